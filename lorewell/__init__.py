"""Spark-native building blocks for retrieval corpora: ingest, sync, chunking, retrieval and bookkeeping."""
