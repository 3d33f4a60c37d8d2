"""A chunk store in Parquet, one folder a project, and a table of chunks by content that spares the chunker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import scalars as S
from lorewell.operators import corpus
from lorewell.sources.staging import delete, discard, file_system, staged

#: Files of one project that a rewrite makes at most, so a project with a third of all rows is that many tasks' work.
SPREAD = 32


def project_of(column: Column) -> Column:
    """A project id as a string; one that is null or empty is an error when it is read, never a wider scope."""
    missing = F.raise_error(F.lit("a read needs a project: project_id is null or empty"))
    return F.coalesce(F.nullif(column.cast("string"), F.lit("")), missing.cast("string"))


def scope_of(rows: DataFrame) -> DataFrame:
    """The distinct project_id of rows; see project_of()."""
    # A comparison, not only a null test, so that the optimizer finds it worth pruning partitions by.
    return rows.select(project_of(F.col("project_id")).alias("project_id")).filter(F.col("project_id") > "").distinct()


class ChunkStore:
    """Chunks under root/chunks/project_id=.../, and rows that were refused under root/rejected/.

    Every read names its projects and reads their folders alone; every write rewrites the folders of the projects it
    touches, from a staged copy, by dynamic partition overwrite: files of other projects stay as they are, and a write
    that was cut off is repeated from the start. One writer at a time. A chunk is known by (project_id, document_id,
    chunk_index): a document of another project never meets it, whatever its id."""

    KEY = ["project_id", "document_id", "chunk_index"]
    CHANGED = ["start_line", "end_line", "content", "content_hash", "token_count", "embedding"]
    SCHEMA = "id string, document_id string, chunk_index int, start_line int, end_line int, content string, content_hash string, token_count int, embedding array<float>, file_path string, language string, created_at timestamp, project_id string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.path = spark, root, f"{root}/chunks"
        fs, at = file_system(spark, self.path)
        fs.mkdirs(at)

    def read(self, scope: str | list[str] | DataFrame) -> DataFrame:
        """Chunks of the projects of scope: an id, a list of ids, or rows with project_id. None, an empty id or a null is an
        error. Ids become partition filters; rows prune by a subquery at run time."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        if isinstance(scope, DataFrame):
            return rows.join(scope_of(scope), "project_id", "left_semi")
        ids = [scope] if isinstance(scope, str) else scope
        if ids is None or not all(isinstance(i, str) and i for i in ids):
            raise ValueError("a read needs a project")
        return rows.filter(F.col("project_id").isin(ids))

    def rejected(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/rejected")

    def _rows(self, rows: DataFrame) -> DataFrame:
        """rows with all columns of the store; what isn't given is null."""
        have = set(rows.columns)
        cols = [f.strip().split(" ", 1) for f in self.SCHEMA.replace("array<float>", "array<float>").split(", ")]
        return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in cols])

    def _accepted(self, rows: DataFrame) -> DataFrame:
        """rows staged, less those without a project, a document, an index or an embedding, which are put aside."""
        given = staged(self._rows(rows))
        bad = corpus.rejected(given, [*self.KEY, "embedding"])
        given.filter(bad).write.mode("append").parquet(f"{self.root}/rejected")
        return given.filter(~bad)

    def upsert(self, rows: DataFrame) -> None:
        """Inserts rows, or overwrites the columns CHANGED of those that are there: id, file_path, language and created_at
        keep their old value. A new row without an id gets one, and the time of the write where it has none. Of rows with one key one stays;
        rows without a project, document, index or embedding go to rejected()."""
        new = self._accepted(rows)
        touched = staged(scope_of(new))
        merged = corpus.upsert(self.read(touched).select(*self.KEY, *self._rest()), new.select(*self.KEY, *self._rest()), self.KEY, self.CHANGED)
        self._write(touched, merged)

    def replace_documents(self, rows: DataFrame) -> None:
        """All chunks of the documents that rows belong to are replaced by rows, so a document that became shorter keeps no
        stale ones. Rows that are refused (see upsert()) replace nothing."""
        new = self._accepted(rows)
        touched = staged(scope_of(new))
        old = corpus.delete_rows(self.read(touched), new, ["project_id", "document_id"]).select(*self.KEY, *self._rest())
        none = old.limit(0)
        self._write(touched, old.unionByName(corpus.upsert(none, new.select(*self.KEY, *self._rest()), self.KEY, self.CHANGED)))

    def delete_documents(self, gone: DataFrame) -> None:
        """Deletes the chunks of gone(project_id, document_id)."""
        gone = staged(gone.select("project_id", F.col("document_id").cast("string").alias("document_id")))
        touched = staged(scope_of(gone))
        self._write(touched, corpus.delete_rows(self.read(touched), gone, ["project_id", "document_id"]))

    def delete_projects(self, gone: DataFrame) -> None:
        touched = staged(scope_of(gone))
        self._write(touched, self.read(touched).limit(0))

    def counts(self, scope: str | list[str] | DataFrame) -> DataFrame:
        return self.read(scope).groupBy("project_id").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))

    def retrieve(self, queries: DataFrame, k: int = 5, **how) -> DataFrame:
        """corpus.hybrid_retrieve() over the folders of the queries' projects."""
        found = self.read(queries.select("project_id")).withColumnRenamed("embedding", "vector")
        return corpus.hybrid_retrieve(queries, found.withColumn("id", F.coalesce("id", F.lit(""))), k, **how)

    def _rest(self) -> list[str]:
        return [f.split(" ", 1)[0] for f in self.SCHEMA.split(", ") if f.split(" ", 1)[0] not in self.KEY]

    def _write(self, touched: DataFrame, merged: DataFrame) -> None:
        full = merged.withColumn("id", F.coalesce("id", F.expr("uuid()"))).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
        spread = F.pmod(F.xxhash64("document_id"), F.lit(SPREAD))
        ready = staged(self._rows(full).repartition("project_id", spread))
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(self.path)
        # A folder that nothing is left of isn't overwritten, so it is deleted here, one name at a time.
        for row in touched.join(ready.select("project_id").distinct(), "project_id", "left_anti").toLocalIterator():
            name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(row.project_id)
            delete(self.spark, f"{self.path}/project_id={name}")
        discard(ready)
        discard(touched)


class ChunkTable:
    """Chunks by content: (content_hash of the whole text, kind of boundaries, options) -> its chunks, each text once.

    fill() chunks only texts that the table hasn't got; of() joins documents to it. So equal texts, later queries and later
    runs share one walk, and no plan holds the chunker more than once. A fill that is repeated after a failure adds
    nothing twice, as files of a failed write are never committed; two writers at once may, so one writes at a time."""

    SCHEMA = "text_hash string, kind string, chunk_index int, start_line int, end_line int, content string, content_hash string, token_count int"

    def __init__(self, spark: SparkSession, path: str, target: int = 384, overlap: int = 40, most: int = 100):
        self.spark, self.options = spark, (target, overlap, most)
        self.path = f"{path}/{target}-{overlap}-{most}"
        fs, at = file_system(spark, self.path)
        fs.mkdirs(at)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    @staticmethod
    def _key(docs: DataFrame) -> tuple[Column, Column]:
        language = F.lower(F.col("language")) if "language" in docs.columns else F.lit("")
        kind = F.lit("")
        for name in S.BOUNDARIES:
            if name:
                kind = F.when(S.has_boundaries(language, name), name).otherwise(kind)
        return F.sha2(F.col("text"), 256), kind

    def fill(self, docs: DataFrame) -> None:
        """Adds the chunks of docs(text, and language if there is one) that aren't here yet."""
        hash_, kind = self._key(docs)
        given = docs.filter(S.non_blank(F.col("text"))).select(hash_.alias("text_hash"), kind.alias("kind"), "text")
        have = self.read().filter("chunk_index = 0").select("text_hash", "kind")
        new = given.groupBy("text_hash", "kind").agg(F.any_value("text").alias("text")).join(have, ["text_hash", "kind"], "left_anti")
        made = corpus.chunk_documents(new.select(F.struct("text_hash", "kind").alias("id"), "text", F.col("kind").alias("language")), *self.options)
        made.select("id.*", *[c for c in made.columns if c != "id"]).write.mode("append").parquet(self.path)

    def of(self, docs: DataFrame) -> DataFrame:
        """What corpus.chunk_documents() gives for docs(id, text, language), read from the table."""
        hash_, kind = self._key(docs)
        asked = docs.filter(S.non_blank(F.col("text"))).select("id", hash_.alias("text_hash"), kind.alias("kind"))
        return asked.join(self.read(), ["text_hash", "kind"]).drop("text_hash", "kind")
