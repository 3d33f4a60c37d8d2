"""Helpers that the operators share: text rules, scratch tables and folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word of the contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bits of the filter that sieved() broadcasts, in words of 64: 2 MB of bits at any size of the data.
FILTER_BITS = 24
#: Tasks that the rows of one hot key are spread over.
SALTS = 64


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; lower() would change other letters too, so it is used where a text has no others (it is
    many times as fast as translate())."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(name: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def fingerprint_of(text: Column) -> Column:
    """With the id, tells rows apart where a result is joined back. Never decides whether texts are equal."""
    return F.xxhash64(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no column of ours can clash with one of them."""
    return F.struct(*map(column, df.columns))


def hash_of_row(df: DataFrame) -> Column:
    """A number by which rows that tie in all else are put in order; maps and variants have no hash and are left out."""
    return F.xxhash64(*[column(c) for c, kind in df.dtypes if "map<" not in kind and kind != "variant"])


def sieved(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """rows with the column maybe: false where the key surely isn't among those of wanted.

    The wanted keys set bits of a filter of 2 ** FILTER_BITS, which is broadcast as (word, mask) rows: 262 144 of them at
    most, however many keys there are. The more keys, the more other rows pass as well; a wanted row always does. So what
    follows may join only the rows that pass, and their texts alone are shuffled."""
    place = F.pmod(F.xxhash64(*key), F.lit(1 << FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))
    words = wanted.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("mask"))
    words = staged(words)  # read more than once
    met = rows.withColumn("place", place).join(F.broadcast(words), F.shiftright("place", 6) == F.col("word"), "left")
    maybe = F.coalesce(F.getbit("mask", F.col("place").bitwiseAND(63).cast("int")) == 1, F.lit(False))
    return met.withColumn("maybe", maybe).drop("place", "word", "mask")


def salt_of(id_: str) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(SALTS)).cast("int")


def salts_of(id_: str) -> Column:
    """Aggregate: which salts the rows of a group have, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt_of(id_)))


def salted(groups: DataFrame) -> DataFrame:
    """groups(salts, ...) -> one row for each salt that the group's rows have: joined on it too, the rows of a hot group
    are spread over SALTS tasks, and a small group is not multiplied beyond its rows."""
    each = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)
    return groups.withColumn("salt", F.explode(each)).drop("salts")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of this machine only where none is named and this machine is all
    there is, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and lost executors cost no rework."""
    path = f"{scratch(df.sparkSession)}/lorewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of staged() that no later plan reads."""
    path = getattr(df, "_staged_at", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
