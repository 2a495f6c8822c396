"""Helpers shared by the operators: reading tables, row keys, text expressions, checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removes a query's shuffle files when it ends: what is written need not be computed again.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space of the word definitions: space and U+0009 to U+000D.
SPACE = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are; ``lower`` does the same, faster, on ASCII texts."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words(text: Column) -> Column:
    """Maximal runs without white space, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's id and text; rows that share it are repeats and share their results.

    A hash passes over nulls, so that (null, x) and (x, null) would share a key: each column counts with
    whether it is null, its length and its value.
    """
    told = F.struct(*[part for c in columns for part in _told(F.col(c).cast("string"))])
    return F.struct(F.xxhash64(told).alias("a"), F.xxhash64(F.lit(7), told).alias("b"))


def _told(value: Column) -> tuple[Column, Column, Column]:
    return value.isNull(), F.coalesce(F.octet_length(value), F.lit(0)), F.coalesce(value, F.lit(""))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of checkpoints: the session's setting. A local session without one, as in tests, gets one of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "tallyfield-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def in_training(doc_id: Column, modulus: int, left_out: int) -> Column:
    """Rows that may be learned from; a null id is one of them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) != left_out, F.lit(True))


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared checkpoint folder: read from there, it needs no recomputation."""
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(frame.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for frame in frames:
        for folder in {path.rsplit("/", 1)[0] for path in frame.inputFiles()}:
            where = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, sample: int, sample_bytes: int) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample: at most ``sample`` ids per class by hash of the id, none of those left out.

    The sample is drawn from the labels, so only its texts meet the documents, in a broadcast of at most
    twice ``sample`` ids. An id has one text (of several rows, the smallest text of at most ``sample_bytes``)
    and one label (with both, it is not learned from), so that at most ``2 * sample * sample_bytes`` bytes
    reach the driver.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label")).where("__id is not null and __label in (0, 1)")
    known = known.where(in_training(F.col("__id"), modulus, left_out))
    known = known.groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__most")).where("__label = __most").drop("__most")
    order = [F.xxhash64("__id"), F.col("__id")]
    drawn = known.where("__label = 1").orderBy(*order).limit(sample).union(known.where("__label = 0").orderBy(*order).limit(sample))
    texts = docs.select("doc_id", "text").where((F.octet_length("text") <= sample_bytes))
    found = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("__id")).groupBy("__id", "__label").agg(F.min("text").alias("text"))
    rows = found.toPandas().sort_values(["__id"], kind="stable")
    return rows["text"].tolist(), rows["__label"].astype(int).tolist()


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running_sums(values: Column) -> Column:
    """The sums of an int array up to each place, in two levels of about the root of its size, so that few elements are copied."""
    none = F.array().cast("array<int>")
    upto = lambda part: F.aggregate(part, none, lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))
    size = lambda v: F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
    parts = lambda v: F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / size(v)).cast("int")), lambda c: upto(F.slice(v, c * size(v) + 1, size(v))))
    before = lambda p: F.concat(F.array(F.lit(0)), upto(F.transform(p, lambda x: F.get(x, F.size(x) - 1))))
    joined = lambda p: let(before(p), lambda b: F.flatten(F.transform(p, lambda x, i: F.transform(x, lambda y: y + F.get(b, i)))))
    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(let(parts(v), joined)))


def small(frame: DataFrame, byte_bound: int, row_bytes: Column) -> bool:
    """Whether the rows, measured first, take at most ``byte_bound`` bytes; what is broadcast is held against this."""
    return (frame.agg(F.sum(row_bytes).alias("n")).first()["n"] or 0) <= byte_bound
