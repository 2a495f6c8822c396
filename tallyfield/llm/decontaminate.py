"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Items are cut into windows of ``n`` words (a shorter item is one window). A window is a set of
(word, place) tokens and an occurrence must contain all of them, so with tokens ordered by rarity a
prefix of one token, the rarest, is necessary. The rarest word of each window joins the words of the
documents; its place bounds the start, the text's length bounds the end, and the survivors are
verified word for word.

The windows are broadcast only if their measured bytes are few; otherwise Spark deals both sides by word
under a salt, since the rarest word of a window of common words is common, and fetches the words of a
document only for the places that remain.

Defined results: null and word-free texts have no words and no hits; an item without words has no
window; repeated items count once per id; of a window's words that tie in rarity the first in the order
of words counts; very long texts are read whole; repeated rows get the same result each; extra columns
of any name are kept or not read; empty tables give empty results or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Measured bytes of windows up to which they are broadcast, and of one beside its words.
BROADCAST_BYTES, ROW_BYTES = 64_000_000, 160
#: Parts into which each word's rows are dealt.
SALTS = 16
#: Everything but ASCII letters, digits and non-ASCII characters parts words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased (A-Z) words."""
    return F.array_remove(F.split(common.ascii_lower(text), NOT_WORD), "")


def windows(items: DataFrame, id_column: str, text_column: str, n: int) -> DataFrame:
    """item_id and each distinct window of its words."""
    split = items.select(F.col(id_column).cast("string").alias("item_id"), item_words(common.whole_text(text_column)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    return split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, n))).alias("win")).groupBy("win").agg(
        F.collect_set("item_id").alias("item_ids")
    )


def rarest(wins: DataFrame, texts: DataFrame) -> DataFrame:
    """Each window with its rarest word and that word's place, by the words' counts over all texts."""
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    counts = texts.select(F.explode("w").alias("word")).groupBy("word").count()
    counts = vocabulary.join(counts, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("n"))
    placed = wins.select("win", F.posexplode("win").alias("place", "word")).join(counts, "word")
    best = placed.groupBy("win").agg(F.min(F.struct("n", "word", "place")).alias("best"))
    return wins.join(best, "win").select("win", "item_ids", F.col("best.word").alias("word"), F.col("best.place").alias("place"))


def find(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_id: str = "item_id", item_text: str = "text", n: int = 10, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document with a hit: key, starts (struct of start and length), item ids."""
    texts = docs.select(common.row_key(id_column, text_column).alias("key"), item_words(common.whole_text(text_column)).alias("w"))
    wins = common.cut(rarest(windows(items, item_id, item_text, n), texts))
    start, size = F.col("pos") - F.col("place"), F.size("win")
    placed = (start >= 0) & (start + size <= F.col("size"))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, size) == F.col("win")
    if common.small(wins, broadcast_bytes, F.octet_length(F.array_join("win", " ")) + F.octet_length(F.array_join("item_ids", " ")) + ROW_BYTES):
        tokens = texts.select("key", "w", F.size("w").alias("size"), F.posexplode("w").alias("pos", "word"))
        hits = tokens.join(F.broadcast(wins), "word").where(placed).where(same)
    else:
        tokens = texts.select("key", F.size("w").alias("size"), F.posexplode("w").alias("pos", "word"))
        tokens = tokens.withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int"))
        dealt = wins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = tokens.join(dealt, ["word", "salt"]).where(placed).join(texts, "key").where(same)
    return hits.select("key", F.struct(start.alias("start"), size.alias("length")).alias("at"), "item_ids").groupBy("key").agg(
        F.array_sort(F.collect_set("at")).alias("starts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids")
    )


def covered(starts: Column) -> Column:
    """Number of words inside the sorted windows, each counted once."""
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(x["start"] + x["length"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"),
        F.greatest(a["end"], x["start"] + x["length"]).alias("end"),
    )
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])


def report(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids, contaminated."""
    found = find(docs, items, id_column, text_column, **options)
    every = docs.select(
        F.col(id_column).alias("doc_id"),
        common.row_key(id_column, text_column).alias("key"),
        F.size(item_words(common.whole_text(text_column))).cast("long").alias("n_words"),
    )
    return every.join(found, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(covered(F.col("starts")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("starts").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents without any hit, with all their columns."""
    found = find(docs, items, id_column, text_column, **options).select(F.col("key").alias("__hit"))
    keyed = docs.withColumn("__key", common.row_key(id_column, text_column))
    return keyed.join(found, F.col("__key") == F.col("__hit"), "left_anti").drop("__key")
