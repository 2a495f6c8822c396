"""Quality rules as a bitmask ledger: each rule is evaluated once, policies only read bits.

``ledger`` measures every text and stores one failure bit per rule next to the measurements;
``apply_policy`` decides with a versioned mask; ``ablation`` counts what each rule of a policy is
responsible for by bitwise operations on a histogram of masks. Native expressions throughout; no
row leaves its partition.

Defined results: a null text counts as empty (no words, every measurement 0, fails MIN_WORDS);
repeated rows and ties are measured alike, on a threshold a rule does not fail; very long texts are read
whole; extra columns of any name are not read; an empty table gives an empty ledger and no ablation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bit of each rule. Bits are never reused for another rule, so that stored ledgers stay readable.
RULES = {
    "MIN_WORDS": 0,
    "REPEATED_WINDOWS": 1,
    "SYMBOLS": 2,
    "WORD_LENGTH": 3,
    "DUPLICATE_LINES": 4,
    "SHOUTING": 5,
    "STUTTER": 6,
}
#: Masks by version: a document is kept if none of the mask's bits failed.
POLICIES = {
    "base": 1 << RULES["MIN_WORDS"] | 1 << RULES["REPEATED_WINDOWS"],
    "v1": (1 << len(RULES)) - 1,
}
WINDOW = 5


def _windows(words: str) -> Column:
    """A 64-bit hash of every window of five words."""
    at = lambda i, k: F.get(F.col(words), i + F.lit(k))
    return F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: str) -> Column:
    """Words inside windows that occur twice or more: equal hashes meet when sorted, their positions are merged."""
    ranked = F.array_sort(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    repeated = lambda s: F.array_sort(
        F.filter(
            F.transform(s, lambda x, i: F.when((x["h"].eqNullSafe(F.get(s, i - 1)["h"])) | (x["h"].eqNullSafe(F.get(s, i + 1)["h"])), x["p"])),
            lambda p: p.isNotNull(),
        )
    )
    length = lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  evaluates value once
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bound(ranked, lambda s: bound(repeated(s), length))).otherwise(0)


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and every measurement of the whole text. Exact but for a 64-bit hash of word windows within one text."""
    read = docs.select(F.col(id_column).alias("doc_id"), common.whole_text(text_column).alias("text"))
    split = read.withColumn("words", common.words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    hashed = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
        F.size(F.filter(F.transform("words", lambda w, i: w == F.get("words", i - 1)), lambda same: same)).cast("long").alias("n_same_as_last"),
        lines.alias("lines"),
        _windows("words").alias("hashes"),
    )
    return hashed.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_capitals",
        "n_same_as_last",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered("hashes").cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``, each rule evaluated once per text."""
    fails = {
        "MIN_WORDS": F.col("n_words") < 10,
        "REPEATED_WINDOWS": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "SYMBOLS": 10 * F.col("n_symbols") > F.col("n_words"),
        "WORD_LENGTH": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        "DUPLICATE_LINES": (F.col("n_dup_lines") > 2) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "SHOUTING": 10 * F.col("n_capitals") > 4 * F.col("word_chars"),
        "STUTTER": 10 * F.col("n_same_as_last") > 2 * F.col("n_words"),
    }
    bits = sum((F.when(test, F.lit(1 << RULES[name])).otherwise(F.lit(0)) for name, test in fails.items()), F.lit(0))
    return measure(docs, id_column, text_column).withColumn("fail_bits", bits.cast("int"))


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """``kept`` by the mask of a policy version; rules are not evaluated again."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail it alone, and rows kept without it.

    The ledger is first aggregated by mask (at most two to the number of rules groups); only these
    groups meet the rules.
    """
    mask = POLICIES[version]
    groups = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).alias("bit")) for name, bit in RULES.items() if mask >> bit & 1])
    each = groups.select("bits", "n", F.explode(rules).alias("r"))
    failed = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        count(failed).alias("n_failed"), count(failed & (rest == 0)).alias("n_only_this"), count(rest == 0).alias("n_kept_without")
    )
