"""The registered queries of the operators and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, decontaminate, main_text, near_duplicates, packing, passage_quality, piece_counts, rule_ledger, sanitise, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text under a context tree learned from six sevenths of them."""
    return context_tree.score(table(spark, sf_dir, "documents"))


def op2_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of personal data and those of the terms that reveal them, for every document."""
    rows = sanitise.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(sanitise.written(F.col("base")), 256)
    return rows.select(
        "row.doc_id", *[count(k) for k in sanitise.KINDS], digest.alias("base_sha256"), sanitise.written(F.col("spans")).alias("spans")
    )


def op2_sanitisation_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base part of ``op2_sanitisation``, which SQL can express."""
    return op2_sanitisation(spark, sf_dir).drop("spans")


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, rule bits and the verdict of the current policy for every document."""
    rows = rule_ledger.apply_policy(rule_ledger.ledger(table(spark, sf_dir, "documents")), "v1")
    base = F.col("fail_bits").bitwiseAND(F.lit(rule_ledger.POLICIES["base"])) != 0
    measures = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(*measures, base.alias("base_failed"), "kept", "fail_bits", F.lit("v1").alias("policy"))


def op3_rule_ledger_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy is responsible for."""
    return rule_ledger.ablation(rule_ledger.ledger(table(spark, sf_dir, "documents")), "v1")


def op4_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document and the greedy longest-match pieces that they fall into."""
    return piece_counts.count(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside any benchmark window of ten words."""
    rows = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie on every machine; they are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in sequences of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are similar by 80 percent or more."""
    rows = near_duplicates.classify(table(spark, sf_dir, "documents"), size=2)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of toxicity of every document by compression with two dictionaries."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.extract(table(spark, sf_dir, "pages"))


def op10_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of good quality of every document by gated attention over its passages."""
    rows = passage_quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select("row.doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Query] = {
    "op1_context_tree": op1_context_tree,
    "op2_sanitisation": op2_sanitisation,
    "op3_rule_ledger": op3_rule_ledger,
    "op4_piece_counts": op4_piece_counts,
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_toxicity": op8_toxicity,
    "op9_main_text": op9_main_text,
    "op10_passage_quality": op10_passage_quality,
    "op2_sanitisation_base": op2_sanitisation_base,
    "op3_rule_ledger_ablation": op3_rule_ledger_ablation,
}

_SPACE = r"[^ \t\n\x0B\x0C\r]+"

#: Measurements and failure bits of every document, as common table expressions.
_LEDGER = rf"""        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_SPACE}') AS w,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS l FROM d),
        p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
        g AS (SELECT r, i, len(list(x) OVER f) AS k, list(x) OVER f AS g FROM p
              WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
        t AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE k = 5),
        c AS (SELECT DISTINCT r, i + o AS i FROM t, range(5) AS s(o) WHERE n > 1),
        n AS (SELECT r, count(*) AS n_repeat_words FROM c GROUP BY r),
        m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                     len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                     len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals, len(l)::BIGINT AS n_lines,
                     len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_same,
                     (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                     coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
              FROM w LEFT JOIN n USING (r)),
        b AS (SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
                     + 8 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
                     + 16 * (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)::INT
                     + 32 * (10 * n_capitals > 4 * word_chars)::INT + 64 * (10 * n_same > 2 * n_words)::INT)::INTEGER AS fail_bits FROM m)
"""

#: The base patterns in their plain form, with the test of a match.
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(right(x, 3) AS INTEGER) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"""length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN CAST({_DIGITS}[-i] AS INTEGER) WHEN CAST({_DIGITS}[-i] AS INTEGER) > 4 THEN 2 * CAST({_DIGITS}[-i] AS INTEGER) - 9
             ELSE 2 * CAST({_DIGITS}[-i] AS INTEGER) END)) % 10 = 0"""),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
)

ORACLES: dict[str, str] = {
    "op2_sanitisation_base": "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), "
    + ", ".join(
        f"""{kind} AS (SELECT r, '{kind}' AS kind, {o} AS o, v, a + coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) AS a FROM (
            SELECT r, i, m[i] AS v, s, coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
            FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS s FROM d),
                 LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)) WHERE {test})"""
        for o, (kind, pattern, test) in enumerate(_BASE)
    )
    + """, x AS (SELECT * FROM email UNION ALL SELECT * FROM ip UNION ALL SELECT * FROM card UNION ALL SELECT * FROM phone),
        y AS (SELECT r, count_if(o = 0) AS e, count_if(o = 1) AS i, count_if(o = 2) AS c, count_if(o = 3) AS p,
                     string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + length(v) AS BIGINT), ',' ORDER BY a, o) AS told FROM x GROUP BY r)
        SELECT doc_id, coalesce(e, 0)::BIGINT AS n_email, coalesce(i, 0)::BIGINT AS n_ip, coalesce(c, 0)::BIGINT AS n_card, coalesce(p, 0)::BIGINT AS n_phone,
               sha256(coalesce(told, '')) AS base_sha256
        FROM d LEFT JOIN y USING (r)""",
    "op3_rule_ledger": _LEDGER + """
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept,
               fail_bits, 'v1' AS policy
        FROM b""",
    "op3_rule_ledger_ablation": _LEDGER + """
        , r AS (SELECT * FROM (VALUES ('MIN_WORDS', 1), ('REPEATED_WINDOWS', 2), ('SYMBOLS', 4), ('WORD_LENGTH', 8), ('DUPLICATE_LINES', 16),
                                      ('SHOUTING', 32), ('STUTTER', 64)) AS v(rule, bit))
        SELECT rule, count(*) FILTER (WHERE (fail_bits & bit) <> 0)::BIGINT AS n_failed, count(*) FILTER (WHERE fail_bits = bit)::BIGINT AS n_only_this,
               count(*) FILTER (WHERE (fail_bits & ~bit) = 0)::BIGINT AS n_kept_without
        FROM b, r GROUP BY rule""",
    "op7_near_duplicates": rf"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}') AS w FROM documents),
        s AS (SELECT DISTINCT r, w[i] || ' ' || w[i + 1] AS g FROM d, LATERAL (SELECT unnest(range(1, len(w))) AS i) WHERE len(w) > 1
              UNION ALL SELECT r, w[1] FROM d WHERE len(w) = 1),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n AS x ON x.r = a JOIN n AS y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        t AS (SELECT r, doc_id AS m FROM d UNION SELECT e.b, t.m FROM t JOIN e ON e.a = t.r)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(m) AS component_id, doc_id = min(m) AS kept
        FROM d LEFT JOIN n USING (r) JOIN t USING (r) GROUP BY r, doc_id, n""",
    "op5_decontamination": r"""
        WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s + 1, s + 10), ' ') AS g, least(len(w), 10) AS k
              FROM i, LATERAL (SELECT unnest(range(greatest(len(w) - 10, 0) + 1)) AS s) WHERE len(w) > 0),
        d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        k AS (SELECT DISTINCT k FROM g),
        p AS (SELECT r, w, k, unnest(range(len(w) - k + 1)) AS s FROM d, k WHERE len(w) >= k),
        o AS (SELECT r, s, k, array_to_string(list_slice(w, s + 1, s + k), ' ') AS g FROM p),
        h AS (SELECT r, s, o.k, item_id FROM o JOIN g ON o.g = g.g AND o.k = g.k),
        c AS (SELECT r, count(DISTINCT s + j) AS n_hit FROM h, LATERAL (SELECT unnest(range(k)) AS j) GROUP BY r),
        t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
              FROM h GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)""",
}
