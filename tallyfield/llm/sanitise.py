"""Personal data: base patterns by position, then information-theoretic sanitisation of terms.

Base spans come from four patterns, leftmost and non-overlapping per kind; a match that fails its
check is dropped. Their values are the protected entities. How strongly a term ``t`` reveals an entity
``e`` is estimated from the corpus as pointwise mutual information over the entity's own information:

    disclosure(t, e) = log2(n(t, e) * D / (n(t) * n(e))) / log2(D / n(e)),   at most 1

with D documents, n(t) and n(e) those that hold the term or the entity, and n(t, e) those where the
term stands within ``near`` words of the entity, across line ends; rows that repeat id and text are one
document. All three count the same tokens: runs without white space, without the punctuation around
them; a token that touches an entity is none. A pair needs ``support`` documents with different
contexts, so that copies of one passage prove nothing. In every document, whether it holds the entity
or not, terms whose disclosure reaches ``remove_at`` are removed, those that reach ``generalise_at``
become ``[TERM]``.

Everything is DataFrame code. Terms are counted within tasks before they are dealt; entities are joined
under a salt, since one may hold a large part of all rows. Chosen terms are broadcast if their measured
bytes are few, else dealt.
Places are running sums, so texts with many spans take time in proportion.

Defined results: null and empty texts have no spans; repeated rows get the same spans each; of terms and
spans that tie all count, ordered by start and kind; very long texts are read whole; extra columns of any
name are kept in ``row`` and not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed order of the kinds. The patterns find what the plain forms in the comments find, in linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; a local part starts where its run or the search starts
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no valid match of the kind.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": "", "term": "[TERM]"}
#: Measured bytes of terms, or of the documents that hold them, up to which they are broadcast, and of one such row beside its text.
BROADCAST_BYTES, ROW_BYTES = 8_000_000, 64
#: Parts into which each entity's rows are dealt.
SALTS = 16
SPAN = "array<struct<kind:string,at:int,end:int,value:string>>"


def _luhn(digits: Column) -> Column:
    """The check sum of 12 to 19 digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda x: F.length(F.regexp_replace(x, "^0+(?=.)", "")) <= 3  # noqa: E731  else too large, whatever it is
        return F.forall(F.split(value, r"\."), lambda x: F.when(small(x), F.right(x, F.lit(3)).cast("int") <= 255).otherwise(False))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _spans(kind: str, text: Column) -> Column:
    """Valid matches of a kind with their places in code points, end exclusive."""
    rest, found = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    # the piece after the last match has no match beside it
    pairs = F.filter(F.arrays_zip(rest.alias("rest"), found.alias("value")), lambda x: x["value"].isNotNull())

    def placed(p: Column) -> Column:
        ends = common.running_sums(F.transform(p, lambda x: F.length(x["rest"]) + F.length(x["value"])))
        spans = lambda e: F.transform(p, lambda x, i: _span(F.lit(kind), F.get(e, i) - F.length(x["value"]), F.get(e, i), x["value"]))
        return F.filter(common.let(ends, spans), lambda s: _valid(kind, s["value"]))

    return F.when(text.rlike(NEEDS[kind]), common.let(pairs, placed)).otherwise(F.array().cast(SPAN))


def _span(kind: Column, at: Column, end: Column, value: Column) -> Column:
    return F.struct(kind.alias("kind"), at.alias("at"), end.alias("end"), value.alias("value"))


def ordered(spans: Column, kinds: tuple[str, ...] = (*KINDS, "removed", "term")) -> Column:
    """By start, then by kind in the fixed order."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["at"].alias("at"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"], s["at"], s["end"], s["value"]))


def base_spans(text: Column) -> Column:
    """All base spans of a text, ordered."""
    return ordered(F.concat(*[_spans(k, text) for k in KINDS]))


def bare(token: Column) -> Column:
    """A token without the punctuation before and after it; possessive and anchored, so in linear time."""
    return F.regexp_replace(token, r"^[^\p{L}\p{M}\p{N}]++|(?<=[\p{L}\p{M}\p{N}])[^\p{L}\p{M}\p{N}]++$", "")


def _nearest(short: Column, whole: Column, was_cut: Column, near: int, backwards: bool) -> Column:
    """The ``near`` words next to a span, nearest first; the whole side is read only if a short one may have split the last.

    A token that touches the span is part of the span's own token, and no word.
    """

    def split(side: Column) -> Column:
        own = F.regexp_replace(side, r"(?<![^ \t-\r])[^ \t-\r]++$" if backwards else r"^[^ \t-\r]++", "")
        found = common.words(F.lower(own))
        return F.reverse(found) if backwards else found

    return F.slice(common.let(split(short), lambda w: F.when(was_cut & (F.size(w) <= near), split(whole)).otherwise(w)), 1, near)


def contexts(texts: DataFrame, near: int) -> DataFrame:
    """(key, entity, terms near it, a hash of the context) of every base span; words count across line ends."""
    held = texts.where(F.col("text").rlike("|".join(NEEDS.values()))).withColumn("spans", base_spans(F.col("text")))
    each = held.select("key", "text", F.explode("spans").alias("s"))
    text, at, end, some = F.col("text"), F.col("s.at"), F.col("s.end"), 40 * near
    entity = F.concat(F.col("s.kind"), F.lit(":"), F.lower("s.value"))
    before = F.substring(text, F.greatest(at + 1 - some, F.lit(1)), F.least(at, F.lit(some)))
    left = _nearest(before, F.substring(text, F.lit(1), at), at > some, near, True)
    right = _nearest(F.substring(text, end + 1, F.lit(some)), F.substring(text, end + 1, F.length(text)), F.length(text) - end > some, near, False)
    sides = each.select("key", entity.alias("entity"), left.alias("left"), right.alias("right"))
    terms = F.array_distinct(F.transform(F.concat("left", "right"), bare))
    return sides.select("key", "entity", F.filter(terms, lambda t: F.length(t) > 1).alias("terms"), F.xxhash64("left", "right").alias("context"))


def disclosures(texts: DataFrame, near: int, support: int) -> DataFrame:
    """(entity, term, n_e, n_te, n_t, n, share) of the terms that stand near an entity in ``support`` contexts."""
    found = common.cut(contexts(texts, near))
    n_entity = found.groupBy("entity").agg(F.count_distinct("key").alias("n_e"), F.count_distinct("context").alias("n_context")).where(F.col("n_context") >= support)
    dealt = n_entity.select("entity", "n_e", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = (
        found.withColumn("salt", F.pmod(F.xxhash64("key", "context"), F.lit(SALTS)).cast("int")).join(dealt, ["entity", "salt"])
        .select("key", "entity", "n_e", "context", F.explode("terms").alias("term"))
        .groupBy("entity", "n_e", "term")
        .agg(F.count_distinct("key").alias("n_te"), F.count_distinct("context").alias("n_seen"))
        .where(F.col("n_seen") >= support)
    )
    pairs = common.cut(pairs)
    # candidates grow towards the whole vocabulary, so terms are counted first, within tasks, and few rows meet
    n_term = _vocabulary(texts).groupBy("term").agg(F.count("*").alias("n_t"))
    scored = pairs.join(n_term, "term").withColumn("n", F.lit(texts.count()))
    mutual = F.log2(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e")))
    share = F.when(F.col("n") > F.col("n_e"), F.least(mutual / F.log2(F.col("n") / F.col("n_e")), F.lit(1.0))).otherwise(0.0)
    return scored.withColumn("share", share)


def held(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, the columns of terms) for each document and each of the terms that it holds."""
    few = common.small(terms, BROADCAST_BYTES, F.octet_length("term") + ROW_BYTES)
    return _vocabulary(texts).join(F.broadcast(terms) if few else terms, "term")


def _vocabulary(texts: DataFrame) -> DataFrame:
    return texts.select("key", F.explode(F.array_distinct(F.transform(common.words(F.lower("text")), bare))).alias("term"))


def disclosing(texts: DataFrame, near: int, support: int, generalise_at: float, remove_at: float) -> DataFrame:
    """(key, term, removed) for every document that holds a term which reveals an entity, be the entity there or not."""
    over = disclosures(texts, near, support).where(F.col("share") >= generalise_at)
    # one row a term, whatever the number of its entities
    return held(texts, common.cut(over.groupBy("term").agg(F.max(F.col("share") >= remove_at).alias("removed"))))


def term_spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, terms' spans): every occurrence of a chosen term in its documents, by the tokens' running length."""
    chosen = common.cut(terms.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("term", "removed"))).alias("chosen")))
    tokens = F.regexp_extract_all(F.col("text"), F.lit(r"[^ \t-\r]+|[ \t-\r]+"), F.lit(0))

    def span(token: Column, end: Column) -> Column:
        value = bare(token)
        kind = F.when(F.col("chosen")[F.lower(value)], F.lit("removed")).otherwise(F.lit("term"))
        # the punctuation before the value stays in the text
        at = end - F.length(token) + F.length(F.regexp_extract(token, r"^[^\p{L}\p{M}\p{N}]*+", 0))
        return F.when(F.col("chosen")[F.lower(value)].isNotNull(), _span(kind, at, at + F.length(value), value))

    placed = lambda t: common.let(common.running_sums(F.transform(t, F.length)), lambda e: F.transform(t, lambda x, i: span(x, F.get(e, i))))
    # the documents are dealt by key only if the chosen ones are too many to broadcast
    few = common.small(chosen, BROADCAST_BYTES, ROW_BYTES + F.aggregate(F.map_keys("chosen"), F.lit(0), lambda a, x: a + F.octet_length(x) + 16))
    found = texts.join(F.broadcast(chosen) if few else chosen, "key")
    return found.select("key", F.filter(common.let(tokens, placed), lambda s: s.isNotNull()).cast(SPAN).alias("more"))


def spans(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    near: int = 8, support: int = 3, generalise_at: float = 0.7, remove_at: float = 0.9,
) -> DataFrame:
    """Per row of docs: its columns in ``row``, ``base`` (base spans) and ``spans`` (with the terms' spans)."""
    texts = docs.select(common.row_key(id_column, text_column).alias("key"), common.whole_text(text_column).alias("text"))
    if texts.groupBy("key").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["key"])
    more = term_spans(texts, disclosing(texts, near, support, generalise_at, remove_at))
    every = docs.select(common.row_key(id_column, text_column).alias("key"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"), base_spans(common.whole_text(text_column)).alias("base"))
    none = F.array().cast(SPAN)
    free = lambda s: ~F.exists("base", lambda b: (b["at"] < s["end"]) & (s["at"] < b["end"]))
    joined = every.join(more, "key", "left").withColumn("more", F.coalesce("more", none))
    return joined.select("row", "base", F.when(F.size("more") == 0, F.col("base")).otherwise(ordered(F.concat("base", F.filter("more", free)))).alias("spans"))


def written(spans: Column, chosen: Column | None = None) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents with every span replaced by its tag; overlapping spans merge under the first tag."""
    found = spans(docs, id_column, text_column, **options)
    text = F.col(f"row.{text_column}")
    tags = F.create_map(*[x for k, v in TAGS.items() for x in (F.lit(k), F.lit(v))])

    def step(a: Column, s: Column) -> Column:
        fresh = s["at"] >= a["end"]
        kept = F.substring(text, a["end"] + 1, s["at"] - a["end"])
        return F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            F.when(fresh, F.concat(a["out"], kept, tags[s["kind"]])).otherwise(a["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(text, a["end"] + 1, F.length(text))))
    new = F.when(F.size("spans") == 0, text).otherwise(clean)
    return found.select(*[(new if c == text_column else F.col(f"row.{c}")).alias(c) for c in docs.columns])
