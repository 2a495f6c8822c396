"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is the running stream of its lower-cased words, one space between two, and a closing 0x0A; it is
read as if line ends stood before it. The context of a byte are the ``depth`` bytes before it, across
words. Each byte is eight binary decisions, and each decision has a context tree of its own: a node keeps
a Krichevsky-Trofimov estimate, and its weighted probability is half that estimate plus half the product
of its children's. The probability of a byte is that of the weighted tree of the training texts, which
mixes the estimates of all depths along the byte's path; contexts that training never saw give one half.

The tree is complete: every context of every training text is a node, so it grows with the corpus, and
it is never gathered. It is a DataFrame per depth with one row for each (context, decision). Going up,
counts and log probabilities of children are sums by the parent's key, combined before they are
shuffled; going down, a row meets its parent's (a parent has at most 256 children of a decision).

Texts are dealt into blocks. A block counts its distinct grams (context and byte) and words; they meet
the tree and the word counts once a block, and then the block's texts: no row per occurrence is shuffled,
and a key, however frequent, has one row a block at most.

Defined results: null and empty texts are the end alone; a null id is never held out; rows that repeat id
and text count repeatedly in training, are read once and scored alike, as are ties; very long texts are
read in slices; extra columns of any name are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of context; a gram and a tree key fit into 64 bits up to 6.
DEPTH = 5
BLOCK_BYTES, SLICE_BYTES, MERGE_ROWS = 20_000_000, 1_000_000, 1_500_000
#: Measured bytes of gram scores up to which they are broadcast, else dealt, and of one of them.
BROADCAST_BYTES, SCORE_BYTES = 160_000_000, 80


def tokens(texts: pa.ChunkedArray | pa.Array) -> pa.ListArray:
    """The lower-cased (A-Z) words of each text; words are parted at space and U+0009 to U+000D."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    words = pc.ascii_split_whitespace(texts)
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar([], words.type), words)


def streams(words: pa.ListArray, depth: int) -> pa.Array:
    """What is coded of each text, behind the line ends that the first contexts see."""
    told = lambda x: pa.scalar(x, pa.large_string())
    return pc.binary_join_element_wise(told("\n" * depth), pc.binary_join(words, told(" ")), told("\n"), told(""))


def grams(some: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every coded byte (the byte lowest, then the context, latest first), and how many each stream has."""
    starts = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
    n = int(starts[-1] - starts[0])
    data = b"\0" * 7 + some.buffers()[2].slice(int(starts[0]), n).to_pybytes() + b"\0" * 8
    out = np.empty(-(-n // 8) * 8, np.uint64)
    for k in range(8):
        out[k::8] = np.frombuffer(data, ">u8", len(out) // 8, k)
    coded = np.ones(n, bool)
    for k in range(depth):
        coded[starts[:-1] - starts[0] + k] = False
    return out[:n][coded] & np.uint64((1 << 8 * (depth + 1)) - 1), np.diff(starts) - depth


def _distinct(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs, or its total weight."""
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    total = np.diff(np.append(first, len(values))) if weights is None else np.add.reduceat(weights, first) if len(first) else weights
    return values[first], total


def _slices(texts: pa.ChunkedArray) -> Iterator[tuple[slice, pa.ListArray]]:
    """Consecutive texts of about SLICE_BYTES bytes, and their words."""
    sizes = pc.binary_length(pc.fill_null(texts, "")).to_numpy().astype(np.int64)
    ends = np.flatnonzero(np.diff(np.append(np.cumsum(sizes) // SLICE_BYTES, -1))) + 1
    for start, end in zip(np.append(0, ends)[:-1].tolist(), ends.tolist(), strict=True):
        yield slice(start, end), tokens(texts[start:end])


def _count_block(table: pa.Table, depth: int) -> pa.Table:
    """(block, gram or word, count in training) of the distinct grams and words of a block of texts."""
    weights = np.where(table["train"].to_numpy(), table["n"].to_numpy(), 0)
    known_parts, count_parts = [pa.array(["\n"], pa.large_string())], [np.array([weights.sum()])]
    gram_parts = []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        gram, n = (np.concatenate(x) for x in zip(*gram_parts, strict=True))
        gram_parts.clear()
        return _distinct(gram, n)

    for part, words in _slices(table["text"]):
        coded = words.flatten().dictionary_encode()
        known_parts.append(coded.dictionary)
        count_parts.append(np.bincount(coded.indices.to_numpy(), np.repeat(weights[part], pc.list_value_length(words).to_numpy()), len(coded.dictionary)))
        some = streams(words, depth)
        for n in np.unique(weights[part]):
            distinct, count = _distinct(grams(some.filter(pa.array(weights[part] == n)), depth)[0])
            gram_parts.append((distinct, count * n))
        if sum(len(g) for g, _ in gram_parts[1:]) > MERGE_ROWS:
            gram_parts.append(merge())
    gram, n = merge()
    coded = pa.concat_arrays(known_parts).dictionary_encode()
    known = coded.dictionary
    counts = np.bincount(coded.indices.to_numpy(), np.concatenate(count_parts), len(known)).astype(np.int64)
    size = len(gram) + len(known)
    return pa.table({
        "block": pa.array(np.full(size, table["block"][0].as_py(), np.int64)),
        "gram": pa.array(np.concatenate([gram.view(np.int64), np.zeros(len(known), np.int64)]), mask=np.arange(size) >= len(gram)),
        "word": pa.concat_arrays([pa.nulls(len(gram), pa.string()), known.cast(pa.string())]),
        "n": pa.array(np.concatenate([n, counts])),
    })


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up, where it is exact to the last digits."""
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * F.ln(y) - y + float(0.5 * np.log(2 * np.pi)) + (1 / 12 - r * (1 / 360 - r / 1260)) / y - F.ln(product)


def log_kt(zeros: Column, ones: Column) -> Column:
    """Natural log of the probability that the Krichevsky-Trofimov estimator gave the counts, in any order."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - float(np.log(np.pi)) - _log_gamma(zeros + ones + 1.0)


def _decision(symbol: Column, k: int) -> tuple[Column, Column]:
    """The k-th decision of a byte: its number (1 to 255, by the bits before) and the bit taken."""
    number = F.lit(1 << k).cast("long").bitwiseOR(F.shiftrightunsigned(symbol, 8 - k))
    return number, F.shiftrightunsigned(symbol, 7 - k).bitwiseAND(F.lit(1).cast("long"))


def tree(counted: DataFrame, depth: int) -> list[DataFrame]:
    """The rows of each depth, 0 to ``depth``: at (context and decision), a, b (zeros, ones), lw, share.

    lw is the log of the weighted probability and share the part of a node's own estimate in it.
    """
    symbol, context = F.col("gram").bitwiseAND(F.lit(255).cast("long")), F.shiftrightunsigned("gram", 8)
    taken = F.array(*[F.struct(F.shiftleft(context, 8).bitwiseOR(number).alias("at"), bit.alias("bit")) for number, bit in (_decision(symbol, k) for k in range(8))])
    bits = counted.select("n", F.explode(taken).alias("d"))
    deepest = bits.groupBy("d.at").agg(F.sum(F.col("n") * (1 - F.col("d.bit"))).alias("a"), F.sum(F.col("n") * F.col("d.bit")).alias("b"))
    levels = [common.written(deepest.select("at", "a", "b", log_kt(F.col("a"), F.col("b")).alias("lw"), F.lit(1.0).alias("share")), f"depth-{depth}")]
    for d in range(depth - 1, -1, -1):
        parent = F.col("at").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1).cast("long"))
        sums = levels[0].groupBy(parent.alias("at")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("below"))
        own = sums.withColumn("own", log_kt(F.col("a"), F.col("b")))
        high, low = F.greatest("own", "below"), F.least("own", "below")
        weighted = own.withColumn("lw", high + F.log1p(F.exp(low - high)) - float(np.log(2)))
        level = weighted.select("at", "a", "b", "lw", F.exp(F.col("own") - float(np.log(2)) - F.col("lw")).alias("share"))
        levels.insert(0, common.written(level, f"depth-{d}"))  # read twice, up and down
    return levels


def predictions(levels: list[DataFrame]) -> DataFrame:
    """(at, p): for every context of full depth and decision, the weighted tree's probability of a one."""
    estimate = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
    down = levels[0].select("at", (F.col("share") * estimate).alias("sum"), (1 - F.col("share")).alias("rest"))
    for d, level in enumerate(levels[1:], 1):
        parent = F.col("at").bitwiseAND(F.lit((1 << 8 * d) - 1).cast("long"))
        met = level.withColumn("parent", parent).join(down.select(F.col("at").alias("parent"), "sum", "rest"), "parent")
        down = met.select("at", (F.col("sum") + F.col("rest") * F.col("share") * estimate).alias("sum"), (F.col("rest") * (1 - F.col("share"))).alias("rest"))
    return down.select("at", F.col("sum").alias("p"))


def gram_scores(counted: DataFrame, depth: int) -> DataFrame:
    """(gram, score), written: log10 of the probability of the gram's byte in its context."""
    node = F.struct(F.col("at").bitwiseAND(F.lit(255).cast("long")).alias("k"), F.col("p").alias("v"))
    # at most 255 decisions a context
    levels = tree(counted, depth)
    by_context = predictions(levels).groupBy(F.shiftrightunsigned("at", 8).alias("context")).agg(F.map_from_entries(F.collect_list(node)).alias("p"))
    symbol = F.col("gram").bitwiseAND(F.lit(255).cast("long"))
    product = F.lit(1.0)
    for k in range(8):
        number, bit = _decision(symbol, k)
        # p for a one, 1 - p for a zero
        product = product * F.abs(1 - bit - F.element_at("p", number))
    met = counted.select("gram", F.shiftrightunsigned("gram", 8).alias("context")).join(by_context, "context")
    # seven digits, which are shuffled more tightly
    scored = common.written(met.select("gram", F.log10(product).cast("float").cast("double").alias("score")), "gram-scores")
    common.forget(*levels)
    return scored


class Table:
    """Values by 64-bit keys: open addressing in arrays, looked up by whole arrays of keys that are all known."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64).view(np.uint64), np.zeros(1 << self.bits)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == np.uint64(2**64 - 1)]
            self.keys[at[free]] = keys[free]
            self.values[at[free]] = values[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            left = left[self.keys[at[left]] != keys[left]]
        return self.values[at]


def _score_block(docs: pa.Table, known: pa.Table, depth: int) -> pa.Table:
    value, is_gram = known["value"].to_numpy(), known["gram"].is_valid().to_numpy()
    table = Table(known["gram"].drop_null().to_numpy().view(np.uint64), value[is_gram])
    # the end is a token that no text holds as a word
    vocabulary, count = known["word"].drop_null().cast(pa.large_string()), value[~is_gram]
    end = int(count[pc.index(vocabulary, pa.scalar("\n", pa.large_string())).as_py()])
    out = []
    for _, words in _slices(docs["text"]):
        coded, sizes = words.flatten().dictionary_encode(), pc.list_value_length(words).to_numpy().astype(np.int64)
        c = count[pc.index_in(coded.dictionary, value_set=vocabulary).to_numpy()]
        ends = np.append(0, np.cumsum(sizes))
        each = lambda x: np.diff(np.append(0, np.cumsum(x[coded.indices.to_numpy()]))[ends])  # noqa: E731, B023
        gram, n = grams(streams(words, depth), depth)
        scores = np.add.reduceat(table[gram], np.cumsum(n) - n)
        out.append((sizes + 1, each((c > 0).astype(np.int64)) + (end > 0), each(np.log10(c + 1)) + np.log10(end + 1), scores, n))
    n_tokens, n_known, counts, scores, n = (pa.array(np.concatenate(x)) for x in zip(*out, strict=True))
    held_out = pc.invert(docs["train"])
    return pa.table({"doc_id": docs["doc_id"], "held_out": held_out, "n": docs["n"], "n_tokens": n_tokens, "n_known": n_known, "counts": counts, "score": scores, "n_bytes": n})


def score(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", modulus: int = 7, left_out: int = 2,
    depth: int = DEPTH, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6")
    key, text = F.col(id_column), F.col(text_column)
    read = docs.select(key.alias("doc_id"), common.in_training(key, modulus, left_out).alias("train"), text.alias("text"))
    facts = docs.agg(F.sum(F.octet_length(common.whole_text(text_column)) + 1).alias("bytes")).first()
    # a row that many repeat is one row with a count, or its block would hold them all
    repeated = docs.groupBy(common.row_key(id_column, text_column).alias("key")).count().where("count > 1").limit(1).count() > 0
    read = read.groupBy("doc_id", "train", "text").agg(F.count("*").alias("n")) if repeated else read.withColumn("n", F.lit(1).cast("long"))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-(facts["bytes"] or 0) // block_bytes)))).cast("long")
    blocked = read.withColumn("block", block)
    counted = blocked.groupBy("block").applyInArrow(lambda t: _count_block(t, depth), "block long, gram long, word string, n long")
    pairs = common.written(counted, "counted")
    by_word = common.written(pairs.where("word is not null").groupBy("word").agg(F.sum("n").alias("value")), "words")
    total = by_word.where("value > 0").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    by_gram = common.written(pairs.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    scored = gram_scores(by_gram, depth)
    few = common.small(scored, BROADCAST_BYTES, F.lit(SCORE_BYTES))
    grams_known = pairs.where("gram is not null").select("block", "gram").join(F.broadcast(scored) if few else scored, "gram").select("block", "gram", F.lit(None).cast("string").alias("word"), F.col("score").alias("value"))
    words_known = pairs.where("word is not null").select("block", "word").join(by_word, "word").select("block", F.lit(None).cast("long").alias("gram"), "word", F.col("value").cast("double").alias("value"))
    known = grams_known.union(words_known)
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n long, n_tokens long, n_known long, counts double, score double, n_bytes long"
    rows = blocked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda a, b: _score_block(a, b, depth), schema)
    if repeated:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    spread = float(np.log10(total["n"] + total["v"] + 1))
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("counts") - F.col("n_tokens") * spread).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
