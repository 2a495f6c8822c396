"""Best-fit packing by a configuration linear program over the length histogram.

Texts become token ids (with the closing id), longer ones are cut into pieces of the sequence length,
the first possibly shorter. Only the histogram of piece lengths reaches the driver: one number per
length, whatever the corpus holds. There a configuration program (how many sequences of each multiset
of lengths) is solved by multiplicative weights: lengths covered so far lose weight, an unbounded
knapsack program prices the best completion of every length at once, and the configurations found get
fractional multiplicities. These are rounded down, and what is left over is packed by best fit, one
bounded knapsack over the lengths at hand for each kind of sequence. The prices are a dual solution: they bound the number of sequences from below (``lower_bound``).

Pieces are ranked within their length in two levels (chunks of rows, then a prefix sum over chunks), and
meet the plan by intervals of ranks, so a length that many pieces share is never gathered in one task.

A piece finds its place by a binary search in the plan's sorted intervals, which are bounded by the
configurations and not by the corpus.

Defined results: null and empty texts are the closing id alone; repeated rows are packed as rows of
their own; pieces that tie in length are ranked by id, piece and checksum, those that tie in all have
places of their own; very long texts are cut into pieces; extra columns of any name are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
CLOSING_ID = 0
ROUNDS, CONFIGURATIONS = 60, 64
#: Part of each multiplicity that is made; the rest leaves all lengths to the last sequences.
KEPT = 0.9
CHUNK_ROWS = 50_000
#: Bits of a rank in a place's key, beside the length.
RANK_BITS = 48
#: The special token of the vocabulary; as the tokenizers library does by default, its text is read as the token.
SPECIAL = {"<|endoftext|>": 50256}

_encoders: dict[str, object] = {}


def encoder(path: str):
    """A tokenizer of the vocabulary in a tokenizers file, the same ids from a faster library; cached per worker."""
    if path not in _encoders:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        # byte-level vocabularies write each byte as a printable character
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in SPECIAL}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _encoders[path] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[path]


def _pieces(batches, path: str, capacity: int):
    encode = encoder(path).encode_to_numpy
    for batch in batches:
        out = []
        for row, text in enumerate(batch.column("text").to_pylist()):
            ids = np.append(encode(text or "", allowed_special="all").astype("<u4"), np.uint32(CLOSING_ID)).astype("<u4")
            n = len(ids)
            ends = list(range((n - 1) % capacity + 1, n + 1, capacity))
            for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                out.append((row, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        rows, piece, start, length, crc = zip(*out, strict=True) if out else ([],) * 5
        yield pa.RecordBatch.from_pydict({
            "row": batch.column("row").take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
        })


def _knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total value within every capacity by items of all lengths, and the item to take first (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        with_item = best[c - 1 :: -1] + value[1 : c + 1]
        k = int(np.argmax(with_item))
        if with_item[k] > best[c - 1]:
            best[c], take[c] = with_item[k], k + 1
        else:
            best[c], take[c] = best[c - 1], -1
    return best, take


def _completed(first: int, take: np.ndarray, capacity: int) -> tuple[int, ...]:
    """The configuration of a length and the best completion of its rest."""
    out, left = [first], capacity - first
    while left > 0 and take[left]:
        if take[left] < 0:
            left -= 1
        else:
            out.append(int(take[left]))
            left -= int(take[left])
    return tuple(sorted(out, reverse=True))


def _fullest(left: np.ndarray, capacity: int) -> list[int]:
    """Lengths at hand that fill a sequence best, the longest among them: a bounded knapsack over sets of sums, held as bits."""
    longest = int(np.flatnonzero(left)[-1])
    space, within = capacity - longest, (1 << (capacity - longest + 1)) - 1
    sums, items, before = 1, [], []
    for length in np.flatnonzero(left[: space + 1])[::-1].tolist():
        many, take = min(int(left[length]) - (length == longest), space // length), 1
        while many > 0:
            take = min(take, many)
            items.append((length, take))
            before.append(sums)
            sums |= sums << length * take & within
            many, take = many - take, take * 2
        if sums >> space & 1:
            break
    total, out = sums.bit_length() - 1, [longest]
    # the shortest come last and are taken only where the longer ones do not reach the sum
    for (length, take), reached in zip(items[::-1], before[::-1], strict=True):
        if not reached >> total & 1:
            out += [length] * take
            total -= length * take
    return out


def _filled(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The best fit of each sequence in turn, longest pieces first; equal sequences are made at once."""
    plan = []
    while left.any():
        config = _fullest(left, capacity)
        lengths, times = np.unique(config, return_counts=True)
        n = int((left[lengths] // times).min())
        left[lengths] -= n * times
        plan.append((tuple(sorted(config, reverse=True)), n))
    return plan


def lower_bound(histogram: np.ndarray, capacity: int, prices: np.ndarray) -> int:
    """Sequences that any plan needs: prices of lengths, scaled so that no configuration is worth more than one, price the demand."""
    worth = _knapsack(prices, capacity)[0][capacity]
    return int(np.ceil((histogram * prices).sum() / worth - 1e-9)) if worth > 0 else 0


def solve(histogram: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (lengths, longest first) with how often to make each; they use up the histogram exactly."""
    demand = histogram.astype(np.int64)
    present = np.flatnonzero(demand)
    if not len(present):
        return []
    need = np.maximum(demand, 1).astype(float)
    covered = np.where(demand > 0, 0.0, np.inf)
    shares: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        open_lengths = present[covered[present] < 1]
        if not len(open_lengths):
            break
        value = np.where(covered < 1, np.arange(capacity + 1) / capacity * np.exp(-2 * np.minimum(covered, 1)), 0.0)
        _, take = _knapsack(value, capacity)
        order = open_lengths[np.lexsort((-open_lengths, covered[open_lengths]))][: max(CONFIGURATIONS, len(open_lengths) // 8)]
        for length in order:
            if covered[length] >= 1:
                continue
            config = _completed(int(length), take, capacity)
            lengths, times = np.unique(config, return_counts=True)
            room = ((1 - covered[lengths]) * need[lengths] / times).min()
            if room <= 0:
                continue
            # a step covers half of what is open of its tightest length, and whole sequences at least
            step = max(min(1.0, room), room / 2)
            shares[config] = shares.get(config, 0.0) + step
            covered[lengths] += step * times / need[lengths]
    left, plan = demand.copy(), []
    for config, share in sorted(shares.items(), key=lambda x: (-sum(x[0]), -x[1])):
        lengths, times = np.unique(config, return_counts=True)
        n = int(min(np.floor(KEPT * share + 1e-9), (left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            plan.append((config, n))
    return plan + _filled(left, capacity)


def intervals(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) for every place of every configuration."""
    out, reached, sequence = [], {}, 0
    for config, n in plan:
        offset = 0
        for length in config:
            rank = reached.get(length, 0)
            out.append((length, rank, rank + n, sequence, offset))
            reached[length] = rank + n
            offset += length
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    read = docs.select(F.col(id_column).alias("row"), F.col(text_column).alias("text"))
    cut = read.mapInArrow(lambda it: _pieces(it, tokenizer, capacity), f"row {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = common.written(cut.withColumnRenamed("row", "doc_id"), "pieces")
    chunks = max(1, pieces.count() // CHUNK_ROWS)
    chunk = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks))
    placed = pieces.withColumn("chunk", chunk)
    sizes = placed.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("length", "chunk", before.alias("before"))
    histogram = np.zeros(capacity + 1, np.int64)
    # one row per length: at most the capacity
    for row in pieces.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    # a place's key: its length, then its first rank
    places = np.array(sorted(intervals(solve(histogram, capacity))), np.int64).reshape(-1, 5)
    plan = spark.sparkContext.broadcast((places[:, 0] << RANK_BITS | places[:, 1], places[:, 3] - places[:, 1], places[:, 4]))

    def placed_in(batches):
        keys, shift, offset = plan.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << RANK_BITS | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(rank + shift[at]), pa.array(offset[at])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    within = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = placed.withColumn("within", within).join(starts, ["length", "chunk"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    read = ranked.select(*columns, (F.col("within") + F.col("before")).cast("long").alias("rank"))
    return read.mapInArrow(placed_in, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
