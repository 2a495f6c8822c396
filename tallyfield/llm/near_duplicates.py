"""MinHash near-duplicates with odd sketches.

One pass turns every text into its set of hashed word shingles, and the set into a 128-bit class key
(equal sets are one class from then on), 256 MinHash samples, 32 band hashes of four samples each, and
an odd sketch: the samples folded into a parity bitmap of 1,024 bits, whose XOR population count
estimates high similarities precisely (J = 1 + n / 4k * ln(1 - 2x / n) for x odd bits).

Classes that share a band hash are candidates. They are never expanded into pairs:

1. band hashes that one class alone has are dropped, which leaves few classes; only their sets are kept;
2. every class is compared with the hub of each of its buckets, by sketches, and the two most similar of
   those hubs are confirmed on full sets; that gives components;
3. in buckets that still hold several components, the classes outside the bucket's largest component meet
   the classes of other components. The join itself screens them, by size, sketch and a bound on the
   intersection from 16-bit remainders of the shingles, and takes a pair in its first shared band only,
   so that little more than true links leaves it; those are confirmed on full sets. Links inside a
   component need no test, since they change nothing.

With 4 samples in each of 32 bands a pair of similarity 0.8 is missed by all with probability 5e-8; the
sketch screen, six standard deviations wide, misses it with about as little. Sizes and remainders are
bounds and miss nothing. A bucket's classes outside its largest component are dealt in parts of ``PART``
to meet the others, so that no task holds a large bucket.

Defined results: a text without words has the empty set and is linked with nothing; fewer words than a
shingle are one shingle, the whole sequence; ties take the smallest id; rows that repeat id and text are one
row; very long texts are read whole; extra columns of any name are kept or not read; an empty table gives an
empty result. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLES, BANDS, ROWS, BITS = 256, 32, 4, 1024
HUBS = 2
#: Sketch estimates this far below the threshold are still confirmed: six standard deviations.
SLACK = 0.165
#: Measured bytes of the candidates' keys up to which they are broadcast, and of one of them; beyond, Spark deals both sides.
BROADCAST_BYTES, KEY_BYTES = 32_000_000, 40
#: Classes of a bucket that meet the others in one task; a larger bucket is dealt in parts.
PART = 512

_seeds = np.random.default_rng(20).integers(0, 2**63, (3, SAMPLES), dtype=np.uint64)
_XOR, _MULTIPLY, _MIX = _seeds[0], _seeds[1] | np.uint64(1), _seeds[2] | np.uint64(1)


def shingles(text: Column, size: int) -> Column:
    """64-bit hashes of the text's word shingles, repeats included."""
    words = common.words(common.ascii_lower(text))
    several = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    one = lambda w: F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) >= size, several(w)).otherwise(one(w))), F.lit(0))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def samples(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash samples (sets by samples) of the non-empty sets that begin at starts."""
    out = np.empty((len(starts), SAMPLES), np.uint64)
    flat = _mixed(flat)
    for j in range(SAMPLES):
        out[:, j] = np.minimum.reduceat((flat ^ _XOR[j]) * _MULTIPLY[j], starts)
    return out


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as 64-bit words."""
    bit = _mixed(minima * _MIX) % np.uint64(BITS)
    flat = bit.astype(np.int64) + np.arange(len(minima))[:, None] * BITS
    odd = np.bincount(flat.ravel(), minlength=len(minima) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, BITS), axis=1).view(np.int64)


def band_hashes(minima: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band's samples and number."""
    used = minima[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(_mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), used.shape[:2])
    for r in range(ROWS):
        out = _mixed(out ^ used[:, :, r])
    return out.view(np.int64)


def _signatures(batches):
    """(node, n_shingles, bands, sketch) beside each row's id and key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("shingles")
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        sets = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        full = np.flatnonzero(sizes)
        nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        bands, sketches = [None] * len(sets), [None] * len(sets)
        for lo in range(0, len(full), 64):
            some = full[lo : lo + 64]
            starts = np.cumsum(sizes[some]) - sizes[some]
            minima = samples(np.concatenate([sets[i] for i in some]).view(np.uint64), starts)
            for i, b, s in zip(some, band_hashes(minima), odd_sketches(minima), strict=True):
                bands[i], sketches[i] = b, s
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "key": batch.column("key"), "node": pa.array(nodes, pa.binary()), "n_shingles": pa.array(sizes),
            "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.list_(pa.int64())),
        })


def most_odd_bits(percent: int) -> int:
    """Odd bits of two sketches at the lowest estimate that is still confirmed."""
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES / BITS * (1 - percent / 100 + SLACK))))


def odd_bits(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches held in numbered columns."""
    each = [F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(BITS // 64)]
    return reduce(lambda x, y: x + y, each)


def similar(a: Column, b: Column, percent: int) -> Column:
    """Whether 100 times the intersection reaches percent times the union of two distinct sets."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of undirected edges (u, v): the smallest node of each component, by alternating stars.

    Every round replaces neighbours by the smallest of a neighbourhood; the number of rounds is
    logarithmic. Minima are aggregated before they meet the edges again.
    """
    edges = common.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # done when every node has one edge and no label has one of its own
        ends = edges.select("u", F.lit(1).alias("n"), F.lit(0).alias("m")).union(edges.select("v", F.lit(0), F.lit(1)))
        wrong = ends.groupBy("u").agg(F.sum("n").alias("n"), F.max("m").alias("m")).where("n > 1 OR n = 1 AND m = 1")
        if wrong.limit(1).count() == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        edges = common.cut(small.where("u <> v").distinct())


def _sketched(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with their odd bits, those that may reach the threshold."""
    side = lambda p: found.select(F.col("node").alias(p), *[F.col("sketch")[i].alias(f"{p}{i}") for i in range(BITS // 64)])
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", odd_bits("a", "b").alias("odd")).where(F.col("odd") <= most_odd_bits(percent))


def _confirmed(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of pairs (a, b) whose full sets are similar."""
    side = lambda p: found.select(F.col("node").alias(p), F.col("shingles").alias(f"set_{p}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.where(similar(F.col("set_a"), F.col("set_b"), percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def links(docs: DataFrame, rows: DataFrame, percent: int, size: int, text_column: str, key: Column) -> DataFrame:
    """Enough confirmed links between classes to connect every component."""
    first = F.min(F.struct("doc_id", "key"))
    classes = rows.where("node is not null").groupBy("node").agg(first["key"].alias("key"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    classes = common.written(classes, "classes")
    banded = classes.select("node", F.posexplode("bands").alias("place", "band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    buckets = common.written(banded.join(shared, "band"), "buckets")
    # the hub of a bucket is the class with most neighbours in all its buckets: the least changed copy
    degree = buckets.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = buckets.select("band", "node").join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node"))["node"].alias("hub"))

    members = common.cut(classes.join(buckets.select("node").distinct(), "node").select("key", "node", "sketch", "bands"))
    keys = members.select("key")
    few = common.small(keys, BROADCAST_BYTES, F.lit(KEY_BYTES))
    texts = docs.select(key.alias("key"), common.whole_text(text_column).alias("text"))
    # only the keys are broadcast; the sets, which are few, meet the rest by key
    sets = texts.join(F.broadcast(keys) if few else keys, "key").select("key", F.array_distinct(shingles(F.col("text"), size)).alias("shingles"))
    found = common.written(sets.join(members, "key").select("node", "sketch", "bands", "shingles").dropDuplicates(["node"]), "members")

    to_hub = buckets.select("band", F.col("node").alias("a")).join(hubs, "band").select("a", F.col("hub").alias("b"))
    close = _sketched(to_hub.where("a <> b").distinct(), found, percent)
    best = F.row_number().over(Window.partitionBy("a").orderBy("odd", "b"))
    hub_links = common.written(_confirmed(close.withColumn("place", best).where(F.col("place") <= HUBS), found, percent), "links")

    labels = components(hub_links)
    labelled = buckets.join(labels, "node", "left").select("band", "place", "node", F.coalesce("label", "node").alias("label"))
    sizes = labelled.groupBy("band", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("n", "label"))["label"].alias("top"), F.count("*").alias("labels"), F.sum("n").alias("size"))
    mixed = mixed.where("labels > 1").select("band", "top", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    words = [F.col("sketch")[i].alias(f"_{i}") for i in range(BITS // 64)]
    rest = F.array_distinct(F.transform("shingles", lambda x: (x % 32749).cast("smallint")))
    facts = found.select("node", F.size("shingles").alias("n"), "bands", rest.alias("rest"), *words)
    still = common.written(labelled.join(mixed, "band").join(facts, "node"), "mixed")
    side = lambda rows, p, out: rows.select("band", "part", *[F.col(c).alias(c if c == "top" else f"{p}_{c.removeprefix('_')}") for c in rows.columns if c not in ("band", "part", "parts", *out)])
    left = side(still.where("label <> top").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "a", ("top",))
    right = side(still.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "b", ("place",))
    # two classes outside of the largest component would meet twice
    once = (F.col("b_label") == F.col("top")) | (F.col("a_node") < F.col("b_node"))
    sized = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    before = F.exists(F.sequence(F.lit(0), F.col("a_place") - 1), lambda i: F.get("a_bands", i) == F.get("b_bands", i))
    first_band = F.when(F.col("a_place") > 0, ~before).otherwise(True)
    # remainders that coincide within a set hide at most as many common shingles
    both = F.size(F.array_intersect("a_rest", "b_rest")) + F.least(F.col("a_n") - F.size("a_rest"), F.col("b_n") - F.size("b_rest"))
    bound = 100 * both >= percent * (F.col("a_n") + F.col("b_n") - both)
    near = (F.col("a_label") != F.col("b_label")) & once & sized & (odd_bits("a_", "b_") <= most_odd_bits(percent)) & first_band & bound
    pairs = left.join(right, ["band", "part"]).where(near).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return hub_links.union(_confirmed(pairs, found, percent))


def _labelled(docs: DataFrame, id_column: str, text_column: str, size: int, percent: int) -> DataFrame:
    """Per row: doc_id, key, n_shingles, label (the component; null for a text without words)."""
    key = common.row_key(id_column, text_column)
    read = docs.select(F.col(id_column).alias("doc_id"), key.alias("key"), shingles(common.whole_text(text_column), size).alias("shingles"))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, key struct<a:bigint,b:bigint>, node binary, n_shingles long, bands array<bigint>, sketch array<bigint>"
    rows = common.written(read.mapInArrow(_signatures, schema), "signatures")
    labels = components(links(docs, rows, percent, size, text_column, key))
    joined = rows.select("doc_id", "key", "node", "n_shingles").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return common.written(joined.select("doc_id", "key", "n_shingles", "label"), "labels")


def classify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, key, n_shingles, component_id (the smallest id reachable)."""
    joined = _labelled(docs, id_column, text_column, size, percent)
    smallest = joined.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return joined.join(smallest, "label", "left").select("doc_id", "key", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the one of the smallest id (null last), with all columns of docs.

    Rows are chosen by component and not by id: null and repeated ids lose only near-duplicates, and of
    the texts without words only rows that repeat id and text.
    """
    found = _labelled(docs, id_column, text_column, size, percent)
    alone = F.when(F.col("label").isNull(), F.col("key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"]
    kept = found.groupBy("label", alone.alias("alone")).agg(first.alias("__kept"))
    few = docs.withColumn("__key", common.row_key(id_column, text_column)).join(kept.select("__kept"), F.col("__key") == F.col("__kept"), "left_semi")
    repeated = found.groupBy("key").count().where("count > 1").limit(1).count() > 0
    return (few.dropDuplicates(["__key"]) if repeated else few).drop("__key")
