"""Near-duplicates, packing, piece counts and the pipeline against brute force."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import near_duplicates, packing, piece_counts, queries
from tallyfield.llm.queries import tokenizer_path

EDGE = [(1, None), (2, ""), (3, " \n"), (4, "solo"), (5, "SOLO"), (6, "one two"), (6, "one two"), (None, "no id at all here")]


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingled(text, size):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def classes(docs, size):
    sets = [shingled(t, size) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(docs):
        groups.setdefault(root(i), []).append(key)
    least = lambda i: min((k for k in groups[root(i)] if k is not None), default=None)
    return [(key, len(sets[i]), least(i) if sets[i] else key) for i, (key, _) in enumerate(docs)]


def variants(rng, base, n, rate):
    out = []
    for _ in range(n):
        w = base.split()
        for i in range(len(w)):
            if rng.random() < rate:
                w[i] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rng = random.Random(size)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    docs = list(EDGE)
    for group in range(4):
        base = text(150)
        docs += [(100 * (group + 1) + i, t) for i, t in enumerate(variants(rng, base, 25, 0.02 + 0.02 * group) + [base] * 3)]
    # a chain: neighbours are similar, the ends are not
    chain = [f"c{i}" for i in range(100)]
    docs += [(1000 + k, " ".join(chain[6 * k :] + [f"d{i}" for i in range(6 * k)])) for k in range(10)]
    docs += [(2000 + i, text(80)) for i in range(30)]
    rng.shuffle(docs)
    out = near_duplicates.classify(frame(spark, docs).withColumn("node", F.lit(1)), size=size).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == sorted(classes(docs, size), key=str)
    kept = near_duplicates.deduplicate(frame(spark, docs).withColumn("label", F.lit(1)), size=size)
    assert kept.columns == ["doc_id", "text", "label"]
    want = sorted({str(k) for k, _, c in classes(docs, size) if k == c})
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert near_duplicates.classify(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [2])
def test_large_mixed_buckets_are_dealt(spark, monkeypatch, size):
    monkeypatch.setattr(near_duplicates, "PART", 3)
    monkeypatch.setattr(near_duplicates, "BROADCAST_BYTES", 0)
    rng = random.Random(11)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    docs = [(i, t) for i, t in enumerate(variants(rng, base, 60, 0.09))] + [(100, "very " * 100_000 + "long")]
    out = near_duplicates.classify(frame(spark, docs).withColumns({"key": F.lit(1), "band": F.lit("x")}), size=size).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == sorted(classes(docs, size))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_give_the_rows_of_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want, out = duck.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, folder)
    order = sorted(out.columns)
    assert order == sorted(want.columns)
    rows = sorted(str([r[c] for c in order]) for r in out.collect())
    assert rows == sorted(str([r[want.columns.index(c)] for c in order]) for r in want.fetchall()) and len(rows) > 5
    assert name != "op7_near_duplicates" or sum("False" in r for r in rows) > 5


def test_null_and_repeated_ids_lose_only_duplicates(spark):
    text = lambda seed: " ".join(f"{seed}{i}" for i in range(40))
    near = " ".join([*text("a").split()[:-1], "end"])
    docs = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (None, ""), (7, text("d")), (7, text("e")), (7, ""), (8, near), (9, text("e"))]
    kept = near_duplicates.deduplicate(frame(spark, docs)).collect()
    want = [(None, text("b")), (None, text("c")), (None, ""), (7, text("d")), (7, text("e")), (7, ""), (8, near)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(str, want))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for similarity in (0.7, 0.8, 0.9, 0.97):
        for _ in range(20):
            n = 2000
            both = int(n * similarity)
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = pool[:n][: both + (n - both) // 2], np.concatenate([pool[:both], pool[n : n + (n - both) // 2]])
            true = both / len(np.union1d(a, b))
            minima = near_duplicates.samples(np.concatenate([a, b]), np.array([0, len(a)]))
            x, y = near_duplicates.odd_sketches(minima)
            odd = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
            k, bits = near_duplicates.SAMPLES, near_duplicates.BITS
            errors.append(1 + bits / (4 * k) * np.log(max(1 - 2 * odd / bits, 1e-9)) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    docs = EDGE + [(10 + i, " ".join(rng.choice(["Über", "naïve", "token", "<|endoftext|>", "12", "!!", "\n"]) for _ in range(rng.choice([1, 30, 300, 3000])))) for i in range(60)]
    path = tokenizer_path("byte_bpe_50k.json")
    out = packing.pack(frame(spark, docs).withColumn("length", F.lit(1)), path).toPandas()
    tokenizer, want = Tokenizer.from_file(path), []
    for i, t in docs:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        ends = list(range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048))
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip([0, *ends], ends))]
    ids = out["doc_id"].astype(object).where(out["doc_id"].notna(), None)
    got = list(zip((None if i is None else int(i) for i in ids), out["piece"], out["start"], out["length"], out["ids_crc32"]))
    assert sorted(map(str, ((a, int(b), int(c), int(d), int(e)) for a, b, c, d, e in got))) == sorted(map(str, want))
    for _, rows in out.sort_values("offset").groupby("sequence_id"):
        assert (rows["offset"].to_numpy() == np.concatenate([[0], rows["length"].cumsum()[:-1]])).all() and rows["length"].sum() <= 2048
    assert packing.pack(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(257, np.int64)
    np.add.at(histogram, rng.integers(1, 257, 5000) if seed else np.full(7, 256), 1)
    plan = packing.solve(histogram, 256, rounds=20)
    used = np.zeros(257, np.int64)
    for config, n in plan:
        assert sum(config) <= 256 and n > 0
        np.add.at(used, list(config), n)
    assert (used == histogram).all()
    made, prices = sum(n for _, n in plan), np.arange(257) / 256
    assert packing.lower_bound(histogram, 256, prices) >= -(-(histogram * np.arange(257)).sum() // 256)
    assert made <= 1.05 * packing.lower_bound(histogram, 256, prices) + (1 if seed else 0)


def test_dual_bound_sees_more_than_the_sum():
    histogram = np.zeros(101, np.int64)
    histogram[60] = 10  # no two fit together
    prices = np.zeros(101)
    prices[51:] = 1
    assert packing.lower_bound(histogram, 100, prices) == 10 == sum(n for _, n in packing.solve(histogram, 100))


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_program_reaches_the_bound(name):
    import pyarrow.parquet as pq

    encode = packing.encoder(tokenizer_path("byte_bpe_50k.json")).encode_to_numpy
    histogram = np.zeros(2049, np.int64)
    for text in pq.read_table(f"/root/testdata/{name}/documents.parquet", columns=["text"])["text"].to_pylist():
        n = len(encode(text or "", allowed_special="all")) + 1
        histogram[2048] += (n - 1) // 2048
        histogram[(n - 1) % 2048 + 1] += 1
    assert sum(n for _, n in packing.solve(histogram)) <= packing.lower_bound(histogram, 2048, np.arange(2049) / 2048) + 1


def test_piece_counts(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    pieces = set(piece_counts.vocabulary(path)) | {bytes([i]) for i in range(256)}
    longest = max(map(len, pieces))

    def greedy(word):
        at = n = 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces)
            n += 1
        return n

    docs = EDGE + [(50, "Hello wörld, antidisestablishmentarianism 日本語 " + "ab" * 3000)]
    out = piece_counts.count(frame(spark, docs), path).collect()
    want = [(i, len((t or "").encode().split()), sum(greedy(b" " + w) for w in (t or "").encode().split())) for i, t in docs]
    assert sorted(((r["doc_id"], r["n_words"], r["n_pieces"]) for r in out), key=str) == sorted(want, key=str)
    toy = piece_counts.Automaton([b"abcdz", b"ab", b"bc", b"cd", b"abcd"])
    assert toy.count([b"abcdz", b"abcd", b"abcx", b"", b"zabcdabcdz"]).tolist() == [1, 1, 3, 0, 3]


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tallyfield.llm import common

    folder = "/root/testdata/sf0.001"
    docs = common.table(spark, folder, "documents").withColumn("kept", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.written(stage(spark, docs, folder), name)
        assert docs.columns == before.columns
        assert docs.count() <= before.count() and docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        assert docs.count() == docs.select("doc_id").distinct().count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.count()
    left = classes([(r["doc_id"], r["text"]) for r in docs.collect()], 5)
    assert sum(k != c for k, _, c in left) <= 2  # tags of the personal data stage may make texts equal again
    assert not docs.where(docs.text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+")).count()


CLASHING = ("row", "key", "base", "spans", "label", "node", "score", "predicted", "held_out", "word", "length", "n", "n_chars")


def test_pipeline_takes_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    plain = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    item = plain(12)
    copy = plain(50)
    docs = [(1, None), (2, ""), (None, None), (None, plain(30)), (None, plain(30)), (3, "mail a@b.org now"), (4, copy), (5, copy), (5, copy), (6, plain(5) + " " + item), (7, "solo"), (8, "long " * 60_000 + plain(10))]
    rows = frame(spark, docs).withColumns({c: F.lit(7) for c in CLASHING})
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    ids = sorted(int(i) for i in out["doc_id"].dropna().unique())
    assert ids == [1, 2, 3, 4, 7, 8] and out["doc_id"].isna().sum() == 3
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["personal_data"](spark, rows, str(tmp_path))
    assert clean.columns == rows.columns and {r["text"] for r in clean.where("doc_id = 3").collect()} == {"mail [EMAIL] now"}
    assert clean.where("doc_id = 3 and n_chars = 16").count() == 1 and clean.where("doc_id = 1 and text is null").count() == 1
    none = rows.where("false")
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, none, str(tmp_path)).count() == 0, name


def test_piece_counts_of_odd_tables(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    docs = frame(spark, EDGE).withColumns({c: F.lit("x") for c in (*CLASHING, "n_words", "n_pieces")})
    out = piece_counts.count(docs, path)
    assert out.columns == ["doc_id", "n_words", "n_pieces"] and out.count() == len(EDGE) and piece_counts.count(docs.where("false"), path).count() == 0
