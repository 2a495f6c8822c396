"""Learned operators: exact bases, codes that sum to one, and accuracy on rows that were left out."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tallyfield.llm import common, context_tree, main_text, passage_quality, toxicity

EDGE = [(1, None), (2, ""), (3, " \n"), (4, "One two ONE"), (4, "One two ONE"), (None, "no id"), (5, "ü " * 4000)]


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def left_out(i, modulus, rest):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == rest


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def kt_log(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


def weighted(counts, context, depth, at):
    """Log of the weighted probability of a node: counts by full context, by definition."""
    below = {c: n for c, n in counts.items() if c.endswith(context)}
    own = kt_log(sum(n[0] for n in below.values()), sum(n[1] for n in below.values()))
    if at == depth:
        return own
    children = sum(weighted(below, k, depth, at + 1) for k in {c[len(c) - at - 1 :] for c in below})
    return math.log(0.5 * math.exp(own) + 0.5 * math.exp(children))


def brute_score(text, training, depth):
    """log10 probability of a text after the training texts: per decision, the ratio of two weighted probabilities."""

    def decisions(t):
        coded = " ".join(words(t)).encode() + b"\n"
        data = b"\n" * depth + coded
        for i in range(len(coded)):
            for k in range(8):
                yield (k, coded[i] >> (8 - k)), data[i : i + depth], coded[i] >> (7 - k) & 1

    counts = {}
    for t in training:
        for number, context, bit in decisions(t):
            counts.setdefault(number, {}).setdefault(context, [0, 0])[bit] += 1
    total = 0.0
    for number, context, bit in decisions(text):
        tree = {c: tuple(n) for c, n in counts.get(number, {}).items()}
        before = weighted(tree, b"", depth, 0) if tree else 0.0
        n = list(tree.get(context, (0, 0)))
        n[bit] += 1
        total += weighted(tree | {context: tuple(n)}, b"", depth, 0) - before
    return total / math.log(10)


@pytest.mark.parametrize("depth", [1, 3])
def test_context_tree_by_definition(spark, depth, monkeypatch):
    monkeypatch.setattr(context_tree, "BROADCAST_BYTES", 0 if depth == 1 else 10**6)
    docs = [(i, t) for i, t in enumerate(["ab abc", "AB ab", "", "é ab", None, "b", "ab abc", "c\tab ab", "abcd", "ba ab", "ab", "aab", "ab b", "é"])] + [(1, "AB ab")] * 3 + [(None, "ab abc"), (None, "ab abc"), (None, None)]
    training = [t for i, t in docs if not left_out(i, 7, 2)]
    assert len(training) < len(docs)
    out = context_tree.score(frame(spark, docs).withColumns({"n": F.lit("x"), "block": F.lit(0), "train": F.lit(1)}), depth=depth, block_bytes=16).collect()
    assert len(out) == len(docs)
    want = {t: brute_score(t, training, depth) for t in {t for _, t in docs}}
    assert sorted((str(r["doc_id"]) for r in out)) == sorted(str(i) for i, _ in docs)
    by_id = {i: want[t] for i, t in docs if i not in (1, None)}
    assert all(abs(r["score"] - by_id[r["doc_id"]]) < 1e-5 for r in out if r["doc_id"] in by_id)
    assert np.allclose(sorted(r["score"] for r in out if r["doc_id"] in (1, None)), sorted(want[t] for i, t in docs if i in (1, None)), atol=1e-5)


def test_context_tree(spark):
    rng = random.Random(1)
    syllables = ["ka", "lo", "mi", "tan", "ver"]
    docs = EDGE + [(10 + i, " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(60))) for i in range(60)]
    out = context_tree.score(frame(spark, docs)).collect()
    tokens = [words(t) + [None] for _, t in docs]
    counts = Counter(w for (i, _), ws in zip(docs, tokens) if not left_out(i, 7, 2) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(((i, left_out(i, 7, 2), len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 6)) for (i, _), ws in zip(docs, tokens)), key=str)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out), key=str) == want
    score = {r["doc_id"]: r["score"] for r in out}
    assert all(s <= 0 for s in score.values()) and score[1] == score[2] == score[3]
    long = [r for r in out if r["held_out"] and r["n_tokens"] > 50]
    assert sum(r["score"] for r in long) > sum(r["base_score"] for r in long)
    empty = context_tree.score(frame(spark, []))
    assert empty.count() == 0
    unseen = context_tree.score(frame(spark, [(i, "ab") for i in range(40) if left_out(i, 7, 2)]))
    assert all(abs(r["score"] - 24 * math.log10(0.5)) < 1e-5 and r["train_tokens"] == 0 for r in unseen.collect())


def test_slices_and_tables():
    texts = pa.array(["", None, " A\tb ", "c" * 9, "\x0b", "ü Ü"])
    found = context_tree.tokens(texts)
    assert found.to_pylist() == [[], [], ["a", "b"], ["c" * 9], [], ["ü", "Ü"]]
    gram, n = context_tree.grams(context_tree.streams(found, 2), 2)
    assert n.tolist() == [1, 1, 4, 10, 1, 6] and gram[2:6].tolist() == [int.from_bytes(x, "big") for x in (b"\n\na", b"\na ", b"a b", b" b\n")]
    context_tree.SLICE_BYTES, kept = 3, context_tree.SLICE_BYTES
    parts = list(context_tree._slices(pa.chunked_array([texts])))
    context_tree.SLICE_BYTES = kept
    assert len(parts) > 2 and [i for p, _ in parts for i in range(6)[p]] == list(range(6)) and sum((w.to_pylist() for _, w in parts), []) == found.to_pylist()
    assert list(context_tree._slices(pa.chunked_array([], pa.string()))) == []
    keys = np.unique(np.random.default_rng(2).integers(0, 2**48, 5000, dtype=np.uint64))
    assert (context_tree.Table(keys, np.arange(len(keys)) * 1.0)[keys[::-1]] == np.arange(len(keys))[::-1]).all()


def sentences(rng, n, extra=()):
    return " ".join(rng.choice(extra) if extra and rng.random() < 0.15 else "".join(rng.choices(["an", "the", "or", "ing", "sh", "re"], k=rng.randrange(1, 4))) for _ in range(n))


def test_toxicity(spark):
    rng = random.Random(4)
    docs, labels = list(EDGE), [(1, 0), (77, 1), (None, 1), (10, None)]
    for i in range(10, 400):
        bad = i % 4 == 0
        docs.append((i, sentences(rng, 80, ["zounds", "blackguard", "scoundrel"] if bad else ())))
        labels.append((i, int(bad)))
    out = toxicity.score(frame(spark, docs), frame(spark, labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == left_out(r["doc_id"], 5, 0) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] >= 10]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    none = toxicity.score(frame(spark, docs), frame(spark, [], "doc_id long, toxic int"))
    assert none.where("score <> 0 OR predicted <> 0").count() == 0


def test_gains_by_plain_compression():
    rng = random.Random(3)
    texts = [sentences(rng, 60, ["zounds", "blackguard"] if i % 2 else ()) for i in range(60)]
    model = toxicity.Model(texts, np.arange(60) % 2)
    gain = toxicity.Gain(model.contents)
    plain = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_BTLAZY2, min_match=3, window_log=19, hash_log=18, chain_log=18, search_log=7, target_length=64,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    size = lambda content, w: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + toxicity.FILLER, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=plain).compress(w + toxicity.FILLER))
    text = "Sing ZOUNDS the or re zounds ing"
    found = [b" sing zounds the ", b" or re zounds ", b" ing "]
    assert toxicity.windows(text) == found and toxicity.windows(None) == toxicity.windows(" \n") == []
    assert gain(text).tolist() == [size(model.contents[0], w) - size(model.contents[1], w) for w in found]
    assert toxicity.describe(np.array([5, 0, -1])).tolist()[:10] == np.log1p([3, 2, 1, 1, 1, 1, 1, 0, 0, 0]).tolist()


@pytest.mark.parametrize("n", [2, 3, 19, 40])
def test_few_labels(spark, n):
    # toxic ones at odd places only, so that halves by place lack a class; ids with both labels and repeated ids
    docs = [(i, f"word{i} zounds blackguard" if i % 2 else f"the plain story {i}") for i in range(60)] + [(6, "again"), (None, None), (61, "")]
    labels = [(i, i % 2) for i in range(60) if not left_out(i, 5, 0)][:n] + [(70, 1), (4, None)]
    known = frame(spark, labels, "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    extra = frame(spark, docs).withColumns({"score": F.lit("x"), "__label": F.lit(1), "held_out": F.lit(0), "predicted": F.lit(0)})
    for op in (toxicity, passage_quality):
        out = op.score(extra, known).collect()
        assert len(out) == len(docs) and all(0 <= r["score"] <= 1 for r in out)
        assert op.score(extra.where("false"), known).count() == 0
    texts, found = common.labelled_sample(frame(spark, docs), known.union(frame(spark, [(3, 0, 0), (3, 1, 1)], "doc_id long, toxic int, quality int")), "toxic", 5, 0, 5, 1000)
    assert len(texts) == len(found) <= 10 and not any("word3 " in t for t in texts)


def test_repeated_id_is_one_sample(spark):
    docs = [(1, f"text {i}") for i in range(500)] + [(2, "other"), (3, None), (4, "long " * 100)]
    labels = frame(spark, [(1, 1), (1, 1), (2, 0), (3, 0), (4, 0)], "doc_id long, toxic int")
    assert common.labelled_sample(frame(spark, docs), labels, "toxic", 7, 99, 10, 200) == (["text 0", "other"], [1, 0])


def test_passage_quality(spark):
    rng = random.Random(6)
    docs, labels = list(EDGE), []
    for i in range(10, 400):
        text = sentences(rng, 200)
        if i % 4 == 0:
            junk = text.split()[:60]
            text = " ".join(text.split()[60:]) + " " + rng.choice([" ".join(w + "$$$" for w in junk), " ".join(junk[:1] * 60), " | ".join(junk).upper()])
        docs.append((i, text))
        labels.append((i, int(i % 4 != 0)))
    known = frame(spark, labels, "doc_id long, quality int")
    out = passage_quality.score(frame(spark, docs), known).select("row.doc_id", "held_out", "score", "predicted").collect()
    assert len(out) == len(docs) and all(r["predicted"] == (r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] >= 10]
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) >= 0.95 * len(held)
    kept = passage_quality.good(frame(spark, docs, "doc_id long, text string"), known)
    assert kept.columns == ["doc_id", "text"]
    assert passage_quality.good(frame(spark, docs), frame(spark, [], "doc_id long, quality int")).count() == len(docs)


def test_network_gradient():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, passage_quality.N_FEATURES)).astype(np.float32) for n in (1, 4, 2)]
    labels = np.array([1.0, 0.0, 1.0])
    passage_quality.EPOCHS, kept = 1, passage_quality.EPOCHS
    net = passage_quality.Network(bags, labels)
    passage_quality.EPOCHS = kept
    loss = lambda: float(-np.mean(labels * np.log(net(bags)) + (1 - labels) * np.log(1 - net(bags))))
    slope = net._slope(bags, labels)
    for name, at in (("w", (3, 2)), ("v", (1, 1)), ("u", (0, 2)), ("a", (1,)), ("c", (4,)), ("d", (0,))):
        before = net.p[name][at]
        net.p[name][at] = before + 1e-5
        up = loss()
        net.p[name][at] = before - 1e-5
        down = loss()
        net.p[name][at] = before
        assert abs((up - down) / 2e-5 - slope[name][at]) < 1e-5


PAGE = """<html><head><title>t</title></head><body><header><a href=/>Home</a></header><nav><ul><li><a>One</a></ul></nav>
<div class="cookie-notice">We use cookies here.</div><article><h1>A &amp; B</h1><p>First <a href="x>y">link</a>
 line.<div class='ad'>Buy!</div><p>Second<br>part &lt;b&gt;<ul><li>item</ul><section id=comments><p>Nice one, thanks a lot for it</p></section></article>
<script>if (a < b) document.write("</p><p>no")</script><aside><p>Other stories that you may like</p></aside><footer>&copy; 2024</footer>"""


def test_main_text(spark):
    pages = [(1, "u1", PAGE), (2, "u2", None), (3, "u3", ""), (4, "u4", "<!-- open " + PAGE), (5, None, "<article>" + "<p>w é</p>" * 5000), (1, "u1", PAGE), (6, "u", '<a "' * 3000)]
    out = main_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in out}
    assert len(out) == 7 and texts[1] == "A & B\nFirst link line.\nSecond part <b>\nitem"
    assert texts[2] == texts[3] == texts[4] == "" and texts[5] == "\n".join(["w é"] * 5000)
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_marks_do_not_take_the_main_text():
    tree = main_text.grow(np.array([r for r, _ in main_text.TABLE], float), np.array([y for _, y in main_text.TABLE], float))
    text = ["A heading of the story", *(" ".join(f"{w}{i}" for i in range(60)) for w in "abc")]
    inner = f"<h2>{text[0]}</h2>" + "".join(f"<p>{t}</p>" for t in text[1:])
    menu = "<nav><a>Home</a></nav><footer>some words of the owner</footer>"
    card = "<article class='related'><a>Read also this</a></article>"
    for page in (
        f"<body class='has-sidebar ad-free'><div>{inner}</div>{menu}", f"<main class='with-comments'>{inner}</main>{menu}", f"<article class='search-enabled'>{inner}</article>{menu}",
        f"<div class='elementor-widget elementor-widget-text-editor'>{inner}</div>{menu}", f"<div class='page has-sidebar'>{inner}</div>{menu}",
        f"<div>{inner}</div>{card}{menu}",
    ):
        assert main_text.main_text(page, tree) == "\n".join(text), page[:80]
    plain = f"<div>{inner}</div>{card.replace('related', 'x')}{menu}"
    assert main_text.main_text(plain, tree).startswith("\n".join(text))
    comments = f"<article>{inner}</article><div class='comments'>" + "<p>nice one, thanks a lot for it all</p>" * 50 + "</div>"
    assert main_text.main_text(comments, tree) == "\n".join(text)
    assert main_text.main_text(f"<div style='display:none'>{inner}</div>", tree) == ""


def grown():
    return main_text.grow(np.array([r for r, _ in main_text.TABLE], float), np.array([y for _, y in main_text.TABLE], float))


def test_link_bars_adverts_and_teasers():
    tree = grown()
    text = [" ".join(f"{w}{i}" for i in range(40)) for w in "abc"]
    inner = "".join(f"<p>{t}</p>" for t in text)
    bar = "<p><a>Home</a> <a>World</a> <a>Sport</a></p>"
    advert = "<div>Buy it now at <a>Shop of deals</a></div>"
    for page in (
        f"<article><a>A teaser of another story</a></article><div id=content>{inner}</div>", f"<article><p>Other story</p></article><div id=content>{inner}</div>",
        f"<article class='post share'>{inner}</article>", f"<article>{bar}{inner}</article>", f"<article>{inner.replace('</p><p>', '</p>' + advert + '<p>', 1)}</article>",
        f"<div>{bar}</div><div>{inner}</div><div>{bar}</div>",
    ):
        lines = [x for x in main_text.main_text(page, tree).split("\n") if x != "Other story"]
        assert lines == text, page[:80]


def planted_page(rng):
    """A page without article, classes or roles, and its paragraphs: only counts and densities tell them from the rest."""
    say = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    links = lambda n: [f"<div><a href=x>{say(rng.randrange(1, 4))}</a></div>" for _ in range(n)]
    body = [say(rng.choice([14, 25, 60, 120])) for _ in range(rng.randrange(4, 9))]
    boxes = [f"<p>{t}</p>" for t in body]
    boxes.insert(rng.randrange(1, len(boxes)), f"<div>{say(3)} <a href=x>{say(3)}</a></div>")
    return "<html><body>" + "".join(links(rng.randrange(4, 9))) + f"<div>{say(2)}</div>" + "".join(links(2)) + "".join(boxes) + "".join(links(rng.randrange(3, 7))) + "</body></html>", body


def test_counts_and_densities_decide():
    tree, rng = grown(), random.Random(12)
    right = wrong = missed = decided = blocks = 0
    for _ in range(200):
        page, body = planted_page(rng)
        got = main_text.main_text(page, tree).split("\n")
        right += len(set(got) & set(body))
        wrong += len(set(got) - set(body))
        missed += len(set(body) - set(got))
        for row in main_text.features(main_text.blocks(page)):
            node = tree
            while isinstance(node, tuple):
                last, node = node[0], node[2] if row[node[0]] <= node[1] else node[3]
            blocks += 1
            decided += last < 6
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.98 and decided > 0.5 * blocks
    assert all(main_text.judge(tree, r) == bool(y) for r, y in main_text.TABLE)


def test_main_text_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + "long text " * 200_000 + "</p>", "x", 3)], "page_id long, url string, html string, text string, n_chars int")
    row = main_text.extract(pages).first()
    assert row["n_chars"] == len(row["text"]) == 1_999_999 and main_text.extract(pages.where("false")).count() == 0
