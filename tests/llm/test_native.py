"""Rule ledger, decontamination and sanitisation against plain Python, with nulls, empty texts, ties and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyfield.llm import common, decontaminate, rule_ledger, sanitise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    (1, "a b c d e a b c d e\nx\nx\n \nx"), (2, None), (3, ""), (4, " \n\t"), (5, "Ünï $ # wörd *"), (5, "Ünï $ # wörd *"), (None, "no id here"),
    (6, " ".join(f"w{i % 9}" for i in range(3000))), (7, "one"), (8, "A B\x0bC D\x0cE\rF"),
]


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def measured(text):
    words = WORD.findall(text or "")
    spots = {}
    for i in range(len(words) - 4):
        spots.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + k for s in spots.values() if len(s) > 1 for i in s for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_rule_ledger(spark):
    rows = rule_ledger.apply_policy(rule_ledger.ledger(frame(spark, EDGE).withColumn("n_words", F.lit("clash"))))
    found = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows.collect()]
    assert sorted(found, key=str) == sorted([(i, *measured(t)) for i, t in EDGE], key=str)
    assert rule_ledger.ledger(frame(spark, [])).count() == 0


def test_ablation(spark):
    rows = frame(spark, [(0,), (1,), (1,), (3,), (4,), (0,)], "fail_bits int")
    out = {r["rule"]: (r["n_failed"], r["n_only_this"], r["n_kept_without"]) for r in rule_ledger.ablation(rows).collect()}
    assert out["MIN_WORDS"] == (3, 2, 4) and out["REPEATED_WINDOWS"] == (1, 0, 2) and out["SYMBOLS"] == (1, 1, 3) and out["SHOUTING"] == (0, 0, 2)
    assert rule_ledger.apply_policy(rows, "base").where("kept").count() == 3


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return ITEM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def contaminated(text, items):
    words, hit, ids = split(text), set(), set()
    for i, item in items:
        w = split(item)
        for s in range(max(len(w) - 10, 0) + 1) if w else ():
            window = w[s : s + 10]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    ids.add(str(i))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("small", [10**7, 0])
def test_decontamination(spark, small):
    rng = random.Random(5)
    vocabulary = ["the"] * 20 + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 10, 14, 25])))) for i in range(12)] + [(20, None), (21, "..."), (0, "The THE the")]
    docs = list(EDGE)
    for i in range(30):
        parts = rng.choices(vocabulary, k=40)
        if i % 3 == 0:
            parts[7:7] = [rng.choice(items[:12])[1].upper()]
        docs.append((100 + i, ", ".join(parts)))
    out = decontaminate.report(frame(spark, docs).withColumn("word", F.lit(1)), frame(spark, items, "item_id long, text string"), broadcast_bytes=small)
    found = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in out.collect()]
    assert sorted(found, key=str) == sorted([(i, *contaminated(t, items)) for i, t in docs], key=str)
    kept = decontaminate.clean(frame(spark, docs).withColumn("extra", F.lit(2)), frame(spark, items, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "extra"]
    assert sorted((r["doc_id"] or -1 for r in kept.collect())) == sorted(i or -1 for i, t in docs if not contaminated(t, items)[1])
    assert decontaminate.report(frame(spark, []), frame(spark, [], "item_id long, text string")).count() == 0


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    out = []
    for order, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "x.y@z-1.org.", "é", "@", ".", "1.2.3.4", "300.1.1.1", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (974) 555-3436", "+49", " ", "-", "7", "55", "a_d@e.f", "\n", "%"]
    docs = [(i, "".join(rng.choices(bits, k=rng.randrange(1, 30)))) for i in range(300)] + EDGE + [(900, "1" * 20_000), (901, "a" * 50_000), (902, "1 " * 5000 + "@"), (903, "a@b.c_d@e.f")]
    rows = sanitise.spans(frame(spark, docs), support=10**6)
    found = [(r["doc_id"], r["s"]) for r in rows.select("row.doc_id", sanitise.written(F.col("base")).alias("s")).collect()]
    assert sorted(found, key=str) == sorted([(i, base(t)) for i, t in docs], key=str)


def test_terms_that_reveal_an_entity(spark):
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=12))
    docs = [(i, plain()) for i in range(60)]
    # a nickname always stands near one address, in different sentences; a common word does, too
    docs += [(100 + i, f"{plain()} zorro wrote alpha {i} from z@y.org today") for i in range(5)]
    # copies of one passage prove nothing
    docs += [(200 + i, "quux beta said w@v.org once") for i in range(5)]
    out = sanitise.sanitise(frame(spark, docs).withColumn("n", F.lit(1)))
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == ["doc_id", "text", "n"]
    assert all("zorro" not in texts[100 + i] and "alpha" in texts[100 + i] and "[EMAIL]" in texts[100 + i] for i in range(5))
    assert all(texts[200 + i] == "quux beta said [EMAIL] once" for i in range(5))
    assert all(texts[i] == t for i, t in docs[:60])
    assert hashlib.sha256(b"").hexdigest() == sanitise.spans(frame(spark, [(1, None)])).select(F.sha2(sanitise.written(F.col("base")), 256)).first()[0]
    assert sanitise.sanitise(frame(spark, [])).count() == 0


def test_terms_across_lines_and_in_punctuation(spark):
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=12))
    docs = [(i, plain()) for i in range(60)]
    docs += [(100 + i, f"{plain()} {i}\nZorro99 E-4711\nmail: z@y.org {plain()}") for i in range(4)]
    docs += [(110, f"{plain()} (zorro99), \"E-4711\"! z@y.org {plain()}")]
    # a word longer than the window's characters hides no word behind it
    docs += [(120 + i, f"{plain()} nick-{'x' * 400} q@p.org {plain()}") for i in range(4)]
    texts = {r["doc_id"]: r["text"] for r in sanitise.sanitise(frame(spark, docs)).collect()}
    assert all("orro99" not in texts[i] and "4711" not in texts[i] for i in (100, 101, 102, 103, 110))
    assert "(), \"\"! [EMAIL]" in texts[110]
    assert all("nick" not in texts[120 + i] for i in range(4))
    assert all(texts[i] == t for i, t in docs[:60])


BARE = re.compile(r"^[\W_]+|[\W_]+$")


def brute_disclosures(docs, near, support):
    """(entity, term): (n_e, n_te, n_t, n), by the definitions."""
    docs = sorted({(str(i), t or "") for i, t in docs})
    holds, entities, pairs, contexts, with_entity = {}, {}, {}, {}, {}
    for d, (_, text) in enumerate(docs):
        tokens = [(m.start(), m.end(), BARE.sub("", m.group()).lower()) for m in WORD.finditer(text)]
        for _, _, t in tokens:
            holds.setdefault(t, set()).add(d)
        for part in base(text).split(",") if base(text) else ():
            kind, a, b = part.split(":")
            name = f"{kind}:{text[int(a) : int(b)].lower()}"
            left, right = [t for x, y, t in tokens if y <= int(a)][-near:][::-1], [t for x, y, t in tokens if x >= int(b)][:near]
            with_entity.setdefault(name, set()).add(d)
            context = (tuple(left), tuple(right))
            entities.setdefault(name, set()).add(context)
            for t in {*left, *right}:
                if len(t) > 1:
                    pairs.setdefault((name, t), set()).add(d)
                    contexts.setdefault((name, t), set()).add(context)
    return {k: (len(with_entity[k[0]]), len(v), len(holds[k[1]]), len(docs)) for k, v in pairs.items() if len(contexts[k]) >= support and len(entities[k[0]]) >= support}


@pytest.mark.parametrize("small", [8_000_000, 0])
def test_disclosures_by_definition(spark, monkeypatch, small):
    monkeypatch.setattr(sanitise, "BROADCAST_BYTES", small)
    rng = random.Random(7)
    some = ["alpha", "beta,", "(gamma)", "Delta", "mail:z@y.org", "z@y.org", "\n", "mail", "+49 30 1234567", "\"zorro99\"", "x@y.zz."]
    docs = [(i, " ".join(rng.choices(some, k=rng.randrange(1, 30)))) for i in range(60)] + [(1, None), (None, "mail z@y.org")] * 2
    texts = frame(spark, docs).select(common.row_key("doc_id", "text").alias("key"), common.whole_text("text").alias("text")).dropDuplicates(["key"])
    out = sanitise.disclosures(texts, 4, 3).collect()
    assert {(r["entity"], r["term"]): (r["n_e"], r["n_te"], r["n_t"], r["n"]) for r in out} == brute_disclosures(docs, 4, 3)
    assert all(r["share"] <= 1 and r["n_te"] <= min(r["n_t"], r["n_e"]) for r in out) and {"mail", "zorro99"} <= {r["term"] for r in out}


def test_many_spans(spark):
    docs = [(1, "a@b.c, " * 12_000), (2, "+49 30 1234567; " * 3000)]
    rows = sanitise.spans(frame(spark, docs).withColumns({"key": F.lit(1), "base": F.lit(2), "spans": F.lit("x"), "row": F.lit(3)}))
    found = {r["i"]: r["s"] for r in rows.select("row.doc_id", sanitise.written(F.col("base")).alias("s")).withColumnRenamed("doc_id", "i").collect()}
    assert found == {i: base(t) for i, t in docs}


def test_row_keys_tell_nulls_apart(spark):
    rows = [(None, "passage"), ("passage", None), (None, None), ("", None), (None, ""), ("", ""), ("a", "bc"), ("ab", "c")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert docs.select(common.row_key("doc_id", "text")).distinct().count() == len(rows)
    items = spark.createDataFrame([(1, "passage")], "item_id long, text string")
    told = {(r["doc_id"], r["n_words"], r["contaminated"]) for r in decontaminate.report(docs, items).collect()}
    assert told == {(None, 1, True), ("passage", 0, False), (None, 0, False), ("", 0, False), ("a", 1, False), ("ab", 1, False)}
    pii = spark.createDataFrame([(None, "a@b.c"), ("a@b.c", None)], "doc_id string, text string")
    assert {(r["i"], r["n"]) for r in sanitise.spans(pii).select(F.col("row.doc_id").alias("i"), F.size("base").alias("n")).collect()} == {(None, 1), ("a@b.c", 0)}


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 1000])
def test_running_sums(spark, n):
    values = [(i * 7) % 13 for i in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(common.running_sums(F.col("v")).alias("s")).first()
    assert row["s"] == [sum(values[: i + 1]) for i in range(n)]


@pytest.mark.parametrize("small", [8_000_000, 0])
def test_terms_are_replaced_where_the_entity_is_not(spark, monkeypatch, small):
    monkeypatch.setattr(sanitise, "BROADCAST_BYTES", small)
    rng = random.Random(6)
    plain = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=12))
    docs = [(i, plain()) for i in range(60)]
    docs += [(100 + i, f"{plain()} zorro wrote {i} from z@y.org today") for i in range(5)] + [(200, "alpha Zorro, beta")]
    texts = {r["doc_id"]: r["text"] for r in sanitise.sanitise(frame(spark, docs)).collect()}
    assert texts[200] in ("alpha , beta", "alpha [TERM], beta")
    assert all(texts[i] == t for i, t in docs[:60])
