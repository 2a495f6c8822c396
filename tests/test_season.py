"""Worked examples, random sequences against a plain simulator, and planted faults."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import scalars
from tallyfield.operators import aggregates, audits, filters, joins, transitions, windows
from tallyfield.schema import TABLES, foreign_keys, unique_keys
from tallyfield.sources.adapter import MONTH_END, MONTH_START
from tallyfield.sources.tables import VersionedStore, append_ledger, conform, scan, write_snapshot

PROOF = "id long, season_user_id long, project_id long, review_status string, progress_delta string, increase string, status int, created_at string"


def proofs(spark, rows, config=1):
    frame = spark.createDataFrame(rows, PROOF)
    return conform(frame.withColumns({c: F.lit(None) for c in ("image_url", "note", "review_comment")}).withColumns({"project_upload_config_id": F.lit(config), "proof_date": F.to_date("created_at")}), "proof_record")


def amounts(frame):
    return {r["id"]: r["increase"] for r in frame.select("id", "increase").collect()}


def test_registry_counts():
    assert len(TABLES) == 14 and len(foreign_keys()) == 16 and len(unique_keys()) == 8
    assert sum(len(t.schema.fields) for t in TABLES.values()) == 86


def test_cap_keeps_delta(spark):
    rows = [(1, 1, 1, "approved", "0.9", "0", 1, "2024-01-01 00:00:00"), (2, 1, 1, "approved", "0.2", "0", 1, "2024-01-02 00:00:00")]
    out = windows.allocate(proofs(spark, rows))
    assert amounts(out) == {1: Decimal("0.9000"), 2: Decimal("0.1000")}
    assert out.where("id = 2").first()["progress_delta"] == Decimal("0.2000")


def simulate(rows, rejected):
    """The sequential rule: zero the rejected, then fill by (created_at, id)."""
    state = {r[0]: [r, Decimal(r[4]), Decimal(r[5])] for r in rows}
    for i in rejected:
        state[i][2] = Decimal(0)
    for key in {(r[1], r[2]) for r in rows}:
        group = sorted((s for s in state.values() if (s[0][1], s[0][2]) == key and s[0][0] not in rejected and s[0][6] == 1), key=lambda s: (s[0][7], s[0][0]))
        space = 1 - sum(s[2] for s in group)
        for s in group:
            more = max(Decimal(0), min(s[1] - s[2], space))
            s[2] += more
            space -= more
    return {i: s[2] for i, s in state.items()}


@pytest.mark.parametrize("seed", range(3))
def test_refill_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows, used = [], {}
    for i in range(120):
        key = (rng.randrange(4), rng.randrange(2))
        delta = Decimal(rng.randrange(0, 5000)) / 10000
        take = min(delta, 1 - used.get(key, Decimal(0)))
        used[key] = used.get(key, Decimal(0)) + take
        # review order is i, creation order is random
        rows.append((i, *key, "approved", str(delta), str(take), 1, f"2024-01-{rng.randrange(1, 28):02d} 00:00:00"))
    rejected = [i for i in range(120) if i % 7 == 3]
    commands = spark.createDataFrame([(i,) for i in rejected], "id long")
    projects = conform(spark.createDataFrame([(k[0] * 10 + k[1], *k, "0", 1) for k in used], "id long, season_user_id long, project_id long, completion_progress string, status int"), "season_user_project")
    out, new = transitions.final_reject(proofs(spark, rows), projects, commands)
    assert amounts(out) == simulate(rows, set(rejected))
    for r in new.collect():
        assert r["completion_progress"] == sum(v for i, v in amounts(out).items() if (rows[i][1], rows[i][2]) == (r["season_user_id"], r["project_id"]) and i not in rejected)
    assert audits.increase_range(out).count() == audits.rejected_zero(out).count() == audits.progress_sum(new, out).count() == 0


def test_ledger_examples(spark):
    rows = [(1, "u", None, "season_reward", 100, 0, None, 1, "2024-01-01 00:00:00"), (2, "u", 5, "exchange", -30, 0, None, 1, "2024-01-02 00:00:00"), (3, "u", None, "manual_adjust", 10, 0, None, 0, "2024-01-03 00:00:00")]
    points = conform(spark.createDataFrame(rows, "id long, user_id string, product_id long, change_type string, change_points int, points_after long, description string, status int, created_at string"), "point_record")
    after = {r["id"]: r["points_after"] for r in windows.running_balance(points).collect()}
    assert after == {1: 100, 2: 70, 3: 70}
    assert aggregates.balance(points).first()["balance"] == 70
    products = conform(spark.createDataFrame([(5, "cup", None, 50, None, 1), (6, "bag", None, 30, None, 1), (7, "old", None, 1, None, 0)], "id long, name string, description string, points_required long, image_url string, status int"), "product")
    commands = spark.createDataFrame([(11, "u", 5), (12, "u", 6), (13, "u", 7)], "id long, user_id string, product_id long")
    done, refused = transitions.exchange(points, products, commands, "2024-01-05 00:00:00")
    assert [(r["id"], r["change_points"], r["points_after"]) for r in done.collect()] == [(11, -50, 20)]
    assert {(r["id"], r["reason"]) for r in refused.collect()} == {(12, "balance"), (13, "not on shelf")}


def test_settlement_pays_once(spark):
    su = conform(spark.createDataFrame([(1, 1, "u", 1, "2024-01-01 00:00:00", None, 1), (2, 1, "v", 1, "2024-01-01 00:00:00", 50, 1)], "id long, season_id long, user_id string, level_id long, participated_at string, final_points long, status int"), "season_user")
    season = conform(spark.createDataFrame([(1, "s", "2024-01-01", "2024-01-31", 1, 2)], "id long, name string, start_date string, end_date string, required_project_count int, status int"), "season")
    projects = conform(spark.createDataFrame([(1, 1, 1, "1", 1)], "id long, season_user_id long, project_id long, completion_progress string, status int"), "season_user_project")
    levels = conform(spark.createDataFrame([(1, "gold", 300, 1)], "id long, name string, reward long, status int"), "project_level")
    ledger = conform(spark.createDataFrame([], "id long, user_id string, product_id long, change_type string, change_points int, points_after long, description string, status int, created_at string"), "point_record")
    none = proofs(spark, [])
    policy = lambda f: F.when(f["n_completed"] >= f["required"], f["reward"]).otherwise(0)
    new, rows = transitions.settle(su, season, projects, none, levels, ledger, "2024-02-01 00:00:00", policy)
    assert {r["id"]: r["final_points"] for r in new.collect()} == {1: 300, 2: 50}
    assert [(r["user_id"], r["change_points"], r["points_after"]) for r in rows.collect()] == [("u", 300, 300)]
    again, more = transitions.settle(new, season, projects, none, levels, ledger.union(rows), "2024-02-02 00:00:00", policy)
    assert more.count() == 0 and again.exceptAll(new).count() == 0


def test_settlement_asks_for_an_ended_season_and_formal_participation(spark):
    when = "2024-01-01 00:00:00"
    rows = [(1, 1, "u", 1, when, None, 1), (2, 2, "u", 1, when, None, 1), (3, 3, "u", 1, when, None, 1), (4, 1, "v", 1, None, None, 1), (5, 1, "w", None, when, None, 1), (6, 1, "x", 1, when, None, 2), (7, 4, "y", 1, when, None, 1)]
    su = conform(spark.createDataFrame(rows, "id long, season_id long, user_id string, level_id long, participated_at string, final_points long, status int"), "season_user")
    seasons = [(1, "a", "2024-01-01", "2024-01-31", 1, 2), (2, "b", "2024-02-01", "2024-02-28", 1, 2), (3, "c", "2024-01-01", "2024-01-31", 1, 1), (4, "d", "2024-03-01", "2024-03-31", 1, 2)]
    season = conform(spark.createDataFrame(seasons, "id long, name string, start_date string, end_date string, required_project_count int, status int"), "season")
    projects = conform(spark.createDataFrame([(i, i, 1, "1", 1) for i in range(1, 8)], "id long, season_user_id long, project_id long, completion_progress string, status int"), "season_user_project")
    levels = conform(spark.createDataFrame([(1, "gold", 300, 1)], "id long, name string, reward long, status int"), "project_level")
    ledger = conform(spark.createDataFrame([], "id long, user_id string, product_id long, change_type string, change_points int, points_after long, description string, status int, created_at string"), "point_record")
    new, paid = transitions.settle(su, season, projects, proofs(spark, []), levels, ledger, "2024-03-15 00:00:00", lambda f: f["reward"])
    assert {r["id"]: r["final_points"] for r in new.collect()} == {1: 300, 2: 300, 3: None, 4: None, 5: None, 6: None, 7: None}
    assert sorted((r["id"], r["user_id"], r["points_after"]) for r in paid.collect()) == [(1, "u", 300), (2, "u", 600)]


def test_untouched_groups_stay(spark):
    # group 2 has space and headroom, but no command touches it
    day = "2024-01-0{} 00:00:00"
    rows = [(1, 1, 1, "approved", "0.6", "0.6", 1, day.format(1)), (2, 1, 1, "approved", "0.6", "0.4", 1, day.format(2)), (3, 2, 1, "approved", "0.6", "0.1", 1, day.format(1))]
    table = proofs(spark, rows)
    done, _ = transitions.final_reject(table.withColumn("review_status", F.when(F.col("id") == 1, "preliminary_approved").otherwise(F.col("review_status"))), conform(spark.createDataFrame([], "id long, season_user_id long, project_id long, completion_progress string, status int"), "season_user_project"), spark.createDataFrame([(1,)], "id long"))
    assert {r["id"]: float(r["increase"]) for r in done.collect()} == {1: 0.0, 2: 0.6, 3: 0.1}


def test_month_rows_count(spark):
    day = "2024-01-0{} 00:00:00"
    start = proofs(spark, [(1, 1, 6, "approved", "0", "0", 1, day.format(1))], 6)
    end = proofs(spark, [(i, 1, 6, "approved", "0", "0", 1, day.format(i)) for i in (2, 3)], 7)
    plain = proofs(spark, [(i, 1, 1, s, "0", "0", 1, day.format(i)) for i, s in ((4, "approved"), (5, "rejected"), (6, "preliminary_approved"))])
    out = aggregates.checkins(start.union(end).union(plain), MONTH_START, MONTH_END)
    assert [(r[0], r[1]) for r in out.collect()] == [(1, 3)]


def test_functions(spark):
    frame = spark.createDataFrame([(50.0, 180.0), (90.0, 180.0), (95.0, 180.0), (80.0, None)], "kg double, cm double")
    targets = [r[0] for r in frame.select(scalars.bmi_target(scalars.bmi(F.col("kg"), F.col("cm")))).collect()]
    assert targets == [2, 3, 4, None]
    rules = spark.createDataFrame([('[{"label":"游泳距离","value":"1500米"},{"label":"Lanes","value":"2 & 3"}]',)], "c string")
    assert rules.select(scalars.rule_lines(F.col("c"))).first()[0] == ["游泳距离：1500米", "Lanes：2 & 3"]
    states = spark.createDataFrame([(None,), (0,), (5,)], "p long").select(filters.settlement_state(F.col("p"))).collect()
    assert [s[0] for s in states] == ["unsettled", "settled without reward", "settled with reward"]


def test_null_keys_are_no_orphans(spark):
    child = spark.createDataFrame([(1, 7), (2, None), (3, 8)], "id long, p long")
    parent = spark.createDataFrame([(7,)], "id long")
    assert [r["id"] for r in joins.orphans(child, parent, "p").collect()] == [3]


def test_sinks(spark, tmp_path):
    snap = spark.createDataFrame([(1, 1, 5)], "id long, season_user_id long, checkin_count long")
    write_snapshot(snap, f"{tmp_path}/leaderboard_snapshot")
    write_snapshot(snap.withColumn("checkin_count", F.lit(9)), f"{tmp_path}/leaderboard_snapshot")
    assert [r["checkin_count"] for r in scan(spark, str(tmp_path), "leaderboard_snapshot").collect()] == [9]
    row = spark.createDataFrame([(1, "u", None, "manual_adjust", 5, 5, None, 1, "2024-01-01 00:00:00")], "id long, user_id string, product_id long, change_type string, change_points int, points_after long, description string, status int, created_at string")
    append_ledger(row, f"{tmp_path}/point_record")
    append_ledger(row, f"{tmp_path}/point_record")
    assert scan(spark, str(tmp_path), "point_record").count() == 2
    append_ledger(row.withColumn("id", F.lit(2)), f"{tmp_path}/point_record", once=True)
    append_ledger(row.withColumn("id", F.lit(2)), f"{tmp_path}/point_record", once=True)
    assert scan(spark, str(tmp_path), "point_record").count() == 3
    store = VersionedStore(spark, f"{tmp_path}/store")
    store.commit({"leaderboard_snapshot": snap, "point_record": row})
    store.commit({"leaderboard_snapshot": store.read("leaderboard_snapshot").withColumn("checkin_count", F.lit(7))})
    assert store.read("leaderboard_snapshot").first()["checkin_count"] == 7 and store.read("point_record").count() == 1


def test_timed_jobs(spark, tmp_path):
    from tallyfield.streaming.jobs import model_review, run_available

    pending = proofs(spark, [(i, 1, 1, "pending", "0", "0", 1, "2024-01-01 00:00:00") for i in range(4)])
    due = filters.pending_due(pending, "2024-01-02 00:00:00", "2 HOURS").withColumn("rule_content", F.lit("[]"))

    def client(request):
        return {"verdict": request["rule_content"] == "[]", "delta": 0.3, "comment": "ok"}

    out = transitions.preliminary_review(pending, model_review(due, client))
    assert sorted(amounts(out).values()) == [Decimal("0.1000"), Decimal("0.3000"), Decimal("0.3000"), Decimal("0.3000")]
    pending.write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(pending.schema).parquet(f"{tmp_path}/in")
    run_available(stream, lambda frame: seen.append(frame.count()), f"{tmp_path}/checkpoint")
    assert sum(seen) == 4


def test_image_scan_finds_orphans(spark, tmp_path):
    from tallyfield.sources.tables import orphan_files, scan_images

    for name in ("a", "b"):
        (tmp_path / f"{name}.jpg").write_bytes(b"x")
    found = scan_images(spark, str(tmp_path))
    kept = spark.createDataFrame([(f"file:{tmp_path}/a.jpg",)], "image_url string")
    assert [r[0].rsplit("/", 1)[1] for r in orphan_files(found, kept).collect()] == ["b.jpg"]


def test_a_second_writer_fails(spark, tmp_path):
    store = VersionedStore(spark, f"{tmp_path}/held")
    product = conform(spark.createDataFrame([(1, "p", None, 5, None, 1)], "id long, name string, description string, points_required long, image_url string, status int"), "product")
    store.commit({"product": product})
    (tmp_path / "held" / "LOCK").touch()
    with pytest.raises(RuntimeError, match="another commit"):
        store.commit({"product": product})
    (tmp_path / "held" / "LOCK").unlink()
    store.commit({"product": product.withColumn("name", F.lit("q"))})
    assert store.read("product").first()["name"] == "q" and not (tmp_path / "held" / "LOCK").exists()
