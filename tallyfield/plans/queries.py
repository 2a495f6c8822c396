"""The registered queries of the season engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates, audits, filters, joins, migrations, sorts, transitions, windows
from ..schema import TABLES, foreign_keys, unique_keys
from ..sources.adapter import MONTH_END, MONTH_START, Domain
from ..sources.tables import VersionedStore, append_ledger, conform, orphan_files, scan, scan_images, scratch, write_snapshot
from .oracle_tables import COUNTED, allocated, over, refilled

AS_OF, AS_OF_TIME, AFTER_TIME, WAIT = "2024-01-20", "2024-01-20 12:00:00", "2024-02-01 00:00:00", "2 HOURS"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Callable[[Domain], DataFrame], oracle: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(Domain(spark, sf_dir))
    if oracle:
        ORACLES[name] = oracle


def _columns(table: str) -> str:
    return ", ".join(f'"{f.name}"' for f in TABLES[table].schema.fields)


def _ids(frame: DataFrame, modulus: int, rest: int) -> DataFrame:
    """A command table: the ids with a given remainder."""
    return frame.where(F.col("id") % modulus == rest).select("id")


# scans
for _name in TABLES:
    add(f"scan_{_name}", lambda d, n=_name: getattr(d, n), over(_name, select=f'SELECT {_columns(_name)} FROM "{_name}"'))

# sources and sinks that are pure functions of tables
_OLD_PROOF = "id, season_user_id, progress_delta, increase, proof_date"
add(
    "orphan_files",
    lambda d: orphan_files(d.proof_record.select(F.col("image_url").alias("path")), d.proof_record.where("id % 9 <> 0")),
    over("proof_record", select="SELECT image_url FROM proof_record WHERE id % 9 = 0"),
)
add("scan_image", lambda d: scan_images(d.spark, d.root, "region.parquet").select(F.regexp_extract("path", "[^/]+$", 0).alias("name")).distinct(), "SELECT 'region.parquet' AS name")


def _replaced(d: Domain) -> DataFrame:
    """A snapshot written over an older one, read back."""
    root = scratch(d.spark)
    for rows in (d.leaderboard_snapshot.withColumn("checkin_count", F.col("checkin_count") + 1), d.leaderboard_snapshot):
        write_snapshot(rows, f"{root}/leaderboard_snapshot")
    return scan(d.spark, root, "leaderboard_snapshot")


def _appended(d: Domain) -> DataFrame:
    """A ledger written in two parts, the second one twice, read back."""
    root = scratch(d.spark)
    append_ledger(d.point_record.where("id % 2 = 0"), f"{root}/point_record")
    for _ in range(2):
        append_ledger(d.point_record.where("id % 2 = 1"), f"{root}/point_record", once=True)
    return scan(d.spark, root, "point_record")


def _committed(d: Domain) -> DataFrame:
    """Two tables committed together, then one of them changed; both read back through the pointer."""
    store = VersionedStore(d.spark, scratch(d.spark))
    store.commit({"season": d.season, "product": d.product})
    store.commit({"season": d.season.withColumn("status", F.lit(2))})
    rows = lambda name: store.read(name).select(F.lit(name).alias("name"), "id", "status")
    return rows("season").union(rows("product"))


for _sink, _table, _query in (("sink_leaderboard", "leaderboard_snapshot", _replaced), ("sink_ledger", "point_record", _appended)):
    add(_sink, _query, over(_table, select=f"SELECT {_columns(_table)} FROM {_table}"))
add("sink_state", _committed, over("season", "product", select="SELECT 'season' AS name, id, CAST(2 AS SMALLINT) AS status FROM season UNION ALL SELECT 'product', id, status FROM product"))
add(
    "migrate_add_progress",
    lambda d: migrations.add_progress(d.season_user_project.drop("completion_progress")),
    over("season_user_project", select="SELECT id, season_user_id, project_id, status, CAST(0 AS DECIMAL(5,4)) AS completion_progress FROM season_user_project"),
)
add(
    "migrate_drop_rank",
    lambda d: migrations.drop_rank(d.leaderboard_snapshot.withColumns({"rank_no": F.lit(1), "calculated_at": F.lit(AS_OF)})),
    over("leaderboard_snapshot", select="SELECT * FROM leaderboard_snapshot"),
)
add(
    "backfill_proof_date",
    lambda d: migrations.backfill_proof_date(d.proof_record.withColumn("proof_date", F.when(F.col("id") % 3 != 0, F.col("proof_date")))).select("id", "proof_date"),
    over("proof_raw", select="SELECT id, CAST(created_at AS DATE) AS proof_date FROM proof_raw"),
)
add(
    "backfill_delta",
    lambda d: migrations.backfill_delta(d.proof_record).select("id", "progress_delta", "increase"),
    over("proof_record", select="SELECT id, increase AS progress_delta, increase FROM proof_record"),
)

# filters and projections
_SU = over("season_user", "season", select="SELECT u.id FROM season_user u JOIN season s ON s.id = u.season_id WHERE {}")
add("filter_enabled", lambda d: filters.enabled(d.user), over("user", select='SELECT * FROM "user" WHERE status = 1'))
add("filter_on_shelf", lambda d: filters.on_shelf(d.product), over("product", select="SELECT * FROM product WHERE status = 1"))
add("filter_visible_suggestion", lambda d: filters.visible(d.user_suggestion), over("user_suggestion", select="SELECT * FROM user_suggestion WHERE is_visible = 1"))
add("filter_current_season", lambda d: filters.current_season(d.season), over("season", select="SELECT * FROM season WHERE status = 1"))
add("filter_valid_approved", lambda d: filters.valid_approved(d.proof_record), over("proof_record", select=f"SELECT {_columns('proof_record')} FROM proof_record WHERE {COUNTED}"))
add(
    "filter_proof_date_window",
    lambda d: filters.date_ok(joins.with_season(d.proof_record, d.season_user, d.season), AS_OF).select("id", "proof_date"),
    over("proof_raw", select=f"SELECT id, proof_date FROM proof_raw WHERE proof_date BETWEEN DATE '2024-01-01' AND least(DATE '2024-01-31', DATE '{AS_OF}')"),
)
add("filter_formal_participant", lambda d: filters.participants(d.season_user, d.season).select("id"), _SU.format("u.status = required_project_count AND level_id IS NOT NULL AND participated_at IS NOT NULL"))
add("filter_legacy_participant", lambda d: filters.legacy_participants(d.season_user, d.season).select("id"), _SU.format("u.status = required_project_count AND level_id IS NOT NULL AND participated_at IS NULL"))
add("filter_settlement_eligible", lambda d: filters.eligible(d.season_user, d.season).select("id"), _SU.format("u.status >= required_project_count AND final_points IS NULL"))
add(
    "filter_pending_due",
    lambda d: filters.pending_due(d.proof_record, AS_OF_TIME, WAIT).select("id"),
    over("proof_raw", select=f"SELECT id FROM proof_raw WHERE status = 1 AND review_status = 'pending' AND created_at <= TIMESTAMP '{AS_OF_TIME}' - INTERVAL {WAIT}"),
)
add("filter_headroom", lambda d: filters.headroom(d.proof_record).select("id", "progress_delta", "increase"), over("proof_record", select=f"SELECT id, progress_delta, increase FROM proof_record WHERE {COUNTED} AND progress_delta > increase"))
_SETTLED = lambda d: d.season_user.withColumn("final_points", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 100).cast("long"))
_SETTLED_SQL = "SELECT * REPLACE (CAST(CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 100 END AS BIGINT) AS final_points) FROM season_user"
add("filter_unsettled", lambda d: filters.unsettled(_SETTLED(d)).select("id"), over("season_user", s=_SETTLED_SQL, select="SELECT id FROM s WHERE final_points IS NULL"))
add("proj_locked_label", lambda d: filters.locked_label(d.season_user, d.season), over("season_user", select="SELECT id, 'locked ' || status || ' / 3' AS label FROM season_user"))
add(
    "proj_settlement_state",
    lambda d: _SETTLED(d).select("id", filters.settlement_state(F.col("final_points")).alias("state")),
    over("season_user", s=_SETTLED_SQL, select="SELECT id, CASE WHEN final_points IS NULL THEN 'unsettled' WHEN final_points = 0 THEN 'settled without reward' ELSE 'settled with reward' END AS state FROM s"),
)
add(
    "proj_status_label",
    lambda d: d.proof_record.select("id", filters.review_label(F.col("review_status")).alias("label")),
    over("proof_raw", select="""SELECT id, CASE review_status WHEN 'pending' THEN 'waiting for review' WHEN 'preliminary_approved' THEN 'approved, final review open'
        WHEN 'preliminary_rejected' THEN 'rejected by preliminary review' ELSE review_status END AS label FROM proof_raw"""),
)

# joins
_VIEW = """SELECT s.season_user_id, u.name AS user_name, d.name AS department_name, l.name AS level_name, s.checkin_count FROM leaderboard_snapshot s
    JOIN season_user e ON e.id = s.season_user_id JOIN "user" u ON u.id = e.user_id JOIN department d ON d.id = u.department_id LEFT JOIN project_level l ON l.id = e.level_id"""
_BOARD = ("leaderboard_snapshot", "season_user", "user", "department", "project_level")
_view = lambda d: joins.leaderboard_view(d.leaderboard_snapshot, d.season_user, d.user, d.department, d.project_level)
add("join_leaderboard_enrich", _view, over(*_BOARD, select=_VIEW))
add(
    "join_proof_season",
    lambda d: joins.with_season(d.proof_record, d.season_user, d.season).select("id", "user_id", "season_id", "start_date", "end_date", "proof_date"),
    over("proof_raw", "season_user", "season", select="SELECT p.id, e.user_id, e.season_id, s.start_date, s.end_date, p.proof_date FROM proof_raw p JOIN season_user e ON e.id = p.season_user_id JOIN season s ON s.id = e.season_id"),
)
_CANCELLED = lambda d: d.season_user_project.withColumn("status", F.when(F.col("id") % 4 == 0, 0).otherwise(1).cast("smallint"))
_CANCELLED_SQL = "SELECT * REPLACE (CAST(CASE WHEN id % 4 = 0 THEN 0 ELSE 1 END AS SMALLINT) AS status) FROM season_user_project"
add(
    "semi_locked_project",
    lambda d: joins.locked_only(d.proof_record, _CANCELLED(d)).select("id"),
    over("season_user_project", x=_CANCELLED_SQL, select="SELECT id FROM proof_record p WHERE EXISTS (SELECT 1 FROM x WHERE status = 1 AND x.season_user_id = p.season_user_id AND x.project_id = p.project_id)"),
)
add(
    "join_upload_config",
    lambda d: joins.with_config(d.proof_record, d.project_upload_config).select("id", "record_type", "sort_order"),
    over("proof_raw", "project_upload_config", select="SELECT p.id, c.record_type, c.sort_order FROM proof_raw p JOIN project_upload_config c ON c.id = p.project_upload_config_id AND c.project_id = p.project_id AND c.status = 1"),
)
add(
    "join_rule",
    lambda d: joins.with_rule(d.season_user_project, d.season_user, d.project_rule).select("id", "rule_id", "rule_content"),
    over("season_user_project", "season_user", "project_rule", select="""SELECT p.id, r.id AS rule_id, r.rule_content FROM season_user_project p JOIN season_user e ON e.id = p.season_user_id
        JOIN project_rule r ON r.project_id = p.project_id AND r.level_id = e.level_id AND r.status = 1"""),
)
_PAIRS = """SELECT e.season_user_id, e.project_id, e.id AS end_id, e.proof_date AS end_date, s.id AS start_id, s.proof_date AS start_date
    FROM proof_record e JOIN (SELECT *, row_number() OVER (PARTITION BY season_user_id, project_id ORDER BY proof_date, id) AS n FROM proof_record WHERE status = 1 AND project_upload_config_id = 6) s
    ON s.season_user_id = e.season_user_id AND s.project_id = e.project_id AND s.n = 1 WHERE e.status = 1 AND e.project_upload_config_id = 7"""
add("join_weight_baseline", lambda d: joins.weight_pairs(d.proof_record, MONTH_START, MONTH_END), over("proof_record", select=_PAIRS))
_kilos = lambda frame: F.when(F.col("project_upload_config_id") == 6, 60 + F.col("season_user_id") % 30).otherwise(60 + F.col("season_user_id") % 30 - F.col("id") % 5)
_weights = lambda d: d.proof_record.where("project_upload_config_id IN (6, 7)").select(F.col("id").alias("proof_id"), _kilos(None).cast("int").alias("kg"))
_BMI = "kg / ((CAST(u.height_cm AS DOUBLE) / 100) * (CAST(u.height_cm AS DOUBLE) / 100))"
_TIER = "CASE WHEN bmi < 24 THEN 2 WHEN bmi < 28 THEN 3 WHEN bmi IS NOT NULL THEN 4 END"
add(
    "join_bmi_tier",
    lambda d: d.user.select("id", scalars.bmi_target(scalars.bmi(50 + F.col("id").cast("long") % 60, F.col("height_cm"))).alias("target_kg")),
    over("user", b=f'SELECT id, {_BMI} AS bmi FROM (SELECT *, 50 + CAST(id AS BIGINT) % 60 AS kg FROM "user") u', select=f"SELECT id, {_TIER} AS target_kg FROM b"),
)
_results = lambda d: d.proof_record.where("review_status = 'pending' AND id % 2 = 0").select(
    "id", F.when(F.col("id") % 11 == 0, F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("created_at")).alias("created_at"),
    (F.col("id") % 3 != 0).alias("verdict"), ((F.col("id") * 13 % 2000).cast("decimal(10,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(5,4)").alias("delta"), F.lit("judged").alias("comment"),
)
add(
    "join_model_writeback",
    lambda d: joins.write_back(d.proof_record, _results(d)).select("id", "verdict", "delta"),
    over("proof_raw", select="SELECT id, id % 3 <> 0 AS verdict, CAST((id * 13 % 2000) * 0.0001 AS DECIMAL(5,4)) AS delta FROM proof_raw WHERE status = 1 AND review_status = 'pending' AND id % 2 = 0 AND id % 11 <> 0"),
)
add(
    "join_ledger_product",
    lambda d: joins.exchanges(d.point_record, d.product),
    over("point_record", "product", select="""SELECT r.id, r.user_id, r.product_id, -r.change_points AS points_paid, r.status, p.name AS product_name, p.points_required
        FROM point_record r LEFT JOIN product p ON p.id = r.product_id WHERE r.change_type = 'exchange'"""),
)
add(
    "join_suggestion_user",
    lambda d: joins.suggestions(d.user_suggestion, d.user).select("id", "user_id", "user_name"),
    over("user_suggestion", "user", select='SELECT s.id, s.user_id, u.name AS user_name FROM user_suggestion s JOIN "user" u ON u.id = s.user_id'),
)
add(
    "join_user_department",
    lambda d: joins.with_department(d.user, d.department).select("id", "name", "department_name"),
    over("user", "department", select='SELECT u.id, u.name, d.name AS department_name FROM "user" u JOIN department d ON d.id = u.department_id'),
)
#: Names of the foreign keys whose columns do not name them.
_FK_NAMES = {
    ("project_rule", "level_id"): "project_rule_level", ("project_upload_config", "project_id"): "project_upload_config_project", ("season_user", "level_id"): "season_user_level",
    ("proof_record", "project_upload_config_id"): "proof_record_upload_config", ("leaderboard_snapshot", "season_user_id"): "leaderboard_season_user",
}
for _child, _column, _parent in foreign_keys():
    _key = _FK_NAMES.get((_child, _column), f"{_child}_{_column.removesuffix('_id')}")
    # every seventh parent is taken away, so that there are orphans to find
    add(
        f"anti_fk_{_key}",
        lambda d, c=_child, k=_column, p=_parent: joins.orphans(getattr(d, c), getattr(d, p).where(F.col("id").cast("long") % 7 != 1), k).select("id", k),
        over(_child, _parent, select=f'SELECT c.id, c."{_column}" FROM "{_child}" c WHERE c."{_column}" IS NOT NULL AND NOT EXISTS (SELECT 1 FROM "{_parent}" p WHERE p.id = c."{_column}" AND CAST(p.id AS BIGINT) % 7 <> 1)'),
    )

# aggregates
add("agg_checkin_count", lambda d: aggregates.checkins(d.proof_record, MONTH_START, MONTH_END), over("checkins", select="SELECT * FROM checkins"))
add("agg_completion_progress", lambda d: aggregates.progress(d.proof_record), over("progress", select="SELECT * FROM progress"))
add("agg_locked_count", lambda d: aggregates.locked_count(_CANCELLED(d)), over("season_user_project", x=_CANCELLED_SQL, select="SELECT season_user_id, CAST(count_if(status = 1) AS BIGINT) AS locked FROM x GROUP BY season_user_id"))
add("agg_balance", lambda d: aggregates.balance(d.point_record), over("balance", select="SELECT * FROM balance"))
add("agg_settlement_facts", lambda d: aggregates.settlement_facts(d.season_user, d.season_user_project, d.proof_record), over("facts", select="SELECT * FROM facts"))
add("agg_exchange_by_product", lambda d: aggregates.exchange_stats(d.point_record), over("point_record", select="SELECT product_id, count(*) AS n_exchanges, CAST(-sum(change_points) AS BIGINT) AS points_paid FROM point_record WHERE change_type = 'exchange' AND status = 1 GROUP BY product_id"))
add(
    "agg_department_stats",
    lambda d: aggregates.department_stats(d.department, d.user, d.point_record, d.season_user, d.season_user_project),
    over("department", "user", "balance", "season_user", "season_user_project",
         e="SELECT user_id, count(*) AS n_entries, sum(coalesce(n, 0)) AS n_completed FROM season_user u LEFT JOIN (SELECT season_user_id, count_if(completion_progress >= 1) AS n FROM season_user_project GROUP BY ALL) p ON p.season_user_id = u.id GROUP BY user_id",
         select="""SELECT d.id AS department_id, d.name, count(*) AS n_users, CAST(sum(coalesce(balance, 0)) AS BIGINT) AS balance, CAST(sum(coalesce(n_entries, 0)) AS BIGINT) AS n_entries,
         CAST(sum(coalesce(n_completed, 0)) AS BIGINT) AS n_completed FROM department d JOIN "user" u ON u.department_id = d.id LEFT JOIN balance b ON b.user_id = u.id LEFT JOIN e ON e.user_id = u.id GROUP BY d.id, d.name"""),
)
_UNIQUE_NAMES = {"department": "department_name", "project": "project_name", "project_level": "project_level_name", "project_upload_config": "upload_config", "leaderboard_snapshot": "leaderboard"}
for _table, _keys in unique_keys():
    # rows with an even id come twice, so that there are duplicates to find
    add(
        f"agg_unique_{_UNIQUE_NAMES.get(_table, _table)}",
        lambda d, t=_table, k=_keys: aggregates.duplicates(getattr(d, t).unionByName(getattr(d, t).where(F.col("id").cast("long") % 2 == 0)), k),
        over(_table, select=f'SELECT {", ".join(_keys)}, count(*) AS n FROM (SELECT * FROM "{_table}" UNION ALL SELECT * FROM "{_table}" WHERE CAST(id AS BIGINT) % 2 = 0) GROUP BY ALL HAVING count(*) > 1'),
    )
_ALL_VALID = lambda d: d.proof_record.withColumn("status", F.lit(1).cast("smallint"))
_ALL_VALID_SQL = "SELECT * REPLACE (CAST(1 AS SMALLINT) AS status) FROM proof_record"
add("agg_one_proof_per_day", lambda d: aggregates.duplicate_proofs(_ALL_VALID(d)), over("proof_record", select="SELECT season_user_id, project_id, proof_date, count(*) AS n FROM proof_record GROUP BY ALL HAVING count(*) > 1"))
add("agg_single_running_season", lambda d: aggregates.running_seasons(d.season.withColumn("status", F.lit(1))), over("season", select="SELECT count(*) AS n FROM season"))

# windows
_proof = lambda frame: frame.select("id", "review_status", "status", "progress_delta", "increase")
_PROOF = "SELECT id, review_status, status, progress_delta, increase FROM {}"
add("win_allocate", lambda d: windows.allocate(d.proof_record.drop("increase"), ("created_at", "id")).select("id", "increase"), over("proof_record", select="SELECT id, increase FROM proof_record"))
_rejecting = lambda d: d.proof_record.withColumns({
    "increase": F.when(F.col("id") % 10 == 5, 0).otherwise(F.col("increase")).cast("decimal(5,4)"), "review_status": F.when(F.col("id") % 10 == 5, "rejected").otherwise(F.col("review_status"))
})
_REJECTING = "SELECT * REPLACE (CAST(CASE WHEN id % 10 = 5 THEN 0 ELSE increase END AS DECIMAL(5,4)) AS increase, CASE WHEN id % 10 = 5 THEN 'rejected' ELSE review_status END AS review_status) FROM proof_record"
add("win_refill", lambda d: _proof(windows.refill(_rejecting(d))), over("proof_record", r=_REJECTING, f=refilled("r"), select=_PROOF.format("f")))
add("win_running_balance", lambda d: windows.running_balance(d.point_record).select("id", "user_id", "points_after"), over("point_record", select="SELECT id, user_id, points_after FROM point_record"))
add(
    "win_latest_proof",
    lambda d: windows.latest_proof(_ALL_VALID(d)).select("id"),
    over("proof_record", select="SELECT id FROM proof_record QUALIFY row_number() OVER (PARTITION BY season_user_id, project_id, proof_date ORDER BY created_at DESC, id DESC) = 1"),
)
add("win_display_rank", lambda d: windows.with_rank(d.leaderboard_snapshot).select("season_user_id", "checkin_count", "rank_no"), over("leaderboard_snapshot", select="SELECT season_user_id, checkin_count, rank() OVER (ORDER BY checkin_count DESC) AS rank_no FROM leaderboard_snapshot"))

# orderings
add("sort_history", lambda d: sorts.history(d.proof_record, 3).select("id", "created_at"), over("proof_raw", select="SELECT id, created_at FROM proof_raw WHERE season_user_id = 3"))
add("sort_upload_config", lambda d: sorts.upload_configs(d.project_upload_config, 6), over("project_upload_config", select="SELECT * FROM project_upload_config WHERE project_id = 6"))
add("sort_levels", lambda d: sorts.levels(d.project_level), over("project_level", select="SELECT * FROM project_level"))
add("sort_refill", lambda d: filters.headroom(d.proof_record).orderBy("created_at", "id").select("id", "created_at"), over("proof_record", select=f"SELECT id, created_at FROM proof_record WHERE {COUNTED} AND progress_delta > increase"))
add("sort_ledger", lambda d: sorts.ledger(d.point_record, "7").select("id", "points_after"), over("point_record", select="SELECT id, points_after FROM point_record WHERE user_id = '7'"))
add("sort_leaderboard", lambda d: sorts.leaderboard(_view(d)), over(*_BOARD, select=_VIEW))
add("sort_suggestions", lambda d: sorts.suggestions_by_time(d.user_suggestion).select("id", "created_at"), over("user_suggestion", select="SELECT id, created_at FROM user_suggestion WHERE is_visible = 1"))
add("sort_products", lambda d: sorts.products(d.product).select("id", "points_required"), over("product", select="SELECT id, points_required FROM product WHERE status = 1"))
add("top_k", lambda d: sorts.page(d.product, "id", 20, after=30), over("product", select="SELECT * FROM product WHERE id > 30 ORDER BY id LIMIT 20"))

# scalars
add("fn_bmi", lambda d: d.user.select("id", F.round(scalars.bmi(F.lit(70), F.col("height_cm")) * 1000).cast("long").alias("bmi_milli")), over("user", select=f'SELECT id, CAST(round({_BMI.replace("kg", "70.0::DOUBLE", 1)} * 1000) AS BIGINT) AS bmi_milli FROM "user" u'))
add("fn_min_date", lambda d: d.season.select("id", scalars.last_day(F.col("end_date"), F.lit(AS_OF).cast("date")).alias("last")), over("season", select=f"SELECT id, least(end_date, DATE '{AS_OF}') AS last FROM season"))
add("fn_to_date", lambda d: d.proof_record.select("id", F.to_date("created_at").alias("day")), over("proof_raw", select="SELECT id, CAST(created_at AS DATE) AS day FROM proof_raw"))
add("fn_clamp", lambda d: d.product.select("id", scalars.clamp(F.col("points_required"), F.lit(30), F.lit(50)).cast("long").alias("points")), over("product", select="SELECT id, greatest(30, least(points_required, 50)) AS points FROM product"))
add(
    "fn_rule_decode",
    lambda d: d.project_rule.select("id", F.explode(scalars.rule_entries(F.col("rule_content"))).alias("e")).select("id", "e.label", "e.value"),
    over("project_rule", select="SELECT id, e->>'label' AS label, e->>'value' AS value FROM (SELECT id, unnest(CAST(rule_content AS JSON[])) AS e FROM project_rule)"),
)
_BROKEN = {1: '{"label":"a","value":"b"}', 2: '[{"label":"a"}]', 3: '[{"label":"a","value":5}]', 4: "[1]", 5: "[", 6: "[]"}
add(
    "fn_rule_validate",
    lambda d: d.project_rule.select("id", F.coalesce(F.create_map(*[F.lit(x).cast(t) for k, v in _BROKEN.items() for x, t in ((k, "long"), (v, "string"))])[F.col("id")], F.col("rule_content")).alias("c")).select("id", scalars.rule_error(F.col("c")).alias("error")),
    over("project_rule", select="SELECT id, CASE WHEN id IN (1, 5) THEN 'not an array' WHEN id = 4 THEN 'not an array of objects' WHEN id IN (2, 3) THEN 'label or value missing or not text' END AS error FROM project_rule"),
)
add(
    "fn_rule_render",
    lambda d: d.project_rule.select("id", F.array_join(scalars.rule_lines(F.col("rule_content")), "\n").alias("lines")),
    over("project_rule", select="SELECT id, 'target：' || (1000 * project_id) || ' per day' || chr(10) || 'days：' || (10 * level_id) || ' in total' AS lines FROM project_rule"),
)
add("fn_proof_path", lambda d: d.proof_record.select("id", scalars.proof_path(F.col("created_at"), F.col("season_user_id").cast("string"), F.col("id")).alias("path")), over("proof_raw", select="SELECT id, '/uploads/proofs/' || strftime(created_at, '%Y/%m') || '/user_' || season_user_id || '/proof_' || id || '.jpg' AS path FROM proof_raw"))
_ACTION = "CASE id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'reupload' ELSE 'preliminary_approve' END"
add(
    "fn_next_status",
    lambda d: d.proof_record.select("id", scalars.next_status(F.col("review_status"), F.expr(_ACTION)).alias("next")),
    over("proof_raw", a=f"SELECT id, review_status AS s, {_ACTION} AS a FROM proof_raw", select="""SELECT id, CASE WHEN a = 'reupload' THEN 'pending' WHEN a = 'preliminary_approve' AND s = 'pending' THEN 'preliminary_approved'
        WHEN a = 'approve' AND s LIKE 'preliminary%' THEN 'approved' WHEN a = 'reject' AND (s LIKE 'preliminary%' OR s = 'approved') THEN 'rejected' END AS next FROM a"""),
)
add("fn_collate", lambda d: d.department.select("id", (scalars.ci_ai(F.upper("name")) == scalars.ci_ai(F.lower("name"))).alias("equal")), over("department", select="SELECT id, TRUE AS equal FROM department"))
add("fn_now", lambda d: d.season.select("id", F.lit(AS_OF_TIME).cast("timestamp_ntz").alias("as_of")), over("season", select=f"SELECT id, TIMESTAMP '{AS_OF_TIME}' AS as_of FROM season"))
add("fn_default_text", lambda d: d.project.select("id", scalars.text_or(F.col("description"), "no description").alias("description")), over("project", select="SELECT id, 'no description' AS description FROM project"))

# audits, on tables with planted faults beside the natural ones
_AUDIT = "SELECT '{0}' AS rule, '{1}' AS \"table\", CAST({2} AS VARCHAR) AS key, CAST({3} AS VARCHAR) AS detail FROM {4}"
_bad = lambda frame, test, **values: frame.withColumns({c: F.when(F.expr(test), v).otherwise(F.col(c)).cast(frame.schema[c].dataType) for c, v in values.items()})
add(
    "audit_increase_range",
    lambda d: audits.increase_range(_bad(d.proof_record, "id % 101 = 0", increase=F.lit(2))),
    over("proof_record", select=_AUDIT.format("increase_range", "proof_record", "id", "'2.0000/' || progress_delta", "proof_record WHERE id % 101 = 0")),
)
add(
    "audit_progress_range",
    lambda d: audits.progress_range(_bad(d.season_user_project, "id % 50 = 0", completion_progress=F.lit(-1))),
    over("season_user_project", select=_AUDIT.format("progress_range", "season_user_project", "id", "'-1.0000'", "season_user_project WHERE id % 50 = 0")),
)
add(
    "audit_progress_sum",
    lambda d: audits.progress_sum(_bad(d.season_user_project, "id % 40 = 0", completion_progress=F.lit("0.3333")), d.proof_record),
    over("season_user_project", select=_AUDIT.format("progress_sum", "season_user_project", "id", "'0.3333/' || completion_progress", "season_user_project WHERE id % 40 = 0 AND completion_progress <> 0.3333")),
)
add(
    "audit_proof_date",
    lambda d: audits.proof_date(d.proof_record, d.season_user, d.season, AS_OF),
    over("proof_raw", select=_AUDIT.format("proof_date", "proof_record", "id", "proof_date", f"proof_raw WHERE proof_date NOT BETWEEN DATE '2024-01-01' AND DATE '{AS_OF}'")),
)
add(
    "audit_one_proof_per_day",
    lambda d: audits.one_proof_per_day(_ALL_VALID(d)),
    over("proof_record", g="SELECT season_user_id, project_id, proof_date, count(*) AS n FROM proof_record GROUP BY ALL HAVING count(*) > 1",
         select=_AUDIT.format("one_proof_per_day", "proof_record", "season_user_id || '/' || project_id || '/' || proof_date", "n", "g")),
)
add(
    "audit_participation_pair",
    lambda d: audits.participation_pair(d.season_user),
    over("season_user", select=_AUDIT.format("participation_pair", "season_user", "id", "'level without time'", "season_user WHERE level_id IS NOT NULL AND participated_at IS NULL")),
)
add(
    "audit_locked_count",
    lambda d: audits.locked_count(d.season_user, _CANCELLED(d)),
    over("season_user", "season_user_project", x=_CANCELLED_SQL, g="SELECT season_user_id, count_if(status = 1) AS n FROM x GROUP BY season_user_id",
         select=_AUDIT.format("locked_count", "season_user", "id", "status || '/' || n", "season_user JOIN g ON g.season_user_id = id WHERE status <> n")),
)
add("audit_single_season", lambda d: audits.single_season(d.season.withColumn("status", F.lit(1))), over("season", select=_AUDIT.format("single_season", "season", "'status=1'", "count(*)", "season")))
add(
    "audit_delta_zero",
    lambda d: audits.delta_zero(_bad(d.proof_record, "id % 30 = 1", progress_delta=F.lit("0.5")), MONTH_START),
    over("proof_record", select=_AUDIT.format("delta_zero", "proof_record", "id", "'0.5000'", "proof_record WHERE id % 30 = 1 AND (review_status IN ('pending', 'preliminary_rejected') OR project_upload_config_id = 6)")),
)
add(
    "audit_rejected_zero",
    lambda d: audits.rejected_zero(_bad(d.proof_record, "id % 20 = 10", increase=F.lit("0.1"))),
    over("proof_record", select=_AUDIT.format("rejected_zero", "proof_record", "id", "'0.1000'", "proof_record WHERE id % 20 = 10 AND review_status = 'rejected'")),
)
add(
    "audit_points_after",
    lambda d: audits.points_after(_bad(d.point_record, "id % 60 = 0", points_after=F.col("points_after") + 1)),
    over("point_record", select=_AUDIT.format("points_after", "point_record", "id", "(points_after + 1) || '/' || points_after", "point_record WHERE id % 60 = 0")),
)
add("audit_negative_balance", lambda d: audits.negative_balance(d.point_record), over("point_record", select=_AUDIT.format("negative_balance", "point_record", "id", "points_after", "point_record WHERE points_after < 0")))
add(
    "audit_product_nullness",
    lambda d: audits.product_nullness(_bad(d.point_record, "id % 70 = 0", product_id=F.lit(None))),
    over("point_record", select=_AUDIT.format("product_nullness", "point_record", "id", "change_type", "point_record WHERE id % 70 = 0 AND change_type = 'exchange'")),
)
add(
    "audit_settlement_once",
    lambda d: audits.settlement_once(_SETTLED(d).unionByName(_SETTLED(d).where("id % 5 = 0"))),
    over("season_user", s=_SETTLED_SQL, select=_AUDIT.format("settlement_once", "season_user", "season_id || '/' || user_id", "2", "s WHERE id % 5 = 0 AND final_points IS NOT NULL")),
)
add(
    "audit_locked_project",
    lambda d: audits.locked_project(d.proof_record, _CANCELLED(d)),
    over("season_user_project", x=_CANCELLED_SQL, select=_AUDIT.format("locked_project", "proof_record", "id", "season_user_id || '/' || project_id", "proof_record p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.status = 1 AND x.season_user_id = p.season_user_id AND x.project_id = p.project_id)")),
)
add(
    "audit_config_match",
    lambda d: audits.config_match(_bad(d.proof_record, "id % 90 = 0", project_upload_config_id=F.lit(99)), d.project_upload_config),
    over("proof_record", select=_AUDIT.format("config_match", "proof_record", "id", "'99/' || project_id", "proof_record WHERE id % 90 = 0")),
)
_FLAW = "CAST(id AS BIGINT) % 25 = 3"
add(
    "audit_not_null",
    lambda d: audits.not_null(_bad(d.user, _FLAW, name=F.lit(None), department_id=F.lit(None)), "user"),
    over("user", select=" UNION ALL ".join(_AUDIT.format("not_null", "user", "id", f"'{c}'", f'"user" WHERE {_FLAW}') for c in ("name", "department_id"))),
)
add(
    "audit_length",
    lambda d: audits.length(_bad(d.user, _FLAW, name=F.repeat(F.lit("x"), 129)), "user"),
    over("user", select=_AUDIT.format("length", "user", "id", "'name'", f'"user" WHERE {_FLAW}')),
)
add(
    "audit_unsigned",
    lambda d: audits.unsigned(_bad(d.product, "id % 25 = 3", points_required=F.lit(-5)), "product"),
    over("product", select=_AUDIT.format("unsigned", "product", "id", "'points_required'", "product WHERE id % 25 = 3")),
)
add(
    "audit_enum",
    lambda d: audits.enum(_bad(d.proof_record, "id % 25 = 3", review_status=F.lit("lost")), "proof_record"),
    over("proof_record", select=_AUDIT.format("enum", "proof_record", "id", "'review_status'", "proof_record WHERE id % 25 = 3")),
)

# transitions; commands are deterministic subsets
_project = lambda frame: frame.select("id", "completion_progress", "status")
_PROGRESS_OF = f"SELECT s.id, CAST(coalesce(t.p, 0) AS DECIMAL(5,4)) AS completion_progress, s.status FROM season_user_project s LEFT JOIN (SELECT season_user_id, project_id, sum(increase) AS p FROM f WHERE {COUNTED} GROUP BY ALL) t ON t.season_user_id = s.season_user_id AND t.project_id = s.project_id"
_lock = lambda d: d.season_user_project.where("id % 6 = 0").select("season_user_id", F.lit(2).cast("long").alias("season_id"), (F.col("season_user_id") - 1).cast("string").alias("user_id"), (1 + (F.col("project_id") + 2) % 6).alias("project_id"), (1_000_000 + F.col("id")).alias("row_id"))
add(
    "tr_lock_project",
    lambda d: transitions.lock_project(d.season_user.where("id % 5 <> 0"), _CANCELLED(d), _lock(d))[0].select("id", "user_id", "status"),
    over("season_user", "season_user_project", x=_CANCELLED_SQL, c="SELECT season_user_id, 1 + (project_id + 2) % 6 AS project_id FROM season_user_project WHERE id % 6 = 0",
         a="SELECT season_user_id, project_id FROM x WHERE status = 1 UNION SELECT season_user_id, project_id FROM c", n="SELECT season_user_id, count(*) AS n FROM a GROUP BY season_user_id",
         select="SELECT u.id, u.user_id, CAST(coalesce(n, 0) AS SMALLINT) AS status FROM season_user u LEFT JOIN n ON n.season_user_id = u.id WHERE u.id % 5 <> 0 OR u.id IN (SELECT season_user_id FROM c)"),
)
add(
    "tr_lock_level",
    lambda d: transitions.lock_level(d.season_user, d.season_user.where("level_id IS NULL AND id % 2 = 0").select("id", F.lit(2).cast("long").alias("level_id")), AS_OF_TIME).select("id", "level_id", "participated_at"),
    over("season_user", select=f"SELECT id, CASE WHEN level_id IS NULL AND id % 2 = 0 THEN 2 ELSE level_id END AS level_id, CASE WHEN level_id IS NULL AND id % 2 = 0 THEN TIMESTAMP '{AS_OF_TIME}' ELSE participated_at END AS participated_at FROM season_user"),
)
_uploads = lambda d: d.season_user_project.select(
    (5_000_000 + F.col("id")).alias("id"), "season_user_id", (1 + F.when(F.col("id") % 7 == 0, F.col("project_id") + 2).otherwise(F.col("project_id") - 1) % 6).alias("project_id"),
    F.when(F.col("id") % 11 == 0, 99).otherwise(F.col("project_id")).cast("long").alias("project_upload_config_id"), F.lit("/uploads/new.jpg").alias("image_url"), F.lit(None).cast("string").alias("note"),
    F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 25).cast("int")).alias("proof_date"),
)
_UPLOADS = "SELECT 5000000 + id AS id, season_user_id, 1 + CASE WHEN id % 7 = 0 THEN project_id + 2 ELSE project_id - 1 END % 6 AS project_id, CASE WHEN id % 11 = 0 THEN 99 ELSE project_id END AS cfg, DATE '2024-01-01' + CAST(id % 25 AS INTEGER) AS proof_date FROM season_user_project"
_JUDGED = f"""SELECT c.id, CASE WHEN proof_date > DATE '{AS_OF}' THEN 'date'
    WHEN NOT EXISTS (SELECT 1 FROM season_user_project s WHERE s.season_user_id = c.season_user_id AND s.project_id = c.project_id) THEN 'project not locked'
    WHEN NOT EXISTS (SELECT 1 FROM project_upload_config f WHERE f.id = c.cfg AND f.project_id = c.project_id) THEN 'configuration'
    WHEN EXISTS (SELECT 1 FROM proof_record p WHERE p.status = 1 AND p.season_user_id = c.season_user_id AND p.project_id = c.project_id AND p.proof_date = c.proof_date)
      OR c.id <> min(c.id) OVER (PARTITION BY c.season_user_id, c.project_id, c.proof_date) THEN 'day taken' END AS reason FROM c"""


def _upload(d: Domain) -> DataFrame:
    new, rejects = transitions.upload(d.proof_record, _uploads(d), d.season_user, d.season, d.season_user_project, d.project_upload_config, AS_OF)
    return new.select("id", F.lit(None).cast("string").alias("reason")).union(rejects)


add("tr_upload", _upload, over("season_user_project", "project_upload_config", c=_UPLOADS, j=_JUDGED, select="SELECT id, reason FROM j"))
_AGAIN = f"""SELECT * REPLACE (CASE WHEN h THEN '/uploads/again.jpg' ELSE image_url END AS image_url, CASE WHEN h THEN 'pending' ELSE review_status END AS review_status,
    CAST(CASE WHEN h THEN 0 ELSE progress_delta END AS DECIMAL(5,4)) AS progress_delta, CAST(CASE WHEN h THEN 0 ELSE increase END AS DECIMAL(5,4)) AS increase,
    CASE WHEN h THEN TIMESTAMP '{AS_OF_TIME}' ELSE created_at END AS created_at) FROM (SELECT *, id % 8 = 3 AND status = 1 AS h FROM proof_record)"""
add(
    "tr_reupload",
    lambda d: _proof(transitions.reupload(d.proof_record, _ids(d.proof_record, 8, 3).withColumn("image_url", F.lit("/uploads/again.jpg")), AS_OF_TIME)),
    over("proof_record", r=_AGAIN, f=refilled("r"), select=_PROOF.format("f")),
)
_VERDICTS = """SELECT * EXCLUDE h REPLACE (CASE WHEN NOT h THEN review_status WHEN id % 3 <> 0 THEN 'preliminary_approved' ELSE 'preliminary_rejected' END AS review_status,
    CAST(CASE WHEN NOT h THEN progress_delta WHEN id % 3 <> 0 THEN (id * 13 % 2000) * 0.0001 ELSE 0 END AS DECIMAL(5,4)) AS progress_delta,
    CAST(CASE WHEN h THEN 0 ELSE increase END AS DECIMAL(5,4)) AS increase), h AS fresh
    FROM (SELECT *, status = 1 AND review_status = 'pending' AND id % 2 = 0 AND id % 11 <> 0 AS h FROM proof_record)"""
add("tr_preliminary_review", lambda d: _proof(transitions.preliminary_review(d.proof_record, _results(d))), over("proof_record", r=_VERDICTS, f=allocated("r"), select=_PROOF.format("f")))
add(
    "tr_final_approve",
    lambda d: _proof(transitions.final_approve(d.proof_record, _ids(d.proof_record, 5, 2))),
    over("proof_record", select="SELECT id, CASE WHEN id % 5 = 2 AND status = 1 AND review_status LIKE 'preliminary%' THEN 'approved' ELSE review_status END AS review_status, status, progress_delta, increase FROM proof_record"),
)
_REJECTED = """SELECT * REPLACE (CASE WHEN h THEN 'rejected' ELSE review_status END AS review_status, CAST(CASE WHEN h THEN 0 ELSE increase END AS DECIMAL(5,4)) AS increase)
    FROM (SELECT *, id % 10 = 5 AND status = 1 AND (review_status LIKE 'preliminary%' OR review_status = 'approved') AS h FROM proof_record)"""
add("tr_final_reject", lambda d: _proof(transitions.final_reject(d.proof_record, d.season_user_project, _ids(d.proof_record, 10, 5))[0]), over("proof_record", r=_REJECTED, f=refilled("r"), select=_PROOF.format("f")))
add("tr_final_reject_progress", lambda d: _project(transitions.final_reject(d.proof_record, d.season_user_project, _ids(d.proof_record, 10, 5))[1]), over("season_user_project", r=_REJECTED, f=refilled("r"), select=_PROGRESS_OF))
_VOIDED = "SELECT * REPLACE (CAST(CASE WHEN id % 12 = 4 THEN 0 ELSE status END AS SMALLINT) AS status, CAST(CASE WHEN id % 12 = 4 THEN 0 ELSE increase END AS DECIMAL(5,4)) AS increase) FROM proof_record"
add("tr_void_proof", lambda d: _project(transitions.void_proof(d.proof_record, d.season_user_project, _ids(d.proof_record, 12, 4))[1]), over("season_user_project", r=_VOIDED, f=refilled("r"), select=_PROGRESS_OF))
add(
    "tr_void_project",
    lambda d: transitions.void_project(d.season_user, d.season_user_project, _ids(d.season_user_project, 4, 0))[0].select("id", "status"),
    over("season_user", "season_user_project", x=_CANCELLED_SQL, select="SELECT u.id, CAST(count_if(x.status = 1) AS SMALLINT) AS status FROM season_user u LEFT JOIN x ON x.season_user_id = u.id GROUP BY u.id"),
)
_KG = "60 + season_user_id % 30 - CASE WHEN project_upload_config_id = 7 THEN id % 5 ELSE 0 END"
_PASSED = f"""SELECT end_id FROM (SELECT q.end_id, a.kg - b.kg AS lost, a.kg / ((CAST(u.height_cm AS DOUBLE) / 100) * (CAST(u.height_cm AS DOUBLE) / 100)) AS bmi FROM q
    JOIN season_user e ON e.id = q.season_user_id JOIN "user" u ON u.id = e.user_id JOIN w a ON a.id = q.start_id JOIN w b ON b.id = q.end_id) WHERE lost >= {_TIER}"""
_WEIGHED = """SELECT * EXCLUDE h REPLACE (CASE WHEN h AND review_status = 'pending' THEN 'preliminary_approved' ELSE review_status END AS review_status,
    CAST(CASE WHEN h THEN 1 ELSE progress_delta END AS DECIMAL(5,4)) AS progress_delta, CAST(CASE WHEN h THEN 0 ELSE increase END AS DECIMAL(5,4)) AS increase), h AS fresh
    FROM (SELECT *, status = 1 AND review_status IN ('pending', 'preliminary_approved', 'approved') AND id IN (SELECT end_id FROM d) AS h FROM proof_record)"""
add(
    "tr_weight_final",
    lambda d: _proof(transitions.weight_final(d.proof_record, d.user, d.season_user, _weights(d), MONTH_START, MONTH_END)),
    over("proof_record", "season_user", "user", q=_PAIRS, w=f"SELECT id, {_KG} AS kg FROM proof_record", d=_PASSED, r=_WEIGHED, f=allocated("r"), select=_PROOF.format("f")),
)
add(
    "tr_season_status",
    lambda d: transitions.season_status(d.season, d.spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "id long, to int")).select("id", "status"),
    over("season", select="SELECT id, CAST(CASE id WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE status END AS SMALLINT) AS status FROM season"),
)
add("tr_refresh_leaderboard", lambda d: transitions.refresh_leaderboard(d.proof_record, d.season_user, d.season, MONTH_START, MONTH_END), over("leaderboard_snapshot", select="SELECT * FROM leaderboard_snapshot"))


def all_or_share(facts: dict) -> F.Column:
    """An example policy: the level's reward if all projects are complete, else its share by completed projects; nobody without a level."""
    share = F.floor(F.coalesce(facts["reward"], F.lit(0)) * facts["n_completed"] / facts["required"])
    return F.when(facts["n_open"] < 100, F.least(share, F.coalesce(facts["reward"], F.lit(0))))


def _settled(d: Domain) -> tuple[DataFrame, DataFrame]:
    """The running season is ended first, then settled on the first day after it."""
    end = d.season.where("status = 1").select("id", F.lit(2).alias("to"))
    return transitions.settle(d.season_user, transitions.season_status(d.season, end), d.season_user_project, d.proof_record, d.project_level, d.point_record, AFTER_TIME, all_or_share)


_PAID = """SELECT u.id, u.user_id, CAST(least(l.reward * f.n_completed // 3, l.reward) AS BIGINT) AS points
    FROM season_user u JOIN season s ON s.id = u.season_id AND s.status IN (1, 2) AND s.end_date < DATE '2024-02-01'
    JOIN facts f ON f.season_user_id = u.id JOIN project_level l ON l.id = u.level_id
    WHERE u.status = s.required_project_count AND u.participated_at IS NOT NULL AND u.final_points IS NULL AND f.n_open < 100"""
add(
    "tr_settle", lambda d: _settled(d)[0].select("id", "final_points"),
    over("season_user", "season", "facts", "project_level", p=_PAID, select="SELECT u.id, coalesce(u.final_points, p.points) AS final_points FROM season_user u LEFT JOIN p ON p.id = u.id"),
)
add(
    "tr_settle_ledger",
    lambda d: _settled(d)[1].select("id", "user_id", "change_points", "points_after"),
    over("season_user", "season", "facts", "project_level", "balance", p=_PAID, select="""SELECT (SELECT max(id) FROM point_record) + p.id AS id, p.user_id, CAST(p.points AS INTEGER) AS change_points,
        CAST(coalesce(b.balance, 0) + sum(p.points) OVER (PARTITION BY p.user_id ORDER BY p.id) AS BIGINT) AS points_after
        FROM p LEFT JOIN balance b ON b.user_id = p.user_id WHERE p.points > 0"""),
)
_orders = lambda d: d.user.where("CAST(id AS BIGINT) % 2 = 0").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.col("id").alias("user_id")).select(
    (9_000_000 + F.col("user_id").cast("long") * 2 + F.col("k")).alias("id"), "user_id", (1 + (F.col("user_id").cast("long") + F.col("k") * 7) % 100).alias("product_id"))


def _exchange(d: Domain) -> DataFrame:
    rows, rejects = transitions.exchange(d.point_record, d.product, _orders(d), AS_OF_TIME)
    return rows.select("id", "change_points", "points_after", F.lit(None).cast("string").alias("reason")).union(
        rejects.select("id", F.lit(None).cast("int"), F.lit(None).cast("long"), "reason")
    )


add(
    "tr_exchange", _exchange,
    over("user", "product", "balance",
         c='SELECT 9000000 + CAST(id AS BIGINT) * 2 + k AS id, id AS user_id, k, 1 + (CAST(id AS BIGINT) + k * 7) % 100 AS product_id FROM "user", range(2) AS r(k) WHERE CAST(id AS BIGINT) % 2 = 0',
         p="SELECT c.*, coalesce(b.balance, 0) AS held, q.points_required AS cost FROM c LEFT JOIN balance b ON b.user_id = c.user_id LEFT JOIN product q ON q.id = c.product_id AND q.status = 1",
         a="SELECT user_id, CASE WHEN cost <= held THEN cost ELSE 0 END AS spent FROM p WHERE k = 0",
         j="SELECT p.*, held - CASE WHEN k = 1 THEN coalesce(a.spent, 0) ELSE 0 END AS free FROM p JOIN a ON a.user_id = p.user_id",
         select="""SELECT id, CAST(CASE WHEN cost <= free THEN -cost END AS INTEGER) AS change_points, CAST(CASE WHEN cost <= free THEN free - cost END AS BIGINT) AS points_after,
         CASE WHEN cost IS NULL THEN 'not on shelf' WHEN cost > free THEN 'balance' END AS reason FROM j"""),
)
add(
    "tr_manual_adjust",
    lambda d: transitions.manual_adjust(d.point_record, d.user.select((8_000_000 + F.col("id").cast("long")).alias("id"), F.col("id").alias("user_id"), F.lit(-5).alias("change_points"), F.lit("correction").alias("description")), AS_OF_TIME).select("id", "user_id", "points_after"),
    over("user", "balance", select='SELECT 8000000 + CAST(u.id AS BIGINT) AS id, u.id AS user_id, coalesce(balance, 0) - 5 AS points_after FROM "user" u LEFT JOIN balance b ON b.user_id = u.id'),
)
add("tr_void_ledger", lambda d: transitions.void_ledger(d.point_record, _ids(d.point_record, 13, 0)).select("id", "status", "points_after"), over("point_record", select="SELECT id, CAST(CASE WHEN id % 13 = 0 THEN 0 ELSE status END AS SMALLINT) AS status, points_after FROM point_record"))
add(
    "tr_toggle",
    lambda d: transitions.toggle(d.product, "product", _ids(d.product, 6, 1).withColumn("to", F.lit(0))).select("id", "status"),
    over("product", select="SELECT id, CAST(CASE WHEN id % 6 = 1 THEN 0 ELSE status END AS SMALLINT) AS status FROM product"),
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard with names and ranks."""
    d = Domain(spark, sf_dir)
    ranked = windows.with_rank(d.leaderboard_snapshot).select("season_user_id", "rank_no")
    return _view(d).join(ranked, "season_user_id")


QUERIES["leaderboard"] = flagship
ORACLES["leaderboard"] = over(*_BOARD, v=_VIEW, select="SELECT *, rank() OVER (ORDER BY checkin_count DESC) AS rank_no FROM v")
