"""Integrity audits: each returns (rule, table, key, detail) rows, none if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TABLES
from . import aggregates, joins, windows
from .filters import counted


def _found(frame: DataFrame, rule: str, table: str, key: Column, detail: Column) -> DataFrame:
    return frame.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def _pair(*columns: str) -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in columns])


def increase_range(proofs: DataFrame) -> DataFrame:
    bad = proofs.where(~((F.col("increase") >= 0) & (F.col("increase") <= F.col("progress_delta")) & (F.col("progress_delta") <= 1)))
    return _found(bad, "increase_range", "proof_record", F.col("id"), _pair("increase", "progress_delta"))


def progress_range(projects: DataFrame) -> DataFrame:
    return _found(projects.where(~F.col("completion_progress").between(0, 1)), "progress_range", "season_user_project", F.col("id"), F.col("completion_progress"))


def progress_sum(projects: DataFrame, proofs: DataFrame) -> DataFrame:
    """Stored progress against the sum of counted increases; a project without counted proofs has 0."""
    total = aggregates.progress(proofs).withColumnRenamed("completion_progress", "total")
    joined = projects.join(total, ["season_user_id", "project_id"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("decimal(5,4)")))
    return _found(joined.where("NOT completion_progress <=> total"), "progress_sum", "season_user_project", F.col("id"), _pair("completion_progress", "total"))


def proof_date(proofs: DataFrame, season_user: DataFrame, season: DataFrame, as_of: str) -> DataFrame:
    joined = joins.with_season(proofs, season_user, season)
    last = F.least(F.col("end_date"), F.lit(as_of).cast("date"))
    return _found(joined.where(~F.col("proof_date").between(F.col("start_date"), last)), "proof_date", "proof_record", F.col("id"), F.col("proof_date"))


def one_proof_per_day(proofs: DataFrame) -> DataFrame:
    return _found(aggregates.duplicate_proofs(proofs), "one_proof_per_day", "proof_record", _pair("season_user_id", "project_id", "proof_date"), F.col("n"))


def participation_pair(season_user: DataFrame) -> DataFrame:
    bad = season_user.where(F.col("level_id").isNull() != F.col("participated_at").isNull())
    return _found(bad, "participation_pair", "season_user", F.col("id"), F.when(F.col("level_id").isNull(), "time without level").otherwise("level without time"))


def locked_count(season_user: DataFrame, projects: DataFrame) -> DataFrame:
    joined = season_user.join(aggregates.locked_count(projects), F.col("id") == F.col("season_user_id"), "left").withColumn("locked", F.coalesce("locked", F.lit(0)))
    return _found(joined.where(F.col("status") != F.col("locked")), "locked_count", "season_user", F.col("id"), F.concat_ws("/", F.col("status").cast("string"), F.col("locked").cast("string")))


def single_season(season: DataFrame) -> DataFrame:
    return _found(aggregates.running_seasons(season), "single_season", "season", F.lit("status=1"), F.col("n"))


def delta_zero(proofs: DataFrame, month_start: tuple[int, ...]) -> DataFrame:
    zero = F.col("review_status").isin("pending", "preliminary_rejected") | F.col("project_upload_config_id").isin(*month_start)
    return _found(proofs.where(zero & (F.col("progress_delta") != 0)), "delta_zero", "proof_record", F.col("id"), F.col("progress_delta"))


def rejected_zero(proofs: DataFrame) -> DataFrame:
    return _found(proofs.where("review_status = 'rejected' AND increase <> 0"), "rejected_zero", "proof_record", F.col("id"), F.col("increase"))


def points_after(points: DataFrame) -> DataFrame:
    """Stored running balances against the valid rows; rows after a voided one show the drift."""
    fresh = windows.running_balance(points.withColumnRenamed("points_after", "stored"))
    return _found(fresh.where("NOT stored <=> points_after"), "points_after", "point_record", F.col("id"), _pair("stored", "points_after"))


def negative_balance(points: DataFrame) -> DataFrame:
    fresh = windows.running_balance(points)
    return _found(fresh.where("points_after < 0"), "negative_balance", "point_record", F.col("id"), F.col("points_after"))


def product_nullness(points: DataFrame) -> DataFrame:
    bad = points.where((F.col("change_type") == "exchange") != F.col("product_id").isNotNull())
    return _found(bad, "product_nullness", "point_record", F.col("id"), F.col("change_type"))


def settlement_once(season_user: DataFrame) -> DataFrame:
    """Users with more than one settled row in a season; the ledger itself names no season."""
    settled = season_user.where("final_points IS NOT NULL")
    return _found(aggregates.duplicates(settled, ("season_id", "user_id")), "settlement_once", "season_user", _pair("season_id", "user_id"), F.col("n"))


def locked_project(proofs: DataFrame, projects: DataFrame) -> DataFrame:
    bad = proofs.join(projects.where("status = 1"), ["season_user_id", "project_id"], "left_anti")
    return _found(bad, "locked_project", "proof_record", F.col("id"), _pair("season_user_id", "project_id"))


def config_match(proofs: DataFrame, configs: DataFrame) -> DataFrame:
    fit = configs.where("status = 1").select(F.col("id").alias("project_upload_config_id"), "project_id")
    bad = proofs.join(fit, ["project_upload_config_id", "project_id"], "left_anti")
    return _found(bad, "config_match", "proof_record", F.col("id"), _pair("project_upload_config_id", "project_id"))


def _columns(frame: DataFrame, rule: str, table: str, tests: dict[str, Column]) -> DataFrame:
    """One pass for all columns of a table: the failed ones are exploded from the row."""
    failed = F.filter(F.array(*[F.when(test, F.lit(c)) for c, test in tests.items()]), lambda c: c.isNotNull()) if tests else F.array().cast("array<string>")
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    return frame.select(key.alias("k"), F.explode(failed).alias("c")).select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), F.col("k").alias("key"), F.col("c").alias("detail"))


def not_null(frame: DataFrame, table: str) -> DataFrame:
    return _columns(frame, "not_null", table, {c: F.col(c).isNull() for c in TABLES[table].required})


def length(frame: DataFrame, table: str) -> DataFrame:
    return _columns(frame, "length", table, {c: F.length(c) > n for c, n in TABLES[table].lengths.items()})


def unsigned(frame: DataFrame, table: str) -> DataFrame:
    return _columns(frame, "unsigned", table, {c: F.col(c) < 0 for c in TABLES[table].unsigned})


def enum(frame: DataFrame, table: str) -> DataFrame:
    return _columns(frame, "enum", table, {c: ~F.col(c).isin(*values) for c, values in TABLES[table].enums.items()})


def audit_all(domain, as_of: str, month_start: tuple[int, ...]) -> DataFrame:
    """Every audit over a set of tables, stacked."""
    d = domain
    parts = [
        increase_range(d.proof_record), progress_range(d.season_user_project), progress_sum(d.season_user_project, d.proof_record),
        proof_date(d.proof_record, d.season_user, d.season, as_of), one_proof_per_day(d.proof_record), participation_pair(d.season_user),
        locked_count(d.season_user, d.season_user_project), single_season(d.season), delta_zero(d.proof_record, month_start), rejected_zero(d.proof_record),
        points_after(d.point_record), negative_balance(d.point_record), product_nullness(d.point_record), settlement_once(d.season_user),
        locked_project(d.proof_record, d.season_user_project), config_match(d.proof_record, d.project_upload_config),
    ]
    for name in TABLES:
        parts += [check(getattr(d, name), name) for check in (not_null, length, unsigned, enum)]
    return reduce(DataFrame.unionByName, parts)


def counted_increase(proofs: DataFrame) -> DataFrame:
    """Increases on rows that do not count."""
    return _found(proofs.where(~counted() & (F.col("increase") != 0)), "counted_increase", "proof_record", F.col("id"), F.col("increase"))
