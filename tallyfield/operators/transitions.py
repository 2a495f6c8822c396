"""State transitions: tables and a command table in, new table versions out.

A command table holds one row per affected row. Amounts of a season_user and project change together,
inside one window group, so a batch of commands needs one shuffle by that key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..schema import TABLES
from ..sources.tables import conform
from . import aggregates, filters, joins, windows


def _marked(frame: DataFrame, commands: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """The frame with ``_hit`` and the commands' columns; a repeated command counts once (the smallest)."""
    renamed = commands.groupBy(*keys).agg(*[F.min(source).alias(f"_{name}") for name, source in columns.items()], F.lit(True).alias("_hit"))
    return frame.join(renamed, keys, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def _done(frame: DataFrame, table: str) -> DataFrame:
    return conform(frame, table)


def _set(frame: DataFrame, when: Column, **values: Column) -> DataFrame:
    return frame.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def _within_touched(frame: DataFrame, touched: Column, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The frame with a window rule applied to the groups (season_user, project) of touched rows only; others are not dealt."""
    groups = frame.where(touched).select(*windows.GROUP).distinct()
    inside, outside = (frame.join(groups, list(windows.GROUP), how) for how in ("left_semi", "left_anti"))
    return rule(inside).unionByName(outside)


def update_progress(projects: DataFrame, proofs: DataFrame) -> DataFrame:
    """Projects with their progress summed anew from the proofs."""
    total = aggregates.progress(proofs).withColumnRenamed("completion_progress", "_total")
    joined = projects.join(total, ["season_user_id", "project_id"], "left")
    return _done(joined.withColumn("completion_progress", F.coalesce("_total", F.lit(0))), "season_user_project")


def lock_project(season_user: DataFrame, projects: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """commands (season_user_id, season_id, user_id, project_id, row_id): create entries, add or relock projects, recount.

    ``row_id`` is the id of a new project row; a cancelled row of the same project is locked again instead.
    """
    entries = commands.groupBy("season_id", "user_id").agg(F.min("season_user_id").alias("id"))
    fresh = entries.join(season_user.select("season_id", "user_id"), ["season_id", "user_id"], "left_anti").withColumn("status", F.lit(0))
    blank = [F.col(f.name) if f.name in fresh.columns else F.lit(None).alias(f.name) for f in TABLES["season_user"].schema.fields]
    entered = season_user.unionByName(_done(fresh.select(*blank), "season_user"))
    again = _marked(projects, commands, ["season_user_id", "project_id"])
    locked = _done(_set(again, F.col("_hit"), status=F.lit(1)), "season_user_project")
    wanted = commands.groupBy("season_user_id", "project_id").agg(F.min("row_id").alias("id"))
    added = wanted.join(projects.select("season_user_id", "project_id"), ["season_user_id", "project_id"], "left_anti")
    added = _done(added.withColumns({"completion_progress": F.lit(0), "status": F.lit(1)}), "season_user_project")
    locked = locked.unionByName(added)
    return recount(entered, locked), locked


def recount(season_user: DataFrame, projects: DataFrame) -> DataFrame:
    """``status`` of season_user as its number of valid locked projects."""
    joined = season_user.join(aggregates.locked_count(projects), F.col("id") == F.col("season_user_id"), "left")
    return _done(joined.withColumn("status", F.coalesce("locked", F.lit(0))), "season_user")


def lock_level(season_user: DataFrame, commands: DataFrame, as_of: str) -> DataFrame:
    """commands (id, level_id): set the level and the time of entry together; a level that is set stays."""
    hit = _marked(season_user, commands, ["id"], level="level_id")
    return _done(_set(hit, F.col("_hit") & F.col("level_id").isNull(), level_id=F.col("_level"), participated_at=F.lit(as_of)), "season_user")


def upload(
    proofs: DataFrame, commands: DataFrame, season_user: DataFrame, season: DataFrame, projects: DataFrame, configs: DataFrame, as_of: str
) -> tuple[DataFrame, DataFrame]:
    """commands (id, season_user_id, project_id, project_upload_config_id, image_url, note, proof_date): accepted proofs and rejects with a reason.

    Checks: the date, a locked project, a fitting enabled configuration, no valid proof of the day (nor an earlier command for it).
    """
    entry = season_user.select(F.col("id").alias("season_user_id"), "season_id")
    bounds = season.select(F.col("id").alias("season_id"), "start_date", "end_date")
    locked = projects.where("status = 1").select("season_user_id", "project_id").distinct().withColumn("_locked", F.lit(True))
    fit = configs.where("status = 1").select(F.col("id").alias("project_upload_config_id"), "project_id").withColumn("_fit", F.lit(True))
    day = ["season_user_id", "project_id", "proof_date"]
    taken = proofs.where("status = 1").select(*day).distinct().withColumn("_taken", F.lit(True))
    first = commands.groupBy(*day).agg(F.min("id").alias("_first"))
    checked = (
        commands.join(entry, "season_user_id", "left").join(bounds, "season_id", "left").join(locked, ["season_user_id", "project_id"], "left")
        .join(fit, ["project_upload_config_id", "project_id"], "left").join(taken, day, "left").join(first, day, "left")
    )
    last = F.least(F.col("end_date"), F.lit(as_of).cast("date"))
    reason = (
        F.when(F.col("start_date").isNull(), "no season")
        .when(~F.col("proof_date").between(F.col("start_date"), last), "date")
        .when(F.col("_locked").isNull(), "project not locked")
        .when(F.col("_fit").isNull(), "configuration")
        .when(F.col("_taken").isNotNull() | (F.col("id") != F.col("_first")), "day taken")
    )
    judged = checked.withColumn("reason", reason)
    new = judged.where("reason IS NULL").withColumns({
        "review_status": F.lit("pending"), "review_comment": F.lit(None), "progress_delta": F.lit(0), "increase": F.lit(0), "status": F.lit(1), "created_at": F.lit(as_of),
    })
    return _done(new, "proof_record"), judged.where("reason IS NOT NULL").select("id", "reason")


def reupload(proofs: DataFrame, commands: DataFrame, as_of: str) -> DataFrame:
    """commands (id, image_url): valid proofs get new content, lose their amounts, wait again; freed space is refilled."""
    hit = _marked(proofs, commands, ["id"], url="image_url")
    legal = F.col("_hit") & (F.col("status") == 1) & scalars.next_status(F.col("review_status"), F.lit("reupload")).isNotNull()
    hit = hit.withColumn("_legal", legal)
    new = _set(hit, F.col("_legal"), image_url=F.col("_url"), review_status=F.lit("pending"), review_comment=F.lit(None), progress_delta=F.lit(0), increase=F.lit(0), created_at=F.lit(as_of).cast("timestamp_ntz"))
    return _done(_within_touched(new, F.col("_legal"), windows.refill), "proof_record")


def preliminary_review(proofs: DataFrame, results: DataFrame) -> DataFrame:
    """results (id, created_at, verdict, delta, comment): write verdicts back where the version is unchanged, then allocate."""
    one = results.groupBy("id", "created_at").agg(*[F.min(F.struct("verdict", "delta", "comment")).alias("_r")])
    hit = proofs.join(one, ["id", "created_at"], "left")
    action = F.when(F.col("_r.verdict"), "preliminary_approve").otherwise("preliminary_reject")
    to = scalars.next_status(F.col("review_status"), action)
    legal = F.col("_r").isNotNull() & (F.col("status") == 1) & to.isNotNull()
    delta = F.when(F.col("_r.verdict"), F.col("_r.delta")).otherwise(0).cast("decimal(5,4)")
    fresh = hit.withColumn("_fresh", legal)
    new = _set(fresh, F.col("_fresh"), review_status=to, review_comment=F.col("_r.comment"), progress_delta=delta, increase=F.lit(0).cast("decimal(5,4)"))
    return _done(_within_touched(new, F.col("_fresh"), lambda rows: windows.allocate_new(rows, F.col("_fresh"))), "proof_record")


def _review(proofs: DataFrame, commands: DataFrame, action: str) -> DataFrame:
    hit = _marked(proofs, commands, ["id"])
    to = scalars.next_status(F.col("review_status"), F.lit(action))
    return hit.withColumn("_legal", F.col("_hit") & (F.col("status") == 1) & to.isNotNull()).withColumn("_to", to)


def final_approve(proofs: DataFrame, commands: DataFrame) -> DataFrame:
    """commands (id): amounts stay as they are."""
    return _done(_set(_review(proofs, commands, "approve"), F.col("_legal"), review_status=F.col("_to")), "proof_record")


def final_reject(proofs: DataFrame, projects: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """commands (id): rejected proofs lose their increase, others are refilled, progress is summed anew."""
    new = _set(_review(proofs, commands, "reject"), F.col("_legal"), review_status=F.col("_to"), increase=F.lit(0).cast("decimal(5,4)"))
    done = _done(_within_touched(new, F.col("_legal"), windows.refill), "proof_record")
    return done, update_progress(projects, done)


def void_proof(proofs: DataFrame, projects: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """commands (id): proofs become invalid, their space is refilled, progress is summed anew."""
    hit = _marked(proofs, commands, ["id"])
    new = _set(hit, F.col("_hit"), status=F.lit(0).cast("smallint"), increase=F.lit(0).cast("decimal(5,4)"))
    done = _done(_within_touched(new, F.col("_hit"), windows.refill), "proof_record")
    return done, update_progress(projects, done)


def void_project(season_user: DataFrame, projects: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """commands (id): cancel locked projects and recount; their proofs stay and drop out through the semi-join."""
    done = _done(_set(_marked(projects, commands, ["id"]), F.col("_hit"), status=F.lit(0)), "season_user_project")
    return recount(season_user, done), done


def weight_final(proofs: DataFrame, users: DataFrame, season_user: DataFrame, weights: DataFrame, month_start: Iterable[int], month_end: Iterable[int]) -> DataFrame:
    """weights (proof_id, kg): month-end proofs that lost their tier's target since the baseline complete the project."""
    pairs = joins.weight_pairs(proofs, month_start, month_end)
    entry = season_user.select(F.col("id").alias("season_user_id"), "user_id").join(users.select(F.col("id").alias("user_id"), "height_cm"), "user_id")
    kilos = lambda name: weights.select(F.col("proof_id").alias(f"{name}_id"), F.col("kg").alias(f"{name}_kg"))
    weighed = pairs.join(entry, "season_user_id").join(kilos("start"), "start_id").join(kilos("end"), "end_id")
    target = scalars.bmi_target(scalars.bmi(F.col("start_kg"), F.col("height_cm")))
    passed = weighed.where(F.col("start_kg") - F.col("end_kg") >= target).select(F.col("end_id").alias("id"))
    hit = _marked(proofs, passed, ["id"])
    legal = F.col("_hit") & (F.col("status") == 1) & F.col("review_status").isin("pending", "preliminary_approved", "approved")
    fresh = hit.withColumn("_fresh", legal)
    state = F.when(F.col("review_status") == "pending", "preliminary_approved").otherwise(F.col("review_status"))
    new = _set(fresh, F.col("_fresh"), review_status=state, progress_delta=F.lit(1).cast("decimal(5,4)"), increase=F.lit(0).cast("decimal(5,4)"))
    return _done(_within_touched(new, F.col("_fresh"), lambda rows: windows.allocate_new(rows, F.col("_fresh"))), "proof_record")


def season_status(season: DataFrame, commands: DataFrame) -> DataFrame:
    """commands (id, to): 0 to 1 to 2; of several seasons that would run, the one of the smallest id does, and none beside one that runs on."""
    hit = _marked(season, commands, ["id"], to="to")
    step = F.col("_hit") & (F.col("_to") == F.col("status") + 1)
    kept = hit.agg(F.count_if((F.col("status") == 1) & ~step).alias("_running"), F.min(F.when(step & (F.col("_to") == 1), F.col("id"))).alias("_starter"))
    judged = hit.join(F.broadcast(kept))  # one row
    starts = (F.col("_to") != 1) | (F.col("_running") == 0) & (F.col("id") == F.col("_starter"))
    return _done(_set(judged, F.coalesce(step, F.lit(False)) & starts, status=F.col("_to")), "season")


def refresh_leaderboard(proofs: DataFrame, season_user: DataFrame, season: DataFrame, month_start: Iterable[int], month_end: Iterable[int]) -> DataFrame:
    """The running season's snapshot; a season_user has at most one row, so its id serves as the row's."""
    entered = season_user.join(season.where("status = 1").select(F.col("id").alias("season_id")), "season_id", "left_semi")
    counts = aggregates.checkins(proofs, month_start, month_end)
    counted = counts.join(entered.select(F.col("id").alias("season_user_id")), "season_user_id", "left_semi")
    return _done(counted.withColumn("id", F.col("season_user_id")), "leaderboard_snapshot")


def settle(
    season_user: DataFrame, season: DataFrame, projects: DataFrame, proofs: DataFrame, levels: DataFrame, points: DataFrame, as_of: str,
    policy: Callable[[dict[str, Column]], Column],
) -> tuple[DataFrame, DataFrame]:
    """Set ``final_points`` of formal participants of ended seasons by the caller's policy, and one reward row each.

    Settled rows are never paid again. Several due seasons of one user are booked one after the other.

    policy maps facts (reward, n_projects, n_completed, n_open, min_progress, required) to points.
    """
    due = filters.settlement_due(season_user, season, as_of)
    level = levels.select(F.col("id").alias("level_id"), "reward")
    facts = aggregates.settlement_facts(season_user, projects, proofs)
    joined = due.join(level, "level_id", "left").join(facts, F.col("id") == F.col("season_user_id"), "left").drop("season_user_id")
    names = ("reward", "n_projects", "n_completed", "n_open", "min_progress")
    given = {c: F.col(c) for c in names} | {"required": F.col("required_project_count")}
    paid = joined.select("id", "user_id", policy(given).cast("long").alias("_points")).where("_points IS NOT NULL")
    done = season_user.join(paid.select("id", "_points"), "id", "left").withColumn("final_points", F.coalesce("final_points", "_points"))
    last = points.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    rows = paid.where("_points > 0").join(F.broadcast(last)).select(  # one row
        (F.col("_last") + F.col("id")).alias("id"), "user_id", F.lit(None).alias("product_id"), F.lit("season_reward").alias("change_type"),
        F.col("_points").cast("int").alias("change_points"), F.lit(None).alias("description"), F.lit(1).alias("status"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
    )
    return _done(done, "season_user"), _booked(rows, points)


def _booked(rows: DataFrame, points: DataFrame) -> DataFrame:
    """New ledger rows with ``points_after``: each user's balance in the ledger and the rows up to each, by (created_at, id)."""
    own = windows.running_balance(rows).join(aggregates.balance(points), "user_id", "left")
    return _done(own.withColumn("points_after", F.col("points_after") + F.coalesce("balance", F.lit(0))), "point_record")


def exchange(points: DataFrame, products: DataFrame, commands: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """commands (id, user_id, product_id): new ledger rows, and rejects with a reason.

    A user's commands are taken by id; each is paid if the shelf and the balance left allow it. The fold
    runs over one user's commands of the batch, which is what the rule's serialisation needs.
    """
    price = products.where("status = 1").select(F.col("id").alias("product_id"), "points_required")
    priced = commands.join(price, "product_id", "left")
    held = aggregates.balance(points)
    each = priced.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("id", "product_id", "points_required"))).alias("c")).join(held, "user_id", "left")
    kind = "array<struct<id:bigint,product_id:bigint,paid:bigint,after:bigint,reason:string>>"

    def step(a: Column, x: Column) -> Column:
        cost = x["points_required"]
        reason = F.when(cost.isNull(), "not on shelf").when(cost > a["left"], "balance")
        left = F.when(reason.isNull(), a["left"] - cost).otherwise(a["left"])
        row = F.struct(x["id"].cast("long").alias("id"), x["product_id"].cast("long").alias("product_id"), cost.cast("long").alias("paid"), left.cast("long").alias("after"), reason.alias("reason"))
        return F.struct(left.cast("long").alias("left"), F.concat(a["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.coalesce("balance", F.lit(0)).cast("long").alias("left"), F.array().cast(kind).alias("rows"))
    done = each.select("user_id", F.explode(F.aggregate("c", start, step, lambda a: a["rows"])).alias("r")).select("user_id", "r.*")
    rows = done.where("reason IS NULL").select(
        "id", "user_id", "product_id", F.lit("exchange").alias("change_type"), (-F.col("paid")).cast("int").alias("change_points"), F.col("after").alias("points_after"),
        F.lit(None).alias("description"), F.lit(1).alias("status"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
    )
    return _done(rows, "point_record"), done.where("reason IS NOT NULL").select("id", "reason")


def manual_adjust(points: DataFrame, commands: DataFrame, as_of: str) -> DataFrame:
    """commands (id, user_id, change_points, description): signed corrections as new ledger rows with their balances."""
    rows = commands.select(
        "id", "user_id", F.lit(None).cast("bigint").alias("product_id"), F.lit("manual_adjust").alias("change_type"), "change_points", "description",
        F.lit(1).cast("smallint").alias("status"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
    )
    return _booked(rows, points)


def void_ledger(points: DataFrame, commands: DataFrame) -> DataFrame:
    """commands (id): rows no longer count; stored running balances stay, the audit reports the drift."""
    return _done(_set(_marked(points, commands, ["id"]), F.col("_hit"), status=F.lit(0)), "point_record")


def toggle(frame: DataFrame, table: str, commands: DataFrame, column: str = "status") -> DataFrame:
    """commands (id, to): enable or disable rows of a master table, or show and hide feedback."""
    return _done(_set(_marked(frame, commands, ["id"], to="to"), F.col("_hit"), **{column: F.col("_to")}), table)
