"""The domain tables built from the star schema, with integer and exact decimal arithmetic only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import allocate
from ..schema import TABLES
from .tables import conform

#: Master data: six projects, three levels, their upload configurations and seasons.
PROJECTS = ((1, "daily steps"), (2, "running"), (3, "cycling"), (4, "swimming"), (5, "strength"), (6, "weight control"))
LEVELS = ((1, "bronze", 100), (2, "silver", 200), (3, "gold", 300))
CONFIGS = tuple((i, i, "ordinary", 0) for i in range(1, 6)) + ((6, 6, "month-start", 10), (7, 6, "month-end", 20))
SEASONS = ((1, "2023-12", "2023-12-01", "2023-12-31", 3, 2), (2, "2024-01", "2024-01-01", "2024-01-31", 3, 1), (3, "2024-02", "2024-02-01", "2024-02-29", 3, 0))
MONTH_START, MONTH_END = (6,), (7,)


def _flag(zero: Column) -> Column:
    return F.when(zero, 0).otherwise(1)


class Domain:
    """Lazy domain tables over one data folder: ``Domain(spark, folder).proof_record``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.root = spark, sf_dir

    def _raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def _rows(self, name: str, rows: list[tuple], columns: str) -> DataFrame:
        return conform(self.spark.createDataFrame(rows, columns), name)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return conform(getattr(self, f"_{name}")(), name)

    def _department(self) -> DataFrame:
        return self._raw("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), _flag(F.col("n_nationkey") % 13 == 12).alias("status"))

    def _user(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._raw("customer").select(
            key.cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("department_id"),
            F.lit(None).alias("avatar_url"), F.when(key % 11 != 0, 150 + key % 50).alias("height_cm"), _flag(key % 17 == 0).alias("status"),
        )

    def _product(self) -> DataFrame:
        return self._raw("part").select(
            (F.col("p_partkey") + 1).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"),
            (20 + F.col("p_size")).alias("points_required"), F.lit(None).alias("image_url"), _flag(F.col("p_partkey") % 10 == 0).alias("status"),
        )

    def _season(self) -> DataFrame:
        return self._rows("season", list(SEASONS), "id long, name string, start_date string, end_date string, required_project_count int, status int")

    def _project(self) -> DataFrame:
        return self._rows("project", [(i, n, None, None, 1) for i, n in PROJECTS], "id long, name string, description string, icon_url string, status int")

    def _project_level(self) -> DataFrame:
        return self._rows("project_level", [(i, n, r, 1) for i, n, r in LEVELS], "id long, name string, reward long, status int")

    def _project_upload_config(self) -> DataFrame:
        rows = [(i, p, kind, f"upload {kind}", None, order, 1) for i, p, kind, order in CONFIGS]
        return self._rows("project_upload_config", rows, "id long, project_id long, record_type string, upload_hint string, note_example string, sort_order long, status int")

    def _project_rule(self) -> DataFrame:
        content = '[{{"label":"target","value":"{} per day"}},{{"label":"days","value":"{} in total"}}]'
        rows = [((p - 1) * 3 + n, p, n, None, content.format(1000 * p, 10 * n), None, 1) for p, _ in PROJECTS for n, _, _ in LEVELS]
        return self._rows("project_rule", rows, "id long, project_id long, level_id long, sub_desc string, rule_content string, rule_note string, status int")

    def _season_user(self) -> DataFrame:
        user = F.col("user_id")
        none = user % 7 == 0
        return self._raw("events").select("user_id").distinct().select(
            (user + 1).alias("id"), F.lit(2).alias("season_id"), user.cast("string").alias("user_id"), F.when(~none, 1 + user % 3).alias("level_id"),
            F.when(~none & (user % 14 != 1), F.lit("2024-01-01 00:00:00")).alias("participated_at"), F.lit(None).alias("final_points"), F.lit(3).alias("status"),
        )

    def _proof_record(self) -> DataFrame:
        event, user, project = F.col("event_id"), F.col("user_id"), F.col("project_id")
        config = F.when((project == 6) & (event % 2 == 1), 7).otherwise(project)
        kind = event % 10
        review = (
            F.when(kind <= 1, "pending").when(kind <= 5, "preliminary_approved").when(kind == 6, "preliminary_rejected").when(kind <= 8, "approved").otherwise("rejected")
        )
        zero = F.col("review_status").isin("pending", "preliminary_rejected") | (F.col("project_upload_config_id") == 6)
        delta = F.when(zero, F.lit(0)).otherwise(event * 37 % 3000).cast("decimal(10,0)") * F.lit("0.0001").cast("decimal(5,4)")
        newest = F.row_number().over(Window.partitionBy("user_id", event % 3, "proof_date").orderBy(F.desc("ts"), F.desc("event_id")))
        rows = (
            self._raw("events")
            .withColumn("project_id", 1 + (user + event % 3) % 6)
            .withColumn("project_upload_config_id", config)
            .withColumn("review_status", review)
            .withColumn("progress_delta", delta.cast("decimal(5,4)"))
            .withColumn("proof_date", F.to_date("ts"))
            .withColumn("status", F.when(newest == 1, 1).otherwise(0))
            .select(
                (event + 1).alias("id"), (user + 1).alias("season_user_id"), "project_id", "project_upload_config_id",
                F.concat(F.lit("/uploads/proofs/"), event.cast("string"), F.lit(".jpg")).alias("image_url"), F.col("props").alias("note"), "proof_date",
                "review_status", F.lit(None).alias("review_comment"), "progress_delta", "status", F.col("ts").alias("created_at"),
            )
        )
        return allocate(rows, ("created_at", "id"))

    def _season_user_project(self) -> DataFrame:
        from ..operators.aggregates import progress

        user = F.col("user_id")
        locked = self._raw("events").select("user_id").distinct().select("user_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
        rows = locked.select((user * 3 + F.col("k") + 1).alias("id"), (user + 1).alias("season_user_id"), (1 + (user + F.col("k")) % 6).alias("project_id"), F.lit(1).alias("status"))
        total = progress(self.proof_record)
        return rows.join(total, ["season_user_id", "project_id"], "left").withColumn("completion_progress", F.coalesce("completion_progress", F.lit(0)))

    def _point_record(self) -> DataFrame:
        from ..operators.windows import running_balance

        key = F.col("o_orderkey")
        kind = key % 3
        rows = self._raw("orders").select(
            (key + 1).alias("id"), F.col("o_custkey").cast("string").alias("user_id"), F.when(kind == 1, 1 + key % 200).alias("product_id"),
            F.when(kind == 0, "season_reward").when(kind == 1, "exchange").otherwise("manual_adjust").alias("change_type"),
            F.when(kind == 0, 100 * (1 + key % 2)).when(kind == 1, -(20 + key % 30)).otherwise(key % 21 - 10).cast("int").alias("change_points"),
            F.lit(None).alias("description"), _flag(key % 29 == 0).alias("status"), F.col("o_orderdate").alias("created_at"),
        )
        return running_balance(rows)

    def _user_suggestion(self) -> DataFrame:
        key = F.col("doc_id")
        minutes = F.make_dt_interval(F.lit(0), F.lit(0), key.cast("int"), F.lit(0))
        return self._raw("documents").select(
            (key + 1).alias("id"), (key % 150).cast("string").alias("user_id"), F.coalesce("text", F.lit("")).alias("content"),
            _flag(key % 5 == 0).alias("is_visible"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minutes).alias("created_at"),
        )

    def _leaderboard_snapshot(self) -> DataFrame:
        from ..operators.transitions import refresh_leaderboard

        return refresh_leaderboard(self.proof_record, self.season_user, self.season, MONTH_START, MONTH_END)
