"""The fourteen tables: Spark types, keys, checks, enumerations and lengths, as one registry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "smallint": T.ShortType(), "int": T.IntegerType(), "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(), "decimal(5,4)": T.DecimalType(5, 4), "decimal(5,2)": T.DecimalType(5, 2),
}


@dataclass(frozen=True)
class Table:
    """columns: 'name:type' in order, '!' marks NOT NULL; foreign: column to parent table."""

    name: str
    columns: str
    unique: tuple[tuple[str, ...], ...] = ()
    foreign: dict[str, str] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)
    enums: dict[str, tuple] = field(default_factory=dict)
    unsigned: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        fields = []
        for part in self.columns.split():
            name, kind = part.rstrip("!").split(":", 1)
            fields.append(T.StructField(name, _TYPES[kind], not part.endswith("!")))
        return T.StructType(fields)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


_ON = {"status": (0, 1)}

TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table("department", "id:string! name:string! status:smallint!", (("name",),), lengths={"id": 64, "name": 128}, enums=_ON),
        Table(
            "user", "id:string! name:string! department_id:string! avatar_url:string height_cm:decimal(5,2) status:smallint!",
            foreign={"department_id": "department"}, lengths={"id": 64, "name": 128, "avatar_url": 500}, enums=_ON, unsigned=("height_cm",),
        ),
        Table(
            "user_suggestion", "id:bigint! user_id:string! content:string! is_visible:smallint! created_at:timestamp_ntz!",
            foreign={"user_id": "user"}, lengths={"user_id": 64}, enums={"is_visible": (0, 1)}, unsigned=("id",),
        ),
        Table("project", "id:bigint! name:string! description:string icon_url:string status:smallint!", (("name",),), lengths={"name": 128, "icon_url": 500}, enums=_ON, unsigned=("id",)),
        Table("project_level", "id:bigint! name:string! reward:bigint! status:smallint!", (("name",),), lengths={"name": 64}, enums=_ON, unsigned=("id", "reward")),
        Table(
            "project_rule", "id:bigint! project_id:bigint! level_id:bigint! sub_desc:string rule_content:string! rule_note:string status:smallint!",
            (("project_id", "level_id"),), {"project_id": "project", "level_id": "project_level"}, {"sub_desc": 255, "rule_note": 500}, _ON, ("id",),
        ),
        Table(
            "project_upload_config", "id:bigint! project_id:bigint! record_type:string! upload_hint:string! note_example:string sort_order:bigint! status:smallint!",
            (("project_id", "record_type"),), {"project_id": "project"}, {"record_type": 64, "upload_hint": 500, "note_example": 500}, _ON, ("id", "sort_order"),
        ),
        Table(
            "season", "id:bigint! name:string! start_date:date! end_date:date! required_project_count:smallint! status:smallint!",
            lengths={"name": 128}, enums={"status": (0, 1, 2)}, unsigned=("id", "required_project_count"),
        ),
        Table(
            "season_user", "id:bigint! season_id:bigint! user_id:string! level_id:bigint participated_at:timestamp_ntz final_points:bigint status:smallint!",
            (("season_id", "user_id"),), {"season_id": "season", "user_id": "user", "level_id": "project_level"}, {"user_id": 64}, unsigned=("id", "final_points", "status"),
        ),
        Table(
            "season_user_project", "id:bigint! season_user_id:bigint! project_id:bigint! completion_progress:decimal(5,4)! status:smallint!",
            (("season_user_id", "project_id"),), {"season_user_id": "season_user", "project_id": "project"}, enums=_ON, unsigned=("id",),
        ),
        Table(
            "proof_record",
            "id:bigint! season_user_id:bigint! project_id:bigint! project_upload_config_id:bigint! image_url:string! note:string proof_date:date! "
            "review_status:string! review_comment:string progress_delta:decimal(5,4)! increase:decimal(5,4)! status:smallint! created_at:timestamp_ntz!",
            foreign={"season_user_id": "season_user", "project_id": "project", "project_upload_config_id": "project_upload_config"},
            lengths={"image_url": 500, "note": 500, "review_status": 32, "review_comment": 500},
            enums={"review_status": ("pending", "preliminary_approved", "preliminary_rejected", "approved", "rejected"), "status": (0, 1)}, unsigned=("id",),
        ),
        Table("leaderboard_snapshot", "id:bigint! season_user_id:bigint! checkin_count:bigint!", (("season_user_id",),), {"season_user_id": "season_user"}, unsigned=("id", "checkin_count")),
        Table(
            "point_record", "id:bigint! user_id:string! product_id:bigint change_type:string! change_points:int! points_after:bigint! description:string status:smallint! created_at:timestamp_ntz!",
            foreign={"user_id": "user", "product_id": "product"}, lengths={"user_id": 64, "change_type": 32, "description": 255},
            enums={"change_type": ("season_reward", "exchange", "manual_adjust"), "status": (0, 1)}, unsigned=("id",),
        ),
        Table("product", "id:bigint! name:string! description:string points_required:bigint! image_url:string status:smallint!", lengths={"name": 128, "image_url": 500}, enums=_ON, unsigned=("id", "points_required")),
    )
}

#: Review states that count towards progress and the leaderboard.
COUNTED = ("preliminary_approved", "approved")


def foreign_keys() -> list[tuple[str, str, str]]:
    """(child table, child column, parent table) of every foreign key."""
    return [(t.name, column, parent) for t in TABLES.values() for column, parent in t.foreign.items()]


def unique_keys() -> list[tuple[str, tuple[str, ...]]]:
    return [(t.name, key) for t in TABLES.values() for key in t.unique]
