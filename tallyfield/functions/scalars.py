"""Column functions of the season rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight targets by body mass index: below 24, 24 to below 28, 28 and more; in kilograms.
BMI_TIERS = ((24, 2), (28, 3), (None, 4))

#: Legal review transitions: (status, action) to status.
TRANSITIONS = {
    ("pending", "preliminary_approve"): "preliminary_approved",
    ("pending", "preliminary_reject"): "preliminary_rejected",
    ("preliminary_approved", "approve"): "approved",
    ("preliminary_approved", "reject"): "rejected",
    ("preliminary_rejected", "approve"): "approved",
    ("preliminary_rejected", "reject"): "rejected",
    ("approved", "reject"): "rejected",
    ("preliminary_approved", "reupload"): "pending",
    ("preliminary_rejected", "reupload"): "pending",
    ("approved", "reupload"): "pending",
    ("rejected", "reupload"): "pending",
    ("pending", "reupload"): "pending",
}


def bmi(weight_kg: Column, height_cm: Column) -> Column:
    """Kilograms by square metres; no result without a height."""
    height = height_cm.cast("double") / 100
    return F.when(height > 0, weight_kg.cast("double") / (height * height))


def bmi_target(index: Column) -> Column:
    """The tier's target in kilograms."""
    tiers = F.when(index < BMI_TIERS[0][0], BMI_TIERS[0][1])
    for high, target in BMI_TIERS[1:]:
        tiers = tiers.when(index.isNotNull() if high is None else index < high, target)
    return tiers


def last_day(end_date: Column, as_of: Column) -> Column:
    return F.least(end_date, as_of)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def next_status(status: Column, action: Column) -> Column:
    """The state after an action, null if the action is not allowed."""
    table = F.create_map(*[F.lit(x) for (a, b), to in TRANSITIONS.items() for x in (f"{a}|{b}", to)])
    return table[F.concat_ws("|", status, action)]


def proof_path(created_at: Column, user_id: Column, proof_id: Column) -> Column:
    return F.format_string("/uploads/proofs/%s/user_%s/proof_%s.jpg", F.date_format(created_at, "yyyy/MM"), user_id, proof_id.cast("string"))


_RULES = "array<struct<label:string,value:string>>"


def rule_entries(content: Column) -> Column:
    """Label and value pairs of a rule's JSON; null where it is not an array."""
    return F.when(F.json_array_length(content).isNotNull(), F.from_json(content, _RULES))


def rule_error(content: Column) -> Column:
    """What is wrong with a rule's JSON, null if nothing: it must be an array of objects with textual label and value."""
    entries = F.from_json(content, "array<map<string,variant>>")
    is_text = lambda e, key: F.schema_of_variant(e[key]) == "STRING"
    good = lambda e: F.coalesce(is_text(e, "label") & is_text(e, "value"), F.lit(False))
    return (
        F.when(content.isNull(), "missing")
        .when(F.json_array_length(content).isNull(), "not an array")
        .when(entries.isNull() | F.exists(entries, lambda e: e.isNull()), "not an array of objects")
        .when(~F.forall(entries, good), "label or value missing or not text")
    )


def rule_lines(content: Column) -> Column:
    """``label：value`` lines for display."""
    return F.transform(rule_entries(content), lambda e: F.concat(e["label"], F.lit("："), e["value"]))


def ci_ai(column: Column) -> Column:
    """Compared without regard to case and accents."""
    return F.collate(column, "UNICODE_CI_AI")


def text_or(column: Column, fallback: str) -> Column:
    return F.coalesce(column, F.lit(fallback))
