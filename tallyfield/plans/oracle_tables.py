"""The domain tables as DuckDB SQL over the star schema, for comparison."""

from __future__ import annotations

_PROOF_RAW = """
    SELECT event_id + 1 AS id, user_id + 1 AS season_user_id, CAST(1 + (user_id + event_id % 3) % 6 AS BIGINT) AS project_id,
           CAST(CASE WHEN (user_id + event_id % 3) % 6 = 5 AND event_id % 2 = 1 THEN 7 ELSE 1 + (user_id + event_id % 3) % 6 END AS BIGINT) AS project_upload_config_id,
           '/uploads/proofs/' || event_id || '.jpg' AS image_url, props AS note, CAST(ts AS DATE) AS proof_date,
           CASE WHEN event_id % 10 <= 1 THEN 'pending' WHEN event_id % 10 <= 5 THEN 'preliminary_approved' WHEN event_id % 10 = 6 THEN 'preliminary_rejected'
                WHEN event_id % 10 <= 8 THEN 'approved' ELSE 'rejected' END AS review_status,
           CAST(NULL AS VARCHAR) AS review_comment,
           CAST(CASE WHEN event_id % 10 IN (0, 1, 6) OR ((user_id + event_id % 3) % 6 = 5 AND event_id % 2 = 0) THEN 0
                     ELSE (event_id * 37 % 3000) * 0.0001 END AS DECIMAL(5,4)) AS progress_delta,
           CAST(CASE WHEN row_number() OVER (PARTITION BY user_id, event_id % 3, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1 THEN 1 ELSE 0 END AS SMALLINT) AS status,
           ts AS created_at
    FROM events"""

COUNTED = "status = 1 AND review_status IN ('preliminary_approved', 'approved')"

TABLES: dict[str, str] = {
    "department": "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(CASE WHEN n_nationkey % 13 = 12 THEN 0 ELSE 1 END AS SMALLINT) AS status FROM nation",
    "user": """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS department_id, CAST(NULL AS VARCHAR) AS avatar_url,
        CAST(CASE WHEN c_custkey % 11 <> 0 THEN 150 + c_custkey % 50 END AS DECIMAL(5,2)) AS height_cm,
        CAST(CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 1 END AS SMALLINT) AS status FROM customer""",
    "product": """SELECT p_partkey + 1 AS id, p_name AS name, p_type AS description, CAST(20 + p_size AS BIGINT) AS points_required, CAST(NULL AS VARCHAR) AS image_url,
        CAST(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS SMALLINT) AS status FROM part""",
    "season": """SELECT CAST(i AS BIGINT) AS id, n AS name, CAST(a AS DATE) AS start_date, CAST(b AS DATE) AS end_date, CAST(3 AS SMALLINT) AS required_project_count,
        CAST(s AS SMALLINT) AS status FROM (VALUES (1, '2023-12', '2023-12-01', '2023-12-31', 2), (2, '2024-01', '2024-01-01', '2024-01-31', 1), (3, '2024-02', '2024-02-01', '2024-02-29', 0)) AS v(i, n, a, b, s)""",
    "project": """SELECT CAST(i AS BIGINT) AS id, n AS name, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS icon_url, CAST(1 AS SMALLINT) AS status
        FROM (VALUES (1, 'daily steps'), (2, 'running'), (3, 'cycling'), (4, 'swimming'), (5, 'strength'), (6, 'weight control')) AS v(i, n)""",
    "project_level": "SELECT CAST(i AS BIGINT) AS id, n AS name, CAST(100 * i AS BIGINT) AS reward, CAST(1 AS SMALLINT) AS status FROM (VALUES (1, 'bronze'), (2, 'silver'), (3, 'gold')) AS v(i, n)",
    "project_upload_config": """SELECT CAST(i AS BIGINT) AS id, CAST(p AS BIGINT) AS project_id, k AS record_type, 'upload ' || k AS upload_hint, CAST(NULL AS VARCHAR) AS note_example,
        CAST(o AS BIGINT) AS sort_order, CAST(1 AS SMALLINT) AS status
        FROM (VALUES (1, 1, 'ordinary', 0), (2, 2, 'ordinary', 0), (3, 3, 'ordinary', 0), (4, 4, 'ordinary', 0), (5, 5, 'ordinary', 0), (6, 6, 'month-start', 10), (7, 6, 'month-end', 20)) AS v(i, p, k, o)""",
    "project_rule": """SELECT CAST((p - 1) * 3 + n AS BIGINT) AS id, CAST(p AS BIGINT) AS project_id, CAST(n AS BIGINT) AS level_id, CAST(NULL AS VARCHAR) AS sub_desc,
        '[{"label":"target","value":"' || (1000 * p) || ' per day"},{"label":"days","value":"' || (10 * n) || ' in total"}]' AS rule_content,
        CAST(NULL AS VARCHAR) AS rule_note, CAST(1 AS SMALLINT) AS status FROM range(1, 7) AS a(p), range(1, 4) AS b(n)""",
    "season_user": """SELECT user_id + 1 AS id, CAST(2 AS BIGINT) AS season_id, CAST(user_id AS VARCHAR) AS user_id,
        CAST(CASE WHEN user_id % 7 <> 0 THEN 1 + user_id % 3 END AS BIGINT) AS level_id,
        CASE WHEN user_id % 7 <> 0 AND user_id % 14 <> 1 THEN TIMESTAMP '2024-01-01 00:00:00' END AS participated_at,
        CAST(NULL AS BIGINT) AS final_points, CAST(3 AS SMALLINT) AS status FROM (SELECT DISTINCT user_id FROM events)""",
    "proof_raw": _PROOF_RAW,
    "proof_record": f"""SELECT id, season_user_id, project_id, project_upload_config_id, image_url, note, proof_date, review_status, review_comment, progress_delta,
        CAST(CASE WHEN {COUNTED} THEN greatest(0, least(progress_delta, 1 - coalesce(sum(CASE WHEN {COUNTED} THEN progress_delta ELSE 0 END) OVER (
            PARTITION BY season_user_id, project_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END AS DECIMAL(5,4)) AS increase,
        status, created_at FROM proof_raw""",
    "progress": f"SELECT season_user_id, project_id, CAST(sum(increase) AS DECIMAL(5,4)) AS completion_progress FROM proof_record WHERE {COUNTED} GROUP BY ALL",
    "season_user_project": """SELECT u.user_id * 3 + k + 1 AS id, u.user_id + 1 AS season_user_id, 1 + (u.user_id + k) % 6 AS project_id,
        CAST(coalesce(p.completion_progress, 0) AS DECIMAL(5,4)) AS completion_progress, CAST(1 AS SMALLINT) AS status
        FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(3) AS r(k)
        LEFT JOIN progress p ON p.season_user_id = u.user_id + 1 AND p.project_id = 1 + (u.user_id + k) % 6""",
    "point_record": """SELECT id, user_id, product_id, change_type, change_points,
        CAST(sum(CASE WHEN status = 1 THEN change_points ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS points_after,
        description, status, created_at FROM (
        SELECT o_orderkey + 1 AS id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(CASE WHEN o_orderkey % 3 = 1 THEN 1 + o_orderkey % 200 END AS BIGINT) AS product_id,
        CASE o_orderkey % 3 WHEN 0 THEN 'season_reward' WHEN 1 THEN 'exchange' ELSE 'manual_adjust' END AS change_type,
        CAST(CASE o_orderkey % 3 WHEN 0 THEN 100 * (1 + o_orderkey % 2) WHEN 1 THEN -(20 + o_orderkey % 30) ELSE o_orderkey % 21 - 10 END AS INTEGER) AS change_points,
        CAST(NULL AS VARCHAR) AS description, CAST(CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 1 END AS SMALLINT) AS status, o_orderdate AS created_at FROM orders)""",
    "user_suggestion": """SELECT doc_id + 1 AS id, CAST(doc_id % 150 AS VARCHAR) AS user_id, coalesce(text, '') AS content,
        CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS SMALLINT) AS is_visible, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at FROM documents""",
    "checkins": f"""SELECT season_user_id, CAST(count_if(project_upload_config_id NOT IN (6, 7)) + least(1, count_if(project_upload_config_id = 7)) AS BIGINT) AS checkin_count
        FROM proof_record WHERE {COUNTED} GROUP BY season_user_id HAVING count_if(project_upload_config_id <> 6) > 0""",
    "leaderboard_snapshot": "SELECT season_user_id AS id, season_user_id, checkin_count FROM checkins",
    "balance": "SELECT user_id, CAST(sum(change_points) AS BIGINT) AS balance FROM point_record WHERE status = 1 GROUP BY user_id",
    "facts": """SELECT su.id AS season_user_id, CAST(coalesce(n_projects, 0) AS BIGINT) AS n_projects, CAST(coalesce(n_completed, 0) AS BIGINT) AS n_completed,
        CAST(coalesce(n_open, 0) AS BIGINT) AS n_open, min_progress FROM season_user su
        LEFT JOIN (SELECT season_user_id, count(*) AS n_projects, count_if(completion_progress >= 1) AS n_completed, min(completion_progress) AS min_progress
                   FROM season_user_project WHERE status = 1 GROUP BY season_user_id) p ON p.season_user_id = su.id
        LEFT JOIN (SELECT season_user_id, count_if(review_status IN ('pending', 'preliminary_approved')) AS n_open FROM proof_record WHERE status = 1 GROUP BY season_user_id) o ON o.season_user_id = su.id""",
}

_NEEDS = {
    "proof_record": ("proof_raw",), "progress": ("proof_record",), "season_user_project": ("progress",), "checkins": ("proof_record",),
    "leaderboard_snapshot": ("checkins",), "balance": ("point_record",), "facts": ("season_user", "season_user_project", "proof_record"),
}


def over(*tables: str, select: str, **more: str) -> str:
    """A query over domain tables (with what they need) and further named selects, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in tables:
        add(name)
    parts = [f'"{n}" AS ({TABLES[n]})' for n in order] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return f"WITH {', '.join(parts)} {select}"


def refilled(source: str) -> str:
    """The closed form of the ordered refill over a named select."""
    counted = COUNTED
    return f"""SELECT * EXCLUDE (increase, head, space, earlier), CAST(increase + greatest(0, least(head, space - coalesce(earlier, 0))) AS DECIMAL(5,4)) AS increase FROM (
        SELECT *, sum(head) OVER (PARTITION BY season_user_id, project_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM (
        SELECT *, CASE WHEN {counted} THEN progress_delta - increase ELSE 0 END AS head,
               1 - sum(CASE WHEN {counted} THEN increase ELSE 0 END) OVER (PARTITION BY season_user_id, project_id) AS space FROM {source}))"""


def allocated(source: str) -> str:
    """Fresh proofs of a named select (column fresh) take what the stored increases leave."""
    counted = COUNTED
    return f"""SELECT * EXCLUDE (increase, used, earlier, fresh),
        CAST(CASE WHEN fresh AND {counted} THEN greatest(0, least(progress_delta, 1 - used - coalesce(earlier, 0))) ELSE increase END AS DECIMAL(5,4)) AS increase FROM (
        SELECT *, sum(CASE WHEN {counted} AND NOT fresh THEN increase ELSE 0 END) OVER (PARTITION BY season_user_id, project_id) AS used,
               sum(CASE WHEN {counted} AND fresh THEN progress_delta ELSE 0 END) OVER (PARTITION BY season_user_id, project_id ORDER BY created_at, id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM {source})"""
