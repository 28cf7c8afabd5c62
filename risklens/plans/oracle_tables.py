"""DuckDB SQL for the mapped tables of ``risklens.sources.testdata``.

Each constant is the body of a CTE; ``with_tables(...)`` prefixes a query
with the CTEs it needs (dependencies are added in order).
"""

from __future__ import annotations

from risklens import constants as C
from risklens.functions.expr import sql_list, sql_pick, sql_str
from risklens.sources.testdata import (AGE_TEXT, EDUCATION_TEXT, LOG_START, PRESENTATION,
                                       PRIORITY_RISK, SEGMENTS, VLE_START)

_K = "c.c_custkey"
_M = f"({_K} % 11)"

STUDENT_INFO = f"""
SELECT c.c_mktsegment AS code_module, '{PRESENTATION}' AS code_presentation,
       {_K} AS id_student,
       CASE WHEN {_K} % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
       n.n_name AS region,
       {sql_pick(EDUCATION_TEXT, 'c.c_nationkey % 6')} AS highest_education,
       CASE WHEN {_M} = 10 THEN NULL WHEN {_M} = 0 THEN '0-10%' WHEN {_M} = 1 THEN '10-20'
            ELSE CAST({_M} * 10 - 10 AS VARCHAR) || '-' || CAST({_M} * 10 AS VARCHAR) || '%' END
         AS imd_band,
       {sql_pick(AGE_TEXT, f'{_K} % 3')} AS age_band,
       CAST({_K} % 4 AS INTEGER) AS num_of_prev_attempts,
       CAST(30 * ({_K} % 5 + 1) AS INTEGER) AS studied_credits,
       CASE WHEN {_K} % 7 = 0 THEN 'Y' ELSE 'N' END AS disability,
       CASE WHEN c.c_acctbal < 0 THEN 'Fail' WHEN {_K} % 50 = 0 THEN 'Unknown'
            WHEN c.c_acctbal < 3000 THEN 'Withdrawn' WHEN c.c_acctbal < 8000 THEN 'Pass'
            ELSE 'Distinction' END AS final_result
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""

STUDENT_VLE = f"""
SELECT c.c_mktsegment AS code_module, '{PRESENTATION}' AS code_presentation,
       c.c_custkey AS id_student,
       CAST(date_diff('day', DATE '{VLE_START}', CAST(e.ts AS DATE)) AS INTEGER) AS date,
       CAST(floor(e.value) AS BIGINT) AS sum_click
FROM events e JOIN customer c ON e.user_id = c.c_custkey"""

ASSESSMENTS = f"""
SELECT p_partkey AS id_assessment, {sql_pick(SEGMENTS, 'p_partkey % 5')} AS code_module,
       '{PRESENTATION}' AS code_presentation,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS weight
FROM part"""

STUDENT_ASSESSMENT = """
SELECT l.l_partkey AS id_assessment, o.o_custkey AS id_student,
       CASE WHEN l.l_linenumber = 7 THEN '?' ELSE CAST(l.l_quantity * 2 AS VARCHAR) END AS score
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""

ENGAGEMENT_DAILY = f"""
SELECT CAST(user_id AS VARCHAR) AS student_id,
       CAST(date_diff('day', DATE '{LOG_START}', CAST(ts AS DATE)) AS INTEGER) AS week_number,
       count(*) AS clicks, 1 AS days_active, min(ts) AS logged_at, CAST(0 AS BIGINT) AS seq
FROM events
GROUP BY user_id, date_diff('day', DATE '{LOG_START}', CAST(ts AS DATE))"""

ENGAGEMENT_MONTHLY = """
SELECT CAST(o_custkey AS VARCHAR) AS student_id,
       CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS week_number,
       count(*) AS clicks, CAST(count(DISTINCT dayofmonth(o_orderdate)) AS INTEGER) AS days_active,
       min(o_orderdate) AS logged_at, CAST(0 AS BIGINT) AS seq
FROM orders
GROUP BY o_custkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate)"""


def _factor_sql(shift: int, flip: int) -> tuple[str, str]:
    idx = f"((o_orderkey + {shift}) % {len(C.FEATURES)})"
    name = sql_pick(C.FEATURES, idx)
    low = sql_pick([C.SUGGESTIONS[f][0] for f in C.FEATURES], idx)
    high = sql_pick([C.SUGGESTIONS[f][1] for f in C.FEATURES], idx)
    text = f"({name} || ': ' || CASE WHEN (o_orderkey + {flip}) % 2 = 0 THEN {high} ELSE {low} END)"
    return text, name


_F1, _ = _factor_sql(0, 0)
_F2, _ = _factor_sql(5, 1)
_F3, _F3_NAME = _factor_sql(9, 0)
_RISK = ("CASE substr(o_orderpriority, 1, 1) "
         + " ".join(f"WHEN {sql_str(d)} THEN {sql_str(r)}" for d, r in PRIORITY_RISK.items())
         + f" ELSE {sql_str(C.UNKNOWN)} END")

PREDICTIONS = f"""
SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS student_id,
       o_orderdate AS prediction_date, {_RISK} AS risk_level,
       (o_orderkey % 100) / 100.0 AS confidence_score,
       {_F1} AS top_factor_1, {_F2} AS top_factor_2,
       CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN {_F3_NAME}
            ELSE {_F3} END AS top_factor_3
FROM orders"""

LATEST_PREDICTION = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY prediction_date DESC, id DESC) AS rn
  FROM predictions) WHERE rn = 1"""

STUDENTS = f"""
SELECT CAST(c.c_custkey AS VARCHAR) AS student_id, c.c_name AS name,
       lower(regexp_replace(c.c_name, '[^A-Za-z0-9]', '', 'g')) || '@example.edu' AS email,
       'teacher' || CAST(c.c_nationkey AS VARCHAR) || '@example.edu' AS teacher_email,
       c.c_mktsegment AS course_id,
       COALESCE(lp.risk_level, {sql_str(C.UNKNOWN)}) AS risk_level,
       COALESCE(lp.confidence_score, 0.0) AS confidence_score,
       {sql_str(C.STATUS_STATIC)} AS status,
       COALESCE(lp.prediction_date, TIMESTAMP '{LOG_START} 00:00:00') AS last_updated
FROM customer c LEFT JOIN latest_prediction lp ON CAST(c.c_custkey AS VARCHAR) = lp.student_id"""

LABELLED = f"""
SELECT doc_id, label, prediction,
       {sql_pick(C.LABEL_ORDER, 'label')} AS actual,
       {sql_pick(C.LABEL_ORDER, 'prediction')} AS predicted
FROM (SELECT doc_id, CAST(quality + toxic * 2 AS INTEGER) AS label,
             CAST(CASE WHEN doc_id % 7 = 0 THEN (quality + toxic * 2 + 1) % 4
                       ELSE quality + toxic * 2 END AS INTEGER) AS prediction
      FROM labels)"""

TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "student_info": (STUDENT_INFO, ()),
    "student_vle": (STUDENT_VLE, ()),
    "assessments": (ASSESSMENTS, ()),
    "student_assessment": (STUDENT_ASSESSMENT, ()),
    "engagement_daily": (ENGAGEMENT_DAILY, ()),
    "engagement_monthly": (ENGAGEMENT_MONTHLY, ()),
    "predictions": (PREDICTIONS, ()),
    "latest_prediction": (LATEST_PREDICTION, ("predictions",)),
    "students": (STUDENTS, ("latest_prediction",)),
    "labelled": (LABELLED, ()),
}


def with_tables(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding the named mapped tables (+ dependencies) and
    any extra (name, sql) CTEs, in the given order."""
    ordered: list[str] = []

    def add(n: str) -> None:
        if n in ordered:
            return
        for dep in TABLES[n][1]:
            add(dep)
        ordered.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({TABLES[n][0]}\n)" for n in ordered]
    ctes += [f"{n} AS ({sql}\n)" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" if ctes else ""


__all__ = ["TABLES", "with_tables", "sql_list"]
