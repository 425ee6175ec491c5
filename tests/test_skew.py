"""A hot entity holding over a third of the log: exact results, and the plan
reduces it map-side before any exchange."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from conftest import SF_ORACLE
from oracle_compare import _rows, duck
from sitepulse.operators import period_rollup
from sitepulse.plans import params as P
from sitepulse.plans.bindings import bind_events


def _hot_log(log):
    hot = log.agg(F.min("entity_key")).first()[0]
    # every click and view (two fifths of the rows) moves to one entity
    return log.withColumn(
        "entity_key",
        F.when(F.col("brush_activity").isNotNull() & (F.col("seq") % 5 != 0), F.lit(hot)).otherwise(
            F.col("entity_key")
        ),
    ), hot


def test_hot_entity_rollup_is_exact_and_reduced_map_side(spark):
    b = bind_events(spark, SF_ORACLE)
    log, hot = _hot_log(b.log)
    share = log.where(F.col("entity_key") == hot).count() / log.count()
    assert share > 1 / 3
    got = period_rollup(log, b.registry, *P.RANGE, roles=b.roles)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        got.explain()
    plan = buf.getvalue()
    # the partial top-1 runs before the exchange on (entity, day)
    _, found, below = plan.partition("Exchange hashpartitioning(entity_key")
    assert found
    under_exchange = below.split("Exchange")[0]
    assert "WindowGroupLimit" in under_exchange and "Partial" in under_exchange
    con = duck(SF_ORACLE)
    sql = f"""
    WITH log AS (
      SELECT CASE WHEN event_type IN ('purchase', 'click', 'view') AND event_id % 5 <> 0
                  THEN {hot} ELSE user_id END AS entity_key,
             ts, CAST(ts AS DATE) AS day,
             CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 1 WHEN 'view' THEN 0 END AS s,
             CASE WHEN event_type <> 'error' THEN TRY_CAST(value AS DECIMAL(12,2)) END AS p,
             event_id
      FROM events
    ), days AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_key, day
                                                  ORDER BY ts DESC, event_id DESC) rn
                     FROM log WHERE day BETWEEN DATE '{P.RANGE[0]}' AND DATE '{P.RANGE[1]}') WHERE rn = 1
    )
    SELECT c.c_custkey AS entity_key, count(d.day) AS entry,
           coalesce(CAST(sum(d.p) AS DECIMAL(18,2)), 0) AS participants,
           CAST(coalesce(sum(d.s), 0) AS BIGINT) AS activity
    FROM customer c LEFT JOIN days d ON c.c_custkey = d.entity_key
    GROUP BY c.c_custkey
    """
    rel = con.sql(sql)
    want = _rows(rel.columns, rel.fetchall())
    mine = got.select(
        F.regexp_extract("record_id", r"-(\d+)$", 1).cast("long").alias("entity_key"), "entry", "participants", "activity"
    )
    assert _rows(mine.columns, [tuple(r) for r in mine.collect()]) == want


def test_hot_entity_reports_match_brute_force(spark):
    from sitepulse.operators import daily_coverage_long
    from sitepulse.plans import oracle as O
    from sitepulse.plans import reports as R

    b = bind_events(spark, SF_ORACLE)
    log, hot = _hot_log(b.log)
    hot_log_cte = (
        O.EVENTS_LOG.replace("log AS", "log0 AS", 1)
        + f""",
log AS (
  SELECT * REPLACE (CASE WHEN brush_activity IS NOT NULL AND seq % 5 <> 0 THEN {hot} ELSE entity_key END AS entity_key)
  FROM log0
)"""
    )
    con = duck(SF_ORACLE)
    cases = [
        (
            R.daily_series_by_block(log, b.registry, roles=b.roles),
            O.with_(O.REGISTRY, hot_log_cte)
            + """SELECT g.block, l.task_schedule_date AS day, count(*) AS entries
FROM log l LEFT JOIN registry g ON l.entity_key IS NOT DISTINCT FROM g.entity_key
GROUP BY g.block, l.task_schedule_date""",
        ),
        (
            daily_coverage_long(log, b.registry, P.DAY, roles=b.roles),
            O.with_(O.REGISTRY, hot_log_cte, O.coverage_ctes(P.DAY)) + "SELECT * FROM coverage",
        ),
        (
            R.block_summary(log, b.registry, P.AS_OF, roles=b.roles),
            O.with_(O.REGISTRY, hot_log_cte, O.block_summary_cte(P.AS_OF)) + "SELECT * FROM summary",
        ),
    ]
    for df, sql in cases:
        rel = con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())
