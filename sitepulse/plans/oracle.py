"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written directly against the driver's tables -- it shares no code path with
the Spark operators, only the parameters and the role bindings.
"""

from __future__ import annotations

from sitepulse.plans import params as P

NUM_RE = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"


def cells() -> list[tuple[str, str, str]]:
    """The oracle's own cell list: (area, kind, name)."""
    return [
        ("R", "GS", "R_GS"),
        ("U", "GS", "U_GS"),
        ("R", "GA", "R_GA"),
        ("U", "GA", "U_GA"),
        ("R", "PS", "R_PS"),
        ("U", "PS", "U_PS"),
    ]

REGISTRY = """registry AS (
  SELECT c.c_custkey AS entity_key,
         'S' || CAST(n.n_regionkey AS VARCHAR) || '-' || CAST(c.c_custkey AS VARCHAR) AS record_id,
         CAST(n.n_regionkey AS VARCHAR) AS site,
         CASE WHEN c.c_acctbal > 5000 THEN 'U' ELSE 'R' END AS area_type,
         CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'GS' WHEN 'FURNITURE' THEN 'GS'
              WHEN 'BUILDING' THEN 'GA' WHEN 'HOUSEHOLD' THEN 'GA'
              WHEN 'MACHINERY' THEN 'PS' END AS school_type,
         c.c_name AS school,
         r.r_name AS block
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

EVENTS_LOG = """log AS (
  SELECT user_id AS entity_key,
         ts AS task_start_date,
         CAST(ts AS DATE) AS task_schedule_date,
         CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS INTEGER)
           AS brush_activity,
         CASE WHEN event_type <> 'error' THEN TRY_CAST(value AS DECIMAL(28,10)) END AS participants,
         event_id AS seq
  FROM events
)"""

ORDERS_LOG = """log AS (
  SELECT o_custkey AS entity_key,
         o_orderdate AS task_start_date,
         CAST(o_orderdate AS DATE) AS task_schedule_date,
         CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS INTEGER) AS brush_activity,
         TRY_CAST(o_totalprice AS DECIMAL(28,10)) AS participants,
         o_orderkey AS seq
  FROM orders
)"""

NULL_KEYS = """registry AS (
  SELECT * REPLACE (CASE WHEN block = 'ASIA' AND school_type = 'GA' THEN NULL ELSE entity_key END AS entity_key)
  FROM registry0
),
log AS (
  SELECT * REPLACE (CASE WHEN brush_activity IS NULL THEN NULL ELSE entity_key END AS entity_key)
  FROM log0
)"""


def number_text(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '[.]?0+$', '')"


def percent(num: str, den: str) -> str:
    """num/den in percent, half-up to two decimals; whole numbers only."""
    q = f"(({num}) * 20000 + ({den})) // (({den}) * 2)"
    return f"CAST({q} // 100 AS VARCHAR) || '.' || lpad(CAST({q} % 100 AS VARCHAR), 2, '0')"


def site_of(c: str) -> str:
    return f"CASE WHEN strpos({c}, '-') > 0 THEN substr({c}, 1, strpos({c}, '-') - 1) ELSE {c} END"


def rest_of(c: str) -> str:
    return f"CASE WHEN strpos({c}, '-') > 0 THEN substr({c}, strpos({c}, '-') + 1) END"


def num_of(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '{NUM_RE}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def d(x) -> str:
    return f"DATE '{x.isoformat()}'"


def lst(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


STATUS01 = "CASE brush_activity WHEN 1 THEN 1 WHEN 2 THEN 0 END"


def days_cte(lo, hi) -> str:
    return f"""days AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_key, task_schedule_date
                                 ORDER BY task_start_date DESC NULLS LAST, seq ASC NULLS LAST) AS rn
    FROM log WHERE task_schedule_date BETWEEN {d(lo)} AND {d(hi)}
  ) WHERE rn = 1
)"""


def reg_filter(blocks=None, areas=None, kinds=None) -> str:
    conds = ["TRUE"]
    if blocks is not None:
        conds.append(f"g.block IN ({lst(blocks)})")
    if areas is not None:
        conds.append(f"g.area_type IN ({lst(areas)})")
    if kinds is not None:
        conds.append(f"g.school_type IN ({lst(kinds)})")
    return " AND ".join(conds)


ENTITY_COLS = f"""g.record_id, {site_of('g.record_id')} AS site_code, {rest_of('g.record_id')} AS id_code,
         {num_of(rest_of('g.record_id'))} AS id_num, g.school, g.block, g.area_type, g.school_type"""


def rollup_ctes(lo, hi, **filters) -> str:
    return f"""{days_cte(lo, hi)},
totals AS (
  SELECT entity_key, count(*) AS entry,
         sum(participants) AS participants,
         CAST(sum({STATUS01}) AS BIGINT) AS activity
  FROM days GROUP BY entity_key
),
rollup AS (
  SELECT {ENTITY_COLS},
         CAST(coalesce(t.entry, 0) AS BIGINT) AS entry,
         coalesce(t.participants, 0) AS participants,
         CAST(coalesce(t.activity, 0) AS BIGINT) AS activity
  FROM registry g LEFT JOIN totals t ON g.entity_key IS NOT DISTINCT FROM t.entity_key
  WHERE {reg_filter(**filters)}
)"""


def detail_ctes(lo, hi) -> str:
    return f"""{days_cte(lo, hi)},
detail AS (
  SELECT {ENTITY_COLS},
         dd.task_schedule_date, dd.brush_activity AS status_raw,
         coalesce(CASE dd.brush_activity WHEN 1 THEN 1 WHEN 2 THEN 0 END, 0) AS brush_activity,
         coalesce(dd.participants, 0) AS participants
  FROM registry g LEFT JOIN days dd ON g.entity_key IS NOT DISTINCT FROM dd.entity_key
)"""


def coverage_ctes(day) -> str:
    return f"""present AS (
  SELECT DISTINCT entity_key, TRUE AS flag FROM log WHERE task_schedule_date = {d(day)}
),
marked AS (
  SELECT g.*, p.flag FROM registry g LEFT JOIN present p ON g.entity_key IS NOT DISTINCT FROM p.entity_key
),
coverage AS (
  SELECT block, area_type, school_type,
         CAST(count_if(coalesce(flag, FALSE)) AS BIGINT) AS present,
         CAST(count(*) AS BIGINT) AS total,
         CAST(count_if(coalesce(flag, FALSE)) AS BIGINT) / NULLIF(CAST(count(*) AS BIGINT), 0) AS share
  FROM marked GROUP BY block, area_type, school_type
)"""


def cell(a, k) -> str:
    return f"(area_type = '{a}' AND school_type = '{k}')"


LISTED = "area_type IN ('R', 'U') AND school_type IN ('GS', 'GA', 'PS')"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def share(c: str) -> str:
    return f"CAST({c} AS DOUBLE) / NULLIF(CAST(sum({c}) OVER (PARTITION BY block) AS DOUBLE), 0)"


def entry_levels_wide_cte() -> str:
    cs = cells()
    counts = ",\n         ".join(f"CAST(count_if(coalesce({cell(a, k)}, FALSE)) AS BIGINT) AS {n}_entry" for a, k, n in cs)
    shares = ",\n       ".join(f"{share(n + '_entry')} AS {n}_entry_P" for _, _, n in cs)
    names = ", ".join(f"{n}_entry" for _, _, n in cs)
    return f"""lv AS (
  SELECT block, entry,
         {counts}
  FROM rollup WHERE {LISTED} GROUP BY block, entry
),
wide AS (
  SELECT block, entry, {names},
       {shares}
  FROM lv
)"""


def activity_levels_wide_cte() -> str:
    cs = cells()
    aggs = []
    for a, k, n in cs:
        aggs.append(f"CAST(count_if(coalesce({cell(a, k)}, FALSE)) AS BIGINT) AS {n}_activity")
        aggs.append(
            f"coalesce(sum(CASE WHEN {cell(a, k)} THEN participants END), 0) AS {n}_participants"
        )
    cols = []
    for suffix in ("activity", "participants"):
        cols += [f"{n}_{suffix}" for _, _, n in cs]
        cols += [f"{share(f'{n}_{suffix}')} AS {n}_{suffix}_P" for _, _, n in cs]
    sep = ",\n         "
    return f"""lv AS (
  SELECT block, activity,
         {sep.join(aggs)}
  FROM rollup WHERE {LISTED} GROUP BY block, activity
),
wide AS (
  SELECT block, activity,
         {sep.join(cols)}
  FROM lv
)"""


def unpivot(id_cols: str, templates: dict[str, str]) -> str:
    parts = []
    for a, k, n in cells():
        vals = ", ".join(f"{t.format(c=n)} AS {out}" for out, t in templates.items())
        parts.append(f"SELECT {id_cols}, '{a}' AS area_type, '{k}' AS school_type, {vals} FROM wide")
    return "\nUNION ALL\n".join(parts)


def monthly_crosstab_sql() -> str:
    aggs = []
    for m, typ in (("entry", "BIGINT"), ("activity", "BIGINT"), ("participants", "DECIMAL(38,10)")):
        for a, k, n in cells():
            aggs.append(
                f"coalesce(CAST(sum(CASE WHEN {cell(a, k)} THEN {m} END) AS {typ}), CAST(0 AS {typ})) AS {m}_{n}"
            )
    return "SELECT block,\n       " + ",\n       ".join(aggs) + "\nFROM rollup GROUP BY block"


def block_summary_cte(as_of) -> str:
    import datetime as dt

    yday = as_of - dt.timedelta(days=1)
    area_counts = ", ".join(f"CAST(count_if(coalesce(area_type = '{a}', FALSE)) AS BIGINT) AS n_{a}" for a in ("R", "U"))
    kind_counts = ", ".join(f"CAST(count_if(coalesce(school_type = '{k}', FALSE)) AS BIGINT) AS n_{k}" for k in ("GS", "GA", "PS"))
    return f"""per_entity AS (
  SELECT entity_key, count(*) AS entries, sum({STATUS01}) AS activities,
         count_if(({STATUS01}) IS NULL) AS unknown_status
  FROM log WHERE task_schedule_date = {d(yday)} GROUP BY entity_key
),
log_by_block AS (
  SELECT g.block, sum(e.entries) AS entries, sum(e.activities) AS activities,
         sum(e.unknown_status) AS unknown_status
  FROM per_entity e LEFT JOIN registry g ON e.entity_key IS NOT DISTINCT FROM g.entity_key
  GROUP BY g.block
),
reg_counts AS (
  SELECT block, CAST(count(*) AS BIGINT) AS schools, {area_counts}, {kind_counts}
  FROM registry GROUP BY block
),
summary AS (
  SELECT r.block, r.schools, r.n_R, r.n_U, r.n_GS, r.n_GA, r.n_PS,
         CAST(coalesce(l.entries, 0) AS BIGINT) AS entries,
         CAST(coalesce(l.activities, 0) AS BIGINT) AS activities,
         CAST(coalesce(l.unknown_status, 0) AS BIGINT) AS unknown_status
  FROM reg_counts r LEFT JOIN log_by_block l ON r.block IS NOT DISTINCT FROM l.block
)"""


RAW = """raw AS (
  SELECT 'C-' || CAST(entity_key AS VARCHAR) AS record_id, CAST(NULL AS VARCHAR) AS redcap_repeat_instrument, site, area_type, school_type,
         school AS school1, CAST(NULL AS TIMESTAMP) AS task_start_date, CAST(NULL AS DATE) AS task_schedule_date,
         CAST(NULL AS DATE) AS activity_date, CAST(NULL AS INTEGER) AS brush_activity_1_5,
         CAST(NULL AS VARCHAR) AS first_to_fifth_participants, CAST(NULL AS BIGINT) AS redcap_repeat_instance
  FROM registry
  UNION ALL
  SELECT 'C-' || CAST(e.user_id AS VARCHAR), 'implementation_status', NULL, NULL, NULL, NULL, e.ts, CAST(e.ts AS DATE), CAST(e.ts AS DATE),
         CAST(CASE e.event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS INTEGER),
         CASE WHEN e.event_type = 'error' THEN 'n/a' ELSE CAST(e.value AS VARCHAR) END, e.event_id
  FROM events e
),
labels AS (
  SELECT 'C-' || CAST(entity_key AS VARCHAR) AS record_id, block AS block1 FROM registry
  UNION ALL
  SELECT 'C-' || CAST(entity_key AS VARCHAR), CAST(NULL AS VARCHAR) FROM registry WHERE school_type = 'GA'
),
registry_x AS (
  SELECT r.record_id, r.site, r.area_type, r.school_type, r.school1 AS school, l.block1 AS block
  FROM raw r
  LEFT JOIN (SELECT record_id, min(block1) AS block1 FROM labels GROUP BY record_id) l
    ON r.record_id IS NOT DISTINCT FROM l.record_id
  WHERE r.redcap_repeat_instrument IS NULL
)"""

SETTINGS_LATEST = """srows AS (
  SELECT event_type || '/' || CAST(user_id AS VARCHAR) AS name,
         CAST(date_diff('second', TIMESTAMP '1970-01-01 00:00:00', ts) AS VARCHAR) AS value,
         ts AS version, event_id AS seq
  FROM events
),
latest AS (
  SELECT name, value, version FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC, seq DESC, value DESC) AS rn FROM srows
  ) WHERE rn = 1
)"""


def freshness_sql(now) -> str:
    import datetime as dt

    now_s = int((now - dt.datetime(1970, 1, 1)).total_seconds())
    age = f"((CAST({now_s} AS DOUBLE) - v) / CAST(3600 AS DOUBLE))"
    ts = "make_timestamp(CAST(round(v * 1000000) AS BIGINT))"
    return f"""SELECT name, {ts} AS last_update, {age} AS age_hours, round_even({age}, 0) AS age_hours_rounded,
       (v IS NULL OR {age} > 24) AS stale, strftime({ts}, '%d %b %Y %I:%M %p') AS last_update_text
FROM (SELECT name, {num_of('value')} AS v FROM latest UNION ALL SELECT '{P.MISSING_SETTING}', NULL)"""


ROLLUP_OUT = "SELECT * REPLACE (CAST(participants AS DOUBLE) AS participants) FROM rollup"


def doubles(cols) -> str:
    return "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols) + ")"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    ev = [REGISTRY, EVENTS_LOG]
    lo, hi = P.RANGE
    rollup = with_(*ev, rollup_ctes(lo, hi))
    mlo, mhi = P.MONTH, P.MONTH.replace(day=31)
    q["period_rollup"] = rollup + ROLLUP_OUT
    q["period_rollup_filtered"] = (
        with_(*ev, rollup_ctes(lo, hi, blocks=P.FILTER_BLOCKS, areas=P.FILTER_AREAS, kinds=P.FILTER_KINDS))
        + ROLLUP_OUT
    )
    q["month_rollup"] = with_(*ev, rollup_ctes(mlo, mhi)) + ROLLUP_OUT
    olo = P.ORDERS_MONTH
    ohi = (olo.replace(day=28) + __import__("datetime").timedelta(days=4)).replace(day=1) - __import__(
        "datetime"
    ).timedelta(days=1)
    q["month_rollup_orders"] = with_(REGISTRY, ORDERS_LOG, rollup_ctes(olo, ohi)) + ROLLUP_OUT
    q["latest_per_day"] = with_(*ev) + """SELECT * EXCLUDE (rn) REPLACE (CAST(participants AS DOUBLE) AS participants) FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_key, task_schedule_date
                               ORDER BY task_start_date DESC NULLS LAST, seq ASC NULLS LAST) AS rn FROM log
) WHERE rn = 1"""
    detail = with_(*ev, detail_ctes(lo, hi))
    q["entity_detail"] = detail + "SELECT * REPLACE (CAST(participants AS DOUBLE) AS participants) FROM detail"
    q["entity_day_list"] = detail + """SELECT record_id, task_schedule_date,
       strftime(task_schedule_date, '%d %b %Y') AS date_text,
       CASE brush_activity WHEN 0 THEN 'Not done' WHEN 1 THEN 'Done' END AS activity_text
FROM detail"""
    q["entity_kpis"] = detail + """SELECT record_id, count(task_schedule_date) AS entries,
       CAST(coalesce(sum(brush_activity), 0) AS BIGINT) AS activities
FROM detail GROUP BY record_id"""
    cov = with_(*ev, coverage_ctes(P.DAY))
    q["daily_coverage_long"] = cov + "SELECT * FROM coverage"
    q["daily_coverage_mixed_only"] = cov + """SELECT block, area_type, school_type, present, total, share FROM (
  SELECT *, sum(present) OVER (PARTITION BY block) AS bp, sum(total) OVER (PARTITION BY block) AS bt FROM coverage
) WHERE bp > 0 AND bp < bt"""
    wide_cols, any_cell = [], " OR ".join(f"coalesce({cell(a, k)}, FALSE)" for a, k, _ in cells())
    for a, k, n in cells():
        pres = f"CAST(count_if(coalesce({cell(a, k)} AND flag, FALSE)) AS BIGINT)"
        tot = f"CAST(count_if(coalesce({cell(a, k)}, FALSE)) AS BIGINT)"
        wide_cols.append(f"{pres} AS {n}")
        wide_cols.append(f"{pres} / NULLIF({tot}, 0) AS {n}_P")
    tp = f"CAST(count_if(coalesce(({any_cell}) AND flag, FALSE)) AS BIGINT)"
    wide_cols.append(f"{tp} AS total")
    wide_cols.append(f"{tp} / NULLIF(CAST(count_if(coalesce({any_cell}, FALSE)) AS BIGINT), 0) AS total_P")
    q["daily_coverage_wide"] = cov + "SELECT block,\n       " + ",\n       ".join(wide_cols) + "\nFROM marked GROUP BY block"
    q["cell_text"] = cov + """SELECT block, area_type, school_type,
       CASE WHEN total > 0 THEN CAST(present AS VARCHAR) || ' (' || CAST(qq // 100 AS VARCHAR) || '.'
            || lpad(CAST(qq % 100 AS VARCHAR), 2, '0') || '%)' ELSE '0' END AS cell_text
FROM (SELECT *, (present * 20000 + total) // (total * 2) AS qq FROM coverage)"""
    q["entry_levels_wide"] = with_(*ev, rollup_ctes(lo, hi), entry_levels_wide_cte()) + "SELECT * FROM wide"
    q["entry_levels_long"] = with_(*ev, rollup_ctes(lo, hi), entry_levels_wide_cte()) + unpivot(
        "block, entry", {"n": "{c}_entry", "share": "{c}_entry_P"}
    )
    q["activity_levels_wide"] = (
        with_(*ev, rollup_ctes(lo, hi), activity_levels_wide_cte())
        + doubles(f"{n}_participants" for _, _, n in cells())
        + " FROM wide"
    )
    q["activity_levels_long"] = with_(*ev, rollup_ctes(lo, hi), activity_levels_wide_cte()) + unpivot(
        "block, activity",
        {
            "n": "{c}_activity",
            "share": "{c}_activity_P",
            "participants": "CAST({c}_participants AS DOUBLE)",
            "participants_share": "{c}_participants_P",
        },
    )
    q["no_activity_list"] = rollup + "SELECT record_id, id_num, block, school, entry FROM rollup WHERE activity = 0"
    q["has_entries_list"] = (
        rollup + "SELECT record_id, id_num, block, school, activity, entry FROM rollup WHERE entry <> 0"
    )
    q["monthly_crosstab"] = (
        with_(*ev, rollup_ctes(mlo, mhi), "ct AS (" + monthly_crosstab_sql() + ")")
        + doubles(f"participants_{n}" for _, _, n in cells())
        + " FROM ct"
    )
    summary = with_(*ev, block_summary_cte(P.AS_OF))
    q["block_summary"] = summary + "SELECT * FROM summary"
    q["summary_totals"] = summary + "SELECT " + ", ".join(
        f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}"
        for c in ("schools", "n_R", "n_U", "n_GS", "n_GA", "n_PS", "entries", "activities", "unknown_status")
    ) + " FROM summary"
    q["first_blocks"] = summary + f"SELECT * FROM summary ORDER BY block NULLS LAST LIMIT {P.FIRST_K}"
    q["daily_series"] = with_(*ev) + "SELECT task_schedule_date AS day, count(*) AS entries FROM log GROUP BY 1"
    q["daily_series_by_block"] = with_(*ev) + """SELECT g.block, l.task_schedule_date AS day, count(*) AS entries
FROM log l LEFT JOIN registry g ON l.entity_key IS NOT DISTINCT FROM g.entity_key
GROUP BY g.block, l.task_schedule_date"""
    q["first_blocks_series"] = with_(*ev) + f"""SELECT g.block, l.task_schedule_date AS day, count(*) AS entries
FROM log l LEFT JOIN registry g ON l.entity_key IS NOT DISTINCT FROM g.entity_key
WHERE g.block IN (SELECT block FROM (SELECT DISTINCT block FROM registry) ORDER BY block NULLS LAST LIMIT {P.FIRST_K})
GROUP BY g.block, l.task_schedule_date"""
    q["filter_blocks"] = with_(REGISTRY) + "SELECT DISTINCT block FROM registry"
    q["block_words"] = with_(REGISTRY) + (
        "SELECT DISTINCT block, string_split(block, ' ')[1] AS first_word, string_split(block, ' ')[-1] AS last_word"
        " FROM registry"
    )
    q["school_options"] = with_(REGISTRY) + (
        f"SELECT block, school, record_id, {rest_of('record_id')} AS id_code FROM registry g "
        f"WHERE {reg_filter(blocks=P.FILTER_BLOCKS)}"
    )
    raw = with_(REGISTRY, RAW)
    q["registry_extract"] = raw + "SELECT * FROM registry_x"
    q["log_extract"] = raw + f"""SELECT record_id, task_start_date, task_schedule_date, activity_date,
       brush_activity_1_5 AS brush_activity, {num_of('first_to_fifth_participants')} AS participants,
       redcap_repeat_instance AS seq
FROM raw WHERE redcap_repeat_instrument = 'implementation_status'"""
    q["code_labels"] = raw + """SELECT record_id, block, area_type,
       CASE area_type WHEN 'R' THEN 'Rural' WHEN 'U' THEN 'Urban' END AS area_label,
       school_type,
       CASE school_type WHEN 'GS' THEN 'Gov School' WHEN 'GA' THEN 'Gov Aided' WHEN 'PS' THEN 'Pvt School' END
         AS school_label
FROM registry_x"""
    q["settings_latest"] = with_(SETTINGS_LATEST) + "SELECT * FROM latest"
    q["freshness"] = with_(SETTINGS_LATEST) + freshness_sql(P.NOW)
    q["masked_keys"] = """WITH keys AS (
  SELECT event_id,
         CASE WHEN event_type = 'error' THEN substr(md5(CAST(event_id AS VARCHAR)), 1, 31)
              WHEN event_type = 'signup' THEN 'g' || substr(md5(CAST(event_id AS VARCHAR)), 2, 31)
              ELSE md5(CAST(event_id AS VARCHAR)) END AS key
  FROM events
)
SELECT event_id, key, coalesce(regexp_full_match(key, '[0-9A-Fa-f]{32}\\n?'), FALSE) AS valid,
       CASE WHEN length(key) >= 8 THEN substr(key, 1, 4) || ' * * * * ' || substr(key, length(key) - 3)
            ELSE key END AS masked
FROM keys"""
    q["key_split"] = f"""WITH k AS (
  SELECT c_custkey,
         CASE c_mktsegment
           WHEN 'MACHINERY' THEN c_name
           WHEN 'BUILDING' THEN 'S' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(c_custkey AS VARCHAR) || '-x'
           WHEN 'HOUSEHOLD' THEN 'S' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(c_custkey AS VARCHAR) || 'd'
           WHEN 'FURNITURE' THEN 'S' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(c_custkey AS VARCHAR)
                                 || CASE WHEN c_acctbal > 5000 THEN 'x5' ELSE 'f' END
           ELSE 'S' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(c_custkey AS VARCHAR) END AS key
  FROM customer
)
SELECT c_custkey, key, {site_of('key')} AS site_code, {rest_of('key')} AS id_code, {num_of(rest_of('key'))} AS id_num
FROM k"""
    q["null_safe_registry_join"] = (
        with_(
            REGISTRY.replace("registry AS", "registry0 AS", 1),
            EVENTS_LOG.replace("log AS", "log0 AS", 1),
            NULL_KEYS,
            rollup_ctes(lo, hi),
        )
        + ROLLUP_OUT
    )
    q["repeat_flags"] = with_(*ev) + """SELECT seq, entity_key, task_schedule_date,
       row_number() OVER (PARTITION BY entity_key, task_schedule_date
                          ORDER BY task_start_date DESC NULLS LAST, seq ASC NULLS LAST) > 1 AS dup
FROM log"""
    q["daily_series_deduped"] = with_(*ev) + """SELECT task_schedule_date AS day, count(*) AS entries FROM (
  SELECT DISTINCT entity_key, task_schedule_date FROM log
) GROUP BY 1"""
    texts = ",\n       ".join(
        f"'Entered: ' || CAST(entry_{n} AS VARCHAR) || ' / Activities: ' || CAST(activity_{n} AS VARCHAR)"
        f" || ' / Students: ' || {number_text(f'participants_{n}')} AS {n}"
        for _, _, n in cells()
    )
    q["monthly_cell_text"] = (
        with_(*ev, rollup_ctes(mlo, mhi), "ct AS (" + monthly_crosstab_sql() + ")")
        + f"SELECT block,\n       {texts}\nFROM ct"
    )
    picked = ", ".join(str(i) for i in P.PICKED_IDS)
    chosen = detail + "SELECT {} FROM detail WHERE id_num IN (" + picked + ")"
    q["entity_detail_selected"] = chosen.format("* REPLACE (CAST(participants AS DOUBLE) AS participants)")
    q["entity_day_list_selected"] = chosen.format(
        "record_id, task_schedule_date, strftime(task_schedule_date, '%d %b %Y') AS date_text,"
        " CASE brush_activity WHEN 0 THEN 'Not done' WHEN 1 THEN 'Done' END AS activity_text"
    )
    q["entity_kpis_selected"] = (
        chosen.format(
            "record_id, count(task_schedule_date) AS entries,"
            " CAST(coalesce(sum(brush_activity), 0) AS BIGINT) AS activities"
        )
        + " GROUP BY record_id"
    )
    q["latest_per_day_ties"] = q["latest_per_day"].replace(EVENTS_LOG, ORDERS_LOG)
    large = EVENTS_LOG.replace(
        "TRY_CAST(value AS DECIMAL(28,10))",
        f"CAST(TRY_CAST(value AS DECIMAL(28,10)) * CAST({P.LARGE_FACTOR} AS DECIMAL(10,0)) AS DECIMAL(28,10))",
    )
    q["period_rollup_large"] = with_(REGISTRY, large, rollup_ctes(lo, hi)) + ROLLUP_OUT
    odd = [
        REGISTRY.replace("registry AS", "registry0 AS", 1),
        EVENTS_LOG.replace("log AS", "log0 AS", 1),
        AWKWARD,
    ]
    odd_rollup = rollup_ctes(lo, hi)
    q["awkward_rollup"] = with_(*odd, odd_rollup) + ROLLUP_OUT
    q["awkward_entry_levels"] = with_(*odd, odd_rollup, entry_levels_wide_cte()) + "SELECT * FROM wide"
    q["awkward_activity_levels"] = (
        with_(*odd, odd_rollup, activity_levels_wide_cte())
        + doubles(f"{n}_participants" for _, _, n in cells())
        + " FROM wide"
    )
    for name, plain in (
        ("awkward_coverage_wide", "daily_coverage_wide"),
        ("awkward_coverage_mixed", "daily_coverage_mixed_only"),
        ("awkward_block_summary", "block_summary"),
        ("awkward_series_by_block", "daily_series_by_block"),
    ):
        q[name] = q[plain].replace(",\n".join(ev), ",\n".join(odd))
        assert q[name] != q[plain], name
    cell_key = "PARTITION BY block, area_type, school_type"
    q["entry_cell_text"] = f"""SELECT block, entry, area_type, school_type,
       CASE WHEN den > 0 THEN CAST(n AS VARCHAR) || ' (' || {percent('n', 'den')} || '%)' ELSE '0' END AS cell_text
FROM (SELECT *, CAST(sum(n) OVER ({cell_key}) AS BIGINT) AS den FROM ({q["entry_levels_long"]}))"""
    # two decimals at most in the measures: whole numbers of hundredths
    q["activity_cell_text"] = f"""SELECT block, activity, area_type, school_type,
       CASE WHEN den > 0 THEN CAST(n AS VARCHAR) || ' (' || {percent('n', 'den')} || '%)' ELSE '0' END
         || ' / ' || {number_text('p')} || ' Participants ('
         || CASE WHEN pden > 0 THEN {percent('pnum', 'pden')} ELSE '0' END || '%)' AS cell_text
FROM (
  SELECT *, CAST(sum(n) OVER ({cell_key}) AS BIGINT) AS den, CAST(p * 100 AS HUGEINT) AS pnum,
         CAST(sum(p) OVER ({cell_key}) * 100 AS HUGEINT) AS pden
  FROM ({q["activity_levels_long"]})
)"""
    q["activity_cell_text"] = q["activity_cell_text"].replace("AS DOUBLE) AS participants", "AS DECIMAL(28,10)) AS p")
    fine = EVENTS_LOG.replace(
        "TRY_CAST(value AS DECIMAL(28,10))",
        f"CAST(TRY_CAST(value AS DECIMAL(28,10)) * CAST({P.FINE} AS DECIMAL(6,5)) AS DECIMAL(28,10))",
    )
    q["activity_cell_text_fine"] = q["activity_cell_text"].replace(EVENTS_LOG, fine).replace("* 100 AS HUGEINT", "* 10000000 AS HUGEINT")
    q["presence_over_range"] = with_(*ev) + f"""SELECT block, count(*) AS any_day, count(*) FILTER (days = {(hi - lo).days + 1}) AS every_day
FROM (
  SELECT g.block, l.entity_key, count(DISTINCT l.task_schedule_date) AS days
  FROM log l JOIN registry g ON l.entity_key IS NOT DISTINCT FROM g.entity_key
  WHERE l.task_schedule_date BETWEEN {d(lo)} AND {d(hi)} GROUP BY g.block, l.entity_key
) GROUP BY block"""
    q["presence_by_day"] = with_(*ev) + f"""SELECT g.block, l.task_schedule_date AS day, count(DISTINCT l.entity_key) AS present
FROM log l JOIN registry g ON l.entity_key IS NOT DISTINCT FROM g.entity_key
WHERE l.task_schedule_date BETWEEN {d(lo)} AND {d(hi)} GROUP BY 1, 2"""
    q["school_pages"] = with_(REGISTRY) + f"""SELECT block, page, count(*) AS n,
       array_to_string(list(school || '=' || record_id ORDER BY place), ',') AS listed
FROM (
  SELECT *, (place - 1) // {P.PAGE} + 1 AS page
  FROM (SELECT block, school, record_id, row_number() OVER (PARTITION BY block ORDER BY school, record_id) AS place FROM registry)
) GROUP BY block, page"""
    dlo, dhi = P.ORDERS_DAYS
    grid = f"(SELECT CAST(unnest(generate_series({d(dlo)}, {d(dhi)}, INTERVAL 1 DAY)) AS DATE) AS day)"
    q["daily_series_dense"] = with_(REGISTRY, ORDERS_LOG) + f"""SELECT day, count(l.seq) AS entries
FROM {grid} LEFT JOIN log l ON l.task_schedule_date = day GROUP BY day"""
    q["daily_series_dense_by_block"] = with_(REGISTRY, ORDERS_LOG) + f"""SELECT b.block, day, count(l.seq) AS entries
FROM (SELECT DISTINCT block FROM registry) b CROSS JOIN {grid}
LEFT JOIN (SELECT log.*, g.block FROM log LEFT JOIN registry g ON log.entity_key IS NOT DISTINCT FROM g.entity_key) l
  ON l.task_schedule_date = day AND l.block IS NOT DISTINCT FROM b.block
GROUP BY b.block, day"""
    kept = REGISTRY.replace("registry AS", "registry0 AS", 1) + """,
registry AS (SELECT * REPLACE ('C-' || CAST(entity_key AS VARCHAR) AS record_id) FROM registry0)"""
    q["stored_rollup"] = with_(kept, ORDERS_LOG, rollup_ctes(*P.LONG_RANGE)) + ROLLUP_OUT
    none = "log AS (SELECT * FROM log0 WHERE FALSE)"
    q["empty_store_rollup"] = (
        with_(kept, ORDERS_LOG.replace("log AS", "log0 AS", 1), none, rollup_ctes(*P.LONG_RANGE)) + ROLLUP_OUT
    )
    q["stored_monthly_crosstab"] = (
        with_(kept, ORDERS_LOG, rollup_ctes(olo, ohi), "ct AS (" + monthly_crosstab_sql() + ")")
        + doubles(f"participants_{n}" for _, _, n in cells())
        + " FROM ct"
    )
    q["stored_log"] = with_(REGISTRY, ORDERS_LOG) + """SELECT 'C-' || CAST(entity_key AS VARCHAR) AS record_id, task_start_date, task_schedule_date,
       task_schedule_date AS activity_date, brush_activity, CAST(participants AS DOUBLE) AS participants, seq,
       CAST(date_trunc('month', task_schedule_date) AS DATE) AS day_month
FROM log"""
    q["stored_registry"] = raw + "SELECT * FROM registry_x"
    clo, chi = P.CHANGED_MONTH
    q["changed_months"] = with_(ORDERS_LOG) + f"""SELECT CAST(date_trunc('month', task_schedule_date) AS DATE) AS day_month,
       count(*) AS rows, coalesce(bool_or(task_schedule_date BETWEEN {d(clo)} AND {d(chi)}), FALSE) AS written
FROM log GROUP BY 1"""
    q["refresh_counts"] = with_(REGISTRY, ORDERS_LOG) + """SELECT kind, stored, with_text, coded, seen_rows, seen_rejected, seen_registry, seen_log
FROM (
  SELECT 'registry' AS kind, count(*) AS stored, 0 AS with_text, 0 AS coded FROM registry
  UNION ALL
  SELECT 'log', count(*), count(*) FILTER (brush_activity IS NULL), count(brush_activity) FROM log
) CROSS JOIN (
  SELECT (SELECT count(*) FROM log) + (SELECT count(*) FROM registry) AS seen_rows,
         (SELECT count(*) FROM log WHERE brush_activity IS NULL) AS seen_rejected,
         (SELECT count(*) FROM registry) AS seen_registry, (SELECT count(*) FROM log) AS seen_log
)"""
    q["stored_unknown_fields"] = """SELECT o_orderpriority AS priority, CAST(date_trunc('month', o_orderdate) AS DATE) AS day_month,
       count(*) AS n, count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice IS NOT NULL) AS weighed,
       max(o_totalprice) FILTER (o_orderstatus <> 'P') AS heaviest
FROM orders GROUP BY 1, 2"""
    q["export_round_trip"] = q["block_summary"]
    q["repeat_flags_source_order"] = """SELECT o_custkey AS entity_key, CAST(o_orderdate AS DATE) AS task_schedule_date,
       o_orderkey AS order_key,
       row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) > 1 AS dup
FROM orders"""
    q["series_headings"] = with_(*ev) + """SELECT day, strftime(day, '%d %b') AS day_text,
       strftime(day, '%b %Y') AS month_text, entries
FROM (SELECT task_schedule_date AS day, count(*) AS entries FROM log GROUP BY 1)"""
    return q


AWKWARD = f"""log AS (
  SELECT entity_key,
         CASE WHEN brush_activity IS NOT NULL THEN task_start_date END AS task_start_date,
         CASE WHEN participants IS NOT NULL THEN task_schedule_date END AS task_schedule_date,
         brush_activity, participants, seq
  FROM (
    SELECT l.* FROM log0 l
    WHERE NOT (coalesce(l.task_schedule_date = {d(P.DAY)}, FALSE)
               AND l.entity_key IN (SELECT entity_key FROM registry0 WHERE block = 'AFRICA'))
    UNION ALL
    SELECT entity_key, CAST({d(P.DAY)} AS TIMESTAMP), {d(P.DAY)}, 1, 1, -1 FROM registry0 WHERE block = 'EUROPE'
  )
),
registry AS (
  SELECT entity_key, record_id, site,
         CASE WHEN block = 'ASIA' AND area_type = 'R' AND school_type = 'GS' THEN NULL ELSE area_type END AS area_type,
         CASE WHEN block = 'AMERICA' AND school_type = 'PS' THEN 'XX' ELSE school_type END AS school_type,
         school, CASE WHEN block = 'MIDDLE EAST' THEN NULL ELSE block END AS block
  FROM registry0
  WHERE NOT (block = 'ASIA' AND area_type = 'R' AND school_type = 'PS')
    AND NOT (block = 'AFRICA' AND area_type = 'U' AND school_type = 'PS')
)"""


ORACLE = build()
