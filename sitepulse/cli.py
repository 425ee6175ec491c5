"""Command line: ``python -m sitepulse.cli refresh|report ...`` (spark-submit friendly).

refresh  landed raw + label exports -> a new published snapshot (R19)
report   one named report over the current snapshot -> csv / parquet (S12)

The session comes from ``SparkSession.builder.getOrCreate()``, so cluster
settings (master, shuffle partitions, spark.checkpoint.dir, ...) are the
submitter's.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepulse.operators import (
    daily_coverage_long,
    daily_coverage_wide,
    entity_detail,
    month_rollup,
    monthly_crosstab,
    period_rollup,
)
from sitepulse.operators.crosstab import activity_levels_wide
from sitepulse.plans import reports as R
from sitepulse.sources import ingest, settings


def _list(v: str | None):
    return None if v is None else [x for x in v.split(",")]


def _double(rollup: DataFrame) -> DataFrame:
    """Exact decimal sums are exported as the stored measure's type."""
    return rollup.withColumn("participants", F.col("participants").cast("double"))


def _date(v: str | None):
    return None if v is None else dt.date.fromisoformat(v)


def build_report(
    name: str, reg: DataFrame, log: DataFrame, a: argparse.Namespace, totals: DataFrame | None = None
) -> DataFrame:
    """A named report; rollups take whole months from the stored ``totals`` where given."""
    roles = ingest.SNAPSHOT_ROLES
    flt = {"blocks": _list(a.blocks), "areas": _list(a.areas), "kinds": _list(a.kinds)}

    def rollup():
        return _double(period_rollup(log, reg, _date(a.lo), _date(a.hi), roles=roles, totals=totals, **flt))

    def monthly():
        return _double(month_rollup(log, reg, _date(a.month), roles=roles, totals=totals, **flt))

    def detail():
        picked = {"record_ids": _list(a.record_ids), "ids": _list(a.ids)}
        return entity_detail(log, reg, _date(a.lo), _date(a.hi), roles=roles, **picked, **flt)

    def summary():
        return R.block_summary(log, reg, _date(a.as_of), roles=roles)

    reports = {
        "period_rollup": rollup,
        "month_rollup": monthly,
        "entity_detail": detail,
        "entity_day_list": lambda: R.entity_day_list(detail()),
        "entity_kpis": lambda: R.entity_kpis(detail()),
        "daily_coverage_long": lambda: daily_coverage_long(
            log, reg, _date(a.day), roles=roles, only_mixed=a.only_mixed, **flt
        ),
        "daily_coverage_wide": lambda: daily_coverage_wide(
            log, reg, _date(a.day), roles=roles, only_mixed=a.only_mixed, **flt
        ),
        "entry_levels_wide": lambda: R.entry_levels_wide(rollup(), flt["areas"], flt["kinds"]),
        "entry_levels_long": lambda: R.entry_levels_long(rollup(), flt["areas"], flt["kinds"]),
        "activity_levels_wide": lambda: activity_levels_wide(rollup(), flt["areas"], flt["kinds"]),
        "activity_levels_long": lambda: R.activity_levels_long(rollup(), flt["areas"], flt["kinds"]),
        "no_activity_list": lambda: R.no_activity_list(rollup()),
        "has_entries_list": lambda: R.has_entries_list(rollup()),
        "monthly_crosstab": lambda: monthly_crosstab(monthly(), flt["areas"], flt["kinds"]),
        "block_summary": summary,
        "summary_totals": lambda: R.summary_totals(summary()),
        "first_blocks": lambda: R.first_blocks(summary(), a.k),
        "daily_series": lambda: R.daily_series(log, roles),
        "daily_series_by_block": lambda: R.daily_series_by_block(log, reg, roles=roles, blocks=flt["blocks"]),
        "first_blocks_series": lambda: R.first_blocks_series(log, reg, k=a.k, roles=roles),
        "filter_blocks": lambda: R.filter_blocks(reg, roles),
        "school_options": lambda: R.school_options(reg, roles=roles, **flt),
    }
    if name not in reports:
        raise SystemExit(f"unknown report {name!r}; one of: {', '.join(sorted(reports))}")
    return reports[name]()


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="sitepulse")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("refresh", help="publish a new snapshot from landed exports")
    r.add_argument("--raw", required=True)
    r.add_argument("--labels", required=True)
    r.add_argument("--root", required=True)
    r.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    r.add_argument("--if-stale", action="store_true", help="only if the last refresh is missing or too old")
    r.add_argument("--keep-unknown", action="store_true", help="keep fields outside the schema (parquet, csv)")
    t = sub.add_parser("retire", help="remove versions older than the grace period")
    t.add_argument("--root", required=True)
    t.add_argument("--hours", type=float, required=True)
    f = sub.add_parser("freshness", help="print the age of the current snapshot")
    f.add_argument("--root", required=True)
    q = sub.add_parser("report", help="write one report over the current snapshot")
    q.add_argument("name")
    q.add_argument("--root", required=True)
    q.add_argument("--out", required=True)
    q.add_argument("--format", default="csv", choices=["csv", "parquet"])
    for opt in ("lo", "hi", "day", "month", "as-of", "blocks", "areas", "kinds", "record-ids", "ids"):
        q.add_argument(f"--{opt}")
    q.add_argument("--only-mixed", action="store_true")
    q.add_argument("--sorted", action="store_true", help="write rows in display order (a global sort)")
    q.add_argument("-k", type=int, default=3)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"sitepulse-{a.cmd}").getOrCreate()
    if a.cmd == "refresh":
        job = ingest.refresh_if_stale if a.if_stale else ingest.refresh
        print(job(spark, a.raw, a.labels, a.root, fmt=a.format, keep_unknown=a.keep_unknown) or "up to date")
        return
    if a.cmd == "retire":
        before = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(hours=a.hours)
        print("\n".join(ingest.retire(spark, a.root, before)))
        return
    if a.cmd == "freshness":
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        rows = settings.read(spark, f"{a.root}/settings").where("name = 'last_update'")
        row = settings.freshness(rows, now, names=["last_update"]).first()
        print(f"{row['last_update_text'] or 'never'} stale={row['stale']}")
        return
    reg, log = ingest.read_snapshot(spark, a.root)
    df = build_report(a.name, reg, log, a, ingest.read_totals(spark, a.root))
    if a.sorted:
        df = R.sorted_for_display(a.name, df)
    ingest.export_table(df, a.out, a.format)


if __name__ == "__main__":
    main()
