"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or what Spark derives from them)
whole; date ranges / days / months are report parameters, not sampling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepulse.functions.sqlexpr import ident
from sitepulse.operators.coverage import daily_coverage_long, daily_coverage_wide, presence_bitmaps, presence_over_range
from sitepulse.operators.crosstab import activity_levels_wide, monthly_crosstab
from sitepulse.operators.dedupe import flag_repeats, latest_per_day
from sitepulse.operators.rollup import entity_detail, month_rollup, period_rollup
from sitepulse.plans import params as P
from sitepulse.plans import reports as R
from sitepulse.plans.bindings import bind_events, bind_orders
from sitepulse.plans import stored, synth
from sitepulse.sources import ingest, settings

Query = Callable[[SparkSession, str], DataFrame]


def _rollup(spark, sf_dir, **kw) -> DataFrame:
    b = bind_events(spark, sf_dir)
    return period_rollup(b.log, b.registry, *P.RANGE, roles=b.roles, **kw)


def _monthly(spark, sf_dir) -> DataFrame:
    b = bind_events(spark, sf_dir)
    return month_rollup(b.log, b.registry, P.MONTH, roles=b.roles)


def _detail(spark, sf_dir) -> DataFrame:
    b = bind_events(spark, sf_dir)
    return entity_detail(b.log, b.registry, *P.RANGE, roles=b.roles)


def _summary(spark, sf_dir) -> DataFrame:
    b = bind_events(spark, sf_dir)
    return R.block_summary(b.log, b.registry, P.AS_OF, roles=b.roles)


def _coverage(spark, sf_dir, **kw) -> DataFrame:
    b = bind_events(spark, sf_dir)
    return daily_coverage_long(b.log, b.registry, P.DAY, roles=b.roles, **kw)


def q_period_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir)


def q_period_rollup_filtered(spark, sf_dir):
    return _rollup(spark, sf_dir, blocks=P.FILTER_BLOCKS, areas=P.FILTER_AREAS, kinds=P.FILTER_KINDS)


def q_month_rollup(spark, sf_dir):
    return _monthly(spark, sf_dir)


def q_month_rollup_orders(spark, sf_dir):
    b = bind_orders(spark, sf_dir)
    return month_rollup(b.log, b.registry, P.ORDERS_MONTH, roles=b.roles)


def q_latest_per_day(spark, sf_dir):
    b = bind_events(spark, sf_dir)
    return latest_per_day(b.log, b.roles)


def q_entity_detail(spark, sf_dir):
    return _detail(spark, sf_dir)


def q_entity_day_list(spark, sf_dir):
    return R.entity_day_list(_detail(spark, sf_dir))


def q_entity_kpis(spark, sf_dir):
    return R.entity_kpis(_detail(spark, sf_dir))


def q_daily_coverage_long(spark, sf_dir):
    return _coverage(spark, sf_dir)


def q_daily_coverage_mixed_only(spark, sf_dir):
    return _coverage(spark, sf_dir, only_mixed=True)


def q_daily_coverage_wide(spark, sf_dir):
    b = bind_events(spark, sf_dir)
    return daily_coverage_wide(b.log, b.registry, P.DAY, roles=b.roles)


def q_entry_levels_long(spark, sf_dir):
    return R.entry_levels_long(_rollup(spark, sf_dir))


def q_entry_levels_wide(spark, sf_dir):
    return R.entry_levels_wide(_rollup(spark, sf_dir))


def q_activity_levels_long(spark, sf_dir):
    return R.activity_levels_long(_rollup(spark, sf_dir))


def q_activity_levels_wide(spark, sf_dir):
    return activity_levels_wide(_rollup(spark, sf_dir))


def q_no_activity_list(spark, sf_dir):
    return R.no_activity_list(_rollup(spark, sf_dir))


def q_has_entries_list(spark, sf_dir):
    return R.has_entries_list(_rollup(spark, sf_dir))


def q_monthly_crosstab(spark, sf_dir):
    return monthly_crosstab(_monthly(spark, sf_dir))


def q_block_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


def q_summary_totals(spark, sf_dir):
    return R.summary_totals(_summary(spark, sf_dir))


def q_first_blocks(spark, sf_dir):
    return R.first_blocks(_summary(spark, sf_dir), P.FIRST_K)


def q_daily_series(spark, sf_dir):
    b = bind_events(spark, sf_dir)
    return R.daily_series(b.log, b.roles)


def q_daily_series_by_block(spark, sf_dir):
    b = bind_events(spark, sf_dir)
    return R.daily_series_by_block(b.log, b.registry, roles=b.roles)


def q_first_blocks_series(spark, sf_dir):
    b = bind_events(spark, sf_dir)
    return R.first_blocks_series(b.log, b.registry, k=P.FIRST_K, roles=b.roles)


def q_filter_blocks(spark, sf_dir):
    b = bind_events(spark, sf_dir)
    return R.filter_blocks(b.registry, b.roles)


def q_block_words(spark, sf_dir):
    b = bind_events(spark, sf_dir)
    return R.block_words(b.registry, b.roles)


def q_school_options(spark, sf_dir):
    b = bind_events(spark, sf_dir)
    return R.school_options(b.registry, blocks=P.FILTER_BLOCKS, roles=b.roles)


def q_registry_extract(spark, sf_dir):
    raw, labels = synth.raw_export(spark, sf_dir), synth.label_export(spark, sf_dir)
    return ingest.extract_registry(raw, labels)


def q_log_extract(spark, sf_dir):
    return ingest.extract_log(synth.raw_export(spark, sf_dir))


def q_code_labels(spark, sf_dir):
    raw, labels = synth.raw_export(spark, sf_dir), synth.label_export(spark, sf_dir)
    return ingest.label_codes(ingest.extract_registry(raw, labels))


def q_settings_latest(spark, sf_dir):
    return settings.latest(synth.settings_rows(spark, sf_dir))


def q_freshness(spark, sf_dir):
    latest = settings.latest(synth.settings_rows(spark, sf_dir))
    return settings.freshness(latest, P.NOW, names=[P.MISSING_SETTING])


def q_masked_keys(spark, sf_dir):
    keys = synth.access_keys(spark, sf_dir)
    return settings.check_keys(keys, "key")


def q_key_split(spark, sf_dir):
    return synth.key_split(spark, sf_dir)


def q_null_safe_registry_join(spark, sf_dir):
    b = bind_events(spark, sf_dir)
    reg, log = synth.with_null_keys(b.registry, b.log)
    return period_rollup(log, reg, *P.RANGE, roles=b.roles)


def q_repeat_flags(spark, sf_dir):
    b = bind_events(spark, sf_dir)
    return flag_repeats(b.log, b.roles).select("seq", "entity_key", "task_schedule_date", "dup")


def q_daily_series_deduped(spark, sf_dir):
    b = bind_events(spark, sf_dir)
    return R.daily_series(b.log, b.roles, dedupe=True)


def q_monthly_cell_text(spark, sf_dir):
    return R.monthly_cell_text(monthly_crosstab(_monthly(spark, sf_dir)))


def q_cell_text(spark, sf_dir):
    return R.coverage_cell_text(_coverage(spark, sf_dir))


def _picked(spark, sf_dir) -> DataFrame:
    b = bind_events(spark, sf_dir)
    return entity_detail(b.log, b.registry, *P.RANGE, ids=P.PICKED_IDS, roles=b.roles)


def q_entity_detail_selected(spark, sf_dir):
    return _picked(spark, sf_dir)


def q_entity_day_list_selected(spark, sf_dir):
    return R.entity_day_list(_picked(spark, sf_dir))


def q_entity_kpis_selected(spark, sf_dir):
    """By full key: every school of the picked ids, whatever its region."""
    b = bind_events(spark, sf_dir)
    keys = [f"S{region}-{i}" for region in range(5) for i in P.PICKED_IDS]
    return R.entity_kpis(entity_detail(b.log, b.registry, *P.RANGE, record_ids=keys, roles=b.roles))


def q_latest_per_day_ties(spark, sf_dir):
    """Orders carry a date only, so every order of a customer and day ties."""
    b = bind_orders(spark, sf_dir)
    return latest_per_day(b.log, b.roles)


def q_period_rollup_large(spark, sf_dir):
    """Measures far above 1e10 stay in every sum."""
    b = bind_events(spark, sf_dir)
    kind = b.log.schema["participants"].dataType.simpleString()
    log = b.log.withColumn(
        "participants", F.expr(f"CAST(participants * CAST({P.LARGE_FACTOR} AS DECIMAL(10, 0)) AS {kind})")
    )
    return period_rollup(log, b.registry, *P.RANGE, roles=b.roles)


def _awkward(spark, sf_dir):
    b = bind_events(spark, sf_dir)
    reg, log = synth.awkward(spark, b.registry, b.log)
    return reg, log, b.roles


def q_awkward_rollup(spark, sf_dir):
    reg, log, roles = _awkward(spark, sf_dir)
    return period_rollup(log, reg, *P.RANGE, roles=roles)


def q_awkward_entry_levels(spark, sf_dir):
    return R.entry_levels_wide(q_awkward_rollup(spark, sf_dir))


def q_awkward_activity_levels(spark, sf_dir):
    return activity_levels_wide(q_awkward_rollup(spark, sf_dir))


def q_awkward_coverage_wide(spark, sf_dir):
    reg, log, roles = _awkward(spark, sf_dir)
    return daily_coverage_wide(log, reg, P.DAY, roles=roles)


def q_awkward_coverage_mixed(spark, sf_dir):
    reg, log, roles = _awkward(spark, sf_dir)
    return daily_coverage_long(log, reg, P.DAY, roles=roles, only_mixed=True)


def q_awkward_block_summary(spark, sf_dir):
    reg, log, roles = _awkward(spark, sf_dir)
    return R.block_summary(log, reg, P.AS_OF, roles=roles)


def q_awkward_series_by_block(spark, sf_dir):
    reg, log, roles = _awkward(spark, sf_dir)
    return R.daily_series_by_block(log, reg, roles=roles)


def q_entry_cell_text(spark, sf_dir):
    return R.entry_cell_text(q_entry_levels_long(spark, sf_dir))


def q_activity_cell_text(spark, sf_dir):
    return R.activity_cell_text(q_activity_levels_long(spark, sf_dir))


def q_series_headings(spark, sf_dir):
    return R.series_headings(q_daily_series(spark, sf_dir))


def q_activity_cell_text_fine(spark, sf_dir):
    """Measures with seven places: the shares' texts are of the exact sums."""
    b = bind_events(spark, sf_dir)
    kind = b.log.schema["participants"].dataType.simpleString()
    log = b.log.withColumn("participants", F.expr(f"CAST(participants * CAST({P.FINE} AS DECIMAL(6, 5)) AS {kind})"))
    rollup = period_rollup(log, b.registry, *P.RANGE, roles=b.roles)
    return R.activity_cell_text(R.activity_levels_long(rollup))


def q_presence_over_range(spark, sf_dir):
    b = bind_events(spark, sf_dir)
    return presence_over_range(presence_bitmaps(b.log, b.registry, *P.RANGE, roles=b.roles), *P.RANGE)


def q_presence_by_day(spark, sf_dir):
    """Exact distinct counts per block and day from the same bitmaps."""
    b = bind_events(spark, sf_dir)
    bitmaps = presence_bitmaps(b.log, b.registry, *P.RANGE, roles=b.roles)
    return bitmaps.groupBy("block", "day").agg(F.sum(F.bitmap_count("bits")).alias("present"))


def q_school_pages(spark, sf_dir):
    """Each page as its number of schools and one text."""
    b = bind_events(spark, sf_dir)
    pages = R.school_pages(b.registry, P.PAGE, roles=b.roles)
    names = F.transform("schools", lambda s: F.concat_ws("=", s["school"], s["record_id"]))
    return pages.select("block", "page", F.size("schools").cast("long").alias("n"), F.array_join(names, ",").alias("listed"))


def q_daily_series_dense(spark, sf_dir):
    b = bind_orders(spark, sf_dir)
    return R.dense_days(R.daily_series(b.log, b.roles), *P.ORDERS_DAYS)


def q_daily_series_dense_by_block(spark, sf_dir):
    b = bind_orders(spark, sf_dir)
    series = R.daily_series_by_block(b.log, b.registry, roles=b.roles)
    return R.dense_days(series, *P.ORDERS_DAYS, R.filter_blocks(b.registry, b.roles))


def _double_outputs(fn: Query) -> Query:
    """Registered results carry decimals as DOUBLE.

    Sums stay exact DECIMAL inside the operators (so they do not depend on
    summation order); only the published column is converted, and a
    decimal-to-double conversion is the same correctly rounded value on
    every engine and in every client library.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        dec = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
        if not dec:
            return df
        return df.withColumns({c: F.expr(f"CAST({ident(c)} AS DOUBLE)") for c in dec})

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Query] = {
    name[2:]: _double_outputs(fn) for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
} | {name: _double_outputs(fn) for name, fn in stored.QUERIES.items()}

FLAGSHIP = "period_rollup"
