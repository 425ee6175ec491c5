from sitepulse.operators.dedupe import flag_repeats, latest_per, latest_per_day  # noqa: F401
from sitepulse.operators.rollup import (  # noqa: F401
    entity_detail,
    filtered_registry,
    month_rollup,
    period_rollup,
)
from sitepulse.operators.crosstab import (  # noqa: F401
    activity_levels_wide,
    level_counts_wide,
    monthly_crosstab,
    wide_to_long,
)
from sitepulse.operators.coverage import daily_coverage_long, daily_coverage_wide  # noqa: F401
