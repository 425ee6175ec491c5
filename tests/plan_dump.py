"""Write PLANS.md: physical plans of key queries as a large cluster plans them.

    python tests/plan_dump.py [sf_dir]

Broadcast of anything but the fixed-size dimensions is switched off (as when
the registry and log are large) and AQE is off, so the static exchanges are
visible; at run time AQE may still turn small joins into broadcasts.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

QUERIES = [
    "period_rollup",
    "latest_per_day",
    "repeat_flags",
    "daily_coverage_wide",
    "activity_levels_wide",
    "block_summary",
    "daily_series_by_block",
]


def _scan(line: str) -> str:
    head = line[: line.index("FileScan")]
    cols = re.search(r"FileScan parquet (\[[^\]]*\])", line)
    loc = re.search(r"\[file:[^\]]*/([^/\]]+)\]", line)
    pushed = re.search(r"PushedFilters: (\[[^\]]*\])", line)
    parts = re.search(r"PartitionFilters: (\[[^\]]*\])", line)
    out = f"{head}FileScan {loc.group(1) if loc else ''} {cols.group(1) if cols else ''}"
    if pushed and pushed.group(1) != "[]":
        out += f" PushedFilters: {pushed.group(1)}"
    if parts and parts.group(1) != "[]":
        out += f" PartitionFilters: {parts.group(1)}"
    return out


def trim(line: str) -> str:
    if "FileScan parquet" in line:
        return _scan(re.sub(r"#\d+L?", "", line))
    line = re.sub(r"#\d+L?", "", line)
    line = re.sub(r"\[plan_id=\d+\]", "", line)
    line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[([^\]]*)\]", lambda m: "file " + os.path.basename(m.group(1)), line)
    return line if len(line) <= 170 else line[:167] + "..."


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "200")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    # keep only the fixed-size dimensions (nation: 25 rows, region: 5) under the threshold
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(16 * 1024))
    out = [
        "# Physical plans (generated by `tests/plan_dump.py`)",
        "",
        "Static plans with AQE off and the broadcast threshold lowered to 16 KB, so only",
        "the fixed-size dimensions (nation, region) broadcast, as on a cluster where",
        "the registry and log are large. Expression lists are trimmed. Read each",
        "plan bottom-up: scans (with `PushedFilters`), then exchanges, then joins.",
        "",
    ]
    for name in QUERIES:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            E.queries()[name](spark, sf_dir).explain()
        body = [trim(l) for l in buf.getvalue().splitlines() if l.strip() and not l.startswith("==")]
        exchanges = sum("Exchange hashpartitioning" in l for l in body)
        out += [f"## {name}", "", f"shuffle exchanges: {exchanges}", "", "```", *body, "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
