"""Quoting for generated SQL expression strings.

Wide crosstabs generate one aggregate per (cell, measure); writing each as a
single ``F.expr`` string keeps plan construction to one call per output
column instead of a dozen Column round trips.
"""

from __future__ import annotations


def lit(v) -> str:
    """A SQL string literal (single quotes and backslashes escaped by a backslash)."""
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def in_cell(area: str, kind: str, area_col: str = "area_type", kind_col: str = "school_type") -> str:
    return f"({ident(area_col)} = {lit(area)} AND {ident(kind_col)} = {lit(kind)})"
