"""sitepulse: field-activity reporting as lazy Spark DataFrames.

Two tables drive everything: a *registry* of entities (one row per site,
with a group label and two classification dimensions) and an append-style
*log* of dated entries.  Every public function maps DataFrames to a lazy
DataFrame; nothing is collected in the core.
"""

from sitepulse.schema import Roles, AREAS, KINDS

__all__ = ["Roles", "AREAS", "KINDS"]
