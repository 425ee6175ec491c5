"""Parameters of the registered queries (events cover January 2024)."""

import datetime as dt

DAY = dt.date(2024, 1, 10)
RANGE = (dt.date(2024, 1, 8), dt.date(2024, 1, 14))
MONTH = dt.date(2024, 1, 1)
AS_OF = dt.date(2024, 1, 11)
ORDERS_MONTH = dt.date(1998, 3, 1)
# A range of whole months with two incomplete ones (orders cover 1995 to 2001).
LONG_RANGE = (dt.date(1996, 2, 10), dt.date(1997, 5, 20))
CHANGED_MONTH = (dt.date(1996, 3, 1), dt.date(1996, 3, 31))
ORDERS_DAYS = (dt.date(1996, 2, 20), dt.date(1996, 3, 10))
PAGE = 7
FINE = "0.00001"
FILTER_BLOCKS = ("AMERICA", "ASIA")
FILTER_AREAS = ("U",)
FILTER_KINDS = ("GS", "PS")
NOW = dt.datetime(2024, 1, 31, 0, 0, 0)
FIRST_K = 3
# Numeric ids of the schools picked in the entity reports.
PICKED_IDS = (1, 7, 12, 20)
MISSING_SETTING = "never/written"
LARGE_FACTOR = 1_000_000_000
