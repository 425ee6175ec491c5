"""Fixed values that must equal the reference's for the results to match.

Kept together, as plain text, in their natural order.
"""

# Fixed values ---------------------------------------------------------------
# Area type codes and their labels.
AREAS = ("R", "U")
AREA_LABELS = {"R": "Rural", "U": "Urban"}
# School type codes and their labels.
KINDS = ("GS", "GA", "PS")
KIND_LABELS = {"GS": "Gov School", "GA": "Gov Aided", "PS": "Pvt School"}
# Activity status codes in the log, and the labels of the recoded 0/1 status.
STATUS_DONE = 1
STATUS_NOT_DONE = 2
STATUS_LABELS = {0: "Not done", 1: "Done"}
# Repeat-instrument value that marks log rows in the raw export.
LOG_INSTRUMENT = "implementation_status"
# Access-key check, and the mask applied when a key is shown.
KEY_PATTERN = r"^([0-9A-Fa-f]{32})(?:\n)?$"
MASK_PATTERN = r"(?<=^.{4}).*(?=.{4}$)"
MASK_TEXT = " * * * * "
# Data older than this many hours (strictly) is stale.
STALE_AFTER_HOURS = 24
# Date text formats: day and month, full date, month heading; date with time
# is the full date followed by a 12-hour clock "hh:mm AM/PM".
DAY_MONTH_FORMAT = "dd MMM"
DATE_FORMAT = "dd MMM yyyy"
MONTH_FORMAT = "MMM yyyy"
# Cell texts: share of a count, activity level, monthly cell.
SHARE_TEXT = "%d (%s%%)"
ACTIVITY_TEXT = "%s / %s Participants (%s%%)"
MONTHLY_TEXT = "Entered: %s / Activities: %s / Students: %s"
