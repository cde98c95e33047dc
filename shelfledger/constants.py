"""Fixed business values.  All of them are defaults of function parameters."""

from datetime import date, datetime

# Tax id -> factor that turns a net price into a tax-inclusive one.
# Any other tax id means a factor of 1.0.
TAX_NEUTRAL_IDS = (5, 2)
TAX_VAT_IDS = (7, 6)
TAX_VAT_FACTOR = 1.11

# Reference text of a cancelled document.
CANCELLED_REF = "/"

# Local zone of the stores.
LOCAL_ZONE = "Asia/Jakarta"

# Opening stock and opening costs.
LEDGER_BASELINE_LOCAL = datetime(2025, 2, 10, 7, 0, 0)
LEDGER_CUTOFF_HOUR = 7
LEDGER_LOCATION_POOL = (44, 8, 154, 155, 156, 53, 157, 158)
OPENING_COST_DATE = date(2025, 2, 10)
COST_WARNING_LIMIT = 10_000_000

# Stock and ABC thresholds.
ABC_A_SHARE = 0.2
ABC_B_SHARE = 0.5
STOCK_LOOKBACK_DAYS = 30
LOW_STOCK_DAYS = 7
SUMMARY_LOW_STOCK_DAYS = 14
# Folder day of raw records whose own day cannot be read; it does not depend on the call.
UNKNOWN_DAY = date(1970, 1, 1)
NO_SALES_COVER = 999999
REORDER_TARGET_DAYS = 30
REORDER_ALERT_DAYS = 14
OVERSTOCK_DAYS = 90

# Opening hours shown in hourly reports.
FIRST_HOUR = 7
LAST_HOUR = 23

# Fallback labels.
UNKNOWN = "Unknown"
UNKNOWN_CATEGORY = "Unknown Category"
UNKNOWN_BRAND = "Unknown Brand"

# Principal names that mean "no principal" (compared as written).
NO_PRINCIPAL_NAMES = (
    "Unknown Principal", "unknown principal", "", "-", "None", "null", "NULL",
)
