"""Results are only right with exactly these numbers and names."""

from __future__ import annotations

# Monthly activity of each category, January to December, and its share of the load.
CATEGORY_ACTIVITY = {
    "rice": [0.10, 0.20, 0.70, 0.90, 1.00, 0.45, 0.30, 0.35, 0.70, 0.80, 0.25, 0.10],
    "pepper": [0.15, 0.35, 1.00, 0.95, 0.55, 0.45, 0.55, 0.75, 0.75, 0.35, 0.15, 0.10],
    "soybean": [0.05, 0.10, 0.20, 0.30, 0.60, 0.90, 0.45, 0.35, 0.45, 0.80, 0.65, 0.10],
    "garlic": [0.20, 0.25, 0.35, 0.45, 0.75, 0.85, 0.25, 0.20, 0.50, 0.95, 0.90, 0.25],
    "onion": [0.15, 0.20, 0.45, 0.65, 0.90, 0.85, 0.25, 0.20, 0.75, 0.95, 0.45, 0.15],
}
CATEGORY_SHARE = {"rice": 0.30, "pepper": 0.25, "soybean": 0.15, "garlic": 0.15, "onion": 0.15}

# Weight per weekday, Monday first.
WEEKDAY_WEIGHT = [1.0, 1.0, 1.0, 1.0, 1.0, 0.7, 0.4]

# Fixed values: (from hour, before hour, weight); hours in no band take the default.
HOUR_BANDS = [(6, 9, 0.90), (9, 12, 0.60), (12, 14, 0.30), (14, 18, 0.55), (18, 21, 0.85)]
HOUR_DEFAULT = 0.10

# The same per service, the first matching band wins.
SERVICE_HOUR_BANDS = {
    "auth": ([(7, 10, 1.35), (18, 22, 1.25), (10, 18, 0.75)], 0.25),
    "payment": ([(9, 12, 1.25), (13, 17, 1.35), (18, 21, 0.85)], 0.20),
    "batch": ([(1, 5, 1.70), (22, 24, 0.95), (0, 1, 0.95)], 0.18),
    "admin": ([(9, 18, 1.10)], 0.08),
    "limit_scoring": ([(9, 12, 1.25), (14, 18, 1.15), (19, 21, 0.65)], 0.15),
}

# Services in generation order and in report order.
SERVICES = ["auth", "payment", "batch", "admin", "limit_scoring"]
REPORT_ORDER = ["payment", "auth", "limit_scoring", "batch", "admin"]

# Demand and load constants per service.
SERVICE_BASE = {"auth": 75.0, "payment": 95.0, "batch": 55.0, "admin": 22.0, "limit_scoring": 80.0}
SERVICE_SEASON_STRENGTH = {"auth": 0.35, "payment": 0.95, "batch": 0.55, "admin": 0.15, "limit_scoring": 0.80}
QUEUE_FACTOR = {"auth": 0.01, "payment": 0.04, "batch": 1.20, "admin": 0.00, "limit_scoring": 0.22}
CPU_FACTOR = {"auth": 0.42, "payment": 0.50, "batch": 0.72, "admin": 0.30, "limit_scoring": 0.68}
DB_FACTOR = {"auth": 0.07, "payment": 0.34, "batch": 0.52, "admin": 0.05, "limit_scoring": 0.38}
LATENCY_FACTOR = {"auth": 0.75, "payment": 1.20, "batch": 2.10, "admin": 0.65, "limit_scoring": 1.55}

# The policy of a single series.
POD_CAPACITY, POD_MARGIN, POD_LEAST, POD_MOST = 21.1, 0.2, 1, 8

# Weather effects on service demand, and the load formulas.
MONSOON_DEMAND, STORM_DEMAND, STORM_FROM = 1.08, 0.85, 0.8
CPU_IDLE, CPU_PER_QUEUED, CPU_MOST = 12.0, 0.03, 100
LATENCY_IDLE, LATENCY_PER_QUEUED, LATENCY_LEAST = 60.0, 0.35, 20
ERROR_BASE, ERROR_SLOPE, ERROR_MOST = 0.001, 0.025, 0.10
CONNECTIONS_MOST = 100

# Base and ceiling of the two single-series demand columns.
REQUEST_RATE_BASE, REQUEST_RATE_MAX = 100.0, 500.0
CPU_BASE, CPU_MAX = 50.0, 100.0

# Storm index by days from landfall.
STORM_PROFILE = [(-1, 0.1), (0, 0.9), (1, 0.7), (2, 0.3), (3, 0.1)]

# Yearly windows (name, first day, last day, multiplier, low, high); the last day ends at 23:00.
YEARLY_EVENTS = [
    ("spring_purchase_spike", (3, 10), (3, 20), 1.4, None, None),
    ("post_typhoon_recovery_spike", (9, 2), (9, 4), 1.5, None, None),
    ("monsoon_volatility", (7, 5), (7, 15), None, 0.5, 1.5),
]
MONSOON_FIRST, MONSOON_LAST = (6, 25), (7, 25)

# Months of the purchase season and of the sign-up season.
PURCHASE_MONTHS = [3, 4, 5, 9, 10, 11]
SIGNUP_MONTHS = [3, 4, 5, 9, 10]
QUARTER_END_MONTHS = [3, 6, 9, 12]

# Cyclic encodings (column, prefix, period, first value).
CYCLES = [("hour", "hour", 24, 0), ("day_of_week", "dow", 7, 0), ("month", "month", 12, 1)]
STATIC_FEATURES = ["is_monsoon", "typhoon_index"]
CYCLIC_FEATURES = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]
MODEL_FEATURES = STATIC_FEATURES + CYCLIC_FEATURES
PEAK_HOURS = [8, 9, 10, 18, 19, 20]
WEEKEND_DAYS = [5, 6]
RECIPE_REGRESSORS = ["is_monsoon", "typhoon_index", "is_peak_hour", "is_weekend", "monsoon_typhoon"]

# Default service policies
# (capacity per pod, safety margin, min pods, max pods, priority, node pool, pods per node).
SERVICE_POLICIES = {
    "payment": (25.0, 0.25, 3, 12, 1, "onprem-critical", 18),
    "auth": (35.0, 0.20, 2, 8, 2, "onprem-critical", 18),
    "limit_scoring": (15.0, 0.25, 2, 9, 2, "onprem-compute", 14),
    "batch": (18.0, 0.15, 1, 7, 4, "onprem-batch", 16),
    "admin": (40.0, 0.10, 1, 3, 5, "onprem-general", 20),
}
POD_BUDGET = 26

# Models compared by default, the tuned counterparts, and the selection rule text.
MODEL_NAMES = ["prophet", "sarima", "gru", "lstm", "gru_tuned", "lstm_tuned"]
TUNED_PAIRS = [("GRU", "Baseline", "gru"), ("GRU", "Tuned", "gru_tuned"), ("LSTM", "Baseline", "lstm"), ("LSTM", "Tuned", "lstm_tuned")]
SELECTION_RULE = (
    "Lowest under_provisioning_rate, then lowest smape, highest pod_accuracy, lowest over_provisioning_rate."
)
