"""Fixed values.

These must equal the values the original application uses, otherwise the
results differ. They are stated here once, in their natural order.
"""

# --- Fixed values -----------------------------------------------------------

# Tag slugs that can give a market its category (first allowed tag wins).
ALLOWED_SLUGS = (
    "sports", "politics", "crypto", "technology",
    "esports", "weather", "finance", "pop-culture",
)

# The three semantic market types, in the order the ridgeline reports them.
MARKET_TYPES = ("Stochastic", "Objective Outcome", "Decision-Agent")

# Per-type baseline exogenous term of the one-step forecast, its default,
# and the AR(1) coefficient.
BASELINE_EXOG = {
    "Decision-Agent": 0.1543,
    "Objective Outcome": 0.0836,
    "Stochastic": 0.0020,
}
DEFAULT_BASELINE_EXOG = 0.05
AR_L1 = 0.9633

# Impact coefficients used when the regression is singular.
DEFAULT_YES_IMPACT = 0.000015
DEFAULT_NO_IMPACT = 0.000015

# Lagged trade-count damping of the AR term: 0 trades, at most 2, more.
AR_DAMPING = (0.1, 0.5, 1.0)

# Traded-volume bands (lower inclusive, upper exclusive; last is open).
VOLUME_BANDS = (
    (0, 10, "< $10"),
    (10, 100, "$10 – $100"),
    (100, 1_000, "$100 – $1k"),
    (1_000, 10_000, "$1k – $10k"),
    (10_000, 100_000, "$10k – $100k"),
    (100_000, 1_000_000, "$100k – $1M"),
    (1_000_000, None, "$1M+"),
)

# Ridgeline: grid points on [0, 1], minimum rows per cell, sample cap.
RIDGELINE_GRID = 100
RIDGELINE_MIN_N = 50
RIDGELINE_KDE_SAMPLE = 20000

# Anomaly threshold on the volatility z-score.
ANOMALY_Z = 1.96

# Certainty buckets: decided at or above the first, contested at or above
# the second, coin-flip below.
CERTAINTY_DECIDED = 0.66
CERTAINTY_CONTESTED = 0.33

# Baseline impact shown per label (default for anything else) and its text.
LABEL_IMPACT = {
    "Decision-Agent": ("0.1543", "Volatility is based mostly on previous market momentum."),
    "Objective Outcome": ("0.0836", "Volatility is anchored to predictable external events"),
}
DEFAULT_LABEL_IMPACT = ("0.002", "The market moves randomly regardless of past data.")

# Time-series build: trade tape features and market quality filters.
ROLLING_WINDOW = 10
MIN_PRICE_FLOOR = 0.0001
Z_CLIP = 20.0
MIN_GLOBAL_STD = 0.00001
BIN_SECONDS = 1800
MIN_TRADES = 50
MIN_USD = 5000.0
MIN_PRICE_RANGE = 0.10
MIN_BINS = 24
DEAD_MIDDLE_MIN_BINS = 20
DEAD_MIDDLE_SPAN = (0.20, 0.80)
DEAD_MIDDLE_SHARE = 0.05
FINAL_MIN_BINS = 10
FINAL_MIN_TRADES = 50
MIN_DURATION_DAYS = 1.0

# Chart helpers: points kept when down-sampling, low-liquidity rule.
MAX_CHART_POINTS = 1440
LOW_LIQUIDITY_SHARE = 0.05
LOW_LIQUIDITY_TRADES = 3

# Search result cap and default top-N sizes.
SEARCH_LIMIT = 50
TOP_MARKETS = 10
TOP_WHALES = 10

# Label data: held-out size and seed; low-confidence cut.
TEST_SIZE = 180
RANDOM_SEED = 42
LOW_CONFIDENCE = 0.5
