"""They must equal the published model for results to match."""

# --- scoring -----------------------------------------------------------------
DECAY_PER_DAY = 0.1
TOP_K_STORIES = 3
SATURATION_K = 25.0
LOG_K = 2.0
SHARE_K = 25.0
SHARE_PER = 100.0
SCANNED_SHARE_K = 0.05
MAX_EVENT_WEIGHT = 5.0
LOOKBACK_DAYS = 180
STORY_SIMILARITY = 0.60
STORY_WINDOW_DAYS = 3
FORMULA_CHANGED_ON = "2026-09-26 00:00:00"
DEFAULT_BASELINE_RISK = 0.1

# --- ingestion ---------------------------------------------------------------
SLICE_MINUTES = 15
PUBLICATION_LAG_MINUTES = 90
DEFAULT_LAST_MINUTES = 1440
MIN_SLICE_COVERAGE = 0.5
SLICE_COLUMNS = 27
TITLE_LIMIT = 500
ACTOR_LIMIT = 200
FEED_LIMIT = 50
SOURCE_SEARCH = "gdelt"
SOURCE_BULK = "gdelt_gkg"
STATUS_OK = "ok"
STATUS_EMPTY = "empty"
STATUS_THROTTLED = "throttled"
STATUS_ERROR = "error"
STATUS_NOT_ATTEMPTED = "not_attempted"
FAILED_STATUSES = (STATUS_THROTTLED, STATUS_ERROR)
SANCTIONS_NULL = "-0-"

# Corridor names that settle the place by themselves, in priority order.
CORRIDOR_TERMS = {
    "Hormuz": ("strait of hormuz", "hormuz"),
    "Red Sea": ("red sea", "bab-el-mandeb", "bab el-mandeb", "mandeb", "suez canal", "gulf of aden"),
    "Cape": ("cape of good hope", "cape route"),
}
# Names that only hint at a corridor.
CORRIDOR_HINT_TERMS = {
    "Red Sea": ("houthi", "bab al-mandab", "yanbu", "jeddah", "hodeidah", "mocha", "perim", "eritrea", "djibouti"),
}
TOPIC_TERMS = (
    "oil", "crude", "tanker", "opec", "petroleum", "refinery", "refining",
    "shipping", "vessel", "cargo", "freight", "lng", "sanction", "embargo",
    "blockade", "aramco", "barrel", "export", "import", "pipeline", "port",
    "closed", "closure", "close", "reopen", "reopening", "shut", "transit",
    "traffic", "convoy", "escort", "strait", "chokepoint", "disruption",
    "deployment", "strike", "attack", "missile", "drone", "naval", "navy",
    "military", "escalation", "escalate", "seize", "seized", "warship",
    "crisis", "tension", "standoff",
)
MARITIME_TERMS = (
    "tanker", "vessel", "ship", "shipping", "convoy", "port", "strait",
    "shipping lane", "sea lane", "maritime", "naval", "navy", "freight",
    "cargo", "seafarer", "chokepoint", "blockade", "pipeline", "terminal",
    "refinery", "aramco", "crude", "oil",
)
TOPIC_THEMES = ("ENV_OIL", "MARITIME", "ECON_OILPRICE", "MARITIME_INCIDENT", "ECON_SANCTIONS")

# --- extraction --------------------------------------------------------------
NO_CORRIDOR = "None"
CORRIDOR_VALUES = ("Hormuz", "Red Sea", "Cape", "None")
EVENT_TYPE_VALUES = ("sanction", "military", "shipping", "policy", "other")
CORRIDOR_ALIASES = {
    "suez": "Red Sea",
    "suez canal": "Red Sea",
    "bab-el-mandeb": "Red Sea",
    "bab el mandeb": "Red Sea",
    "gulf of aden": "Red Sea",
    "strait of hormuz": "Hormuz",
    "persian gulf": "Hormuz",
    "cape of good hope": "Cape",
    "none": "None",
    "null": "None",
    "": "None",
}

# --- network -----------------------------------------------------------------
SOURCE = "SOURCE"
SINK = "SINK"
CAPACITY_EPS = 1e-9
AFFECTED_BELOW = 0.95
MAX_CORRIDORS = 16
MAX_COMPONENT_PORTS = 10
LOSS_FRACTION_THRESHOLD = 0.15
RISK_ALONE_THRESHOLD = 0.75
SCENARIOS = (
    # key, name, mechanism, corridor, degradation_pct, supply_reduction_mbd, price_impact_usd,
    # affected_volume_mbd, transit_day_increase, india_impact_mbd, source
    ("hormuz_30", "Hormuz 30% Disruption", "corridor", "Hormuz", 30.0, None, 20.0, 5.1, None, None, "IEA Chokepoints 2023"),
    ("hormuz_full", "Hormuz Full Closure", "corridor", "Hormuz", 100.0, None, 65.0, 17.0, None, None, "IEA Chokepoints 2023"),
    ("red_sea", "Red Sea Suspension", "corridor", "Red Sea", 80.0, None, 5.0, None, 14, None, "IEA Red Sea Assessment 2024"),
    ("opec_cut", "OPEC+ Emergency Cut", "supply", None, None, 2.0, 15.0, None, None, 0.8, "IEA Oil Market Report 2024"),
)

# --- response ----------------------------------------------------------------
CRISIS_WEIGHTS = {"normal": (0.40, 0.35, 0.25), "severe": (0.20, 0.55, 0.25)}  # cost, transit, compatibility
RESERVE_TOTAL_MB = 36.87
RESERVE_FLOOR_SHARE = 0.20
RESERVE_RATE_MBD = 1.0
MAX_HORIZON_DAYS = 999
DEFAULT_DURATION_DAYS = 14

# --- validation --------------------------------------------------------------
SIGNAL_THRESHOLD = 0.6
TOLERANCE_DAYS = 2
SPIKE_SESSION_PCT = 5.0
SCORE_TIME = "16:30:00"
WARMUP_DAYS = 7
