"""Fixed vocabularies, limits and patterns of the domain, plus the small lookup tables built
from them.

Every operator takes its vocabulary as a parameter; the values here are only the defaults.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: they decide results, so they are stated plainly ------------------------

DEAL_TYPES = ["M&A", "Funding", "Stake", "JV"]
CATEGORIES = ["Food", "Beverage", "Personal care", "Home care", "Other"]
UNDISCLOSED = "Undisclosed"
DEFAULT_REGION = "India"

TIER_1 = [
    "Reuters", "Bloomberg", "The Economic Times", "Mint", "Business Standard", "Moneycontrol",
    "BusinessLine", "VCCircle", "Financial Express",
]
TIER_2 = ["Inc42", "Entrackr", "YourStory", "Just Food", "FoodDive"]
UNKNOWN_TIER = 3

SOURCE_ALIASES = {
    "economic times": "The Economic Times",
    "the economic times": "The Economic Times",
    "et bureau": "The Economic Times",
    "economictimes.indiatimes.com": "The Economic Times",
    "livemint": "Mint",
    "live mint": "Mint",
    "livemint.com": "Mint",
    "mint.com": "Mint",
    "business standard": "Business Standard",
    "business-standard.com": "Business Standard",
    "moneycontrol.com": "Moneycontrol",
    "the hindu businessline": "BusinessLine",
    "hindu businessline": "BusinessLine",
    "thehindubusinessline.com": "BusinessLine",
    "financial express": "Financial Express",
    "financialexpress.com": "Financial Express",
    "vccircle.com": "VCCircle",
    "inc42.com": "Inc42",
    "entrackr.com": "Entrackr",
    "yourstory.com": "YourStory",
    "just food": "Just Food",
    "just-food.com": "Just Food",
    "justfood.com": "Just Food",
    "food dive": "FoodDive",
    "fooddive.com": "FoodDive",
    "reuters.com": "Reuters",
    "bloomberg.com": "Bloomberg",
}

BLOCKED_SOURCES = [
    "marketbeat",
    "home health care news", "mcknights home care", "fierce healthcare",
    "care home professional", "caring times", "hospice news", "laingbuisson news",
    "at the races", "daily racing form", "betfair", "olbg", "racing tv",
    "read horse racing", "thoroughbred daily news", "william hill news",
]

DIRECT_FEEDS = {
    "The Economic Times":
        "https://economictimes.indiatimes.com/industry/cons-products/fmcg/rssfeeds/13352306.cms",
    "Moneycontrol": "https://www.moneycontrol.com/rss/business.xml",
    "Entrackr": "https://entrackr.com/rss",
    "Inc42": "https://inc42.com/feed/",
    "FoodDive": "https://www.fooddive.com/feeds/news/",
}

WATCHLIST = [
    "HUL", "Hindustan Unilever", "ITC", "Dabur", "Marico", "Nestle India", "Unilever",
    "Procter & Gamble", "Colgate", "Britannia", "Tata Consumer", "Emami", "Godrej Consumer",
    "Adani Wilmar", "Patanjali", "Varun Beverages", "United Spirits", "Radico Khaitan",
    "Zydus Wellness", "Jyothy Labs", "Bajaj Consumer Care", "Bikaji Foods", "Gopal Snacks",
    "Honasa Consumer", "Mamaearth", "Nykaa", "Wipro Consumer Care", "CavinKare",
    "Reliance Consumer Products",
]
CATEGORY_TERMS = [
    "FMCG", "consumer goods", "packaged foods", "beverages", "personal care", "home care",
    "D2C brand", "snacks brand", "dairy brand", "confectionery", "skincare brand",
    "haircare brand", "ayurveda", "nutraceutical",
]
QUERY_VERBS = ["acquires", "funding", "stake", "raises", "invests", "merger"]
SEARCH_URL_PREFIX = "https://news.google.com/rss/search?q="
SEARCH_URL_SUFFIX = "&hl=en-IN&gl=IN&ceid=IN:en"

TRACKING_PARAM = (
    "^(utm_.*|fbclid|gclid|mc_cid|mc_eid|igshid|ref|referrer|source|cmpid|ncid)$"
)
WRAPPER_HOST_SUFFIX = "news.google.com"

# Words that describe a company without naming one.
GENERIC_TOKENS = [
    "company", "companies", "firm", "firms", "startup", "startups", "brand", "brands",
    "business", "businesses", "major", "majors", "group", "maker", "makers", "player",
    "players", "giant", "giants", "billionaire", "entity", "arm", "unit", "subsidiary",
    "venture", "chain", "retailer", "producer", "manufacturer", "conglomerate", "parent",
    "undisclosed", "unnamed", "unknown", "anonymous", "investor", "investors", "consortium",
    "beverage", "beverages", "food", "foods", "cosmetics", "care", "personal", "home",
    "products", "fmcg", "consumer", "goods", "dairy", "snacks", "beauty", "skincare",
    "the", "a", "an", "of", "and", "in", "global", "local", "leading", "top", "largest",
    "biggest", "indian", "kenyan", "german", "american", "british", "french", "chinese",
    "japanese", "european", "us", "uk", "india", "based", "listed", "private", "public",
]

# Legal-form words that callers may add to GENERIC_TOKENS; off by default.
LEGAL_SUFFIXES = ["llc", "ltd", "inc", "pvt"]

DEAL_VERB_PATTERN = "|".join([
    r"acquir\w*", "acquisition", r"merge\w*", "merger", "buyout", "buys?", "stake",
    r"invest\w*", "funding", "raises?", "raised", r"series\s+[a-e]", "takeover",
    r"takes?\s+over", r"divest\w*", r"joint\s+venture", r"\bJV\b", r"majority\s+stake",
    r"minority\s+stake",
])
SECTOR_SIGNAL_PATTERN = "|".join(WATCHLIST + [
    "FMCG", r"consumer\s+goods", r"packaged\s+food", r"beverage\w*", r"personal\s+care",
    r"home\s+care", "skincare", "haircare", "D2C", r"snack\w*", "dairy", r"confectioner\w*",
])
NOISE_PATTERN = "|".join([
    r"\((?:nyse|nasdaq|lon|otcmkts|tsx|amex|asx|cboe)\s*:",
    r"\b13f\b",
    r"\bshares of\b",
    r"\b(?:stock position|stock holdings|holdings in)\b",
    r"(?:buys|sells|purchases|boosts|reduces|trims|lowers|cuts|lifts|raises|acquires"
    r"|decreases|increases)\s+[\d,]+\s+shares",
    r"\bstake (?:lifted|boosted|cut|lowered|trimmed|reduced|raised|decreased|increased|sold)"
    r"\s+by\b",
    r"has \$[\d.,]+\s+(?:million|billion)\s+(?:holdings|stock|stake|position)",
    r"\bprice target\b",
    r"\bconsensus recommendation\b",
    r"(?:moderate|strong)\s+buy",
    r"\bhome health\b",
    r"\bhospice\b",
    r"\bassisted living\b",
    r"\bnursing home\b",
    "caregiv",
    "in-home care",
    r"\bhomecare\b",
])

MAX_VALUE = {"INR_CRORE": 100_000.0, "USD_MILLION": 100_000.0, "INR": 1e13, "USD": 1e11}
# value -> USD millions: multiply for the first two, divide for the last two.
USD_MILLION_FACTOR = {"INR_CRORE": 0.12, "USD_MILLION": 1.0}
USD_MILLION_DIVISOR = {"INR": 8_300_000.0, "USD": 1_000_000.0}
SIZE_STEPS = [(500.0, 1.0), (100.0, 0.85), (25.0, 0.7), (5.0, 0.5)]
SIZE_SMALLEST, SIZE_UNKNOWN = 0.35, 0.5

TIER_SCORE = {1: 0.75, 2: 0.5, 3: 0.25}
CORROBORATION_STEP, CORROBORATION_CAP = 0.12, 0.25
BADGES = [(0.75, "High"), (0.45, "Med")]
LOWEST_BADGE = "Low"
BADGE_RANK = {"High": 3, "Med": 2, "Low": 1}

WEIGHTS = {"relevance": 0.35, "credibility": 0.3, "recency": 0.2, "size": 0.15}
TOP_N = 12
WINDOW_DAYS = 90
PER_FEED_CAP = 25
# Sentences of the digest.
METHODOLOGY = (
    "Method: %d articles ingested from %d sources over the last %d days, "
    "de-duplicated to %d unique stories (embedding similarity + title match), "
    "filtered to %d confirmed FMCG deals, ranked to the top %d. "
    "Confidence badges reflect source tier and how many independent outlets reported a "
    "deal — they measure corroboration, not truth, and are not fact-checking. "
    'Deal values are as reported; "Undisclosed" means terms were not made public.'
)
NO_DEALS = "No qualifying FMCG deals in this window."
DEALS_TRACKED = " FMCG deals tracked this period."
INVESTS, ACQUIRES = " invests in ", " acquires "

REFRESH_PRESET = {"window_days": 21, "query_limit": 8, "per_feed_cap": 10}

COSINE_THRESHOLD = 0.8
TITLE_MATCH_RATIO = 95
EMBED_TEXT_LENGTH, PROMPT_SNIPPET_LENGTH, EXTRACT_SNIPPET_LENGTH = 512, 400, 800
SCREEN_BATCH, CONFIRM_BATCH, EMBED_BATCH = 25, 6, 32
EMBED_DIM = 384
SWEEP_THRESHOLDS = [0.6, 0.65, 0.7, 0.75, 0.78, 0.8, 0.82, 0.85]
PAIR_FLOOR, BAND_LOW, BAND_HIGH, BAND_ROWS = 0.45, 0.72, 0.86, 22

DATE_TOLERANCE_DAYS = 5
VALUE_TOLERANCE = 0.01

EXPORT_COLUMNS = [
    "Acquirer", "Target", "Type", "Value", "Value (raw)", "Currency", "Stake %", "Category",
    "Region", "Announced", "Confidence", "Sources", "Source count", "Credibility", "Source URL",
]

# --- Lookup tables ------------------------------------------------------------------------
# Built from Arrow tables, so Catalyst knows their exact size and itself decides whether a
# join broadcasts them; a caller's own, larger table is shuffled instead.


def term_dim(spark: SparkSession, terms: list[str] | None = None) -> DataFrame:
    """(term, term_pos): what the query grid asks for, watched names before category terms."""
    terms = WATCHLIST + CATEGORY_TERMS if terms is None else terms
    schema = pa.schema([("term", pa.string()), ("term_pos", pa.int32())])
    return spark.createDataFrame(pa.table({"term": list(terms), "term_pos": list(range(len(terms)))}, schema))


def alias_dim(spark: SparkSession, aliases: dict[str, str] = SOURCE_ALIASES) -> DataFrame:
    """(alias_key, unified): one row per known publisher spelling."""
    columns = {"alias_key": list(aliases), "unified": list(aliases.values())}
    schema = pa.schema([("alias_key", pa.string()), ("unified", pa.string())])
    return spark.createDataFrame(pa.table(columns, schema))


def tier_dim(
    spark: SparkSession, tier1: list[str] = TIER_1, tier2: list[str] = TIER_2
) -> DataFrame:
    """(tier_source, tier): the allowlist; everything absent is tier 3."""
    tiers = {**{s: 2 for s in tier2}, **{s: 1 for s in tier1}}
    schema = pa.schema([("tier_source", pa.string()), ("tier", pa.int32())])
    columns = {"tier_source": list(tiers), "tier": list(tiers.values())}
    return spark.createDataFrame(pa.table(columns, schema))


def blocklist_dim(spark: SparkSession, blocked: list[str] = BLOCKED_SOURCES) -> DataFrame:
    schema = pa.schema([("blocked", pa.string())])
    return spark.createDataFrame(pa.table({"blocked": list(blocked)}, schema))


def category_dim(spark: SparkSession, categories: list[str] = CATEGORIES) -> DataFrame:
    """(category, category_pos): the canonical section order."""
    schema = pa.schema([("category", pa.string()), ("category_pos", pa.int32())])
    columns = {"category": list(categories), "category_pos": list(range(len(categories)))}
    return spark.createDataFrame(pa.table(columns, schema))
