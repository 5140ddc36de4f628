"""Word lists, patterns, limits and tables that results depend on."""

# ---- fixed values: URLs ------------------------------------------------------------------
SKIP_EXTENSIONS = [
    ".pdf", ".zip", ".tar", ".gz", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".mp3",
    ".mp4", ".avi", ".mov", ".woff", ".woff2", ".ttf", ".eot", ".ico", ".css", ".js",
]
PAGINATION_PATTERNS = [
    r"/page/(\d+)",
    r"/p/(\d+)",
    r"/\?(?:.*[&;]|)page=(\d+)",
    r"/\?(?:.*[&;]|)p=(\d+)",
    r"-page-(\d+)",
    r"_(\d+)\.html?",
]
# host (and, for one entry, path) of each advertising or analytics endpoint
AD_HOSTS = [
    "doubleclick.net", "googlesyndication.com", "googleadservices.com", "googletagservices.com",
    "google-analytics.com", "googletagmanager.com", "adsystem.amazon.com", "amazon-adsystem.com",
    "criteo.com", "criteo.net", "outbrain.com", "taboola.com", "scorecardresearch.com",
    "adsrvr.org", "adnxs.com", "rubiconproject.com", "pubmatic.com", "openx.net",
    "moatads.com", "facebook.com/tr", "connect.facebook.net", "analytics.twitter.com",
    "ads.yahoo.com", "ads.linkedin.com", "adform.net",
]
BLOCKED_HOSTS = [
    "localhost", "metadata.google.internal", "metadata.azure.internal", "instance-data.ec2.internal",
]
# IPv4 ranges that are not globally reachable (IANA special-purpose registry)
NON_GLOBAL_IPV4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
# addresses inside 192.0.0.0/24 that are globally reachable
GLOBAL_IPV4_EXCEPTIONS = ["192.0.0.9", "192.0.0.10"]
URL_IN_TEXT = r"https?://[^\s<>\"']+"

# ---- fixed values: page text -------------------------------------------------------------
NOISE_CLASS_WORDS = [
    "ad", "ads", "advert", "advertisement", "adsbygoogle", "sponsored", "sidebar", "nav",
    "navbar", "navigation", "cookie", "cookies", "popup", "modal",
]
NOISE_CLASS_SUFFIXES = ["sidenav", "subnav", "topnav"]
NOISE_TAGS = ["script", "style", "nav", "footer", "header", "aside"]
CHALLENGE_PHRASES = [
    "checking your browser", "cloudflare", "please wait", "verify you are human",
    "are you a robot", "just a moment", "ddos protection",
]
BASE64_IMAGE = r"(?i)data:image/[a-zA-Z0-9+.\-]+;base64,[^\s)\"'<>]+"
MAX_MARKDOWN_CHARS = 500_000
THIN_CONTENT_CHARS = 200
BATCH_PREVIEW_CHARS = 2000
SNAPSHOT_PREVIEW_CHARS = 500
LOG_TEXT_CHARS = 4096
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]

# ---- fixed values: change detection ------------------------------------------------------
DIFF_URL = r"https?://\S+"
DIFF_DATE = r"\d{1,2}[/:]\d{2}[/:]\d{2,4}"
DIFF_TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:am|pm)?"
DIFF_MAX_CHANGES = 50
DIFF_MIN_CHARS = 20
DIFF_SENTENCE_CHARS = 200
SENTENCE_MIN_CHARS = 10
SNAPSHOTS_PER_URL = 10
CHANGES_PER_EVENT = 20

# ---- fixed values: failure classification ------------------------------------------------
CAPTCHA_WORDS = [
    "captcha", "recaptcha", "hcaptcha", "please verify", "are you human",
    "verification required", "challenge", "blocked by", "automated access", "bot detected",
    "unusual traffic",
]
PAYWALL_WORDS = [
    "subscribe", "subscription required", "login required", "sign in to", "premium content",
    "members only", "paywall",
]
STATUS_CODES = {
    400: "bad_request", 401: "unauthorized", 403: "forbidden", 404: "not_found",
    408: "timeout", 413: "content_too_large", 429: "rate_limited", 500: "internal_error",
    502: "upstream_error", 503: "service_unavailable", 504: "timeout",
}
EXCEPTION_CODES = [
    ("unsupportedrendermodeerror", "unsupported_option"),
    ("optionerror", "unsupported_option"),
    ("timeouterror", "timeout"),
    ("httpx.timeout", "timeout"),
    ("httpx.connecterror", "connection_error"),
    ("circuitopenerror", "circuit_open"),
    ("emptypageerror", "empty_content"),
    ("valueerror", "invalid_url"),
    ("urllib.error.httperror", "upstream_error"),
    ("playwright.timeout", "timeout"),
]
PROXY_STATUSES = [407, 429, 502, 503, 504]
PROXY_MARKERS = [
    "proxy authentication", "proxy connection", "err_proxy", "err_tunnel", "connection reset",
    "connection refused", "timed out", "timeout",
]
RETRY_BACKOFFS = [1, 2, 4, 8, 16, 32]
NO_RETRY_TYPES = ["captcha", "paywall", "client_error"]
JS_SERVERS = ["cloudflare", "vercel", "netlify", "ampproject"]
JS_HEADER_PREFIXES = ["x-vercel", "x-next", "x-nuxt", "x-vite"]
JS_HEADERS = ["x-nextjs-cache", "x-nextjs-matched-path", "x-powered-by", "cf-ray"]
MIN_STATIC_BYTES = 2000

# ---- fixed values: host health -----------------------------------------------------------
FAILURE_THRESHOLD = 5
RECOVERY_SECONDS = 60.0
HALF_OPEN_CALLS = 1
MONITOR_SECONDS = 120
BACKOFF_FACTOR = 0.7
RECOVERY_STEP = 0.05
MIN_MULTIPLIER = 0.1
MAX_MULTIPLIER = 1.0
REQUESTS_PER_MINUTE = 60.0
BURST_SIZE = 20
WINDOW_SECONDS = 60.0
HISTORY_LENGTH = 100
EMA_KEEP = 0.7
EMA_GAIN = 0.3
ENGINE_PRIORS = {"bing": (0.90, 1800.0), "brave": (0.88, 1900.0), "duckduckgo": (0.88, 1900.0)}
ENGINE_FAILURES = 2
ENGINE_COOLDOWN_SECONDS = 30.0
ENDPOINT_FAILURES = 3
ENDPOINT_COOLDOWN_SECONDS = 60.0
ENDPOINT_IDENTITY_VERSION = "proxy-endpoint-v1"

# ---- fixed values: stores ----------------------------------------------------------------
CACHE_SIZE = 10_000
CACHE_TTL_SECONDS = 300
SELECTORS_PER_URL = 20
SELECTOR_URLS = 1000
RECENCY_STEPS = [(3600, 1.0), (86400, 0.5)]
RECENCY_OLD = 0.1

# ---- fixed values: extraction and research -----------------------------------------------
PAGE_CHARS = 50_000
TOTAL_CHARS = 120_000
TRUNCATION_RESERVE = 100
TRUNCATION_MIN = 500
PAGE_MARKER = ("\n---\n\U0001F4C4 Page ", ": ", "\n\U0001F517 URL: ", "\n---\n")
REPORT_WORDS = {"brief": 500, "standard": 1500, "comprehensive": 4000}
CONFIDENCE_LABELS = [(0.8, "HIGH CONFIDENCE"), (0.6, "MEDIUM CONFIDENCE"), (0.4, "LOW CONFIDENCE")]
CHUNK_CHARS = 1000
CHUNK_OVERLAP = 100
CHUNK_BOUNDARIES = ["\n\n", ". ", "\n"]
