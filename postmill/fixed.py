"""Fixed values. Results depend on each of these exactly as written."""

# --- Fixed values: tracking table layouts (column names, in order) ---------
MAIL_COLUMNS = [
    "job_url", "source", "date_received", "fetch_status", "fetch_attempts",
    "fetch_error", "last_fetch_at", "last_seen_at", "company", "role_title",
    "location", "apply_url", "job_description", "job_summary",
    "agent_bucket", "agent_reasoning",
]
BOARD_COLUMNS = [
    "source", "first_seen", "company", "role_title", "job_url", "location",
    "department", "fetch_status", "fetch_attempts", "last_fetch_at",
    "fetch_error", "job_description", "job_summary", "agent_bucket",
    "agent_reasoning",
]
COMPANY_LIST_COLUMNS = ["company", "company_url", "career_site_url", "last_error"]

# --- Fixed values: limits ---------------------------------------------------
MAX_ATTEMPTS = 3
DESCRIPTION_CHARS = 6000
SUMMARY_CHARS = 500
PACK_SIZE = 10
MAIL_CAP = 25
BOARD_CAP = 25
COMPANY_CAP = 50
MESSAGE_CAP = 50
MAX_REJECTS, MAX_EXCEPTIONS, MAX_NOTES = 15, 15, 10
MIN_DESCRIPTION_CHARS = 100
MIN_LINK_CHARS = 10

# --- Fixed values: states and buckets ---------------------------------------
RETRYABLE = ["pending", "failed", "timeout"]
STATES = ["pending", "fetched", "failed", "timeout"]
BUCKETS = ["true_match", "monitor", "reject"]

# --- Fixed values: posting link rules ---------------------------------------
EXCLUDED_LINK_PARTS = [
    "/benefits", "/culture", "/about", "/contact", "/press", "/blog",
    "linkedin.com/company",
]
POSTING_LINK_PATTERNS = [
    r"greenhouse\.io/.*/jobs/\d+",
    r"job-boards\.greenhouse\.io/.*/jobs/\d+",
    r"jobs\.lever\.co/",
    r"workday\.com/.*/job",
    r"jobs\.ashbyhq\.com/[^/]+/[^/]+",
    r"ashbyhq\.com/.*/jobs",
    r"jobs\.gem\.com/[^/]+/(?:job|jobs)/",
    r"jobs\.gem\.com/[^/]+/[^/]+/.+",
    r"jobs\.gem\.com/[^/]+/[a-zA-Z0-9_-]{20,}",
    r"darwinbox\.in/.*/(?:job|jobs)/",
    r"/careers?/.*(?:job|position|opening)",
    r"/jobs?/.*(?:job|position|opening|\d+)",
    r"/openings?/",
    r"/job/",
    r"/position/",
    r"linkedin\.com/jobs/view/\d+",
]
OPEN_ROLES_PHRASES = [
    "view open roles", "see open roles", "open roles", "open positions",
    "current openings", "browse jobs", "view jobs", "see jobs", "all jobs",
    "job openings", "join our team", "we're hiring",
]
CAREERS_PATH_PATTERNS = [
    r"/careers?/?$", r"/jobs?/?$", r"/careers?/", r"/jobs?/", r"/openings?/",
    r"/join/?$", r"/work-with-us/?$",
]
CAREERS_EXACT_TEXTS = [
    "careers", "jobs", "join us", "join our team", "work with us",
    "open positions", "open roles",
]
CAREERS_PHRASES = ["careers", "jobs", "open roles", "open positions"]
APPLY_PHRASES = ["apply", "employer"]
APPLY_BUTTON_PHRASES = ["apply", "employer site"]
APPLY_REPORT_PATTERN = r"(?i)apply|employer"
APPLY_REPORT_HOSTS = ["greenhouse", "ashby", "lever"]

# --- Fixed values: hosts, paths and source tags -----------------------------
BOARD_LINK_PATTERN = (
    r"https?://(?:boards\.greenhouse\.io|job-boards\.greenhouse\.io"
    r"|job-boards\.eu\.greenhouse\.io)/([a-zA-Z0-9_-]+)/jobs/(\d+)"
)
HOSTED_LINK_PATTERN = (
    r"https?://(?:boards\.greenhouse\.io|job-boards\.greenhouse\.io"
    r"|jobs\.ashbyhq\.com|jobs\.lever\.co|apply\.workable\.com"
    r"|[a-zA-Z0-9-]+\.greenhouse\.io)/[^\s\"']+"
)
ALERT_PATH = "/jobs/view/"
ALERT_TRACKED_PATH = "/comm/jobs/view/"
ALERT_HOST = "linkedin.com"
AGGREGATOR_HOST = "swooped.co"
AGGREGATOR_API_HOST = "api.swooped.co"
AGGREGATOR_POSTING_PATH = "job-postings"
SOURCE_MAIL, SOURCE_BOARD = "gmail", "greenhouse"
SOURCE_COMPANY, SOURCE_DESCRIBED = "companies", "swooped"

# --- Fixed values: page parsing ---------------------------------------------
GENERIC_TITLES = [
    "work with us!", "join our team!", "careers", "open roles",
    "job opportunities",
]
TITLE_SUFFIX_PATTERN = r"(?iU)\s*\|\s*LinkedIn\s*$"
DESCRIPTION_CLASS_PATTERN = r"(?i)job-description|job-details|description"
DESCRIPTION_ID_PATTERN = r"(?i)job-description|description"
DESCRIPTION_TESTID_PATTERN = r"(?i)job|description"
CONTEXT_TAGS = ["div", "article", "li", "section"]

# --- Fixed values: capture bodies (field aliases, first non-empty wins) -----
LIST_URL_KEYS = ["url", "applyUrl", "apply_url"]
LIST_TITLE_KEYS = ["jobTitle", "title", "role_title"]
LIST_LOCATION_KEYS = ["location", "location_text"]
LIST_DESCRIPTION_KEYS = ["jobDescription", "description", "job_description"]
WALK_URL_KEYS = [
    "apply_url", "applyUrl", "application_url", "job_url", "url",
    "external_url",
]
WALK_TITLE_KEYS = ["jobTitle", "title", "role_title", "name"]
WALK_COMPANY_KEYS = ["company", "company_name", "employer"]
WALK_DESCRIPTION_KEYS = ["jobDescription", "description", "job_description", "body"]
WALK_LOCATION_KEYS = ["location", "location_text"]

# --- Fixed values: scoring texts --------------------------------------------
CLOSED_PHRASES = [
    "no longer accepting applications", "applications are closed",
    "role is closed",
]
CLOSED_REASON = "Role is closed: no longer accepting applications"
FAILED_REASON = "Scoring failed: LLM returned invalid JSON"
FAILED_NOTE = "Scoring parse error - review jobs manually"
NEXT_SKIP, NEXT_REVIEW = "Skip", "Review manually"
REASON_BULLET = "• "
PACK_SEPARATOR = "\n\n---\n\n"
PREFS_HEADING = "Learned from your feedback:\n"
PREFS_REJECT_LABEL = "Reject these companies: "
PREFS_EXCEPTION_LABEL = "Exceptions (override category rules): "

# --- Fixed values: discovery error texts ------------------------------------
ERROR_NO_COMPANY_URL = "Career URL failed and no company URL to fall back to"
ERROR_NO_CAREERS_LINK = "Career URL failed; no careers link found on company page"
ERROR_NO_POSTINGS = "Found careers page but no job links extracted"
ERROR_FALLBACK = "Fallback failed: "

# --- Fixed values: entity aliases (lower-case alias -> stored name) ---------
ENTITY_ALIASES = {
    "microsoft corp": "Microsoft",
    "microsoft corporation": "Microsoft",
    "msft": "Microsoft",
    "google llc": "Google",
    "alphabet": "Google",
    "amazon.com": "Amazon",
    "amazon": "Amazon",
    "aws": "Amazon",
}
EMPTY_ENTITY_ERROR = "Entity is empty after normalization"
REJECT_AFTER_EXCEPTION = (
    "is in exceptions. Remove from exceptions first, or confirm you want to reject."
)
EXCEPTION_AFTER_REJECT = (
    "is in reject list. Remove from reject first, or confirm you want to add as exception."
)
