"""Fixed values.

Word lists, patterns, lookup tables and thresholds that results depend on.
They are data, not logic: each must keep exactly this content for results to
stay comparable from run to run.  Every function that uses one also takes it
as an argument, so a job can pass its own.
"""

# --------------------------------------------------------------------------
# Lead hygiene
# --------------------------------------------------------------------------
TRACKING_PREFIXES = ["utm_"]
TRACKING_NAMES = ["fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "ref", "igshid"]

PARKING_NAME_SERVERS = [
    "sedoparking.com", "parkingcrew.net", "above.com", "bodis.com",
    "parklogic.com", "dan.com", "voodoo.com", "parked.com",
]

COUNTRY_BY_SUFFIX_LABEL = {
    "ca": "CA", "uk": "UK", "de": "DE", "fr": "FR", "au": "AU", "nz": "NZ",
    "ie": "IE", "nl": "NL", "se": "SE", "no": "NO", "dk": "DK", "fi": "FI",
    "es": "ES", "it": "IT", "jp": "JP", "in": "IN", "br": "BR", "mx": "MX",
}

# Public suffixes where no published list is at hand: single labels in general
# use, and the registry's second level per country.
GENERIC_SUFFIXES = (
    "com org net edu gov mil int info biz name pro io ai co app dev cloud "
    "online store shop site tech agency studio design digital media group "
    "company solutions services consulting software systems network academy "
    "health care legal finance capital ventures partners global world today "
    "news blog email live life space website xyz top club vip me tv cc eu asia"
).split()
COUNTRY_SUFFIXES = (
    "ca uk de fr au nz ie nl se no dk fi es it jp in br mx us ch at be pt pl "
    "cz sk hu ro bg gr tr ru ua il za kr cn hk tw sg my th id ph vn ar cl pe "
    "ee lv lt is lu si hr rs ae sa eg ke ng"
).split()
SECOND_LEVEL_SUFFIXES = {
    "uk": "co org ac gov ltd plc me net sch nhs",
    "au": "com net org edu gov id",
    "nz": "co net org ac govt school",
    "in": "co net org ac gov firm gen ind",
    "jp": "co ne or ac go",
    "br": "com net org gov edu",
    "mx": "com net org gob edu",
    "za": "co org net ac gov",
    "kr": "co or ne re go ac",
    "cn": "com net org gov edu",
    "tw": "com net org gov edu",
    "hk": "com net org gov edu",
    "sg": "com net org gov edu",
    "my": "com net org gov edu",
    "tr": "com net org gov edu",
    "ar": "com net org gob edu",
    "il": "co org net ac",
    "es": "com org nom gob edu",
    "fr": "asso com gouv nom",
    "th": "co or ac go in",
    "id": "co or ac go web",
}

# --------------------------------------------------------------------------
# Page corpus
# --------------------------------------------------------------------------
MAX_PAGES_PER_DOMAIN = 8
MAX_CHARS_PER_DOMAIN = 60_000
LOW_CONTENT_CHARS = 150
CACHE_DAYS = 30
MAX_SITEMAP_LOCATIONS = 300
MAX_PEOPLE_PER_PAGE = 30
MAX_PEOPLE_PER_DOMAIN = 40
BLOCK_SAMPLE_CHARS = 3000

# page type -> pattern, in the order types are tried
PAGE_TYPE_PATTERNS = [
    ("about", r"\babout\b|\bwho[-\s]?we[-\s]?are\b|\bour[-\s]?story\b"),
    ("team", r"\bteam\b|\bleadership\b|\bmeet[-\s]?the[-\s]?team\b|\bour[-\s]?people\b|"
             r"\bexecutives?\b|\bmanagement\b|\bfounders?\b"),
    ("services", r"\bservices?\b|\bpricing\b|\bsolutions?\b|\bwhat[-\s]?we[-\s]?do\b"),
    ("contact", r"\bcontact\b|\bget[-\s]?in[-\s]?touch\b"),
    ("careers", r"\bcareers?\b|\bjobs?\b|\bwe[-\s]?are[-\s]?hiring\b"),
    ("blog", r"\bblog\b|\bnews\b|\binsights?\b|\barticles?\b"),
]
PAGES_PER_TYPE = {"blog": 2}
DEFAULT_PAGES_PER_TYPE = 1

BLOCK_WALL_PATTERN = (
    r"just a moment|attention required|access denied|are you a human|"
    r"verify you are human|checking your browser|cf-browser-verification|"
    r"unusual traffic from your computer|please enable cookies to continue|"
    r"pardon our interruption|request blocked"
)

EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
IMAGE_SUFFIX_PATTERN = r"\.(png|jpg|jpeg|gif|svg)$"
PLACEHOLDER_DOMAIN_PATTERN = r"^(example|test|sample|yourcompany|yourdomain)\b"
JUNK_EMAIL_DOMAINS = [
    "example.com", "example.org", "example.net", "yourcompany.com",
    "yourdomain.com", "domain.com", "test.com", "email.com", "company.com",
    "sentry.io", "wixpress.com", "godaddy.com", "gravatar.com",
    "schema.org", "w3.org", "cloudflare.com",
]

CARD_TITLE_PATTERN = (
    r"\b(Co-?Founder|Founder|Chief [A-Za-z]+ Officer|CEO|CTO|CFO|COO|President|Owner|"
    r"Managing Director|Director|Head of [A-Za-z &]+|Sales Manager|VP of [A-Za-z &]+|"
    r"Business Development|Marketing Manager|General Manager|Manager|Engineer|Lead|"
    r"Specialist|Coordinator|Analyst|Consultant|Executive|Representative|Advocate)\b"
)
CARD_NAME_PATTERN = r"^[A-Z][a-zA-Z'-]+(?:\s[A-Z]\.)?\s[A-Z][a-zA-Z'-]+$"
CARD_NAME_STOP_WORDS = [
    "our", "about", "contact", "learn", "get", "free", "read", "see", "view",
    "meet", "join", "sign", "log", "book", "start", "watch", "shop", "buy",
    "the", "team", "company", "privacy", "policy", "terms", "service",
    "cookie", "settings", "all", "rights", "reserved", "back", "next", "skip",
]
CARD_MAX_TITLE_WORDS = 6
PERSON_RELATIONS = ["founder", "founders", "employee", "employees", "member", "members"]

PERMANENT_ERROR_MARKERS = ["ERR_NAME_NOT_RESOLVED", "ERR_ADDRESS_UNREACHABLE", "ERR_INVALID_URL"]

# --------------------------------------------------------------------------
# contacts
# --------------------------------------------------------------------------
MAX_CONTACTS_PER_DOMAIN = 2
GUESS_PREFIXES = ["info", "contact", "sales", "hello"]
MAX_PENDING_PEOPLE = 5
MAX_PROBED_TEMPLATES = 5

DECISION_MAKER_PATTERN = (
    r"\b(Co-?Founder|Founder|Chief [A-Za-z]+ Officer|CEO|CTO|CFO|COO|President|Owner|"
    r"Managing Director|Director|Head of [A-Za-z &]+|VP of [A-Za-z &]+|Vice President|"
    r"General Manager|Business Development|Marketing Manager|Sales Manager)\b"
)
SENIORITY_PATTERNS = [
    (1, r"\b(Co-?Founder|Founder|CEO|Chief Executive Officer|President|Owner)\b"),
    (2, r"\b(CTO|CFO|COO|Chief [A-Za-z]+ Officer|Managing Director|VP of [A-Za-z &]+|Vice President)\b"),
    (3, r"\b(Sales Manager|Marketing Manager|Business Development|Head of [A-Za-z &]+)\b"),
]
LOWEST_SENIORITY = 9

# {f} first name, {l} last name, {fi} and {li} their initials
ADDRESS_TEMPLATES = ["{f}.{l}", "{f}{l}", "{fi}{l}", "{f}", "{f}_{l}", "{l}.{f}", "{f}.{li}", "{fi}.{l}"]

# role, priority, pattern on the part before @; the first that fits wins
ROLE_PATTERNS = [
    ("founder_owner", 1, r"^(founder|co-?founder|owner|ceo|president|principal)\b"),
    ("sales_bd", 1, r"^(sales|bd|biz\.?dev|business\.?development|partnerships?)\b"),
    ("marketing", 2, r"^(marketing|growth|brand)\b"),
    ("personal", 2, r"^[a-z]+[._][a-z]+$"),
    ("generic_contact", 3, r"^(info|contact|hello|hi|team|office|admin|enquiries?)\b"),
    ("support", 4, r"^(support|help|service|customerservice)\b"),
    ("hr_careers", 5, r"^(hr|careers?|jobs|recruit(ing)?)\b"),
]
DEFAULT_ROLE = ("other", 4)

PROSE_TITLES = (
    r"Co-?Founder|Founder|Chief Executive Officer|CEO|President|Owner|"
    r"Managing Director|Director|Head of Sales|Sales Manager|VP of Sales|"
    r"Business Development|Marketing Manager|General Manager"
)
PROSE_NAME = r"[A-Z][a-z]+(?:\s[A-Z]\.?)?\s[A-Z][a-z]+"
NAME_THEN_TITLE = rf"({PROSE_NAME})\s*[,\-–—]?\s*(?:is\s+(?:the|our)\s+)?({PROSE_TITLES})"
TITLE_THEN_NAME = rf"({PROSE_TITLES})\s*[,:\-–—]\s*({PROSE_NAME})"
SELF_INTRODUCTION = (
    rf"\b(?:I[’'`]?m|I am|My name is)\s+({PROSE_NAME})\s*,?\s*"
    rf"(?:one of the\s+|the\s+|an?\s+)?({PROSE_TITLES})s?\b"
)
TRAILING_COMPANY = r"^\s*(?:at|of|@|,)\s+([A-Z][A-Za-z0-9&.\-]+(?:\s[A-Z][A-Za-z0-9&.\-]+){0,2})"
TRAILING_CHARS = 40
PROSE_PAGE_TYPES = ["about", "team", "contact", "careers", "home"]

NOTE_NO_MX = "no MX records"
NOTE_NOT_CHECKED = "SMTP verification disabled (--verify-smtp not passed)"
NOTE_CATCH_ALL = "domain is catch-all -- cannot confirm this specific mailbox exists"
NOTE_GUESS_CATCH_ALL = "domain is catch-all -- cannot verify any specific guess"
NOTE_GUESS_NO_MX = "no MX records -- cannot verify"
NOTE_GUESS_SPECULATIVE = (
    "no confirmed email pattern for this domain -- speculative guess using the most common "
    "convention (--verify-smtp not enabled)"
)

GAP_COLUMNS = [
    "domain", "company_name_guess", "gap_reason", "existing_best_name", "existing_best_email",
    "google_search_url", "linkedin_search_url", "found_name", "found_title", "found_email",
    "verified_yn", "notes",
]

# --------------------------------------------------------------------------
# analysis
# --------------------------------------------------------------------------
MAX_PROMPT_CHARS = 60_000
MIN_HOOK_SPECIFICITY = 7
ANALYSIS_TEXT_KEYS = ["company_name", "what_they_do", "icp_they_serve", "geo", "size_estimate"]
ANALYSIS_LIST_KEYS = [
    "services", "recent_events", "hiring_signals", "tech_signals", "pains", "hooks", "disqualifiers",
]

# --------------------------------------------------------------------------
# drafting
# --------------------------------------------------------------------------
SEQUENCE_LENGTH = 4
CONFIDENCE_RANK = {"high": 0, "medium": 1, "low": 2}
UNKNOWN_CONFIDENCE_RANK = 99
REQUIRED_OFFER_KEYS = [
    "your_company_name", "sender_name", "what_you_sell", "icp_description", "proof_points", "cta_style",
]
PLACEHOLDER_PATTERN = r"\[[a-z0-9_\- ]{2,40}\]"

# --------------------------------------------------------------------------
# Quality gate
# --------------------------------------------------------------------------
MAX_BODY_WORDS = 90
MAX_READING_GRADE = 8
MIN_GROUNDING = 8
MIN_OVERALL = 7
ALWAYS_REVIEWED = 50
REVIEW_PERCENT = 10
BORDERLINE_OVERALL = 7

BANNED_PHRASES = [
    "hope this email finds you well", "just following up", "revolutionary", "game-changing",
    "synergy", "circling back", "touch base", "per my last email",
]
# label, pattern, case-insensitive?
LEAK_PATTERNS = [
    ("double_curly", r"\{\{[^}]*\}\}", False),
    ("double_bracket", r"\[\[[^\]]*\]\]", False),
    ("literal_undefined", r"\bundefined\b", True),
    ("literal_null", r"\bnull\b", True),
    ("literal_name_token", r"\bNAME\b", False),
    ("ai_self_disclosure", r"\bas an ai\b", True),
    ("ai_no_access", r"i don['’]t have access", True),
]
GROUNDING_STOP_WORDS = [
    "the", "and", "that", "this", "with", "from", "your", "have", "been", "were", "they",
    "their", "about", "which", "would", "could", "should", "there",
]
MIN_KEYWORD_CHARS = 5
VIOLATION_LINKS = "the first mail holds a link"
VIOLATION_IMAGE = "the body refers to an image or a file"
VIOLATION_UNGROUNDED = "the body refers to no verified detail"
DEFAULT_JUDGE_FEEDBACK = "the scores of the judge are too low"

# --------------------------------------------------------------------------
# sending
# --------------------------------------------------------------------------
MAX_SEQUENCE_STEP = 4
STEP_DELAY_DAYS = {1: 3, 2: 4, 3: 5}
# (first day, day after the last or None, cap per day)
WARMUP_RAMP = [(0, 7, 10), (7, 14, 20), (14, 21, 30), (21, None, 40)]
WARMUP_STAGES = [(7, "week 1 (ramping)"), (14, "week 2 (ramping)"), (21, "week 3 (ramping)")]
STEADY_STAGE = "steady state"
DKIM_SELECTORS = ["google", "default", "selector1", "selector2", "k1", "dkim", "mail"]
DNSBL_ZONES = ["zen.spamhaus.org", "b.barracudacentral.org", "dnsbl.sorbs.net"]

# --------------------------------------------------------------------------
# Inbound mail
# --------------------------------------------------------------------------
LOOK_BACK_DAYS = 10
OOO_DELAY_DAYS = 7
SOFT_BOUNCE_DELAY_DAYS = 2
BOUNCE_SENDER_PATTERN = r"mailer-daemon|postmaster|mail delivery|no-?reply@.*delivery"
BOUNCE_SUBJECT_PATTERN = (
    r"undeliver|delivery status notification|delivery failure|failure notice|"
    r"returned mail|mail delivery failed|couldn.t be delivered"
)
UNSUBSCRIBE_PATTERN = (
    r"\bunsubscribe\b|stop emailing|remove me from|take me off|stop contacting|"
    r"do not (email|contact) me again|no longer interested.{0,20}remove"
)
OOO_PATTERN = (
    r"out of (the )?office|automatic reply|auto-reply|on vacation|"
    r"currently (away|out|on leave)|annual leave|will be back"
)
OOO_DATE_PATTERN = (
    r"(?:back|return(?:ing)?|available)\s+(?:on\s+)?"
    r"(\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?|"
    r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2})"
)
DSN_STATUS_PATTERN = r"\bStatus:\s*([45])\.\d{1,3}\.\d{1,3}"
HARD_BOUNCE_PATTERN = (
    r"no such user|does not exist|user unknown|invalid recipient|"
    r"recipient rejected|mailbox not found|address rejected|"
    r"no mailbox here|unknown user|unrouteable address"
)
SOFT_BOUNCE_PATTERN = (
    r"mailbox full|quota exceeded|over quota|try again later|"
    r"temporarily deferred|greylist|message delayed|"
    r"temporary failure|service (?:not|un)available|throttl"
)
DOMAIN_STOP_REASON = "unsubscribed (colleague requested stop)"

# --------------------------------------------------------------------------
# feedback
# --------------------------------------------------------------------------
MIN_SAMPLE = 200
HEALTH_LIMITS = {"bounce_rate_max": 0.02, "reply_rate_min": 0.05, "positive_rate_min": 0.01}
FEW_SHOT_LIMIT = 5
FEW_SHOT_REPLY_CHARS = 150
