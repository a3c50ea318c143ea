"""Words, codes, patterns and formats the results depend on."""

# Verdicts in display order, with the label shown to people.
VERDICT_LABELS = {
    "STRONG": "Excellent Match",
    "DECENT": "Worth Applying",
    "WEAK": "Low Priority",
    "REJECT": "Skip This One",
}
UNKNOWN_LABEL = "Unknown"
VERDICTS = tuple(VERDICT_LABELS)

TRACKER_STATUSES = ("Applied", "Interviewing", "Offer", "Rejected", "Withdrawn")
TIERS = ("free", "paid")
API_PROVIDERS = ("openai", "anthropic")

# Seniority ladder, lowest first.
SENIORITY_LADDER = (
    "Junior", "Mid", "Senior", "Lead", "Staff",
    "Principal", "Manager", "Director", "VP",
)

# Composite score: weights in percent.
ATS_WEIGHT = 45
ROLE_WEIGHT = 55

# Limits.
FREE_SCREENS_PER_MONTH = 5
HISTORY_ROWS_PER_USER = 200
MIN_BATCH_FOR_INTELLIGENCE = 3
MAX_TEXTS_PER_BATCH = 10
MAX_URLS_PER_BATCH = 20
MAX_POSTING_IDS = 20
REPORT_EXPIRY_DAYS = 30
MINUTES_SAVED_PER_REJECT = 12
REASON_LINE_CHARS = 90
MAX_FILE_BYTES = 5 * 1024 * 1024
MAX_TEXT_CHARS = 50_000
CONTROL_CHAR_PERCENT = 15
TOP_SKILLS = 8

# Whitespace as ECMAScript defines it for trim() and \s: once as the characters
# themselves, once as a character class valid in Java regex and in RE2.
WS_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
# Characters that count as binary noise in a text.
CONTROL_CHARS = r"[\x00-\x08\x0B\x0E-\x1F\x7F]"

# Reasons for refusing a document or text.
EMPTY_TEXT = "Resume is empty or could not be read"
BINARY_TEXT = "File content appears to be binary or corrupt"
LONG_TEXT = "File text exceeds 50,000 characters — please trim your resume"
NOT_PDF = "File does not appear to be a valid PDF"
ACTIVE_PDF = "PDF contains active content and cannot be processed"
UNSUPPORTED_FILE = "Only PDF and .txt files are supported."
ACTIVE_PDF_CONTENT = r"/JavaScript\s*\(|/JS\s*\(|/AA\s*<<"

# A link is a job posting when it matches any of these (case-insensitive).
JOB_LINK_PATTERNS = (
    r"/jobs/[^/\s?#]+",
    r"/job/[^/\s?#]+",
    r"/careers/[a-zA-Z0-9_-]+",
    r"/career/[a-zA-Z0-9_-]+",
    r"/openings/[^/\s?#]+",
    r"/positions/[^/\s?#]+",
    r"/apply/[^/\s?#]+",
    r"/posting/[^/\s?#]+",
    r"/opportunities/[^/\s?#]+",
    r"/role/[^/\s?#]+",
    r"greenhouse\.io/.+/jobs/\d+",
    r"jobs\.lever\.co/.+/[a-f0-9]{8}-[a-f0-9]{4}",
    r"myworkdayjobs\.com",
    r"icims\.com/jobs/\d+",
    r"jobs\.smartrecruiters\.com",
    r"jobs\.ashbyhq\.com/.+/[a-f0-9]{8}-[a-f0-9]{4}",
    r"linkedin\.com/jobs/view/\d+",
    r"indeed\.com/viewjob",
    r"ats\.rippling\.com",
    r"bamboohr\.com/careers/\d+",
    r"jobvite\.com/[^/]+/job/",
)
POSTING_URL = "https://www.linkedin.com/jobs/view/%s/"

# Columns of the batch export, in file order.
EXPORT_COLUMNS = (
    "Job Title", "Company", "URL", "ATS Score", "Role Level Score",
    "Composite Score", "Verdict", "Hard Reject Reasons", "Screened At",
)
RANKED_COLUMNS = ("Company", "Job Title", "ATS %", "Role Fit %", "Composite %", "Verdict")

# Our own cut-offs, where the data contract leaves them open.
STRONG_AT = 80
DECENT_AT = 60
HIGH_DEMAND_PERCENT = 60
MODERATE_PERCENT = 30
POINTS_PER_LEVEL = 20
UNKNOWN_LEVEL_SCORE = 50
