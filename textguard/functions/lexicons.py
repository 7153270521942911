"""Fixed values of the screening rules.

FIXED VALUES: every list, pattern, weight and message in this module must equal the
behaviour being reproduced, character for character and in this order. They are
stated plainly, together, in natural order. Nothing else lives here.
"""

# ---------------------------------------------------------------- PII (masking side)
# (type, pattern, confidence) in evaluation order; patterns are matched case-insensitively.
PII_RULES = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.95),
    ("phone", r"(\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", 0.90),
    ("ssn", r"\b\d{3}[-]?\d{2}[-]?\d{4}\b", 0.85),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", 0.80),
    ("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.75),
    ("date_of_birth", r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)\d{2}\b", 0.70),
    ("zip_code", r"\b\d{5}(?:-\d{4})?\b", 0.65),
]

# Span-conflict priority; any type not listed has priority 1.
TYPE_PRIORITY = {"credit_card": 3, "ssn": 3, "email": 2, "phone": 1, "name": 0, "location": 0}
DEFAULT_TYPE_PRIORITY = 1

# Values that are never PII (searched case-insensitively inside the matched value).
PLACEHOLDER_VALUE_PATTERNS = [
    r"example\.com", r"test\.com", r"sample\.com",
    r"123-45-6789", r"000-00-0000", r"111-11-1111",
    r"1234-5678-9012-3456", r"0000-0000-0000-0000",
]

# A zip code within 20 characters of one of these is taken as arithmetic.
ZIP_CONTEXT_CHARS = 20
MATH_INDICATORS = ["+", "-", "*", "/", "=", "plus", "minus", "times", "divided", "equals", "sum", "add"]

# Default masking strategy per type; types not listed use "token".
DEFAULT_MASK_STRATEGY = {
    "email": "partial",
    "phone": "partial",
    "ssn": "full",
    "credit_card": "partial",
    "ip_address": "token",
    "date_of_birth": "full",
    "zip_code": "token",
}
MASK_STRATEGIES = ["token", "partial", "hash", "full"]

# Token / hash labels of the dedicated maskers; other types use upper(type).
TOKEN_LABEL = {"email": "EMAIL", "phone": "PHONE", "ssn": "SSN", "credit_card": "CREDIT_CARD", "ip_address": "IP"}
HASH_LABEL = {"email": "EMAIL_HASH", "phone": "PHONE_HASH", "ssn": "SSN_HASH", "credit_card": "CC_HASH",
              "ip_address": "IP_HASH"}
REDACTED = "[REDACTED]"
HASH_HEX_CHARS = 8

# ---------------------------------------------------------------- secrets
API_KEY_PATTERNS = [r"sk-[a-zA-Z0-9]{32,}", r"pk_[a-zA-Z0-9]{32,}", r"[a-zA-Z0-9]{32,}"]
API_KEY_MIN_ENTROPY = 3.5
API_KEY_CONFIDENCE = 0.85
PASSWORD_PATTERNS = [r"password\s*[:=]\s*([^\s]+)", r"passwd\s*[:=]\s*([^\s]+)", r"pwd\s*[:=]\s*([^\s]+)"]
PASSWORD_CONFIDENCE = 0.80
TRIVIAL_PASSWORDS = ["password", "123456", "admin", "test", "demo", "qwerty"]
TRIVIAL_PASSWORD_MIN_LEN = 6
API_KEY_MASK = "[API_KEY_REDACTED]"
PASSWORD_MASK = "[PASSWORD_REDACTED]"

# ---------------------------------------------------------------- prompt screen
JAILBREAK_PATTERNS = [
    r"ignore\s+(?:all\s+)?previous\s+(instructions?|prompts?|rules?)",
    r"ignore\s+(previous|all|above)\s+(instructions?|prompts?|rules?)",
    r"forget\s+(everything|all|previous)",
    r"act\s+as\s+(dan|jailbroken|developer|admin|root|system|god|anything)",
    r"act\s+as\s+(if\s+)?you\s+(are|were)\s+(not\s+)?(an\s+)?ai",
    r"pretend\s+(to\s+be|you\s+are)",
    r"roleplay\s+as",
    r"you\s+are\s+now\s+(dan|jailbroken|free)",
    r"system\s+prompt\s+(override|bypass)",
    r"developer\s+mode",
    r"admin\s+access",
    r"sudo\s+mode",
    r"jailbreak",
    r"prompt\s+injection",
    r"ignore\s+safety",
    r"disable\s+safety",
    r"override\s+safety",
]
JAILBREAK_WEIGHT_TENTHS = 2  # 0.2 per pattern, uncapped

# Prompt-side PII presence: (type, pattern), matched case-sensitively.
PROMPT_PII_RULES = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"(\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"),
    ("ssn", r"\b\d{3}-?\d{2}-?\d{4}\b"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    ("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
]
PROMPT_PASSWORD_PATTERN = r"password\s*[:=]\s*(\S+)"

PLACEHOLDER_TOKENS = ["admin", "administrator", "test", "tester", "demo", "user", "guest",
                      "example", "sample", "password", "pass", "foo", "bar", "baz"]
PLACEHOLDER_EMAIL_DOMAINS = ["example.com", "example.org", "test.com", "test.org", "invalid", "localhost"]
DISPOSABLE_EMAIL_DOMAINS = ["mailinator.com", "10minutemail.com", "guerrillamail.com", "tempmail.com"]
PLACEHOLDER_CONTEXT_WORDS = ["example", "placeholder", "sample", "demo", "test"]
TRIVIAL_PASSWORD_SUBSTRINGS = ["password", "admin", "qwerty", "letmein", "123", "abc"]
PROMPT_PASSWORD_MIN_LEN = 8
PROMPT_PASSWORD_MIN_ENTROPY = 2.5

NER_LABELS_ALWAYS = ["PERSON"]
NER_LABELS_LONG = ["ORG", "GPE"]
# The reference also skips its own product name; that sixth word is not reproduced here.
NER_SKIP_WORDS = ["api", "ai", "llm", "gpt", "openai"]

# Leetspeak fold: each character of the first string maps to the same position of the second.
LEET_FROM = "@431!|$57+098"
LEET_TO = "aaeiiissttogb"
ZERO_WIDTH_CLASS = "[\u200B-\u200D\uFEFF]"

# Prompt/response lexicon (substring match), 0.2 each.
LEXICON_KEYWORDS = [
    "hate", "kill", "violence", "suicide", "bomb", "terrorist", "racist",
    "sexist", "harassment", "abuse", "threat", "harm", "dangerous",
    "idiot", "stupid", "dumb", "moron", "trash", "shut up", "kys",
    "die", "hate you", "worthless", "disgusting", "pig",
]
HARMFUL_PHRASES = ["how to make", "instructions for", "step by step"]
HARMFUL_WORDS = ["bomb", "weapon", "poison", "harm"]

# ---------------------------------------------------------------- output filter
TOXICITY_KEYWORDS = [
    "hate", "kill", "violence", "suicide", "bomb", "terrorist", "racist",
    "sexist", "harassment", "abuse", "threat", "harm", "dangerous",
    "idiot", "stupid", "dumb", "moron", "trash", "shut up", "kys",
    "die", "hate you", "worthless", "disgusting", "pig", "asshole",
    "bitch", "bastard", "fuck", "damn", "hell",
]
NEGATIVE_WORDS = [
    "terrible", "awful", "horrible", "disgusting", "revolting",
    "pathetic", "useless", "worthless", "stupid", "idiotic",
    "hateful", "vicious", "cruel", "brutal", "savage",
]
POSITIVE_WORDS = ["good", "great", "excellent", "wonderful", "amazing", "fantastic", "love", "happy"]
AGGRESSIVE_PHRASES = [
    "you should die", "kill yourself", "go to hell", "fuck off",
    "shut the fuck up", "you're worthless", "nobody cares",
]
# Weights in tenths: keyword 0.2, phrase 0.5, strongly negative sentiment 0.3.
KEYWORD_TENTHS, PHRASE_TENTHS, SENTIMENT_TENTHS = 2, 5, 3
SENTIMENT_PENALTY_BELOW = -0.5
SENTIMENT_SCALE = 10

BIAS_PATTERNS = [
    ("gender", [
        r"all\s+(men|women|males|females)\s+(are|do|can't)",
        r"(typical|all)\s+(male|female|man|woman)\s+(behavior|trait)",
        r"(men|women)\s+(always|never|can't)\s+",
        r"(he|she)\s+(should|must|can't)\s+(because\s+)?(he|she)\s+is\s+(a\s+)?(man|woman)",
    ]),
    ("racial", [
        r"all\s+(black|white|asian|hispanic|latino|arab|muslim|jewish)\s+(people|men|women)\s+",
        r"(typical|all)\s+(black|white|asian|hispanic|latino|arab|muslim|jewish)\s+",
        r"(race|ethnicity)\s+(determines|means|explains)",
    ]),
    ("religious", [
        r"all\s+(christians|muslims|jews|hindus|buddhists|atheists)\s+",
        r"(typical|all)\s+(christian|muslim|jewish|hindu|buddhist|atheist)\s+",
        r"(religion|faith)\s+(makes|means|explains)\s+",
    ]),
]
# Defined by the reference but never evaluated there; off unless asked for.
AGE_BIAS_PATTERNS = [
    r"all\s+(old|young|elderly|teenagers|millennials|boomers)\s+(people|men|women)\s+",
    r"(typical|all)\s+(old|young|elderly|teenager|millennial|boomer)\s+",
    r"(age|generation)\s+(determines|means|explains)",
]
BIAS_TENTHS_PER_TYPE = 3

OUTPUT_JAILBREAK_PATTERNS = [
    r"i\s*['']?\s*(ll|will|can|am\s+going\s+to)\s+ignore\s+(my\s+)?(safety\s+)?(guidelines|instructions|rules)",
    r"i\s+(am|have)\s+(now|been)\s+(in|entered)\s+(developer|admin|root|jailbreak|unrestricted)\s+mode",
    r"i\s+can\s+(now|now\s+can)\s+bypass\s+(my\s+)?(restrictions|safety|guidelines)",
    r"i\s+(will|can|'ll)\s+act\s+as\s+(if\s+)?(i\s+am|i'm)\s+not\s+(an\s+)?ai",
    r"i\s+(will|can|'ll)\s+(now|now\s+can)\s+(do|say|provide)\s+anything",
    r"safety\s+(has\s+)?(been\s+)?(disabled|turned\s+off|bypassed)",
    r"i\s+(am|have)\s+(now|been)\s+free\s+(from|of)\s+(restrictions|guidelines)",
    r"i\s+(will|can|'ll)\s+ignore\s+(all\s+)?(previous\s+)?(safety\s+)?(concerns|warnings)",
    r"developer\s+mode\s+(activated|enabled|on)",
    r"jailbreak\s+(successful|complete|activated)",
    r"i\s*['']?\s*(ll|will)\s+ignore",
]
OUTPUT_JAILBREAK_TENTHS = 4

SEVERITY_LEVELS = ["low", "medium", "high", "critical"]
DEFAULT_SANITIZATION = {"toxicity": "censor", "bias": "warn", "jailbreak": "block"}

MSG_TOXIC_WHOLE = "[REDACTED - Toxic content detected]"
MSG_TOXIC_PREFIX = "[Content censored due to toxicity detection]\n"
MSG_BIAS_PREFIX = "[Content censored - {} bias detected]\n"
MSG_JAILBREAK_WHOLE = "[REDACTED - Jailbreak indicators detected]"
MSG_WARN_PREFIX = "⚠️ WARNING: This response has been flagged for potentially harmful content.\n\n"
MSG_BLOCKED = "[RESPONSE BLOCKED - Toxic content detected]"
MSG_REFUSED = "Your message has been flagged for security reasons. Please rephrase your request."

# Explanation formats.
EXPL_JAILBREAK = "Jailbreak attempt detected. Patterns found: "
EXPL_PII = "PII detected: "
EXPL_NER = "Named entities detected: "
EXPL_LEXICON = "Toxic content detected. Keywords: "
EXPL_HARMFUL = "Potentially harmful instructions detected"
EXPL_PII_MASKED = "PII detected and masked"
EXPL_TOXICITY = "Toxicity detected (score: {})"
EXPL_BIAS = "Bias detected: "
EXPL_OUTPUT_JAILBREAK = "Jailbreak indicators detected in response"
EXPL_SEP = " | "
LIST_SEP = ", "
EXPLANATION_ITEMS = 3

# ---------------------------------------------------------------- canned replies (no model)
INTENT_WORDS = [
    ("greeting", ["hello", "hi", "hey", "greetings"]),
    ("help", ["help", "assist", "support"]),
    ("question", ["what", "who", "how", "why", "when", "where"]),
]

# ---------------------------------------------------------------- model-side thresholds
MODEL_PII_THRESHOLDS = {
    "email": 0.7, "phone": 0.6, "ssn": 0.8, "credit_card": 0.7, "ip_address": 0.6,
    "date_of_birth": 0.7, "zip_code": 0.5, "name": 0.6, "location": 0.6,
}
MODEL_SPAN_STRIP_CHARS = ".,;:!?)"
MODEL_SPAN_MIN_LEN = 3
MODEL_SPAN_MERGE_GAP = 2
TOXICITY_MODEL_DETECT = 0.5
TOXICITY_MODEL_SEVERITY = [(0.8, "high"), (0.6, "medium")]  # else "low"
BIAS_MODEL_LABELS = ["gender", "racial", "religious"]
BIAS_MODEL_DETECT = 0.5
BIAS_MODEL_SEVERITY = [(0.7, "high"), (0.4, "medium"), (0.2, "low")]

# ---------------------------------------------------------------- analytics
TRUNC_TITLE, TRUNC_EVENT_MESSAGE, TRUNC_PREVIEW = 50, 500, 100
ELLIPSIS = "..."
RECENT_EVENTS_CAP = 500
RECENT_SCAN = 200
HEALTH_BANDS = [(80, "green", "Excellent"), (60, "yellow", "Good")]
HEALTH_ELSE = ("red", "Needs Attention")
USER_ROLES = ["USER", "ADMIN", "MODERATOR"]

# Beginnings of a stored reply that stands for a filtered one (FIXED VALUES).
FILTERED_REPLY_PREFIXES = ["[REDACTED", "[RESPONSE BLOCKED", "[Content censored"]
