"""Word lists, patterns and seed rows.

FIXED VALUES — these must equal the behaviour being matched (keyword lists,
shortener domains, sender and URL patterns, dimension seeds, limits). They are
stated plainly, in their natural order, and read by both the Spark code and the
SQL oracles.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: limits and vectoriser settings
# ---------------------------------------------------------------------------
MAX_EMAIL_LENGTH = 10000
MAX_UPLOAD_BYTES = 16 * 1024 * 1024
ALLOWED_EXTENSIONS = ("txt", "eml", "msg")
MAX_FEATURES = 3000
MIN_DF = 2
MAX_DF = 0.95
SUBLINEAR_TF = True
TEST_SIZE = 0.2
SEED = 42
HIGH_RISK = 70
WARN_RISK = 40
REJECT_EMPTY, REJECT_LONG, REJECT_LARGE = "empty", "too_long", "too_large"
MODEL_NAMES = ("random_forest", "svm", "ensemble")

# ---------------------------------------------------------------------------
# FIXED VALUES: keyword lists (substring match on the lower-cased text)
# ---------------------------------------------------------------------------
# 10-word list of the batch feature dict
KEYWORDS_10 = [
    "urgent", "verify", "suspended", "click here", "limited time",
    "act now", "congratulations", "winner", "lottery", "prize",
]
# 20-word configured list (risk score, old-stack keyword count)
KEYWORDS_20 = [
    "urgent", "verify", "suspended", "click here", "limited time",
    "act now", "congratulations", "winner", "lottery", "prize",
    "free money", "guaranteed", "risk free", "no obligation",
    "dear sir/madam", "dear customer", "update payment",
    "confirm identity", "account suspended", "security alert",
]
# 5-word list of the live metadata vector
KEYWORDS_5 = ["verify", "click", "suspended", "limited", "expires"]
# 4-word urgency list of the live metadata vector
URGENT_4 = ["urgent", "immediate", "asap", "hurry"]
# 10-word urgency list of the old feature stack
URGENCY_10 = [
    "urgent", "immediate", "asap", "hurry", "quickly", "deadline",
    "expires", "limited time", "act now", "don't delay",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: URL and sender patterns
# ---------------------------------------------------------------------------
# URL finder with the unescaped $-_ range (path characters match)
URL_PATTERN_RANGE = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
# URL finder with the escaped class (stops at the first '/' after the host)
URL_PATTERN_ESCAPED = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$\-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
IP_PATTERN_LOOSE = r"\d+\.\d+\.\d+\.\d+"
IP_PATTERN_BOUNDED = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
SHORTENERS_4 = ["bit.ly", "tinyurl.com", "goo.gl", "t.co"]
SHORTENERS_5 = ["bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly"]
SENDER_PATTERNS = [r"noreply@", r"donotreply@", r"[0-9]+@", r"@[0-9]+\.", r"[a-z]+[0-9]+@"]

# ---------------------------------------------------------------------------
# FIXED VALUES: dimension seeds (keyword, category, weight) etc.
# ---------------------------------------------------------------------------
KEYWORD_SEED = [
    ("urgent", "urgency", 5.0),
    ("verify", "verification", 4.0),
    ("suspended", "threat", 6.0),
    ("click here", "call_to_action", 4.5),
    ("limited time", "urgency", 5.5),
    ("act now", "urgency", 5.0),
    ("congratulations", "prize", 4.0),
    ("winner", "prize", 4.5),
    ("lottery", "prize", 6.0),
    ("prize", "prize", 4.0),
    ("free money", "offer", 7.0),
    ("guaranteed", "offer", 3.5),
    ("risk free", "offer", 4.0),
    ("no obligation", "offer", 3.0),
    ("confirm identity", "verification", 5.5),
    ("account suspended", "threat", 7.0),
    ("security alert", "threat", 5.0),
    ("update payment", "financial", 6.0),
    ("wire transfer", "financial", 7.5),
    ("social security", "personal_info", 8.0),
]
URL_PATTERN_SEED = [
    (r"bit\.ly", "shortened", 3.0),
    (r"tinyurl\.com", "shortened", 3.0),
    (r"goo\.gl", "shortened", 3.0),
    (r"t\.co", "shortened", 2.5),
    (r"ow\.ly", "shortened", 3.0),
    (r"\d+\.\d+\.\d+\.\d+", "suspicious", 6.0),
    (r"[a-z]+\d+[a-z]+\.com", "suspicious", 4.0),
    (r"secure.*bank.*\.tk", "suspicious", 8.0),
    (r"paypal.*verify.*\.tk", "suspicious", 9.0),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: English stop words (Spark's StopWordsRemover default list)
# ---------------------------------------------------------------------------
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd",
    "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've",
    "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't",
    "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't",
    "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's",
    "where's", "who's", "why's", "would",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: suffix tables of Porter's algorithm, steps 2 to 4, in the order they are tried
# ---------------------------------------------------------------------------
PORTER_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
PORTER_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
PORTER_STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
