"""Results are only right when these equal the published ones."""

# The 25 page features, in model order.
TAG_FEATURES = [
    "total_tag_count", "unique_tag_count", "depth_of_dom_tree", "average_children_per_node",
    "count_form", "count_input", "count_script", "count_img", "count_iframe", "count_link",
    "count_meta",
]
STRUCTURE_FEATURES = ["dom_entropy", "dom_token_count", "dom_length_bytes", "ratio_interactive_tags"]
SIMILARITY_FEATURES = [
    "ncd_phish_cluster_1_min", "ncd_phish_cluster_1_avg",
    "ncd_phish_cluster_2_min", "ncd_phish_cluster_2_avg",
    "ncd_phish_cluster_3_min", "ncd_phish_cluster_3_avg",
    "ncd_legit_min", "ncd_legit_avg", "ncd_phish_best", "ncd_phish_avg",
]
FEATURES = TAG_FEATURES + STRUCTURE_FEATURES + SIMILARITY_FEATURES

# Prototype sets behind the similarity features.
PHISH_SETS = ["phish_cluster_1", "phish_cluster_2", "phish_cluster_3"]
LEGIT_SET = "legit"

# Thresholds.
SMALL_DOM_THRESHOLD = 2000
MINIMAL_DOM_THRESHOLD = 300
MINIMAL_DOM_PENALTY = 0.05
NEAREST_THRESHOLD = 0.48
ML_GATE = 0.6
MIN_VARIANCE_GAIN = 0.001
DEFAULT_K = 5
MAX_CLUSTERS = 4
MIN_TRAINING_SAMPLES = 10

# Elements dropped with their content, and elements that never hold content.
REMOVED_ELEMENTS = ["script", "style", "noscript"]
VOID_ELEMENTS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem",
    "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame",
    "image", "isindex", "nextid", "spacer",
]

# Sanitizing modes and detection modes.
TAGS_ONLY = "tags_only"
TAGS_ATTRS = "tags_attrs"
MODE_RESOURCES = "resource-signature"
MODE_DOM = "dom-structure"

# Answer texts.
DETAIL_PAGE_PREFIX = "https://phishtank.com/phish_detail.php?phish_id="
LOOKUP_SOURCE = "phishtank-local"
LOOKUP_SKIPPED = "skipped"
UNVERIFIED_SOURCE = "phishtank_unverified"
SIGNATURE_SOURCE = "signature-local"
SKIPPED_MESSAGE = "URL not found in PhishTank database, NCD analysis skipped"
ERROR_NO_DOM = "Unable to extract DOM from URL."
ERROR_NO_PROTOTYPES = "No prototypes available."
ERROR_NOT_FETCHED = "Unable to fetch DOM"

# Explanations; scores are filled in with four decimals.
DECISION_PHISH_MINIMAL = "Phishing prototype match ({phish}) better than adjusted legitimate ({adjusted}, original: {legit})"
DECISION_PHISH = "Phishing prototype match ({phish}) better than legitimate ({legit})"
DECISION_LEGIT_MINIMAL = "Legitimate prototype match ({adjusted}, original: {legit}) better than phishing ({phish})"
DECISION_LEGIT = "Legitimate prototype match ({legit}) better than phishing ({phish})"
REASON = (
    "Classified as {verdict}. Phishing prototype distances: min={phish}, avg={phish_avg}. "
    "Legitimate prototype distances: min={legit}, avg={legit_avg}. {penalty}{decision}"
)
REASON_PENALTY = "Minimal DOM penalty applied (+{amount}). "

# Certificate probe answers, first matching keyword wins.
SSL_MESSAGES = [
    ("EOF", "SSL connection interrupted"),
    ("CERTIFICATE_VERIFY_FAILED", "Certificate verification failed"),
    ("HANDSHAKE", "SSL handshake failed"),
    ("TIMEOUT", "SSL connection timeout"),
    ("CONNECTION", "SSL connection error"),
]
SSL_OTHER = "SSL error (certificate unavailable)"
PROBE_MESSAGES = {
    "timeout": "Connection timeout",
    "dns": "DNS resolution failed",
    "refused": "Connection refused",
}
PROBE_OTHER = "Certificate unavailable"
HTTP_ONLY = "HTTP only (no SSL)"
UNKNOWN = "unknown"
NO_PTR = "no PTR record"
