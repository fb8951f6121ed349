"""Word lists, patterns and limits that results must agree on."""

from __future__ import annotations

# Retrieval constants.
SPAN_SECONDS = 30.0
PAUSE_GAP_SECONDS = 2.0
BLOCK_SECONDS = 120
TEXT_BUDGET = 24000
TARGETED_FRAMES = 12
COVERAGE_FRAMES = 32
NUMERIC_GUARD_CAP = 12
FACET_EXPANSION_TOP = 3
SPAN_RESCUE_TOP = 8
SPAN_RESCUE_PER_CHAPTER = 2
QUESTION_TERM_WEIGHT = 2
FUZZY_MIN_LEN = 5
NOTE_LIMIT = 3
FRAME_DEDUPE_SECONDS = 20.0
CHAPTER_FRAME_OFFSET = 10.0
EVIDENCE_TOKEN_CAP = 25000
TOKENS_PER_CHAR = 0.25
TOKENS_PER_FRAME = 250
MIN_FRAMES = 4
MIN_EVIDENCE_SECONDS = 540
LEXICAL_LIMIT = 16
LEXICAL_SEEDS = 8
MAX_EXPANSIONS = 4
RANK_FUSION_K = 60

# Words the evidence tokenizer drops.
STOPWORDS = (
    "the a an and or of to in is it for on with that this you i we they as at be are "
    "was were do does did have has had not so if then than but about into just like "
    "can could would will your my our their its what how why when where which there here"
).split()

# Facet word lists.
FACETS = {
    "cost": ["price", "pricing", "cost", "costs", "cheap", "cheaper", "dollar", "dollars",
             "million", "token", "tokens"],
    "speed": ["fast", "faster", "speed", "minute", "minutes", "second", "seconds", "took", "time"],
    "benchmark": ["benchmark", "benchmarks", "score", "scores", "leaderboard", "rank", "best", "top"],
    "features": ["feature", "features", "mode", "modes", "app", "tool", "tools", "does", "can", "new"],
}
NUMERIC_FACETS = ("cost", "speed", "benchmark")

# Words that negate and words that ask about a change in time.
NEGATION = ["no", "not", "never", "without", "cannot", "can't", "won't", "isn't", "doesn't"]
TEMPORAL = ["before", "after", "then", "next", "previous", "change", "become", "start", "end"]
BEFORE_WORDS = ["before", "initial", "first"]
AFTER_WORDS = ["after", "then", "finally", "next"]

# Patterns (Java syntax).
EVIDENCE_TOKEN = "[a-z0-9.']+"
EXACT_TOKEN = "[A-Za-z0-9]+(?:[._:/-][A-Za-z0-9]+)*"
NUMBER = r"(?iU)(?<![\p{L}\p{N}_])(?:[$€£])?\d[\d,.]*(?:%|x|ms|s|gb|mb|kb)?"
COVERAGE_QUESTION = "(?iu)summari|overview|main (stories|points|topics)|everything|all the"
DEICTIC = (
    "(?iu)as you can see|you can see|look at|on ?(the )?screen|right here|this is what"
    "|check (this |it )?out|shown here"
)
NUMERIC = r"[$][0-9]|[0-9]+(\.[0-9]+)?%|per million|[0-9,]+ tokens|[0-9]+ (minutes?|seconds?)"
ROUTE_VISUAL = (
    r"(?iu)\b(?:visible|visual|ui|user interface|on[- ]screen|screen|text|table|"
    r"object|motion|transition|before\s*(?:and|[-/]?)\s*after|graph|chart|plot|"
    r"car\s+(?:move|movement|moving)|person\s+(?:walk|walks|walking)|"
    r"object\s+(?:move|motion|moving)|logo\s+(?:looks?|appears?)|"
    r"animation\s+(?:does|show|shows)|what\s+changed)\b"
)
ROUTE_COVERAGE = r"(?iu)\b(?:coverage|summary|summar(?:y|ize)|all topics|everything|chronology|timeline)\b"
ROUTE_SAID = r"(?iu)\b(?:said|say|explained|explain|spoken|tell me)\b"
TAG = "<[^>]+>"
SENTENCE_END = "[.!?。！？…‼⁇;；]+\\s*"
NON_SPEECH = r"^\s*(?:[\[\(][^\]\)]*[\]\)]|[♪♫\s])+\s*$"
EVIDENCE_MARKER = r"(?iU)UNTRUSTED\s+VIDEO\s+EVIDENCE"
SECRET_KEY = ("(?i)(?:api[_-]?key|authorization|cookie|secret|password|access[_-]?token"
              "|refresh[_-]?token|bearer[_-]?token)")
MEDIA_KINDS = ("audio", "video", "image", "frame", "frames", "crop", "media", "source_media")
SECRET_TEXT = r"(?i)(?:authorization\s*:\s*\S+|(?:api[_-]?key|cookie|password|secret)\s*[=:]\s*\S+)"
HOME_PATH = r"""(?:^|[\s"'=])(/Users/[^\s"'/]+/|/home/[^\s"'/]+/|~/)"""
PRIVATE_PATH = r"""(?m)(?:^|[\s"'=])(/[^\s"']+|~/[^\s"']+|[A-Za-z]:\\[^\s"']+)"""
SIGNED_URL = r"""https?://[^\s"']+[?#][^\s"']+"""
LANGUAGE_TAG = "^[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*$"
CUE_HEADER = (r"^\s*(?:(\d{1,2}):)?(\d{2}):(\d{2})[.,](\d{3})\s+-->\s+"
              r"(?:(\d{1,2}):)?(\d{2}):(\d{2})[.,](\d{3})(?:\s+.*)?$")

# Code points that draw nothing but are not in category Cf.
BLANK_LETTERS = r"\x{034F}\x{115F}\x{1160}\x{3164}\x{FFA0}"
VARIATION_SELECTORS = r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
TAG_BLOCK = r"\x{E0000}-\x{E007F}"
ZERO_WIDTH_SPACE = "\u200b"
LINE_BREAKS = "\r\n|[\r\u2028\u2029\f\u0085]"

# Failure classes in the order they are tried, and the text that shows each.
FAILURE_SIGNS = (
    ("max_filesize_exceeded", ("larger than max-filesize",)),
    ("login_required", ("sign in to confirm", "login required", "authentication required")),
    ("region_locked", ("not available in your country", "geo-restricted", "region")),
    ("private_or_deleted", ("private video", "video unavailable", "has been removed", "deleted")),
    ("unsupported_extractor", ("unsupported url", "no suitable extractor")),
    ("sabr_client", ("sabr", "streaming data is missing", "player response")),
    ("http_429", ("http error 429", "too many requests", "status code 429")),
    ("http_403", ("http error 403", "forbidden", "status code 403")),
    ("network_timeout", ("timed out", "timeout", "connection reset", "temporary failure")),
    ("format_unavailable", ("requested format is not available", "no video formats found")),
)
RETRYABLE_FAILURES = ("sabr_client", "http_403", "http_429", "network_timeout", "format_unavailable")

MEDIA_SUFFIXES = (
    "mp4", "mov", "mkv", "webm", "avi", "m4v", "mp3", "wav", "m4a", "aac", "flac",
    "jpg", "jpeg", "png", "webp", "gif", "bmp",
)

# Frame thinning.
MAX_FPS = 2.0
FRAME_DELTA_THRESHOLD = 2.0
CELL_TOLERANCE = 25
CHANGED_PCT_THRESHOLD = 2.0
WINDOW_SIZE = 4
WINDOW_HORIZON_SECONDS = 90.0
FLOOR_INTERVAL_SECONDS = 30.0
FLOOR_CAP_SHARE = 0.30
SCENE_MIN_FRAMES = 8
KEYFRAME_MIN = 4
FPS_FRAME_CEILING = 5000

# Repetition loops.
LOOP_MIN_CONSECUTIVE = 20
LOOP_DOMINANCE_MIN = 40
LOOP_DOMINANCE_RATIO = 0.6
LOOP_INTRA_MIN_REPEATS = 20
LOOP_MAX_PERIOD = 30

MIN_SPEECH_SECONDS = 0.5
MAX_RECEIPTS = 512

# Evaluation.
RUBRIC = {"correctness": 0.40, "completeness": 0.25, "citation": 0.25, "adherence": 0.10}
BOOTSTRAP_REPLICATES = 10_000
MIN_LATENCY_REPEATS = 30
MIN_P95_OBSERVATIONS = 20
MIN_FAMILIES = 5
MIN_FAMILIES_PER_CLASS = 3

# Request limits.
MAX_QUESTION_BYTES = 16_384
MAX_TEXT_BUDGET = 200_000
MAX_FRAMES = 10_000
DETAILS = ("transcript", "efficient", "balanced", "token-burner", "evidence")
CONTROL_DETAILS = ("transcript", "efficient", "balanced", "token-burner")
DESCRIPTION_LIMIT = 2000

# Fixed values of the artifact tables: enumerations, patterns, required fields and ranges that results must agree on.
PATTERNS = {
    "sha40": "^[0-9a-f]{40}$",
    "sha64": "^[0-9a-f]{64}$",
    "packet_id": "^P[0-9]+[A-Z]?$",
    "utc_timestamp": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$",
}
STATUSES = ["provisional", "complete", "failed", "partial", "invalid"]
RESULT_STATES = ["success", "degraded", "partial", "unavailable", "fatal"]
FAILURE_CLASSES = [
    "sabr_client", "http_403", "http_429", "network_timeout", "format_unavailable", "invalid_source", "login_required",
    "region_locked", "private_or_deleted", "unsupported_source", "cookie_validation", "integrity_refusal",
    "adapter_unavailable", "incomplete_output", "runtime_error",
]
SPLITS = ["tier1", "development", "confirmatory", "external"]
ARMS = ["control", "candidate"]
COMMON = {
    "required": ["schema_version", "artifact_type", "created_at_utc", "packet_id", "status"],
    "enum": {"status": STATUSES},
    "pattern": {"created_at_utc": "utc_timestamp", "packet_id": "packet_id", "control_commit": "sha40",
                "candidate_commit": "sha40", "candidate_config_hash": "sha64", "plan_sha256": "sha64"},
}
ARTIFACTS = {
    "case": {"required": ["case_id", "source_family_id", "split", "question_class"], "enum": {"split": SPLITS},
             "min_items": {"obligations": 1}, "pattern": {"source_metadata_hash": "sha64"}},
    "run": {"required": ["case_id", "arm", "attempt", "order", "result_state", "raw_manifest_path"],
            "enum": {"arm": ARMS, "result_state": RESULT_STATES, "failure_class": FAILURE_CLASSES},
            "positive": ["attempt", "order"], "path": ["raw_manifest_path"]},
    "judgment": {"required": ["case_id", "arm", "refused"], "enum": {"arm": ARMS}, "nonnegative": ["citations_checked"]},
    "retrieval": {"required": ["case_id", "arm", "temporal_iou"], "enum": {"arm": ARMS}},
    "usage": {"required": ["case_id", "arm", "measurement_kind", "measurement_source"],
              "enum": {"arm": ARMS, "measurement_kind": ["reported", "estimated"]}, "positive": ["attempt"],
              "nonnegative": ["reader_text_tokens", "reader_image_tokens", "all_model_input_tokens",
                              "all_model_output_tokens", "calls", "dollars"]},
    "resource": {"required": ["case_id", "arm", "state"], "enum": {"arm": [*ARMS, "noop"], "state": ["cold", "warm"]},
                 "nonnegative": ["wall_ms", "cpu_ms", "peak_rss_bytes", "disk_bytes", "network_bytes", "process_calls",
                                 "initialization_ms"]},
    "asr": {"required": ["case_id", "arm", "language"], "enum": {"arm": ARMS}, "positive": ["reference_words"],
            "nonnegative": ["substitutions", "deletions", "insertions"], "min_items": {"boundary_errors_seconds": 20}},
    "failure": {"required": ["case_id", "arm", "normalized_failure", "final_state"],
                "enum": {"arm": ARMS, "normalized_failure": FAILURE_CLASSES, "final_state": RESULT_STATES}, "positive": ["attempt"]},
    "install_result": {"required": ["operation", "exit_code"], "nonnegative": ["exit_code", "duration_ms", "artifact_bytes"],
                       "enum": {"operation": ["install", "update", "invoke", "rollback", "purge", "uninstall", "reinstall"]}},
    "privacy_scan": {"required": ["secret_class", "artifact_path", "observed_matches", "pass"],
                     "nonnegative": ["observed_matches"], "path": ["artifact_path"]},
    "provenance": {"required": ["mechanism", "disposition", "use_kind"],
                   "enum": {"disposition": ["ship", "evaluate-only", "defer", "exclude"],
                            "use_kind": ["inspiration", "adaptation", "code"]}},
}

# Fixed values of bundle manifests.
BUNDLE_SCHEMA_VERSION = 1
MANIFEST_FIELDS = ["bundle_schema_version", "tool_versions", "schema_versions", "evidence_budget", "completeness_state", "provenance",
                   "media_included", "files"]
COMPLETENESS_STATES = ["complete", "partial", "degraded"]

# Decision rules: split, role, name, metric, scope (None: every one), comparison, bound, required.
DECISION_RULES = [
    ("development", "gate", "quality", "quality.mean", None, ">=", -0.25, True),
    ("development", "gate", "quality", "quality_class.mean", None, ">=", -0.50, False),
    ("development", "gate", "recall", "recall.mean", None, ">=", -0.02, True),
    ("development", "gate", "citation", "citation.mean", None, ">=", -0.02, True),
    ("development", "gate", "completion", "completion.excess", None, "<=", 0.0, True),
    ("confirmatory", "gate", "quality", "quality.lower_95", None, ">", -0.25, True),
    ("confirmatory", "gate", "quality", "quality_class.lower_95", None, ">", -0.50, False),
    ("confirmatory", "gate", "recall", "recall.lower_95", None, ">", -0.02, True),
    ("confirmatory", "gate", "citation", "citation.lower_95", None, ">", -0.02, True),
    ("confirmatory", "gate", "completion", "completion.drop", None, "<=", 0.0, True),
    ("confirmatory", "gate", "targeted_tokens", "tokens.reduction", "targeted", ">=", 0.50, True),
    ("confirmatory", "gate", "coverage_tokens", "tokens.reduction", "coverage", ">=", 0.25, True),
    ("any", "gate", "before_after", "before_after.failed", None, "<=", 0.0, False),
    ("any", "gate", "latency", "latency.excess", None, "<=", 0.0, True),
    ("any", "gate", "asr", "asr.wer", None, "<=", 1.0, True),
    ("any", "gate", "asr", "asr.language_failed", None, "<=", 0.0, True),
    ("any", "gate", "asr", "asr.boundary_median", None, "<=", 0.25, True),
    ("any", "gate", "asr", "asr.boundary_p95", None, "<=", 1.0, True),
    ("any", "gate", "blockers", "blockers.count", None, "<=", 0.0, False),
    ("any", "regression", "answer_quality", "quality.mean", None, "<", -0.10, False),
    ("any", "regression", "evidence_recall", "recall.mean", None, "<", -0.01, False),
    ("any", "regression", "citation_support", "citation.mean", None, "<", -0.01, False),
    ("any", "regression", "completion", "completion.drop", None, ">", 0.0, False),
    ("any", "regression", "total_system_tokens", "usage.tokens", None, ">", 1.02, False),
    ("any", "regression", "total_system_dollars", "usage.dollars", None, ">", 1.02, False),
    ("any", "regression", "total_system_calls", "usage.calls", None, ">", 1.0, False),
    ("any", "regression", "latency", "latency.excess", None, ">", 0.0, False),
    ("any", "regression", "resource_cpu_ms", "resource.cpu_ms", None, ">", 0.0, False),
    ("any", "regression", "resource_peak_rss_bytes", "resource.peak_rss_bytes", None, ">", 0.0, False),
    ("any", "regression", "resource_disk_bytes", "resource.disk_bytes", None, ">", 0.0, False),
    ("any", "regression", "resource_network_bytes", "resource.network_bytes", None, ">", 0.0, False),
    ("any", "regression", "resource_process_calls", "resource.process_calls", None, ">", 0.0, False),
    ("any", "regression", "resource_initialization_ms", "resource.initialization_ms", None, ">", 0.0, False),
    ("any", "improvement", "quality", "quality.mean", None, ">", 0.10, False),
    ("any", "improvement", "reader_tokens", "tokens.reduction", None, ">", 0.02, False),
    ("any", "improvement", "total_system_cost", "usage.dollars", None, "<", 0.98, False),
    ("any", "improvement", "recall", "recall_class.mean", None, ">", 0.01, False),
    ("any", "improvement", "citation", "citation_class.mean", None, ">", 0.01, False),
]
