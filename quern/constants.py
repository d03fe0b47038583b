"""Fixed values of the data model, in one place."""

#: Markers of the case-sensitive line classifier, in the order they are tried.
CRITICAL_MARKS = (
    "error[", "ERROR:", "Error:", ": error:", "error TS", "FAILED", "FAIL:", "FAIL\t", "panic:", "Traceback (most recent",
    "exception:", "fatal:", "FATAL:", "✗", "× ",
)
NOISE_MARKS = (
    "Compiling ", "Downloading ", "Fetching ", "Checking ", "Blocking waiting for ", "Locking ", "Downloaded ", "Unpacking ",
    "Installing ", "npm warn ", "[DEBUG]", "[TRACE]", "DEBUG:", "TRACE:", "Refreshing state",
)
NOISE_STARTS = ("DEBUG ", "TRACE ")
IMPORTANT_MARKS = (
    "warning[", "WARNING:", "Warning:", "WARN:", "modified:", "deleted:", "new file:", "renamed:", "diff --git", "@@ -", "--- a/",
    "+++ b/", "test result:", "Tests:", "PASSED", "passed", "✓", "...ok", "ok (", "syntax ok", "all ok", "Successfully built", "Finished",
)

#: Markers of the block classifier, on lower-cased text.
FAILURE_MARKS = ("error:", "error[", "fatal:", "exception:", "panic:", "build failed", "--- fail")
FAIL_GLYPHS = "✗✘❌"
PASS_GLYPHS = "✓✔✅"
PROGRESS_STARTS = ("compiling ", "downloading ", "fetching ", "building ")
DIAGNOSTIC_MARKS = ("warning:", "deprecated:", "deprecation warning", "test result:", "--- pass", "diff --git")
TOOL_CRITICAL = {
    "cargo": ("error[e", "panicked at", "could not compile"), "rustc": ("error[e", "panicked at", "could not compile"),
    "npm": ("npm err!", "uncaught exception", "failed to compile"), "yarn": ("npm err!", "uncaught exception", "failed to compile"),
    "node": ("npm err!", "uncaught exception", "failed to compile"),
    "pytest": ("traceback (most recent call last):", "failed (", "fatal error"), "python": ("traceback (most recent call last):", "failed (", "fatal error"),
}
TOOL_DIAGNOSTIC = {"cargo": ("warning:",), "rustc": ("warning:",), "npm": ("npm warn", "warning"), "yarn": ("npm warn", "warning")}

#: Lines after a critical one that are promoted, and the score they get.
BOOST_LINES = 5
BOOST_SCORE = 0.7
CONTEXT_BOOST_CAP = 0.4
KEEP_SCORE = 0.3

#: Windows, floors and bounds of the operators.
RERUN_WINDOW_SECS = 300
RERUN_MIN_SAMPLES = 8
POST_HOOK_FIX_TS = 1784731675
SKEW_LIMIT = 3.0
CACHE_READ_RATE = 0.10
MEANINGFUL = 0.90

MIN_GAIN_INPUT = 200
MIN_LEDGER_INPUT = 264
RUN_GAIN = 150
PROJECT_MULT = 3
WHOLE_OUTPUT = 1024
MIN_REDUCTION_PCT = 95
HANDLE_CHARS = 16

COLLAPSE_MIN_GROUP = 3
COLLAPSE_RATIO = 0.50
COLLAPSE_MIN_LINES = 10

MAX_PARSE_BYTES = 1_000_000
NDJSON_SAMPLE = 50
MIN_DELIMITED = 3

BYTES_PER_TOKEN = {"code": 3.2, "prose": 4.5, "json": 2.8, "build_log": 3.8, "mixed": 3.6}

WORKING_DAYS = 30
TRACE_DAYS = 7
SESSION_GAP_SECS = 240 * 60
PRESSURE_WINDOW = 200_000
PRESSURE_WARN = 0.65
PRESSURE_CRITICAL = 0.82
BUDGET_CAUTION = 60
BUDGET_STOP = 80
ESCALATE = 90

HOST_OUTPUT_CAP = 30_000
MAX_ERRORS = 5

#: Route thresholds by mode: keep, soft.
ROUTE_MODES = {
    "debug": (0.90, 0.50), "conservative": (0.75, 0.40), "balanced": (0.70, 0.30), "auto": (0.70, 0.30), "efficient": (0.60, 0.20),
    "aggressive": (0.60, 0.20),
}
MARKER = "[fold: "
