"""Fixed values.

Word lists, patterns, formats and rule texts that log producers and earlier
results fix for us. They are data, kept together and in their natural order;
nothing here computes anything.
"""

# --- levels -----------------------------------------------------------------

LEVEL_WORDS = {
    "ERROR": ["E", "ERR", "ERROR", "FATAL", "CRIT", "CRITICAL", "SEVERE", "PANIC", "EMERG", "ALERT"],
    "WARN": ["W", "WARN", "WARNING"],
    "INFO": ["I", "INFO", "INF", "NOTICE"],
    "DEBUG": ["D", "DEBUG", "DBG"],
    "TRACE": ["T", "TRACE", "VERBOSE"],
}
ERROR_LEVELS = ["ERROR", "CRITICAL"]

# Numeric levels of JSON loggers of the Bunyan / Pino family (opt-in).
NUMERIC_LEVELS = {"10": "TRACE", "20": "DEBUG", "30": "INFO", "40": "WARN", "50": "ERROR", "60": "ERROR"}

# Syslog severity 0..7.
SEVERITY_LEVELS = ["CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"]

ERROR_KEYWORDS = ["failed", "error", "fatal", "critical", "denied", "segfault", "panic"]
WARN_KEYWORDS = ["warn", "warning"]

# --- key aliases ------------------------------------------------------------

JSON_TIME_KEYS = ["@timestamp", "timestamp", "time", "ts", "datetime", "date", "created_at"]
JSON_LEVEL_KEYS = ["level", "severity", "log_level", "lvl", "loglevel", "type"]
JSON_MESSAGE_KEYS = ["message", "msg", "log", "text", "event", "description", "details"]
JSON_SERVICE_KEYS = ["service", "service_name", "app", "application", "name", "component", "logger", "source"]
JSON_ERROR_KEYS = ["error", "exception", "stack_trace"]

LOGFMT_TIME_KEYS = ["ts", "time", "timestamp", "datetime", "date", "@timestamp"]
LOGFMT_LEVEL_KEYS = ["level", "lvl", "severity"]
LOGFMT_MESSAGE_KEYS = ["msg", "message", "event"]
LOGFMT_SERVICE_KEYS = ["service", "app", "caller", "source", "component"]

# --- line patterns ----------------------------------------------------------
# (?d): only \n ends a line.

ACCESS_LOG_PATTERN = (
    r'(?d)^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+([^"]*?)(?:\s+HTTP/[\d.]+)?"'
    r'\s+(\d{3})\s+(\d+|-)(?:\s+"([^"]*)"\s*"([^"]*)")?.*$'
)
SYSLOG_3164_PATTERN = (
    r"(?d)^([A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+([a-zA-Z0-9_.-]+)\s+([a-zA-Z0-9_./-]+)"
    r"(?:\[(\d+)\])?:\s+(.*)$"
)
SYSLOG_5424_PATTERN = (
    r"(?d)^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:\[(.*?)\]|-(?=\s|$))?\s*(.*)$"
)
SPRING_HEADER_PATTERN = (
    r"(?d)^(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s+(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)"
    r"\s+(\d+)\s+---\s+\[(.*?)\]\s+(\S+)\s*:\s*(.*)$"
)
GENERIC_PATTERN = (
    r"(?di)^\[?(\d{4}[-/.]\d{2}[-/.]\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:\s?(?:Z|[+-]\d{2}:?\d{2}))?)\]?"
    r"\s*(?:\[([^\]]+)\])?\s*(?:\[?(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\]?)?"
    r"\s*(?:\[([^\]]+)\])?\s*(?:[-:>|]\s*|\s+)(.*)$"
)
LOGFMT_PAIR_PATTERN = r'[a-zA-Z0-9_.-]+=(?:"[^"]*"|\S+)'

# Detection order: ties go to the earlier format.
FORMATS = ["json", "springboot", "nginx_apache", "syslog", "logfmt", "generic_standard"]
DETECT_LINES = 20
DETECT_MIN_SCORE = 0.1
FALLBACK_SHARE = 0.2
LOGFMT_DETECT_PAIRS = 3
LOGFMT_PARSE_PAIRS = 2

# --- masks, in order --------------------------------------------------------

MASKS = [
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"\b[0-9a-fA-F]{16,64}\b", "<HASH>"),
    (r"\b\d+\b", "<NUM>"),
    (r"https?://\S+", "<URL>"),
    (r"(?:/[\w.-]+)+/?", "<PATH>"),
]
WILDCARD = "<*>"

# --- anomaly rules ----------------------------------------------------------

HISTOGRAM_BUCKETS = 40
MIN_DATED_ROWS = 5
BURST_Z = 2.0
BURST_MIN_ERRORS = 3
BURST_RATE = 0.35
BURST_CRITICAL_RATE = 0.6
HTTP_AUTH_CODES = [401, 403, 429]
HTTP_MIN_ROWS = 5
AUTH_PHRASES = ["failed password", "authentication failure", "invalid credentials", "login failed", "unauthorized"]
AUTH_MIN_ROWS = 4
AUTH_CRITICAL_ROWS = 10
RARE_MAX_SIZE = 2
RARE_MIN_TOTAL = 50

# --- incident rules ---------------------------------------------------------

INCIDENT_RULES = [
    {
        "category": "DATABASE_FAILURE",
        "patterns": [
            r"connection refused",
            r"pool exhausted",
            r"could not obtain connection",
            r"deadlock",
            r"psycopg2\.operationalerror",
            r"hikari.*timeout",
        ],
        "title": "Database Connectivity / Connection Pool Exhaustion",
        "root_cause": "The application backend is unable to acquire or maintain connections to the database. This is typically caused by connection pool saturation, network partition, or the database server rejecting incoming connections under high load.",
        "remediation": [
            "Check database active connections and max_connections limit.",
            "Verify network reachability and database latency metrics.",
            "Inspect application connection pool sizing (e.g. HikariCP, PgPool) and leak detection thresholds.",
            "Look for unclosed transactions or long-running database queries blocking the pool.",
        ],
    },
    {
        "category": "MEMORY_EXHAUSTION",
        "patterns": [
            r"outofmemoryerror",
            r"java heap space",
            r"oomkilled",
            r"gc overhead limit exceeded",
            r"memory error",
        ],
        "title": "Application Memory Saturation / OOM Crash",
        "root_cause": "Process ran out of heap/virtual memory. Garbage collector was unable to reclaim sufficient space, leading to degraded throughput or SIGKILL termination.",
        "remediation": [
            "Inspect heap dumps for memory leaks in large caches or unclosed streams.",
            "Review recent deployments for unbounded memory allocations.",
            "Adjust JVM `-Xmx` or container memory limits in Kubernetes manifest.",
            "Enable Prometheus / CloudWatch memory metrics alerts before reaching 85% utilization.",
        ],
    },
    {
        "category": "CASCADING_TIMEOUT",
        "patterns": [
            r"gateway timeout",
            r"504 gateway",
            r"502 bad gateway",
            r"connect timed out",
            r"read timed out",
            r"circuit breaker open",
        ],
        "title": "Cascading Microservice Timeout / Upstream Degradation",
        "root_cause": "An upstream dependency or downstream microservice failed to respond within the configured timeout window, causing cascading request backpressure and gateway timeouts (HTTP 502/504).",
        "remediation": [
            "Identify the slowest upstream microservice in the distributed trace.",
            "Verify circuit breaker thresholds and fallback behaviors.",
            "Check downstream CPU/memory saturation or thread starvation.",
            "Implement exponential backoff with jitter on retry policies.",
        ],
    },
    {
        "category": "SECURITY_ATTACK",
        "patterns": [
            r"failed password",
            r"invalid jwt",
            r"unauthorized",
            r"forbidden",
            r"signature verification failed",
            r"rate limit exceeded",
            r"401 unauthorized",
        ],
        "title": "Security Anomaly / Credential Stuffing / Auth Failures",
        "root_cause": "Abnormal volume of failed authentications, expired/tampered JWT tokens, or repeated unauthorized access attempts targeting API endpoints.",
        "remediation": [
            "Inspect the offending client IPs and cross-reference with threat intelligence.",
            "Enforce IP rate limiting (WAF / Cloudflare / Nginx limit_req).",
            "Verify if key rotation occurred causing legitimate token invalidation.",
            "Enable MFA and trigger CAPTCHA challenges for repeated login failures.",
        ],
    },
    {
        "category": "NULL_OR_TYPE_ERROR",
        "patterns": [
            r"nullpointerexception",
            r"attributeerror: 'nonetype'",
            r"cannot read propert.*of (?:null|undefined)",
            r"typeerror: Cannot read",
        ],
        "title": "Unhandled Null Reference / Missing Data Contract",
        "root_cause": "An expected object or dictionary key was null/None at runtime. Usually indicates an unhandled edge case, schema mismatch with upstream payloads, or missing validation.",
        "remediation": [
            "Inspect the call stack to identify the exact line where variable was uninitialized.",
            "Add defensive null-checks or schema validation (Pydantic / TypeScript guard).",
            "Verify upstream payload backwards compatibility.",
        ],
    },
]
CONFIDENCE_BASE = 0.6
CONFIDENCE_STEP = 0.05
CONFIDENCE_MAX = 0.98

# --- texts, as printf formats -------------------------------------------------

BURST_TITLE = "Sudden Error Spike (%d errors, %.1f%% error rate)"
BURST_TEXT = "Log volume had %d events with %d errors in this window. Top affected services: %s."
HTTP_TITLE = "High Volume of HTTP %d Responses"
HTTP_TEXT = "Detected %d instances of HTTP %d responses across the logged duration."
AUTH_TITLE = "Possible Brute Force / Repeated Auth Failures (%d attempts)"
AUTH_TEXT = "Target source '%s' recorded %d failed authentication events in the dataset."
RARE_TITLE = "Rare Error Signature (Seen only %d time%s)"
RARE_TEXT = "New or rare error template encountered: '%s'"

SUMMARY_ISSUE = (
    "Analysis of %d log entries detected an active incident with %d errors (%s%% error rate). "
    "The primary suspected root cause is '%s' affecting services: %s. %s"
)
SUMMARY_ERRORS = (
    "Detected %d errors (%s%% error rate) across %d services. "
    "Errors contain custom application exceptions. Review the top error traces below."
)
SUMMARY_CLEAN = (
    "No critical errors or anomalies detected across %d log events. Systems operating within normal parameters."
)
