"""Levels, tag patterns, method names and skip lists that results depend on."""

PYTHON_LOG_METHODS = ("debug", "info", "warning", "error", "critical", "exception", "fatal", "log")

GO_LEVELS = {
    "debug": ("Debug", "Debugf", "Debugw", "Debugln"),
    "info": ("Info", "Infof", "Infow", "Infoln", "Print", "Printf", "Println", "Log", "Logf"),
    "warning": ("Warn", "Warnf", "Warnw", "Warnln"),
    "error": ("Error", "Errorf", "Errorw", "Errorln"),
    "critical": ("Fatal", "Fatalf", "Fatalw", "Fatalln", "Panic", "Panicf", "Panicln", "DPanic", "DPanicf", "DPanicw"),
}
GO_CHAIN_ENDS = ("Msg", "Msgf", "Send")
GO_CHAIN_LEVELS = {"Trace": "debug", "Debug": "debug", "Info": "info", "Warn": "warning", "Error": "error", "Fatal": "critical", "Panic": "critical"}
GO_NON_LOG_PACKAGES = ("http", "errors", "fmt", "os", "io", "json", "strings", "bytes", "strconv")
#: Field constructors of a structured logger: they make arguments, not log entries.
GO_FIELD_PACKAGE = "zap"

TS_LEVELS = {
    "info": ("log", "info"),
    "warning": ("warn",),
    "error": ("error",),
    "debug": ("debug", "trace", "verbose", "silly"),
    "critical": ("fatal",),
}

FUNCTION_TAGS = {
    "auth": ("login", "logout", "authenticate", "authorize", "auth", "verify_token", "refresh_token", "check_permission"),
    "security": ("encrypt", "decrypt", "hash", "verify_signature", "sanitize", "validate_token", "check_csrf"),
    "database": ("query", "execute", "commit", "rollback", "migrate", "create_table", "drop_table", "upsert", "bulk_insert"),
    "http": ("request", "response", "fetch", "download", "upload", "get", "post", "put", "patch", "delete"),
    "payment": ("charge", "refund", "invoice", "subscribe", "checkout", "payment", "billing", "stripe", "process_payment"),
    "lifecycle": ("startup", "shutdown", "init", "teardown", "cleanup", "on_start", "on_stop", "bootstrap", "dispose"),
    "retry": ("retry", "backoff", "attempt", "fallback", "circuit_breaker"),
    "cache": ("cache", "invalidate", "evict", "warm", "memoize"),
    "queue": ("enqueue", "dequeue", "publish", "subscribe", "consume", "produce", "dispatch", "worker"),
    "validation": ("validate", "check", "assert", "verify", "ensure", "sanitize_input"),
}
MODULE_TAGS = {
    "auth": ("auth", "iam", "permission", "rbac", "acl"),
    "security": ("security", "crypto", "ssl", "tls"),
    "database": ("db", "database", "orm", "repository", "dao", "models"),
    "http": ("api", "routes", "views", "handlers", "endpoints", "middleware"),
    "payment": ("payment", "billing", "stripe", "checkout"),
    "lifecycle": ("startup", "boot", "config", "settings"),
    "queue": ("queue", "worker", "celery", "tasks", "jobs"),
    "cache": ("cache", "redis"),
}
LEXICAL_TAGS = {
    "auth": ("login_required", "requires_auth", "permission_required", "jwt_required"),
    "http": ("route", "get", "post", "put", "delete", "api_view", "app.route", "router"),
    "retry": ("retry", "backoff", "tenacity"),
    "cache": ("cached", "cache", "lru_cache", "memoize"),
    "lifecycle": ("on_event", "startup", "shutdown", "lifespan"),
    "async": ("celery", "task", "shared_task"),
}
MESSAGE_TAGS = {
    "auth": "login|logout|auth|token|session|credential",
    "security": "password|secret|key|cert|ssl|tls|encrypt",
    "database": "query|sql|table|row|column|database|migration",
    "http": "request|response|status|endpoint|url|header",
    "payment": "payment|charge|refund|invoice|billing",
    "performance": "slow|timeout|latency|elapsed|duration",
    "error": "fail|error|exception|crash|panic|abort",
    "retry": "retry|attempt|backoff|reconnect",
}
ERROR_LEVELS = ("error", "critical", "exception", "fatal")

PYTHON_CALL_SKIP = frozenset(
    "print len range enumerate zip map filter str int float bool list dict set tuple isinstance issubclass hasattr getattr setattr "
    "type super property staticmethod classmethod open sorted reversed min max sum abs any all next iter id hash repr format "
    "debug info warning error critical exception fatal log".split()
)
GO_CALL_SKIP = frozenset(
    "make len cap new append copy delete close panic recover complex real imag print println min max clear "
    "string byte rune int int64 int32 float64 float32 uint uint64 uint32 bool "
    "Debug Debugf Debugw Debugln Info Infof Infow Infoln Warn Warnf Warnw Warnln Error Errorf Errorw Errorln "
    "Fatal Fatalf Fatalw Fatalln Panic Panicf Panicln Print Printf Println Log Logf".split()
)
GO_PACKAGE_SKIP = frozenset("fmt http json os io strings bytes strconv filepath errors context sync time sort math regexp encoding net crypto reflect testing slog log".split())
TS_CALL_SKIP = frozenset(
    "parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent encodeURI decodeURI setTimeout setInterval clearTimeout "
    "clearInterval require Symbol log info warn error debug trace fatal verbose push pop shift unshift splice slice concat map filter reduce "
    "forEach find findIndex some every includes indexOf join split trim replace match keys values entries assign freeze defineProperty "
    "hasOwnProperty toString valueOf toUpperCase toLowerCase startsWith endsWith padStart padEnd substring charAt sort reverse flat flatMap "
    "fill then catch finally resolve reject all allSettled race parse stringify typeof instanceof".split()
)
TS_OBJECT_SKIP = frozenset(
    "console JSON Math Object Array String Number Boolean Date RegExp Promise Set Map WeakMap WeakSet Buffer process Error TypeError "
    "RangeError Reflect Proxy Intl Symbol logger log".split()
)

IGNORED_FOLDERS = ("node_modules", "venv", "__pycache__")
LANGUAGE_SUFFIXES = {"python": (".py",), "go": (".go",), "typescript": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")}
TS_MARKERS = ("src", "lib", "app", "pages", "components", "api")

#: Placeholders of message templates: brace fields, and printf verbs.
BRACE_FIELD = r"\{[^}]*\}"
PRINTF_VERB = r"%[-+0 #]*\d*\.?\d*[diouxXeEfFgGcrsab%]"
GO_FORMAT_VERB = r"%[+\-#0 ]*(?:\*|\d+)?(?:\.(?:\*|\d+))?[sdvfteqxXoObBpTwgGUcn]"
