"""The predicate vocabulary: every pattern the rules and extractors match.

A ``Pattern`` holds the expression body without inline flags, so that the same text serves Java
regular expressions here and RE2 in the SQL checks. ``needs`` lists lower-case literals of which
every match contains at least one; a tuple stands for literals that occur together.
``functions.text.matches`` tests those first with a byte search and runs the expression only where
it can succeed, which removes most of the regex cost of a scan.
"""

from __future__ import annotations

from dataclasses import dataclass

# Letters outside ASCII that fold to an ASCII letter under Unicode case rules.
FOLDS = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}


def guard(starts: str, ignore_case: bool) -> str:
    """Look-ahead for the first character of a match.

    It changes no result. At most positions one table look-up takes the place of the word boundary
    and the alternatives of the expression behind it.
    """
    if not starts:
        return ""
    if starts == "\\d":
        return "(?U)(?=\\d)"
    chars = "".join(c + c.upper() + FOLDS.get(c, "") if ignore_case and c.isalpha() else c
                    for c in starts)
    return f"(?=[{chars}])"


@dataclass(frozen=True)
class Pattern:
    name: str
    body: str
    needs: tuple[str | tuple[str, ...], ...] = ()
    ignore_case: bool = True
    starts: str = ""             # characters, in lower case, one of which begins every match

    @property
    def java(self) -> str:
        """Java form: Unicode classes and, if asked for, Unicode case folding."""
        flags = "(?iU)" if self.ignore_case else "(?U)"
        return guard(self.starts, self.ignore_case) + flags + self.body

    @property
    def re2(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.body


# ---------------------------------------------------------------------------------------------
# The expressions below decide which rows are reported and must stay as they are.
# ---------------------------------------------------------------------------------------------
LOG_CALL = Pattern(
    "log_call",
    r"\b(?:logging|logger|log|auditLogger|audit_logger|audit|LOGGER|LOG)"
    r"\s*(?:\.\s*[A-Za-z_][A-Za-z0-9_]*)?\s*\(",
    needs=("log", "audit"),
    starts="la",
)
SENSITIVE = Pattern(
    "sensitive",
    r"(password|passwd|pwd|secret|token|api[_-]?key|authorization|cookie|session[_-]?id|"
    r"session|ssn|social[_-]?security|credit[_-]?card|cardholder|card_number|cvv|"
    r"connection[_-]?string|private[_-]?key)",
    needs=("password", "passwd", "pwd", "secret", "token", "api", "authorization", "cookie",
           "session", "ssn", "social", "credit", "cardholder", "card_number", "cvv",
           "connection", "private"),
    starts="pstac",
)
SAFE_TRANSFORM = Pattern(
    "safe_transform",
    r"(mask|masked|redact|redacted|hash|hashed|tokenize|scrub|sanitize|pseudonym|"
    r"anonym|obfuscate)",
    needs=("mask", "redact", "hash", "tokenize", "scrub", "sanitize", "pseudonym", "anonym",
           "obfuscate"),
    starts="mrhtspao",
)
UNTRUSTED_INPUT = Pattern(
    "untrusted_input",
    r"(request|headers?|params?|query|payload|body|input|user_agent|cookie|filename|path|"
    r"external|client|form|args)",
    needs=("request", "header", "param", "query", "payload", "body", "input", "user_agent",
           "cookie", "filename", "path", "external", "client", "form", "args"),
    starts="rhpqbiucfea",
)
SANITIZER = Pattern(
    "sanitizer",
    r"(sanitize|escape|encode|normalize|replace|strip|validate|structured|extra=|MDC\.put)",
    needs=("sanitize", "escape", "encode", "normalize", "replace", "strip", "validate",
           "structured", "extra=", "mdc.put"),
    starts="senrvm",
)
DISABLE_LOGGING = Pattern(
    "disable_logging",
    r"(logging\.disable\s*\(|\.disabled\s*=\s*True\b|Level\.OFF\b|level\s*=\s*[\"']OFF[\"'])",
    needs=("disable", "level"),
    starts="l.",
)
CONSOLE_LOG = Pattern(
    "console_log",
    r"\b(?:System\.(?:out|err)\.println|printStackTrace|traceback\.print_exc|print)\s*\(",
    needs=("print",),
    starts="spt",
)
TECHNICAL_RESPONSE = Pattern(
    "technical_response",
    r"(return\s+str\s*\(\s*\w+\s*\)|detail\s*=\s*str\s*\(|"
    r"jsonify\s*\([^;\n]*(?:str\s*\(|traceback|format_exc|\.args)|"
    r"ResponseEntity[^;\n]*body\s*\([^;\n]*\.getMessage\s*\(|"
    r"sendError\s*\([^;\n]*\.getMessage\s*\(|"
    r"return\s+[^;\n]*\.getMessage\s*\(|"
    r"traceback\.format_exc\s*\(|stackTrace)",
    needs=(("return", "str"), ("detail", "str"), "jsonify", "getmessage", "format_exc",
           "stacktrace"),
    starts="rdjst",
)
PROPAGATION = Pattern(
    "propagation", r"\b(raise|throw)\b", needs=("raise", "throw"), ignore_case=False, starts="rt"
)
STACK_LOGGED = Pattern(
    "stack_logged",
    r"(logger\.exception|exc_info=true)",
    needs=("logger.exception", "exc_info=true"),
)
LOG_AT_LEVEL = Pattern(
    "log_at_level",
    r"\b(?:logger|log|logging)\s*\.\s*(?:error|warning|warn|critical)\s*\(",
    needs=("error", "warn", "critical"),
    ignore_case=False,
    starts="l",
)
MESSAGE_ONLY = Pattern(
    "message_only",
    r"(str\s*\(\s*\w+\s*\)|\.getMessage\s*\(\)|\bargs\b)",
    needs=("str", "getmessage", "args"),
    ignore_case=False,
    starts="s.a",
)
COMMENT_LINE = Pattern("comment_line", r"^\s*(?:#|//|\*|$)", ignore_case=False)

PY_FUNCTION = r"^\s*def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
PY_CLASS = r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\b"
JAVA_CLASS = r"\bclass\s+([A-Za-z_][A-Za-z0-9_]*)\b"
# One character class in place of a repeated group: Java walks a repeated group recursively, and a
# prose line of some thousand words would exhaust the stack.
JAVA_METHOD = r"^\s*[\w<>\[\]\s]*[\w<>\[\]]\s+([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*\)"
NOT_A_METHOD = ("if", "for", "while", "switch", "catch")
IMPORT = Pattern(
    "import",
    r"^\s*(?:import\s+[\w.*,\s]+|from\s+[\w.]+\s+import\s+.+)",
    needs=("import",),
    ignore_case=False,
)
API_HANDLER = Pattern(
    "api_handler",
    r"(@(?:app\.)?(?:get|post|put|delete|patch)\b|@(?:Get|Post|Put|Delete|Patch)Mapping\b|"
    r"@RequestMapping\b|Controller\b|ResponseEntity\b)",
    needs=("@", "controller", "responseentity"),
)
GLOBAL_HANDLER = Pattern(
    "global_handler",
    r"(@app\.exception_handler\b|@ControllerAdvice\b|@ExceptionHandler\b|"
    r"set_exception_handler\b)",
    needs=("exception_handler", "@controlleradvice", "@exceptionhandler"),
)
BLOCK_HEADS = ("except ", "except:", "catch ", "} catch")
HOTWORDS = (
    "login", "auth", "authorize", "permission", "role", "session", "validate", "validator",
    "exception", "error", "catch", "except", "logger", "logging", "audit", "password", "token",
    "secret", "request", "header", "payload", "upload", "deserialize", "export", "admin",
)

SECRET_MARK = "[REDACTED_SECRET]"
TOKEN_MARK = "[REDACTED_TOKEN]"
CONNECTION_MARK = "[REDACTED_CONNECTION_STRING]"
KEY_MARK = "[REDACTED_PRIVATE_KEY]"


@dataclass(frozen=True)
class Redaction:
    body: str
    mark: str
    keeps_name: bool = False  # the first group is written back in front of the mark
    joint: str = ""           # text between that group and the mark
    ignore_case: bool = True
    dot_all: bool = False
    needs: tuple[str, ...] = ()  # as for a Pattern
    starts: str = ""             # as for a Pattern


# Applied one after the other, in this order.
REDACTIONS = (
    Redaction(r"(password|passwd|pwd|secret)\s*[:=]\s*['\"]?[^'\"\s,;]+", SECRET_MARK, True, "=",
              needs=("password", "passwd", "pwd", "secret"), starts="ps"),
    Redaction(r"(api[_-]?key)\s*[:=]\s*['\"]?[^'\"\s,;]+", SECRET_MARK, True, "=",
              needs=("api",), starts="a"),
    Redaction(r"(authorization)\s*[:=]\s*['\"]?[^'\"\r\n]+", TOKEN_MARK, True, "=",
              needs=("authorization",), starts="a"),
    Redaction(r"(cookie|session[_-]?id)\s*[:=]\s*['\"]?[^'\"\s,;]+", TOKEN_MARK, True, "=",
              needs=("cookie", "session"), starts="cs"),
    Redaction(
        r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
        TOKEN_MARK, ignore_case=False, needs=("eyj",),
    ),
    Redaction(r"(bearer\s+)[A-Za-z0-9._~+/=-]{12,}", TOKEN_MARK, True, needs=("bearer",),
              starts="b"),
    Redaction(
        r"(jdbc:[^'\"\s]+|postgres(?:ql)?://[^'\"\s]+|mysql://[^'\"\s]+|"
        r"mongodb(?:\+srv)?://[^'\"\s]+)",
        CONNECTION_MARK, needs=("jdbc:", "postgres", "mysql:", "mongodb"), starts="jpm",
    ),
    Redaction(
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
        KEY_MARK, ignore_case=False, dot_all=True, needs=("-----begin ",),
    ),
    Redaction(r"\b(?:\d[ -]*?){13,19}\b", SECRET_MARK, ignore_case=False, starts="\\d"),
)
# ------------------------------------------------------------------------ end of fixed values

LINE_PREDICATES = (
    LOG_CALL, SENSITIVE, SAFE_TRANSFORM, UNTRUSTED_INPUT, SANITIZER, DISABLE_LOGGING, CONSOLE_LOG,
    TECHNICAL_RESPONSE, PROPAGATION, STACK_LOGGED, LOG_AT_LEVEL, MESSAGE_ONLY, COMMENT_LINE,
)
