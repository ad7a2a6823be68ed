"""Line rules: which patterns, in which order, with what severity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITY_ORDER = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}
DEDUCTIONS = {"CRITICAL": 15, "HIGH": 10, "MEDIUM": 5, "LOW": 2, "INFO": 0}


@dataclass(frozen=True)
class Rule:
    type: str
    severity: str
    cwe: str
    pattern: str
    says: str
    fix: str | None
    needs: tuple[str, ...]  # a line that matches has one of these, whatever the case


# Patterns, types, severities and weakness numbers, in the order in which findings are listed.
SECURITY_RULES = [
    Rule("Hardcoded API Key", "HIGH", "CWE-798", r"""(?i)(api[_\-]?key|apikey)\s*[=:]\s*["'][A-Za-z0-9_\-/+=]{16,}["']""", "An API key stands in the source.", "Read the key from the environment or a secret store.", ("api",)),
    Rule("Hardcoded Secret Key", "HIGH", "CWE-798", r"""(?i)(secret[_\-]?key|secretkey)\s*[=:]\s*["'][A-Za-z0-9_\-/+=]{16,}["']""", "A secret key stands in the source.", "Read the key from the environment or a secret store.", ("secret",)),
    Rule("Hardcoded Password", "HIGH", "CWE-798", r"""(?i)(password|passwd|pwd)\s*[=:]\s*["'][^"']{4,}["']""", "A password stands in the source.", "Read the password from the environment or a secret store.", ("pass", "pwd")),
    Rule("Hardcoded Token", "HIGH", "CWE-798", r"""(?i)(token|auth_token|access_token|bearer)\s*[=:]\s*["'][A-Za-z0-9_\-/.+=]{20,}["']""", "An access token stands in the source.", "Read the token from the environment or a secret store.", ("token", "bearer")),
    Rule("AWS Access Key ID", "CRITICAL", "CWE-798", r"AKIA[0-9A-Z]{16}", "An AWS access key id stands in the source.", "Revoke the key and use roles or a secret store.", ("akia",)),
    Rule("Hardcoded Private Key", "CRITICAL", "CWE-321", r"""(?i)(private[_\-]?key)\s*[=:]\s*["']-----BEGIN""", "A private key stands in the source.", "Revoke the key and load its successor from a protected file.", ("private",)),
    Rule("Hardcoded Connection String", "HIGH", "CWE-798", r"""(?i)(connection[_\-]?string|database[_\-]?url|db[_\-]?url)\s*[=:]\s*["'][^"']{10,}["']""", "A connection string, perhaps with a password, stands in the source.", "Read the connection string from the environment.", ("connection", "database", "db")),
    Rule("SQL Injection — String Interpolation in execute()", "CRITICAL", "CWE-89", r"""execute\s*\(.*(%s|%d|\{|\+|\.format\s*\(|f["'])""", "A statement given to execute() is put together from strings.", "Pass values as parameters of the statement.", ("execute",)),
    Rule("SQL Injection — Unsafe Query Construction", "CRITICAL", "CWE-89", r"""(?i)(cursor|conn|connection|db|session)\.(execute|raw|query)\s*\(.*(\+|%|\.format|f["'])""", "A query is put together from strings.", "Pass values as parameters of the query.", (".execute", ".raw", ".query")),
    Rule("SQL Injection — SQLAlchemy text() with f-string", "CRITICAL", "CWE-89", r"""(?i)text\s*\(\s*f["']""", "text() is given a formatted string.", "Use bound parameters in text().", ("text",)),
    Rule("Command Injection — os.system()", "CRITICAL", "CWE-78", r"os\.system\s*\(", "os.system() runs a command line through the shell.", "Use subprocess.run with a list of arguments.", ("os.system",)),
    Rule("Command Injection — subprocess with shell=True", "CRITICAL", "CWE-78", r"subprocess\.(call|run|Popen)\s*\(.*shell\s*=\s*True", "A subprocess is run through the shell.", "Pass a list of arguments and leave out shell=True.", ("subprocess.",)),
    Rule("Code Injection — eval()", "CRITICAL", "CWE-78", r"(?i)eval\s*\(", "eval() runs whatever text it is given.", "Parse the text, for example with ast.literal_eval.", ("eval",)),
    Rule("Code Injection — exec()", "CRITICAL", "CWE-78", r"(?i)exec\s*\(", "exec() runs whatever text it is given.", "Call known functions instead of generated code.", ("exec",)),
    Rule("Unsafe Deserialization — pickle", "HIGH", "CWE-502", r"pickle\.(loads?|Unpickler)\s*\(", "Unpickling can run code of whoever wrote the data.", "Use a data format such as JSON.", ("pickle.",)),
    Rule("Unsafe Deserialization — PyYAML", "HIGH", "CWE-502", r"yaml\.(load|unsafe_load)\s*\((?!.*Loader\s*=\s*(SafeLoader|yaml\.SafeLoader))", "YAML is loaded with a loader that can build any object.", "Use yaml.safe_load.", ("yaml.",)),
    Rule("Unsafe Deserialization — marshal", "HIGH", "CWE-502", r"marshal\.loads?\s*\(", "marshal data can crash or deceive its reader.", "Use a data format such as JSON.", ("marshal.",)),
    Rule("Unsafe Deserialization — jsonpickle", "HIGH", "CWE-502", r"jsonpickle\.decode\s*\(", "jsonpickle can build any object from its input.", "Use plain JSON and check its schema.", ("jsonpickle.",)),
    Rule("Weak Cryptography — MD5", "MEDIUM", "CWE-327", r"(?i)(md5|MD5)\s*\(", "MD5 no longer withstands collisions.", "Use SHA-256, or a password hash for passwords.", ("md5",)),
    Rule("Weak Cryptography — SHA-1", "MEDIUM", "CWE-327", r"(?i)(sha1|SHA1)\s*\(", "SHA-1 no longer withstands collisions.", "Use SHA-256, or a password hash for passwords.", ("sha1",)),
    Rule("Weak Cryptography — Deprecated Algorithm", "MEDIUM", "CWE-327", r"(?i)(DES|Blowfish|RC4|RC2)\b", "DES, Blowfish, RC2 and RC4 are no longer safe.", "Use AES-GCM or ChaCha20-Poly1305.", ("des", "blowfish", "rc")),
    Rule("Insecure Randomness", "MEDIUM", "CWE-327", r"(?i)random\.(random|randint|choice|shuffle)\s*\(", "The random module can be predicted.", "Use the secrets module.", ("random.",)),
    Rule("Insecure TLS — SSL Verification Disabled", "MEDIUM", "CWE-319", r"verify\s*=\s*False", "TLS certificates are not checked.", None, ("verify",)),
    Rule("Insecure HTTP — Plaintext URL", "MEDIUM", "CWE-319", r"http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0)", "Traffic over plain HTTP can be read and changed.", None, ("http://",)),
]

# Issue names and patterns of the performance review; the first that a line matches is its issue.
PERFORMANCE_RULES = [
    ("Nested Loops", r"\bfor\b.+\bfor\b"),
    ("List append in loop (potential)", r"\.append\s*\("),
    ("Blocking sleep", r"time\.sleep\s*\("),
    ("SELECT * query", r"(?i)SELECT \*"),
    ("Full file read into memory", r"\.read\(\)"),
    ("String concatenation in loop (potential)", r"""\+\s*['"]|['"][^'"]*\+"""),
    ("Regex compiled inside function (potential)", r"(?i)re\.compile\s*\("),
]
ISSUES = {
    "Nested Loops": "Loops in loops take time with the square of the input.",
    "List append in loop (potential)": "A list grows by one entry a turn.",
    "Blocking sleep": "The thread stands still while it sleeps.",
    "SELECT * query": "All columns are read, wanted or not.",
    "Full file read into memory": "The whole file must fit into memory.",
    "String concatenation in loop (potential)": "Each turn copies the string.",
    "Regex compiled inside function (potential)": "The pattern is compiled at each call.",
}
SUGGESTIONS = {
    "Nested Loops": "Index one side by key, or use a set-based operation.",
    "List append in loop (potential)": "Build the list in one comprehension.",
    "Blocking sleep": "Wait without blocking the event loop.",
    "SELECT * query": "Name the columns that are needed.",
    "Full file read into memory": "Read in chunks.",
    "String concatenation in loop (potential)": "Join the parts once.",
    "Regex compiled inside function (potential)": "Compile the pattern once, outside.",
}


def found(line: Column, pattern: str) -> Column:
    """Whether the pattern occurs in a line; classes and borders are Unicode, a dot stops only at \\n."""
    return line.rlike(f"(?Ud){pattern}")


def folded(line: Column) -> Column:
    """A line in one case, in which special forms of letters are the plain ones, too."""
    return F.translate(F.lower(line), "\u017f\u212a\u0131\u0307", "ski")


def breaks(rule: Rule, line: Column, fold: Column) -> Column:
    """Whether a line breaks a rule; its pattern is only tried where the folded line has what it needs."""
    may = F.lit(False)
    for part in rule.needs:
        may = may | F.contains(fold, F.lit(part))
    return may & found(line, rule.pattern)


def rank(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), severity), F.lit(0))
