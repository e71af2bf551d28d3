"""Paths, names and small text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions of parsed and of merely tracked languages, and pruned folders.
PARSED = {".py": "python", ".java": "java", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".kt": "kotlin", ".graphqls": "graphql", ".bpmn": "bpmn", ".avdl": "avdl"}
TRACKED = {".html": "html", ".css": "css", ".csv": "csv"}
DENIED = ["node_modules", ".venv", "venv", "dist", "build", "target", "__pycache__", ".git", ".idea", ".gradle", ".mvn", "vendor", "bower_components"]
SCANNED = [".py", ".java", ".ts", ".tsx", ".js", ".jsx", ".kt", ".json", ".yaml", ".yml", ".env", ".properties", ".toml", ".xml", ".graphqls", ".bpmn", ".avdl", ".html", ".css", ".csv"]
MAX_PARSE_BYTES, MAX_SCAN_BYTES = 2_000_000, 500_000
#: File names at which programs start, by language.
ENTRY_POINTS = {"python": ["main.py", "app.py", "manage.py", "wsgi.py", "asgi.py"], "java": ["main.java"], "kotlin": ["main.kt", "application.kt"], "typescript": ["index.ts", "main.ts", "server.ts", "app.ts"], "tsx": ["index.tsx", "main.tsx", "app.tsx"], "javascript": ["index.js", "main.js", "server.js", "app.js"]}


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(?:^|/)[^/]+(\.[^./]+)$", 1)


def language_of(path: Column) -> Column:
    """Language by extension: exact case for parsed ones, any case for tracked ones, else null."""
    return F.coalesce(F.try_element_at(literal_map(PARSED), suffix(path)), F.try_element_at(literal_map(TRACKED), F.lower(suffix(path))))


def denied(path: Column) -> Column:
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*[F.lit(x) for x in DENIED]))


def is_entry_point(path: Column, language: Column) -> Column:
    known = F.lit(False)
    for lang, names in ENTRY_POINTS.items():
        known = known | ((language == lang) & F.lower(basename(path)).isin(names))
    return known | ((language == "java") & basename(path).endswith("Application.java"))


def qualified_name(path: Column, name: Column, parent: Column) -> Column:
    """``path::name`` or ``path::Class.name``, the class from the parent's own qualified name."""
    own = F.get(F.split(parent, "::", 2), F.lit(1))
    return F.when(parent.isNull(), F.concat(path, F.lit("::"), name)).otherwise(F.concat(path, F.lit("::"), own, F.lit("."), name))


def chunk_name(function: Column, index: Column) -> Column:
    return F.concat(function, F.lit("::chunk"), index.cast("string"))


def slug(text: Column, max_len: int = 40, default: str = "issue") -> Column:
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, max_len), "-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def queue_email(email: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(email), r"[^\p{L}\p{N}_-]", "-"), 1, 64)


def queue_name(pattern: str, environment: str, email: Column) -> Column:
    head, tail = pattern.replace("{environment}", environment).split("{email}")
    return F.substring(F.concat(F.lit(head), queue_email(email), F.lit(tail)), 1, 80)


def secret_variable(tenant: Column) -> Column:
    return F.concat(F.lit("LAMBDA_WEBHOOK_"), F.regexp_replace(F.upper(tenant), r"[^\p{L}\p{N}]", "_"), F.lit("_SECRETS_ARN"))


def email_domain(email: Column) -> Column:
    return F.nullif(F.trim(F.lower(F.get(F.split(email, "@"), F.lit(1)))), F.lit(""))


def address_of(header: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(header, "<(.*?)>", 1), F.lit("")), header)


def without_mentions(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<@[^>]+>", ""))


def without_line_range(path: Column) -> Column:
    return F.regexp_replace(path, r":\d+-\d+$", "")


def normal_symbol(symbol: Column) -> Column:
    """A symbol as people write it: no blanks, back-ticks, call suffix or file prefix."""
    s = F.regexp_replace(F.trim(symbol), "^`+|`+$", "")
    return F.element_at(F.split(F.regexp_replace(s, r"\(.*\)$", ""), "::"), -1)


def normal_path(path: Column) -> Column:
    p = F.regexp_replace(F.trim(path), "^`+|`+$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(p, r"^\./", ""), "^/+", ""), F.lit(""))


def fit_bytes(text: Column, limit: int = 8000) -> Column:
    """At most ``limit`` UTF-8 bytes, never half a character."""
    b = F.substring(F.encode(text, "UTF-8"), 1, limit)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.regexp_replace(F.try_validate_utf8(F.make_valid_utf8(b.cast("string"))), "�$", ""))
