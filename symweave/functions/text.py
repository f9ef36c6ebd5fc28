"""Column expressions on names, paths and texts; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qualified_name_of_path(path: Column) -> Column:
    """The dotted import name of a Python file; an `__init__.py` is its package, except at the root."""
    dotted = F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))
    return F.when(dotted.rlike(r"\.__init__$"), F.regexp_replace(dotted, r"\.__init__$", "")).otherwise(dotted)


def package_of_path(path: Column) -> Column:
    """Array of the parts of the package that contains the file."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def line_count(text: Column) -> Column:
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)).cast("int")


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def ancestor_scopes(name: Column) -> Column:
    """The dotted name and each shorter prefix, the longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def repo_hash(root_path: Column) -> Column:
    return F.left(F.sha2(root_path, 256), F.lit(16))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def byte_size(size: Column) -> Column:
    """`512 B`, `1.5 KB` and so on in steps of 1024, up to GB; a size halfway between two tenths takes the even one."""
    tenths = lambda unit, by: F.format_string(f"%.1f {unit}", F.bround(size / float(by), 1))
    return (
        F.when(size < 1024, F.format_string("%d B", size.cast("long")))
        .when(size < 1024**2, tenths("KB", 1024))
        .when(size < 1024**3, tenths("MB", 1024**2))
        .when(size.isNotNull(), tenths("GB", 1024**3))
    )


def has_path_prefix(path: Column, prefix: str) -> Column:
    """Whether the path is the prefix or lies below it, by whole segments."""
    prefix = prefix.rstrip("/")
    return (path == prefix) | path.startswith(prefix + "/")


# Shapes of common credentials.
SECRET_PATTERNS = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
)
REDACTED = "[REDACTED]"


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits."""
    chars = F.split(text, "")
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))


#: Strings that may be keys: so long at least, of such characters, and of so many bits a character.
KEY_CHARS, KEY_LENGTH, KEY_BITS = "A-Za-z0-9+/_=-", 20, 4.0


def redact(text: Column, patterns: tuple[str, ...] = SECRET_PATTERNS) -> Column:
    """Credentials by shape, and values assigned to names of secrets, replaced."""
    for p in patterns:
        text = F.regexp_replace(text, p, REDACTED)
    return F.regexp_replace(text, r"(?i)\b(token|secret|password|api_key)(\s*[=:]\s*[\"']?)[A-Za-z0-9+/_-]{16,}", "$1$2" + r"\[REDACTED\]")


def redact_keys(text: Column, bits: float = KEY_BITS) -> Column:
    """Long strings of letters and digits mixed whose characters are near to random, replaced."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{KEY_CHARS}]{{{KEY_LENGTH},}}"), F.lit(0)))
    keys = F.filter(found, lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]") & (entropy(x) >= bits))
    # the longest first, as one may be part of another
    ordered = F.array_sort(keys, lambda x, y: F.length(y) - F.length(x))
    return F.when(text.isNotNull(), F.aggregate(ordered, text, lambda t, x: F.replace(t, x, F.lit(REDACTED))))


def redact_env(text: Column) -> Column:
    """The values of `NAME=value` lines, as files of settings have them, replaced; names and comments stay."""
    return F.regexp_replace(text, r"(?m)^([ \t]*(?:export[ \t]+)?[A-Za-z_][A-Za-z0-9_.]*[ \t]*=)[ \t]*[^\r\n]+", "$1" + r"\[REDACTED\]")


def is_env_path(path: Column) -> Column:
    return F.substring_index(path, "/", -1).rlike(r"^\.env(\..*)?$|\.env$")


def redact_file(path: Column, text: Column) -> Column:
    return F.when(is_env_path(path), redact_env(text)).otherwise(redact_keys(redact(text)))
