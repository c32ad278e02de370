"""Patterns, names and lists that results depend on.

Patterns are in Java's spelling; ``re2`` gives the spelling that DuckDB takes.
"""

from __future__ import annotations

ID_CARD = r"^[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\z|^[1-9]\d{5}\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}\z"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\z"
PLATE = r"^\p{IsHan}[A-Z][A-Z0-9]{5,6}\z"
BANK_CARD = r"^[3-6]\d{15,18}\z"

#: What siblings are tested for, the more specific first; a tie goes to the earlier.
SIBLING_PATTERNS = {
    "uuid": UUID,
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z",
    "ip": IPV4,
    "date": r"^\d{4}-\d{2}-\d{2}",
    "phone": r"^(?:\+?86)?1[3-9]\d{9}\z",
    "idcard": ID_CARD,
    "bankcard": BANK_CARD,
    "plate": PLATE,
    "version": r"^v[0-9]+\z",
    "alphanumeric": r"^[a-zA-Z]+[0-9]+\z",
    "float": r"^[0-9]+\.[0-9]+\z",
    "integer": r"^[0-9]+\z",
}

#: What a variable's name ends with; other patterns give var_ and the parent's name.
VARIABLE_SUFFIX = {
    "integer": "id", "uuid": "uuid", "float": "value", "date": "date", "ip": "ip", "version": "version",
    "alphanumeric": "code", "phone": "phone", "idcard": "idcard", "bankcard": "bankcard", "plate": "plate",
}

#: What a variable matches later, not anchored; none for email and similar lengths.
VARIABLE_REGEX = {
    "integer": r"[0-9]+",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "float": r"[0-9]+\.[0-9]+",
    "date": r"\d{4}-\d{2}-\d{2}",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "version": r"v[0-9]+",
    "alphanumeric": r"[a-zA-Z]+[0-9]+",
    "phone": r"(?:\+?86)?1[3-9][0-9]{9}",
    "idcard": r"[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]",
    "bankcard": r"[3-6][0-9]{15,18}",
    "plate": r"[\p{IsHan}][A-Z][A-Z0-9]{5,6}",
}

#: Logical types by pattern, in order of priority.
LOGICAL_PATTERNS = {
    "uuid": UUID,
    "ipaddress": IPV4,
    "phone": r"^(?:\+?86|0086)?1[3-9]\d{9}\z|^0\d{2,3}[1-9]\d{6,7}\z",
    "idcard": ID_CARD,
    "bankcard": BANK_CARD,
    "plate": PLATE,
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\z",
    "datetime": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "date": r"^\d{4}-\d{2}-\d{2}\z",
    "time": r"^\d{2}:\d{2}:\d{2}",
    "url": r"^https?://",
    "json": r"^\s*\{.*\}\s*\z|^\s*\[.*\]\s*\z",
    "xml": r"^\s*<",
}

#: Physical types in the order that settles a tie.
PHYSICAL_TYPES = ("integer", "float", "boolean", "string", "object", "array", "null")

#: File name endings that a variable without a pattern doesn't match.
STATIC_EXTENSIONS = (
    ".html", ".htm", ".css", ".js", ".json", ".xml",
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".txt", ".csv", ".zip", ".tar", ".gz",
    ".mp3", ".mp4", ".avi", ".mov",
    ".woff", ".woff2", ".ttf", ".eot",
)

#: Headers that shape routes, and the columns that hold them.
ROUTING_HEADERS = {"Accept": "accept", "Authorization": "authorization", "X-Api-Version": "x_api_version", "Accept-Language": "accept_language", "X-Requested-With": "x_requested_with"}

BODY_METHODS = ("POST", "PUT", "PATCH")
MAX_PARAMS = 1000


def re2(pattern: str) -> str:
    """The same pattern for RE2."""
    return pattern.replace(r"\p{IsHan}", r"\p{Han}")


STATIC_PATTERN = r"\.(?:" + "|".join(x[1:] for x in STATIC_EXTENSIONS) + r")\z"
