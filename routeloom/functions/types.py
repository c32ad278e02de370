"""Physical and logical type of single values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeloom.functions.patterns import LOGICAL_PATTERNS

# Equivalents of character rules; a bare sign counts as an integer, a bare dot as a float.
INTEGER = r"^[+-]?[0-9]*\z"
HEX = r"^0[xX][0-9a-fA-F]+\z"
SCIENTIFIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+\z"
PLAIN_FLOAT = r"^[+-]?[0-9]*\.[0-9]*\z"
DECIMAL = r"^([+-][0-9]*|[0-9]+)\.[0-9]{2}\z"
CURRENCY = r"^[$€£¥￥]"
IPV6 = (
    r"(?i)^(?=[0-9a-f:.]*:)(?=[0-9a-f:.]+\z)(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){6}(?:\d{1,3}\.){3}\d{1,3}"
    r"|(?=(?:[^:]*:){2,8}[^:]*\z)(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?::(?:(?:[0-9a-f]{1,4}:)*(?:[0-9a-f]{1,4}|(?:\d{1,3}\.){3}\d{1,3}))?)\z"
)


def physical(v: Column) -> Column:
    return (
        F.when(v.isin("", "null", "NULL"), "null")
        .when(v.isin("true", "false", "TRUE", "FALSE"), "boolean")
        .when((F.octet_length(v) < 16) & v.rlike(INTEGER), "integer")
        .when(v.rlike(HEX), "integer")
        .when(v.rlike(SCIENTIFIC) | v.rlike(PLAIN_FLOAT), "float")
        .when((F.length(v) >= 2) & F.startswith(v, F.lit("[")) & F.endswith(v, F.lit("]")), "array")
        .when((F.length(v) >= 2) & F.startswith(v, F.lit("{")) & F.endswith(v, F.lit("}")), "object")
        .otherwise("string")
    )


def phone_form(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9+]", "")


def matches(name: str, v: Column) -> Column:
    """Whether a value fits the pattern of a logical type."""
    if name == "phone":
        return phone_form(v).rlike(LOGICAL_PATTERNS[name])
    if name == "ipaddress":
        return v.rlike(LOGICAL_PATTERNS[name]) | (F.contains(v, F.lit(":")) & v.rlike(IPV6))
    return v.rlike(LOGICAL_PATTERNS[name])


def pattern_type(v: Column) -> Column:
    """The first logical type whose pattern fits; null if none does."""
    out = F.lit(None).cast("string")
    for name in reversed(LOGICAL_PATTERNS):
        out = F.when(matches(name, v), name).otherwise(out)
    return out


def number_format(v: Column) -> Column:
    """percentage, currency, decimal or null."""
    return F.when(F.endswith(v, F.lit("%")), "percentage").when(v.rlike(CURRENCY), "currency").when(v.rlike(DECIMAL), "decimal")
