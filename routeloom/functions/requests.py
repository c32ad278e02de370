"""Parts of a request as Column expressions: URL, query, body, headers, cookies.  All run inside Spark's own engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeloom.functions.patterns import BODY_METHODS, MAX_PARAMS, STATIC_PATTERN

URL_PARTS = r"(?s)^(?:.+?://[^/?]*|//[^/?]*)?([^?]*)(?:\?(.*))?\z"
PARAM = "array<struct<name:string,value:string>>"


def url_path(url: Column) -> Column:
    """What stands between the authority and the first question mark; a fragment is not cut off."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "/+", "/")


def decode_segment(segment: Column) -> Column:
    """Percent escapes decoded, plus signs kept; null if an escape is bad."""
    return F.when(F.instr(segment, "%") == 0, segment).otherwise(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))))


def decode_query(text: Column) -> Column:
    return F.try_url_decode(text)


def path_segments(url: Column) -> Column:
    """Decoded segments without empty ones and dots; null entries mark bad escapes."""
    raw = F.filter(F.split(url_path(url), "/"), lambda x: x != "")
    return F.filter(F.transform(raw, decode_segment), lambda x: x.isNull() | ~x.isin("", ".", ".."))


def path_param_key(segment: Column) -> Column:
    """The key of a key=value segment, else an empty string."""
    return F.regexp_extract(segment, r"^([A-Za-z_][A-Za-z0-9_]*)=", 1)


def segment_key(segment: Column) -> Column:
    """What a segment is called in the tree: its key if it is key=value."""
    key = path_param_key(segment)
    return F.when(key != "", key).otherwise(segment)


def path_params(segments: Column) -> Column:
    named = F.filter(segments, lambda s: path_param_key(s) != "")
    return F.transform(named, lambda s: F.struct(F.lower(path_param_key(s)).alias("name"), F.substring(s, F.length(path_param_key(s)) + 2, F.length(s)).alias("value")))


def query_params(query: Column) -> Column:
    """(name, value) in order; names in lower case, repeats kept; null values or names mark bad escapes or semicolons."""
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: x != "")

    def one(pair: Column) -> Column:
        bad = F.instr(pair, ";") > 0
        name = F.lower(decode_query(F.substring_index(pair, "=", 1)))
        value = F.when(F.instr(pair, "=") > 0, decode_query(F.substring(pair, F.instr(pair, "=") + 1, F.length(pair)))).otherwise("")
        return F.struct(F.when(~bad, name).alias("name"), F.when(~bad, value).alias("value"))

    return F.transform(pairs, one)


def bad_params(params: Column) -> Column:
    return F.exists(params, lambda p: p["name"].isNull() | p["value"].isNull())


def method(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "GET").otherwise(F.upper(value))


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.trim(F.coalesce(content_type, F.lit(""))), ";", 1)))


def takes_body(method_: Column) -> Column:
    return method_.isin(*BODY_METHODS)


def multipart_params(content_type: Column, body: Column) -> Column:
    """(name, value) of the parts; a file's value is its name.  Null without a boundary."""
    boundary = F.regexp_extract(content_type, r'(?i)boundary="?([^";]+)"?', 1)
    parts = F.filter(F.split(body, F.concat(F.lit(r"\Q--"), boundary, F.lit(r"\E"))), lambda p: F.instr(p, "\r\n\r\n") > 0)

    def one(part: Column) -> Column:
        at = F.instr(part, "\r\n\r\n")
        head = F.substring(part, F.lit(1), at - 1)
        content = F.regexp_replace(F.substring(part, at + 4, F.length(part)), r"^(?:\r\n)+|(?:\r\n)+\z", "")
        file = F.regexp_extract(head, r'(?i)filename="?([^";\r\n]*)"?', 1)
        name = F.lower(F.regexp_extract(head, r'(?i)(?:^|[;\s])name="?([^";\r\n]*)"?', 1))
        return F.struct(name.alias("name"), F.when(file != "", file).otherwise(content).alias("value"))

    return F.when(boundary != "", F.filter(F.transform(parts, one), lambda p: p["name"] != ""))


def cut_params(params: Column) -> Column:
    return F.slice(params, 1, MAX_PARAMS)


def cookies(header: Column) -> Column:
    """(name, value) of a Cookie header, the last of equal names; one without a sign has an empty value."""
    parts = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")

    def one(part: Column) -> Column:
        name = F.trim(F.substring_index(part, "=", 1))
        value = F.when(F.instr(part, "=") > 0, F.trim(F.substring(part, F.instr(part, "=") + 1, F.length(part)))).otherwise("")
        return F.struct(name.alias("name"), value.alias("value"))

    pairs = F.filter(F.transform(parts, one), lambda p: p["name"] != "")
    none = F.array().cast(PARAM)
    return F.aggregate(pairs, none, lambda kept, p: F.concat(F.filter(kept, lambda x: x["name"] != p["name"]), F.array(p)))


def accept_value(value: Column) -> Column:
    return F.trim(F.substring_index(F.trim(F.substring_index(value, ",", 1)), ";", 1))


def auth_scheme(value: Column) -> Column:
    return F.substring_index(value, " ", 1)


def header_value(name: Column, value: Column) -> Column:
    lower = F.lower(name)
    return F.when(lower.isin("accept", "accept-language"), accept_value(value)).when(lower == "authorization", auth_scheme(value)).otherwise(value)


def is_ajax(requested_with: Column) -> Column:
    return F.coalesce(requested_with == "XMLHttpRequest", F.lit(False))


def static_file(segment: Column) -> Column:
    return F.lower(segment).rlike(STATIC_PATTERN)


def variable_matches(segment: Column, pattern: Column) -> Column:
    """Patterns are not anchored; without one everything but static files matches."""
    usable = ~F.coalesce(segment, F.lit("")).isin("", "/")
    return usable & F.when(F.coalesce(pattern, F.lit("")) == "", ~static_file(segment)).otherwise(F.regexp_like(segment, pattern))


def query_has(query: Column, name: Column) -> Column:
    """Whether a query string is a parameter's name, or has it with a value; any case, so ``page_size`` isn't ``page``."""
    wanted = F.lower(name)
    return (F.lower(query) == wanted) | F.exists(F.split(F.lower(query), "&"), lambda p: F.startswith(p, F.concat(wanted, F.lit("="))))


def values_of(query: Column, name: Column) -> Column:
    """All values of one parameter as they stand in a query string, an empty one where there is no sign."""
    mine = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: F.lower(F.substring_index(p, "=", 1)) == F.lower(name))
    return F.transform(mine, lambda p: F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(""))


def extract_param(query: Column, name: Column, default: Column, required: Column) -> Column:
    """Struct found, value, multi: the values joined by commas, else the default; not found only if it is required and there is neither."""
    own = values_of(query, name)
    values = F.when((F.size(own) == 0) & (F.coalesce(default, F.lit("")) != ""), F.array(default)).otherwise(own)
    found = ~(F.coalesce(required, F.lit(False)) & (F.size(values) == 0))
    return F.struct(found.alias("found"), F.when(found, F.array_join(values, ",")).alias("value"), (found & (F.size(values) > 1)).alias("multi"))


def extract_variable(segment: Column, pattern: Column) -> Column:
    """The segment where a path variable takes it, else null."""
    return F.when(variable_matches(segment, pattern), segment)


def variable_display(name: Column, pattern: Column, physical: Column) -> Column:
    """How a variable is shown: its name with its pattern, else with its type."""
    return F.concat(F.lit("{"), name, F.lit(":"), F.when(F.coalesce(pattern, F.lit("")) != "", pattern).otherwise(F.coalesce(physical, F.lit("string"))), F.lit("}"))


def header(headers: Column, name: str) -> Column:
    """A header's value in a map by a name in any case; of several that of the last."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])
