"""JSON bodies as parameters, inside Spark's own engine: a variant, opened one level after another until only leaves are left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEMS = "array<struct<name:string,value:variant>>"
NAME_VALUE = "struct<name:string,value:variant>"


def number_text(d: Column, plain: bool = False) -> Column:
    """A number that isn't whole, or too large for 64 bits: the digits of Java's Double.toString, with an exponent below 1e-4 and from 1e6 on.

    ``plain`` writes no exponents: all places up to the point, zeros included.
    """
    s = F.abs(d).cast("string")
    mantissa, shift = F.substring_index(s, "E", 1), F.when(F.contains(s, F.lit("E")), F.substring_index(s, "E", -1).cast("int")).otherwise(0)
    whole = F.substring_index(mantissa, ".", 1)
    raw = F.replace(mantissa, F.lit("."), F.lit(""))
    digits = F.regexp_replace(raw, "^0+|0+$", "")
    exponent = shift + F.length(whole) - 1 - F.length(F.regexp_extract(raw, "^(0*)", 1))
    rest = F.substring(digits, F.lit(2), F.length(digits))
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), power)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    places = F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits)))
    sign = F.when(d < 0, "-").otherwise("")
    if plain:
        whole_part = F.concat(digits, F.repeat(F.lit("0"), exponent + 1 - F.length(digits)))
        return F.concat(sign, F.when(exponent < 0, small).when(F.length(digits) <= exponent + 1, whole_part).otherwise(places))
    return F.concat(sign, F.when((exponent < -4) | (exponent >= 6), scientific).when(exponent < 0, small).otherwise(places))


def scalar_text(value: Column, plain: bool = False) -> Column:
    """A leaf's text: null is empty, whole numbers have no point, others are as ``number_text`` writes them."""
    kind, d = F.schema_of_variant(value), F.try_variant_get(value, "$", "double")
    whole = (d == F.floor(d)) & (F.abs(d) < 9.2233720368547758e18)
    return F.when(kind == "VOID", "").when(kind.isin("STRING", "BOOLEAN"), F.try_variant_get(value, "$", "string")).when(whole, d.cast("long").cast("string")).otherwise(number_text(d, plain))


def _nested(items: Column) -> Column:
    kind = lambda e: F.schema_of_variant(e["value"])
    return F.exists(items, lambda e: kind(e).startswith("OBJECT") | kind(e).startswith("ARRAY"))


def _opened(e: Column) -> Column:
    """The members of an object by dotted names, the items of an array by numbers, or the leaf itself."""
    pair = lambda name, value: F.struct(name.alias("name"), value.alias("value")).cast(NAME_VALUE)
    member = lambda x: pair(F.when(e["name"] == "", x["key"]).otherwise(F.concat(e["name"], F.lit("."), x["key"])), x["value"])
    item = lambda x, i: pair(F.concat(e["name"], F.lit("."), i.cast("string")), x)
    return F.coalesce(
        F.transform(F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>")), member),
        F.transform(F.try_variant_get(e["value"], "$", "array<variant>"), item),
        F.array(pair(e["name"], e["value"])),
    )


def json_params(body: Column, plain: bool = False) -> Column:
    """(name, value) of the leaves; names in lower case; null where the body isn't JSON; ``plain`` numbers have no exponents.

    A top-level array's names begin with a point, a top-level scalar has none, empty objects and arrays give nothing.  There are no
    more levels than opening brackets, and once nothing is nested the remaining ones are passed over.
    """
    parsed = F.try_parse_json(body)
    start = F.array(F.struct(F.lit("").alias("name"), parsed.alias("value"))).cast(ITEMS)
    state = lambda open_, items: F.struct(open_.alias("open"), items.alias("items")).cast(f"struct<open:boolean,items:{ITEMS}>")

    def level(s: Column, _: Column) -> Column:
        return F.when(s["open"], state(_nested(s["items"]), F.flatten(F.transform(s["items"], _opened)))).otherwise(s)

    brackets = F.length(body) - F.length(F.translate(body, "{[", ""))
    # An object in a body with one bracket has leaves only, so nothing is opened level by level.
    flat = F.transform(F.map_entries(F.try_variant_get(F.when(brackets == 1, parsed), "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")).cast(NAME_VALUE))
    deep = F.aggregate(F.sequence(F.lit(0), brackets), state(F.lit(True), start), level, lambda s: s["items"])
    leaves = F.coalesce(flat, deep)
    named = F.filter(leaves, lambda e: e["name"] != "")
    return F.when(parsed.isNotNull(), F.transform(named, lambda e: F.struct(F.lower(e["name"]).alias("name"), scalar_text(e["value"], plain).alias("value"))))
