"""Diagnostics of parsed requests: rows with a level and a message, and a logger for the driver with bounded values."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels in order; what is below the chosen one isn't told.
LEVELS = ("debug", "info", "warn", "error", "off")
#: So much of a value a message shows: bytes in the logger, characters in a table of diagnostics.
MAX_VALUE = 512


def shorten(value: object, most: int = MAX_VALUE) -> str:
    """A text cut to so many bytes of UTF-8, never inside a character."""
    raw = str(value).encode("utf-8", "surrogatepass")
    return str(value) if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "..."


class _Shorten(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        if isinstance(record.args, tuple):
            record.args = tuple(shorten(x) if isinstance(x, str) else x for x in record.args)
        return True


def logger(level: str = "warn", name: str = "routeloom") -> logging.Logger:
    """The library's logger; ``off`` silences it."""
    out = logging.getLogger(name)
    numbers = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR, "off": logging.CRITICAL + 1}
    out.setLevel(numbers[level])
    if not any(isinstance(f, _Shorten) for f in out.filters):
        out.addFilter(_Shorten())
    return out


def diagnostics(parsed: DataFrame, level: str = "warn") -> DataFrame:
    """(seq, level, message, value) of parsed rows: an error for a URL that can't be read, a warning for a bad query or body.

    With ``info`` each request is told, with ``debug`` its parameters too.
    """
    least = LEVELS.index(level)
    e, shown = F.col("error"), F.coalesce("url", F.lit(""))
    lenient = e.isin("bad query", "bad body")
    rows = parsed.select("seq", "error", "method", "params", F.when(F.length(shown) > MAX_VALUE, F.concat(F.substring(shown, 1, MAX_VALUE), F.lit("..."))).otherwise(shown).alias("value"))
    entry = lambda name, message: F.struct(F.lit(name).alias("level"), message.alias("message"), F.col("value"))
    told = []
    if least <= LEVELS.index("error"):
        told.append(F.when(e.isNotNull() & ~lenient, entry("error", e)))
    if least <= LEVELS.index("warn"):
        told.append(F.when(lenient, entry("warn", e)))
    if least <= LEVELS.index("info"):
        told.append(F.when(e.isNull(), entry("info", F.concat(F.lit("request "), "method"))))
    if least <= LEVELS.index("debug"):
        told.append(F.when(e.isNull(), entry("debug", F.concat(F.lit("parameters "), F.expr("array_join(transform(params, p -> p.name), ', ')")))))
    none = F.array().cast("array<struct<level:string,message:string,value:string>>")
    return rows.select("seq", F.explode(F.array_compact(F.array(*told)) if told else none).alias("d")).select("seq", "d.*")
