"""Column functions over one raw line of the form ``[seconds.frac] [thread] [component] message``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, and the line and level patterns.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a class. Explicit ranges are far cheaper than ``(?U)\s``.
_INNER_SPACE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = rf"[ {_INNER_SPACE}]"
# A run of white space that is more than one blank.
UNEVEN_SPACE = rf" {SPACE}+|[{_INNER_SPACE}]{SPACE}*"
_BRACKET = r"\[[^\]]+\]"
PS_LINE = rf"(?d)^\[\p{{Nd}}+\.\p{{Nd}}+\]{SPACE}+{_BRACKET}{SPACE}+{_BRACKET}{SPACE}+.+$"
LEVEL = rf"^(Level\p{{Nd}}+|Version|Warning|Error|Debug){SPACE}*:"
TIMESTAMP = rf"^{SPACE}*\[(\p{{Nd}}+\.\p{{Nd}}+)\]"
TAG = r"\[([^\[\]]+)\]"
TAG_SEARCH_CHARS = 200


def strip(text: Column) -> Column:
    """Drop leading and trailing white space of any kind (``trim`` drops blanks only)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_ps_line(value: Column) -> Column:
    """True for a well-formed log line; only those open entries and trigger rules."""
    # The prefix test stays in generated code and spares most other lines the regex.
    return value.startswith("[") & value.rlike(PS_LINE)


def is_continuation(value: Column) -> Column:
    """True for a line that extends the entry above it."""
    return value.startswith(" ") | value.startswith("\t")


def to_millis(seconds: Column) -> Column:
    """Seconds as text to whole milliseconds, truncated."""
    return (seconds.try_cast("double") * F.lit(1000)).try_cast("bigint")


def ps_elapsed_ms(value: Column) -> Column:
    """Milliseconds of a line already known to be a PS line."""
    return to_millis(F.substring_index(F.substring_index(value, "]", 1), "[", -1))


def ps_fields(value: Column) -> dict[str, Column]:
    """elapsed_ms, component, level and message of a line already known to be a PS line.

    No bracket group may hold a ``]``, so one split on it yields every field and the
    pattern is not run again per group.
    """
    parts = F.split(value, r"\]", 4)
    tag = F.get(parts, 2)
    message = strip(F.get(parts, 3))
    level = F.regexp_extract(message, LEVEL, 1)
    return {
        "elapsed_ms": ps_elapsed_ms(value),
        "component": strip(F.substr(tag, F.instr(tag, "[") + F.lit(1))),
        "level": F.when(level == "", F.lit("Unknown")).otherwise(level),
        "message": message,
    }


def raw_meta(value: Column) -> dict[str, Column]:
    """timestamp text and component tag of any raw line, as a rule finding shows them."""
    tags = F.regexp_extract_all(F.substring(value, 1, TAG_SEARCH_CHARS), F.lit(TAG), F.lit(1))
    timestamp = F.regexp_extract(value, TIMESTAMP, 1)
    return {
        "timestamp": timestamp,
        "elapsed_ms": F.coalesce(to_millis(F.nullif(timestamp, F.lit(""))), F.lit(0).cast("bigint")),
        "component": F.coalesce(F.get(tags, 2), F.get(tags, 1), F.lit("")),
    }
