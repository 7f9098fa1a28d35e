"""Column functions over message text: masking, tokens, similarity, merge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.lines import UNEVEN_SPACE, strip

WILDCARD = "<*>"
EMPTY_PREFIX = "<empty>"
UNKNOWN_ID = "<unk>"

# What counts as a dynamic value, leftmost alternative first: a MAC address, an
# IPv4 address, a hexadecimal number, a number. Numbers stand between word boundaries, spelled
# as look-arounds over letters, digits and underscore because ``\b`` differs between Java
# releases beside non-ASCII text. The first look-ahead and the place of each look-behind only
# let the search pass over other characters quickly.
_WORD = r"[\p{L}\p{N}_]"
_ENDS = rf"(?!{_WORD})"
DYNAMIC = r"(?=[0-9a-fA-F\p{Nd}])(?:" + "|".join([
    r"(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}",
    r"(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}",
    rf"0(?<!{_WORD}0)x[0-9a-fA-F]+{_ENDS}",
    rf"\p{{Nd}}(?<!{_WORD}\p{{Nd}})\p{{Nd}}*(?:\.\p{{Nd}}+)?{_ENDS}",
]) + ")"


def mask(message: Column) -> Column:
    """Replace every dynamic value by the wildcard."""
    return F.regexp_replace(message, DYNAMIC, WILDCARD)


def params(message: Column) -> Column:
    """The dynamic values, in order."""
    return F.regexp_extract_all(message, F.lit(DYNAMIC), F.lit(0))


def masked_text(message: Column) -> Column:
    """Masked tokens joined by one blank: equal texts are exactly equal token lists."""
    return strip(F.regexp_replace(mask(message), UNEVEN_SPACE, " "))


def tokens(masked: Column) -> Column:
    """Token list of a ``masked_text``."""
    return F.when(masked == "", F.array().cast("array<string>")).otherwise(F.split(masked, " "))


def n_tokens(masked: Column) -> Column:
    """Token count of a ``masked_text`` without building the list."""
    blanks = F.char_length(masked) - F.char_length(F.replace(masked, F.lit(" "), F.lit("")))
    return F.when(masked == "", F.lit(0)).otherwise(blanks + F.lit(1)).cast("int")


def prefix(masked: Column) -> Column:
    """First token, which with the count selects the bucket of candidate templates."""
    return F.when(masked == "", F.lit(EMPTY_PREFIX)).otherwise(F.substring_index(masked, " ", 1))


def matching_positions(template: Column, toks: Column) -> Column:
    """Positions where the template has a wildcard or the same token; equal lengths assumed."""
    same = F.zip_with(toks, template, lambda t, m: (m == WILDCARD) | (m == t))
    return F.size(F.filter(same, lambda hit: hit))


def similarity(template: Column, toks: Column) -> Column:
    """Share of matching positions; 0 for unequal lengths, 1 for two empty lists."""
    return (
        F.when(F.size(template) != F.size(toks), F.lit(0.0))
        .when(F.size(template) == 0, F.lit(1.0))
        .otherwise(matching_positions(template, toks) / F.size(template))
    )


def merge(template: Column, toks: Column) -> Column:
    """Template that covers both: differing positions become wildcards."""
    return F.zip_with(toks, template, lambda t, m: F.when(t == m, t).otherwise(F.lit(WILDCARD)))
