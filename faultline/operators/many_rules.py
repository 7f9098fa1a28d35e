"""Rules by the hundred: one pass finds which rules a line may match.

Every match of most patterns holds one of a few plain texts. These are taken from the patterns, or
given with the rule, and searched for all rules at once by an Aho-Corasick automaton, whose cost does
not grow with the number of rules. Only the rules it names have their patterns tried on the line, by
Spark's own regular expressions, so results are those of one ``rlike`` each. A rule without such a
text is tried on every line.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Sequence
from re import _constants as op
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.rules import Rule

SHORTEST = 3  # characters of a text worth searching for

# Inline flags that do not change which characters of a pattern are plain.
_KNOWN_FLAGS = _parser.SRE_FLAG_IGNORECASE | _parser.SRE_FLAG_MULTILINE | _parser.SRE_FLAG_DOTALL
_KNOWN_FLAGS |= _parser.SRE_FLAG_UNICODE
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)


def _ascii_forms() -> dict[int, str]:
    """ASCII letters in lower case, and the other letters that match them in any case."""
    forms = {}
    for code in (*range(65, 91), *range(0x80, 0x2200)):
        for form in (chr(code).lower(), chr(code).upper().lower()):
            if form[:1].isascii() and (len(form) == 1 or form[1:] == "̇"):
                forms[code] = form[0]
    return forms


_FORMS = _ascii_forms()


def folded(text: str) -> str:
    return text.translate(_FORMS)


def required_texts(pattern: str) -> tuple[str, ...]:
    """Texts in lower case of which every match holds at least one; none if there are no such.

    The syntax that Java and Python share is understood; for any other there are no texts.
    """
    # Classes of characters and names of groups say nothing about texts.
    pattern = re.sub(r"\\[pP](\{\w+\}|\w)", r"\\w", pattern)
    pattern = re.sub(r"\(\?<(\w+)>", "(", pattern)
    if re.search(r"\[[^\]]*\[", re.sub(r"\\.", "", pattern)):
        return ()  # a set within a set
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = _parser.parse(pattern)
    except (re.error, Warning, OverflowError, RecursionError):
        return ()
    if parsed.state.flags & ~_KNOWN_FLAGS:
        return ()
    return tuple(sorted(_required(parsed) or ()))


def _required(sequence: Iterable) -> frozenset[str] | None:
    """The best set for a sequence: that of the part whose shortest text is the longest."""
    found: list[frozenset[str]] = []
    run = ""
    for kind, value in [*sequence, (None, None)]:
        if kind is op.LITERAL and 32 <= value < 127:
            run += chr(value).lower()
            continue
        if len(run) >= SHORTEST:
            found.append(frozenset([run]))
        run, inner = "", None
        if kind is op.BRANCH:
            parts = [_required(part) for part in value[1]]
            inner = frozenset().union(*parts) if all(parts) else None
        elif kind is op.SUBPATTERN:
            inner = _required(value[3])
        elif kind is op.ATOMIC_GROUP:
            inner = _required(value)
        elif kind in _REPEATS and value[0] > 0:
            inner = _required(value[2])
        if inner:
            found.append(inner)
    return max(found, key=lambda texts: min(map(len, texts)), default=None)


def candidates(rules: Sequence[Rule], value: Column) -> Column:
    """Places in ``rules`` of those that may match the line, as an array."""
    wanted: dict[str, set[int]] = {}
    always: set[int] = set()
    for i, rule in enumerate(rules):
        texts = rule.literals or required_texts(rule.pattern)
        always |= set() if texts else {i}
        for text in texts:
            wanted.setdefault(folded(text), set()).add(i)

    @F.pandas_udf("array<int>")
    def search(lines: pd.Series) -> pd.Series:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, places in wanted.items():
            automaton.add_word(text, places)
        automaton.make_automaton()

        def places_in(line: str | None) -> list[int]:
            if line is None:
                return []
            hit = (places for _, places in automaton.iter(folded(line))) if wanted else ()
            return sorted(always.union(*hit))

        return lines.map(places_in)

    return search(value)


def with_candidates(lines: DataFrame, rules: Sequence[Rule], out: str) -> DataFrame:
    """One row per line and rule that may match it, with the rule's place as ``out``."""
    found = lines.withColumn("_rules", candidates(rules, F.col("value")))
    return found.select(*lines.columns, F.explode("_rules").alias(out))
