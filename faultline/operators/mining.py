"""Template mining: groups of similar masked messages, found in order of first occurrence.

Messages meet only inside a bucket (token count, first token). A message joins the bucket's
most similar template if the share of equal positions reaches the threshold, and every
position that differs becomes a wildcard; otherwise it starts a template. Once a bucket
holds ``max_children`` templates, the next message that fits none adds a template of
wildcards, which from then on takes everything.

The result depends on the order, yet little of the work is sequential:

* Repeats change nothing, since some template already covers the text, so only distinct
  texts count, each at its first position. That is a plain hash aggregation.
* A text covered by the templates of some moment is covered by all later ones, so it can be
  dropped unseen. Every other text changes the templates, by adding one or by widening at
  least one position, and a bucket has room for only about ``max_children * tokens`` such
  changes.

Any first part of a bucket, in order, can be folded alone. So each round finds, by counts per cell
of positions, where at most ``2 * round_size`` open texts of every bucket end, and drops the later
texts before anything is shuffled. One task per bucket folds the rest in order, and all later
texts that the new templates cover are dropped in parallel.

A bucket that one round takes whole has its texts and its finished templates in one task, so
``mine_counted`` looks its texts up there as well and no text travels a second time for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import templates as tpl
from faultline.operators.matching import join_bucket, join_unique, match_texts
from faultline.operators.ordered import with_row_number
from faultline.staging import stage

ROUND_SIZE = 20_000
POSITION_CHUNK = 1 << 20

_BUCKET = ["n", "prefix"]
# Cells a bucket's positions are counted in to find where a round ends.
CELLS = 1024

# Tokens of a bucket that its task keeps for the look-up; beyond them the texts go to match_texts.
HELD_TOKENS = 1 << 22

_STATE = (
    "n INT, prefix STRING, pos BIGINT, template STRING, last_pos BIGINT, open BOOLEAN, "
    "nth INT, n_lines BIGINT, normal BOOLEAN"
)
# What a fold reads; the text of a template, is_text false, is the template.
_FOLDED = ["n", "prefix", "is_text", "pos", "nth", "masked", "cut", "n_lines", "normal"]
_STATE_COLUMNS = [field.split()[0] for field in _STATE.split(", ")]


def distinct_masked(messages: DataFrame) -> DataFrame:
    """(pos, message, normal) rows to one row per masked text.

    Gives masked, n, prefix, the first pos, n_lines, and whether any line was normal.
    """
    return (
        messages.select("pos", "normal", tpl.masked_text(F.col("message")).alias("masked"))
        .groupBy("masked")
        .agg(
            F.min("pos").alias("pos"),
            F.count(F.lit(1)).alias("n_lines"),
            F.bool_or("normal").alias("normal"),
        )
        .select(
            "masked",
            tpl.n_tokens(F.col("masked")).alias("n"),
            tpl.prefix(F.col("masked")).alias("prefix"),
            "pos",
            "n_lines",
            "normal",
        )
    )


def mine_templates(
    texts: DataFrame,
    sim_threshold: float = 0.5,
    max_children: int = 128,
    round_size: int = ROUND_SIZE,
) -> DataFrame:
    """Templates of the distinct masked ``texts``: n, prefix, pos (of creation), template."""
    narrow = texts.select(*_BUCKET, "pos", "masked")
    return _mined(narrow, sim_threshold, max_children, round_size).select(
        *_BUCKET, "pos", "template"
    )


def mine_counted(
    texts: DataFrame,
    sim_threshold: float = 0.5,
    max_children: int = 128,
    round_size: int = ROUND_SIZE,
) -> DataFrame:
    """``mine_templates``, and of each template its lines: n_lines and whether any is normal.

    ``nth`` is the template's place in its bucket. ``texts`` should be a written table: those of
    buckets that take more than one task are looked up by ``match_texts``.
    """
    narrow = texts.select(*_BUCKET, "pos", "masked", "n_lines", "normal")
    mined = _mined(narrow, sim_threshold, max_children, round_size).select(
        *_BUCKET, "pos", "template", "nth", "n_lines", "normal"
    )
    large = mined.filter(F.col("n_lines").isNull())
    keys = stage(large.select(*_BUCKET).distinct(), "large-buckets", measured=True)
    if keys.isEmpty():
        return mined
    own = F.concat_ws(" ", F.col("n"), F.col("nth"), F.col("prefix"))
    matched = match_texts(
        join_unique(narrow, keys, _BUCKET, "inner"),
        large.select(*_BUCKET, F.col("nth").alias("ord"), own.alias("event_id"), "template"),
        sim_threshold,
    )
    counts = matched.groupBy("event_id").agg(
        F.sum("n_lines").alias("more_lines"), F.bool_or("normal").alias("more_normal")
    )
    counts = stage(counts.filter(F.col("event_id").isNotNull()), "line-counts", measured=True)
    return (
        join_unique(mined.withColumn("event_id", own), counts, ["event_id"], "left")
        .withColumn("n_lines", F.coalesce("n_lines", "more_lines", F.lit(0).cast("bigint")))
        .withColumn("normal", F.coalesce("normal", "more_normal", F.lit(False)))
        .select(*mined.columns)
    )


def _mined(
    texts: DataFrame, sim_threshold: float, max_children: int, round_size: int
) -> DataFrame:
    """The final state of every bucket, a row a template."""
    if not 0 < sim_threshold <= 1:
        raise ValueError("sim_threshold must lie in (0, 1]")
    fold = _folder(sim_threshold, max_children)
    remaining = texts
    state = stage(_fold_buckets(_first(remaining, round_size), fold), "templates")
    finished = state.filter(~F.col("open"))
    while not (going_on := state.filter("open")).isEmpty():
        # Buckets with more than round_size open texts; nothing else is read again.
        remaining = stage(_uncovered(remaining, going_on), "open-texts")
        known = going_on.select(*_BUCKET, "pos", F.col("template").alias("masked"), "nth")
        state = stage(_fold_buckets(_first(remaining, round_size, known), fold), "templates")
        finished = finished.unionByName(state.filter(~F.col("open")))
    return finished


def number_templates(mined: DataFrame) -> DataFrame:
    """Add the position in creation order, ord, and the id made from it.

    Counts from ``mine_counted`` stay. Its ``nth`` settles the order of equal positions, so that
    numbers are the same when they are computed again.
    """
    counted = [c for c in ("n_lines", "normal") if c in mined.columns]
    ties = [*_BUCKET, "nth"] if "nth" in mined.columns else []
    numbered = with_row_number(
        mined,
        keys=[],
        coarse={"chunk": F.floor(F.col("pos") / POSITION_CHUNK).cast("bigint")},
        coarse_order=[F.col("_unit_chunk")],
        order=[F.col(c) for c in ("pos", *ties)],
        out="ord",
    ).withColumn("ord", F.col("ord") - 1)
    return numbered.select(
        F.format_string("E%04d", "ord").alias("event_id"),
        "n",
        "prefix",
        tpl.tokens(F.col("template")).alias("tokens"),
        "template",
        "ord",
        *counted,
    )


def count_lines(templates: DataFrame, matched: DataFrame) -> DataFrame:
    """Add n_lines: lines whose masked text matches the template in the finished dictionary."""
    lines = matched.groupBy("event_id").agg(F.sum("n_lines").alias("n_lines"))
    # A written table: a filter for the join's keys would repeat the look-up below it.
    lines = stage(lines, "line-counts", measured=True)
    return join_unique(templates, lines, ["event_id"], "left").withColumn(
        "n_lines", F.coalesce("n_lines", F.lit(0).cast("bigint"))
    )


def _first(texts: DataFrame, round_size: int, known: DataFrame | None = None) -> DataFrame:
    """The first texts of each bucket, at most ``2 * round_size``, and its templates so far.

    ``cut`` tells whether the bucket has more. Later texts leave in the map step.
    """
    ends = round_ends(texts, round_size)
    if ends is None:
        head = texts.withColumn("cut", F.lit(False))
    else:
        head = join_unique(texts, ends, _BUCKET, "left").filter(
            F.col("end").isNull() | (F.col("pos") < F.col("end"))
        )
        head = head.withColumn("cut", F.col("end").isNotNull())
    counted = "n_lines" in texts.columns
    counts = {
        "n_lines": F.col("n_lines") if counted else F.lit(None).cast("bigint"),
        "normal": F.col("normal") if counted else F.lit(None).cast("boolean"),
    }
    head = head.withColumns({"is_text": F.lit(True), "nth": F.lit(0), **counts}).select(*_FOLDED)
    if known is None:
        return head
    none = {name: F.lit(None).cast(head.schema[name].dataType) for name in counts}
    return head.unionByName(
        known.withColumns({"is_text": F.lit(False), "cut": F.lit(False), **none}).select(*_FOLDED)
    )


def round_ends(texts: DataFrame, round_size: int) -> DataFrame | None:
    """For buckets of over ``round_size`` texts a position ``end``: 1 to 2 * round_size lie before.

    None if no bucket is so large. Positions are unique within a bucket, so the search, which
    looks closer at a cell that holds too many, ends at cells of one position at the latest.
    """
    sizes = texts.groupBy(*_BUCKET).agg(
        F.count(F.lit(1)).alias("many"),
        F.min("pos").alias("low"),
        (F.max("pos") + 1).alias("high"),
    )
    open_spans = stage(sizes.filter(F.col("many") > round_size).drop("many"), "large-buckets")
    found = None
    while not open_spans.isEmpty():
        width = F.ceil((F.col("high") - F.col("low")) / F.lit(CELLS))
        spans = open_spans.withColumn("width", width.cast("bigint"))
        cell = F.floor((F.col("pos") - F.col("low")) / F.col("width")).cast("bigint")
        inside = (
            join_unique(texts.select(*_BUCKET, "pos"), spans, _BUCKET, "inner")
            .filter((F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("high")))
            .groupBy(*_BUCKET, "low", "width", cell.alias("cell"))
            .agg(F.count(F.lit(1)).alias("many"))
        )
        per_bucket = inside.groupBy(*_BUCKET, "low", "width").agg(
            F.array_sort(F.collect_list(F.struct("cell", "many"))).alias("cells")  # at most CELLS
        )
        looked = stage(
            per_bucket.select(
                *_BUCKET,
                "low",
                "width",
                F.element_at("cells", 1)["cell"].alias("first"),
                _last_within("cells", 2 * round_size).alias("last"),
            ),
            "bucket-cells",
        )
        ends = looked.filter("last >= 0").select(
            *_BUCKET, (F.col("low") + (F.col("last") + 1) * F.col("width")).alias("end")
        )
        found = ends if found is None else found.unionByName(ends)
        closer = F.col("low") + F.col("first") * F.col("width")
        open_spans = looked.filter("last < 0").select(
            *_BUCKET, closer.alias("low"), (closer + F.col("width")).alias("high")
        )
    return found


def _last_within(cells: str, most: int) -> Column:
    """The last cell up to which at most ``most`` texts lie; -1 if the first has more."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-1).cast("bigint").alias("last"))

    def add(done: Column, cell: Column) -> Column:
        total = done["sum"] + cell["many"]
        return F.struct(
            total.alias("sum"), F.when(total <= most, cell["cell"]).otherwise(done["last"]).alias("last")
        )

    return F.aggregate(cells, start, add)["last"]


def _fold_buckets(rows: DataFrame, fold) -> DataFrame:
    """Stream every bucket, in order, through ``fold``: many small buckets share a task."""
    ordered = rows.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET, "is_text", "pos", "nth")
    return ordered.select(*_FOLDED).mapInPandas(fold, _STATE)


def _uncovered(texts: DataFrame, going_on: DataFrame) -> DataFrame:
    per_bucket = going_on.groupBy(*_BUCKET).agg(
        F.max("last_pos").alias("last_pos"),
        # At most max_children + 1 of them.
        F.collect_list(tpl.tokens(F.col("template"))).alias("known"),
    )
    toks = tpl.tokens(F.col("masked"))
    left = join_bucket(texts, per_bucket, "inner").filter(F.col("pos") > F.col("last_pos"))
    return left.filter(~F.exists("known", lambda t: _covers(t, toks))).select(*texts.columns)


def _covers(template: Column, toks: Column) -> Column:
    pairs = F.zip_with(toks, template, lambda t, m: (m == tpl.WILDCARD) | (m == t))
    return F.forall(pairs, lambda same: same)


class _Bucket:
    """Templates of one bucket as rows of token codes; code 0 is the wildcard."""

    def __init__(self, n: int, prefix: str, max_children: int) -> None:
        self.n, self.prefix, self.max_children = n, prefix, max_children
        self.codes = {tpl.WILDCARD: 0}
        self.grid = np.zeros((4, n), dtype=np.int32)
        self.created: list[int] = []
        self.cut, self.last_pos = False, -1
        # Codes, lines and normal of every text, while all of the bucket is here and they are few.
        self.held: list[tuple] | None = []

    @property
    def swallows_all(self) -> bool:
        return len(self.created) > self.max_children

    def encode(self, text: str) -> list[int]:
        codes = self.codes
        return [codes.setdefault(t, len(codes)) for t in text.split(" ")] if self.n else []

    def append(self, pos: int, toks: list[int] | np.ndarray) -> None:
        size = len(self.created)
        if size == len(self.grid):
            self.grid = np.vstack([self.grid, np.zeros_like(self.grid)])
        self.grid[size] = toks
        self.created.append(pos)

    def add_known(self, pos: int, template: str) -> None:
        self.append(pos, self.encode(template))
        self.held = None

    def add_text(self, pos: int, text: str, cut: bool, n_lines, normal, sim_threshold: float) -> None:
        self.cut, self.last_pos = cut, pos
        if cut or n_lines is None or (self.held and len(self.held) * self.n > HELD_TOKENS):
            self.held = None
        if self.swallows_all and self.held is None:
            return
        toks = np.array(self.encode(text), np.int32)
        if self.held is not None:
            self.held.append((toks, n_lines, normal))
        if self.swallows_all:
            return
        size = len(self.created)
        if size:
            known = self.grid[:size]
            equal = ((known == 0) | (known == toks)).sum(axis=1)
            best = int(equal.argmax())  # the earliest of equally similar ones
            if self.n == 0 or equal[best] / self.n >= sim_threshold:
                known[best][known[best] != toks] = 0
                return
        self.append(pos, toks if size < self.max_children else [0] * self.n)

    def counts(self, sim_threshold: float) -> list[tuple]:
        """n_lines and normal of each finished template; nulls if texts are not all held.

        As in ``match_texts``: most equal positions, the earliest on ties, none below the threshold.
        """
        size = len(self.created)
        if not self.held:
            return [(None, None)] * size
        lines, normal = [0] * size, [False] * size
        texts = np.array([codes for codes, _, _ in self.held], np.int32).reshape(-1, self.n)
        best, most = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int64)
        for at, codes in enumerate(self.grid[:size]):
            hits = ((texts == codes) | (codes == 0)).sum(axis=1)
            best[hits > most] = at
            most = np.maximum(most, hits)
        found = most / max(self.n, 1) >= sim_threshold if self.n else most >= 0
        for at, fits, (_, many, good) in zip(best.tolist(), found.tolist(), self.held):
            if fits:
                lines[at] += many
                normal[at] = normal[at] or bool(good)
        return list(zip(lines, normal))

    def templates(self, sim_threshold: float) -> Iterator[tuple]:
        words = list(self.codes)
        is_open = self.cut and not self.swallows_all
        counts = self.counts(sim_threshold)
        for nth, (pos, codes) in enumerate(zip(self.created, self.grid.tolist())):
            template = " ".join([words[c] for c in codes])
            yield self.n, self.prefix, pos, template, self.last_pos, is_open, nth, *counts[nth]


def _folder(sim_threshold: float, max_children: int):
    """The sequential step over rows sorted by bucket, templates before texts."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The rows of a bucket wait until a second one comes: a lone text is its template.
        first: tuple | None = None
        bucket: _Bucket | None = None

        def add(row: tuple) -> None:
            _, _, is_text, pos, _, text, cut, n_lines, normal = row
            if is_text:
                bucket.add_text(pos, text, cut, n_lines, normal, sim_threshold)
            else:
                bucket.add_known(pos, text)

        def finished() -> Iterator[tuple]:
            nonlocal first, bucket
            if bucket is not None:
                yield from bucket.templates(sim_threshold)
            elif first is not None:
                n, prefix, _, pos, _, text, cut, n_lines, normal = first
                seen = (None, None) if cut else (n_lines, normal)
                yield n, prefix, pos, text, pos, cut, 0, *seen
            first = bucket = None

        for batch in batches:
            done: list[tuple] = []
            for row in zip(*[_values(batch[c]) for c in _FOLDED]):
                if first is None or first[0] != row[0] or first[1] != row[1]:
                    done.extend(finished())
                    first = row
                    if not row[2] or not max_children:
                        bucket = _Bucket(row[0], row[1], max_children)
                        add(row)
                    continue
                if bucket is None:
                    bucket = _Bucket(row[0], row[1], max_children)
                    add(first)
                add(row)
            yield _state_rows(done)
        yield _state_rows(list(finished()))

    return fold


def _values(column: pd.Series) -> list:
    """Plain values, nulls as None; only counts may be null."""
    if column.name in ("n_lines", "normal"):
        column = column.astype(object).where(column.notna(), None)
    return column.tolist()


def _state_rows(rows: list[tuple]) -> pd.DataFrame:
    state = pd.DataFrame(rows, columns=_STATE_COLUMNS, dtype=object)
    return state.astype({"n_lines": "Int64", "normal": "boolean"})
