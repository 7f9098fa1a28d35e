"""Look-up of masked texts in a finished template dictionary, and tagging of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import templates as tpl
from faultline.staging import fits_broadcast, stage

_BUCKET = ["n", "prefix"]


def join_unique(rows: DataFrame, side: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join rows to a side with one row per key, where one key may be most of the rows.

    A side that measures small is broadcast and the rows stay where they are. Otherwise both are
    shuffled on the key; adaptive execution splits the rows of a hot key over several tasks, each
    with its one row of the side.
    """
    return rows.join(F.broadcast(side) if fits_broadcast(side) else side, on, how)


def join_bucket(texts: DataFrame, per_bucket: DataFrame, how: str) -> DataFrame:
    """Join texts to the one row of their bucket (n, prefix)."""
    return join_unique(texts, stage(per_bucket, "buckets", measured=True), _BUCKET, how)


def match_texts(
    texts: DataFrame, templates: DataFrame, sim_threshold: float = 0.5
) -> DataFrame:
    """Add event_id and template of the best match in the text's bucket, null below threshold.

    ``texts`` has one row per masked text (masked, n, prefix, ...). The templates of a bucket
    travel as one array, so each text is compared in place and no pair becomes a row. Highest
    similarity wins, the earliest template on ties.
    """
    # The tokens joined by blanks are the template, so only they travel.
    per_bucket = templates.groupBy(*_BUCKET).agg(
        F.collect_list(
            F.struct("ord", "event_id", tpl.tokens(F.col("template")).alias("tokens"))
        ).alias("known")
    )
    scored = F.transform(
        "known",
        lambda t: F.struct(
            tpl.matching_positions(t["tokens"], F.col("toks")).alias("hits"),
            (-t["ord"]).alias("earliness"),
            t["event_id"].alias("event_id"),
            t["tokens"].alias("tokens"),
        ),
    )
    best = F.col("best")
    share = best["hits"] / F.nullif(F.col("width"), F.lit(0))
    good = best.isNotNull() & F.coalesce(share >= F.lit(float(sim_threshold)), F.lit(True))
    return (
        join_bucket(texts, per_bucket, "left")
        # Used twice, the list stays a column; else Spark splits the text anew for every template.
        .withColumn("toks", tpl.tokens(F.col("masked")))
        .withColumns({"best": F.array_max(scored), "width": F.size("toks")})
        .select(
            *texts.columns,
            F.when(good, best["event_id"]).alias("event_id"),
            F.when(good, F.array_join(best["tokens"], " ")).alias("template"),
        )
    )


def resolve_texts(matched: DataFrame, neighbours: DataFrame | None) -> DataFrame:
    """Settle each text: its match, else its nearest neighbour, else the unknown id.

    ``neighbours`` has masked, event_id, similarity and template of the texts resolved by
    similarity. Adds resolved_via_oov and oov_similarity, null where the match was direct.
    """
    if neighbours is None:
        near = matched.withColumns(
            {
                "near_id": F.lit(None).cast("string"),
                "near_template": F.lit(None).cast("string"),
                "near_similarity": F.lit(None).cast("double"),
            }
        )
    else:
        near = matched.join(
            neighbours.select(
                "masked",
                F.col("event_id").alias("near_id"),
                F.col("template").alias("near_template"),
                F.col("similarity").alias("near_similarity"),
            ),
            "masked",
            "left",
        )
    direct = F.col("event_id").isNotNull()
    kept = [c for c in matched.columns if c not in ("event_id", "template")]
    return near.select(
        *kept,
        F.coalesce("event_id", "near_id", F.lit(tpl.UNKNOWN_ID)).alias("event_id"),
        F.coalesce("template", "near_template", "masked").alias("template"),
        F.when(~direct, F.col("near_id").isNotNull()).alias("resolved_via_oov"),
        F.when(~direct, F.col("near_similarity")).alias("oov_similarity"),
    )


def tag_entries(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Give every entry the id of its masked text, its template and its dynamic values.

    A text that is not among the resolved ones is unknown and stands for itself.
    """
    message = F.col("message")
    keyed = entries.withColumns({"masked": tpl.masked_text(message), "params": tpl.params(message)})
    tags = resolved.select("masked", "event_id", "template", "resolved_via_oov", "oov_similarity")
    joined = join_unique(keyed, stage(tags, "tags", measured=True), ["masked"], "left")
    return joined.select(
        *entries.columns,
        F.coalesce("event_id", F.lit(tpl.UNKNOWN_ID)).alias("event_id"),
        F.coalesce("template", "masked").alias("template"),
        "params",
        "resolved_via_oov",
        "oov_similarity",
    )


def template_text(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Add the template of each row's event_id; an id the dictionary lacks stands for itself."""
    texts = templates.select("event_id", "template")
    return join_unique(rows, texts, ["event_id"], "left").withColumn(
        "template", F.coalesce("template", "event_id")
    )
