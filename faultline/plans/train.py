"""Training: template dictionary, embeddings and the ids of the healthy corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.vectors import Embedder, embed_templates, hash_embedding
from faultline.operators.assemble import assemble_entries
from faultline.operators.matching import match_texts, resolve_texts
from faultline.operators.mining import distinct_masked, mine_counted, number_templates
from faultline.operators.neighbours import resolve_unmatched
from faultline.operators.rare import known_ids
from faultline.sources.logs import list_files, read_lines
from faultline.sources.model import Model, new_version, save_table
from faultline.staging import fits_broadcast, job_staging, stage

SIM_THRESHOLD = 0.5
MAX_CHILDREN = 128
MIN_SIMILARITY = 0.55


def with_positions(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Add pos, one number that orders entries by file_ord, then line_no.

    It counts the lines of all files before, so it is dense and cannot overflow.
    """
    # One narrow row per file, as many as the driver listed.
    sizes = lines.groupBy("file_ord").agg(F.max("line_no").alias("n"))
    earlier = Window.orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        sizes.select("file_ord", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")),
        "file-starts",
        measured=True,
    )
    side = F.broadcast(starts) if fits_broadcast(starts) else starts
    return entries.join(side, "file_ord").withColumn("pos", F.col("first") + F.col("line_no")).drop("first")


def resolve(
    texts: DataFrame,
    model: Model,
    sim_threshold: float = SIM_THRESHOLD,
    min_similarity: float = MIN_SIMILARITY,
    embedder: Embedder = hash_embedding,
) -> DataFrame:
    """Final id and template of each distinct masked text: direct match, else neighbour."""
    matched = match_texts(texts, model.templates, sim_threshold)
    if model.embeddings is None:
        return resolve_texts(matched, None)
    matched = stage(matched, "matched")
    missed = matched.filter(F.col("event_id").isNull())
    if missed.isEmpty():
        return resolve_texts(matched, None)
    queries = stage(
        embed_templates(missed.select(F.col("masked").alias("key")), "key", embedder),
        "missed",
    )
    near = resolve_unmatched(queries, model.embeddings, min_similarity).join(
        model.templates.select("event_id", "template"), "event_id"
    )
    return resolve_texts(matched, near.withColumnRenamed("key", "masked"))


def train_entries(
    entries: DataFrame,
    model_dir: str,
    sim_threshold: float = SIM_THRESHOLD,
    max_children: int = MAX_CHILDREN,
    embedder: Embedder = hash_embedding,
) -> Model:
    """Train on entries with pos, message and normal (true for the healthy corpus).

    The model in ``model_dir`` is replaced as a whole, when all of the new one is written.
    """
    texts = stage(distinct_masked(entries), "texts")
    # Every trained text has a match in the finished dictionary, though not always the
    # template it was folded into, so counts and healthy ids come from a second look-up.
    numbered = number_templates(mine_counted(texts, sim_threshold, max_children))
    with new_version(entries.sparkSession, model_dir) as version:
        templates = save_table(numbered, version, "templates")
        embeddings = save_table(
            embed_templates(templates.select("event_id", "template"), "template", embedder),
            version,
            "embeddings",
        )
        normal = save_table(known_ids(numbered.filter("normal")), version, "normal_ids")
    return Model(templates, embeddings, normal)


def train(
    spark: SparkSession,
    normal_dir: str,
    anomaly_dir: str,
    model_dir: str,
    sim_threshold: float = SIM_THRESHOLD,
    max_children: int = MAX_CHILDREN,
    embedder: Embedder = hash_embedding,
    skip_unreadable: bool = False,
) -> Model:
    """Train on two directories of logs; the second only widens the dictionary.

    A file that fails while it is read is an error. With ``skip_unreadable`` the rest of it is left
    out instead, and Spark does not tell of which files.
    """
    normal_files = list_files(spark, normal_dir)
    n_normal = normal_files.count()
    anomaly_files = list_files(spark, anomaly_dir, corpus_rank=1, first_ord=n_normal)
    if n_normal + anomaly_files.count() == 0:
        raise ValueError(f"no log files in {normal_dir} or {anomaly_dir}")
    with job_staging(spark):
        lines = [
            read_lines(spark, folder, files, skip_unreadable)
            for folder, files in ((normal_dir, normal_files), (anomaly_dir, anomaly_files))
        ]
        every = with_positions(
            assemble_entries(lines[0]).unionByName(assemble_entries(lines[1])),
            lines[0].unionByName(lines[1]).select("file_ord", "line_no"),
        )
        healthy = F.col("file_ord") < n_normal
        return train_entries(
            every.select("pos", "message", healthy.alias("normal")),
            model_dir,
            sim_threshold,
            max_children,
            embedder,
        )
