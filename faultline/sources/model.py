"""The trained model: three parquet tables in one folder.

Each training writes a version of its own below the folder, and then switches the file ``current``
to it, in one step. A training that fails, or is still at work, leaves readers with the whole model
of before. ``current`` names the version before it as well, which stays for jobs that read it; the
one before that is removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from faultline import schemas
from faultline.folders import Folder

_TABLES = {
    "templates": schemas.TEMPLATES,
    "embeddings": schemas.EMBEDDINGS,
    "normal_ids": schemas.NORMAL_IDS,
}
_CURRENT = "current"


class Model(NamedTuple):
    """Template dictionary, its embeddings, and the ids seen in healthy logs."""

    templates: DataFrame
    embeddings: DataFrame | None
    normal_ids: DataFrame | None


@contextmanager
def new_version(spark: SparkSession, model_dir: str) -> Iterator[str]:
    """A folder for the tables of a new version, which is the model when the block ends.

    If the block fails, its tables go and the model stays as it was.
    """
    folder = Folder(spark, model_dir)
    folder.make()
    version = f"version-{uuid.uuid4().hex}"
    try:
        yield f"{model_dir}/{version}"
    except BaseException:
        folder.remove(version)
        raise
    kept, *older = (folder.read(_CURRENT) or "").split() or [None]
    names = [version] if kept is None else [version, kept]
    folder.replace(_CURRENT, "\n".join(names) + "\n", f"{_CURRENT}-{version}")
    for name in older:
        folder.remove(name)


def save_table(df: DataFrame, version: str, name: str) -> DataFrame:
    """Write one table of a version, and read it back."""
    columns = [field.split()[0] for field in _TABLES[name].split(", ")]
    path = f"{version}/{name}"
    df.select(*columns).write.parquet(path)
    return df.sparkSession.read.schema(_TABLES[name]).parquet(path)


def load_model(spark: SparkSession, model_dir: str | None) -> Model | None:
    """The current model in ``model_dir``, or None if it has not been trained."""
    named = Folder(spark, model_dir).read(_CURRENT) if model_dir else None
    if named is None:
        return None
    version = named.split()[0]
    # With an explicit schema the tables are only listed here, not read.
    return Model(
        *(spark.read.schema(_TABLES[name]).parquet(f"{model_dir}/{version}/{name}") for name in _TABLES)
    )
