"""Working folders that all executors can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: What is written between steps is read once or twice; disk is what it costs.
CODEC = "zstd"

_own: dict[str, str | None] = {}  # by application, where the session names no folder


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from the session; where none is set, a temporary one of our own, on one machine only."""
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _own.setdefault(app, None) or tempfile.mkdtemp(prefix="wayframe-")
        _own[app] = path
    return path.rstrip("/")


_made: dict[str, list[str]] = {}  # folders by application, in the order in which they were named


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one."""
    path = f"{shared_dir(spark)}/wayframe/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """The folders that this application has named so far and not cleared."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def clear(spark: SparkSession, folders: Iterable[str]) -> None:
    """Remove folders that :func:`fresh_dir` named in this application, once nothing reads what was written there; others stay.

    A DataFrame that was settled is read from its folder whenever it is used, so clear what is done with only.
    """
    own = _made.get(spark.sparkContext.applicationId, [])
    for path in [p for p in folders if p in own]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        own.remove(path)


def settle(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts the lineage and keeps column pruning."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
