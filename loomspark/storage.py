"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset on a local master, a temporary folder of this application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _FALLBACK:
            _FALLBACK[app] = tempfile.mkdtemp(prefix="loomspark-")
        folder = _FALLBACK[app]
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df stored as Parquet in the shared folder and read again; a lost executor then costs no recomputation. released() deletes it."""
    path = f"{shared_folder(df.sparkSession)}/loomspark-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomspark_path = path
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables from written() that nothing reads any more."""
    held = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    for path in [t._loomspark_path for t in tables]:
        _deleted(spark, path)
        held.remove(path)


@contextlib.contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Delete what written() stores within; for work whose results are stored elsewhere at its end."""
    held = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = set(held)
    try:
        yield
    finally:
        for path in [p for p in held if p not in before]:
            _deleted(spark, path)
            held.remove(path)
