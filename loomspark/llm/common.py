"""What the operators of this subpackage share: the shared folder, written tables, bounded Arrow pieces, distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset on a local master a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _FALLBACK:
            _FALLBACK[app] = tempfile.mkdtemp(prefix="loomspark-")
        folder = _FALLBACK[app]
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which release() deletes."""
    path = f"{shared_folder(spark)}/loomspark-{tag}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, tag: str, hashes: tuple[str, ...] = ()) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, and a lost executor loses nothing.

    hashes are Parquet columns of values that seldom repeat, for which no dictionary is tried.
    """
    path = new_path(df.sparkSession, tag)
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in hashes}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomspark_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more, and the shuffles behind them, which Spark drops once the driver's JVM has collected their handles."""
    for df in tables:
        path = getattr(df, "_loomspark_path", None)
        if path:
            delete_path(spark, path)
            _WRITTEN.get(spark.sparkContext.applicationId, [path]).remove(path)
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession, keep: str | None = None) -> None:
    """Delete all that the operators have written in the shared folder, but for one path; call it when their results have been stored."""
    written = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in written:
        if path != keep:
            delete_path(spark, path)
    if keep in written:
        _WRITTEN[spark.sparkContext.applicationId] = [keep]


def small_enough(df: DataFrame, rows: int, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most so many (narrow) rows, else as it is, for Spark to shuffle.

    Where rows hold arrays, weight gives their lengths, and the sum of one more than each counts.
    """
    if weight is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    total = df.agg(F.sum(weight.cast("long") + 1)).first()[0] or 0
    return F.broadcast(df) if total <= rows else df


def by_place(df: DataFrame) -> tuple[DataFrame, Callable]:
    """df with columns named by their place, which clash with no name an operator uses, and a function that restores the names.

    restored(out, name=column, ...) selects the original columns from out, some of them replaced, or new ones added at the end.
    """
    names = df.columns

    def restored(out: DataFrame, **more: Column) -> DataFrame:
        own = [more.get(c, F.col(f"_own{i}")).alias(c) for i, c in enumerate(names)]
        return out.select(*own, *[x.alias(c) for c, x in more.items() if c not in names])

    return df.toDF(*[f"_own{i}" for i in range(len(names))]), restored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch whose texts hold about max_bytes at most (one row at least), so memory follows no batch size."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        limit = (ends[start - 1] if start else 0) + max_bytes
        stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, all else left alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_rank(df: DataFrame, group: str, order: list[str], out: str, parts: int | None = None) -> DataFrame:
    """df with a gapless 0-based rank of each row in its group, though one group may hold most rows.

    Rows are range-partitioned by group and order, so that a large group spans
    many tasks; each row's place in its partition comes from its row id, and
    the partition's start within the group from the counts of (partition,
    group), of which there are at most partitions + groups. The sorted rows
    are written first, since two evaluations of a range partitioning may cut
    it at different points. Null groups form one group. df should be narrow.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order]
    mid = F.monotonically_increasing_id()
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_mid", mid)
    placed = materialize(placed.withColumn("_part", F.shiftright("_mid", 33)), "rank")
    from pyspark.sql import Window as W

    counts = placed.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    starts = small_enough(starts, 1_000_000)
    joined = placed.join(starts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(out, F.col("_mid") - F.col("_first") + F.col("_before")).drop("_mid", "_part", "_p", "_g", "_first", "_before")
