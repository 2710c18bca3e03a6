"""Splits of records into train, val and test without leaks between files or groups."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import base_filename, norm_path, strip_extension
from loomspark.operators.graph import merged_groups
from loomspark.operators.ordinals import with_ordinal

#: Keys that the compatible shuffle brings to the driver at most.
COMPATIBLE_KEYS = 5_000_000


def _checked(train: float, val: float) -> None:
    if 1.0 - train - val < 0:
        raise ValueError(f"train ratio {train} and val ratio {val} are more than 1")


def hashed(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key))


def random_split(df: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42, key: str = "file_name", compatible: bool = False) -> DataFrame:
    """df with split, by key: the keys in random order, the first int(n * train) of them train, the next int(n * val) val, the others test.

    The order is by a hash, which needs no driver; compatible instead shuffles
    the sorted keys with Python's generator, on the driver, as long as there
    are no more than COMPATIBLE_KEYS.
    """
    _checked(train, val)
    keys = df.select(key).distinct()
    n = keys.count()
    if compatible:
        if n > COMPATIBLE_KEYS:
            raise ValueError("too many keys for the compatible order")
        order = sorted(tuple(r[0]) if isinstance(r[0], list) else (r[0],) for r in keys.collect())
        random.Random(seed).shuffle(order)
        kind = df.schema[key].dataType.simpleString()
        rows = [(list(k) if kind.startswith("array") else k[0], i) for i, k in enumerate(order)]
        placed = df.sparkSession.createDataFrame(rows, f"`{key}` {kind}, _r long")
    else:
        text = F.col(key).cast("string") if df.schema[key].dataType.typeName() != "array" else F.array_join(key, "\u001f")
        placed = with_ordinal(keys.withColumn("_h", hashed(seed, text)), ["_h", key], "_r").drop("_h")
    first, second = int(n * train), int(n * train) + int(n * val)
    named = placed.select(key, F.when(F.col("_r") < first, "train").when(F.col("_r") < second, "val").otherwise("test").alias("split"))
    return df.join(named, key)


def file_groups(groups: DataFrame, files: DataFrame) -> DataFrame:
    """(file_name, group_id) for files (file_name) that a group's document names.

    Whole normalised paths come first, then paths without extension, then bare
    names; the first of these that has a candidate decides, and several
    different candidates there are an error. Files without one are left out.
    """
    docs = groups.select(norm_path(F.col("doc_id")).alias("path"), "doc_id", "group_id").distinct()
    own = files.select("file_name", norm_path(F.col("file_name")).alias("path")).distinct()
    found = None
    for tier, form in enumerate((lambda p: p, strip_extension, base_filename)):
        some = own.withColumn("k", form(F.col("path"))).drop("path").join(docs.withColumn("k", form(F.col("path"))).drop("path"), "k").select("file_name", "doc_id", "group_id", F.lit(tier).alias("tier"))
        found = some if found is None else found.union(some)
    at = found.groupBy("file_name", "tier").agg(F.count_distinct("doc_id", "group_id").alias("n"), F.min("group_id").alias("group_id"))
    best = at.groupBy("file_name").agg(F.min(F.struct("tier", "n", "group_id")).alias("b"))
    clash = F.raise_error(F.concat(F.lit("ambiguous group for "), F.col("file_name"))).cast("string")
    return best.select("file_name", F.when(F.col("b.n") > 1, clash).otherwise(F.col("b.group_id")).alias("group_id"))


def greedy_parts(counts: list[tuple[int, int]], goals: dict[str, float]) -> list[tuple[int, int, int, str]]:
    """(weight, first, number, split) for (weight, number of units) pairs, the heaviest first: units of a weight are counted from first, and each goes to the split that lacks most."""
    sums, out = dict.fromkeys(goals, 0), []
    for weight, n in sorted(counts, reverse=True):
        for i in range(n):
            best = max(goals, key=lambda s: goals[s] - sums[s])
            sums[best] += weight
            if out and out[-1][0] == weight and out[-1][3] == best:
                out[-1] = (weight, out[-1][1], out[-1][2] + 1, best)
            else:
                out.append((weight, i, 1, best))
    return out


def greedy_split(units: DataFrame, train: float, val: float, seed: int) -> DataFrame:
    """(unit, split) of units (unit, weight): the heaviest first (of equals in hashed order), each to the split that lacks most; ties to train, then val.

    Each choice depends on those before, so the driver makes them, from the
    number of units of each weight; units get their places within a weight by a
    distributed rank. The driver's time grows with the number of units, and what
    it holds with the number of turns from one split to another.
    """
    _checked(train, val)
    counts = [(r["weight"], r["n"]) for r in units.groupBy("weight").agg(F.count("*").alias("n")).collect()]  # as many rows as different weights
    total = sum(w * n for w, n in counts)
    parts = greedy_parts(counts, {"train": total * train, "val": total * val, "test": total * (1.0 - train - val)})
    table = units.sparkSession.createDataFrame(parts, "w long, first long, n long, split string")
    ranked = with_ordinal(units.select("unit", "weight", (-F.col("weight")).alias("_m"), hashed(seed, F.col("unit")).alias("_h")), ["_m", "_h", "unit"], "_r")
    start = ranked.groupBy("weight").agg(F.min("_r").alias("before"))
    ranked = ranked.join(start, "weight").withColumn("_i", F.col("_r") - F.col("before"))
    return ranked.join(table, (F.col("weight") == F.col("w")) & (F.col("_i") >= F.col("first")) & (F.col("_i") < F.col("first") + F.col("n"))).select("unit", "split")


def group_split(df: DataFrame, groups: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42, key: str = "file_name") -> DataFrame:
    """df with split, whole groups of files staying together; a bundle belongs to the group of its first file that has one."""
    weights = df.groupBy(key).agg(F.count("*").cast("long").alias("weight"))
    members = weights.select(key, F.posexplode(key).alias("pos", "f")) if df.schema[key].dataType.typeName() == "array" else weights.select(key, F.lit(0).alias("pos"), F.col(key).alias("f"))
    mapped = file_groups(groups, members.select(F.col("f").alias("file_name")))
    own = members.join(mapped.withColumnRenamed("file_name", "f"), "f").groupBy(key).agg(F.min_by("group_id", "pos").alias("group_id"))
    text = F.array_join(key, "\u001f") if df.schema[key].dataType.typeName() == "array" else F.col(key)
    unit = F.coalesce(F.concat(F.lit("group|"), "group_id"), F.concat(F.lit("single|"), text))
    keyed = weights.join(own, key, "left").withColumn("unit", unit)
    split = greedy_split(keyed.groupBy("unit").agg(F.sum("weight").alias("weight")), train, val, seed)
    return df.join(keyed.join(split, "unit").select(key, "split"), key)


def split(df: DataFrame, strategy: str = "random", groups: DataFrame | None = None, **how) -> DataFrame:
    """random; dedupped: by merged groups; cluster: by groups as they are."""
    if strategy == "random":
        return random_split(df, **how)
    if strategy not in ("dedupped", "cluster"):
        raise ValueError(f"unknown split strategy: {strategy}")
    if groups is None:
        raise ValueError(f"{strategy} needs groups")
    return group_split(df, merged_groups(groups) if strategy == "dedupped" else groups, **how)
