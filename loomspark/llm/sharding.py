"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import by_place, materialize, small_enough, with_rank

#: Rows of a plan, or groups of several rows, that are broadcast at most; more are joined by a shuffle.
BROADCAST = 1_000_000


class CapacityTree:
    """A balanced tree (a treap with fixed pseudo-random priorities) of (remaining capacity, bin)."""

    def __init__(self):
        self._root, self._state = None, 88172645463325252

    def _priority(self) -> int:
        x = self._state
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self._state = x
        return x

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._join(a[3], b)]
        return [b[0], b[1], self._join(a, b[2]), b[3]]

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self._root, key)
        self._root = self._join(self._join(low, [key, self._priority(), None, None]), high)

    def remove(self, key: tuple[int, int]) -> None:
        low, high = self._split(self._root, key)
        own, high = self._split(high, (key[0], key[1] + 1))
        self._root = self._join(low, high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest remaining capacity of at least size."""
        node, best = self._root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def roomiest(self) -> tuple[int, int]:
        node = self._root
        while node[3] is not None:
            node = node[3]
        return node[0]


def best_fit_decreasing(sizes: Sequence[int], capacity: int, bins: int | None = None) -> list[int]:
    """The bin of each item: by decreasing size (ties in the order given), into the bin with the least room that fits.

    Without bins, a new bin opens whenever nothing fits, so that few bins of
    the fixed capacity are used; items above capacity get a bin of their own.
    With bins, so many are open from the start and what fits nowhere goes to
    the bin with the most room.
    """
    tree, out, opened = CapacityTree(), [0] * len(sizes), bins or 0
    for b in range(opened):
        tree.add((capacity, b))
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        place = tree.tightest(sizes[i])
        if place is None and bins is None:
            place = (max(capacity, sizes[i]), opened)
            opened += 1
        else:
            place = place or tree.roomiest()
            tree.remove(place)
        out[i] = place[1]
        tree.add((place[0] - sizes[i], place[1]))
    return out


def fill(counts: Iterable[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int]]:
    """best_fit_decreasing for (size, number of items) pairs: (size, first, number, bin), items of a size being counted from first.

    Once an item of some size has entered a bin, that bin stays the tightest
    for the next one until it holds no more, so equal items enter it together
    and the work follows the number of sizes and bins, not of items.
    """
    tree, out, opened = CapacityTree(), [], bins or 0
    for b in range(opened):
        tree.add((capacity, b))
    for size, n in sorted(counts, reverse=True):
        first = 0
        while first < n:
            place = tree.tightest(size)
            if place is None and bins is None:
                place = (max(capacity, size), opened)
                opened += 1
            else:
                place = place or tree.roomiest()
                tree.remove(place)
            taken = min(n - first, max(1, place[0] // size if size else n - first))
            out.append((size, first, taken, place[1]))
            tree.add((place[0] - taken * size, place[1]))
            first += taken
    return out


def _keyed(docs: DataFrame, text: Column, overhead: int) -> DataFrame:
    text = F.coalesce(text, F.lit(""))
    return docs.withColumns({
        "_size": (F.octet_length(text) + overhead).cast("long"),
        "_crc": F.crc32(text.cast("binary")),
        "_h": F.xxhash64(text),
    })


def _fair_capacity(counts: Sequence[tuple[int, int]], shards: int) -> int:
    """The share of a shard, when groups above it have shards of their own; counts are (size, number of groups), the largest first."""
    rest, left = sum(size * n for size, n in counts), shards
    for size, n in counts:
        for _ in range(min(n, left)):
            if left <= 1 or size * left <= rest:
                return max(1, -(-rest // left))
            rest, left = rest - size, left - 1
    return max(1, -(-rest // left))


def plan_shards(keyed: DataFrame, shards: int | None, capacity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(_h, _crc, group_size) of groups of several rows, and (size, low, high, shard): the shard of groups of a size whose _h is in [low, high).

    keyed has _h, _crc and _size. The driver gets the number of groups of each
    size, which has as many rows as there are different sizes (100,000 or so,
    as texts have), and packs by it; groups of one size are in the order of _h,
    so a plan needs only the places where the shard changes.
    """
    spark = keyed.sparkSession
    groups = keyed.groupBy("_h", "_crc").agg(F.sum("_size").alias("size"), F.count("*").alias("m"))
    groups = materialize(groups, "groups")
    counts = [tuple(r) for r in groups.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()]
    filled = fill(counts, capacity or _fair_capacity(counts, shards), shards)
    cuts = [(size, first) for size, first, _, _ in filled if first]
    low: dict[tuple[int, int], int] = {}
    if cuts:
        table = spark.createDataFrame(cuts, "s long, first long")
        cut = groups.join(small_enough(table.select(F.col("s").alias("size")).distinct(), BROADCAST), "size", "left_semi")
        ranked = with_rank(cut.select("size", "_h", "_crc"), "size", ["_h", "_crc"], "r")
        found = ranked.join(small_enough(table, BROADCAST), (F.col("size") == F.col("s")) & (F.col("r") == F.col("first")))
        low = {(r["size"], r["first"]): r["_h"] for r in found.select("size", "first", "_h").collect()}  # a row for each cut
    rows = [(size, low.get((size, first)), low.get((size, first + n)), b) for size, first, n, b in filled]
    return groups.where("m > 1").select("_h", "_crc", F.col("size").alias("group_size")), spark.createDataFrame(rows, "size long, low long, high long, shard int")


def _placed(keyed: DataFrame, plan: tuple[DataFrame, DataFrame]) -> DataFrame:
    """keyed with _shard."""
    several, table = plan
    several = small_enough(several.select(F.col("_h").alias("_gh"), F.col("_crc").alias("_gc"), "group_size"), BROADCAST)
    out = keyed.join(several, (F.col("_h") == F.col("_gh")) & (F.col("_crc") == F.col("_gc")), "left").withColumn("_group", F.coalesce("group_size", "_size"))
    inside = (F.col("_group") == F.col("size")) & F.coalesce(F.col("_h") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("_h") < F.col("high"), F.lit(True))
    return out.join(small_enough(table, BROADCAST), inside).withColumn("_shard", F.col("shard")).drop("_gh", "_gc", "group_size", "_group", "size", "low", "high", "shard")


def with_shard(docs: DataFrame, shards: int | None = 40, text_col: str = "text", overhead: int = 16, capacity: int | None = None) -> DataFrame:
    """docs with a column shard (0 to shards - 1), by best-fit decreasing.

    The sizes of shards, in UTF-8 bytes of their texts plus overhead for each
    row, are as near equal as indivisible groups allow: rows with equal texts
    are one group and share a shard (null counts as empty; texts that agree in
    two hashes count as equal). Groups enter shards by decreasing size, each
    into the shard with the least room that still holds it. Groups above a
    shard's share have their own shards, and the rest share the others evenly.
    With capacity and no shards, shards of that capacity are opened as they are
    needed, so that few are; a group above it has a shard of its own.

    Every group is packed by its own size. Texts are only shuffled if more than
    BROADCAST groups have several rows. An empty table gives no rows; shards
    may stay empty when there are few groups. All columns stay, whatever their
    names, but a column named shard is replaced.
    """
    own, restored = by_place(docs.drop("shard"))
    keyed = _keyed(own, F.col(own.columns[docs.drop("shard").columns.index(text_col)]), overhead)
    return restored(_placed(keyed, plan_shards(keyed.select("_h", "_crc", "_size"), shards, capacity)), shard=F.col("_shard"))


def assign(docs: DataFrame, shards: int | None = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, capacity: int | None = None) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for every row: as with_shard, and slot is the row's gapless place in its shard by id.

    Null ids come first in a shard; repeated rows get different slots. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    keyed = materialize(_keyed(rows, F.col("_text"), overhead).drop("_text"), "keyed")
    placed = _placed(keyed, plan_shards(keyed, shards, capacity))
    ranked = with_rank(placed, "_shard", ["_id", "_size", "_h"], "slot")
    return ranked.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), "slot")
