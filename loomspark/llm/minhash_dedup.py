"""MinHash near-duplicate detection with odd sketches.

Each document becomes the set of its word shingles. 256 MinHash samples give
25 bands of five for candidate buckets, and all samples, folded into a parity
bitmap of 1024 bits (an odd sketch), let two documents be compared by the
population count of an XOR. A second parity bitmap, of the whole set, bounds
the sets' difference from below. What both pass is confirmed on the full
shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import wordhash as wh
from loomspark.llm.common import by_place, discard, materialize, pieces, small_enough
from loomspark.llm.components import connected_components
from loomspark.shipping import map_arrow

SAMPLES, BANDS, ROWS, SKETCH_BITS = 256, 25, 5, 1024
#: Candidates whose estimated similarity is this far below the threshold are given up: over four standard errors, one pair at the threshold in 100,000.
MARGIN = 0.12
#: At most so many ids are broadcast to fetch candidates' texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Links tried for a document of a divided bucket before all its remaining candidates are.
TRIES = 4

_RNG = np.random.default_rng(7919)
_FACTORS = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SALTS = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_PLACES = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)


def minhash(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The MinHash samples (sets x SAMPLES) of non-empty sets laid end to end."""
    out = np.empty((len(bounds) - 1, SAMPLES), dtype=np.uint32)
    narrow = (hashes >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + (1 << 15), side="right")) - 1)
        part, cuts = narrow[bounds[i] : bounds[j]], bounds[i:j] - bounds[i]
        room = np.empty_like(part)
        for k in range(SAMPLES):
            np.bitwise_xor(part, _SALTS[k], out=room)
            np.multiply(room, _FACTORS[k], out=room)
            out[i:j, k] = np.minimum.reduceat(room, cuts)
        i = j
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (sets x SKETCH_BITS / 64 words) of MinHash samples."""
    places = wh.mix64(samples.astype(np.uint64) * _PLACES[None, :] + np.arange(SAMPLES, dtype=np.uint64)[None, :]) & np.uint64(SKETCH_BITS - 1)
    flat = places.astype(np.int64) + np.arange(len(samples))[:, None] * SKETCH_BITS
    parity = (np.bincount(flat.ravel(), minlength=len(samples) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(len(samples), SKETCH_BITS), axis=1).view(np.uint64)


def bands(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, which also tells bands apart."""
    rows = samples[:, : BANDS * ROWS].astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), rows.shape[:2]).copy()
    for r in range(ROWS):
        keys = wh.mix64(keys ^ rows[:, :, r]) * np.uint64(0x9FB21C651E98DF25)
    return wh.mix64(keys)


def far_bits(similarity: float) -> int:
    """Expected population count of the XOR of two sketches at a similarity."""
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / SKETCH_BITS)))


def parity(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity bitmaps (sets x SKETCH_BITS / 64 words) of whole sets laid end to end."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    flat = (wh.mix64(hashes ^ np.uint64(0xA5A5F00DBAADCAFE)) & np.uint64(SKETCH_BITS - 1)).astype(np.int64) + owner * SKETCH_BITS
    odd = (np.bincount(flat, minlength=(len(bounds) - 1) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(bounds) - 1, SKETCH_BITS), axis=1).view(np.uint64)


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and their bounds."""
    data, offsets = wh.string_buffer(texts)
    starts, ends, first = wh.words(data, offsets, wh.SPACE_CLASS)
    hashes, bounds = wh.shingle_hashes(wh.word_hashes(data, starts, ends), first, k)
    found = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return (np.concatenate(found) if found else hashes), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(values.ravel())))


def _identities(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit identity of each set, in two halves; 0 for an empty one."""
    out = []
    for mixed in (wh.mix64(hashes + np.uint64(0x632BE59BD9B4E019)), wh.mix64(hashes ^ np.uint64(0xE220A8397B1DCDAF))):
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(mixed, out=sums[1:])
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return out[0], out[1]


def text_key(text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(text.cast("string"))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, t, n, hi, lo, sketch, whole, bands) of each row; t is a hash of the text, sketch is the odd sketch, whole the set's own bitmap; hi and lo identify the set, and those after n are empty for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, bounds = _sets(piece.column("text"), k)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                kept = np.concatenate([[0], np.cumsum(n[full])])
                samples = minhash(hashes, kept)
                hi, lo = _identities(hashes, bounds)
                lengths = np.zeros(len(n), dtype=np.int64)
                lengths[full] = 1
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("t"), pa.array(n), pa.array(_signed(hi)), pa.array(_signed(lo)), _lists(odd_sketch(samples), lengths * (SKETCH_BITS // 64)), _lists(parity(hashes, kept), lengths * (SKETCH_BITS // 64)), _lists(bands(samples), lengths * BANDS)],
                    names=["id", "t", "n", "hi", "lo", "sketch", "whole", "bands"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), text_key(F.col(text_col)).alias("t"))
    return map_arrow(rows, run, "id long, t long, n long, hi long, lo long, sketch array<long>, whole array<long>, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, items): the sorted shingle hashes of the classes in wanted (id, hi, lo, node), read from the texts of id that have this set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, bounds = _sets(piece.column("text"), k)
                own = [_signed(x) == np.asarray(piece.column(c)) for x, c in zip(_identities(hashes, bounds), ("hi", "lo"))]
                same = own[0] & own[1]
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([piece.column("node").filter(pa.array(same)), _lists(hashes[np.repeat(same, n)], n[same])], names=["node", "items"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(small_enough(wanted, BROADCAST_IDS), "id").select("node", "hi", "lo", "text")
    return map_arrow(rows, run, "node long, items array<long>")


def _far(a: Column, b: Column) -> Column:
    """Population count of the XOR of two sketch columns."""
    total = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        total = total + F.bit_count(a.getItem(i).bitwiseXOR(b.getItem(i)))
    return total


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes (node, id, hi, lo) with 100 * intersection >= percent * union of their full shingle sets."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ids = materialize(classes.select("id", "hi", "lo", "node").join(nodes, "node", "left_semi").select("id", "hi", "lo", "node"), "ids")
    sets = materialize(_full_sets(docs, ids, id_col, text_col, k).dropDuplicates(["node"]), "sets")
    left, right = (sets.select(F.col("node").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")
    shared = F.size(F.array_intersect("a_items", "b_items")).cast("long")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("i"), (F.size("a_items") + F.size("b_items")).cast("long").alias("s"))
    out = materialize(joined.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("s") - F.col("i"))).select("a", "b"), "links")
    discard(docs.sparkSession, sets, ids)
    return out


def _judged(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, t, n, component, smallest) of each row: component names its group, null for rows that aren't compared, smallest is the group's least id.

    Classes of equal sets are numbered, so that rows which share an id but not
    a text are different documents throughout.
    """
    cut = far_bits(percent / 100 - MARGIN)
    everything = materialize(signatures(docs, id_col, text_col, k), "signatures")
    full = everything.where("n > 0 and id is not null")
    classes = full.groupBy("hi", "lo").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("whole").alias("whole"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sketches = classes.select("node", "n", "sketch", "whole")
    entries = classes.select("id", "node", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min(F.struct("id", "node"))["node"].alias("leader"), F.count("*").alias("m")).where("m > 1").drop("m")
    members = materialize(entries.drop("id").join(buckets, "key"), "members")

    def near(x: str, y: str) -> Column:
        """Whether sizes, the sets' own bitmaps and the odd sketches leave it open that two sets are similar enough."""
        both = F.col(f"{x}_n") + F.col(f"{y}_n")
        most = F.floor(both * (100 - percent) / (100 + percent))
        # At most that many bits differ; of large sets, about as many as of a random difference of that size, and six deviations more.
        seen = F.least(most.cast("double"), SKETCH_BITS / 2 * (1 - F.exp(-2.0 * most / SKETCH_BITS)) + 3 * SKETCH_BITS**0.5)
        sizes = F.lit(100) * F.least(f"{x}_n", f"{y}_n") >= F.lit(percent) * F.greatest(f"{x}_n", f"{y}_n")
        return sizes & (_far(F.col(f"{x}_w"), F.col(f"{y}_w")) <= seen) & (_far(F.col(f"{x}_s"), F.col(f"{y}_s")) <= cut)

    def of(x: str, df: DataFrame, *more: str) -> DataFrame:
        return df.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_s"), F.col("whole").alias(f"{x}_w"), *[F.col(c).alias(f"{x}_{c}") for c in more])

    stars = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    scored = stars.join(of("a", sketches), "a").join(of("b", sketches), "b").where(near("a", "b"))
    scored = materialize(scored.select("a", "b", _far(F.col("a_s"), F.col("b_s")).alias("far")), "stars")
    tried = materialize(scored.groupBy("b").agg(F.min_by("a", F.struct("far", "a")).alias("a")).select("a", "b"), "tried")
    links = [confirm(tried, classes, docs, id_col, text_col, k, percent)]
    labels = materialize(connected_components(links[0]), "labels")
    for step in ("stars", "closest", "rest"):
        c = labels.select("node", F.col("component").alias("c"))
        if step == "stars":
            left, right = (c.select(F.col("node").alias(x), F.col("c").alias(f"{x}_c")) for x in "ab")
            apart = scored.join(left, "a", "left").join(right, "b", "left").where(F.coalesce("a_c", "a") != F.coalesce("b_c", "b"))
            fresh = apart.select("a", "b").join(tried, ["a", "b"], "left_anti")
        else:
            named = members.join(c, "node", "left").select("key", "node", F.coalesce("c", "node").alias("c"))
            share = named.groupBy("key", "c").agg(F.count("*").alias("m"))
            divided = share.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
            open_ = named.join(divided, "key").join(sketches, "node")
            x, y = of("x", open_.where("c <> main"), "key", "c"), of("y", open_, "key", "c")
            met = x.join(y, (F.col("x_key") == F.col("y_key")) & (F.col("x_c") != F.col("y_c")) & near("x", "y"))
            met = met.groupBy("x", "y").agg(F.first(_far(F.col("x_s"), F.col("y_s"))).alias("far"))
            fresh = met.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).join(tried, ["a", "b"], "left_anti")
        if step == "closest":
            best = F.min(F.struct("far", "a", "b")).alias("p")
            fresh = fresh.groupBy("x", F.pmod(F.xxhash64("y"), F.lit(TRIES)).alias("r")).agg(best).select("p.a", "p.b")
        fresh = materialize(fresh.select("a", "b").distinct(), "tried")
        if fresh.isEmpty():
            continue
        links.append(confirm(fresh, classes, docs, id_col, text_col, k, percent))
        tried = tried.union(fresh)
        if not links[-1].isEmpty():
            found = links[0]
            for more in links[1:]:
                found = found.union(more)
            labels = materialize(connected_components(found), "labels")
    groups = classes.select("hi", "lo", "id", "node").join(labels, "node", "left")
    linked = groups.where("component is not null")
    least = materialize(linked.groupBy("component").agg(F.min("id").alias("smallest")), "least")
    linked = linked.join(small_enough(least, BROADCAST_IDS), "component").select("hi", "lo", "component", "smallest")
    named = linked.union(groups.where("component is null").select("hi", "lo", F.col("node").alias("component"), F.col("id").alias("smallest")))
    empty = (F.col("n") == 0) | F.col("id").isNull()
    return everything.select("id", "t", "n", F.when(~empty, F.col("hi")).alias("hi"), F.when(~empty, F.col("lo")).alias("lo")).join(named, ["hi", "lo"], "left").drop("hi", "lo")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: (id_col, n_shingles, component_id, kept).

    Documents are linked when 100 * |intersection| >= percent * |union| of
    their distinct k-word shingles (A-Z lower-cased, words between ASCII white
    space; with fewer than k words the whole sequence is the one shingle).
    component_id is the smallest id reachable over links and kept says that it
    is the row's own id. Null and empty texts and texts without words have an
    empty set, are linked with nothing and are kept; so are rows whose id is
    null, with a null component. Repeated rows with one id and text share a
    component and are all kept; rows that share an id and not a text are
    compared as the different texts they are, each with its own component_id.
    An empty table gives no rows; other columns of docs are ignored.

    Equal sets form one class, so exact copies never meet each other. Within a
    bucket every class meets that with the bucket's smallest id, the closest of
    its buckets first; only buckets whose members are then still in different
    components are searched further: classes outside the bucket's largest
    component meet all its members, first their closest by sketch, then all
    that remain. Every candidate pair is thus either confirmed, rejected, or
    already in one component, without emitting the pairs of a large group.
    """
    out = _judged(docs, id_col, text_col, k, percent)
    component = F.coalesce("smallest", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates, and all of docs' columns, whatever their names.

    Groups are those of near_duplicates, but rows that share an id and not a
    text are told apart, so that none is lost for another's sake: of each group
    the row with the smallest id stays (of several, that with the smallest hash
    of its text; of rows equal in both, any one). Rows with a null id, or with
    texts that are null or have no words, all stay. No rows give no rows. Only
    the rows to go are joined with docs; texts move only where those are very
    many, or for ids and texts that occur twice.
    """
    judged = materialize(_judged(docs, id_col, text_col, k, percent).where("component is not null"), "judged")
    sizes = judged.groupBy("component").agg(F.count("*").alias("m"), F.min(F.struct("id", "t")).alias("first")).where("m > 1").drop("m")
    sizes = small_enough(materialize(sizes, "sizes"), BROADCAST_IDS)  # one group may hold most rows
    members = materialize(judged.join(sizes, "component").select("id", "t", (F.struct("id", "t") == F.col("first")).alias("first")), "members")
    own, restored = by_place(docs)
    key, text = (F.col(own.columns[docs.columns.index(c)]) for c in (id_col, text_col))
    own = own.withColumns({"_key": key.cast("long"), "_text": text_key(text)})

    def only(which: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        which = small_enough(materialize(which, "which"), BROADCAST_IDS)
        return rows.join(which, (F.col("_key") == F.col("id")) & (F.col("_text") == F.col("t")), how)

    gone = members.where("not first").select("id", "t").distinct()
    kept = only(gone, "left_anti", own)
    twice = materialize(members.where("first").groupBy("id", "t").count().where("count > 1").select("id", "t"), "twice")
    if not twice.isEmpty():
        kept = only(twice, "left_anti", kept).unionByName(only(twice, "left_semi", kept).dropDuplicates(["_key", "_text"]))
    return restored(kept)
