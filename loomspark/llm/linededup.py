"""Line deduplication by an exact set-similarity join of lines' words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import wordhash as wh
from loomspark.llm.common import by_place, discard, materialize, pieces, small_enough
from loomspark.shipping import map_arrow

#: Words whose counts are sent to all tasks, at most, the most frequent ones; bits of a map of the other words that occur in several lines.
KNOWN_WORDS, MAP_BITS = 1 << 20, 22
#: Bits of the parity maps that candidates' sets are compared by before the sets themselves.
WIDE_BITS = 512
#: Words of more than so many lines' prefixes first meet their earliest line alone.
HOT = 64
#: Words of more than so many sets' prefixes are met by a join, which Spark can split; entries of a range of other words, about.
HEAVY, RANGE = 1 << 16, 1 << 17
BROADCAST_IDS = 1_000_000
_MERGE = 1 << 21
#: Entries that are packed, and pairs that are looked at, at a time.
_PACK, _PAIRS = 1 << 19, 1 << 18
#: First bits of a word's hash that an index of the known words goes by.
_TOP = 20
#: Bytes of text at a time where nothing is merged across pieces; their arrays stay in the cache.
PIECE = 1 << 19


def _line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and line number of each line that has words, the sorted distinct word hashes of all, each line's distinct words as places in these end to end, and the lines' bounds."""
    data, offsets = wh.string_buffer(texts)
    starts, ends, first = wh.words(data, offsets, wh.SPACE_CLASS)
    words, back = wh.distinct(wh.word_hashes(data, starts, ends))
    breaks = np.flatnonzero(data == 10)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    before = np.bincount(np.searchsorted(starts, breaks), minlength=len(starts) + 1)
    place = np.cumsum(before[: len(starts)]) + text
    key = np.sort(place * len(words) + back)
    keep = np.ones(len(key), dtype=bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    line = key // max(len(words), 1)
    new_line = np.ones(len(line), dtype=bool)
    new_line[1:] = line[1:] != line[:-1]
    at = np.flatnonzero(new_line)
    of_line = text[np.searchsorted(place, line[at])]
    number = line[at] - of_line - np.searchsorted(breaks, offsets[:-1])[of_line]
    return of_line, number, words, key - line * len(words), np.append(at, len(line))


def _class_of(words: np.ndarray, items: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit identity of each set, in two halves."""
    if len(bounds) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    n = np.diff(bounds).astype(np.uint64)
    halves = (wh.mix64(words + np.uint64(0x632BE59BD9B4E019)), wh.mix64(words ^ np.uint64(0xE220A8397B1DCDAF)))
    return tuple(wh.mix64(np.add.reduceat(mixed[items], bounds[:-1]) + n).view(np.int64) for mixed in halves)


def _least_shared(n: Column, percent: int, whole: int) -> Column:
    return F.ceil(n * percent / whole)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit values, first all lowest bytes, then all second ones and so on, as they compress well so."""
    return np.concatenate([c.astype("<u8") for c in columns]).view(np.uint8).reshape(-1, 8).T.tobytes()


def _columns(data: bytes, n: int) -> np.ndarray:
    """The n columns of _planes."""
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u8").astype(np.uint64).reshape(n, -1)


def _packed(words: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted words and what goes with them, each word less the one before."""
    return _planes(np.diff(words, prepend=np.uint64(0)), *more)


def _unpacked(data: bytes, n: int = 2) -> list[np.ndarray]:
    words, *more = _columns(data, n)
    return [np.cumsum(words, dtype=np.uint64), *[x.view(np.int64) for x in more]]


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct words and the sums of their counts."""
    words, place = wh.distinct(np.concatenate([np.zeros(0, dtype=np.uint64), *[w for w, _ in parts]]))
    counts = np.concatenate([np.zeros(0, dtype=np.int64), *[m for _, m in parts]])
    return words, np.bincount(place, weights=counts, minlength=len(words)).astype(np.int64)


def lines_and_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two kinds of rows from one pass over the texts: (doc, pos, c, d), each line with words and its class c, d (lines of equal word sets); and (part, words), packed hashes of one of several ranges with numbers of lines they are in, for word_counts; those rows' c, d and pos are the least and the largest id and the largest line number that the task had read."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        least, most, last = [], [], []
        starts = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)

        def rows(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            types = {"doc": pa.int64(), "pos": pa.int32(), "c": pa.int64(), "d": pa.int64(), "part": pa.int32(), "words": pa.binary()}
            return pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(n, t) for x, t in types.items()], names=list(types))

        def ranges(words: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            ends = [0, *np.searchsorted(words, starts).tolist(), len(words)]
            bounds = {k: pa.array([v], t) for k, v, t in (("c", min(least, default=0), pa.int64()), ("d", max(most, default=0), pa.int64()), ("pos", max(last, default=0), pa.int32()))}
            for i in range(parts):
                a, b = ends[i], ends[i + 1]
                if b > a:
                    yield rows(1, bounds | {"part": pa.array([i], pa.int32()), "words": pa.array([_packed(words[a:b], counts[a:b])], pa.binary())})

        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                text, number, found, items, bounds = _line_words(piece.column("text"))
                held.append((found, np.bincount(items, minlength=len(found))))
                if len(text):
                    ids = np.asarray(piece.column("doc"))
                    least, most, last = [min([*least, int(ids.min())])], [max([*most, int(ids.max())])], [max([*last, int(number.max())])]
                c, d = _class_of(found, items, bounds)
                yield rows(len(text), {"doc": piece.column("doc").take(pa.array(text)), "pos": pa.array(number.astype(np.int32)), "c": pa.array(c), "d": pa.array(d)})
                if sum(len(w) for w, _ in held[1:]) > _MERGE:
                    held = [_summed(held)]
                    if len(held[0][0]) > _MERGE:
                        yield from ranges(*held.pop())
        yield from ranges(*_summed(held))

    return map_arrow(_rows(docs, id_col, text_col), run, "doc long, pos int, c long, d long, part int, words binary")


def word_counts(read: DataFrame) -> DataFrame:
    """(h, m), the hashes of words that several lines have, and the numbers of these lines, from the rows of lines_and_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("words"), strict=True):
                held.setdefault(part, []).append(_unpacked(data.as_buffer()))
        while held:
            words, counts = _summed(held.popitem()[1])
            more = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(words[more].view(np.int64)), pa.array(counts[more])], names=["h", "m"])

    parts = int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(read.where("part is not null").select("part", "words").repartition(parts, "part"), run, "h long, m long")


def rarity(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent words' hashes (sorted) and counts, and a bit map of the other words in several lines.

    At most KNOWN_WORDS words and 2 ** MAP_BITS places reach the driver,
    whatever the vocabulary. The order of words that follows from them is the
    same everywhere, which is what makes the join exact; the finer it tells
    rare words apart, the faster it is.
    """
    scale = F.floor(F.log2("m")).cast("int")
    steps = {r[0]: r[1] for r in counts.groupBy(scale.alias("s")).count().collect()}
    least, total = 64, 0
    while least > 1 and total + steps.get(least - 1, 0) <= KNOWN_WORDS:
        least -= 1
        total += steps.get(least, 0)
    known = counts.where(scale >= least).toArrow()
    hashes, many = known["h"].to_numpy().view(np.uint64), known["m"].to_numpy()
    order = np.argsort(hashes)
    rest = counts.where((scale < least) & (F.col("m") > 1)).select(F.col("h").bitwiseAND((1 << MAP_BITS) - 1).cast("int").alias("p")).distinct().toArrow()
    places = np.zeros(1 << MAP_BITS, dtype=bool)
    places[rest["p"].to_numpy()] = True
    return hashes[order], many[order], np.packbits(places)


def _places(known: np.ndarray, index: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place in known (sorted) of each of these words that is there; index has the first place for each value of a hash's upper bits."""
    at = np.minimum(index[(words >> np.uint64(64 - _TOP)).astype(np.int64)], len(known) - 1)
    below = np.flatnonzero(known[at] < words)
    while len(below):
        at[below] += 1
        below = below[at[below] < len(known)]
        below = below[known[at[below]] < words[below]]
    return np.minimum(at, len(known) - 1)


def _sorted_order(x: np.ndarray) -> np.ndarray:
    """A stable argsort of values from 0 on."""
    bits = len(x).bit_length()
    if len(x) and int(x.max()) >> (63 - bits):
        return np.argsort(x, kind="stable")
    return np.sort(x << bits | np.arange(len(x))) & ((1 << bits) - 1)  # much faster than an argsort


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of x from each of these places up to the next, none being empty."""
    return np.add.reduceat(x, first, dtype=np.int32) if len(first) else np.zeros(0, dtype=np.int32)


def prefixes(docs: DataFrame, known: tuple[np.ndarray, np.ndarray, np.ndarray], id_col: str, text_col: str, percent: int) -> DataFrame:
    """(c, d, doc, pos, n, bits, skip, often, words) of lines, each class once a piece at least: the words of its prefix that other lines have too, rarest first.

    skip counts the words before them, which are in this line alone; often
    counts those at their end that are, or may be, in more than HOT lines; bits
    is a 64-bit parity map of the set. Sets that can't match another are left
    out.
    """
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        frequent, counts, packed = held.value
        places = np.unpackbits(packed).astype(bool)
        index = np.searchsorted(frequent, np.arange(1 << _TOP, dtype=np.uint64) << np.uint64(64 - _TOP))
        untold = len(counts) > 0 and counts.min() > HOT  # words that are not known may then be in many lines
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                text, number, words, items, bounds = _line_words(piece.column("text"))
                n = np.diff(bounds)
                if not len(n):
                    continue
                c, d = _class_of(words, items, bounds)
                parity = np.uint64(1) << (wh.mix64(words) & np.uint64(63))
                bits = np.bitwise_xor.reduceat(parity[items], bounds[:-1])
                rank = places[(words & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)].astype(np.int64)
                if len(frequent):
                    at = _places(frequent, index, words)
                    rank = np.where(frequent[at] == words, counts[at] + 1, rank)
                by_rank = _sorted_order(rank)  # and by hash, as words are sorted
                turn = np.empty_like(by_rank)
                turn[by_rank] = np.arange(len(by_rank))
                line = np.repeat(np.arange(len(n)) * len(words), n)
                turns = np.sort(line + turn[items])
                ids = np.asarray(piece.column("doc"))[text]
                by_class = np.lexsort((number, ids, d, c))
                once = by_class[np.append(True, (c[by_class][1:] != c[by_class][:-1]) | (d[by_class][1:] != d[by_class][:-1]))]
                wanted = np.sort(once[n[once] * (100 - percent) >= percent])  # a set of n words can match one of n + 1
                length = n[wanted] - -(-percent * n[wanted] // 100) + 1
                first = np.cumsum(length) - length
                early = np.arange(length.sum()) + np.repeat(bounds[wanted] - first, length)
                items = by_rank[turns[early] - line[early]]
                rank = rank[items]
                skip = _sums(rank == 0, first)
                often = _sums((rank > HOT + 1) | (untold & (rank > 0)), first)
                kept = length - skip
                some = np.flatnonzero(kept)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept[some])]).astype(np.int32)), pa.array(words[items[rank > 0]].view(np.int64)))
                skip, often, some = skip[some], often[some], wanted[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[some]), pa.array(d[some]), piece.column("doc").take(pa.array(text[some])), pa.array(number[some].astype(np.int32)), pa.array(n[some].astype(np.int32)), pa.array(bits[some].view(np.int64)), pa.array(skip), pa.array(often), lists],
                    names=["c", "d", "doc", "pos", "n", "bits", "skip", "often", "words"],
                )

    return map_arrow(_rows(docs, id_col, text_col), run, "c long, d long, doc long, pos int, n int, bits long, skip int, often int, words array<long>")


def _wide(words: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Parity maps of WIDE_BITS of sets laid end to end."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    places = (wh.mix64(words ^ np.uint64(0xA5A5F00DBAADCAFE)) & np.uint64(WIDE_BITS - 1)).astype(np.int64)
    odd = (np.bincount(places + owner * WIDE_BITS, minlength=n * WIDE_BITS) & 1).astype(np.uint8)
    maps = np.packbits(odd.reshape(n, WIDE_BITS), axis=1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * (WIDE_BITS // 64)).astype(np.int32)), pa.array(maps.ravel()))


def _some_lines(texts: pa.Array, owner: np.ndarray, number: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lines of these numbers of the texts at owner, and which of the numbers these are; a text may lack a line that is asked for."""
    data, offsets = wh.string_buffer(texts)
    breaks = np.flatnonzero(data == 10)
    before, after = np.searchsorted(breaks, offsets[:-1]), np.searchsorted(breaks, offsets[1:])
    which = np.flatnonzero(number <= (after - before)[owner])
    owner, number = owner[which], number[which]
    bounds = np.concatenate([[-1], breaks, [len(data)]])
    at = before[owner] + number
    starts, ends = np.maximum(bounds[at] + 1, offsets[owner]), np.minimum(bounds[at + 1], offsets[owner + 1])
    held = data.tobytes()
    return pa.array([held[a:b] for a, b in zip(starts.tolist(), ends.tolist())], pa.large_string()), which


def _confirm(pairs: DataFrame, places: Callable[[DataFrame], DataFrame], docs: DataFrame, repeated: bool, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The pairs (early, late) whose word sets are as similar as percent, the sets being read again from the texts."""
    wanted = pairs.select(F.col("early").alias("o")).union(pairs.select(F.col("late").alias("o"))).distinct()
    wanted = places(wanted)
    key = [c for c in ("pos", "c", "d") if c in wanted.columns]
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("o", *key)).alias("at"))  # of one document
    wanted = small_enough(materialize(wanted, "wanted"), BROADCAST_IDS, F.size("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                asked, flat = piece.column("at"), piece.column("at").flatten()
                lines, which = _some_lines(piece.column("text"), pa.compute.list_parent_indices(asked).to_numpy(), flat.field("pos").to_numpy())
                at, _, words, items, bounds = _line_words(lines)
                which = which[at]
                ids, right = flat.field("o").to_numpy()[which], np.ones(len(which), dtype=bool)
                for name, half in zip(key[1:], _class_of(words, items, bounds)):
                    right &= flat.field(name).to_numpy()[which] == half
                found = [(i, ids[i]) for i in np.flatnonzero(right)]
                sets = [words[items[bounds[i] : bounds[i + 1]]] for i, _ in found]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                flat = np.concatenate([words[:0], *sets])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o for _, o in found], pa.int64()), pa.array(np.diff(ends)), _wide(flat, ends), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                    names=["o", "n", "wide", "items"],
                )

    rows = _rows(docs, id_col, text_col).join(wanted, "doc")
    sets = map_arrow(rows, run, "o long, n int, wide array<long>, items array<long>")
    sets = materialize(sets.dropDuplicates(["o"]) if repeated else sets, "sets", ("o", "wide.list.element", "items.list.element"))
    early, late = (sets.select(F.col("o").alias(x), F.col("n").alias(f"{x}_n"), F.col("wide").alias(f"{x}_wide")) for x in ("early", "late"))
    far = sum((F.bit_count(F.col("early_wide").getItem(i).bitwiseXOR(F.col("late_wide").getItem(i))) for i in range(WIDE_BITS // 64)), F.lit(0))
    both = F.col("early_n") + F.col("late_n")
    close = pairs.join(early, "early").join(late, "late").where(far <= both - 2 * _least_shared(both, percent, 100 + percent))
    close = materialize(close.select("early", "late", both.cast("long").alias("s")), "close")

    def items(x: str) -> DataFrame:  # of sets that are still in question
        asked = small_enough(close.select(F.col(x).alias("o")).distinct(), BROADCAST_IDS)
        return sets.join(asked, "o", "left_semi").select(F.col("o").alias(x), F.col("items").alias(f"{x}_items"))

    shared = F.size(F.array_intersect("early_items", "late_items")).cast("long")
    joined = close.join(items("early"), "early").join(items("late"), "late").select("early", "late", shared.alias("i"), "s")
    out = materialize(joined.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("s") - F.col("i"))).select("early", "late"), "links")
    discard(docs.sparkSession, sets, wanted, close)
    return out


def _marked(sets: DataFrame, found: DataFrame) -> DataFrame:
    """sets with gone, 1 if found has it as late, else 0."""
    gone = small_enough(found.select(F.col("late").alias("o")).distinct().withColumn("gone", F.lit(1)), BROADCAST_IDS)
    return sets.join(gone, "o", "left").withColumn("gone", F.coalesce("gone", F.lit(0)))


def _entries(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The entries (w, o, bits, at) that the smaller and the larger set of a pair meet by.

    o holds the set's place, times two, plus one if found has it as late; at
    holds n in its upper half, and in its lower one the word's position, times
    four, plus one if the entry stands for the smaller set of a pair, plus two
    if it stands for the larger one.

    The smaller of two similar sets has a shared word in a prefix about half as
    long as the other's. Most entries of that prefix stand for both, so that
    one exchange serves either side. Two sets that are both found to
    go need not meet: for words that many lines have, w tells them apart (its
    last two bits, after 48 of the word's hash: 2 to meet sets that stay, 1 to meet those that go), so that
    a group of near copies doesn't meet pair by pair. A smaller set that stays
    meets both kinds and has two such entries for a word.
    """
    marked = _marked(sets, found)
    size = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1 - F.col("skip")
    size = F.greatest(F.least(size, F.size("words")), F.lit(0)).cast("int")
    first = F.size("words") - F.col("often")  # of the words that many lines have
    marked = marked.withColumn("short", size).withColumn("first", first)
    again = F.when(F.col("short") > F.col("first"), F.slice("words", F.col("first") + 1, F.col("short") - F.col("first"))).otherwise(F.slice("words", 1, 0))
    rows = marked.select("o", "bits", "n", "skip", "gone", "short", "first", F.size("words").alias("long"), F.posexplode(F.concat("words", again)).alias("p", "w"))
    second = F.col("p") >= F.col("long")
    i = F.when(second, F.col("p") - F.col("long") + F.col("first")).otherwise(F.col("p"))
    hot = i >= F.col("first")
    kind = F.when(~hot, 0).when(second == (F.col("gone") == 1), 2).otherwise(1)
    role = F.when(second, 1).when((F.col("p") < F.col("short")) & ~(hot & (F.col("gone") == 1)), 3).otherwise(2)
    place = F.shiftleft((i + F.col("skip")).cast("long"), 2).bitwiseOR(role.cast("long"))
    w = F.shiftleft(F.shiftrightunsigned("w", 16), 2).bitwiseOR(kind.cast("long"))
    return rows.select(w.alias("w"), (F.col("o") * 2 + F.col("gone")).alias("o"), "bits", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(place).alias("at"))


def _met(entries: DataFrame, percent: int) -> DataFrame:
    """The pairs (early, late) of sets whose entries meet and that may be as similar as percent."""
    short, long = (entries.select(*[F.col(c).alias(f"{x}_{c}") for c in entries.columns]) for x in ("a", "b"))
    later = F.greatest("a_o", "b_o")
    a_n, b_n = F.shiftright("a_at", 32), F.shiftright("b_at", 32)
    a_i, b_i = (F.shiftright(F.col(c).bitwiseAND((1 << 32) - 1), 2) for c in ("a_at", "b_at"))
    far = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits")))
    both, least = a_n + b_n, 100 + percent  # sets of n and m words share at least percent * (n + m) / least
    fits = (
        (F.col("a_w") == F.col("b_w"))
        & (F.col("a_at").bitwiseAND(F.lit(1)) + F.col("b_at").bitwiseAND(F.lit(2)) == 3)  # in one, as a filter of one side would keep the sides from sharing an exchange
        & (F.lit(least) * F.least(a_n - a_i, b_n - b_i) >= F.lit(percent) * both)  # at the first word they share, all shared ones are still to come; the length filter follows from this
        & (a_n <= b_n) & (F.lit(least) * (both - far) >= F.lit(2 * percent) * both)
        & ((a_n < b_n) | (F.col("a_o") < F.col("b_o"))) & (later.bitwiseAND(F.lit(1)) == 0)
    )
    early = F.shiftright(F.least("a_o", "b_o"), 1)
    return short.join(long, fits).select(early.alias("early"), F.shiftright(later, 1).alias("late")).where("early < late").distinct()


def _packed_entries(sets: DataFrame, found: DataFrame, heavy: np.ndarray, ranges: int, percent: int) -> DataFrame:
    """(part, entries), the entries of _entries packed by ranges of w, without those of the heavy words (sorted hashes)."""
    left_out = sets.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array([(i << 50) // ranges for i in range(1, ranges)], dtype=np.uint64)
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            w, *more = (np.concatenate(x) for x in zip(*held))
            held.clear()
            by = np.argsort(w)
            w, more = w[by], [x[by] for x in more]
            ends = [0, *np.searchsorted(w, starts).tolist(), len(w)]
            some = [i for i in range(ranges) if ends[i + 1] > ends[i]]
            data = [_packed(*[x[ends[i] : ends[i + 1]] for x in (w, *more)]) for i in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["part", "entries"])

        for batch in batches:
            o, bits, n, skip, often, gone = (batch.column(c).to_numpy().astype(np.int64) for c in ("o", "bits", "n", "skip", "often", "gone"))
            words = batch.column("words").flatten().to_numpy().view(np.uint64)
            long = np.asarray(batch.column("words").value_lengths()).astype(np.int64)
            row = np.repeat(np.arange(len(o)), long)
            i = np.arange(len(words)) - np.repeat(np.cumsum(long) - long, long)
            hot, stays = i >= (long - often)[row], gone[row] == 0
            early = i < (n - -(-n * 2 * percent // (100 + percent)) + 1 - skip)[row]
            if len(left_out.value):
                some = ~(hot & np.isin(words, left_out.value))
                words, row, i, hot, stays, early = (x[some] for x in (words, row, i, hot, stays, early))
            kind = np.where(hot, np.where(stays, 2, 1), 0)
            role = np.where(early & (stays | ~hot), 3, 2)
            again = np.flatnonzero(hot & early)
            kind, role = np.append(kind, np.where(stays[again], 1, 2)), np.append(role, np.ones(len(again), dtype=np.int64))
            words, row, i = (np.append(x, x[again]) for x in (words, row, i))
            w = (words >> np.uint64(16) << np.uint64(2)) | kind.astype(np.uint64)
            held.append((w, (o * 2 + gone)[row], bits[row], (n[row] << 32) | ((i + skip[row]) << 2) | role))
            if sum(len(x[0]) for x in held) >= _PACK:
                yield packed()
        if held:
            yield packed()

    marked = _marked(sets, found).select("o", "bits", "n", "skip", "often", "gone", "words")
    return map_arrow(marked, run, "part int, entries binary")


def _near_sizes(w: np.ndarray, o: np.ndarray, bits: np.ndarray, at: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of _met among these entries, some more than once; only sets of near sizes are looked at."""
    by = np.lexsort((at >> 32, w))
    w, o, bits, at = w[by], o[by], bits[by], at[by]
    n, role = at >> 32, at & 3
    rest = n - ((at & ((1 << 32) - 1)) >> 2)  # words from the entry's on
    word = np.cumsum(np.append(False, w[1:] != w[:-1])[: len(w)]).astype(np.int64) << 32
    small, large = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    key = (word | n)[large]
    first = np.searchsorted(key, (word | n)[small])
    most = np.minimum(n[small] * 100 // max(percent, 1), (1 << 32) - 1)
    many = np.searchsorted(key, word[small] | most, side="right") - first
    ends, start = np.cumsum(many), 0
    while start < len(small):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PAIRS, side="right")))
        m = many[start:stop]
        a = np.repeat(small[start:stop], m)
        b = large[np.arange(len(a)) + np.repeat(first[start:stop] - np.cumsum(m) + m, m)]
        start = stop
        both = n[a] + n[b]
        near = (100 + percent) * np.minimum(rest[a], rest[b]) >= percent * both  # at the first word they share, all shared ones are still to come
        a, b, both = a[near], b[near], both[near]
        near = (100 + percent) * (both - np.bitwise_count((bits[a] ^ bits[b]).view(np.uint64))) >= 2 * percent * both
        a, b = a[near], b[near]
        a_o, b_o = o[a], o[b]
        early, later = np.minimum(a_o, b_o) >> 1, np.maximum(a_o, b_o)
        right = ((n[a] < n[b]) | (a_o < b_o)) & (later & 1 == 0) & (early < later >> 1)
        yield early[right], later[right] >> 1


def _met_in_ranges(packed: DataFrame, parts: int, percent: int) -> DataFrame:
    """The pairs (early, late) of _met, from _packed_entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Buffer]] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("entries"), strict=True):
                held.setdefault(part, []).append(data.as_buffer())
        while held:
            entries = [np.concatenate(x) for x in zip(*[_unpacked(data, 4) for data in held.popitem()[1]])]
            for early, late in _near_sizes(*entries, percent):
                by = np.lexsort((late, early))
                early, late = early[by], late[by]
                new = np.append(True, (early[1:] != early[:-1]) | (late[1:] != late[:-1]))[: len(early)]
                yield pa.RecordBatch.from_arrays([pa.array(early[new]), pa.array(late[new])], names=["early", "late"])

    return map_arrow(packed.repartition(parts, "part"), run, "early long, late long").distinct()


def _all_met(sets: DataFrame, found: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """The pairs (early, late) of sets that meet by a word; hot has the words w in m prefixes that many lines have.

    Entries go to tasks by ranges of words, of which there are enough for a
    task's memory, and a task looks only at pairs of near sizes. Words of more
    than HEAVY prefixes are met by a join instead.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = hot.where(F.col("m") > HEAVY).select("w")  # no more than one for HEAVY entries
    hashes = np.sort(heavy.toArrow()["w"].to_numpy().view(np.uint64))
    entries = sets.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(parts, entries // (4 * RANGE))
    out = _met_in_ranges(_packed_entries(sets, found, hashes, 4 * parts, percent), parts, percent)
    if not len(hashes):
        return out
    rows = _entries(sets, found, percent)
    some = F.broadcast(heavy.select(F.shiftrightunsigned("w", 16).alias("u")).distinct())
    rows = rows.join(some, F.shiftrightunsigned("w", 2) == F.col("u"), "left_semi").where(F.col("w").bitwiseAND(F.lit(3)) > 0)
    return out.union(_met(rows, percent)).distinct()


def later_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per document: (id_col, n_lines, n_removed, removed_lines), the latter the numbers, from 0, of lines to remove.

    A line (between line feeds) goes if its set of distinct words (A-Z
    lower-cased, between ASCII white space) has a Jaccard similarity of percent
    with that of an earlier line of any document; lines are ordered by id, then
    number. Lines without words always stay. Null texts have no lines; rows
    with a null id keep all their lines, and rows that share an id are judged
    by that id and line number together. An empty table gives no rows.

    Equal sets are one class. Its words are ordered from rare to frequent; two
    similar sets share a word of their prefixes, the smaller set's being the
    shorter one. Classes that meet there pass the length filter, the positional
    filter, and an exact bound from 64-bit parity maps before their sets are
    compared. Words in many prefixes first
    let their lines meet the earliest of them; only lines not yet found to go
    meet all earlier lines, so groups of near copies don't meet pair by pair.
    Candidates' sets are read again, and wider parity maps of them leave few
    to be compared in full.
    """
    spark = docs.sparkSession
    read = materialize(lines_and_words(docs, id_col, text_col), "lines", ("c", "d", "words"))
    counts = materialize(word_counts(read), "words")
    known = rarity(counts)
    lines = read.where("doc is not null").select("doc", "pos", "c", "d")
    discard(spark, counts)
    repeated = not docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()
    least, most, last = read.where("part is not null").agg(F.min("c"), F.max("d"), F.max("pos")).first()
    shift = (last or 0).bit_length()
    made = prefixes(docs, known, id_col, text_col, percent)
    # o orders classes by their first lines: of these, o holds id and number where both fit, else the rank
    if not repeated and (least or 0) >= 0 and (most or 0).bit_length() + shift <= 62:
        line = F.shiftleft("doc", shift).bitwiseOR(F.col("pos").cast("long"))
        firsts = lines.groupBy("c", "d").agg(F.min(line).alias("o"), F.count("*").alias("m"))
        several = materialize(firsts.where("m > 1").select("c", "d", "o"), "several")
        copies = lines.select("c", "d", line.alias("line")).join(small_enough(several, BROADCAST_IDS), ["c", "d"]).where("line <> o").select(F.col("line").alias("o"))
        made = made.withColumn("line", line)
        if several.count() <= BROADCAST_IDS:
            made = made.join(F.broadcast(several), ["c", "d"], "left").where("o is null or o = line").drop("o").withColumnRenamed("line", "o")
        else:
            made = made.withColumnRenamed("line", "o").join(firsts.select("c", "o"), ["c", "o"], "left_semi")

        def places(ids: DataFrame) -> DataFrame:
            return ids.select("o", F.shiftright("o", shift).alias("doc"), F.col("o").bitwiseAND((1 << shift) - 1).cast("int").alias("pos"))

        copies = places(copies)
    else:
        firsts = lines.groupBy("c", "d").agg(F.min(F.struct("doc", "pos")).alias("f")).select("c", "d", "f.doc", "f.pos")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = firsts.repartitionByRange(parts, "doc", "pos").sortWithinPartitions("doc", "pos")
        classes = materialize(ordered.withColumn("o", F.monotonically_increasing_id()), "classes")
        own = classes.select("c", "d", F.col("doc").alias("first_doc"), F.col("pos").alias("first_pos"))
        copies = lines.join(own, ["c", "d"]).where("doc <> first_doc or pos <> first_pos")
        made = made.drop("d").join(classes.drop("d"), ["c", "doc", "pos"])

        def places(ids: DataFrame) -> DataFrame:
            return classes.join(ids, "o", "left_semi")

    copies = materialize(copies.select("doc", "pos"), "copies")  # they go in any case, their classes' first lines if these match
    sets = made.select("o", "n", "bits", "skip", "often", "words")
    sets = materialize(sets.dropDuplicates(["o"]) if repeated else sets, "prefixes", ("o", "bits", "words.list.element"))
    discard(spark, read)

    def side(x: str, df: DataFrame) -> DataFrame:
        return df.select(F.col("w").alias(f"{x}_w"), *[F.col(c).alias(f"{x}_{c}") for c in ("o", "n", "bits", "i")])


    def frequent(some: DataFrame) -> DataFrame:
        entries = some.select("o", "n", "bits", "skip", (F.size("words") - F.col("often")).alias("first"), F.posexplode("words").alias("i", "w"))
        return entries.where("i >= first").select("w", "o", "n", "bits", (F.col("i") + F.col("skip")).alias("i"))

    often = frequent(sets)
    least = _least_shared(F.col("a_n") + F.col("b_n"), percent, 100 + percent)
    far = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits")))
    fits = (
        (F.col("a_w") == F.col("b_w")) & (F.col("a_o") < F.col("b_o"))
        & (F.lit(100) * F.least("a_n", "b_n") >= F.lit(percent) * F.greatest("a_n", "b_n"))
        & (F.least(F.col("a_i"), F.col("b_i")) + F.least(F.col("a_n") - F.col("a_i"), F.col("b_n") - F.col("b_i")) >= least)
        & (far <= F.col("a_n") + F.col("b_n") - 2 * least)
    )
    hot = often.groupBy("w").agg(F.count("*").alias("m"), F.min("o").alias("o")).where(F.col("m") > HOT)
    hot = materialize(hot, "hot")
    first = hot.select("w", "o")
    leading = sets.join(small_enough(first.select("o").distinct(), BROADCAST_IDS), "o", "left_semi")
    leaders = materialize(frequent(leading).join(small_enough(first, BROADCAST_IDS), ["w", "o"]), "leaders")
    met = side("b", often).join(small_enough(side("a", leaders), BROADCAST_IDS), fits)
    near = met.groupBy(F.col("b_o").alias("late")).agg(F.min_by("a_o", F.struct(far, F.col("a_o"))).alias("early"))
    found = _confirm(materialize(near, "met"), places, docs, repeated, id_col, text_col, percent)
    pairs = materialize(_all_met(sets, found, hot, percent), "pairs")
    discard(spark, sets, leaders)
    more = _confirm(pairs, places, docs, repeated, id_col, text_col, percent)
    matched = places(found.union(more).select(F.col("late").alias("o")).distinct()).select("doc", "pos")
    removed = matched.union(copies).groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("removed_lines"))  # of one document
    breaks = F.coalesce(F.octet_length("t") - F.octet_length(F.replace("t", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    out = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t")).select(id_col, breaks.alias("n_lines")).join(removed, F.col(id_col) == F.col("doc"), "left")
    removed_lines = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return out.select(id_col, "n_lines", F.size(removed_lines).cast("long").alias("n_removed"), removed_lines.alias("removed_lines"))


def remove_lines(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that judged (from later_matches) names taken out of the texts.

    All rows and columns stay, whatever their names; null texts, and rows whose
    id is null, are left as they are. Rows that share an id lose the same
    lines. An empty table gives no rows.
    """
    own, restored = by_place(docs)
    key, text = (F.col(own.columns[docs.columns.index(c)]) for c in (id_col, text_col))
    some = judged.where("n_removed > 0").select(F.col(id_col).alias("_id"), "removed_lines").dropDuplicates(["_id"])
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("removed_lines"), i)), "\n")
    out = own.join(small_enough(some, BROADCAST_IDS, F.size("removed_lines")), key == F.col("_id"), "left")
    return restored(out, **{text_col: F.when(F.col("_id").isNotNull(), kept).otherwise(text)})
