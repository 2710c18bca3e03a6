"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import lower_ascii, materialize, small_enough

#: Rows of item samples, item shingles or candidate ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters; null has none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)
    first = F.when(parts.getItem(0) == "", 2).otherwise(1)
    last = F.when(F.element_at(parts, -1) == "", F.size(parts) - 1).otherwise(F.size(parts))
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def _grams(rows: DataFrame, k: int) -> DataFrame:
    """rows with w, an array column's k-word windows, a row for each, as structs of the words.

    The words' array is zipped with itself moved on by one word, by two and so
    on, which stays within generated code, as lambdas don't. As an outer
    generator it isn't evaluated once more to filter out rows without windows.
    """
    moved = [F.slice("words", F.lit(j + 1), F.greatest(F.size("words") - j, F.lit(0))) for j in range(k)]
    fields = F.arrays_zip(*[m.alias(f"w{j}") for j, m in enumerate(moved)])
    return rows.withColumn("w", F.explode_outer(fields)).where(F.col("w")[f"w{k - 1}"].isNotNull())


def _words(k: int) -> list[Column]:
    return [F.col("w")[f"w{j}"] for j in range(k)]


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for each item of which a document holds percent % of the distinct k-word shingles.

    Items are partitioned by their number of shingles, each partition spanning
    a factor of two. The bottom-s MinHash sample of an item holds s of its
    shingle hashes, s following from the partition's upper size so that an
    item contained to the threshold has a fixed least number of them in the
    document, whatever the document's length: no containment is missed. Only
    documents with enough windows for the partition are searched. Candidates
    are then verified on the strings of all their distinct shingles.

    Items of fewer than k words have their whole word sequence as one shingle,
    looked for as such. Items without words and null texts match nothing;
    documents or items with a null id are not reported, and rows that share an
    id count as one document or item. Ties and repeated rows give one pair.
    Empty tables give no rows. Other columns are ignored.
    """
    items = items.select(F.col(item_id).cast("long").alias("item"), words_of(F.col(text_col)).alias("words")).where("item is not null and size(words) > 0")
    items = items.withColumn("k", F.least(F.size("words"), F.lit(k)))
    sizes = sorted(r[0] for r in items.select("k").distinct().collect())  # at most k values
    strings = None
    for n in sizes:
        some = _grams(items.where(F.col("k") == n), n).select("item", "k", F.concat_ws(" ", *_words(n)).alias("s"))
        strings = some if strings is None else strings.union(some)
    if strings is None:
        return docs.sparkSession.createDataFrame([], f"{doc_id} long, {item_id} long, n_item long, n_shared long, containment double")
    strings = strings.distinct()
    counts = strings.groupBy("item").agg(F.count("*").alias("n"))
    items_full = materialize(strings.join(counts, "item"), "items")
    # The hash of a shingle's string would differ from that of its words: samples hash the words again.
    word = F.split("s", " ")
    hashes = F.lit(None).cast("long")
    for n in sizes:
        hashes = F.when(F.col("k") == n, F.xxhash64(*[F.get(word, F.lit(j)) for j in range(n)])).otherwise(hashes)
    low = F.pow(F.lit(2), F.floor(F.log2("n"))).cast("long")
    least = F.ceil(F.col("n") * percent / 100).cast("long")
    bottom = F.array_sort(F.collect_set("h"))  # of one item
    sampled = items_full.withColumn("h", hashes).groupBy("item", "n", "k").agg(bottom.alias("h")).withColumn("low", low)
    sampled = sampled.withColumn("taken", F.least(F.floor(F.col("low") * 2 * (100 - percent) / 100).cast("long") + 1, F.size("h").cast("long")))
    sampled = sampled.select("item", "k", F.ceil(F.col("low") * percent / 100).cast("long").alias("least_windows"), (F.col("taken") - (F.col("n") - least)).alias("need"), F.explode(F.slice("h", F.lit(1), F.col("taken").cast("int"))).alias("h"))
    sampled = small_enough(materialize(sampled, "samples"), BROADCAST_ROWS)

    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    rows = texts.select("doc", words_of(F.col("text")).alias("words"))
    hits = None
    for n in sizes:
        found = _grams(rows, n).select("doc", F.size("words").alias("size"), F.xxhash64(*_words(n)).alias("h"))
        own = sampled.where(F.col("k") == n)
        found = found.join(small_enough(own, BROADCAST_ROWS), "h").where(F.col("size") - n + 1 >= F.col("least_windows")).select("doc", "item", "need", "h")
        hits = found if hits is None else hits.union(found)
    candidates = hits.distinct().groupBy("doc", "item", "need").agg(F.count("*").alias("got")).where("got >= need").select("doc", "item")
    candidates = materialize(candidates, "candidates")
    named = small_enough(candidates.select("doc").distinct(), BROADCAST_ROWS)
    suspects = materialize(texts.join(named, "doc", "left_semi"), "suspects")
    again = suspects.select("doc", words_of(F.col("text")).alias("words"))
    pieces = None
    for n in sizes:
        part = _grams(again, n).select("doc", F.lit(n).alias("k"), F.concat_ws(" ", *_words(n)).alias("s"))
        pieces = part if pieces is None else pieces.union(part)
    shared = pieces.join(small_enough(items_full, BROADCAST_ROWS), ["k", "s"]).select("doc", "item", "n", "s").distinct()
    shared = shared.groupBy("doc", "item", "n").agg(F.count("*").alias("shared"))
    shared = shared.where(F.col("shared") * 100 >= F.col("n") * percent).join(candidates, ["doc", "item"], "left_semi")
    return shared.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("n").alias("n_item"), F.col("shared").alias("n_shared"), (F.col("shared") / F.col("n")).alias("containment"))
