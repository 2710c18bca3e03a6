import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspark.operators import chunking, corpus, curation, graph, ordinals, registry, splits
from loomspark.schemas import RECORD


def chunked(spark, text, n=3):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(chunking.chunks(F.col("t"), n).alias("c")).first()["c"]


def test_chunks(spark):
    got = chunked(spark, "One a. Two b. Three c.\n\nFour d. Five e. Six f.")
    assert [(c["chunk_id"], c["sentence_count"], c["word_count"], c["start"], c["end"]) for c in got] == [(1, 3, 6, 0, 6), (2, 3, 6, 6, 12)]
    assert got[1]["text"] == "Four d. Five e. Six f."
    assert chunked(spark, "  \n\n ") == []


def sectioned(spark, docs, n, strategy):
    df = spark.createDataFrame([(0, i, f"d{i}", t) for i, t in enumerate(docs)], "bundle int, pos int, path string, text string")
    return chunking.bundled_documents(df, 1, n, strategy).first()["sections_structured"]


def test_sections(spark):
    docs = ["A1. A2. A3. A4.", "B1. B2."]
    assert [s.count("Segment") for s in sectioned(spark, docs, 4, "sequential")] == [1, 1, 1, 3]
    balanced = sectioned(spark, docs, 2, "doc_balanced")
    assert all("[Doc: d0]" in s and "[Doc: d1]" in s for s in balanced) and len(balanced) == 2
    mixed = sectioned(spark, docs, 1, "interleaved")[0].split("\n")[1:]
    assert [x.split("): ")[1] for x in mixed] == ["A1.", "B1.", "A2.", "B2.", "A3.", "A4."]
    assert sectioned(spark, docs[:1], 9, "interleaved")[-1].startswith("=== Section 4 ===")


def test_bundles(spark):
    files = spark.createDataFrame([(p,) for p in "abcde"], "path string")
    manifest = spark.createDataFrame([(0, 0, "d"), (0, 1, "zz"), (1, 0, "d"), (1, 1, "a")], "bundle long, pos int, path string")
    got = chunking.bundles(files, 2, 3, manifest).orderBy("kind", "bundle", "pos").collect()
    assert [(r["kind"], r["bundle"], r["path"]) for r in got] == [(0, 0, "d"), (0, 1, "a"), (1, 0, "b"), (1, 0, "c"), (1, 1, "e")]
    with pytest.raises(PySparkException, match="at most 2"):
        chunking.bundles(files, 3, 2).collect()


def test_ordinals(spark):
    df = spark.createDataFrame([(random.Random(i).random(),) for i in range(500)], "x double").repartition(7)
    got = ordinals.with_ordinal(df, ["x"]).orderBy("x").collect()
    assert [r["ordinal"] for r in got] == list(range(500))
    assert ordinals.with_ordinal(df.limit(0), ["x"]).count() == 0


def records(spark, rows):
    names = [p.split()[0] for p in RECORD.split(", ")]
    full = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, RECORD).withColumn("file_name", F.array("file_name")).withColumn("rec_ord", F.monotonically_increasing_id()).coalesce(1)


def pair(q, segs=(1,)):
    return (q, "a", 3, "contextual", "factual", list(segs), 1, [])


def scored(*scores):
    return ([(None, None, None, None, (float(s), ""), "") for s in scores],)


def test_quality_filter(spark):
    rows = [
        {"file_name": "f1", "deduplicated_qa_pairs": [pair("x"), pair("y")], "qa_evaluations": scored(7, 3)},
        {"file_name": "f2", "deduplicated_qa_pairs": [pair("z")]},
        {"file_name": "f3", "deduplicated_qa_pairs": []},
    ]
    df = records(spark, rows)
    assert [r["question"] for r in curation.scored_pairs(df).collect()] == ["x"]
    assert [r[0] for r in curation.skipped(df).collect()] == [["f2"]]
    assert curation.consistent(df).count() == 2
    assert tuple(curation.retention(df).first()) == (2, 1, 1, 1, 50.0)


def test_positives(spark):
    rows = [{"file_name": "f", "chunks": [("t1", 0, 1, 1, 1, 1, 1, None, None), ("t2", 1, 2, 1, 1, 2, 2, None, None)], "deduplicated_qa_pairs": [pair("x", (2, 1, 2)), pair("y", (9,)), pair("z", ()), pair("", (1,))], "qa_evaluations": scored(9, 9, 9, 9)}]
    df = records(spark, rows)
    pairs = curation.scored_pairs(df).withColumn("file_identifier", F.lit("f"))
    mapping = corpus.chunk_map(corpus.chunk_rows(df))
    one = corpus.with_positives(pairs, mapping).collect()
    assert [(r["question"], len(r["pos_ids"]), r["pos_ids"][0] == r["pos_ids"][2]) for r in one] == [("x", 3, True)]
    assert sorted(r["question"] for r in corpus.with_positives(pairs, mapping, None, False).collect()) == ["x", "z"]
    assert corpus.with_positives(pairs, mapping, 2).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    got = dict(graph.components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200))
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_merged_groups(spark):
    groups = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "b"), ("g2", "c"), ("g3", "x"), ("g4", "y"), ("g4", "z")], "group_id string, doc_id string")
    got = {}
    for g, d in graph.merged_groups(groups).collect():
        got.setdefault(g, set()).add(d)
    assert got == {"merged_0001": {"a", "b", "c"}, "merged_0002": {"y", "z"}}


@pytest.mark.parametrize("compatible", [False, True])
def test_random_split(spark, compatible):
    df = spark.createDataFrame([([f"f{i // 2}"], i) for i in range(40)], "file_name array<string>, i int")
    got = splits.random_split(df, 0.7, 0.2, 1, compatible=compatible).collect()
    other = splits.random_split(df.orderBy(F.desc("i")), 0.7, 0.2, 1, compatible=compatible).collect()
    assert {(r["i"], r["split"]) for r in got} == {(r["i"], r["split"]) for r in other}
    assert len({(tuple(r["file_name"]), r["split"]) for r in got}) == 20
    assert [sum(r["split"] == s for r in got) for s in ("train", "val", "test")] == [28, 8, 4]
    if compatible:
        keys = sorted({(f"f{i}",) for i in range(20)})
        random.Random(1).shuffle(keys)
        assert {tuple(r["file_name"]) for r in got if r["split"] == "train"} == set(keys[:14])
    with pytest.raises(ValueError):
        splits.random_split(df, 0.9, 0.2)


def test_file_groups(spark):
    groups = spark.createDataFrame([("g1", "a/x.txt"), ("g2", "b/x.txt")], "group_id string, doc_id string")
    files = spark.createDataFrame([("./a/x.txt",), ("b/x.md",), ("q.txt",)], "file_name string")
    assert {tuple(r) for r in splits.file_groups(groups, files).collect()} == {("./a/x.txt", "g1"), ("b/x.md", "g2")}
    with pytest.raises(PySparkException, match="ambiguous"):
        splits.file_groups(groups, spark.createDataFrame([("c/x.md",)], "file_name string")).collect()


def test_group_split_keeps_groups_together(spark):
    df = spark.createDataFrame([([f"f{i}"], i) for i in range(30)], "file_name array<string>, i int")
    groups = spark.createDataFrame([(f"g{i // 3}", f"f{i}") for i in range(12)], "group_id string, doc_id string")
    got = splits.split(df, "dedupped", groups).collect()
    assert len(got) == 30 and len({(r["i"] // 3, r["split"]) for r in got if r["i"] < 12}) == 4
    with pytest.raises(ValueError):
        splits.split(df, "cluster")


def test_modality_vote(spark):
    relevance = spark.createDataFrame([("q1", "d", 0), ("q2", "d", 1), ("q3", "d", 2), ("q4", "e", 3), ("qx", "e", 4)], "query_id string, corpus_id string, ord int")
    modes = spark.createDataFrame([("q1", "b", 0), ("q2", "a", 0), ("q3", "zz", 0), ("q3", "a", 1), ("q4", "b", 0)], "query_id string, modality string, load_ord int")
    assert {r["corpus_id"]: r["modality"] for r in curation.modality_votes(relevance, modes).collect()} == {"d": "a", "e": "b"}


def test_package_lists(spark):
    a = spark.createDataFrame([("x.whl", "sha256=1", None), ("y.whl", "sha256=2", ">=3")], "filename string, hash string, requires_python string")
    b = spark.createDataFrame([("x.whl", "sha256=1", ">=3.9")], a.schema)
    assert {tuple(r) for r in registry.merged_package_lists(a, b).collect()} == {("x.whl", "sha256=1", ">=3.9"), ("y.whl", "sha256=2", ">=3")}
    with pytest.raises(PySparkException, match="different bytes"):
        registry.merged_package_lists(a, b.withColumn("hash", F.lit("sha256=9"))).collect()
