import json
import random

import pytest
from pyspark.sql import functions as F

from loomspark.__main__ import main
from loomspark.functions import code, text
from loomspark.operators import chunking, registry, splits
from loomspark.plans import models
from loomspark.plans.config import GenerationConfig, RepositoryConfig, is_secret, is_under, producer_version, with_environment
from loomspark.plans.generate import StubClient, dedup_outcome, generate
from loomspark.shipping import ship
from loomspark.sources import files, projects, records, seed_source
from loomspark.storage import releasing, shared_folder, written


def values(spark, data, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_repository_addresses(spark):
    specs = ["https://GitHub.com/a/b", "http://github.com/a/b.git?tab=readme#x", "https://www.github.com/a/b", "https://github.com/a/b/c", " a/b.git ", "git@github.com:a/b.git", "a", "ftp://github.com/a/b", "https://github.com/a/b.git/"]
    want = ["a/b", "a/b", None, None, "a/b", "a/b", None, None, "a/b"]
    assert values(spark, specs, code.github_repository(F.col("x"))) == want
    from loomspark.sources.repositories import github_name

    for spec, name in zip(specs, want):
        if name is None:
            with pytest.raises(ValueError):
                github_name(spec)
        else:
            assert github_name(spec) == name


def test_owners_versions_and_requirements(spark):
    owners = ["@user", "@user-", "@-x", "@org/team_1", "@org/te.am", "a@b.c", "@org/"]
    assert values(spark, owners, code.is_release_owner(F.col("x"))) == [True, True, False, True, False, False, False]
    texts = [">=1, <2", "~=1", "~=1.2", "==1.*", ">1.*", "===any", "", None, "1.0", ">=1.0.dev1,>=1.0.dev1"]
    assert values(spark, texts, code.version_specifier(F.col("x"))) == ["<2,>=1", None, "~=1.2", "==1.*", None, "===any", None, None, None, ">=1.0.dev1"]
    found = values(spark, ["A.b_c[x,y]>=1 ; os_name == 'nt'", "a (<2)", "-bad", "a >= x", "a @ https://x"], code.requirement_parts(F.col("x")))
    assert [tuple(r) if r else None for r in found] == [("a-b-c", ">=1", 'os_name == "nt"'), ("a", "<2", None), None, None, None]


def test_headers(spark):
    head = "# SPDX-License-Identifier: MIT\n\n"
    texts = ["x\n", "#!/bin/sh\nx\n", "# SPDX-License-Identifier: ISC\n# SPDX-FileCopyrightText: a\n\n\nx\n", "", "#!/bin/sh\n# SPDX-License-Identifier: ISC\n"]
    want = [head + "x\n", "#!/bin/sh\n" + head + "x\n", head + "x\n", head.rstrip("\n") + "\n", "#!/bin/sh\n" + head.rstrip("\n") + "\n"]
    assert values(spark, texts, code.with_header(F.col("x"), F.lit(head))) == want


def test_splitting_odd_texts(spark):
    """Long texts without a sentence's end, white space of all kinds, blank lines with blanks, a closing quote."""
    odd = ["word " * 20000, "a.  \n \n  b? c", "One. Two! \n　\nThree", "x\n\n\ny", ' "Yes." No. ', "...\n...", "\n \n", None, "a." * 3000]
    got = values(spark, odd, text.sentences(F.col("x")))
    assert got == [["word " * 19999 + "word"], ["a.", "b?", "c"], ["One.", "Two!", "Three"], ["x", "y"], ['"Yes."', "No."], ["...", "..."], [], None, ["a." * 3000]]
    df = spark.createDataFrame([(1, " ".join(f"S{i}." for i in range(11))), (2, "no end"), (3, " "), (4, None)], "id int, text string")
    rows = chunking.exploded_chunks(df, "id", per_chunk=5).orderBy("id", "doc_chunk_index").collect()
    assert [(r["id"], r["sentence_count"], r["start"], r["end"]) for r in rows] == [(1, 5, 0, 5), (1, 5, 5, 10), (1, 1, 10, 11), (2, 1, 0, 2)]
    arrays = {r["id"]: r["c"] for r in df.select("id", chunking.chunks(F.col("text")).alias("c")).collect()}
    assert [c["text"] for c in arrays[1]] == [r["text"] for r in rows if r["id"] == 1] and arrays[3] == [] and arrays[4] is None
    words = lambda t: F.split(t, " ")
    assert [len(r["c"]) for r in df.where("id = 1").select(chunking.chunks(F.col("text"), 2, splitter=words).alias("c")).collect()] == [6]


def test_sentence_splitter_is_planned_once(spark):
    df = spark.createDataFrame([(1, "a. b")], "id int, text string")
    plan = chunking.exploded_chunks(df, "id").select("id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[.!?]") == 1


def plain_greedy(units, train, val, seed):
    import hashlib

    total = sum(w for _, w in units)
    goals, sums, out = {"train": total * train, "val": total * val, "test": total * (1.0 - train - val)}, dict.fromkeys(("train", "val", "test"), 0), {}
    for u, w in sorted(units, key=lambda x: (-x[1], hashlib.md5(f"{seed}|{x[0]}".encode()).hexdigest())):
        best = max(goals, key=lambda s: goals[s] - sums[s])
        sums[best] += w
        out[u] = best
    return out


def test_greedy_split_against_a_plain_loop(spark):
    r = random.Random(1)
    units = [(f"u{i}", r.choice([1, 1, 2, 3, 50, r.randrange(1, 400)])) for i in range(400)]
    got = dict(splits.greedy_split(spark.createDataFrame(units, "unit string, weight long"), 0.7, 0.2, 5).collect())
    assert got == plain_greedy(units, 0.7, 0.2, 5)
    assert splits.greedy_split(spark.createDataFrame([], "unit string, weight long"), 0.7, 0.2, 5).count() == 0


def test_groups_of_files_with_one_name(spark, tmp_path):
    for name, group in (("a", "x"), ("b", "y")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "g.json").write_text(json.dumps({"exact": {"groups": {"g1": [group], group: [f"{group}1", f"{group}2"]}}}))
    got = records.load_groups(spark, [str(tmp_path / n / "g.json") for n in ("a", "b")]).orderBy("group_id", "pos").collect()
    assert [(r["group_id"], r["doc_id"]) for r in got] == [("g1", "y"), ("x", "x1"), ("x", "x2"), ("y", "y1"), ("y", "y2")]


def test_package_list_files(spark, tmp_path):
    good = {"filename": "b-1.10-py3-none-any.whl", "hash": "sha256=" + "0" * 64, "requires_python": ">=3.10"}
    path = tmp_path / "list.jsonl"
    path.write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"filename": "b-1.9-py3-none-any.whl"}) + "\n")
    rows = records.load_package_list(spark, str(path))
    assert [r["filename"] for r in rows.collect()] == ["b-1.9-py3-none-any.whl", "b-1.10-py3-none-any.whl"]
    assert json.loads(registry.package_list_lines(rows).collect()[1]["value"]) == good
    for broken in ("[1]", "{", json.dumps(good | {"hash": "md5=1"}), json.dumps(good | {"requires_python": "=>3"}), json.dumps(good | {"filename": "a/b.whl"})):
        path.write_text("\n" + json.dumps(good) + "\n" + broken + "\n")
        with pytest.raises(Exception, match="list.jsonl:3 "):
            records.load_package_list(spark, str(path)).collect()
    assert records.load_package_list(spark, str(tmp_path / "none")).count() == 0


def project(name, version="1.0.0", more="", points='a = "m:a"'):
    return f'[project]\nname = "{name}"\nversion = "{version}"\ndescription = "What {name} does"\nlicense = "MIT"\nreadme = "README.md"\nauthors = [{{name = "A"}}]\nrequires-python = ">=3.10"\ndependencies = ["Host_Lib>=1,<2; python_version > \'3.9\'"]\n{more}[project.entry-points."some.plugins"]\n{points}\n'


SETTINGS = '[tool.x.catalog]\ncatalog-url = "https://c/x"\nrepository-url = "https://r"\ndocs-base-url = "https://docs.example/"\npackage-prefix = "pre-"\npackage-index-url = "https://i"\npackage-assets-url = "https://a"\npackage-assets-release-tag = "t"\ndefault-host-requirement = "host-lib>=1"\nauthor-name = "A"\nrelease-ref-template = "{package}/v{version}"\n'


def test_projects_to_catalog_and_release(spark, tmp_path):
    plugins = tmp_path / "plugins"
    for folder, content, owners in (("pre-a", project("pre-a"), "* @org/team\n"), ("pre-b", project("pre-b", "1.x"), ""), ("pre-c", "no toml", None)):
        (plugins / folder).mkdir(parents=True)
        (plugins / folder / "pyproject.toml").write_text(content)
        if owners is not None:
            (plugins / folder / "CODEOWNERS").write_text(owners)
    (plugins / "pre-a" / "docs").mkdir()
    (tmp_path / "pyproject.toml").write_text(SETTINGS)
    found = projects.projects(spark, str(plugins), "some.plugins")
    rows = {r["folder"]: r for r in found.collect()}
    assert rows["pre-a"]["entry_points"] == {"a": "m:a"} and rows["pre-a"]["owners"] == ["@org/team"] and rows["pre-a"]["has_docs"] and not rows["pre-b"]["has_docs"] and rows["pre-c"]["error"].startswith("not TOML")
    settings = projects.catalog_settings(str(tmp_path / "pyproject.toml"), "tool", "x", "catalog", aliases={"default-host-requirement": "default-requirement"})
    assert (settings.package_name("z"), settings.docs_url("plugins/z/"), settings.release_ref("p", "1")) == ("pre-z", "https://docs.example/plugins/z/", "p/v1")
    entries = projects.catalog_rows(found, settings, "host-lib").where("package = 'pre-a'")
    (one,) = entries.collect()
    assert (one["requirement"], one["python"], one["docs_url"], one["host_specifier"], one["host_marker"], one["repository_path"]) == ("pre-a", ">=3.10", "https://docs.example/plugins/pre-a/", "<2,>=1", 'python_version > "3.9"', "plugins/pre-a")
    assert registry.compatibility_errors(entries, "host-lib").count() == 0
    tagged = found.where("error is null").withColumn("tag_version", F.lit("1.0.0"))
    errors = {tuple(r) for r in registry.release_errors(tagged, "host-lib", settings.release_ref_template).collect()}
    assert errors == {("pre-b", e) for e in ("version is malformed", "version differs from the tag's", "release ref differs from the template's", "no owner who can release")}
    full = entries.withColumns({"package_pos": F.lit(0), "plugin_pos": F.lit(0), "plugin": F.lit("plug-a"), "plugin_type": F.lit("t"), "entry_group": F.lit("some.plugins")})
    document = json.loads(registry.catalog_document(full))
    assert document["schema_version"] == 2 and document["packages"][0]["plugins"][0]["entry_point"] == {"group": "some.plugins", "name": "a", "value": "m:a"}
    assert projects.repeated_slugs(found).count() == 0 and projects.bumped(project("x"), "minor")[1] == "1.1.0"
    for wrong in (SETTINGS.replace('"https://r"', '"ftp://r"'), SETTINGS.replace("{version}", "{other}"), SETTINGS.replace('author-name = "A"', ""), SETTINGS.replace(">=1", "")):
        (tmp_path / "pyproject.toml").write_text(wrong)
        with pytest.raises(ValueError):
            projects.catalog_settings(str(tmp_path / "pyproject.toml"), "tool", "x", "catalog", aliases={"default-host-requirement": "default-requirement"})


def test_models(tmp_path):
    roles = {"artifact_extraction": ("m", "p"), "qa_generation": ("m", "p"), "quality_judge": ("j", "p")}
    suite, aliases = models.model_suite(roles, ("e", "p"), 4)
    assert [m.alias for m in suite] == ["embed", "artifact_extraction", "quality_judge"] and aliases["qa_generation"] == "artifact_extraction"
    assert suite[1].parameters["max_parallel_requests"] == 4 and models.check_embedding("embed", suite).model == "e"
    for alias in ("quality_judge", "none"):
        with pytest.raises(ValueError):
            models.check_embedding(alias, suite)
    path = tmp_path / "p.json"
    path.write_text(json.dumps([{"name": "a", "endpoint": "https://file"}]))
    configured = [models.Provider("a", "https://x"), models.Provider("b", "https://y", api_key="KEY")]
    everything, custom = models.providers(configured, str(path), {"name": "b", "endpoint": "https://z"}, lambda: [models.Provider("a", "https://d"), models.Provider("d", "https://d")])
    assert {p.name: p.endpoint for p in everything} == {"d": "https://d", "a": "https://file", "b": "https://z"} and custom[1].api_key == "KEY"
    assert models.providers() == (None, [])
    with pytest.raises(ValueError):
        models.providers([configured[0], models.Provider("a", "https://other")])
    assert any("with a key" in line for line in models.described(suite, custom)) and "KEY" not in " ".join(models.described(suite, custom))


def test_settings(tmp_path, monkeypatch):
    assert [is_secret(n) for n in ("api_key", "API-KEY", "my_token", "token", "api_key_env", "x_password", "max_tokens")] == [True, True, False, True, False, True, False]
    monkeypatch.setenv("LOOM_TEST", "v")
    assert with_environment({"a": ["${LOOM_TEST}", "x ${LOOM_TEST}"]}) == ({"a": ["v", "x ${LOOM_TEST}"]}, ["LOOM_TEST"])
    assert is_under(str(tmp_path / "a" / ".." / "b"), str(tmp_path)) and not is_under(str(tmp_path / ".."), str(tmp_path)) and producer_version()
    for bad in (lambda: RepositoryConfig(), lambda: RepositoryConfig(path=".", clone_depth=0), lambda: GenerationConfig(start_index=3, end_index=2), lambda: GenerationConfig(dataset_name="..")):
        with pytest.raises(ValueError):
            bad()


def folder_of(tmp_path, n):
    root = tmp_path / "texts"
    root.mkdir()
    for i in range(n):
        (root / f"f{i}.txt").write_text(f"File {i} says this. And that. " * 4)
    (root / "bad.txt").write_bytes(b"\xff")
    return root


def test_index_range_buffers_and_amounts(spark, tmp_path):
    root = folder_of(tmp_path, 6)
    seed = {"path": str(root), "min_text_length": 1}
    from loomspark.plans.config import from_mapping

    config = from_mapping(GenerationConfig, {"seed_source": seed, "output_dir": str(tmp_path / "out"), "buffer_size": 2, "start_index": 1, "end_index": 4})
    made = generate(spark, config, StubClient(3))
    names = {r["source_id"] for r in spark.read.json(str(made.path)).select("source_id").collect()}
    assert names == {f"f{i}.txt" for i in range(1, 5)}
    sizes = [len(p.read_text().splitlines()) for p in made.path.glob("*.json")]
    assert max(sizes) <= 2 and sum(sizes) == 4
    assert files.count_seeds(spark, str(root)) == 7 and files.count_seeds(spark, str(root), multi_doc=True) == 4
    with pytest.raises(ValueError):
        generate(spark, from_mapping(GenerationConfig, {"seed_source": seed, "output_dir": str(tmp_path / "more"), "num_records": 99}), StubClient(3))
    counted = dedup_outcome(spark.read.schema("qa_generation struct<pairs:array<struct<question:string>>>, deduplicated_qa_pairs array<struct<question:string>>").json(str(made.path))).first()
    assert counted["kept"] + counted["removed"] == 12


def test_contents_are_read_by_extension(spark, tmp_path):
    root = folder_of(tmp_path, 2)
    (root / "X.TXT").write_text("Upper case. Indeed.")
    (root / "y.bin").write_text("no")
    listed = files.listing(spark, str(root), extensions=[".txt"])
    got = {r["path"]: r["text"] for r in files.texts(spark, listed, str(root), extensions=[".txt"]).collect()}
    assert set(got) == {"f0.txt", "f1.txt", "X.TXT", "bad.txt"} and got["bad.txt"] is None and got["X.TXT"].startswith("Upper")


def test_table_source(spark, tmp_path):
    root = folder_of(tmp_path, 5)
    seed_source.register(spark)
    df = spark.read.format("loom_texts").option("path", str(root)).option("filesPerTask", 2).option("minLength", 3).load()
    assert sorted(r["path"] for r in df.collect()) == [f"f{i}.txt" for i in range(5)] and df.rdd.getNumPartitions() == 3


def test_flags_of_several_values(tmp_path, capsys):
    assert main(["generate", "--query-counts", "multi_hop=1", "structural=1"]) == 2
    assert "query_counts" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["generate", "--query-counts", "multi_hop=x"])


def test_written_tables_are_deleted(spark):
    with releasing(spark):
        path = written(spark.range(3).toDF("x"), "test")._loomspark_path
        import os

        assert os.path.exists(path) and path.startswith(shared_folder(spark))
    assert not os.path.exists(path)


def test_version_order_in_places(spark):
    ship(spark)
    rows = spark.createDataFrame([(f"p-{v}-py3-none-any.whl",) for v in ("1.10", "1.9", "1.9rc1", "1.9.post1")], "filename string")
    assert [r["filename"].split("-")[1] for r in registry.placed_package_list(rows).orderBy("place").collect()] == ["1.9rc1", "1.9", "1.9.post1", "1.10"]


def test_corpus_splits_and_archives(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    (tmp_path / "corpus.jsonl").write_text('{"_id": "a", "text": "t"}\n{"_id": "b", "text": "u", "group_id": "g"}\n')
    assert [(r["_id"], r["group_id"]) for r in records.load_corpus(spark, str(tmp_path / "corpus.jsonl")).orderBy("line_ord").collect()] == [("a", None), ("b", "g")]
    (tmp_path / "splits.json").write_text(json.dumps({"text": ["q1", "q2"], "image": ["q2"]}))
    assert [tuple(r) for r in records.load_splits(spark, str(tmp_path / "splits.json")).orderBy("load_ord", "query_id").collect()] == [("q1", "text", 0), ("q2", "text", 0), ("q2", "image", 1)]
    dist = tmp_path / "dist"
    dist.mkdir()
    with zipfile.ZipFile(dist / "a-1.0-py3-none-any.whl", "w") as z:
        z.writestr("a-1.0.dist-info/METADATA", "Name: a\nRequires-Python: >=3.10\n\nbody\nRequires-Python: no\n")
    with tarfile.open(dist / "a-1.0.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("a-1.0/PKG-INFO")
        data = b"Name: a\n\n"
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    rows = {r["filename"]: r for r in records.distributions(spark, str(dist)).collect()}
    assert rows["a-1.0-py3-none-any.whl"]["requires_python"] == ">=3.10" and rows["a-1.0.tar.gz"]["requires_python"] is None
    assert registry.package_list_errors(records.distributions(spark, str(dist))).count() == 0


def test_processors_run_after_columns(spark):
    from loomspark.plans.generate import TextTransform, run_columns

    df = spark.createDataFrame([("ab",)], "x string")
    seen = run_columns(df, [TextTransform("y", "x"), TextTransform("z", "y", "lower", drop=True)], processors=[lambda t: t.withColumn("n", F.length("y"))])
    assert seen.columns == ["x", "y", "n"] and seen.first()["y"] == "AB"
    with pytest.raises(ValueError):
        run_columns(df, [TextTransform("y", "none")])
