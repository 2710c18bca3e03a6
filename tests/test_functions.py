import hashlib
import os.path
import posixpath

from pyspark.sql import functions as F

from loomspark.functions import code, text
from loomspark.shipping import ship


def values(spark, inputs, column):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", column.alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_norm_path(spark):
    paths = ["a/./b/../c//d", "", "..", "../a", "/..", "/a/../..", "//a/b", "///a", "a\\b", "a/../../b", "./"]
    assert values(spark, paths, text.norm_path(F.col("x"))) == [posixpath.normpath(p.replace("\\", "/")) for p in paths]


def test_file_name_parts(spark):
    names = ["a/b.txt", ".bashrc", "x/.hidden.md", "noext", "a.tar.gz", "..x", "d.e/f"]
    assert values(spark, names, text.base_filename(F.col("x"))) == [os.path.splitext(os.path.basename(n))[0] for n in names]
    assert values(spark, names, text.strip_extension(F.col("x"))) == [os.path.splitext(n)[0] for n in names]


def test_extensions(spark):
    names = ["A.TXT", "b.md", "Makefile", ".gitignore"]
    assert values(spark, names, text.matches_extensions(F.col("x"), [".txt", ""])) == [True, False, True, False]
    assert values(spark, names, text.matches_extensions(F.col("x"), None)) == [True] * 4


def test_ids(spark):
    df = spark.createDataFrame([(["b", "a/../a"],), (["one"],), ([],)], "m array<string>")
    got = df.select(text.source_id(F.col("m")).alias("s"), text.bundle_id(F.col("m")).alias("b")).collect()
    two, one = hashlib.md5(b"a||b").hexdigest(), hashlib.md5(b"one").hexdigest()
    assert [tuple(r) for r in got] == [(two[:16], two), ("one", one), ("", "")]
    assert values(spark, ["é"], text.corpus_id(F.col("x"))) == ["d_" + hashlib.sha256("é".encode()).hexdigest()[:16]]


def test_record_identifier_falls_back_on_empty_source(spark):
    df = spark.createDataFrame([("", ["f/x"]), (None, ["f/x"]), ("a//b", ["f/x"])], "s string, f array<string>")
    assert [r[0] for r in df.select(text.record_identifier(F.col("s"), F.col("f"))).collect()] == ["f/x", "f/x", "a/b"]


def test_title_and_strip(spark):
    ship(spark)
    words = ["foo-bar they're", "ÉCOLE x2y", ""]
    assert values(spark, words, text.title(F.col("x"))) == [w.title() for w in words]
    spaced = ["  a b \x1f", "　x\n"]
    assert values(spark, spaced, text.strip(F.col("x"))) == [s.strip() for s in spaced]


def test_sentences(spark):
    assert values(spark, ['One. Two! "Three?" Four'], text.sentences(F.col("x"))) == [["One.", "Two!", '"Three?"', "Four"]]
    assert values(spark, ["a.\n\n \nb", "  "], text.sentences(F.col("x"))) == [["a.", "b"], []]


def test_greedy_distinct(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [2.0, 0.0], [0.0, 0.0], [0.0, 0.0]],), ([],)], "v array<array<double>>")
    assert [r[0] for r in df.select(text.greedy_distinct(F.col("v"), 0.9)).collect()] == [[0, 1, 3, 4], []]


def test_code_functions(spark):
    assert values(spark, ["a/b.git", "https://github.com/x/y.git", "https://gitlab.com/x/y", "git@github.com:o/n"], code.github_repository(F.col("x"))) == ["a/b", "x/y", None, "o/n"]
    assert values(spark, ["1.2.3", "1.2.3rc1", "01.2.3"], code.bump_semver(F.col("x"), "minor")) == ["1.3.0", None, "1.3.0"]
    assert values(spark, ["a/b/c.py", "x.py", "[.py"], F.col("x").rlike(code.glob_to_regex("a*.py"))) == [True, False, False]
    assert values(spark, ["My Plugin!!", "--"], code.docs_slug(F.col("x"))) == ["my-plugin", "plugin"]
    assert values(spark, ["# T #\n", "no"], code.markdown_title(F.lit("some-dir/my_page.md"), F.col("x"))) == ["T", "Some Dir / My Page"]
    assert values(spark, ["my-plug"], code.pascal(F.col("x"))) == ["MyPlug"]
    assert values(spark, ["pkg_a-1.0-py3-none-any.whl", "pkg-a-2.0.tar.gz", "x"], code.wheel_parts(F.col("x"))["version"]) == ["1.0", "2.0", None]


def test_versions_sort(spark):
    ship(spark)
    order = ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.1", "1.10", "1!0.1"]
    keys = values(spark, order, code.version_key(F.col("x")))
    assert keys == sorted(keys)
