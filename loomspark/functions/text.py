"""Paths, identities and text as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() has it: for Java regular expressions, the same without the line feed, and as a list.
PYTHON_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_IN_LINE = PYTHON_SPACE.replace(r"\s", r" \t\x0B\f\r")
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Control characters that texts don't have: between the sentences of a chunk, and between chunks.
_MARK, _CUT = "\x01", "\x02"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even where body's lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.btrim(text, F.lit(_SPACES))


def word_count(text: Column) -> Column:
    """Number of runs without white space."""
    bare = strip(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"{PYTHON_SPACE}+")))


def norm_path(path: Column) -> Column:
    """A source path with forward slashes, without . and .. steps and doubled slashes; an empty one is a dot."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    root = F.when(slashed.rlike("^//(?!/)"), "//").when(slashed.startswith("/"), "/").otherwise("")
    steps = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))

    def step(kept, s):
        up = (F.size(kept) == 0) | (F.element_at(F.concat(F.array(F.lit("")), kept), -1) == "..")
        back = F.when(~up, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(root == "", F.concat(kept, F.array(s))).otherwise(kept)
        return F.when(s == "..", back).otherwise(F.concat(kept, F.array(s)))

    joined = F.concat(root, F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/"))
    return F.when(joined == "", ".").otherwise(joined)


def members_key(members: Column) -> Column:
    """md5 of sorted members, which bundles are named by."""
    return F.md5(F.array_join(F.array_sort(members), "||").cast("binary"))


def source_id(members: Column) -> Column:
    """The one member, 16 hex digits for several, empty for none; members are normalised paths."""
    paths = F.transform(members, norm_path)
    return F.when(F.size(paths) == 0, "").when(F.size(paths) == 1, F.get(paths, F.lit(0))).otherwise(F.substring(members_key(paths), 1, 16))


def bundle_id(members: Column) -> Column:
    """32 hex digits, even for one member; empty for none."""
    paths = F.transform(members, norm_path)
    return F.when(F.size(paths) == 0, "").otherwise(members_key(paths))


def corpus_id(text: Column) -> Column:
    """A text's stable content id."""
    return F.concat(F.lit("d_"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def record_identifier(source: Column, file_name: Column) -> Column:
    """A record's source id if it has one, else the id that its file names give."""
    return F.when(F.coalesce(source, F.lit("")) != "", norm_path(source)).otherwise(source_id(file_name))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def strip_extension(path: Column) -> Column:
    """A path without its last extension; names that only begin with a dot keep it."""
    stem = F.regexp_extract(path, r"^(.*[^/.][^/]*)\.[^./]*$", 1)
    return F.when(path.rlike(r"^(.*/)?\.*[^/.][^/]*\.[^./]*$"), stem).otherwise(path)


def base_filename(path: Column) -> Column:
    """The last step of a path, without its extension."""
    return strip_extension(base_name(path))


def suffix(name: Column) -> Column:
    """The extension of a file name with its dot, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def matches_extensions(path: Column, extensions: Sequence[str] | None) -> Column:
    """Whether a path has one of the extensions, whatever their case; an empty one stands for names without a dot, none for all paths."""
    if not extensions:
        return F.lit(True)
    name = base_name(path)
    wanted = [e.lower() for e in extensions if e]
    hit = suffix(name).isin(wanted) if wanted else F.lit(False)
    return hit | (~name.contains(".") if "" in extensions else F.lit(False))


def file_names(raw: Column) -> Column:
    """A file_name column (a string, or a JSON array of them) as an array."""
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))


def _marked(text: Column) -> Column:
    """A text with a mark between its sentences, in two passes over it."""
    paragraphs = F.regexp_replace(strip(text), rf"\n(?:{_IN_LINE}*+\n)+{PYTHON_SPACE}*+", _MARK)
    return F.regexp_replace(paragraphs, rf"""([.!?]++["')\]]*+){PYTHON_SPACE}++{_MARK}?+|{_IN_LINE}++{_MARK}""", f"$1{_MARK}")


def sentences(text: Column) -> Column:
    """Sentences of all paragraphs in order: paragraphs end at blank lines, sentences after ., ! or ? (with closing quotes or brackets) and white space."""
    return F.when(strip(text) != "", F.split(_marked(text), _MARK)).when(text.isNotNull(), F.array().cast("array<string>"))


def chunk_pieces(text: Column, per_chunk: int, splitter: Callable[[Column], Column] | None = None) -> Column:
    """A text's runs of per_chunk sentences as an array of strings with a mark between sentences; a text without any gives one empty string.

    All is done by native string functions, whatever the number of sentences.
    A splitter, which makes an array of sentences, may replace the built-in one.
    """
    marked = _marked(text) if splitter is None else F.array_join(splitter(text), _MARK)
    if per_chunk == 1:
        return F.split(marked, _MARK)
    # Each match must begin where the last one ended: a rest of fewer sentences is looked at once.
    group = rf"\G((?:[^{_MARK}]*+{_MARK}){{{per_chunk - 1}}}[^{_MARK}]*+){_MARK}"
    return F.split(F.regexp_replace(marked, group, f"$1{_CUT}"), _CUT)


def piece_text(piece: Column) -> Column:
    """A piece as a text."""
    return strip(F.translate(piece, _MARK, " "))


def piece_sentences(piece: Column) -> Column:
    """A piece's number of sentences."""
    return F.length(piece) - F.length(F.replace(piece, F.lit(_MARK), F.lit(""))) + 1


def greedy_distinct(vectors: Column, threshold: float) -> Column:
    """Positions kept of an array of vectors: each is kept unless one kept before has a cosine above threshold; zero vectors are like nothing."""

    def unit(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return let(F.when(norm == 0, 1.0).otherwise(norm), lambda n: F.transform(v, lambda x: x / n))

    units = F.transform(vectors, lambda v, i: F.struct(i.alias("i"), unit(v).alias("v")))

    def dot(a, b):
        total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))

    def fold(u):
        kept = F.aggregate(u, F.slice(u, 1, 0), lambda k, x: F.when(F.exists(k, lambda y: dot(y["v"], x["v"]) > threshold), k).otherwise(F.concat(k, F.array(x))))
        return F.transform(kept, lambda x: x["i"])

    return let(units, fold)


def title(column: Column) -> Column:
    """Title case as Python has it: a letter after any other character is a capital."""
    return F.pandas_udf(_title, "string")(column)


def _title(values: pd.Series) -> pd.Series:
    return values.str.title()


def text_transform(column: Column, how: str) -> Column:
    """upper, lower or title."""
    kinds = {"upper": F.upper, "lower": F.lower, "title": title}
    if how not in kinds:
        raise ValueError(f"unknown transform: {how}")
    return kinds[how](column)
