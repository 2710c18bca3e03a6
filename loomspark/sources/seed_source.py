"""A directory's texts as a table source: spark.read.format("loom_texts")."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomspark.shipping import ship


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class TextReader(DataSourceReader):
    """The manifest on the driver, contents on executors; a file gives a row, or none if it isn't UTF-8 or too short."""

    def __init__(self, options):
        self.root, self.pattern = options["path"], options.get("pattern", "*")
        self.per_task, self.least = int(options.get("filesPerTask", 1000)), int(options.get("minLength", 0))

    def partitions(self) -> list[InputPartition]:
        names = sorted(str(p.relative_to(self.root)) for p in Path(self.root).rglob(self.pattern) if p.is_file())
        if not names:
            raise FileNotFoundError(f"no file under {self.root} matches")
        return [_Files(names[a : a + self.per_task]) for a in range(0, len(names), self.per_task)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for name in partition.names:
            try:
                text = (Path(self.root) / name).read_bytes().decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(text) >= self.least:
                yield name, text


class TextSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loom_texts"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema) -> TextReader:
        return TextReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    ship(spark)
    spark.dataSource.register(TextSource)
