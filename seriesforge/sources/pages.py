"""A source of page geometry, to be filled in where a PDF library is at hand.

``PageSource`` is a Python data source: a reader function gives a file's blocks or strokes, one task
a file. No reader for PDF is bundled, because the libraries for it aren't part of this environment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seriesforge.sources.drawn import BLOCKS, SEGMENTS

#: Reader functions by the format's name: path -> rows of the asked kind.
READERS: dict[str, Callable[[str, str], Iterator[tuple]]] = {}


class PageSource(DataSource):
    """``spark.read.format("pages").option("kind", "blocks").option("reader", name).load(paths)``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return BLOCKS if self.options.get("kind", "blocks") == "blocks" else SEGMENTS

    def reader(self, schema) -> "PageReader":
        return PageReader(self.options)


class PageReader(DataSourceReader):
    """One partition a file."""

    def __init__(self, options):
        self.kind, self.named = options.get("kind", "blocks"), options.get("reader", "")
        self.read_file = READERS.get(self.named)
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        if self.read_file is None:
            raise ValueError(f"no reader named {self.named!r} is registered for pages")
        yield from self.read_file(partition.value, self.kind)
