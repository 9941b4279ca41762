"""Layout parsers as a data source: one large file is many tasks, and its pages go to the parser in batches.

A parser has ``count(path, file)``, the number of pages, and ``parse(path, file, first, last)``, the blocks of these
pages in order, each with its ``page_idx``; ``file`` is open for reading and can be sought. Files are split by their
size, as Spark's own sources do, so that none is opened before its task runs; which pages a split takes is known when
the task has counted them. Small files share a task. What is read is named by paths that every executor can open.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any, BinaryIO, Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.blocks import BLOCK_SCHEMA

PAGES = "source string, page_idx int, pos int, block string, error string"


class PageParser(Protocol):
    def count(self, path: str, file: BinaryIO) -> int: ...

    def parse(self, path: str, file: BinaryIO, first: int, last: int) -> list[dict[str, Any]]: ...


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    bare = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), bare) if "://" not in bare else fs.FileSystem.from_uri(bare)


def listed(where: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder, named as Spark names them; like Spark's own sources it leaves out files of no bytes."""
    system, inner = located(where)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    start = "file:" if isinstance(system, fs.LocalFileSystem) else where[: where.index("://") + 3]
    return sorted((start + f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and f.path.endswith(suffix))


class Splits(InputPartition):
    """(path, number of the split, number of its file's splits) of one task."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces


def dealt(files: list[tuple[str, int]], most: int) -> list[Splits]:
    """Splits of at most ``most`` bytes; files that are smaller share one."""
    out, held, size = [], [], 0
    for path, n in files:
        k = -(-n // most)
        if k > 1:
            out += [Splits([(path, i, k)]) for i in range(k)]
            continue
        if held and size + n > most:
            out.append(Splits(held))
            held, size = [], 0
        held.append((path, 0, 1))
        size += n
    return [*out, Splits(held)] if held else out


class PageReader(DataSourceReader):
    def __init__(self, parser: PageParser, only: frozenset[str] | None, options: dict[str, str]):
        self.parser, self.only, self.where = parser, only, options["path"]
        self.suffix = options.get("suffix", ".pdf")
        self.first, self.last = int(options.get("firstPage", 0)), int(options["lastPage"]) if "lastPage" in options else None
        self.most, self.batch = max(1, int(options.get("splitBytes", 8 << 20))), max(1, int(options.get("batchPages", 16)))

    def partitions(self) -> list[Splits]:
        return dealt([x for x in listed(self.where, self.suffix) if self.only is None or x[0] in self.only], self.most)

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        for path, i, k in partition.pieces:
            try:
                yield from self._pages(path, i, k)
            except Exception as e:  # one file must not end the others
                yield _batch([(path, None, None, None, f"{type(e).__name__}: {e}")])

    def _pages(self, path: str, i: int, k: int) -> Iterator[pa.RecordBatch]:
        system, inner = located(path)
        with system.open_input_file(inner) as file:
            n = self.parser.count(path, file)
            wanted = max(0, (n if self.last is None else min(n, self.last + 1)) - self.first)
            begin, end = self.first + i * wanted // k, self.first + (i + 1) * wanted // k
            for low in range(begin, end, self.batch):
                high = min(end, low + self.batch)
                file.seek(0)
                rows, seen = [], {}
                for block in self.parser.parse(path, file, low, high - 1):
                    page = block.get("page_idx")
                    page = low if page is None else page
                    if low <= page < high:
                        rows.append((path, page, seen.setdefault(page, 0), json.dumps(block, ensure_ascii=False), None))
                        seen[page] += 1
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["source", "page_idx", "pos", "block", "error"])


class PageSource(DataSource):
    """The format ``layout_pages``; options: path, suffix, firstPage, lastPage, splitBytes, batchPages."""

    parser: PageParser
    only: frozenset[str] | None = None

    @classmethod
    def name(cls) -> str:
        return "layout_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PageReader:
        return PageReader(self.parser, self.only, self.options)


def read_pages(spark: SparkSession, where: str, parser: PageParser, pages: tuple[int, int | None] = (0, None), only: frozenset[str] | None = None, **options: int | str) -> DataFrame:
    """(source, page_idx, pos, block, error): the blocks of all files, or of those in ``only``, page by page; a split that fails is one row with ``error``.

    The paths of the files are on the driver, as in every source of files; their pages never are.
    """
    spark.dataSource.register(type("Source", (PageSource,), {"parser": parser, "only": only}))
    first, last = pages
    more = {} if last is None else {"lastPage": last}
    return spark.read.format("layout_pages").options(firstPage=first, **more, **options).load(where)


def failures(rows: DataFrame) -> DataFrame:
    """(source, error) of the files of which a split failed."""
    return rows.where("error IS NOT NULL").groupBy("source").agg(F.min("error").alias("error"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """Block rows of the files that were read whole, numbered through; the document is numbered by a hash of its path.

    Only the number of blocks of each page goes through a window, not the blocks.
    """
    fields = [f for f in BLOCK_SCHEMA.split(", ") if not f.startswith(("doc_id", "block_idx", "page_idx"))]
    whole = rows.where("error IS NULL").join(failures(rows).select("source"), "source", "left_anti")
    before = Window.partitionBy("source").orderBy("page_idx").rowsBetween(Window.unboundedPreceding, -1)
    pages = whole.groupBy("source", "page_idx").agg(F.count("*").alias("n"))
    starts = pages.select("source", "page_idx", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = whole.join(starts, ["source", "page_idx"])
    found = numbered.select("source", F.xxhash64("source").alias("doc_id"), (F.col("start") + F.col("pos")).cast("int").alias("block_idx"), "page_idx", F.from_json("block", ", ".join(fields)).alias("b"))
    order = [f.split(" ")[0] for f in BLOCK_SCHEMA.split(", ")]
    return found.select("source", "doc_id", "block_idx", "page_idx", "b.*").select("source", *order)
