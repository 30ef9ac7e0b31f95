"""Block-gzip text as a splittable source.

A block-gzip file is a chain of small gzip members, each of which states its
own length.  A plain gzip reader takes it in one task; here a file is cut at
byte offsets, each task starts at the first member after its offset, and lines
are given to the task in which they begin.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row

from verdance.shipping import ship

#: Compressed bytes of one task, and of one read.
SPLIT, READ = 64 << 20, 4 << 20
#: Longest member of the format; text in one Arrow batch.
LONGEST, BATCH = 1 << 16, 4 << 20
#: Text in a member that is written; what does not shrink still fits.
MEMBER = 0xFF00
#: Bits of a line number that count inside its task, as Spark's rising ids have them.
INSIDE = 33
FIXED = 9


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """Path and length of a file, or of the files of a folder by name, without hidden ones; paths are those of its file system."""
    at, inner = system_of(path)
    info = at.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else at.get_file_info(fs.FileSelector(inner))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and (i.path == inner or i.base_name[0] not in "._"))


def member_length(head: bytes) -> int | None:
    """Length of the member that starts here by its extra field; null if none starts here."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    end, i = 12 + struct.unpack_from("<H", head, 10)[0], 12
    while i + 4 <= min(end, len(head)):
        name, size = head[i : i + 2], struct.unpack_from("<H", head, i + 2)[0]
        if name == b"BC" and size == 2 and i + 6 <= len(head):
            return struct.unpack_from("<H", head, i + 4)[0] + 1
        i += 4 + size
    return None


def is_block_gzip(path: str) -> bool:
    """Whether a file, or the first of a folder, that pyarrow can open starts with a member that states its length; any other path is left to Spark's readers."""
    try:
        found = files_of(path)
        if not found:
            return False
        with system_of(path)[0].open_input_stream(found[0][0], compression=None) as f:
            return member_length(f.read(LONGEST)) is not None
    except (OSError, pa.ArrowInvalid):
        return False


def packed(text: bytes) -> bytes:
    """A member of at most ``MEMBER`` bytes of text; the member of no text marks the end of a file."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    head = struct.pack("<4sIBBH2sHH", b"\x1f\x8b\x08\x04", 0, 0, 255, 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def first_member(f: pa.NativeFile, size: int, start: int) -> int:
    """Offset of the first member at or after ``start``: its length leads to another member or to the end, and its text unpacks."""
    if start == 0:
        return 0
    f.seek(start)
    window = f.read(3 * LONGEST)
    i = window.find(b"\x1f\x8b\x08\x04")
    while 0 <= i < LONGEST:
        n = member_length(window[i : i + LONGEST])
        if n and (start + i + n == size or member_length(window[i + n : i + n + LONGEST]) is not None):
            try:
                zlib.decompress(window[i : i + n], 31)
                return start + i
            except zlib.error:
                pass
        i = window.find(b"\x1f\x8b\x08\x04", i + 1)
    if start + len(window) >= size:
        return size
    raise ValueError(f"no block starts in {LONGEST} bytes after {start}")


def unpacked(f: pa.NativeFile, size: int, at: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, text)`` of each member from the offset of one on."""
    held, base = b"", at
    while at < size:
        if len(held) - (at - base) < LONGEST and base + len(held) < size:
            f.seek(base + len(held))
            held = held[at - base :] + f.read(READ)
            base = at
        here = held[at - base : at - base + LONGEST]
        n = member_length(here)
        if n is None or len(here) < n:
            raise ValueError(f"no whole block at {at}")
        yield at, zlib.decompress(here[:n], 31)
        at += n


def lines(f: pa.NativeFile, size: int, start: int, end: int) -> Iterator[bytes]:
    """The lines of one task: those that begin after the start of its first member and not after that of the next task's.

    The first line of the file belongs to the first task.  A line of any
    length, over any number of members and tasks, is given once, whole.
    """
    first, stop = first_member(f, size, start), first_member(f, size, min(end, size))
    if first >= stop:
        return
    parts: list[bytes] = []
    skip = first > 0
    for at, text in unpacked(f, size, first):
        past = at >= stop
        if skip:
            if past:
                return
            cut = text.find(b"\n")
            if cut < 0:
                continue
            text, skip = text[cut + 1 :], False
        *whole, rest = text.split(b"\n")
        if whole:
            yield b"".join([*parts, whole[0]])
            if past:
                return
            yield from whole[1:]
            parts = []
        parts.append(rest)
    if not skip and any(parts):
        yield b"".join(parts)


@dataclass
class BlockPartition(InputPartition):
    """Bytes ``start`` to ``end`` of a file of ``size`` bytes; ``index`` counts the tasks of all files."""

    index: int
    path: str
    size: int
    start: int
    end: int


class BlockReader(DataSourceReader):
    """``keep`` (places of wanted cells) is empty for whole lines; else lines are records and only these cells leave the task."""

    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))
        self.width = int(options.get("width", 0))
        self.exact = options.get("exact", "true") == "true"
        self.keep = [int(i) for i in options.get("keep", "").split(",") if i]

    def partitions(self) -> Sequence[BlockPartition]:
        cuts = [(path, size, a, min(a + self.split, size)) for path, size in files_of(self.path) for a in range(0, max(size, 1), self.split)]
        return [BlockPartition(k, *cut) for k, cut in enumerate(cuts)]

    def read(self, partition: BlockPartition) -> Iterator[pa.RecordBatch]:
        base = partition.index << INSIDE
        with system_of(self.path)[0].open_input_file(partition.path) as f:
            numbers, texts, held = [], [], 0
            for n, line in enumerate(lines(f, partition.size, partition.start, partition.end)):
                if not (self.width and line.startswith(b"#")):
                    numbers.append(base + n)
                    texts.append(line)
                    held += len(line)
                if held >= BATCH:
                    yield self.batch(numbers, texts)
                    numbers, texts, held = [], [], 0
            if numbers:
                yield self.batch(numbers, texts)

    def batch(self, numbers: list[int], texts: list[bytes]) -> pa.RecordBatch:
        line = pa.array(numbers, pa.int64())
        text = pc.replace_substring_regex(pa.array(texts, pa.binary()).cast(pa.string()), "\r$", "")
        if not self.width:
            return pa.RecordBatch.from_arrays([line, text], names=["line", "text"])
        fields = pc.split_pattern(text, "\t")
        size = pc.list_value_length(fields)
        n, starts, flat = size.to_numpy(), fields.offsets.to_numpy()[:-1].astype(np.int64), fields.values
        # A record of another width is told by its number of columns and has no cells.
        good = n == self.width if self.exact else n >= self.width
        at = lambda i: flat.take(pa.array(starts + i, pa.int64(), mask=n <= i))
        wanted = starts[good][:, None] + FIXED + np.array(self.keep, np.int64)
        ends = np.concatenate([[0], np.cumsum(good * len(self.keep))]).astype(np.int32)
        cells = pa.ListArray.from_arrays(pa.array(ends), flat.take(pa.array(wanted.ravel())))
        return pa.RecordBatch.from_arrays([line, size, at(0), at(1), at(3), at(4), at(8), cells], names=RECORD_NAMES)


@dataclass
class Written(WriterCommitMessage):
    path: str


class BlockWriter(DataSourceWriter):
    """Lines of the only column, one file for each task; files of attempts that did not count are deleted at the end."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        at, inner = system_of(self.path)
        at.create_dir(inner, recursive=True)
        name = f"{inner.rstrip('/')}/part-{TaskContext.get().partitionId():05d}-{self.job}-{uuid.uuid4().hex}.gz"
        with at.open_output_stream(name, compression=None) as f:
            held = bytearray()
            for row in iterator:
                held += (row[0] or "").encode() + b"\n"
                while len(held) >= MEMBER:
                    f.write(packed(bytes(held[:MEMBER])))
                    del held[:MEMBER]
            if held:
                f.write(packed(bytes(held)))
            f.write(packed(b""))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        self._drop({m.path for m in messages if m})

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(set())

    def _drop(self, keep: set[str]) -> None:
        at, _ = system_of(self.path)
        for path, _ in files_of(self.path):
            if self.job in path and path not in keep:
                at.delete_file(path)


RECORD = "row_index long, n_columns int, chrom string, pos string, ref string, alt string, format string, cells array<string>"
RECORD_NAMES = [c.split(" ")[0] for c in RECORD.split(", ")]


class BlockGzip(DataSource):
    """``spark.read.format("blockgzip").load(path)``: lines, or with ``width`` and ``keep`` the records of a VCF."""

    @classmethod
    def name(cls) -> str:
        return "blockgzip"

    def schema(self) -> str:
        return RECORD if "width" in self.options else "line long, text string"

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options["path"])


def block_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """``(line, text)`` of a block-gzip file in tasks of ``split`` compressed bytes; numbers rise with the place in the file, with gaps between tasks."""
    _register(spark)
    return spark.read.format("blockgzip").option("splitBytes", split).load(path)


def block_records(spark: SparkSession, path: str, width: int, keep: Sequence[int], exact: bool = True, split: int = SPLIT) -> DataFrame:
    """Records of a block-gzip VCF with the cells of the places ``keep`` only, and with their number of columns; the cells of other samples never leave the reader."""
    if not keep:
        raise ValueError("no cells to keep")
    _register(spark)
    return spark.read.format("blockgzip").options(splitBytes=split, width=width, keep=",".join(map(str, keep)), exact=str(exact).lower()).load(path)


def numbered_from_zero(rows: DataFrame, column: str = "line") -> DataFrame:
    """Numbers without gaps, as one task would count: each task's numbers start after the lines of the tasks before it. ``rows`` must have all lines of the file."""
    part = F.shiftright(column, INSIDE)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row for each task
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    out = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn(column, F.col("__before") + F.col(column).bitwiseAND(F.lit((1 << INSIDE) - 1))).drop("__part", "__before")


def write_blocks(lines_of: DataFrame, path: str) -> None:
    """Write the lines of the only column to a new folder of block-gzip files, one for each partition; their names follow the partitions."""
    _register(lines_of.sparkSession)
    lines_of.write.format("blockgzip").mode("append").save(path)


def _register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(BlockGzip)
