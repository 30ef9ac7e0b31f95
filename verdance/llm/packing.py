"""Harmonic packing of token sequences."""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm.common import in_batches, kept_in_worker, table
from verdance.storage import materialize

CAPACITY = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: A piece may leave this part of its class's share empty; beyond it the document is cut.
SLACK = 1 / 64
#: White-space-free chunks whose ids a worker remembers.
REMEMBERED = 400_000


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> Iterator[tuple[int, int]]:
    """``(length, k)`` of the pieces of ``n`` tokens: a piece of class ``k`` fits ``k`` times.

    Whole capacities come first.  What is left goes to the class ``k`` of its
    reciprocal, ``k = capacity // length``, unless it would leave more than
    ``slack`` of the class's share ``capacity // k`` unused; then a piece of
    exactly the next smaller share is cut off.  Every cut at least halves the
    rest, so there are at most ``log2(capacity)`` of them.
    """
    while n >= capacity:
        yield capacity, 1
        n -= capacity
    while n:
        k = capacity // n
        if capacity // k - n <= slack * (capacity // k):
            yield n, k
            return
        part = capacity // (k + 1)
        yield part, capacity // part
        n -= part


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered(dict):
    """Values by key in two generations: a full young one becomes the old one, and what is used again moves up."""

    def __init__(self, compute: Callable[[str], bytes], most: int):
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ChunkEncoder:
    """Ids of whole texts by the tokenizer's own steps, each done once for what repeats.

    The vocabulary drops white space and its normaliser never looks across
    it, so the ids of a text are those of its chunks between white space; the
    ids of a chunk are those of the pieces that the vocabulary's pattern cuts
    it into.  Both are remembered, as little-endian bytes.  Chunks with
    characters from U+0250 on, whose normal form or lower case may depend on
    more than one character, and chunks that could hold a special token's
    string go through the tokenizer as a whole.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.piece = regex.compile(json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = _byte_letters()
        self.pieces = Remembered(self._piece, most * 2 // 3)
        self.chunks = Remembered(self._chunk, most)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        pieces = self.pieces
        if chunk.isascii():
            if chunk.isalpha():
                return pieces[chunk.lower()]
            if chunk[:-1].isalpha() and chunk[-1] in ".,":  # a word and the mark after it, the most frequent other chunk
                return pieces[chunk[:-1].lower()] + pieces[chunk[-1]]
            if not chunk.isprintable() or "<|" in chunk:
                return self._whole(chunk)
        else:
            if max(chunk) >= "\u0250" or min(chunk) < "!" or "\x7f" in chunk or "<|" in chunk:
                return self._whole(chunk)
            chunk = unicodedata.normalize("NFC", chunk)
        return b"".join(map(pieces.__getitem__, self.piece.findall(chunk.lower())))

    def _whole(self, chunk: str) -> bytes:
        return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        # str.split also splits at U+001C to U+001F, which the vocabulary has tokens for.
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return b"".join(map(self.chunks.__getitem__, filter(None, re.split(r"[ \t-\r]+", text)) if odd else text.split()))


def encoder(path: str, most: int = REMEMBERED) -> ChunkEncoder:
    """One for all tasks of a worker."""
    return kept_in_worker(("chunks", path, most), lambda: ChunkEncoder(path, most))


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("k", pa.int32()), ("part", pa.int32()), ("rank_in_part", pa.int64())])


def pieces(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents with their class and their rank among the class's pieces of the same task.

    A null or empty text is its end id alone.  Every row is a document, so a
    repeated row has pieces of its own, and so have rows with equal or null
    ids.  Other columns are not read; an empty table has no pieces.
    ``remembered`` chunks of text at most are kept with their ids in a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, ranks = encoder(vocabulary_path, remembered), TaskContext.get().partitionId(), Counter()
        end = int(end_id).to_bytes(4, "little")

        def rows():
            for b in batches:
                for doc, text in zip(*b.columns):
                    doc, ids = doc.as_py(), encode(text.as_py() or "") + end
                    n, start, view = len(ids) // 4, 0, memoryview(ids)
                    for length, k in cuts(n, capacity):
                        yield doc, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n, k, part, ranks[k]
                        ranks[k] += 1
                        start += length

        yield from in_batches(rows(), PIECES)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int, part int, rank_in_part long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _first_fit_decreasing(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], na_position="last", kind="stable")
        free: list[tuple[int, int]] = []  # (room, bin), sorted: the tightest bin that fits is taken
        bins, offsets, n = [], [], 0
        for length in order["length"].tolist():
            at = bisect_left(free, (length, -1))
            room, which = free.pop(at) if at < len(free) else (capacity, n)
            n = max(n, which + 1)
            bins.append(which)
            offsets.append(capacity - room)
            if room > length:
                insort(free, (room - length, which))
        return order.assign(bin=bins, offset=offsets)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "offset"]]

    return run


def harmonic_pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences of at most ``capacity`` tokens, ``k`` pieces of class ``k`` in each.

    Every worker ranks its own pieces; one total per worker and class gives it
    the rank it starts at, after which the bin ``rank // k`` and the place
    ``rank % k`` of each piece are known without any worker asking another.
    The pieces that do not fill a last bin are fewer than ``k`` for each class,
    and so fewer than ``capacity * (1 + ln capacity)`` whatever the corpus; that bounded
    rest alone is packed by first fit decreasing in one task.
    """
    parts = materialize(parts, "pieces")
    count = parts.groupBy("k", "part").agg(F.count("*").alias("n"))
    first = count.selectExpr("k", "part", "sum(n) over (partition by k order by part) - n as rank_0", "sum(n) over (partition by k) as n_k")
    # One row per class: at most 2 * sqrt(capacity) rows.
    base = count.groupBy("k").agg(F.sum("n").alias("n")).selectExpr("k", "sum(n div k) over (order by k) - n div k as seq_0")
    ranked = parts.join(first, ["k", "part"]).withColumn("rank", F.col("rank_0") + F.col("rank_in_part"))
    full = ranked.where("rank div k < n_k div k").join(F.broadcast(base), "k").selectExpr("*", "seq_0 + rank div k as sequence_id")
    full = full.selectExpr("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "cast(sum(length) over (partition by sequence_id order by rank) - length as long) as offset")
    rest = ranked.where("rank div k >= n_k div k").select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    n_full = count.groupBy("k").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.expr("n div k")), F.lit(0))).first()[0]
    packed = rest.groupBy(F.lit(0).alias("one")).applyInPandas(_first_fit_decreasing(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin long, offset long")
    packed = packed.selectExpr("doc_id", "start", "length", "ids_crc32", "doc_tokens", f"bin + {n_full} as sequence_id", "offset")
    return full.unionByName(packed)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as packed pieces; a null or empty text is its end id alone."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return harmonic_pack(pieces(docs, public_tokenizers.path(VOCABULARY)))
