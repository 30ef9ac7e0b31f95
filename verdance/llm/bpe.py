"""Byte-level BPE by longest matches and backtracking, exact and in linear time."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm.common import in_batches, kept_in_worker, table

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces of text, and pairs of tokens, that a worker remembers.
REMEMBERED = 500_000
NEVER = 1 << 60
#: Longest piece, in characters, that is remembered.
SHORT = 64


class BytePairCodec:
    """Encoder and decoder for a table of merge ranks.

    A token sequence is the result of the merges exactly if each two adjacent
    tokens are what the merges make of their joined bytes ("compatible").
    ``encode_piece`` therefore walks from left to right, takes the longest
    token that fits at each place, falls back to shorter ones while it is
    incompatible with the token before it, and steps back if none is left.  A
    place that was left without success is never entered again, so the steps
    are linear in the piece.  Compatibility is remembered by pair of tokens.
    Bytes are handed to the automaton as Latin-1, one character for each.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = REMEMBERED):
        # The pattern's authors mean Unicode white space; the regex module's \s also has U+001C to U+001F.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.ranks, self.most = ranks, most
        self.token = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.pieces: dict[str, bytes] = {}

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The merges by definition, the lowest rank first and the leftmost of equals, down to ``stop`` parts. For tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > stop:
            ranked = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = min(ranked)
            if best == NEVER:
                break
            i = ranked.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``t``; None for single bytes and for tokens that no merge makes."""
        if t not in self.split:
            two = self.merged(self.token[t], 2)
            self.split[t] = (self.ranks[two[0]], self.ranks[two[1]]) if len(two) == 2 and b"".join(two) in self.ranks and self.merged(self.token[t]) == [self.token[t]] else None
        return self.split[t]

    def reachable(self, t: int) -> bool:
        """Whether the merges make this one token of its own bytes."""
        return len(self.token[t]) == 1 or self.halves(t) is not None

    def spine(self, t: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the left (0) or right (1) end of ``t`` as it is merged: each part and the rank that ends it."""
        if (known := self.spines[side].get(t)) is None:
            two, known = self.halves(t), []
            if two:
                known = list(self.spine(two[side], side))
                known[-1] = (known[-1][0], t)
            known.append((self.token[t], NEVER))
            self.spines[side][t] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge joins the two tokens' bytes before both are complete.

        The parts that face each other at the joint change as the tokens are
        merged; a merge across it happens if its rank comes before the rank
        that ends either part, where of equal ranks the left one goes first.
        """
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > self.most:
                self.pairs.clear()
            left, right, i, j, known = self.spine(a, 1), self.spine(b, 0), 0, 0, True
            rank = self.ranks.get
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                m = rank(x + y, NEVER)
                if m < x_ends and m <= y_ends and m != NEVER:
                    known = False
                    break
                if x_ends == NEVER and y_ends == NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self.pairs[a, b] = known
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        fits: list[list[int]] = [[] for _ in data]  # tokens by start, from short to long
        for end, t in self.automaton.iter(data.decode("latin-1")):
            fits[end + 1 - len(self.token[t])].append(t)
        n, out, at = len(data), [], 0
        left = [len(x) for x in fits]  # candidates not tried yet at each start
        dead = bytearray(n + 1)
        while at < n:
            while left[at]:
                left[at] -= 1
                t = fits[at][left[at]]
                end = at + len(self.token[t])
                if not dead[end] and self.reachable(t) and (not out or self.compatible(out[-1], t)):
                    out.append(t)
                    at = end
                    break
            else:
                if not out:
                    raise ValueError("a byte has no token")
                dead[at] = 1
                at -= len(self.token[out.pop()])
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers, each match of the pattern by itself."""
        found = self.pattern.findall(text)
        known = self.pieces
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            pass
        if len(known) > self.most:
            known.clear()
        out = []
        for piece in found:
            ids = known.get(piece)
            if ids is None:
                ids = np.asarray(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= SHORT:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def codec(path: str, pattern: str) -> BytePairCodec:
    """One for all tasks of a worker."""
    return kept_in_worker(("bpe", path, pattern), lambda: BytePairCodec(load_ranks(path), pattern))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every row, and its ids as bytes if ``with_ids``.

    One pass without a shuffle; a null text is an empty one and has no ids.
    Repeated rows stay, other columns of ``docs`` are not read.
    """
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)

        def rows():
            for b in batches:
                for i, text in zip(b.column(0), b.column(1)):
                    ids = c.encode(text.as_py() or "")
                    yield i.as_py(), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest(), ids if with_ids else None

        yield from in_batches(rows(), schema, 256)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
    return out if with_ids else out.drop("ids")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")
