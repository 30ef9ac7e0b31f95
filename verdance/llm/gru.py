"""Document log-likelihoods from a gated recurrent language model written in numpy.

The model reads word symbols: the most frequent words by themselves, all others
by a class of their spelling.  Its output is factored: first a class of 64
symbols, then the symbol inside it; the last class holds the spellings.  A word
outside the frequent ones is scored inside its spelling by its smoothed count
over the whole training corpus, so every text has a proper probability.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm.common import in_batches, table
from verdance.storage import materialize, result_only

#: Frequent words that are symbols, spelling classes of the others, and symbols of an output class: the last class has all spellings.
WORDS, TAILS, PER_CLASS = 4096, 64, 64
SYMBOLS = WORDS + TAILS
#: Tokens that meet the output weights at once.
BLOCK = 512
#: Logits below this in size need no shift before they are exponentiated in single precision.
SAFE = 60.0
#: Rows of one place that are summed at once.
OFTEN = 32
#: Words whose counts every worker holds; all rarer ones meet their counts in a join.
HELD = 131_072
#: Units; tokens of a window, after which backpropagation is cut and the state goes on; documents read side by side.
HIDDEN, WINDOW, LANES = 32, 32, 256
#: Window of scoring, which has nothing to cut: longer ones cost less.
SCORED_WINDOW = 64
#: Documents read side by side in scoring, where no step of learning depends on it: more of them share what a call costs.
SCORED_LANES = 512
#: Step sizes; each round trains on its own part of the documents, and the workers' weights are averaged after it.
RATES = (0.03, 0.02, 0.01, 0.005)
ADDED = 0.1
END = b""
#: Distinct words of several stretches that a worker adds up before it hands them on.
COUNTED = 600_000
#: Bytes of text whose words are numbered at once.
STRETCH = 8 << 20
FAN_IN = 64
SEED = 7
LN10 = float(np.log(10.0))


def stretches(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, in slices of some ``STRETCH`` bytes; a longer text is a slice by itself."""
    at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // STRETCH
    edges = [0, *(np.nonzero(np.diff(at))[0] + 1).tolist(), len(texts)]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield texts.slice(lo, hi - lo)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space, ASCII letters in lower case: the distinct ones, with ``END`` among them; the place there of each word of text after text, each text with its end; and where each text stops."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words, ids = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
    # White space at the edges of a text leaves empty words, which are none.
    end = pc.index(words, END).as_py()
    if end < 0:
        end, words = len(words), pa.concat_arrays([words, pa.array([END], pa.binary())])
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    some = ids != end
    owner, ids = owner[some], ids[some]
    out = np.full(len(ids) + len(texts), end, np.int64)
    out[np.arange(len(ids)) + owner] = ids
    return words, out, np.cumsum(np.bincount(owner, minlength=len(texts)) + 1)


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


class Weights:
    """The model's parameters as one flat vector with named parts; the last column of ``wc`` and ``ww`` is the bias."""

    def __init__(self, flat: np.ndarray | None = None):
        shapes = {"g": (SYMBOLS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (SYMBOLS // PER_CLASS, HIDDEN + 1), "ww": (SYMBOLS, HIDDEN + 1)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.zeros(size, np.float32) if flat is None else flat
        at = 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, counts: np.ndarray, tail_mass: np.ndarray) -> Weights:
        """Random state weights, and output biases that make the first model the unigram model."""
        self, rng = cls(), np.random.default_rng(SEED)
        self.g[:] = rng.normal(0, 0.2, self.g.shape)
        self.u[:] = rng.normal(0, HIDDEN**-0.5, self.u.shape)
        self.wc[:, :-1] = rng.normal(0, 0.05, self.wc[:, :-1].shape)
        self.ww[:, :-1] = rng.normal(0, 0.05, self.ww[:, :-1].shape)
        mass = np.full(SYMBOLS, 1e-6)
        mass[: len(counts)] = counts + ADDED
        mass[WORDS:] = tail_mass
        self.ww[:, -1] = np.log(mass)
        self.ww[len(counts) : WORDS, -1] = -30.0
        self.wc[:, -1] = np.log(mass.reshape(-1, PER_CLASS).sum(1))
        self.wc[:, -1] -= self.wc[:, -1].max()
        return self


class Model:
    def __init__(self, w: Weights):
        self.w = w
        self.m, self.v, self.t = np.zeros_like(w.flat), np.zeros_like(w.flat), 0
        self.g = self.inner = None
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array for one use at a time, from memory that stays: fresh pages for each window would cost more than what is computed in them."""
        size = math.prod(shape)
        if name not in self.rooms or self.rooms[name].size < size:
            self.rooms[name] = np.empty(size + size // 4, np.float32)
        return self.rooms[name][:size].reshape(shape)

    def states(self, x: np.ndarray, h: np.ndarray, keep: bool):
        """States after each symbol of ``x`` (lanes, window), from ``h``; with ``keep`` also gates, candidates, what the candidates take from the state before (times -2), and that state. All hold until the next call."""
        n, (lanes, width) = HIDDEN, x.shape
        # Signs and factors are those inside the exponentials of sigmoid and tanh; states meet them gate by gate, so that all that follows is contiguous.
        if self.inner is None:
            factors = np.repeat(np.array([-1, -1, -2], np.float32), n)
            self.inner = np.multiply(self.w.g, factors, out=self.room("inner", *self.w.g.shape)), np.ascontiguousarray((self.w.u * factors).reshape(n, 3, n).transpose(1, 0, 2))
        g, u = self.inner
        path = self.room("path", width + 1, lanes, n)
        path[0] = h
        before, hs, h = path[:-1], path[1:], path[0]
        rows = width if keep else 1
        gates, candidates, taken = self.room("gates", rows, 2, lanes, n), self.room("candidates", rows, lanes, n), self.room("taken", rows, lanes, n)
        gx, gh = self.room("gx", lanes, 3, n), self.room("gh", 2, lanes, n)
        of_gate = gx.transpose(1, 0, 2)
        symbols = np.ascontiguousarray(x.T)
        with np.errstate(over="ignore"):  # an infinite exponential is a gate of 0
            for t in range(width):
                k = t if keep else 0
                zr, c, ghn = gates[k], candidates[k], taken[k]
                np.take(g, symbols[t], axis=0, out=gx.reshape(lanes, 3 * n), mode="clip")  # with a mode, take writes straight into its place
                np.matmul(h, u[:2], out=gh)
                np.matmul(h, u[2], out=ghn)
                np.add(of_gate[:2], gh, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.divide(1, zr, out=zr)
                np.multiply(zr[1], ghn, out=c)
                c += of_gate[2]
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                new = hs[t]
                np.subtract(h, c, out=new)
                new *= zr[0]
                new += c
                h = new
        return hs, (gates, candidates, taken, before)

    @staticmethod
    def add_rows(to: np.ndarray, places: np.ndarray, rows: np.ndarray) -> None:
        """Add each of ``rows`` to the row of ``to`` that its place names.

        Rows of a frequent place are summed at once; of the others, the first
        of each place, then the second, and so on.
        """
        order = np.argsort(places.astype(np.uint16 if len(to) <= 1 << 16 else np.int64), kind="stable")  # small numbers are sorted by their digits
        places = places[order]
        start = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
        size = np.diff(np.r_[start, len(places)])
        often = size > OFTEN
        for lo, hi in zip(start[often].tolist(), (start + size)[often].tolist()):
            to[places[lo]] += np.add.reduce(np.take(rows, order[lo:hi], axis=0), 0)
        start, size = start[~often], size[~often]
        by_size = np.argsort(-size, kind="stable")
        start, size = start[by_size], size[by_size]
        total = np.take(rows, order[start], axis=0)
        for k in range(1, size[0] if len(size) else 0):
            m = np.searchsorted(-size, -k)  # places with more than k rows
            total[:m] += np.take(rows, order[start[:m] + k], axis=0)
        to[places[start]] += total

    def likelihood(self, hs: np.ndarray, y: np.ndarray, mask: np.ndarray, grads: Weights | None = None):
        """Natural log-probabilities (lanes, window) of ``y``; with ``grads``, instead what flows back into the states.

        Tokens are sorted by their class, and a block of them at a time meets
        the weights, classes down and tokens across: blocks stay in the cache.
        """
        w, lanes = self.w, mask.shape[0]
        at = np.flatnonzero(mask.T)
        target = y.T.reshape(-1)[at]
        order = np.argsort((target // PER_CLASS).astype(np.uint8 if SYMBOLS // PER_CLASS < 256 else np.uint16), kind="stable")  # small numbers are sorted by their digits
        at, target = at[order], target[order]
        n, (cls, word) = len(target), np.divmod(target, PER_CLASS)
        states, each = self.room("states", n, HIDDEN + 1), np.arange(BLOCK)
        states[:, HIDDEN] = 1
        states[:, :HIDDEN] = hs.reshape(-1, HIDDEN)[at]
        out, back = np.zeros(n, np.float32), None if grads is None else self.room("back", n, HIDDEN)

        def small(weights) -> bool:
            """Whether no logit can leave the range of exponentials: states lie between -1 and 1."""
            return bool(np.abs(weights).sum(1).max(initial=0) < SAFE)

        def softmax(weights, gradient, lo, hi, at, first, safe):
            x, place = states[lo:hi], (at[lo:hi], each[: hi - lo])
            logits = np.matmul(weights, x.T, out=self.room("logits", len(weights), hi - lo))
            if not safe:
                logits -= logits.max(0)
            out[lo:hi] += logits[place]
            np.exp(logits, out=logits)
            total = np.add.reduce(logits, 0)
            out[lo:hi] -= np.log(total)
            if gradient is not None:
                logits *= np.float32(1.0 / n) / total
                logits[place] -= np.float32(1.0 / n)
                gradient += logits @ x
                if first:
                    np.matmul(logits.T, weights[:, :HIDDEN], out=back[lo:hi])
                else:
                    back[lo:hi] += logits.T @ weights[:, :HIDDEN]

        safe = small(w.wc)
        for lo in range(0, n, BLOCK):
            softmax(w.wc, None if grads is None else grads.wc, lo, min(n, lo + BLOCK), cls, True, safe)
        safe = small(w.ww)
        edges = np.searchsorted(cls, np.arange(SYMBOLS // PER_CLASS + 1)).tolist()
        for k, (start, end) in enumerate(zip(edges, edges[1:])):
            part = slice(k * PER_CLASS, (k + 1) * PER_CLASS)
            for lo in range(start, end, BLOCK):
                softmax(w.ww[part], None if grads is None else grads.ww[part], lo, min(end, lo + BLOCK), word, False, safe)
        if grads is None:
            ll = np.zeros(mask.shape[::-1], np.float64)
            ll.reshape(-1)[at] = out
            return ll.T, None
        dhs = self.room("dhs", *hs.shape)
        if n < hs.shape[0] * lanes:
            dhs[:] = 0
        dhs.reshape(-1, HIDDEN)[at] = back
        return None, dhs

    def learn(self, x, y, mask, h, rate: float) -> np.ndarray:
        """One step of truncated backpropagation through the window; the state after it."""
        n = HIDDEN
        g = self.g = self.g or Weights()
        g.flat[:] = 0
        hs, (gates, c, taken, before) = self.states(x, h, True)
        _, dhs = self.likelihood(hs, y, mask, g)
        # What a change of the state after a step does to what the candidate takes, to both gates and to the candidate.
        dh, d_all = np.zeros_like(h), self.room("d all", 4, *hs.shape)
        through, some, other, passed = (self.room(name, *shape) for name, shape in (("through", h.shape), ("some", h.shape), ("other", h.shape), ("passed", (3, *h.shape))))
        back = np.ascontiguousarray(self.w.u.reshape(n, 3, n).transpose(1, 2, 0)[[2, 0, 1]])
        for t in range(len(hs) - 1, -1, -1):
            (z, r), ct, (to_taken, to_z, to_r, to_c) = gates[t], c[t], d_all[:, t]
            dh += dhs[t]
            np.subtract(1, z, out=some)
            np.multiply(dh, some, out=through)
            np.subtract(before[t], ct, out=some)
            some *= z
            np.multiply(some, through, out=to_z)
            np.multiply(ct, ct, out=some)
            some *= through
            np.subtract(through, some, out=to_c)
            np.multiply(to_c, r, out=to_taken)
            np.subtract(r, 1, out=other)
            other *= taken[t]
            other *= np.float32(0.5)
            np.multiply(to_taken, other, out=to_r)
            dh *= z
            np.matmul(d_all[:3, t], back, out=passed)
            for part in passed:
                dh += part
        inner = np.matmul(before.reshape(-1, n).T, d_all[:3].reshape(3, -1, n))
        g.u.reshape(n, 3, n)[:] += inner[[1, 2, 0]].transpose(1, 0, 2)
        rows = self.room("rows", *hs.shape[:2], 3, n)
        rows[:] = d_all[1:].transpose(1, 2, 0, 3)
        self.add_rows(g.g, x.T.reshape(-1), rows.reshape(-1, 3 * n))
        self.t += 1
        # In blocks, in place: the moments and the step of a block stay in the cache.
        grown = 1 / (1 - 0.99**self.t)
        size, least = np.float32(rate / (1 - 0.9**self.t) / grown**0.5), np.float32(1e-6 / grown**0.5)
        for lo in range(0, len(g.flat), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            d, m, v = g.flat[part], self.m[part], self.v[part]
            d *= np.float32(0.1)
            m *= np.float32(0.9)
            m += d
            d *= d  # a hundredth of the gradient's square
            v *= np.float32(0.99)
            v += d
            np.sqrt(v, out=d)
            d += least
            np.divide(m, d, out=d)
            d *= size
            self.w.flat[part] -= d
        self.inner = None
        return hs[-1]


def windows(docs: Iterator[tuple[object, np.ndarray]], lanes: int, start: int, width: int = WINDOW):
    """Documents side by side: ``(owners, x, y, mask, fresh, ended)`` of one window after the other.

    Each lane reads one document to its end, window by window, then the next;
    ``fresh`` marks lanes that begin one, ``ended`` those that end one.  ``x``
    is the symbol before ``y``; the first is ``start``.  When no document waits
    and lanes run dry, the rest, which is long documents, is read in windows as
    much wider, so that a window holds about as many tokens as with all lanes.
    """
    current: list[tuple | None] = [None] * lanes
    place, size, last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.full(lanes, start, np.int64)
    more = True
    while True:
        fresh = np.zeros(lanes, bool)
        for k in np.nonzero(place == size)[0].tolist() if more else ():
            current[k] = next(docs, None)
            if current[k] is None:
                more = False
                break
            place[k], size[k], last[k], fresh[k] = 0, len(current[k][1]), start, True
        left = size - place
        if not left.any():
            return
        # Half the lanes end within the window at the most.
        wide = width if more else max(width, min(width * (lanes // np.count_nonzero(left)), int(np.sort(left[left > 0])[np.count_nonzero(left) // 2])))
        n = np.minimum(left, wide)
        x, y = np.empty((lanes, wide), np.int64), np.zeros((lanes, wide), np.int64)
        for k, p, m in zip(range(lanes), place.tolist(), n.tolist()):
            if m:
                y[k, :m] = current[k][1][p : p + m]
        x[:, 0], x[:, 1:] = last, y[:, :-1]
        mask = np.arange(wide) < n[:, None]
        place += n
        last = y[np.arange(lanes), n - 1]
        ended = (n > 0) & (place == size)
        yield current, x, y, mask, fresh, ended
        for k in np.nonzero(ended)[0].tolist():
            current[k] = None


def longest_first(docs: Iterator[tuple[object, np.ndarray]], tokens: int = LANES * WINDOW * 100) -> Iterator[tuple[object, np.ndarray]]:
    """The same documents, sorted from long to short inside each stretch of so many tokens, so that lanes end together."""
    held, n = [], 0
    for d in docs:
        held.append(d)
        n += len(d[1])
        if n >= tokens:
            yield from sorted(held, key=lambda x: -len(x[1]))
            held, n = [], 0
    yield from sorted(held, key=lambda x: -len(x[1]))


class Lexicon:
    """Symbols and smoothed logarithms of the held words."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.rank = {w: i for i, w in enumerate(words)}
        self.n = len(words)
        self.log = np.log10(np.append(counts + ADDED, ADDED))
        tails = np.fromiter(map(tail_class, words), np.int64, len(words))
        self.symbol = np.append(np.where(np.arange(len(words)) < WORDS, np.arange(len(words)), WORDS + tails), 0)
        self.end = self.symbol[self.rank[END]] if END in self.rank else 0

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the words, ``n`` for those that are not held, and their symbols."""
        ranks = np.fromiter(map(self.rank.get, words, repeat(self.n)), np.int64, len(words))
        out = self.symbol[ranks]
        rare = np.nonzero(ranks == self.n)[0]
        out[rare] = [WORDS + tail_class(words[i]) for i in rare.tolist()]
        return ranks, out


_last: tuple = (None, None)


def lexicon_of(held) -> Lexicon:
    """The lexicon of a broadcast, built once in a worker."""
    global _last
    if _last[0] is not held.value:
        _last = (held.value, Lexicon(*held.value))
    return _last[1]


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over all texts of ``docs(text)``; the empty word counts the texts, each of which ends once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            for part in stretches(b.column(0)):
                words, ids, _ = split(part)
                held.append(pa.table({"word": words, "c": np.bincount(ids, minlength=len(words))}))
                if sum(map(len, held)) > COUNTED:
                    held = [added(held)]
                    if len(held[0]) > COUNTED // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from added(held).to_batches()

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """At most ``HELD`` words with their counts, from the most frequent on, in one order.

    A histogram over the leading binary digits of the counts, which has some
    hundred rows, gives the count from which on they are few enough, so each
    partition sends only words that are taken.
    """
    digits = F.greatest(F.lit(0), F.floor(F.log2(F.col("c"))) - 6)
    step = F.expr("shiftright(c, cast(d as int))")
    sizes = counts.withColumn("d", digits).groupBy("d", step.alias("s")).agg(F.count("*").alias("n")).collect()
    least, n = 1 << 62, 0
    for r in sorted(sizes, key=lambda r: -(r["s"] << r["d"])):
        n += r["n"]
        if n > HELD:
            break
        least = r["s"] << r["d"]
    top = sorted(((-t["c"], bytes(t["word"])) for t in counts.where(F.col("c") >= least).collect()))  # HELD rows at most
    return [w for _, w in top], np.array([-c for c, _ in top], np.float64)


def _averaged(rows: DataFrame) -> np.ndarray | None:
    """Mean of ``weights`` weighted by ``tokens``, in groups of at most 64 rows until one is left."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "weights"])  # sums in one order, however the rows arrive
        n = pdf["tokens"].to_numpy(np.float64)
        total = sum(np.frombuffer(w, np.float32) * np.float64(k) for w, k in zip(pdf["weights"], n))
        return pd.DataFrame({"weights": [(total / n.sum()).astype(np.float32).tobytes()], "tokens": [int(n.sum())]})

    rows = materialize(rows, "gru-weights")
    while (n := rows.count()) > 1:
        groups = -(-n // FAN_IN)
        rows = materialize(rows.withColumn("k", F.pmod(F.xxhash64("weights"), F.lit(groups))).groupBy("k").applyInPandas(mean, "weights binary, tokens long"), "gru-weights")
    last = rows.first()
    return None if last is None else np.frombuffer(last["weights"], np.float32).copy()


def symbols_in(value: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint16)


def encoded(rows: DataFrame, lexicon, log_mass: np.ndarray, floor: float) -> DataFrame:
    """Each of ``rows(doc_id, text, held_out)`` with its symbols, two bytes each, its counts and base score, and in ``score`` what words have inside their spellings; ``words`` and ``times`` are those that are not held, whose counts both scores lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon_of(lexicon)
        for b in batches:
            first = 0
            for part in stretches(b.column(2)):
                words, ids, stops = split(part)
                ranks, of_word = lex.look_up(words.to_pylist())
                starts, outside, rare = np.r_[0, stops[:-1]], of_word >= WORDS, ranks == lex.n
                logs = np.where(rare, 0.0, lex.log[ranks])
                inside = np.where(outside, logs - log_mass[np.maximum(of_word - WORDS, 0)], 0.0)
                n, known = stops - starts, np.add.reduceat((~rare)[ids], starts, dtype=np.int64)
                base, inside = np.add.reduceat(logs[ids], starts) - n * floor, np.add.reduceat(inside[ids], starts)
                at = np.flatnonzero(rare[ids])
                pairs, times = np.unique(np.searchsorted(stops, at, side="right") * len(words) + ids[at], return_counts=True)
                edges = pa.array(np.searchsorted(pairs, np.arange(len(part) + 1) * len(words)).astype(np.int32))
                unheld = pa.ListArray.from_arrays(edges, words.take(pa.array(pairs % len(words))))
                symbols = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.r_[0, stops * 2].astype(np.int32)), pa.py_buffer(of_word.astype(np.uint16)[ids])])
                times = pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int32)))
                ids_and_folds = [b.column(k).slice(first, len(part)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids_and_folds, pa.array(n), pa.array(known), pa.array(base), pa.array(inside), unheld, times, symbols], names=names)
                first += len(part)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<binary>, times array<int>, symbols binary"
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def trained(docs: DataFrame, lexicon, first: Weights) -> Weights:
    """Weights after one pass over ``docs(doc_id, symbols)``, in rounds of local training and averaging.

    Round ``r`` takes the documents whose hash says so, on every worker; all
    documents are read once in all.  A worker with little to read keeps fewer
    documents side by side, so that it makes as many steps.  A worker is a task:
    how the input is split into tasks, and the order of its rows, are part of
    the result, as the order is for any stochastic gradient.
    """
    spark, w = docs.sparkSession, first
    end = Lexicon(*lexicon.value).end
    for r, rate in enumerate(RATES):
        sent = spark.sparkContext.broadcast(w.flat)

        def run(batches: Iterator[pa.RecordBatch], rate=rate, sent=sent) -> Iterator[pa.RecordBatch]:
            model, tokens = Model(Weights(sent.value.copy())), 0
            source, ahead, waiting = ((None, symbols_in(s)) for b in batches for s in b.column(0)), [], 0
            while waiting < LANES * WINDOW * 100 and (d := next(source, None)) is not None:
                ahead.append(d)
                waiting += len(d[1])
            lanes = int(np.clip(waiting // (WINDOW * 100), 8, LANES))
            h = np.zeros((lanes, HIDDEN), np.float32)
            for _, x, y, mask, fresh, _ in windows(longest_first(chain(ahead, source)), lanes, end):
                h[fresh] = 0
                live = np.nonzero(mask[:, 0])[0]
                # A window that few lanes still fill moves the weights as much less.
                seen = int(mask.sum())
                h[live] = model.learn(x[live], y[live], mask[live], h[live], rate * min(1.0, 2.0 * seen / (lanes * WINDOW)))
                tokens += seen
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([model.w.flat.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], names=["weights", "tokens"])

        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(len(RATES))) == r).select("symbols")
        flat = _averaged(part.mapInArrow(run, "weights binary, tokens long"))
        w = w if flat is None else Weights(flat)
        sent.unpersist()
    return w


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learns from the rows whose CRC-32 of the id, as text, is not divisible by
    10; rows with a null id are held out.  A null text is an empty one, whose
    only token is its end.  Repeated rows are scored, and learned from, each by
    itself.  Without training rows all counts are 0 and the model is uniform.

    Counts cover all training tokens.  The ``HELD`` most frequent words go to
    every worker; the others are joined with their counts by word, and are so
    rare each that no key of that join is hot.
    """
    return result_only(docs.sparkSession, "gru-documents", lambda: _scored(docs, id_col, text_col))


def _scored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    rows = rows.withColumn("held_out", held_out)
    learn = rows.where(~F.col("held_out"))
    counts = materialize(word_counts(learn), "word-counts")
    stats = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, v_train = int(stats["n"]), int(stats["v"])
    words, top_counts = _most_frequent(counts)
    # Spelling classes: their mass outside the frequent words, with one more type for all unseen ones.
    tail = F.crc32(F.expr("substring(word, greatest(1, octet_length(word) - 1), 2)")) % TAILS
    mass = np.full(TAILS, ADDED)
    for t in counts.groupBy(tail.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mass[t["k"]] += t["c"] + ADDED * t["v"]
    for w, c in zip(words[:WORDS], top_counts):
        mass[tail_class(w)] -= c + ADDED
    mass = np.maximum(mass, ADDED)
    lexicon = spark.sparkContext.broadcast((words, top_counts))
    log_mass, floor = np.log10(mass), float(np.log10(n_train + ADDED * (v_train + 1)))
    coded = materialize(encoded(rows, lexicon, log_mass, floor).withColumn("row", F.monotonically_increasing_id()), "gru-symbols")
    model = trained(coded.where(~F.col("held_out")).select("doc_id", "symbols"), lexicon, Weights.fresh(top_counts[:WORDS], mass))
    sent, end = spark.sparkContext.broadcast(model.flat), Lexicon(words, top_counts).end
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    schema = pa.schema(list(zip(kept, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Model(Weights(sent.value))
        docs = ((row, symbols_in(s)) for b in batches for s, *row in zip(b.column(len(kept)), *(c.to_pylist() for c in b.columns[:-1])))

        def scored():
            h, total = np.zeros((SCORED_LANES, HIDDEN), np.float32), np.zeros(SCORED_LANES)
            for owners, x, y, mask, fresh, ended in windows(longest_first(docs), SCORED_LANES, end, SCORED_WINDOW):
                h[fresh], total[fresh] = 0, 0
                # Only lanes with a document are run: the last ones run dry at different times.
                live = np.nonzero(mask[:, 0])[0]
                hs, _ = net.states(x[live], h[live], False)
                total[live] += net.likelihood(hs, y[live], mask[live])[0].sum(1)
                h[live] = hs[-1]
                for k in np.nonzero(ended)[0]:
                    *row, inside = owners[k][0]
                    yield (*row, inside + total[k] / LN10)

        yield from in_batches(scored(), schema)

    out = coded.select(*kept, "symbols").mapInArrow(run, coded.select(*kept).schema)
    rare = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rare = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(ADDED))).alias("logs"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
    )
    out = out.join(rare, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0)) if n_train else F.lit(0).cast("long")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored by the recurrent model and by the smoothed unigram base."""
    return score_documents(table(spark, sf_dir, "documents"))
