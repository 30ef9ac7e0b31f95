"""Text quality from overlapping heuristics: a label model by expectation maximisation and a hashed linear scorer."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdance.llm.common import kept_in_worker, table
from verdance.storage import materialize

BAD, GOOD, SILENT = "b", "g", "-"
#: Documents that the linear scorer is fitted on, in expectation; the label model sees all documents.
FITTED = 6000
#: Hashed features, passes over the fitted documents, step size, weight decay.
BUCKETS, EPOCHS, RATE, DECAY = 1 << 16, 6, 0.5, 1e-5
#: A document is kept from this probability of being good on.
KEEP = 0.5
ROUNDS = 50
#: Words of the windows in which distinct ones are counted, and records that a worker hands back at once.
WINDOW, OUT_ROWS = 100, 512
REMEMBERED = 150_000

_PLAIN = frozenset(".,;:!?'\"()-–—’‘“”«»…¿¡/%€$&")


class Words(dict):
    """Numbers for words, and a table of what the labellers need of each: a text is then a few array operations."""

    #: Columns: odd symbols, capitals, letters, characters, shortness, exclamation, bucket of the shape, bucket of the word.
    COLUMNS = 8

    def __init__(self):
        self.facts = np.zeros((1024, self.COLUMNS), np.int32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        letters = sum(c.isalpha() for c in word)
        symbols = sum(not c.isalnum() and (c not in _PLAIN or word.count(c) > 1 and c not in ".-'") for c in word)
        shape, last = "", ""
        for c in word:
            k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if k != last:
                shape += k
            last = k
        self.facts[at] = (symbols, sum(c.isupper() for c in word), letters, len(word), 0 < letters <= 3, "!!" in word, zlib.crc32(("s" + shape).encode()) % BUCKETS, zlib.crc32(("w" + word.lower()).encode()) % BUCKETS)
        self[word] = at
        return at

    def of(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words; they hold until the next call."""
        if len(self) > REMEMBERED:
            self.clear()
        words = (text or "").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def known_words() -> Words:
    """One table for all tasks of a worker."""
    return kept_in_worker(("words",), Words)


def _vote(bad: bool, good: bool = False) -> str:
    """A labeller speaks against a text, some also for one; that it finds no junk of its kind says little by itself."""
    return BAD if bad else GOOD if good else SILENT


#: The labellers, in the order of their votes.
LABELLERS = ("repeats", "top_word", "few_distinct", "shouting", "exclaims", "symbols", "symbol_words", "bare_tokens", "no_short_words")
#: Those that also speak for a text. Where they are silent, as on short texts, they have no opinion.
TWO_SIDED = np.array([name in ("few_distinct", "symbols", "no_short_words") for name in LABELLERS])


_EXTRA = np.array([zlib.crc32(k) % BUCKETS for k in (b"#repeats", b"#top", b"#upper", b"#symbols", b"#bare", b"#long", b"#exclaims")])


def distinct_in_windows(ids: np.ndarray, distinct: int) -> float:
    """Share of words that are the first of their kind in their window; a text is cut into equal windows of ``WINDOW`` words or, at its ends, up to twice as many."""
    n, k = len(ids), len(ids) // WINDOW
    if k < 2:
        return distinct / n
    return len(np.unique(np.arange(n) * k // n * (1 << 32) + ids)) / n


def read_document(ids: np.ndarray, facts: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Votes of all labellers on a text's words, and its hashed features with their values."""
    n = len(ids)
    if not n:
        return SILENT * len(LABELLERS), np.empty(0, np.int64), np.empty(0, np.float32)
    distinct, times = np.unique(ids, return_counts=True)
    rows = facts[distinct]
    symbols, upper, letters, chars = (times @ rows[:, :4]).tolist()
    short, exclaims = (times @ rows[:, 4:6] / n).tolist()
    odd, bare = float(times @ (rows[:, 0] > 0) / n), float(times @ (rows[:, 2] == 0) / n)
    repeats, top = float((ids[1:] == ids[:-1]).sum() / n), float(times.max() / n)
    varied = distinct_in_windows(ids, len(distinct))
    enough, long = n >= 8, n >= 30
    votes = [
        _vote(enough and repeats >= 0.2),
        _vote(enough and top >= 0.35),
        _vote(long and varied <= 0.25, long and varied >= 0.55),
        _vote(letters >= 20 and upper >= 0.5 * letters),
        _vote(enough and exclaims >= 0.2),
        _vote(enough and symbols >= 0.08 * chars, long and symbols <= 0.01 * chars),
        _vote(enough and odd >= 0.3),
        _vote(enough and bare >= 0.25),
        _vote(long and short <= 0.03, long and 0.15 <= short <= 0.6),
    ]
    shapes, where = np.unique(rows[:, 6], return_inverse=True)
    more = np.array([repeats, top, upper / max(1, letters), min(1.0, 5 * symbols / chars), bare, 1.0 - short, exclaims])
    value = np.concatenate([np.bincount(where, times) / n, 0.3 * times / n, 3.0 * more]).astype(np.float32)
    return "".join(votes), np.concatenate([shapes, rows[:, 7], _EXTRA]).astype(np.int64), value


def label_model(patterns: dict[str, int], rounds: int = ROUNDS) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern, how often each labeller objects by hidden kind, and the kinds' shares.

    A text is good or of one of several kinds of junk, one for each labeller to
    begin with, because labellers that look for one kind are silent on the
    others; two classes with independent labellers would take a rare kind for
    good.  Given the kind the labellers are independent.  The returned rates are
    ``[kind, labeller]``: how often a labeller objects, of the texts that it has
    an opinion on; the silence of one that only ever objects is an opinion.
    Row 0 are the false alarms on good texts, the others the hits on a kind of
    junk.  Expectation maximisation runs over the counts of patterns,
    which stand for all documents.  It starts from a plain reading of the
    votes: good where nobody objects, else one of the kinds that somebody
    objects to.
    """
    keys = sorted(patterns)
    n = len(LABELLERS)
    if not keys:
        return {}, np.zeros((n + 1, n)), np.zeros(n + 1)
    said = np.array([[c == BAD for c in k] for k in keys], np.float64)
    held = np.array([[c != SILENT for c in k] for k in keys], np.float64)
    held[:, ~TWO_SIDED] = 1.0
    weight = np.array([patterns[k] for k in keys], np.float64)
    belief = np.column_stack([said.sum(1) == 0, said])
    belief = belief / belief.sum(1, keepdims=True) * 0.98 + 0.02 / (n + 1)
    for _ in range(rounds):
        mass = weight @ belief
        share = (mass + 1.0) / (mass.sum() + n + 1.0)
        part = (belief * weight[:, None]).T
        rate = (part @ said + 0.05) / (part @ held + 0.1)
        log = np.log(share) + said @ np.log(rate).T + (held - said) @ np.log(1 - rate).T
        belief = np.exp(log - log.max(1, keepdims=True))
        belief /= belief.sum(1, keepdims=True)
    return dict(zip(keys, belief[:, 0].tolist())), rate, share


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> np.ndarray:
    """Weights, the bias last, of a logistic scorer for soft targets; AdaGrad over the rows in the given order."""
    w, g = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-2)
    for _ in range(EPOCHS):
        for (at, value), t in zip(rows, target):
            err = 1.0 / (1.0 + np.exp(-np.clip(w[at] @ value + w[-1], -30, 30))) - t
            grad = err * value + DECAY * w[at]
            np.add.at(g, at, grad * grad)
            np.add.at(w, at, -RATE * grad / np.sqrt(g[at]))
            g[-1] += err * err
            w[-1] -= RATE * err / np.sqrt(g[-1])
    return w


def scores(w: np.ndarray, at: np.ndarray, value: np.ndarray) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(w[at] @ value + w[-1], -30, 30))))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fitted: int = FITTED, keep: float = KEEP, columns: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``columns`` of ``docs`` (all if None) with ``votes``, ``posterior``, ``score`` and ``kept``, whose names begin with ``prefix``.

    ``posterior`` is the label model's probability of good for the row's
    votes, ``score`` the linear scorer's, ``kept`` whether it is at least
    ``keep``.  A null text and one without words get no votes and the score 0,
    and are not kept.  The label model's counts cover all rows; the scorer is
    fitted on the rows whose hash of id and text falls under a bound that lets
    ``fitted`` of them pass in expectation, whatever the corpus size, in the
    order of these hashes.  Rows with equal texts get equal scores; repeated
    rows, equal and null ids are rows of their own.  Without rows, or without a
    text, nothing is fitted and nothing is kept.  Columns of ``docs`` that have
    the name of a result are replaced.

    Texts are read once: votes and hashed features go to a table, from which
    the counts, the sample and then the scores are taken.
    """
    spark = docs.sparkSession
    results = [prefix + c for c in ("votes", "posterior", "score", "kept")]
    names = [c for c in (docs.columns if columns is None else columns) if c not in results]
    rest = docs.select(F.col(f"`{text_col}`").alias("__text"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("__hash"), *[F.col(f"`{c}`") for c in names])
    plain = [T.StructField(f.name, f.dataType) for f in rest.schema.fields[2:]]
    found = [T.StructField("__hash", T.LongType()), T.StructField("__votes", T.StringType()), T.StructField("__at", T.BinaryType()), T.StructField("__value", T.BinaryType())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known_words()
        for whole in batches:
            for lo in range(0, whole.num_rows, OUT_ROWS):
                b, out = whole.slice(lo, OUT_ROWS), []
                for t in b.column(0):
                    ids = words.of(t.as_py())
                    votes, at, value = read_document(ids, words.facts) if len(ids) else (None, None, None)
                    out.append((votes, None if at is None else at.astype(np.uint16).tobytes(), None if value is None else value.tobytes()))
                added = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*b.columns[2:], b.column(1), *added], names=[f.name for f in plain + found])

    rows = materialize(rest.mapInArrow(read, T.StructType(plain + found)), "quality-features")
    patterns = {r["v"]: r["n"] for r in rows.where("__votes is not null").groupBy(F.col("__votes").alias("v")).agg(F.count("*").alias("n")).collect()}  # at most 3 to the number of labellers
    posterior, _, _ = label_model(patterns)
    bound = min(1.0, fitted / max(1, sum(patterns.values())))
    chosen = rows.where(F.col("__votes").isNotNull() & (F.pmod("__hash", F.lit(1 << 30)) < int(bound * (1 << 30)))).select("__hash", "__votes", "__at", "__value")
    sample = sorted(chosen.toArrow().to_pylist(), key=lambda r: (r["__hash"], r["__at"], r["__value"]))  # ``fitted`` rows in expectation
    features = [(np.frombuffer(r["__at"], np.uint16), np.frombuffer(r["__value"], np.float32)) for r in sample]
    weights = fit_linear(features, np.array([posterior[r["__votes"]] for r in sample])) if sample else None
    sent = spark.sparkContext.broadcast((posterior, weights))
    judged = [T.StructField(results[0], T.StringType()), T.StructField(results[1], T.DoubleType()), T.StructField(results[2], T.DoubleType())]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, w = sent.value
        for b in batches:
            out = []
            for votes, at, value in zip(*b.columns[-3:]):
                if w is None or not votes.is_valid:
                    out.append((None, None, 0.0))
                else:
                    out.append((votes.as_py(), posterior[votes.as_py()], scores(w, np.frombuffer(at.as_buffer(), np.uint16), np.frombuffer(value.as_buffer(), np.float32))))
            if out:
                added = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], *added], names=[f.name for f in plain + judged])

    return rows.drop("__hash").mapInArrow(judge, T.StructType(plain + judged)).withColumn(results[3], F.col(f"`{results[2]}`") >= keep)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, label-model posterior, score and decision for every document."""
    return quality(table(spark, sf_dir, "documents"), columns=["doc_id"])
