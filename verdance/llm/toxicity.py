"""Toxicity from two Kneser-Ney models of spelling, one of toxic and one of ordinary texts, that back off to the same shared counts."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdance.llm.common import in_batches, kept_in_worker, mixed, table
from verdance.storage import materialize

#: Symbols of an n-gram, and what is taken off each count.
ORDER, DISCOUNT = 6, 0.9
#: Labelled rows that are learned from, in expectation, and n-grams that a model holds at most.
FITTED, NGRAMS = 20_000, 250_000
#: How many of a text's most telling words are compared, beside the whole text, and the symbols that a word counts as at least.
TELLING, SHORTEST = (1, 2, 4, 8), 8.0
#: A document is called toxic from this score on.
TOXIC = 0.5
#: Words that a worker remembers, words that it counts before it hands them on, and texts that it looks up together.
REMEMBERED, COUNTED, TOGETHER = 300_000, 200_000, 64
#: Characters of a text that are read at once, and the longest run of letters that is read as one word.
PIECE, LONGEST = 1 << 20, 64
START, END = "\x02", "\x03"

_LETTERS = re.compile(r"[^\W\d_]+")


def spellings(token: str) -> list[str]:
    """The runs of letters of a token in lower case, cut after ``LONGEST`` letters each; none for a bare sign or number."""
    if token.isalpha() and len(token) <= LONGEST:
        return [token.lower()]
    return [run[i : i + LONGEST] for run in _LETTERS.findall(token.lower()) for i in range(0, len(run), LONGEST)]


def ngrams_of(word: str) -> list[str]:
    """One n-gram for each letter and the end of a word: the symbol after at most ``ORDER - 1`` earlier ones, of which the start is one."""
    s = START + word + END
    return [s[max(0, i + 1 - ORDER) : i + 1] for i in range(1, len(s))]


#: What the code points of an n-gram are multiplied with, by their place from the end; a context has the places of its n-gram.
_WEIGHTS = mixed(np.arange(1, ORDER + 1, dtype=np.uint64)) | np.uint64(1)


def hashed(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit keys of strings from the weighted sums of their code points."""
    return mixed(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _keys(texts: list[str], width: int) -> np.ndarray:
    """Keys of strings of at most ``width`` characters, right aligned."""
    flat = np.frombuffer("".join(t.rjust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return hashed(flat.reshape(len(texts), width).astype(np.uint64) @ _WEIGHTS[:width], np.fromiter(map(len, texts), np.int64, len(texts)))


class Models:
    """Both models as sorted arrays: the log-probability of each known n-gram in either, and the weight with which each known context backs off."""

    def __init__(self, keys, toxic, ordinary, contexts, back_toxic, back_ordinary, alphabet: int):
        at, c = np.argsort(keys), np.argsort(contexts)
        self.keys, self.logs = keys[at], np.stack([toxic[at], ordinary[at]]).astype(np.float32)
        self.contexts, self.back = contexts[c], np.stack([back_toxic[c], back_ordinary[c]]).astype(np.float32)
        self.floor = -float(np.log(alphabet + 1.0))

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of spellings, ``[model, word]``, and in a third row how many symbols they have."""
        out = np.zeros((3, len(words)))
        if not words:
            return out
        flat = np.frombuffer("".join("\0" * (ORDER - 2) + START + w + END for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = np.arange(len(owner)) + owner * (ORDER - 1)
        length = np.minimum(place + 2, ORDER)
        sums = np.zeros(len(owner), np.uint64)
        for j in range(ORDER):
            sums += flat[first + j] * _WEIGHTS[j]
        last = flat[first + ORDER - 1] * _WEIGHTS[-1]
        logs = np.zeros((2, len(owner)))
        left = np.arange(len(owner))
        while len(left):
            known, where = _find(self.keys, hashed(sums[left], length[left]))
            logs[:, left[known]] += self.logs[:, where[known]]
            left = left[~known]
            single = length[left] == 1
            logs[:, left[single]] += self.floor
            left = left[~single]
            seen, where = _find(self.contexts, hashed(sums[left] - last[left], length[left] - 1))
            logs[:, left[seen]] += self.back[:, where[seen]]
            gone = ORDER - length[left]
            sums[left] -= flat[first[left] + gone] * _WEIGHTS[gone]
            length[left] -= 1
        for m in range(2):
            out[m] = np.bincount(owner, logs[m], len(words))
        out[2] = sizes
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def fit_models(counts: pd.DataFrame) -> Models:
    """Models from ``(gram, toxic, ordinary)``: counts of the n-grams of :func:`ngrams_of` in either class.

    The shared model is interpolated Kneser-Ney over both classes together: the
    longest n-grams have their counts, shorter ones the number of symbols that
    they are known to follow.  A class takes ``DISCOUNT`` off its own counts of
    the longest n-grams and gives what that frees to the shared model; so an
    n-gram that a class has hardly met is about as likely in it as in the other.
    """
    d = DISCOUNT
    whole = counts[counts.toxic + counts.ordinary > 0].copy()
    whole["n"] = whole.toxic + whole.ordinary
    whole["context"], whole["size"] = whole.gram.str[:-1], whole.gram.str.len()
    # Shorter n-grams: how many symbols come before each; a whole n-gram that begins a word is one such symbol before what follows.
    levels, longer = [], whole[whole["size"] == ORDER].gram
    for size in range(ORDER - 1, 0, -1):
        level = longer.str[1:].value_counts().rename_axis("gram").rename("n").reset_index()
        levels.append(level)
        longer = pd.concat([level.gram, whole[whole["size"] == size].gram])
    shared: dict[str, float] = {"": 1.0 / (len(levels[-1]) + 1.0)}
    grams, logs, contexts, back = [], [], [], []
    for level in reversed(levels):
        level["context"] = level.gram.str[:-1]
        of = level.groupby("context").n.agg(["sum", "size"])
        total, types = level.context.map(of["sum"]).to_numpy(float), level.context.map(of["size"]).to_numpy(float)
        lower = np.array([shared[g[1:]] for g in level.gram])
        p = (level.n.to_numpy(float) - d + d * types * lower) / total
        shared.update(zip(level.gram, p.tolist()))
        grams += level.gram.tolist()
        logs.append(np.stack([np.log(p)] * 2))
        named = of[of.index != ""]
        contexts += named.index.tolist()
        back.append(np.stack([np.log(d * named["size"] / named["sum"])] * 2))
        if "" in of.index:
            unigram_rest = d * of["size"][""] / of["sum"][""] * shared[""]
    whole["t_types"], whole["o_types"] = whole.toxic > 0, whole.ordinary > 0
    of = whole.groupby("context").agg(n=("n", "sum"), types=("n", "size"), toxic=("toxic", "sum"), ordinary=("ordinary", "sum"), t_types=("t_types", "sum"), o_types=("o_types", "sum"))
    here = of.loc[whole.context]
    lower = np.array([shared[g[1:]] for g in whole.gram])
    p = (whole.n.to_numpy(float) - d + d * here.types.to_numpy() * lower) / here.n.to_numpy()
    own, rests = [], []
    for name, types in (("toxic", "t_types"), ("ordinary", "o_types")):
        n, c = here[name].to_numpy(float), whole[name].to_numpy(float)
        own.append(np.log(np.where(n > 0, (np.maximum(c - d, 0) + d * here[types].to_numpy() * p) / np.maximum(n, 1), p)))
        rests.append(np.log(d * of.types / of.n) + np.log(np.where(of[name] > 0, d * of[types] / np.maximum(of[name], 1), 1.0)))
    grams += whole.gram.tolist()
    logs.append(np.stack(own))
    contexts += of.index.tolist()
    back.append(np.stack(rests))
    # Anchored contexts are their own strings, so none of the lists names an n-gram or a context twice.
    logs, back = np.concatenate(logs, 1), np.concatenate(back, 1)
    out = Models(_keys(grams, ORDER), logs[0], logs[1], _keys(contexts, ORDER - 1), back[0], back[1], len(levels[-1]))
    out.floor = float(np.log(unigram_rest))
    return out


def pieces(text: str) -> Iterator[str]:
    """A text cut at white space into parts of about ``PIECE`` characters; one without white space stays whole."""
    lo = 0
    while len(text) - lo > PIECE:
        cut = re.compile(r"\s").search(text, lo + PIECE)
        if not cut:
            break
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:] if lo else text


class Reader:
    """Log-likelihoods of texts under both models, word by word; words are looked up once and remembered."""

    def __init__(self, models: Models):
        self.models, self.known = models, {}
        self.facts = np.zeros((3, 1024))

    def learn(self, tokens: set[str]) -> None:
        """Look up the tokens that are not known yet, all at once."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [t for t in tokens if t not in self.known]
        if not new:
            return
        parts = [spellings(t) for t in new]
        flat = [w for p in parts for w in p]
        words = sorted(set(flat))
        number = {w: i for i, w in enumerate(words)}
        of = self.models.words(words)
        owner = np.repeat(np.arange(len(new)), [len(p) for p in parts])
        values = of[:, [number[w] for w in flat]] if flat else np.zeros((3, 0))
        lo = len(self.known)
        while self.facts.shape[1] < lo + len(new):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)], 1)
        for m in range(3):
            self.facts[m, lo : lo + len(new)] = np.bincount(owner, values[m], len(new))
        self.known.update(zip(new, range(lo, lo + len(new))))

    def read(self, text: str | None) -> tuple[float, float, float, list[float]]:
        """Log-likelihoods under the toxic and the ordinary model, symbols, and the features: how much likelier a symbol is in toxic texts, over the whole text and over its most telling words."""
        total, best = np.zeros(3), np.zeros(TELLING[-1])
        for piece in pieces(text or ""):
            tokens = piece.split()
            if tokens:
                if not self.known.keys() >= (words := set(tokens)):
                    self.learn(words)
                f = self.facts[:, np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))]
                total += f.sum(1)
                best = np.concatenate([best, (f[0] - f[1]) / np.maximum(f[2], SHORTEST)])
                best = np.partition(best, len(best) - TELLING[-1])[-TELLING[-1] :]
        best = np.sort(best)[::-1]
        toxic, ordinary, symbols = total.tolist()
        return toxic, ordinary, symbols, [(toxic - ordinary) / max(symbols, 1.0), *[float(best[:k].mean()) for k in TELLING]]


def fit_scale(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights, the bias last, of a logistic curve through features ``x``; Newton's method with a small ridge."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3] * x.shape[1] + [1e-6])
        step = np.linalg.solve(h, a.T @ (y - p) - np.r_[1e-3 * w[:-1], 0.0])
        w += step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-8:
            break
    return w


class Fitted:
    """What scoring needs: the models and the weights of the features, or a share of toxic rows where nothing could be fitted."""

    def __init__(self, models: Models | None, weights: np.ndarray | None, share: float):
        self.models, self.weights, self.share = models, weights, share


def learned_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fitted: int) -> DataFrame:
    """``(text, toxic, fold)`` of the documents with a label: about ``fitted`` of them, chosen by the hash of the id.

    Labels without an id or a value, and ids that are labelled both ways, are
    left out.  Equal texts have the same fold.
    """
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    ids = materialize(ids.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other"), "toxicity-labels")
    bound = int(min(1.0, fitted / max(1, ids.count())) * (1 << 30))
    ids = F.broadcast(ids.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < bound))  # ``fitted`` rows of two numbers in expectation
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(ids, "id")
    return rows.select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"))


COUNTS = ("o0", "t0", "o1", "t1")


def ngram_counts(rows: DataFrame) -> DataFrame:
    """``(gram, o0, t0, o1, t1)``: the n-grams of all words in ordinary and toxic texts of either fold.

    Tasks add words up before they hand them on, words become n-grams once per
    distinct word, and both sums are Spark's.
    """
    sums = [F.sum(c).alias(c) for c in COUNTS]
    word_schema = pa.schema([("word", pa.string()), *[(c, pa.int64()) for c in COUNTS]])
    gram_schema = pa.schema([("gram", pa.string()), *[(c, pa.int64()) for c in COUNTS]])

    def add(held: dict[str, list[int]], key: str, counts: list[int]) -> None:
        have = held.get(key)
        if have is None:
            held[key] = list(counts)
        else:
            for k in range(4):
                have[k] += counts[k]

    def rows_of(held: dict[str, list[int]]) -> Iterator[tuple]:
        for key, counts in held.items():
            yield key, *counts

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic, fold in zip(b.column(0), b.column(1), b.column(2)):
                one = [0] * 4
                at = 2 * fold.as_py() + toxic.as_py()
                for piece in pieces(text.as_py() or ""):
                    for token, n in Counter(piece.split()).items():
                        one[at] = n
                        for word in spellings(token):
                            add(held, word, one)
                    if len(held) > COUNTED:
                        yield from in_batches(rows_of(held), word_schema)
                        held = {}
        yield from in_batches(rows_of(held), word_schema)

    def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        for b in batches:
            for word, *counts in zip(*(c.to_pylist() for c in b.columns)):
                for gram in ngrams_of(word):
                    add(held, gram, counts)
            if len(held) > COUNTED:
                yield from in_batches(rows_of(held), gram_schema)
                held = {}
        yield from in_batches(rows_of(held), gram_schema)

    numbers = ", ".join(f"{c} long" for c in COUNTS)
    words = rows.mapInArrow(count_words, f"word string, {numbers}").groupBy("word").agg(*sums)
    return words.mapInArrow(count_ngrams, f"gram string, {numbers}").groupBy("gram").agg(*sums)


def fit(rows: DataFrame, most: int = NGRAMS) -> Fitted:
    """Both models and the weights, from ``(text, toxic, fold)``.

    The models hold the ``most`` most frequent n-grams, whole ties only; rarer
    ones are left to the shared counts of shorter ones.  The weights are fitted
    on scores of rows that their own models have not seen: those of each fold
    by the models of the other.
    """
    spark = rows.sparkSession
    seen = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(seen.values())
    share = seen.get(1, 0) / total if total else 0.0
    if len(seen) < 2:
        return Fitted(None, None, share)
    counted = materialize(ngram_counts(rows).withColumn("n", F.expr(" + ".join(COUNTS))), "toxicity-ngrams")
    by_count = sorted(((r["k"], r["c"]) for r in counted.groupBy(F.least("n", F.lit(1000)).alias("k")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, held = 1001, 0
    for k, c in by_count:
        if held + c > most:
            break
        least, held = k, held + c
    grams = counted.where(F.col("n") >= least).drop("n").toPandas().sort_values("gram")  # ``most`` rows at most

    def models(folds: tuple[int, ...]) -> Models:
        part = pd.DataFrame({"gram": grams.gram, "toxic": sum(grams[f"t{k}"] for k in folds), "ordinary": sum(grams[f"o{k}"] for k in folds)})
        return fit_models(part)

    halves, key = [spark.sparkContext.broadcast(models((1 - k,))) for k in (0, 1)], uuid.uuid4().hex
    names = [f"f{k}" for k in range(len(TELLING) + 1)]
    schema = pa.schema([("toxic", pa.int32()), *[(n, pa.float64()) for n in names]])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = kept_in_worker(("toxicity", key), lambda: [Reader(h.value) for h in halves])

        def out() -> Iterator[tuple]:
            for b in batches:
                for text, toxic, fold in zip(b.column(0), b.column(1), b.column(2)):
                    yield toxic.as_py(), *readers[fold.as_py()].read(text.as_py())[3]

        yield from in_batches(out(), schema)

    table_ = rows.mapInArrow(judge, "toxic int, " + ", ".join(f"{n} double" for n in names)).toArrow()  # a few numbers for each learned row
    x = np.column_stack([table_.column(n).to_numpy() for n in names])
    order = np.lexsort(x.T)
    weights = fit_scale(x[order], table_.column("toxic").to_numpy()[order].astype(float))
    return Fitted(models((0, 1)), weights, share)


def score_texts(docs: DataFrame, fitted: Fitted, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all if None) with ``log_toxic``, ``log_ordinary`` (base e, whole text), ``symbols`` and ``score``.

    A null text and one without letters have no symbols and get the score of
    a text that nothing speaks for or against.  Columns of ``docs`` with the name of a result are replaced.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(fitted), uuid.uuid4().hex
    results = [T.StructField(n, T.DoubleType()) for n in ("log_toxic", "log_ordinary", "symbols", "score")]
    taken = {f.name for f in results}
    names = [c for c in (docs.columns if columns is None else columns) if c not in taken]
    rest = docs.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`") for c in names])
    fields = [T.StructField(f.name, f.dataType) for f in rest.schema.fields[1:]] + results

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        reader = kept_in_worker(("toxicity", key), lambda: Reader(model.models)) if model.models else None
        for whole in batches:
            for lo in range(0, whole.num_rows, TOGETHER):
                b, out = whole.slice(lo, TOGETHER), []
                texts = [t.as_py() or "" for t in b.column(0)]
                if reader:
                    reader.learn({t for text in texts if len(text) <= PIECE for t in text.split()})
                for text in texts:
                    if reader:
                        toxic, ordinary, symbols, x = reader.read(text)
                        z = float(np.dot(model.weights[:-1], x) + model.weights[-1])
                        out.append((toxic, ordinary, symbols, float(1.0 / (1.0 + np.exp(-min(30.0, max(-30.0, z)))))))
                    else:
                        out.append((0.0, 0.0, 0.0, model.share))
                added = [pa.array(c, pa.float64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *added], names=[f.name for f in fields])

    return rest.mapInArrow(run, T.StructType(fields))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fitted: int = FITTED, columns: list[str] | None = None) -> DataFrame:
    """All ``docs`` scored by models that learn from the labelled ones.

    ``labels`` has ``(id_col, label_col)``, 1 for toxic; only the labels given
    are learned from, by their texts alone.  Rows are judged one by one: equal
    texts get equal scores, repeated rows and null ids are rows of their own,
    and an empty table gives an empty result.  Without labels of both kinds
    the score is the share of toxic ones, 0 without any.
    """
    return score_texts(docs, fit(learned_rows(docs, labels, id_col, text_col, label_col, fitted)), text_col, columns)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from four fifths of the labels."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs, table(spark, sf_dir, "labels").where(remainder != 0), columns=["doc_id"])
    return out.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "log_toxic", "log_ordinary", "symbols")
