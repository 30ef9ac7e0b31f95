"""Fill-in-middle and toxicity against brute force and held-out accuracy; the SQL of the first is run with the others'."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdance.llm import middle, toxicity
from verdance.llm.queries import QUERIES
from verdance.shipping import ship

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, form string, score string, n long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def odd(spark):
    """Null columns, blank, marked and very long texts, repeated rows, columns named like results."""
    rng = random.Random(6)
    long = "".join(rng.choice(["idiot", "é", "😀x", " ", "\n\t", "a", "<P", " "]) for _ in range(30_000))
    texts = [None, "", " ", " \n\t", "one", " one", "one ", "one two", "a<S>b c", "<M>", "Straße 中文 😀 tail x\r\n", long, long + " ", "x" * 20_000, " " * 20_000]
    rows = [(i, t, "s", "f", "z", 1) for i, t in enumerate(texts)] + [(3, "one", "s", "f", "z", 1), (None, "no id here at all", None, None, None, None)] * 2
    rows += [(1000 + i, " ".join(rng.choice(["ab", "c", "de"]) for _ in range(i)), "s", "f", "z", 2) for i in range(40)]
    return spark.createDataFrame(rows, DOCS)


def rearranged(doc_id, text):
    text = text or ""
    w = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:lo]), "".join(w[lo:hi]), "".join(w[hi:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(w), "plain", None, None, text
    if h4 % 100 < 80:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 7, 1000, middle.CHUNK])
def test_middle_is_brute_force(spark, odd, chunk):
    docs = odd if chunk > 7 else odd.where("text is null or length(text) < 200")
    out = middle.fill_in_middle(docs, chunk=chunk, columns=["doc_id", "source", "text", "form"])
    assert out.columns == ["doc_id", "source", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == rearranged(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_middle_of_nothing(spark):
    assert middle.fill_in_middle(spark.createDataFrame([], DOCS)).collect() == []


def plain_models(counts):
    """Interpolated Kneser-Ney as its definition reads, by dictionaries: a function of symbol and context for each class."""
    d, order = toxicity.DISCOUNT, toxicity.ORDER
    pooled = Counter({g: t + o for g, t, o in counts})
    kinds = {k: {g for g in pooled if len(g) == k} for k in range(1, order + 1)}
    for k in range(order - 1, 0, -1):
        kinds[k] = kinds[k] | {g[1:] for g in kinds[k + 1]}
    alphabet = {g[-1] for g in pooled}

    def shared_lower(context, symbol):
        """Probability after a context that begins inside a word, from numbers of symbols before."""
        follows = Counter()
        k = len(context) + 1
        for g in kinds[k + 1]:
            if g[1:-1] == context:
                follows[g[-1]] += 1
        lower = shared_lower(context[1:], symbol) if context else 1.0 / (len(alphabet) + 1)
        total = sum(follows.values())
        return (max(follows[symbol] - d, 0) + d * len(follows) * lower) / total if total else lower

    def probability(context, symbol, which):
        own, both = Counter(), Counter()
        for g, t, o in counts:
            if g[:-1] == context:
                both[g[-1]] += t + o
                own[g[-1]] += (t, o)[which]
        lower = shared_lower(context[1:], symbol)
        total = sum(both.values())
        if not total:
            return lower
        pool = (max(both[symbol] - d, 0) + d * len(both) * lower) / total
        n = sum(own.values())
        return (max(own[symbol] - d, 0) + d * sum(v > 0 for v in own.values()) * pool) / n if n else pool

    return probability


def test_models_are_plain_kneser_ney():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcü") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    held: dict[str, list[int]] = {}
    for k, w in enumerate(words):
        for g in toxicity.ngrams_of(w):
            held.setdefault(g, [0, 0])[k % 3 == 0] += 1 + k % 4
    counts = [(g, v[0], v[1]) for g, v in sorted(held.items())]
    models = toxicity.fit_models(pd.DataFrame(counts, columns=["gram", "toxic", "ordinary"]))
    probability = plain_models(counts)
    asked = [*words[:12], "abcabcabcabc", "zz", "aüz", "c"]
    got = models.words(asked)
    for i, w in enumerate(asked):
        assert got[2, i] == len(w) + 1
        for which in (0, 1):
            want = sum(np.log(probability(g[:-1], g[-1], which)) for g in toxicity.ngrams_of(w))
            assert got[which, i] == pytest.approx(want, abs=1e-3)


def test_ngram_counts_are_brute_force(spark, odd, monkeypatch):
    rows = odd.where("length(text) < 20000 or text is null").select("text", F.expr("cast(doc_id % 2 as int)").alias("toxic"), F.expr("cast(doc_id % 3 = 0 as int)").alias("fold")).where("toxic is not null")
    want = Counter()
    for text, toxic, fold in rows.collect():
        for token in (text or "").split():
            for w in toxicity.spellings(token):
                for g in toxicity.ngrams_of(w):
                    want[g, 2 * fold + toxic] += 1
    got = {(r.gram, k): r[c] for r in toxicity.ngram_counts(rows).collect() for k, c in enumerate(toxicity.COUNTS) if r[c]}
    assert got == dict(want)


def test_long_texts_are_read_whole(monkeypatch):
    models = toxicity.fit_models(pd.DataFrame({"gram": toxicity.ngrams_of("abc") + toxicity.ngrams_of("xyz"), "toxic": [0] * 4 + [9] * 4, "ordinary": [9] * 4 + [0] * 4}))
    text = "abc " * 500 + "xyz\n" + "abc " * 500
    whole = toxicity.Reader(models).read(text)
    monkeypatch.setattr(toxicity, "PIECE", 37)
    parts = toxicity.Reader(models).read(text)
    assert np.allclose(np.hstack(whole), np.hstack(parts)) and parts[2] == 1001 * 4 and parts[3][1] > 0


def test_held_out_toxic_documents_are_found(spark):
    out = QUERIES["op12_toxicity"](spark, "/root/testdata/sf0.1")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert out.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty() and out.count() == docs.count()
    rows = out.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r.predicted for r in held if r.toxic], [r.predicted for r in held if not r.toxic]
    # Most words that mark toxic texts are in English; the others are rare endings of ordinary beginnings.
    assert sum(toxic) >= 0.65 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(40)] + [(1004, 1), (None, 1), (1005, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(odd, labels)
    assert out.columns == ["doc_id", "text", "source", "form", "n", "log_toxic", "log_ordinary", "symbols", "score"]
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text or "", r.score) == r.score or not (r.text or "").strip()
    assert {r.score for r in rows if not (r.text or "").strip()} == {next(r.score for r in rows if r.text == "")}
    assert {r.score for r in toxicity.toxicity(odd, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(odd, labels.where("toxic > 5")).collect()} == {0.0}
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.toxicity(empty, labels).collect() == [] and toxicity.toxicity(empty, labels.limit(0)).collect() == []
