"""The corpus operators against brute force, exact round trips and held-out accuracy."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from compare import same

from verdance.llm import bpe, gru, hnsw, jaccard, lines, packing, sharding, simhash, warc, weaklabels
from verdance.llm.queries import ORACLE_SQL, QUERIES
from verdance.shipping import ship
from verdance.storage import shared_dir

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, extra string"
WORDS = "the of and rivers mountains garden seed wild allele sample panel region stone water light tree".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "er", "ing", str(rng.randrange(99))]) for _ in range(n))


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def odd(spark):
    """Null columns, empty and blank texts, a very long one, ties, repeated rows, columns whose names clash."""
    rng = random.Random(4)
    long = prose(rng, 30_000)
    rows = [(1, None, "a", None), (2, "", None, "x"), (3, "  \n\t ", "b", "x"), (4, long, "c", "x"), (5, long, "d", "x"), (6, "one", "e", "x"), (7, "one", "f", "x"), (7, "one", "f", "x"), (None, "no id here", "g", "x"), (8, "Straße Ünïcode 中文 😀 tail", "h", "x")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, FOLDER), ORACLE_SQL[name], FOLDER)


# 1 WARC


def test_warc_round_trip(spark, tmp_path):
    big = "x<>é" * 60_000
    rows = [(1, "http://a", "<p>"), (2, None, None), (3, "u\r\nv", ""), (4, "b", big), (5, "b", big), (5, "b", big), (6, "c", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    chunks = warc.chunk_rows(pages, "page_id", "url", "html", 1000)
    folder = f"file://{tmp_path}/w"
    back = warc.read_warc(warc.write_warc(chunks, folder, roll_bytes=100), folder, 777)
    got = back.orderBy("id", "chunk_no").collect()
    last = [r for r in got if r.last]
    payload = {}
    for r in got:
        if r.record_type == "response":
            payload.setdefault(r.id, b"")
            payload[r.id] += bytes(r.chunk)
            assert len(r.chunk) <= 777 and r.bytes_so_far == len(payload[r.id])
            assert r.digest_so_far == base64.b32encode(hashlib.sha1(payload[r.id]).digest()).decode()
    assert payload == {1: b"<p>", 2: b"", 4: big.encode()}
    assert sorted((r.id, r.record_type, r.refers_to, r.bytes_so_far) for r in last) == [(1, "response", None, 3), (2, "response", None, 0), (3, "revisit", 2, 0), (4, "response", None, 300_000), (5, "revisit", 4, 300_000), (5, "revisit", 4, 300_000), (6, "revisit", 1, 3)]
    none = warc.chunk_rows(pages.where("false"), "page_id", "url", "html")
    assert warc.read_warc(warc.write_warc(none, folder), folder).count() == 0


def test_warc_odd_rows(spark, tmp_path):
    """Null ids, columns that are called like the operator's own, repeated rows."""
    rows = [(None, "u", "same", "x", 1), (3, "u", "same", "y", 2), (2, "u", "same", "z", 3), (None, "v", "alone", "x", 4), (None, "v", "alone", "x", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, chunk string, record int")
    folder = f"file://{tmp_path}/w"
    got = warc.read_warc(warc.write_warc(warc.chunk_rows(pages, "page_id", "url", "html", 3), folder), folder, 2).where("last").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r.id, r.record_type, r.refers_to, r.bytes_so_far) for r in got), key=key) == [(2, "response", None, 4), (3, "revisit", 2, 4), (None, "response", None, 5), (None, "response", None, 5), (None, "revisit", 2, 4)]


def test_warc_payloads_travel_in_chunks(spark, tmp_path):
    """A payload of 100 MB: no row behind the scan is larger than a chunk, and the Python workers stay small."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"page_id": pa.array([1], pa.int64()), "url": ["u"], "html": ["0123456789" * 10_000_000]}), f"{tmp_path}/p.parquet")
    pages = spark.read.parquet(f"{tmp_path}/p.parquet")
    chunks = warc.chunk_rows(pages, "page_id", "url", "html")
    assert chunks.selectExpr("max(octet_length(chunk))", "sum(octet_length(chunk))", "count(*)").first()[:] == (65536, 100_000_000, 1526)
    folder = f"file://{tmp_path}/w"
    back = warc.read_warc(warc.write_warc(chunks, folder), folder, with_chunks=False).where("last").first()
    assert (back.bytes_so_far, back.digest_so_far) == (100_000_000, base64.b32encode(hashlib.sha1(b"0123456789" * 10_000_000).digest()).decode())

    def most(batches):
        yield pa.RecordBatch.from_pydict({"batch": [b.nbytes for b in batches]})

    assert chunks.mapInArrow(most, "batch long").agg({"batch": "max"}).first()[0] < 72 << 20  # Spark's own bound of a batch, 64 MB, and not the record


# 2 BPE


def test_bpe_equals_the_library(spark, odd, empty):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(P.path(bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.BytePairCodec(ranks, P.PATTERN, most=200)
    rng = random.Random(1)
    texts = [prose(rng, 50), "a" * 3000, "".join(rng.choice("etaoin") for _ in range(5000)), "it's  we'll\n\n x\x1c\x85​　٢²"]
    texts += ["".join(rng.choice("ab \n\t  eéßł'sтЖ1२中文😀\x1c\x85　.,!-_" + chr(rng.randrange(32, 0x2FFF))) for _ in range(30)) for _ in range(300)]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()
    got = bpe.encode_decode(odd, P.path(bpe.RANKS), P.PATTERN, with_ids=True).collect()
    assert len(got) == 10
    for r, (i, t) in zip(got, [(x.doc_id, x.text) for x in odd.collect()]):
        assert r.id == i and np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(t or "")
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(empty, P.path(bpe.RANKS), P.PATTERN).count() == 0


# 3 embeddings


def brute_links(rows, t=0.93):
    links, parent = collections.Counter(), {i: i for i, _, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (i, li, v) in enumerate(rows):
        for j, lj, w in rows[k + 1 :]:
            if li is None or li != lj or v is None or w is None or len(v) != len(w) or None in v or None in w:
                continue
            a, b = np.asarray(v, float), np.asarray(w, float)
            if not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
                continue
            if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= t:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in parent}


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 150)
    monkeypatch.setattr(hnsw, "MOST_SHARD_ROWS", 150)
    monkeypatch.setattr(hnsw, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [(i, int(i % 2), (centres[i % 6] + rng.normal(size=16) * (0.02 + 0.3 * rng.random())).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, 0, rows[0][2]) for i in range(40)]  # copies
    rows += [(2000, None, rows[0][2]), (2001, 0, None), (2002, 0, [0.0] * 16), (2003, 0, [float("nan")] * 16), (2004, 0, rows[0][2][:8]), (2005, 0, [None] * 16), (2006, 0, [x * 1e30 for x in rows[0][2]]), (2007, 0, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(df).collect()}
    want = brute_links(rows)
    assert got.keys() == want.keys()
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}
    found, true = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert hnsw.RECALL * true <= found <= true
    assert hnsw.near_duplicates(df.where("false")).count() == 0


def test_links_come_from_the_graph(monkeypatch):
    """Also in shards that are smaller than a beam: without an audit that fails nothing is scanned."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 50, 90, 700):
        x = rng.normal(size=(n, 16))
        x[n // 2 :] = x[: n - n // 2] + 0.05 * rng.normal(size=(n - n // 2, 16))
        x /= np.linalg.norm(x, axis=1)[:, None]
        searches, search = [], hnsw.Graph.search
        monkeypatch.setattr(hnsw.Graph, "search", lambda self, q, ef: searches.append(ef) or search(self, q, ef))
        a, b = hnsw.linked(hnsw.Graph(x, np.arange(n)), x, x, 0.93, hnsw.EF)
        monkeypatch.undo()
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.93))}
        assert searches and len(want & set(zip(a.tolist(), b.tolist()))) >= hnsw.RECALL * len(want)


def test_embeddings_with_repeated_ids_and_clashing_columns(spark):
    v, w = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, 0, v, 5), (1, 0, v, 6), (2, 0, v, 5), (3, 0, w, 5), (None, 0, v, 5), (4, 1, v, 5), (5, 1, [1.0, 0.01, 0.1], 5), (6, 2, w, 5)]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, n_links int"), audit_log=None).collect()
    assert sorted((r.id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True)]


def test_recall_is_audited_over_the_whole_label(spark, monkeypatch):
    from pyspark import cloudpickle

    def lost(x, links, q, entry, ef):
        """A search that never leaves its entry."""
        ids, sims = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), -np.inf, np.float32)
        ids[:, 0], sims[:, 0] = entry, np.einsum("nd,nd->n", q, x[entry])
        return ids, sims

    rng = np.random.default_rng(8)
    base = rng.normal(size=(1900, 16))
    v = np.concatenate([base, base[:80] + 0.01 * rng.normal(size=(80, 16))])
    rows = [(i, k % 2, x.tolist()) for i, (k, x) in enumerate(zip([*range(1900), *range(80)], v))]
    rows += [(5000 + i, 2, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 16)))]
    rows += [(6000, 2, [x * 1.001 + 0.001 for x in rows[-300][2]])]  # a single link, which no audit may meet
    for name, value in (("SHARD_ROWS", 128), ("MOST_SHARD_ROWS", 128), ("BLOCK_ROWS", 64), ("beam", lost)):
        monkeypatch.setattr(hnsw, name, value)
    cloudpickle.register_pickle_by_value(hnsw)
    try:
        got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(hnsw)
    assert {r.id: (r.n_links, r.component_id) for r in got} == brute_links(rows)


def test_graph_search_finds_neighbours():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = hnsw.Graph(x, np.arange(1500))
    g = hnsw.Graph.restored(x, g.state())
    ids, _ = g.search(x[:200].astype(np.float32), 64)
    best = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, best)]) > 0.9


# 4 quality


def test_quality_on_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = weaklabels.quality(docs).select("doc_id", "kept", "score").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good.kept.mean() > 0.998 and bad.kept.mean() < 0.03


def plain_votes(text):
    """The labellers as loops over words."""
    words = text.split()
    n = len(words)
    letters = [sum(c.isalpha() for c in w) for w in words]
    symbols = [sum(not c.isalnum() and (c not in weaklabels._PLAIN or w.count(c) > 1 and c not in ".-'") for c in w) for w in words]
    upper, chars = sum(c.isupper() for w in words for c in w), sum(map(len, words))
    k = max(1, n // 100)
    firsts, seen = 0, set()
    for i, w in enumerate(words):
        if i and i * k // n != (i - 1) * k // n:
            seen = set()
        firsts += w not in seen
        seen.add(w)
    varied, short = firsts / n, sum(0 < x <= 3 for x in letters) / n
    repeats, top = sum(a == b for a, b in zip(words, words[1:])) / n, max(collections.Counter(words).values()) / n
    bad = [
        n >= 8 and repeats >= 0.2, n >= 8 and top >= 0.35, n >= 30 and varied <= 0.25, sum(letters) >= 20 and upper >= 0.5 * sum(letters), n >= 8 and sum("!!" in w for w in words) / n >= 0.2,
        n >= 8 and sum(symbols) >= 0.08 * chars, n >= 8 and sum(x > 0 for x in symbols) / n >= 0.3, n >= 8 and sum(x == 0 for x in letters) / n >= 0.25, n >= 30 and short <= 0.03,
    ]
    good = {2: n >= 30 and varied >= 0.55, 5: n >= 30 and sum(symbols) <= 0.01 * chars, 8: n >= 30 and 0.15 <= short <= 0.6}
    return "".join("b" if b else "g" if good.get(j) else "-" for j, b in enumerate(bad))


def plain_posterior(patterns):
    """Expectation maximisation, pattern by pattern and kind by kind."""
    n, two = len(weaklabels.LABELLERS), (2, 5, 8)
    kinds, belief = range(n + 1), {}
    for p in patterns:
        start = [float("b" not in p)] + [float(c == "b") for c in p]
        belief[p] = [x / sum(start) * 0.98 + 0.02 / (n + 1) for x in start]
    for _ in range(weaklabels.ROUNDS):
        mass = [sum(c * belief[p][k] for p, c in patterns.items()) for k in kinds]
        share = [(m + 1) / (sum(mass) + n + 1) for m in mass]
        has = lambda p, j: p[j] != "-" or j not in two
        rate = [[(sum(c * belief[p][k] for p, c in patterns.items() if p[j] == "b") + 0.05) / (sum(c * belief[p][k] for p, c in patterns.items() if has(p, j)) + 0.1) for j in range(n)] for k in kinds]
        for p in patterns:
            like = [share[k] * math.prod(rate[k][j] if p[j] == "b" else 1 - rate[k][j] for j in range(n) if has(p, j)) for k in kinds]
            belief[p] = [x / sum(like) for x in like]
    return {p: b[0] for p, b in belief.items()}


def test_quality_query_against_brute_force(spark):
    """Votes, posteriors and scores of the query, recomputed in plain loops; on this table every text is fitted on."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id", "text", "xxhash64(doc_id, text) as h").collect()
    got = {r.doc_id: r for r in QUERIES["op4_quality"](spark, FOLDER).collect()}
    texts = {r.doc_id: r.text for r in docs}
    votes = {i: plain_votes(t) for i, t in texts.items() if (t or "").split()}
    posterior = plain_posterior(collections.Counter(votes.values()))
    table = weaklabels.Words()
    features = {}
    for i in votes:
        words = texts[i].split()
        n, at = len(words), {w: table[w] for w in set(words)}
        facts = {w: table.facts[k] for w, k in at.items()}
        shape = collections.Counter(int(facts[w][6]) for w in words)
        kept = [(b, c / n) for b, c in shape.items()] + [(int(facts[w][7]), 0.3 * c / n) for w, c in collections.Counter(words).items()]
        extra = weaklabels.read_document(table.of(texts[i]), table.facts)[2][-7:]
        features[i] = [(b, float(np.float32(v))) for b, v in kept] + [(int(b), float(v)) for b, v in zip(weaklabels._EXTRA, extra)]
    w, g, bias, g_bias = collections.defaultdict(float), collections.defaultdict(lambda: 1e-2), 0.0, 1e-2
    sig = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    order = [r.doc_id for r in sorted((r for r in docs if r.doc_id in votes), key=lambda r: r.h)]
    for _ in range(weaklabels.EPOCHS):
        for i in order:
            err = sig(sum(w[b] * v for b, v in features[i]) + bias) - posterior[votes[i]]
            grad = [(b, err * v + weaklabels.DECAY * w[b]) for b, v in features[i]]
            for b, d in grad:
                g[b] += d * d
            for b, d in grad:
                w[b] -= weaklabels.RATE * d / math.sqrt(g[b])
            g_bias += err * err
            bias -= weaklabels.RATE * err / math.sqrt(g_bias)
    assert got.keys() == texts.keys()
    for i, r in got.items():
        if i not in votes:
            assert (r.votes, r.posterior, r.score, r.kept) == (None, None, 0.0, False)
            continue
        score = sig(sum(w[b] * v for b, v in features[i]) + bias)
        assert r.votes == votes[i] and abs(r.posterior - posterior[votes[i]]) < 1e-6 and abs(r.score - score) < 1e-3 and (r.kept == (score >= 0.5) or abs(score - 0.5) < 1e-3)


def test_quality_has_no_length_cap(spark):
    rng = random.Random(12)
    junk = " ".join(rng.choice(["buy", "cheap", "now", "here", "deal"]) for _ in range(60_000))
    ids = weaklabels.known_words().of(junk)
    assert weaklabels.read_document(ids, weaklabels.known_words().facts)[0][2] == "b"
    ids = weaklabels.known_words().of(" ".join(prose(rng, 100) for _ in range(300)))
    assert weaklabels.read_document(ids, weaklabels.known_words().facts)[0][2] == "g"  # prose of any length repeats its words, but not at once


def test_quality_edges(spark, odd, empty):
    clash = odd.withColumnRenamed("extra", "votes").withColumnRenamed("source", "kept")
    got = weaklabels.quality(clash).collect()
    assert len(got) == 10 and set(got[0].asDict()) == {"doc_id", "text", "votes", "posterior", "score", "kept"}
    assert all((r.score == 0.0) and not r.kept for r in got if not (r.text or "").split())
    own = weaklabels.quality(clash, prefix="_")
    assert sorted(map(str, own.select(*clash.columns).collect())) == sorted(map(str, clash.collect()))
    assert own.columns == [*clash.columns, "_votes", "_posterior", "_score", "_kept"]
    assert weaklabels.quality(empty).count() == 0
    assert weaklabels.label_model({})[0] == {}


def test_label_model_recovers_accuracies():
    rng = random.Random(2)
    n, counts, truth = len(weaklabels.LABELLERS), collections.Counter(), {}
    for _ in range(20_000):
        bad = rng.random() < 0.2
        kind = rng.randrange(3)
        votes = "".join("b" if rng.random() < (0.9 if bad and j % 3 == kind else 0.002) else "g" if weaklabels.TWO_SIDED[j] else "-" for j in range(n))
        counts[votes] += 1
        truth.setdefault(votes, []).append(bad)
    posterior, rates, share = weaklabels.label_model(counts)
    assert abs(share[0] - 0.8) < 0.02 and rates[0].max() < 0.02
    wrong = sum((posterior[v] < 0.5) != b for v, bs in truth.items() for b in bs)
    assert wrong < 0.01 * 20_000


# 5 lines


def brute_lines(rows, min_sites=lines.MIN_SITES, keep_whole_copies=False):
    """``(text, n_lines, n_removed)`` of each row ``(id, text, site)``."""
    cut = [None if t is None else t.split("\n") for _, t, _ in rows]
    own = [[x.strip(" \t\r\f\v") for x in c or []] for c in cut]
    sites, first, holders = collections.defaultdict(set), {}, collections.defaultdict(set)
    for (i, _, site), c in zip(rows, own):
        for x in c:
            sites[x].add(site or "")
            if i is not None:
                first[x] = min(first.get(x, i), i)
        holders[frozenset(c) - {""}].add(i)
    hot, out = {x for x in sites if x and len(sites[x]) >= min_sites}, []
    for (i, t, _), c, o in zip(rows, cut, own):
        solid = {x for x in o if x}
        stays = i is None or (keep_whole_copies and solid <= hot and len(holders[frozenset(solid)] - {None}) > 1)
        gone = [not stays and x in hot and i > first[x] for x in o]
        out.append((None if t is None else "\n".join(x for x, g in zip(c, gone) if not g), sum(map(bool, o)), sum(gone)))
    return out


@pytest.mark.parametrize("keep", [False, True])
def test_line_dedup(spark, odd, empty, keep):
    rng = random.Random(3)
    rows = [(i, f"own line {i}\n  All rights reserved. \nmore {i}", f"s{i}", "x") for i in range(8)]
    rows += [(20 + i, "whole copy\nsecond", f"s{i}", "x") for i in range(8)]
    rows += [(40 + i, f"five sites {i % 5}\nshared by five", f"s{i % 5}", "x") for i in range(20)]
    rows += [(60 + i, "menu\nterms", f"s{i}", "x") for i in range(7)] + [(70 + i, "menu\nterms\n" * 2 + f"own {i}", f"s{i}", "x") for i in range(3)] + [(75, "menu", "s1", "x")]
    # Repeated rows and equal ids with other texts, boilerplate in both.
    rows += [(5, "A\nB\nAll rights reserved.\nD\nE", "s1", "x"), (5, "All rights reserved.", "s2", "x"), (5, "A\nmenu", "s2", "x")]
    rows += [(90, "mine\nAll rights reserved.", "s3", "x")] * 3 + [(20, "whole copy\nsecond", "s9", "x"), (None, "menu\nterms", "s4", "x"), (None, "menu", None, "x")]
    rows += [(100 + i, "\n".join(rng.choice(["menu", "terms", "", " menu\t", f"x{rng.randrange(5)}", f"u{i}"]) for _ in range(rng.randrange(6))), f"s{rng.randrange(9)}", "x") for i in range(60)]
    rows += [tuple(r) for r in odd.collect()]
    got = sorted((r.doc_id is None, r.doc_id, str(r.text), r.n_lines, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS), keep_whole_copies=keep).collect())
    want = sorted((r[0] is None, r[0], str(t), n, k) for r, (t, n, k) in zip(rows, brute_lines([r[:3] for r in rows], keep_whole_copies=keep)))
    assert [str(x) for x in got] == [str(x) for x in want]
    clash = lines.dedup_lines(odd.withColumnRenamed("extra", "n_removed"), prefix="_")
    assert sorted(map(str, clash.select(*DOCS_NOW).collect())) == sorted(map(str, odd.withColumnRenamed("extra", "n_removed").select(*DOCS_NOW).collect()))
    assert lines.dedup_lines(empty, keep_whole_copies=keep).count() == 0


DOCS_NOW = ("doc_id", "text", "n_removed")


def test_line_query_on_repeated_rows(spark, odd, tmp_path):
    rows = [(i, f"own {i}\nfooter\nmore", f"s{i}", "x") for i in range(7)] + [(3, "own\nfooter", "s1", "x")] * 3 + [(4, "footer", "s2", "x"), (8, "footer\n\nx", None, "x")]
    spark.createDataFrame(rows, DOCS).union(odd.where("doc_id is not null")).write.parquet(f"{tmp_path}/documents.parquet")
    same(QUERIES["op5_line_dedup"](spark, str(tmp_path)), ORACLE_SQL["op5_line_dedup"], str(tmp_path))


# 6 sharding


def test_shards_are_contiguous_and_balanced(spark, odd, empty):
    rng = random.Random(9)
    rows = [(i * 3, rng.randrange(1, 500)) for i in range(5000)] + [(7, 20_000), (7, 20_000), (None, 5), (8, None)]
    got = sorted(sharding.shards_by_bytes(spark.createDataFrame(rows, "id long, size long"), "id", "size", 24).collect(), key=lambda r: (r.shard, r.slot))
    assert len(got) == len(rows)
    ids = [-1 if r.id is None else r.id for r in got]
    assert ids == sorted(ids)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all([r.slot for r in x] == list(range(len(x))) for x in by.values())
    share = sum(r.size for r in got) / 24
    assert all(abs(sum(r.size for r in x) - share) <= 20_000 for x in by.values()) and max(by) <= 23
    zero = sharding.shards_by_bytes(spark.createDataFrame([(1, 0), (2, None)], "id long, size long"), "id", "size", 5).collect()
    assert {r.shard for r in zero} == {0}
    assert sharding.shards_by_bytes(spark.createDataFrame([], "id long, size long"), "id", "size", 5).count() == 0


def test_shard_query_against_brute_force(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    sizes = [len(t.encode()) + 8 for _, t in docs]
    total, before, slots, want = sum(sizes), 0, collections.Counter(), {}
    for (i, t), size in zip(docs, sizes):
        shard = min(23, (before * 2 + size) * 24 // (2 * total))
        want[i] = (size, zlib.crc32(t.encode()), "bytes", shard, slots[shard], None)
        slots[shard] += 1
        before += size
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_sharding"](spark, FOLDER).collect()}
    assert got == want


# 7 language model


def test_language_model_base_and_gain(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    words, counts = {}, collections.Counter()
    for r in docs.collect():
        words[r.doc_id] = (r.text or "").encode().lower().split() + [b""]
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            counts.update(words[r.doc_id])
    n, v = sum(counts.values()), len(counts)
    floor = math.log10(n + 0.1 * (v + 1))
    got = QUERIES["op7_gru_lm"](spark, FOLDER).collect()
    for r in got:
        w = words[r.doc_id]
        assert abs(r.base_score - sum(math.log10(counts[x] + 0.1) - floor for x in w)) < 1e-6
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), n, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def plain_score(words, lex, w, counts, mass):
    """Log10 probability of one text, symbol by symbol in plain loops: no windows, no lanes, no blocks."""
    n, h, total = gru.HIDDEN, [0.0] * gru.HIDDEN, 0.0
    sig = lambda v: 1 / (1 + math.exp(-v))
    before = lex.end
    for word in words:
        g, u = w.g[before].tolist(), w.u.tolist()
        take = [sum(h[i] * u[i][j] for i in range(n)) for j in range(3 * n)]
        z, r = [sig(g[j] + take[j]) for j in range(n)], [sig(g[n + j] + take[n + j]) for j in range(n)]
        c = [math.tanh(g[2 * n + j] + r[j] * take[2 * n + j]) for j in range(n)]
        h = [c[j] + z[j] * (h[j] - c[j]) for j in range(n)]
        rank = lex.rank.get(word, gru.HELD)
        symbol = rank if rank < gru.WORDS else gru.WORDS + zlib.crc32(word[-2:]) % gru.TAILS
        k, m = divmod(symbol, gru.PER_CLASS)
        for rows, at in ((w.wc, k), (w.ww[k * gru.PER_CLASS : (k + 1) * gru.PER_CLASS], m)):
            logits = [sum(a * b for a, b in zip(row, h)) + row[-1] for row in rows.tolist()]
            most = max(logits)
            total += (logits[at] - most - math.log(sum(math.exp(x - most) for x in logits))) / math.log(10)
        if symbol >= gru.WORDS:
            total += math.log10(counts.get(word, 0) + gru.ADDED) - math.log10(mass[symbol - gru.WORDS])
        before = symbol
    return total


def test_scores_equal_a_plain_forward_pass(spark, monkeypatch):
    """Also of texts over several windows, of rare and unseen words, and of null and empty ones."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", "s", str(rng.randrange(3000))]) for _ in range(rng.choice([1, 7, 60, 200, 400])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "never seen 漢字 words ÀÉ"), (503, " ".join(["the"] * 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(gru, "HELD", 5000)
    kept, trained = {}, gru.trained

    def watched(docs, lexicon, first):
        kept["lex"], kept["w"] = gru.Lexicon(*lexicon.value), trained(docs, lexicon, first)
        return kept["w"]

    monkeypatch.setattr(gru, "trained", watched)
    got = {r.doc_id: r for r in gru.score_documents(df).collect()}
    split = {i: (t or "").encode().lower().split() + [b""] for i, t in rows}
    counts = collections.Counter(x for i, ws in split.items() if zlib.crc32(str(i).encode()) % 10 for x in ws)
    lex, mass = kept["lex"], [gru.ADDED] * gru.TAILS
    for x, c in counts.items():
        if lex.rank.get(x, gru.HELD) >= gru.WORDS:
            mass[zlib.crc32(x[-2:]) % gru.TAILS] += c + gru.ADDED
    assert got.keys() == split.keys()
    for i in [*range(0, 120, 6), 500, 501, 502, 503]:
        want = plain_score(split[i], lex, kept["w"], counts, mass)
        assert abs(got[i].score - want) < 1e-3 * (1 + abs(want)) ** 0.5, i


def test_language_model_edges(spark, odd, empty):
    got = gru.score_documents(odd).collect()
    assert len(got) == 10 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert gru.score_documents(empty).count() == 0


def test_every_training_token_is_learned_from(spark, monkeypatch):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, prose(rng, rng.choice([3, 40, 900]))) for i in range(300)], "doc_id long, text string")
    averaged, learned = gru._averaged, []

    def watched(rows):
        learned.append(sum(r.tokens for r in rows.collect()))
        return averaged(rows)

    monkeypatch.setattr(gru, "_averaged", watched)
    got = gru.score_documents(docs).first()
    assert sum(learned) == got.train_tokens


def test_rounds_of_learning_read_symbols_and_not_texts(spark, monkeypatch):
    """Texts are split once for counting and once for their symbols, however many rounds learn from them."""
    texts = [" \tThe  cat\x0bsat\r\n", "", None, "   ", "ÀÉ É\x85x \x1c\xa0y the THE", "a " * 500]
    kept, trained = {}, gru.trained

    def watched(docs, lexicon, first):
        kept["docs"], kept["lex"] = docs, gru.Lexicon(*lexicon.value)
        kept["rows"] = {r.doc_id: r.symbols for r in docs.collect()} if "symbols" in docs.columns else None
        return trained(docs, lexicon, first)

    monkeypatch.setattr(gru, "trained", watched)
    got = {r.doc_id: r for r in gru.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert "text" not in kept["docs"].columns
    for i, t in enumerate(texts):
        words = [*(t or "").encode().lower().split(), b""]
        assert got[i].n_tokens == len(words)
        if zlib.crc32(str(i).encode()) % 10:
            assert np.frombuffer(kept["rows"][i], np.uint16).tolist() == kept["lex"].look_up(words)[1].tolist()


def test_rows_of_a_place_are_added_up():
    rng = np.random.default_rng(2)
    places = np.r_[np.full(3 * gru.OFTEN, 7), rng.integers(0, 60, 300), 99]
    rows, got, want = rng.integers(-9, 9, (len(places), 6)).astype(np.float32), np.ones((100, 6), np.float32), np.ones((100, 6), np.float32)
    np.add.at(want, places, rows)
    gru.Model.add_rows(got, places, rows)
    assert (got == want).all()


def test_softmax_covers_half_of_the_tokens(spark):
    counts = gru.word_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("word <> ''").toPandas().c.sort_values(ascending=False)
    assert counts[: gru.WORDS].sum() > 0.5 * counts.sum() and gru.TAILS >= 64


def test_gru_windows_stay_full_when_lanes_run_dry():
    sizes = [900, 700, *[20] * 60]
    docs = [(k, np.arange(n) + 1000 * k) for k, n in enumerate(sizes)]
    seen, windows, most = {k: [] for k in range(len(docs))}, 0, 0
    for owners, x, y, mask, fresh, ended in gru.windows(iter(docs), 16, -1):
        windows, most = windows + 1, max(most, int(mask.sum()))
        for lane in np.nonzero(mask[:, 0])[0]:
            part, own = y[lane][mask[lane]], seen[owners[lane][0]]
            assert fresh[lane] == (not own) and x[lane, 0] == (own[-1] if own else -1) and (x[lane, 1 : len(part)] == part[:-1]).all()
            own.extend(part.tolist())
            assert ended[lane] == (len(own) == sizes[owners[lane][0]])
    assert all(seen[k] == d.tolist() for k, d in docs)  # each token once, in its document's order
    assert windows <= 12 and most <= 16 * gru.WINDOW * 2  # 29 windows of fixed width: the longest document's


def test_gru_likelihood_is_the_same_with_and_without_the_shift(monkeypatch):
    rng = np.random.default_rng(4)
    w = gru.Weights.fresh(np.arange(gru.WORDS, 0, -1.0), np.ones(gru.TAILS) * 50)
    y, mask = rng.integers(0, gru.SYMBOLS, (8, 6)), np.ones((8, 6), bool)
    hs = rng.uniform(-1, 1, (6, 8, gru.HIDDEN)).astype(np.float32)
    plain = gru.Model(w).likelihood(hs, y, mask)[0]
    monkeypatch.setattr(gru, "SAFE", 0.0)
    assert np.allclose(plain, gru.Model(w).likelihood(hs, y, mask)[0], atol=1e-4)
    w.ww *= 1e4  # beyond the range of exponentials
    monkeypatch.undo()
    assert np.isfinite(gru.Model(w).likelihood(hs, y, mask)[0]).all()


def test_gradient_is_that_of_the_likelihood(monkeypatch):
    rng = np.random.default_rng(0)
    w = gru.Weights.fresh(np.arange(gru.WORDS, 0, -1.0), np.ones(gru.TAILS) * 50)
    x, y = rng.integers(0, 40, (3, 5)), rng.integers(0, gru.WORDS + gru.TAILS, (3, 5))
    mask = np.ones((3, 5), bool)
    mask[2, 3:] = False
    h = np.zeros((3, gru.HIDDEN), np.float32)
    loss = lambda flat: -(m := gru.Model(gru.Weights(flat))).likelihood(m.states(x, h, False)[0], y, mask)[0].sum() / mask.sum()
    model = gru.Model(gru.Weights(w.flat.copy()))
    model.learn(x, y, mask, h, 0.0)
    grad = model.m / 0.1  # the first moment after one step
    for k in rng.choice(np.nonzero(np.abs(grad) > 1e-3)[0], 25):
        a, b = w.flat.copy(), w.flat.copy()
        a[k] += 2e-2
        b[k] -= 2e-2
        assert abs((loss(a) - loss(b)) / 4e-2 - grad[k]) < 0.05 * abs(grad[k]) + 2e-3


# 8 packing


def check_packing(pieces, docs, capacity=packing.CAPACITY):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    of, at = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        at[p.sequence_id].append(p)
    for i, text in docs:
        ids, start = t.encode(text or "", add_special_tokens=False).ids + [packing.END_ID], 0
        for p in sorted(of.pop(i), key=lambda p: p.start):
            part = np.asarray(ids[p.start : p.start + p.length], "<u4")
            assert p.start == start and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(part.tobytes())
            start += p.length
        assert start == len(ids)
    assert not of
    for group in at.values():
        end = 0
        for p in sorted(group, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end <= capacity
    return sum(p.length for p in pieces) / (capacity * len(at))


def test_packing_covers_all_tokens(spark, odd, empty):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert check_packing(QUERIES["op8_packing"](spark, FOLDER).collect(), [(r.doc_id, r.text) for r in docs.collect()]) > 0.99
    once = odd.dropDuplicates(["doc_id"])
    check_packing(packing.harmonic_pack(packing.pieces(once, P.path(packing.VOCABULARY))).collect(), [(r.doc_id, r.text) for r in once.collect()])
    assert packing.harmonic_pack(packing.pieces(empty, P.path(packing.VOCABULARY))).count() == 0


def test_chunks_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(P.path(packing.VOCABULARY)), packing.ChunkEncoder(P.path(packing.VOCABULARY), 300), random.Random(8)
    for _ in range(3000):
        y = "".join(rng.choice("ab \n\t  eéßł'sтЖ1२中文😀\x1c\x1f\x7f\x00\x85　.,!-_ΣİÅÅǅ²¼ªn̈<|endoftext|>''ll" + chr(rng.randrange(32, 0x300))) for _ in range(rng.randrange(40)))
        assert np.frombuffer(e(y), "<u4").tolist() == t.encode(y, add_special_tokens=False).ids


def test_cuts_fit_their_classes():
    for n in list(range(1, 9000, 7)) + [1, 4095, 4096, 4097]:
        cut = list(packing.cuts(n))
        assert sum(x for x, _ in cut) == n and all(x * k <= packing.CAPACITY for x, k in cut) and len(cut) <= n // packing.CAPACITY + 12


# 9 SimHash


def test_simhash_against_brute_force(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op9_simhash"](spark, FOLDER).collect()}
    prints = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for k, (i, t) in enumerate(docs):
        j, other = docs[(k + 1) % len(docs)]
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].near_next == 1 - (prints[i] ^ prints[j]).bit_count() / 64
        assert got[i].near_edited == 1 - (prints[i] ^ int(got[i].edited_fingerprint, 16)).bit_count() / 64
        if i % 20 == 0:
            assert got[i].n_near == sum((prints[i] ^ p).bit_count() <= simhash.RADIUS for p in prints.values()) - 1
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.1


def plain_fingerprint(text):
    """Votes of the same term hashes, term by term."""
    import xxhash

    words, votes = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w], [0] * 64
    for w, after in zip(words, [*words[1:], None]):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        h = h if after is None else xxhash.xxh64_intdigest(after.encode(), h)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b, v in enumerate(votes) if v > 0)


def test_fingerprints_equal_plain_votes(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op9_simhash"](spark, FOLDER).collect()}
    for k in range(0, len(docs), 7):
        (i, t), (_, after) = docs[k], docs[(k + 1) % len(docs)]
        half = len(t) // 2
        assert int(got[i].fingerprint, 16) == plain_fingerprint(t)
        assert int(got[i].edited_fingerprint, 16) == plain_fingerprint(t[: len(t) - half] + after[:half])


def check_next(spark, rows, buckets):
    got = simhash.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", buckets).collect()
    key = lambda i, t: (i is not None, i or 0, t)
    assert sorted(key(r.id, r.text) for r in got) == sorted(key(i, t or "") for i, t in rows)
    assert sorted(key(r.next_id, r.next_text) for r in got) == sorted(key(i, t or "") for i, t in rows)  # every row is the next of one
    order = sorted({i for i, _ in rows}, key=lambda i: key(i, ""))
    after = dict(zip(order, order[1:] + order[:1]))
    many = collections.Counter(i for i, _ in rows)
    assert all(r.next_id in (r.id, after[r.id]) for r in got)
    assert collections.Counter(r.id for r in got if r.next_id == after[r.id] and len(order) > 1) == ({i: 1 for i in order} if len(order) > 1 else {})
    assert sum(many.values()) == len(got)
    return collections.Counter(r.bucket for r in got)


def test_buckets_are_even_whatever_the_ids(spark):
    rng = random.Random(2)
    texts = [f"text {k}" for k in range(3000)]
    even = lambda sizes: max(sizes.values()) < 3 * 3000 / 16
    assert even(check_next(spark, [(k, t) for k, t in enumerate(texts[:-1])] + [(1 << 60, "far")], 16))
    assert even(check_next(spark, [(rng.randrange(-(1 << 62), 1 << 62), t) for t in texts], 16))
    assert even(check_next(spark, [(5 if k % 3 == 0 else None if k % 3 == 1 else k, t) for k, t in enumerate(texts)], 16))
    check_next(spark, [(1, "same")] * 40 + [(2, None), (2, ""), (None, "same"), (None, "same")], 16)


def test_simhash_edges(spark, odd, empty):
    rows = simhash.with_next(odd, "doc_id", "text", 8).collect()
    assert len(rows) == 10
    order = sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in odd.collect()))
    after = {}
    for a, b in zip(order, order[1:] + order[:1]):
        after.setdefault(a, []).append(b)
    for r in rows:
        key = (-1 if r.id is None else r.id, r.text)
        assert ((-1 if r.next_id is None else r.next_id), r.next_text) in after[key]
    fp = {r.id: r.fp for r in simhash.fingerprints(odd.where("doc_id < 7").selectExpr("doc_id as id", "text"), ["id"], "text", "fp").collect()}
    assert fp[1] == fp[2] == fp[3] == 0 and fp[4] == fp[5] and fp[6] != 0
    assert simhash.with_next(empty, "doc_id", "text", 8).count() == 0
    single = simhash.with_next(odd.where("doc_id = 8"), "doc_id", "text", 8).collect()
    assert [(r.id, r.next_id, r.next_text == r.text) for r in single] == [(8, 8, True)]


def test_votes_of_long_texts_are_exact(spark):
    text = " ".join(["a b"] * 50_000)
    one, two = (simhash.fingerprints(spark.createDataFrame([(1, t)], "id long, text string"), ["id"], "text", "fp").first().fp for t in (text, " ".join(["a b"] * 5_000)))
    assert one == two


# 10 Jaccard


def brute_components(docs, k, num, den):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        seen = collections.Counter()
        for s in sets[i]:
            seen.update(holders[s])
            holders[s].append(i)
        for j, common in seen.items():
            if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_equals_brute_force(spark, k, num):
    rng = random.Random(k)
    base, other = prose(rng, 150).split(), prose(rng, 60).split()
    docs = []
    for i in range(260):  # a large group of near copies with one to many edits, and chains
        w = list(base if i % 3 else other)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(60)}"
        docs.append((i, " ".join(w[: len(w) - rng.randrange(3)])))
    docs += [(300 + i, prose(rng, rng.randrange(0, 40))) for i in range(150)] + [(500 + i, t) for i, t in enumerate(["A b", "a  B", "", None, "a", "x y z", "X\ny\tz"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, size=k, num=num, den=100).collect()}
    assert got == brute_components(docs, k, num, 100)


def test_jaccard_keeps_no_table_that_is_read_no_more(spark, monkeypatch):
    """When pairs of different centres are compared, and later, whole sets of the leaders' pairs and tokens without a place are gone."""
    there, write = {}, jaccard.materialize

    def seen(df, label):
        out = write(df, label)
        folder = f"{shared_dir(spark)}/verdance/{spark.sparkContext.applicationId}".removeprefix("file:")
        there[label] = {name.rsplit("-", 1)[0] for name in os.listdir(folder)} - before
        return out

    folder = f"{shared_dir(spark)}/verdance/{spark.sparkContext.applicationId}".removeprefix("file:")
    before = {name.rsplit("-", 1)[0] for name in os.listdir(folder)} if os.path.isdir(folder) else set()
    monkeypatch.setattr(jaccard, "materialize", seen)
    QUERIES["op10_ngram_jaccard"](spark, FOLDER).count()
    assert "stars-sets" in there["stars-sets"] and "shared-tokens" in there["shared-tokens"]
    assert "shingle-prefixes" not in there["stars-sets"]
    assert not there["cross-pairs-asked"] & {"stars-sets", "stars-asked", "shared-tokens", "shingle-prefixes"}
    assert not there["followers"] & {"cross-pairs-sets", "placed-tokens"}


def test_jaccard_query_and_edges(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_ngram_jaccard"](spark, FOLDER).collect()}
    assert got == brute_components(docs, 3, 90, 100)
    rows = jaccard.jaccard_components(odd.withColumnRenamed("extra", "component_id")).collect()
    assert len(rows) == 10 and {r.id: r.component_id for r in rows} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, None: None, 8: 8}
    assert jaccard.jaccard_components(empty).count() == 0


def test_same_boilerplate_in_many_texts(spark):
    """Texts that are mostly one passage share its tokens without being alike; some are."""
    rng = random.Random(7)
    passage = prose(rng, 60).split()
    docs = [(i, " ".join(passage[: rng.choice([40, 50, 60])] + prose(rng, rng.choice([0, 2, 5, 9, 14, 30])).split())) for i in range(250)]
    for size, num in ((3, 90), (5, 80)):
        got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), size=size, num=num, den=100).collect()}
        assert got == brute_components(docs, size, num, 100)


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline
    from verdance.storage import materialize

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    kept = materialize(stage["quality_classifier"](spark, docs, FOLDER), "t")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and all(i in ids for i, q in label.items() if q == 1 and seen[i].split())
    assert sum(i in ids for i, q in label.items() if q == 0) <= 0.05 * sum(q == 0 for q in label.values())
    cleaned = materialize(stage["line_dedup"](spark, kept, FOLDER), "t")
    assert cleaned.columns == columns and {r.doc_id for r in cleaned.collect()} == ids and all(r.n_chars == len(r.text) for r in cleaned.collect())
    single = materialize(stage["ngram_jaccard"](spark, cleaned, FOLDER), "t")
    groups = brute_components([(r.doc_id, r.text) for r in cleaned.collect()], 5, 80, 100)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in groups.items() if i == c}
    assert check_packing(stage["packing"](spark, single, FOLDER).collect(), [(r.doc_id, r.text) for r in single.collect()]) > 0.99
