"""Repeated ids: every row is a document of its own, in the operators and in the pipeline."""

import collections
import random

import numpy as np
import pytest

from verdance.llm import gru, hnsw, jaccard
from verdance.shipping import ship

WORDS = "the of and rivers mountains garden seed wild allele sample panel region stone water light tree".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n))


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def shingles(text, size):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(rows, size, num):
    """Per row, by brute force: the component's rows, as positions."""
    sets, at = [shingles(t, size) for _, t in rows], list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return [groups[root(i)] for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    a, b = prose(rng, 60), prose(rng, 60)
    # Verified cases: an id with texts of two groups links neither group with the other, and one like nothing stays.
    out = [(1, a), (2, b), (5, a + " q"), (5, b + " q"), (5, "wholly other words that are like no others at all"), (7, b + " x"), (9, "t u v"), (9, "t u v"), (9, "T u  v"), (None, a), (None, a), (11, None), (11, ""), (12, None)]
    for i in range(120):
        w = (a if i % 2 else b).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
        out.append((rng.randrange(40), " ".join(w)))
    return out + [(100, prose(rng, 30)), (100, prose(rng, 30))]


@pytest.mark.parametrize("size,num", [(3, 90), (5, 80)])
def test_components_by_row(spark, rows, size, num):
    got = collections.Counter((r.id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size=size, num=num, den=100).collect())
    want = collections.Counter()
    for (i, t), group in zip(rows, components(rows, size, num)):
        want[i, len(shingles(t, size)), None if i is None else min(rows[j][0] for j in group)] += 1
    assert got == want


def test_pipeline_removes_rows_not_ids(spark, rows):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard"]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component long".replace("component long", "component string"))
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    kept = collections.Counter((r.doc_id, r.text) for r in got.collect())
    groups = components(rows, 5, 80)
    wanted = [g for i, g in enumerate(groups) if g[0] == i]
    assert sum(kept.values()) == len(wanted)
    for group in wanted:
        first = min(rows[j][0] for j in group) if rows[group[0]][0] is not None else None
        assert sum(kept[r] for r in {rows[j] for j in group if rows[j][0] == first}) >= 1
    assert kept[5, "wholly other words that are like no others at all"] == 1 and kept[9, "t u v"] + kept[9, "T u  v"] == 1 and kept[None, rows[0][1]] == 2
    assert stage(spark, docs.where("false"), "").collect() == []


def test_links_of_vectors_that_share_an_id(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    rows = []
    for i in range(150):
        v = base[rng.integers(6)] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2, 0.5])
        rows.append((int(rng.integers(60)), int(rng.integers(2)), v.tolist()))
    rows += [(1, 0, base[0].tolist()), (1, 0, (base[0] * 2).tolist()), (1, 0, base[1].tolist()), (1, 1, base[0].tolist()), (None, 0, base[0].tolist())]
    unit = np.array([r[2] for r in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.93) & np.array([[a[1] == b[1] and None not in (a[0], b[0]) for b in rows] for a in rows]) & ~np.eye(len(rows), dtype=bool)
    at = list(range(len(rows)))
    for _ in rows:
        at = [min([at[i], *[at[j] for j in np.nonzero(linked[i])[0]]]) for i in range(len(rows))]
    want = collections.Counter()
    for i, (vec_id, _, _) in enumerate(rows):
        least = None if vec_id is None else min(rows[j][0] for j in range(len(rows)) if at[j] == at[i] and rows[j][0] is not None)
        want[vec_id, int(linked[i].sum()), least] += 1
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert collections.Counter((r.id, r.n_links, r.component_id) for r in got) == want


def test_nothing_is_known_without_training_rows(spark):
    out = gru.score_documents(spark.createDataFrame([(None, "a b c"), (None, None), (None, "")], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in out) == [(1, 0, 0), (1, 0, 0), (4, 0, 0)]
