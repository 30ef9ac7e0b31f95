"""Near-duplicate embeddings by navigable small-world graphs, one per shard."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdance.llm.common import mixed, table
from verdance.operators.components import connected_components
from verdance.storage import materialize, result_only

#: Vectors of a shard, at least and at most, where a label has as many, and of a block of queries, in expectation.
SHARD_ROWS, MOST_SHARD_ROWS, BLOCK_ROWS = 8192, 65_536, 8192
#: Queries that meet a shard at once.
AT_ONCE = 1024
#: Links of a node on the upper layers and on the lowest; beams of build and first search.
M, M0, EF_BUILD, EF = 16, 32, 48, 48
#: Share of true links that audits must find; queries that a shard's audit takes, at first and where those met fewer than the least number of links.
RECALL, AUDITS, MORE_AUDITS, LEAST_TRUTHS = 0.995, 512, 8192, 20
THRESHOLD = 0.93


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all ``q`` at once: ids and similarities of the ``ef`` best seen, -1 where fewer."""
    n, deg = len(q), links.shape[1]
    ids, sims, done = np.full((n, ef), -1, np.int64), np.full((n, ef), -np.inf, np.float32), np.ones((n, ef), bool)
    seen = np.zeros((n, len(x)), bool)
    all_rows = np.arange(n)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("nd,nd->n", q, x[entry]), False
    seen[all_rows, entry] = True
    rows = all_rows
    while True:
        open_ = np.where(done[rows], -np.inf, sims[rows])
        best = open_.argmax(1)
        live = open_[np.arange(len(rows)), best] > -np.inf
        rows, best = rows[live], best[live]
        if not len(rows):
            return ids, sims
        near = links[ids[rows, best]]
        done[rows, best] = True
        new = near >= 0
        near = np.where(new, near, 0)
        new &= ~seen[rows[:, None], near]
        at = np.nonzero(new)
        seen[rows[at[0]], near[at]] = True
        sim = np.full((len(rows), deg), -np.inf, np.float32)
        sim[at] = np.einsum("kd,kd->k", q[rows[at[0]]], x[near[at]])
        all_sims = np.concatenate([sims[rows], sim], 1)
        keep = np.argpartition(-all_sims, ef - 1, 1)[:, :ef]
        sims[rows] = np.take_along_axis(all_sims, keep, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(new, near, -1)], 1), keep, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~new], 1), keep, 1)


def diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, up to ``most``: first those nearer to the row than to a better one taken, then the nearest others."""
    order = np.argsort(-sims, 1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    v = x[np.maximum(ids, 0)]
    among = np.einsum("nid,njd->nij", v, v)
    shadow = np.full(sims.shape, -np.inf, np.float32)
    taken, count = np.zeros(ids.shape, bool), np.zeros(len(ids), np.int64)
    for k in range(ids.shape[1]):
        ok = (ids[:, k] >= 0) & (count < most) & (sims[:, k] > shadow[:, k])
        taken[:, k] = ok
        count += ok
        shadow[ok] = np.maximum(shadow[ok], among[ok, k])
    rank = np.where(ids < 0, 3 * ids.shape[1], np.where(taken, 0, ids.shape[1]) + np.arange(ids.shape[1]))
    first = np.argsort(rank, 1, kind="stable")[:, :most]
    return np.take_along_axis(ids, first, 1)


class Graph:
    """Hierarchical navigable small world over unit vectors, built from the top layer down in blocks of growing size."""

    def __init__(self, x: np.ndarray, salt: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float32)
        u = (mixed(salt.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        self.level = np.minimum((-np.log(np.maximum(u, 1e-300)) / np.log(M)).astype(np.int64), 8)
        top = int(self.level.max())
        self.links = [np.full((len(x), M0 if k == 0 else M), -1, np.int64) for k in range(top + 1)]
        order = np.argsort(-self.level, kind="stable")
        self.entry = int(order[0])
        at = 1
        while at < len(order):
            size = min(256, max(1, at), len(order) - at)
            level = self.level[order[at]]
            block = order[at : at + size]
            block = block[self.level[block] == level]
            self._insert(block, int(level))
            at += len(block)

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        entry = np.full(len(q), self.entry)
        for k in range(len(self.links) - 1, to, -1):
            entry = beam(self.x, self.links[k], q, entry, 1)[0][:, 0]
        return entry

    def _insert(self, block: np.ndarray, level: int) -> None:
        q = self.x[block]
        entry = self._descend(q, level)
        for k in range(min(level, len(self.links) - 1), -1, -1):
            ids, sims = beam(self.x, self.links[k], q, entry, EF_BUILD)
            entry = ids[np.arange(len(block)), sims.argmax(1)]
            own = q @ q.T  # the block's vectors don't see each other in the graph yet
            np.fill_diagonal(own, -np.inf)
            most = min(M, len(block))
            near = np.argpartition(-own, most - 1, 1)[:, :most]
            own = np.take_along_axis(own, near, 1)
            ids = np.concatenate([ids, np.where(own > -np.inf, block[near], -1)], 1)
            sims = np.where(ids < 0, -np.inf, np.concatenate([sims, own], 1))
            chosen = diverse(self.x, ids, sims, M)
            self.links[k][block, :M] = chosen[:, :M]
            self._link_back(k, np.repeat(block, chosen.shape[1]), chosen.reshape(-1))

    def _link_back(self, k: int, source: np.ndarray, target: np.ndarray) -> None:
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        start = np.r_[0, np.nonzero(np.diff(target))[0] + 1] if len(target) else np.empty(0, np.int64)
        place = np.arange(len(target)) - np.repeat(start, np.diff(np.r_[start, len(target)]))
        for lo in range(0, int(place.max()) + 1 if len(place) else 0, M0):
            part = (place >= lo) & (place < lo + M0)
            nodes, where = np.unique(target[part], return_inverse=True)
            more = np.full((len(nodes), M0), -1, np.int64)
            more[where, place[part] - lo] = source[part]
            ids = np.concatenate([self.links[k][nodes], more], 1)
            order = np.argsort(ids, 1)
            ids = np.take_along_axis(ids, order, 1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids < 0, -np.inf, np.einsum("nd,nkd->nk", self.x[nodes], self.x[np.maximum(ids, 0)])).astype(np.float32)
            self.links[k][nodes] = diverse(self.x, ids, sims, self.links[k].shape[1])

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        return beam(self.x, self.links[0], q, self._descend(q, 0), ef)

    def state(self) -> bytes:
        shape = np.array([len(self.x), self.x.shape[1], len(self.links), self.entry], np.int64)
        return shape.tobytes() + b"".join(a.astype(np.int32).tobytes() for a in self.links)

    @classmethod
    def restored(cls, x: np.ndarray, state: bytes) -> Graph:
        self = cls.__new__(cls)
        self.x = np.ascontiguousarray(x, np.float32)
        n, _, layers, self.entry = np.frombuffer(state[:32], np.int64).tolist()
        at, self.links = 32, []
        for k in range(layers):
            w = M0 if k == 0 else M
            self.links.append(np.frombuffer(state, np.int32, n * w, at).reshape(n, w).astype(np.int64))
            at += 4 * n * w
        return self


def linked(graph: Graph, x: np.ndarray, q: np.ndarray, threshold: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(query, node)`` that the graph finds with a cosine of at least ``threshold`` in double precision.

    A query whose beam holds nothing but links is searched again with a
    doubled one, until it holds something else; where that beam would look at
    more neighbours than the shard has nodes, such a query meets all nodes
    instead, which is exact and costs less.  ``x`` and ``q`` are unit vectors
    in double precision.
    """
    q32, slack = q.astype(np.float32), threshold - 1e-4
    found_q, found_x, todo, wide = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.arange(len(q)), min(ef, len(x))
    while len(todo):
        ids, sims = graph.search(q32[todo], wide)
        full = (sims >= slack).all(1) & (wide < len(x))
        a, b = np.nonzero((sims >= slack) & ~full[:, None])
        a, b = todo[a], ids[a, b]
        good = np.einsum("nd,nd->n", q[a], x[b]) >= threshold
        found_q.append(a[good])
        found_x.append(b[good])
        todo, wide = todo[full], min(wide * 2, len(x))
        if wide * M0 >= len(x):
            a, b = scanned(x, q[todo], threshold)
            found_q.append(todo[a])
            found_x.append(b)
            break
    return np.concatenate(found_q), np.concatenate(found_x)


def scanned(x: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs by brute force."""
    return np.nonzero(q @ x.T >= threshold)


def _unit(packed: bytes, dim: int, dtype: str) -> np.ndarray:
    v = np.frombuffer(packed, dtype).reshape(-1, dim).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


def _forest(pairs: Iterator[tuple[int, int]], n: int) -> list[int]:
    parent = list(range(n))
    for a, b in pairs:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
    for a in range(n):
        parent[a] = parent[parent[a]]
    return parent


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, audit_log: str | None = None) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row: vectors of one label linked by cosine.

    ``n_links`` counts the other vectors linked directly, ``component_id`` is
    the smallest id that links reach and ``kept`` marks the row that has it.
    Null labels and vectors that are null, zero, or hold a null or non-finite
    component link with nothing, and so does a row with a null id, which has no
    component; vectors of different length do not link.  Other columns are not
    read; an empty table gives an empty result.

    Equal vectors are one node with a count, so copies are never expanded.
    The nodes of a label are dealt to shards, whose size grows with the square
    root of the label's up to a bound, so a hot label is many shards; each
    shard has a graph of its own, and every block of the label's nodes is a
    query to every shard.  Links come from the graphs.  In each shard a fixed
    number of queries is also scanned by brute force; these audits are pooled
    over the label, taken again with more queries if they met too few links,
    and the label is searched again with a doubled beam until the pooled recall
    is enough.  Only a label whose beam would hold a whole shard and whose
    audits still fail is scanned instead.  A task gives back counts and a spanning forest of the links it found, never
    the pairs.  Rows that repeat an id are vectors of their own: each has its
    own links and component, whose name is the smallest id in it.

    ``audit_log`` names a folder for the audits, a Parquet table ``(label, dim,
    beam, audits, hits, truths)``: one row per label and search.
    """
    return result_only(rows.sparkSession, "near-vectors", lambda: _near_duplicates(rows, id_col, vec_col, label_col, threshold, audit_log))


def _near_duplicates(rows: DataFrame, id_col: str, vec_col: str, label_col: str, threshold: float, audit_log: str | None) -> DataFrame:
    kind = next(f.dataType for f in rows.schema if f.name == vec_col)
    dtype = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("vec", pa.binary())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = []
            for label, v in zip(b.column(1).to_pylist(), b.column(2)):
                a = None
                if label is not None and v.is_valid and len(v) and not v.values.null_count:
                    a = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype)
                    a = a + a.dtype.type(0) if np.isfinite(a).all() and a.any() else None  # -0.0 becomes 0.0
                vecs.append(a)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([None if a is None else len(a) for a in vecs], pa.int32()), pa.array([None if a is None else a.tobytes() for a in vecs], pa.binary())], schema=schema
            )

    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("v"))
    plain = materialize(plain.mapInArrow(packed, "id long, label string, dim int, vec binary"), "vectors")
    nodes = plain.where("vec is not null and id is not null").groupBy("label", "dim", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # An id may come with several vectors, so nodes have numbers of their own.
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    counts = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    size = f"least({MOST_SHARD_ROWS}, greatest({SHARD_ROWS}, 32 * sqrt(n)))"
    counts = counts.selectExpr("label", "dim", "n", f"cast(ceil(n / {size}) as int) as shards", f"cast(ceil(n / {BLOCK_ROWS}) as int) as blocks")
    dealt = nodes.join(counts, ["label", "dim"]).withColumn("shard", F.expr("cast(pmod(xxhash64(rep), shards) as int)")).withColumn("block", F.expr("cast(pmod(xxhash64(rep, 1), blocks) as int)"))

    def pack(pdf: pd.DataFrame) -> tuple:
        pdf = pdf.sort_values("node")
        return pdf["node"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64), b"".join(pdf["vec"])

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, copies, vecs = pack(pdf)
        first = pdf.iloc[0]
        x = _unit(vecs, int(first["dim"]), dtype)
        row = (first["label"], int(first["dim"]), int(first["shard"]), int(first["blocks"]), int(first["n"]), ids.tobytes(), copies.tobytes(), vecs, Graph(x, ids).state())
        return pd.DataFrame([row], columns=["label", "dim", "shard", "blocks", "n", "ids", "copies", "vecs", "graph"])

    def blocked(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, _, vecs = pack(pdf)
        first = pdf.iloc[0]
        return pd.DataFrame([(first["label"], int(first["dim"]), int(first["block"]), int(first["shards"]), ids.tobytes(), vecs)], columns=["label", "dim", "block", "shards", "ids", "vecs"])

    index = materialize(dealt.groupBy("label", "dim", "shard").applyInPandas(built, "label string, dim int, shard int, blocks int, n long, ids binary, copies binary, vecs binary, graph binary"), "vector-graphs")
    queries = materialize(dealt.groupBy("label", "dim", "block").applyInPandas(blocked, "label string, dim int, block int, shards int, ids binary, vecs binary"), "vector-queries")

    columns = ["id", "links", "root", "label", "dim", "audits", "truths"]

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame([], columns=columns)
        a, b = left.iloc[0], right.iloc[0]
        dim, shard, ef = int(a["dim"]), int(a["shard"]), int(a["ef"])
        x, q = _unit(a["vecs"], dim, dtype), _unit(b["vecs"], dim, dtype)
        ids, copies, asked = np.frombuffer(a["ids"], np.int64), np.frombuffer(a["copies"], np.int64), np.frombuffer(b["ids"], np.int64)
        graph = Graph.restored(x, a["graph"])
        # Which queries are audited differs from shard to shard.
        luck = mixed(asked.view(np.uint64) + np.uint64(shard + 1) * np.uint64(0x9E3779B97F4A7C15)).astype(np.float64) / 2.0**64
        audited = luck * int(a["n"]) < int(a["wanted"])
        at, to, hits, truths = [], [], 0, 0
        for lo in range(0, len(asked), AT_ONCE):
            part, chosen = q[lo : lo + AT_ONCE], np.nonzero(audited[lo : lo + AT_ONCE])[0]
            scan = ef < 0
            i, j = scanned(x, part, threshold) if scan else linked(graph, x, part, threshold, ef)
            other = asked[lo + i] != ids[j]
            i, j = i[other], j[other]
            at.append(lo + i)
            to.append(j)
            if not scan and len(chosen):
                k, m = scanned(x, part[chosen], threshold)
                truths += int((asked[lo + chosen[k]] != ids[m]).sum())
                hits += int(np.isin(i, chosen).sum())  # what the graph found is verified, so it is among the truths
        at, to = np.concatenate(at), np.concatenate(to)
        links = np.bincount(at, copies[to], len(asked)).astype(np.int64)
        nodes, where = np.unique(np.concatenate([asked, ids]), return_inverse=True)
        root = np.asarray(_forest(zip(where[at].tolist(), where[len(asked) + to].tolist()), len(nodes)))
        moved = np.nonzero(root != np.arange(len(nodes)))[0]
        some = links > 0
        out = pd.DataFrame({"id": np.concatenate([asked[some], nodes[moved]]), "links": np.concatenate([links[some], np.zeros(len(moved), np.int64)]), "root": np.concatenate([asked[some], nodes[root[moved]]])})
        out = out.assign(label=a["label"], dim=dim, audits=0, truths=0)
        # The cell's audit is a row without an id, with the hits in the place of the links.
        return pd.concat([out, pd.DataFrame([(None, hits, None, a["label"], dim, int(audited.sum()) * (ef >= 0), truths)], columns=columns)]).astype({"id": "Int64", "root": "Int64"})

    key = ["label", "dim", "shard", "block"]
    todo, asks, done_links = index.withColumn("ef", F.lit(EF)).withColumn("wanted", F.lit(AUDITS)), queries, []
    while True:
        to_blocks = todo.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks").groupBy(*key)
        to_shards = asks.withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).drop("shards").groupBy(*key)
        part = materialize(to_blocks.cogroup(to_shards).applyInPandas(searched, "id long, links long, root long, label string, dim int, audits long, truths long"), "vector-links")
        # One beam serves all cells of a label, so their audits are one sample.
        audits = part.where("id is null").groupBy("label", "dim").agg(F.sum("links").alias("hits"), F.sum("truths").alias("truths"), F.sum("audits").alias("audits"))
        sizes = todo.groupBy("label", "dim").agg(F.max("n").alias("n"), F.count("*").alias("shards"), F.max("ef").alias("ef"), F.max("wanted").alias("wanted"))
        audits = materialize(audits.join(sizes, ["label", "dim"]), "vector-audits")
        if audit_log:
            audits.select("label", "dim", F.col("ef").alias("beam"), "audits", "hits", "truths").write.mode("append").parquet(audit_log)
        failed = F.col("hits") < RECALL * F.col("truths")
        few = (F.col("truths") < LEAST_TRUTHS) & (F.col("wanted") < F.least("n", F.lit(MORE_AUDITS)))
        # Too few links met: more audits with the same beam. Recall too low: a wider beam, and a scan where it would hold a whole shard.
        wider = F.when(F.col("ef") * 2 * F.col("shards") >= F.col("n"), F.lit(-1)).otherwise(F.col("ef") * 2)
        poor = audits.where((F.col("ef") >= 0) & (failed | few)).select("label", "dim", F.when(failed, wider).otherwise(F.col("ef")).alias("next_ef"), F.when(few, F.lit(MORE_AUDITS)).otherwise(F.col("wanted")).alias("next_wanted"))
        poor = materialize(poor, "vector-audits")
        part = part.where("id is not null")
        if poor.isEmpty():
            done_links.append(part)
            break
        done_links.append(part.join(poor, ["label", "dim"], "left_anti"))
        todo = todo.join(poor, ["label", "dim"]).drop("ef", "wanted").withColumnsRenamed({"next_ef": "ef", "next_wanted": "wanted"})
        asks = asks.join(poor.select("label", "dim"), ["label", "dim"])
    found = reduce(DataFrame.unionByName, [x.select("id", "links", "root") for x in done_links])
    links = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    comp = connected_components(found, "id", "root")
    done = nodes.join(links, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = done.groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("least"))
    done = done.join(least, F.col("component") == F.col("of")).select("label", "dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("least").alias("component"))
    # Rows that link with nothing never meet the join: they would be one hot key there.
    able = F.col("vec").isNotNull() & F.col("id").isNotNull()
    linked_rows = plain.where(able).join(done, ["label", "dim", "vec"]).select("id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    alone = plain.where(~able).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked_rows.unionByName(alone)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings``, linked at cosine 0.93 inside a label."""
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP3_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, e.y FROM r JOIN e ON e.x = r.reached),
    c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id)
    SELECT c.vec_id, (SELECT count(*) FROM e WHERE e.x = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c"""
