"""Exact similarity join of word shingle sets by adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdance.llm.common import in_batches, kept_in_worker, mixed, table
from verdance.operators.components import connected_components
from verdance.storage import drop_tables, materialize, recorded, result_only

#: Cells of the frequency sketch, in blocks that are merged independently.
CELLS, BLOCKS = 1 << 21, 64
#: Partial blocks that one task adds up at most.
FAN_IN = 128
#: Matches a prefix may ask for, and the cost of verifying a pair in units of a posting.
MOST_MATCHES, VERIFY_COST = 4, 32.0
#: Wanted classes that are sent to every worker at most: three numbers each, 12 MB.
BROADCAST_IDS = 500_000
#: Words whose hashes a worker remembers.
REMEMBERED = 250_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingler(size: int) -> Shingler:
    """One for all tasks of a worker."""
    return kept_in_worker(("shingles", size), lambda: Shingler(size))


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class Shingler:
    """Distinct hashed shingles of ``size`` words; a shorter text's whole sequence is its one shingle."""

    def __init__(self, size: int):
        self.size, self.known = size, _WordHashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted 64-bit hashes; empty without words. ASCII letters are lower-cased, ASCII white space separates."""
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(w))
        acc = np.full(len(w) - k + 1, np.uint64(k))
        for i in range(k):
            acc = mixed(acc * _ODD[0] + w[i : len(w) - k + 1 + i])
        return np.unique(acc)


def digest_of(shingles: np.ndarray) -> bytes:
    """What tells a shingle set from all others."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(CELLS - 1)).astype(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """One pass over all texts: a digest of each shingle set, and this task's counts of shingles per cell.

    Rows with ``kind`` 0 are documents ``(id, text_hash, n, digest)``; rows with ``kind``
    1 are blocks of the task's frequency sketch ``(id: the block, cells)``.
    """
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts, held = shingler(size), np.zeros(CELLS, np.int32), []

        def rows():
            nonlocal held
            for b in batches:
                for i, text, h in zip(b.column(0), b.column(1), b.column(2)):
                    s = shingles(text.as_py())
                    held.append(s)
                    if len(held) >= 512:
                        np.add(counts, np.bincount(_cell(np.concatenate(held)), minlength=CELLS), out=counts, casting="unsafe")
                        held = []
                    yield 0, i.as_py(), h.as_py(), len(s), digest_of(s) if len(s) else None, None
            if held:
                np.add(counts, np.bincount(_cell(np.concatenate(held)), minlength=CELLS), out=counts, casting="unsafe")

        yield from in_batches(rows(), schema)
        if counts.any():
            for k, block in enumerate(counts.reshape(BLOCKS, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((1, k, None, 0, None, np.minimum(block, 255).astype(np.uint8).tobytes()), schema)], schema=schema)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, "kind int, id long, text_hash long, n long, digest binary, cells binary")
    return materialize(out, "shingle-signatures")


def frequencies(sketch: DataFrame) -> np.ndarray:
    """The merged sketch as the base-2 logarithm of each cell's count, one byte for each: 2 MB whatever the corpus.

    A count-min sketch of one row over all documents.  Partial blocks are added
    up in groups of at most 128 until one of each is left; a task's share of a
    cell counts up to 255, so a cell that is hot everywhere stays far above the
    others.  It only orders tokens and estimates costs; no result depends on it.
    """

    def added(dtype):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(c, dtype).astype(np.uint32) for c in pdf["cells"])
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "cells": [total.tobytes()]})

        return run

    level = sketch.select(F.col("id").alias("block"), "cells")
    dtype, n = np.uint8, level.count() // BLOCKS
    while True:
        groups = max(1, -(-n // FAN_IN))
        level = level.withColumn("g", F.pmod(F.xxhash64("cells", F.monotonically_increasing_id()), F.lit(groups))).groupBy("block", "g").applyInPandas(added(dtype), "block long, cells binary")
        level, dtype, n = materialize(level, "shingle-sketch"), np.uint32, groups
        if groups == 1:
            break
    cells = np.zeros((BLOCKS, CELLS // BLOCKS), np.uint32)
    for row in level.collect():  # BLOCKS rows of fixed size
        cells[row["block"]] = np.frombuffer(row["cells"], np.uint32)
    return np.log2(1.0 + cells.reshape(-1)).astype(np.uint8)


def prefix_of(tokens: np.ndarray, logs: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The tokens of a set's adaptive prefix and the matches that it asks for.

    In the order (rarest cell, hash), which all sets share, two sets of at
    least the wanted similarity have ``l`` tokens in common among their first
    ``n - ceil(num / den * n) + l``.  ``l`` is chosen to make the estimated
    cost least: postings read, plus pairs verified, of which there are at most
    1/l of the postings.
    """
    n = len(tokens)
    need = -(-num * n // den)
    most = min(MOST_MATCHES, need)
    log = logs[_cell(tokens)]
    order = np.lexsort((tokens, log))[: n - need + most]
    others = np.exp2(log[order].astype(np.float64)) - 1.0
    postings = np.cumsum(others)[n - need :]
    cost = postings * (1.0 + VERIFY_COST / np.arange(1, most + 1)) + np.arange(most)
    matches = int(np.argmin(cost)) + 1
    return tokens[order[: n - need + matches]], matches


def prefixes(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int, logs: np.ndarray) -> DataFrame:
    """``(id, digest, n, matches, prefix)`` of all documents that have shingles."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(logs)  # CELLS bytes
    schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("matches", pa.int32()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, logs = shingler(size), held.value

        def rows():
            for b in batches:
                for i, text in zip(b.column(0), b.column(1)):
                    s = shingles(text.as_py())
                    if len(s):
                        p, matches = prefix_of(s, logs, num, den)
                        yield i.as_py(), digest_of(s), len(s), matches, p.view(np.int64)

        yield from in_batches(rows(), schema, 1024)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id long, digest binary, n long, matches int, prefix array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """``(id, tokens)`` of the classes whose number is in ``nodes``.

    ``classes`` are ``(node, rep, digest)``: a class is read from a document
    with the id ``rep`` whose shingles have the digest.  Few classes (their
    number is checked) go to every worker and texts stay where they are; more
    than ``BROADCAST_IDS`` meet the texts in a shuffle.
    """
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(size)

        def rows():
            for b in batches:
                for node, mark, text in zip(b.column(0), b.column(1), b.column(2)):
                    s = shingles(text.as_py())
                    # An id may come with several texts: each class takes its own.
                    if len(s) and int.from_bytes(digest_of(s)[:8], "big", signed=True) == mark.as_py():
                        yield node.as_py(), s.view(np.int64)

        yield from in_batches(rows(), schema, 256)

    mark = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    wanted = materialize(classes.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select("node", F.col("rep").alias("id"), mark.alias("mark")), "wanted-classes")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(wanted, "id").select("node", "mark", "text")
    return texts.mapInArrow(run, "id long, tokens array<long>").dropDuplicates(["id"])


def _compared(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int, label: str, classes: DataFrame, deltas: bool = False) -> DataFrame:
    """The pairs ``(x, y)`` with ``linked``, by exact intersection; with ``deltas`` also ``n_y`` and what ``y`` has more (``added``) and less (``lacking``) than ``x``."""
    with recorded() as made:
        pairs = materialize(pairs.select("x", "y"), f"{label}-asked")
        ids = pairs.select("x").union(pairs.select("y")).toDF("id").distinct()
        sets = materialize(shingle_sets(docs, id_col, text_col, size, ids, classes), f"{label}-sets")
    a = sets.select(F.col("id").alias("x"), F.col("tokens").alias("tx"))
    b = sets.select(F.col("id").alias("y"), F.col("tokens").alias("ty"))
    both = pairs.join(a, "x").join(b, "y").withColumn("common", F.size(F.array_intersect("tx", "ty")))
    linked = (F.col("common") * den >= (F.size("tx") + F.size("ty") - F.col("common")) * num).alias("linked")
    # Followers are near enough to their leader for their differences to be few.
    close = F.col("common") * den >= (F.size("tx") + F.size("ty") - F.col("common")) * max(0, 2 * num - den)
    more = [F.size("ty").alias("n_y"), F.array_except("ty", "tx").alias("added"), F.array_except("tx", "ty").alias("lacking"), close.alias("close")] if deltas else []
    out = materialize(both.select("x", "y", linked, *more), label)
    drop_tables(docs.sparkSession, made)  # whole shingle sets, which nothing reads again
    return out


def _alike(n1: Column, n2: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes can have the similarity."""
    return (n1 * den >= n2 * num) & (n2 * den >= n1 * num)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(id, n_shingles, component_id, text_hash, component)`` for each row of ``docs``: groups of texts linked by Jaccard similarity of at least ``num / den``.

    Sets are the distinct ``size``-word shingles.  Two documents are linked
    when ``den`` times the intersection reaches ``num`` times the union;
    ``component_id`` is the smallest id that links reach.  A null or wordless
    text has the empty set and is linked with nothing.  Rows are documents, also
    those that repeat an id: with the same text they get the same answer, with
    another text their own.  ``component`` numbers the components, of which two
    can have the same smallest id then; it is null where there are no links to
    speak of: without words, and for a null id, which is a document of its own.
    ``text_hash`` is ``xxhash64`` of the text.

    The join is exact, and no group is expanded into pairs:

    1. Equal sets are one class with one representative.
    2. Each representative is compared with one leader, the holder of its
       prefix tokens that shares most; components of these links swallow the
       large groups of near copies at linear cost.
    3. Representatives of different components and different leaders that share
       as many prefix tokens as the pair's smaller demand are verified; a shared
       token counts only where its places leave room for the rest of the needed
       overlap.
    4. Those of one leader that is not linked with one of them can only be
       linked if they share a difference from the leader; such pairs are
       decided by the number of differences they share.
    """
    return result_only(docs.sparkSession, "jaccard-components", lambda: _components(docs, id_col, text_col, size, num, den))


def _components(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    sig = signatures(docs, id_col, text_col, size)
    plain = sig.where("kind = 0").select("id", "text_hash", "n", "digest")
    # Equal sets are one class: from here on ``id`` is the number of a class, and documents are found again by ``rep`` and digest.
    reps = plain.where("id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id())
    reps = materialize(reps, "shingle-classes")
    spark = docs.sparkSession
    with recorded() as sketches:
        logs = frequencies(sig.where("kind = 1"))
    drop_tables(spark, sketches)
    held = prefixes(docs, id_col, text_col, size, num, den, logs).join(reps.withColumnRenamed("rep", "id"), ["id", "digest"]).dropDuplicates(["id", "digest"]).select(F.col("node").alias("id"), "n", "matches", "prefix")
    with recorded() as sets:
        held = materialize(held, "shingle-prefixes")
    # ``room``: how many tokens of the set come after this one.
    posts = held.select("id", "n", "matches", F.posexplode("prefix").alias("at", "token")).select("id", "n", "matches", "token", (F.col("n") - F.col("at") - 1).alias("room"))

    # Sets can only be alike if their sizes are, so holders of a token meet by token and size band; alike sizes are in the same band or next to it.
    band = F.floor(F.log("n") / F.log(F.lit(den / num))).cast("int")
    shared = posts.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    with recorded() as tokens:
        shared = materialize(posts.join(shared, "token").withColumn("band", band), "shared-tokens")

    # A token's leader is the holder whose prefix is shared most: a text that others were copied from, if there is one.
    fame = shared.groupBy("id").agg(F.count("*").alias("met"), F.sum(F.least("holders", F.lit(1 << 20))).alias("meets"))
    fame = fame.join(held.select("id", F.size("prefix").alias("p")), "id").select("id", F.struct((F.col("met") / F.col("p")).alias("share"), "meets", (-F.col("id")).alias("first")).alias("fame"))
    leaders = shared.join(fame, "id").groupBy("token", "band").agg(F.max_by(F.struct("id", "n", "matches"), "fame").alias("l")).select("token", "band", F.col("l.id").alias("leader"), F.col("l.n").alias("n_leader"), F.col("l.matches").alias("m_leader"))
    reach = leaders.select("token", "leader", "n_leader", "m_leader", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    led = shared.join(reach, ["token", "band"]).where("id <> leader").groupBy("id", "n", "leader", "n_leader", F.least("matches", "m_leader").alias("want")).agg(F.count("*").alias("common"))
    # One leader for each: what this round leaves out the next one decides.
    led = led.where(_alike(F.col("n"), F.col("n_leader"), num, den) & (F.col("common") >= F.col("want")))
    stars = led.groupBy("id").agg(F.max_by("leader", F.struct("common", -F.col("leader"))).alias("leader"))
    stars = materialize(stars.select(F.col("leader").alias("x"), F.col("id").alias("y")), "leader-pairs")
    drop_tables(spark, sets)
    stars = _compared(stars, docs, id_col, text_col, size, num, den, "stars", reps, deltas=True)
    comp = connected_components(stars.where("linked"), "x", "y")
    home = comp.withColumnRenamed("node", "id")
    around = stars.where("close").select(F.col("y").alias("id"), F.col("x").alias("center"))
    placed = shared.join(home, "id", "left").join(around, "id", "left")
    # A leader that follows nobody is the centre of its own followers, and so is anyone else of none.
    with recorded() as places:
        placed = materialize(placed.select("id", "n", "matches", "token", "room", "band", F.coalesce("component", "id").alias("comp"), F.coalesce("center", "id").alias("center")), "placed-tokens")
    drop_tables(spark, tokens)

    # Different centres: by shared prefix tokens, first centre by centre, so that one centre's followers never meet each other here.
    # Linked sets share at least o = num / (num + den) * (n1 + n2) tokens, of which all but ``want`` come after each of the first ``want``
    # in both orders: a token counts for a pair only if o <= room + want on either side, and a pair of centres only if enough tokens do.
    wide = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("center").alias("c_lo"), F.max("center").alias("c_hi")).where("lo <> hi and c_lo <> c_hi").select("token")
    met = placed.join(wide, "token", "left_semi")
    far = F.max(F.col("room") + F.col("matches")).alias("far")
    spots = met.groupBy("token", "band", "center").agg(F.min("n").alias("least"), F.max("n").alias("most"), far, F.min("matches").alias("want"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    side = lambda df, v, *names: df.select("token", *[F.col(c).alias(c + v) for c in ("center", "band", *names)])
    spot = ("least", "most", "far", "want", "lo", "hi")
    near_bands = side(spots, "_a", *spot).withColumn("band_b", F.explode(F.array(F.col("band_a"), F.col("band_a") + 1)))
    apart = (F.col("center_a") != F.col("center_b")) & ((F.col("band_a") != F.col("band_b")) | (F.col("center_a") < F.col("center_b"))) & ~((F.col("lo_a") == F.col("hi_b")) & (F.col("hi_a") == F.col("lo_b")))

    def meets(x: str, y: str, least_x: str, most_x: str, least_y: str, most_y: str, room: Column) -> Column:
        """Whether sets with sizes in these ranges and a token that has so much room can be alike."""
        n = F.col(least_x + x) + F.col(least_y + y)
        return (F.col(least_x + x) * num <= F.col(most_y + y) * den) & (F.col(least_y + y) * num <= F.col(most_x + x) * den) & (n * num <= room * (num + den))

    pairs_of = near_bands.join(side(spots, "_b", *spot), ["token", "band_b"]).where(apart & meets("_a", "_b", "least", "most", "least", "most", F.least("far_a", "far_b")))
    both_sides = Window.partitionBy("center_a", "band_a", "center_b", "band_b")
    pairs_of = pairs_of.withColumn("shared", F.count("*").over(both_sides)).withColumn("want", F.min(F.least("want_a", "want_b")).over(both_sides)).where("shared >= want")
    pairs_of = pairs_of.select("token", "center_a", "band_a", "center_b", "band_b", "least_b", "most_b", "far_b")
    member = ("id", "n", "matches", "room", "comp")
    one = side(met, "_a", *member)
    cross = pairs_of.join(one, ["token", "center_a", "band_a"]).where(meets("_a", "_b", "n", "n", "least", "most", F.least(F.col("room_a") + F.col("matches_a"), "far_b")))
    cross = cross.drop("least_b", "most_b", "far_b").join(side(met, "_b", *member), ["token", "center_b", "band_b"])
    want = F.least("matches_a", "matches_b")
    cross = cross.where((F.col("comp_a") != F.col("comp_b")) & meets("_a", "_b", "n", "n", "n", "n", F.least("room_a", "room_b") + want))
    pairs = cross.groupBy(F.least("id_a", "id_b").alias("x"), F.greatest("id_a", "id_b").alias("y"), want.alias("want")).agg(F.count("*").alias("common")).where("common >= want").select("x", "y")
    more = _compared(pairs, docs, id_col, text_col, size, num, den, "cross-pairs", reps).where("linked").select("x", "y")
    drop_tables(spark, places)

    # The same centre C: if x is not linked with C and shares none of its differences from C with y, then x and y are not linked:
    # with c = (1 - t) / (1 + t), |x ^ C| > c (|x| + |C|) and |y| <= |C| + |y ^ C| give |x ^ y| = |x ^ C| + |y ^ C| > c (|x| + |y|).
    # So only pairs with a shared difference meet, of which x is not linked with C.  With dx, dy and s the differences of both
    # and the shared ones, being linked asks for 2 s >= dx + dy - c (|x| + |y|); as s <= dy, x must share at least
    # dx - c (|x| + |y|) of its own, and y at least half of the least dx + dy - c (|x| + |y|).  So they share one among the
    # first differences of both in one order, the rarest first.
    follow = stars.where("close").select(F.col("y").alias("id"), F.col("x").alias("center"), "linked", F.col("n_y").alias("n"), (F.size("added") + F.size("lacking")).alias("d"), "added", "lacking").join(home, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    follow = materialize(follow, "followers")
    bounds = follow.groupBy("center").agg(F.max("n").alias("n_most"), F.min(F.when(~F.col("linked"), F.col("d"))).alias("d_least")).where("d_least is not null")
    slack = F.lit((den - num) / (den + num) + 1e-12) * (F.col("n") + F.col("n_most"))
    kept = ("id", "center", "linked", "n", "d", "comp")
    off = follow.join(bounds, "center").withColumn("first_own", F.greatest(F.lit(1), F.ceil(F.col("d") - slack)).cast("int")).withColumn("first_other", F.greatest(F.lit(1), F.ceil((F.col("d_least") + F.col("d") - slack) / 2)).cast("int"))
    kept = (*kept, "first_own", "first_other")
    off = off.select(*kept, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("added").alias("t")), F.struct(F.lit(1).alias("side"), F.col("lacking").alias("t")))).alias("s")).select(*kept, "s.side", F.explode("s.t").alias("token"))
    holders = off.groupBy("center", "side", "token").agg(F.count("*").alias("h"), F.count_if(~F.col("linked")).alias("open")).where("h > 1 and open > 0")
    # Differences that nobody shares come first in the order and are as many as are not among those that somebody does.
    off = off.join(holders, ["center", "side", "token"]).withColumn("after", F.row_number().over(Window.partitionBy("id", "center").orderBy(F.desc("h"), "side", "token")))
    ours = off.where("not linked and after >= first_own").select("center", "side", "token", F.col("id").alias("ia"), F.col("n").alias("na"), F.col("comp").alias("pa"))
    theirs = off.where("after >= first_other").select("center", "side", "token", F.col("id").alias("ib"), F.col("n").alias("nb"), F.col("comp").alias("pb"), F.col("linked").alias("lb"))
    meet = ours.join(theirs, (ours.center == theirs.center) & (ours.side == theirs.side) & (ours.token == theirs.token) & (F.col("pa") != F.col("pb")) & (F.col("lb") | (F.col("ia") < F.col("ib"))) & _alike(F.col("na"), F.col("nb"), num, den))
    meet = materialize(meet.select(F.col("ia").alias("x"), F.col("ib").alias("y")).distinct(), "difference-pairs")
    full = lambda v: follow.select(F.col("id").alias(v), F.col("n").alias(f"n{v}"), F.col("d").alias(f"d{v}"), F.col("added").alias(f"a{v}"), F.col("lacking").alias(f"l{v}"))
    both = meet.join(full("x"), "x").join(full("y"), "y")
    differ = F.col("dx") + F.col("dy") - 2 * (F.size(F.array_intersect("ax", "ay")) + F.size(F.array_intersect("lx", "ly")))
    total = F.col("nx") + F.col("ny")
    same = both.where((total - differ) * den >= (total + differ) * num).select("x", "y")
    more = materialize(more.unionByName(same), "cross-links")

    # Components of components: the nodes left are the first round's.
    comp2 = connected_components(more.join(comp.selectExpr("node as x", "component as cx"), "x", "left").join(comp.selectExpr("node as y", "component as cy"), "y", "left").select(F.coalesce("cx", "x").alias("src"), F.coalesce("cy", "y").alias("dst")))
    final = reps.join(comp.selectExpr("node", "component as c1"), "node", "left").withColumn("c1", F.coalesce("c1", "node")).join(comp2.selectExpr("node as c1", "component as c2"), "c1", "left").select("digest", "rep", F.coalesce("c2", "c1").alias("component"))
    final = materialize(final, "class-components")
    least = final.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = plain.where("id is not null and digest is not null").join(final.select("digest", "component").join(least, "component"), "digest")
    alone = plain.where("id is null or digest is null").select("id", "text_hash", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return linked.select(*alone.columns).unionByName(alone).select("id", F.col("n").alias("n_shingles"), "component_id", "text_hash", "component")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: 3-word shingles, similarity 0.9."""
    out = jaccard_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP10_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle FROM p),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.component_id FROM (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) d LEFT JOIN n ON n.doc_id = d.doc_id"""
