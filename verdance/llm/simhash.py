"""SimHash fingerprints and Hamming search by permuted block tables.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdance.llm.common import table
from verdance.storage import materialize

BITS = 64
#: Terms that vote in one packed counter; four counters of 16 bits share a long.
CHUNK = 16_384
#: Hamming radius of the search, and the blocks a fingerprint is cut into.
RADIUS, BLOCKS = 3, 6


def words_of(text: Column) -> Column:
    """The words of a text in lower case: what ASCII white space separates."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def term_hashes(words: Column) -> Column:
    """Hashes of a text's terms: each word with its follower, the last word alone.

    A term that occurs n times is there n times, which is its weight.
    ``words`` must be a column of its own, not an expression: the lambda reads
    it once for each word.
    """
    return F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def _lanes(h: Column) -> list[Column]:
    """Sixteen longs; lane j of the g-th has bit 4g+j of the hash in 16 bits of its own."""
    out = []
    for g in range(BITS // 4):
        x = F.shiftrightunsigned(h, 4 * g).bitwiseAND(F.lit(15))
        out.append(x.bitwiseAND(F.lit(1)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(2)), 15)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(4)), 30)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(8)), 45)))
    return out


def fingerprints(rows: DataFrame, keys: list[str], text_col: str, out: str) -> DataFrame:
    """``keys`` and the SimHash of ``text_col`` as a long ``out``; rows with equal keys are taken as one text.

    Every term votes +1 or -1 on each bit by its hash; the sign of the sum is
    the bit (a tie is 0, and so is every bit of a text without terms; a null
    text is an empty one).  Votes are summed per 16,384 terms in packed
    counters, then per text, so a text of any length is one small row before
    anything is shuffled and its counters are exact.
    """
    terms = rows.select(*keys, words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("__w"))
    terms = terms.select(*keys, F.posexplode_outer(term_hashes(F.col("__w"))).alias("__i", "__h"))
    terms = terms.withColumn("__chunk", F.expr(f"__i div {CHUNK}"))
    packed = terms.groupBy(*keys, "__chunk").agg(F.count("__h").alias("n"), *[F.sum(c).alias(f"s{g}") for g, c in enumerate(_lanes(F.col("__h")))])
    bit = [F.shiftrightunsigned(F.col(f"s{b // 4}"), 16 * (b % 4)).bitwiseAND(F.lit(65535)) for b in range(BITS)]
    votes = packed.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(f"b{b}") for b, c in enumerate(bit)])
    value = F.lit(0).cast("long")
    for b in range(BITS):
        value = value.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return votes.select(*keys, value.alias(out))


def as_hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _tables(radius: int, blocks: int) -> list[int]:
    """Bit masks of all choices of ``blocks - radius`` blocks: two fingerprints within the radius agree on one."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(block[i] for i in pick)) for pick in combinations(range(blocks), blocks - radius)]


def within_radius(queries: DataFrame, all_rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(q, fp, distance)`` for each distinct fingerprint ``q`` of ``queries`` and ``fp`` of ``all_rows`` within ``radius`` bits.

    Both frames have one long column ``fp``; nulls match nothing.  Each
    fingerprint stands in one table per choice of blocks, keyed by its bits
    there; agreeing keys are verified, and a pair counts in the first table
    where it agrees, so no pair is made twice.  Equal fingerprints are merged
    first: a group of copies is one row in each table.
    """
    masks = _tables(radius, blocks)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col("fp").alias(name)).where(F.col(name).isNotNull()).distinct()
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
        return rows.select(name, F.explode(keys).alias("k")).select(name, "k.t", "k.key")

    a, b = keyed(queries, "q"), keyed(all_rows, "fp")
    x = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.lit(len(masks))
    for t, m in reversed(list(enumerate(masks))):
        first = F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(t)).otherwise(first)
    hit = (a.t == b.t) & (a.key == b.key) & (F.bit_count(x) <= radius) & (a.t == first)
    # The planner would size the tables before they are exploded, and broadcast what grows with the data.
    return a.hint("merge").join(b.hint("merge"), hit).select("q", "fp", F.bit_count(x).alias("distance"))


def _cuts(ranged: DataFrame, buckets: int) -> tuple[Column, Column]:
    """Sorted first keys ``(id, h)`` of the buckets of ``ranged(k, part)``, and every ``sqrt(buckets)``-th of all but the first.

    They are written once, a row for each bucket, and come into the plan as
    scalar subqueries: its size does not grow with the buckets.
    """
    firsts = materialize(ranged.groupBy("part").agg(F.min("k").alias("k")), "cuts")
    step = max(1, int(buckets**0.5))
    every = firsts.agg(F.sort_array(F.collect_list("k")).alias("k"))
    return every.scalar(), every.select(F.filter(F.expr("slice(k, 2, greatest(size(k) - 1, 0))"), lambda _, i: i % step == 0)).scalar()


def _bucket(key: Column, firsts: Column, coarse: Column, buckets: int) -> Column:
    """Which bucket of consecutive keys ``(id, h)`` a row is in, by the sorted first keys of the buckets: two short scans."""
    step = max(1, int(buckets**0.5))
    # Cuts not above the key, from the key's place among them in falling order: subqueries cannot stand inside lambdas.
    reached = lambda cuts: F.size(cuts) + 1 - F.array_position(F.sort_array(F.array_append(cuts, key), False), key).cast("int")
    blocks = reached(coarse)
    inside = reached(F.slice(firsts, (F.greatest(blocks, F.lit(1)) - 1) * step + 2, step))
    return F.when(blocks == 0, 0).otherwise((blocks - 1) * step + inside)


def with_next(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Each row with the row after it by ascending id; the last one's is the first.

    Gives ``bucket, at`` (a key of the row), ``id, text`` (null: empty) and
    ``next_id, next_text``.  A null id comes before all others; equal ids are
    in the order of a hash of their texts, and equal rows follow each other.
    An empty table gives an empty result.

    A range partitioning of the narrow table of ids and hashes gives the cut
    points, at most ``buckets`` of them, so buckets have near equal rows
    whatever the ids are: outliers, hashed ids, one id with a third of all
    rows.  Texts are then shuffled once, into their buckets; the first row of
    each bucket also goes to the bucket before it.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = rows.select("id", "h").repartitionByRange(buckets, F.col("id").asc_nulls_first(), "h").select(F.struct("id", "h").alias("k"), F.spark_partition_id().alias("part"))
    firsts, coarse = _cuts(ranged, buckets)
    key = F.struct("id", "h")
    rows = rows.withColumn("bucket", _bucket(key, firsts, coarse, buckets))
    opens = F.get(firsts, F.col("bucket")).eqNullSafe(key)
    last = F.size(firsts) - 1
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"), F.lit(0).alias("wrap"))
    there = F.struct(F.when(F.col("bucket") == 0, last).otherwise(F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("guest"), (F.col("bucket") == 0).cast("int").alias("wrap"))
    rows = rows.select("id", "h", "text", F.explode(F.when(opens, F.array(here, there)).otherwise(F.array(here))).alias("to")).select("id", "h", "text", "to.*")
    order = Window.partitionBy("bucket").orderBy("wrap", F.col("id").asc_nulls_first(), "h", "guest")
    rows = rows.select("bucket", F.row_number().over(order).alias("at"), "guest", "id", "h", "text", F.lead("id").over(order).alias("next_id"), F.lead("text").over(order).alias("next_text"))
    return rows.where("guest = 0").drop("guest", "h")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    ``n_near``: for the ids divisible by 20, the other documents whose
    fingerprint differs in at most 3 bits; null for the rest.
    """
    docs = table(spark, sf_dir, "documents")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, "doc_id", "text", buckets)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    rows = rows.select(
        "bucket", "at", "id", F.xxhash64("text").alias("h"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "next_id", F.xxhash64("next_text").alias("next_h"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("v"),
    ).select("*", "v.which", "v.t")
    keys = ["bucket", "at", "id", "h", "n_chars", "edited_sha256", "next_id", "next_h"]
    both = fingerprints(rows, [*keys, "which"], "t", "fp").groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    both = materialize(both, "fingerprints")
    after = both.groupBy(F.col("id").alias("n_id"), F.col("h").alias("n_h")).agg(F.max("fp").alias("next_fp"))
    out = both.join(after, F.col("next_id").eqNullSafe(F.col("n_id")) & (F.col("next_h") == F.col("n_h")), "left")

    per_fp = both.groupBy("fp").agg(F.count("*").alias("n"))
    near = within_radius(both.where("id % 20 = 0").select("fp"), both.select("fp")).join(per_fp, "fp").groupBy("q").agg((F.sum("n") - 1).alias("n_near"))
    found = both.where("id % 20 = 0").select(F.col("bucket").alias("b_"), F.col("at").alias("a_"), "fp").join(near, F.col("fp") == F.col("q")).select("b_", "a_", "n_near")
    out = out.join(found, (F.col("bucket") == F.col("b_")) & (F.col("at") == F.col("a_")), "left")
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near",
    )
