"""Fill-in-middle: texts cut at two word boundaries and put together in another order.

A boundary lies between two adjacent characters, the first no white space and
the second white space, so boundaries can be counted in any chunk that knows
one character more than its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdance.llm.common import table
from verdance.storage import materialize

#: Code points of a chunk.
CHUNK = 1 << 14
SEED = 42
#: Documents out of a hundred that are rearranged, and out of a hundred of those the ones that begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_BOUNDARY = r"[^\x20\x09-\x0D][\x20\x09-\x0D]"
_AFTER = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def boundaries(chunk: Column) -> Column:
    """How many pairs of adjacent characters end a token."""
    return F.regexp_count(chunk, F.lit(_BOUNDARY)).cast("long")


def boundary_at(chunk: Column, rank: Column) -> Column:
    """Characters before the boundary of this rank, the first being 1: those of the tokens that end at or before it."""
    upto = F.slice(F.split(chunk, _AFTER, (rank + 1).cast("int")), F.lit(1), rank.cast("int"))
    return F.aggregate(upto, F.lit(0).cast("long"), lambda n, t: n + F.length(t))


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """The first four groups of eight hexadecimal digits of a hash of seed and id, as numbers; a null id reads as an empty one."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def assembled(text: Column, form: Column, prefix_chars: Column, middle_chars: Column) -> Column:
    """The rearranged text: whole, prefix - suffix - middle, or suffix - prefix - middle, with markers."""
    n = F.length(text)
    prefix = F.substring(text, F.lit(1), prefix_chars.cast("int"))
    middle = F.substring(text, (prefix_chars + 1).cast("int"), middle_chars.cast("int"))
    suffix = F.substring(text, (prefix_chars + middle_chars + 1).cast("int"), n)
    return (
        F.when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; its parts hold no markers, so each marker is there once."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda k: F.get(part, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def chunked(rows: DataFrame, chunk: int) -> DataFrame:
    """``(row, k, last, piece)``: each text in chunks of ``chunk`` code points, each with the first one of the next chunk after it."""
    schema = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("last", pa.bool_()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0), b.column(1)):
                row, text = row.as_py(), text.as_py()
                for k in range(-(-len(text) // chunk)):
                    piece = [[row], [k], [(k + 1) * chunk >= len(text)], [text[k * chunk : (k + 1) * chunk + 1]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(piece, schema)], schema=schema)

    return rows.select("row", "text").mapInArrow(run, "row long, k int, last boolean, piece string")


def _drawn(df: DataFrame, n: Column) -> DataFrame:
    """Adds ``n``, the ranks ``lo`` and ``hi`` of the cuts, and ``form``."""
    h = draws(F.col("__id"))
    plain = (F.length("__text") == 0) | F.contains("__text", F.lit(PREFIX)) | F.contains("__text", F.lit(SUFFIX)) | F.contains("__text", F.lit(MIDDLE)) | (F.col("__h3") % 100 >= RATE)
    df = df.withColumn("__n", n).withColumns({f"__h{k + 1}": x for k, x in enumerate(h)})
    a, b = F.col("__h1") % (F.col("__n") + 1), F.col("__h2") % (F.col("__n") + 1)
    return df.withColumns({"__lo": F.least(a, b), "__hi": F.greatest(a, b), "__form": F.when(plain, "plain").when(F.col("__h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")}).drop(*[f"__h{k + 1}" for k in range(4)])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all if None) with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    A token is white space with the word after it, or white space that ends
    the text; ``n`` counts them.  Prefix and middle end after numbers of tokens
    that the id's hash draws; ``form`` is ``plain``, ``psm`` or ``spm``.
    ``prefix_chars`` and ``middle_chars`` count code points, null if plain.

    A text of at most one chunk is counted and cut where it is.  Longer ones
    are cut into chunks that overlap by one character and are dealt to all
    tasks: each counts its boundaries, prefix sums over a text's counts tell
    which chunk holds which cut, and only these chunks are read again.

    A null text is empty; empty texts are plain with no tokens.  Rows with
    equal ids, or with null ones, get the same draws; repeated rows are rows of
    their own; an empty table gives an empty result.  Columns of ``docs`` with
    the name of a result are replaced.
    """
    taken = ("n", "form", "prefix_chars", "middle_chars", "output")
    names = [c for c in (docs.columns if columns is None else columns) if c not in taken]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    short, long = rows.where(F.length("__text") <= chunk), rows.where(F.length("__text") > chunk)

    def cut(rank: str) -> Column:
        r = F.col(rank)
        return F.when(r == 0, F.lit(0).cast("long")).when(r == F.col("__n"), F.length("__text").cast("long")).otherwise(boundary_at(F.col("__text"), r))

    near = _drawn(short, F.when(F.length("__text") > 0, boundaries(F.col("__text")) + 1).otherwise(F.lit(0).cast("long")))
    near = near.withColumns({"__first": F.when(F.col("__form") != "plain", cut("__lo")), "__second": F.when(F.col("__form") != "plain", cut("__hi"))})

    # Rows of long texts get numbers that stay, since they are read several times.
    long = materialize(long.withColumn("__row", F.monotonically_increasing_id()), "middle-long")
    parts = chunked(long.select(F.col("__row").alias("row"), F.col("__text").alias("text")), chunk).repartition("row", "k")
    parts = materialize(parts.withColumn("held", boundaries(F.col("piece"))), "middle-chunks")
    before = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select("row", "k", "held", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    total = parts.groupBy(F.col("row").alias("__row")).agg(F.sum("held").alias("__pairs"))
    far = _drawn(long.join(total, "__row"), F.col("__pairs") + 1)
    ranks = far.where("__form <> 'plain'").select(F.col("__row").alias("row"), "__n", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("__lo").alias("rank")), F.struct(F.lit(1).alias("which"), F.col("__hi").alias("rank")))).alias("c")).select("row", "__n", "c.which", "c.rank")
    inner = ranks.where("rank > 0 and rank < __n").join(sums, "row").where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("held")))
    found = inner.select("row", "k", "which", (F.col("rank") - F.col("before")).alias("own")).join(parts.select("row", "k", "piece"), ["row", "k"])
    found = found.select("row", "which", (F.col("k").cast("long") * chunk + boundary_at(F.col("piece"), F.col("own"))).alias("at"))
    places = found.groupBy(F.col("row").alias("__row")).agg(F.max(F.when(F.col("which") == 0, F.col("at"))).alias("__at0"), F.max(F.when(F.col("which") == 1, F.col("at"))).alias("__at1"))
    end = lambda rank, at: F.when(F.col("__form") != "plain", F.when(F.col(rank) == 0, F.lit(0).cast("long")).when(F.col(rank) == F.col("__n"), F.length("__text").cast("long")).otherwise(F.col(at)))
    far = far.join(places, "__row", "left").withColumns({"__first": end("__lo", "__at0"), "__second": end("__hi", "__at1")})

    both = near.select(*[F.col(f"`{c}`") for c in names], "__text", "__n", "__form", "__first", "__second").unionByName(far.select(*[F.col(f"`{c}`") for c in names], "__text", "__n", "__form", "__first", "__second"))
    both = both.withColumn("__middle", F.col("__second") - F.col("__first"))
    output = assembled(F.col("__text"), F.col("__form"), F.col("__first"), F.col("__middle"))
    return both.select(*[F.col(f"`{c}`") for c in names], F.col("__n").alias("n"), F.col("__form").alias("form"), F.col("__first").alias("prefix_chars"), F.col("__middle").alias("middle_chars"), output.alias("output"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` rearranged; digests of the outputs and of the texts rebuilt from them."""
    out = fill_in_middle(table(spark, sf_dir, "documents"), columns=["doc_id"])
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    w AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
    c AS (SELECT doc_id, text, w, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS lo, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS hi,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
    p AS (SELECT doc_id, text, n, form, array_to_string(w[1:lo], '') AS p, array_to_string(w[lo + 1:hi], '') AS m, array_to_string(w[hi + 1:], '') AS s FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
    FROM p"""
