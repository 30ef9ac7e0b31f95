"""Removal of boilerplate lines by the number of distinct sites that carry them.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm.common import table
from verdance.storage import materialize, result_only

#: Sites a line must be on to be boilerplate.
MIN_SITES = 6
#: Relative standard deviation of the sketches, and how many of them around the
#: threshold are counted exactly.
RSD, BAND = 0.05, 6


#: White space that does not count at a line's ends.
BLANK = " \t\r\f\x0B"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def line_rows(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """``(id, key, site, pos, n_lines, h)``: the non-blank lines of each row with a 128-bit hash of the trimmed line.

    ``id`` and ``key``, a hash of the text, are the row's name; ``n_lines`` is
    how many such lines it has.  Lines end at line feeds.  A null site is the
    site ``''``; a null text has no lines.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("key"), F.coalesce(F.col(f"`{site_col}`"), F.lit("")).alias("site"), F.transform(F.split(text, "\n", -1), _trimmed).alias("lines"))
    rows = rows.select("id", "key", "site", F.size(F.filter("lines", lambda x: x != "")).alias("n_lines"), F.posexplode("lines").alias("pos", "line")).where("line <> ''")
    return rows.select("id", "key", "site", "pos", "n_lines", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).alias("h"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, rsd: float = RSD, band: int = BAND) -> DataFrame:
    """Hashes of the lines on at least ``min_sites`` distinct sites, with ``first_id``, the smallest id that has them.

    One HyperLogLog sketch of the sites per line hash, merged by the partial
    and final aggregation; the estimate decides far from the threshold.  Lines
    whose estimate is within ``band`` deviations of it are counted exactly, so
    the decision is that of the exact count (a sketch is off by more than six
    deviations about once in 10^9 lines).  Lines seen on fewer rows than
    ``min_sites`` cannot reach it and leave before.
    """
    spread = lines.groupBy("h").agg(F.approx_count_distinct("site", rsd).alias("est"), F.count("*").alias("n"), F.min("id").alias("first_id"))
    width = max(1.0, band * rsd * min_sites)
    spread = materialize(spread.where((F.col("n") >= min_sites) & (F.col("est") >= min_sites - width)), "line-spread")
    sure = spread.where(F.col("est") > min_sites + width).select("h", "first_id")
    near = spread.where(F.col("est") <= min_sites + width).select("h", "first_id")
    sites = lines.select("h", "site").join(near, "h").groupBy("h", "first_id", "site").agg(F.lit(1).alias("one"))
    exact = sites.groupBy("h", "first_id").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h", "first_id")
    return sure.unionByName(exact)


def _whole_copies(hits: DataFrame) -> DataFrame:
    """Names of the rows that have nothing but boilerplate, and exactly the lines of a row with another id."""
    solid = hits.where("n_hit = n_lines").select("id", "key", F.xxhash64("lines").alias("s1"), F.xxhash64(F.lit(1), "lines").alias("s2"))
    shared = solid.groupBy("s1", "s2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("s1", "s2")
    return solid.join(shared, ["s1", "s2"]).select("id", "key")


def _line_hits(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, keep_whole_copies: bool) -> DataFrame:
    """``(id, key, gone)``: the positions of the lines that leave, of the rows that lose some."""
    lines = materialize(line_rows(docs, id_col, text_col, site_col), "lines")
    marks = materialize(boilerplate(lines, min_sites), "boilerplate")
    # Skew of one hot line is split by the join; the positions are as many as the text has lines, whatever the number of repeated rows.
    seen = lines.where("id is not null").join(marks, "h").groupBy("id", "key")
    gone = F.collect_set(F.when(F.col("id") > F.col("first_id"), F.col("pos"))).alias("gone")
    if not keep_whole_copies:
        return seen.agg(gone).where(F.size("gone") > 0)
    hits = materialize(seen.agg(gone, F.max("n_lines").alias("n_lines"), F.size(F.collect_set("pos")).alias("n_hit"), F.array_sort(F.collect_set("h")).alias("lines")), "line-hits")
    return hits.where(F.size("gone") > 0).join(_whole_copies(hits), ["id", "key"], "left_anti").select("id", "key", "gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, keep_whole_copies: bool = False, prefix: str = "") -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text_col``, plus ``n_lines`` and ``n_removed``, whose names begin with ``prefix``.

    A line on ``min_sites`` distinct sites stays in the rows with the smallest
    id that has it and leaves all others, with its line feed.  A line that
    repeats inside one text counts once for its site, and all of its repeats
    share its fate.  ``n_lines`` counts non-blank lines.

    With ``keep_whole_copies`` a row keeps its text if all of its lines are
    boilerplate and they are the very set of lines of a row with another id:
    it is a copy of a whole document, which is for document deduplication to
    judge.  Otherwise such a row may end up empty.

    Rows are told apart by id and text, so equal ids with other texts are
    cleaned each by itself, and a row that is repeated is cleaned in all its
    repeats.  Null and blank texts pass unchanged, and so do rows with a null
    id, though their lines count for their sites.  An empty table gives an
    empty result.  All other columns pass through; columns of ``docs`` that
    have the name of a result are replaced.

    Texts are split into lines once; hashes, sites and ids go to a table.
    Texts move once, to meet the positions to drop.
    """
    hits = result_only(docs.sparkSession, "line-hits", lambda: _line_hits(docs, id_col, text_col, site_col, min_sites, keep_whole_copies))
    results = [prefix + "n_lines", prefix + "n_removed"]
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results], F.xxhash64(F.col(f"`{text_col}`")).alias("__key"))
    hits = hits.select(F.col("id").alias("__id"), F.col("key").alias("__hit_key"), F.col("gone").alias("__gone"))
    # The same plan at every size: rows and positions meet in a shuffle by row, which splits what is hot.
    joined = rest.join(hits.hint("merge"), (F.col(f"`{id_col}`") == F.col("__id")) & (F.col("__key") == F.col("__hit_key")), "left")
    text = F.col(f"`{text_col}`")
    all_lines = F.split(text, "\n", -1)
    solid = F.when(text.isNull(), 0).otherwise(F.size(F.filter(all_lines, lambda x: _trimmed(x) != "")))
    left = F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    return joined.select(
        *[F.when(F.col("__gone").isNotNull(), left).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in results],
        solid.alias(results[0]),
        F.coalesce(F.size("__gone"), F.lit(0)).alias(results[1]),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: non-blank lines, removed lines, and the MD5 of the text that stays."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


#: A row is its number here, since ids and whole rows may repeat.
OP5_SQL = f"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, text FROM documents
    ), cut AS (
        SELECT r, doc_id, site, i AS pos, list_extract(string_split(text, chr(10)), i) AS raw FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs WHERE text IS NOT NULL)
    ), lines AS (
        SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM cut
    ), marks AS (
        SELECT line, min(doc_id) AS first_id FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
    ), seen AS (
        SELECT l.*, coalesce(l.doc_id > m.first_id, false) AS gone FROM lines l LEFT JOIN marks m ON l.line = m.line
    ), per AS (
        SELECT r, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_gone, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
        FROM seen GROUP BY r
    )
    SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_gone, 0) AS BIGINT) AS n_removed, md5(CASE WHEN n_gone > 0 THEN coalesce(kept, '') ELSE d.text END) AS text_md5
    FROM docs d LEFT JOIN per p ON d.r = p.r"""
