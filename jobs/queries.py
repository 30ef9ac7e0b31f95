"""The jobs as queries: each runs twice into one new folder and answers what its output holds then; and DuckDB SQL for that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import allele_atlas, descriptor_stream
from jobs.common import load_config
from verdance.storage import fresh_path


def _rounded(out: DataFrame) -> DataFrame:
    return out.select(*[F.round(f"`{f.name}`", 9).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in out.schema])


def job1_descriptor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of ``documents``; the second run finds no new files."""
    folder = fresh_path(spark, "job1")
    config = load_config(descriptor_stream.CONFIG, descriptor_stream.KEYS)
    for _ in range(2):
        path = descriptor_stream.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", f"{folder}/checkpoint", config)
    return _rounded(spark.read.parquet(path))


def job2_allele_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chromosomes, and then two of them again."""
    folder = fresh_path(spark, "job2")
    config = load_config(allele_atlas.CONFIG, allele_atlas.KEYS)
    allele_atlas.run(spark, sf_dir, folder, config)
    path = allele_atlas.run(spark, sf_dir, folder, config, ["chr1", "chr4"])
    return _rounded(spark.read.parquet(path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_descriptor_stream": job1_descriptor_stream, "job2_allele_atlas": job2_allele_atlas}

_SUM = "CAST(coalesce(sum({0}) FILTER ({1}), 0) AS BIGINT)"
_GARDENS = ("Pingshun", "Tongguan", "Zhendong")
_MINOR = """CASE WHEN Wild_AC * 2 <= Wild_AN THEN 'ALT' ELSE 'REF' END AS Wild_minor_allele, least(Wild_AC, Wild_AN - Wild_AC) AS Wild_minor_count"""
_BIN = """round(Wild_minor_count / Wild_AN, 9) AS Wild_minor_MAF,
        CASE WHEN Wild_minor_count / Wild_AN <= 0.01 THEN 'MAF_le_0.01' WHEN Wild_minor_count / Wild_AN <= 0.05 THEN '0.01_lt_MAF_le_0.05' WHEN Wild_minor_count / Wild_AN <= 0.10 THEN '0.05_lt_MAF_le_0.10' ELSE 'MAF_gt_0.10' END AS Wild_MAF_bin"""

JOB1_SQL = rf"""
    WITH d AS (SELECT coalesce(lang, 'NA') AS chrom, coalesce(text, '') AS text, CAST(substr(source, 4) AS INTEGER) AS s FROM documents WHERE regexp_full_match(source, 'src(1?[0-9])')),
    g AS (SELECT chrom, text, CASE WHEN s < 8 THEN 'Wild' WHEN s < 13 THEN 'Pingshun' WHEN s < 16 THEN 'Tongguan' ELSE 'Zhendong' END AS grp FROM d),
    n AS (SELECT chrom, count(*) FILTER (grp = 'Wild') AS Wild_AN, {", ".join(f"count(*) FILTER (grp = '{g}') AS {g}_AN" for g in _GARDENS)} FROM g GROUP BY chrom),
    w AS (SELECT chrom, grp, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))) AS pos FROM g),
    c AS (SELECT chrom, pos, count(*) FILTER (grp = 'Wild') AS Wild_AC, {", ".join(f"count(*) FILTER (grp = '{g}') AS {g}_AC" for g in _GARDENS)} FROM w GROUP BY chrom, pos),
    s AS (SELECT *, {" + ".join(f"{g}_AC" for g in _GARDENS)} AS Ex_situ_AC, {" + ".join(f"{g}_AN" for g in _GARDENS)} AS Ex_situ_AN FROM c JOIN n USING (chrom)),
    t AS (SELECT *, {_MINOR} FROM s WHERE Wild_AC > 0 AND Wild_AC < Wild_AN)
    SELECT chrom, pos, {", ".join(f"{g}_AC, {g}_AN" for g in ("Wild", "Ex_situ", *_GARDENS))}, Wild_minor_allele, Wild_minor_count, {_BIN},
        {", ".join(f"CASE WHEN Wild_minor_allele = 'ALT' THEN {g}_AC ELSE {g}_AN - {g}_AC END AS {g}_minor_count" for g in ("Ex_situ", *_GARDENS))}
    FROM t"""

_REGIONS = ("AFRICA", "AMERICA", "MIDDLE EAST")
JOB2_SQL = f"""
    WITH a AS (SELECT s_suppkey, CASE WHEN r_name IN ('AFRICA', 'AMERICA', 'MIDDLE EAST') THEN 'Wild' WHEN r_name = 'ASIA' OR r_name = 'EUROPE' THEN 'Ex_situ' END AS grp, r_name AS region
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    l AS (SELECT 'chr' || (l_partkey % 5) AS chrom, CAST(l_partkey AS VARCHAR) AS pos, grp, region,
        CAST(l_discount >= 0.05 AND l_quantity <= CASE WHEN l_partkey % 10 = 9 THEN 20 ELSE l_partkey % 10 END AS INTEGER) AS alt
        FROM lineitem JOIN a ON l_suppkey = s_suppkey WHERE grp IS NOT NULL),
    c AS (SELECT chrom, pos, {_SUM.format("alt", "grp = 'Wild'")} AS Wild_AC, count(*) FILTER (grp = 'Wild') AS Wild_AN, {_SUM.format("alt", "grp = 'Ex_situ'")} AS X_AC, count(*) FILTER (grp = 'Ex_situ') AS X_AN,
        {", ".join(f"{_SUM.format('alt', f'region = {r!r}')} AS ac{i}, count(*) FILTER (region = '{r}') AS an{i}" for i, r in enumerate(_REGIONS))} FROM l GROUP BY chrom, pos),
    t AS (SELECT *, {_MINOR} FROM c WHERE Wild_AC > 0 AND Wild_AC < Wild_AN),
    m AS (SELECT *, {", ".join(f"CASE WHEN Wild_minor_allele = 'ALT' THEN ac{i} ELSE an{i} - ac{i} END AS n{i}" for i in range(3))} FROM t WHERE CASE WHEN Wild_minor_allele = 'ALT' THEN X_AC ELSE X_AN - X_AC END = 0),
    o AS (SELECT *, concat_ws(';', {", ".join(f"CASE WHEN n{i} > 0 THEN '{r}' END" for i, r in enumerate(_REGIONS))}) AS here, {" + ".join(f"CAST(n{i} > 0 AS INTEGER)" for i in range(3))} AS k FROM m)
    SELECT chrom, pos AS POS, Wild_minor_allele, Wild_minor_count, {_BIN}, CAST(k AS INTEGER) AS Presence_region_count,
        CASE WHEN k > 0 THEN here ELSE 'None' END AS Presence_regions, CASE WHEN k = 1 THEN here ELSE 'NA' END AS Region_specific_region,
        n0 AS AFRICA_minor_count, n1 AS AMERICA_minor_count, n2 AS MIDDLE_EAST_minor_count
    FROM o"""

ORACLE_SQL = {"job1_descriptor_stream": JOB1_SQL, "job2_allele_atlas": JOB2_SQL}
