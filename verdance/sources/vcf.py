"""VCF text as relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.functions import genotypes as G
from verdance.operators.checks import ValidationError, assert_empty, chromosome_overlaps, unsorted_positions
from verdance.sources import blocks
from verdance.sources.tables import numbered_lines


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the column line, unique."""
    line = spark.read.text(path).where(F.col("value").startswith("#CHROM")).head()
    if line is None:
        raise ValidationError(f"{path} has no column line")
    names = line["value"].rstrip("\r\n").split("\t")[9:]
    if len(names) != len(set(names)):
        raise ValidationError(f"{path} names a sample twice")
    return names


def read_records(spark: SparkSession, path: str, names: Sequence[str], exact: bool = True, samples: Sequence[str] | None = None) -> DataFrame:
    """``(row_index, chrom, pos, ref, alt, format, cells)``; rows of another width are an error.

    ``cells`` has those of ``samples``, in their order (default: of all).  A
    block-gzip file is read in many tasks, and the cells of other samples never
    leave the reader; a plain gzip file is one partition.
    """
    kept = [names.index(x) for x in checked_samples(names, samples)] if samples is not None else range(len(names))
    n, wrong = 9 + len(names), f"{path} has rows of another width"
    if kept and blocks.is_block_gzip(path):
        rows = blocks.block_records(spark, path, n, kept, exact)
        assert_empty(rows.where(F.col("n_columns") != n if exact else F.col("n_columns") < n).select("chrom", "pos", "n_columns"), wrong)
        return rows.drop("n_columns")
    rows = numbered_lines(spark, path).where(~F.col("text").startswith("#")).withColumn("f", F.split(F.regexp_replace("text", "\r$", ""), "\t"))
    assert_empty(rows.where(F.size("f") != n if exact else F.size("f") < n).select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).alias("pos"), F.size("f").alias("n_columns")), wrong)
    at = lambda i: F.get("f", F.lit(i))
    cells = F.slice("f", 10, len(names)) if samples is None else F.array(*[at(9 + i) for i in kept]).cast("array<string>")
    return rows.select(F.col("line").alias("row_index"), at(0).alias("chrom"), at(1).alias("pos"), at(3).alias("ref"), at(4).alias("alt"), at(8).alias("format"), cells.alias("cells"))


def checked_samples(names: Sequence[str], samples: Sequence[str]) -> Sequence[str]:
    """The samples, all of which the VCF must have."""
    absent = sorted(set(samples) - set(names))
    if absent:
        raise ValidationError(f"samples absent from the VCF: {absent[:10]}")
    return samples


def calls(records: DataFrame, names: Sequence[str], samples: Sequence[str]) -> DataFrame:
    """Long calls ``(chrom, pos, ref, alt, sample_id, gt, dp, gq)`` of the wanted samples only.

    Cells of other samples are never split.  A record without GT is an error; a
    cell that ends before GT has a null genotype.
    """
    place = {s: i for i, s in enumerate(names)}
    checked_samples(names, samples)
    cells = F.array(*[F.struct(F.lit(s).alias("sample_id"), F.get("cells", F.lit(place[s])).alias("cell")) for s in samples])
    has_gt = F.array_contains(F.split("format", ":"), "GT")
    fmt = F.when(has_gt, F.col("format")).otherwise(F.raise_error(F.concat(F.lit("no GT at "), "chrom", F.lit(":"), "pos")))
    long = records.withColumn("format", fmt).select("chrom", "pos", "ref", "alt", "format", F.explode(cells).alias("c"))
    field = lambda n: G.cell_field(F.col("c.cell"), F.col("format"), n)
    return long.select("chrom", "pos", "ref", "alt", "c.sample_id", field("GT").alias("gt"), field("DP").alias("dp"), field("GQ").alias("gq"))


def check_biallelic_sorted(records: DataFrame) -> None:
    """Every record is one base against another, in rising order inside chromosomes that do not come back."""
    from verdance.functions.alleles import snp_state

    assert_empty(records.where(~snp_state(F.col("ref"), F.col("alt"))).select("chrom", "pos", "ref", "alt"), "records that are no biallelic SNP")
    sites = records.select("chrom", F.col("pos").cast("long").alias("pos_n"), "row_index")
    assert_empty(unsorted_positions(sites), "records out of order")
    assert_empty(chromosome_overlaps(sites), "a chromosome comes back")
