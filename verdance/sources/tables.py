"""Readers of delimited tables; every column comes as text, gzip is told by the suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdance.functions.text import canonical_material, canonical_region, cleaned, first_column, stripped
from verdance.operators.checks import ValidationError, assert_empty, duplicates


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, text)``; numbers rise with the place in the file, with gaps between partitions."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


def read_tsv(spark: SparkSession, path: str, *required: str) -> DataFrame:
    """A table with a header; all columns are text and blanks stay blank."""
    df = spark.read.options(sep="\t", header=True, inferSchema=False, emptyValue="", nullValue="\u0000", quote='"', escape='"').csv(path)
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValidationError(f"{path} lacks the columns {absent}")
    return df.select(*[F.coalesce(F.regexp_replace(f"`{c}`", "\r$", ""), F.lit("")).alias(c.rstrip("\r")) for c in df.columns])


def read_sample_list(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, ord)`` of one id per line: trimmed, without blanks, unique, in the file's order."""
    rows = numbered_lines(spark, path).select("line", stripped(F.col("text")).alias("sample_id")).where("sample_id <> ''")
    out = rows.select("sample_id", F.row_number().over(Window.orderBy("line")).alias("ord"))  # a cohort, not sites
    assert_empty(duplicates(out, "sample_id"), f"{path} lists samples twice")
    if out.isEmpty():
        raise ValidationError(f"{path} lists no samples")
    return out


def read_acan(spark: SparkSession, path: str, group: str) -> DataFrame:
    """``(grp, chrom, pos, alt_ac, an)`` of an allele-count table.

    Blank lines are skipped; the first other line may be a header, which is a
    line whose third and fourth field are no integers and that names a known
    column.  Further columns are ignored.  Counts must be whole numbers with
    0 <= AC <= AN.
    """
    rows = numbered_lines(spark, path).where(stripped(F.col("text")) != "")
    first = rows.orderBy("line").limit(1).first()
    if first is None:
        raise ValidationError(f"{path} has no rows")
    f = first["text"].split("\t")
    whole = lambda x: x.strip().lstrip("+-").isdigit()
    if len(f) >= 4 and not (whole(f[2]) and whole(f[3])) and {x.strip().upper().lstrip("#") for x in f[:4]} & {"CHROM", "POS", "AC", "ALT_AC", "AN"}:
        rows = rows.where(F.col("line") != first["line"])
    part = F.split("text", "\t")
    count = lambda i: F.get(part, F.lit(i)).try_cast("int")
    out = rows.select(F.lit(group).alias("grp"), F.get(part, F.lit(0)).alias("chrom"), F.get(part, F.lit(1)).alias("pos"), count(2).alias("alt_ac"), count(3).alias("an"))
    assert_empty(out.where("pos is null or alt_ac is null or an is null or alt_ac < 0 or alt_ac > an"), f"{path} has rows that are no allele counts")
    return out


def read_missing_targets(spark: SparkSession, path: str) -> DataFrame:
    """Missing targets with typed columns and their bin computed again; sites are unique and there is at least one."""
    from verdance.functions.alleles import maf_bin

    df = read_tsv(spark, path, "CHROM", "POS", "Wild_minor_allele", "Wild_minor_count", "Wild_minor_MAF")
    maf = F.col("Wild_minor_MAF").cast("double")
    out = df.withColumns({"Wild_minor_count": F.col("Wild_minor_count").cast("double").cast("int"), "Wild_minor_MAF": maf, "Wild_MAF_bin": maf_bin(maf)})
    assert_empty(duplicates(out, "CHROM", "POS"), f"{path} lists a target twice")
    if out.isEmpty():
        raise ValidationError(f"{path} lists no targets")
    return out


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, material, garden, region, Original_*)`` with null words, materials and regions made uniform.

    Rows without an id, or with a null word in its place, are left out.  A blank
    region is looked up in ``Registered_region``; a null word is not blank.
    """
    df = read_tsv(spark, path)
    col = lambda *names: cleaned(F.col(f"`{c}`")) if (c := first_column(df.columns, *names)) else F.lit("NA")
    raw = lambda name: F.col(f"`{c}`") if (c := first_column(df.columns, name)) else F.lit("")
    if not first_column(df.columns, "SampleID", "IID"):
        raise ValidationError(f"{path} has no sample column")
    material = canonical_material(col("Material_type", "Material"))
    garden = F.when(material == "Wild", "NA").otherwise(col("Ex_situ_site", "Garden"))
    region = canonical_region(F.when(raw("Region") == "", raw("Registered_region")).otherwise(raw("Region")))
    out = df.where(col("SampleID", "IID") != "NA").select(col("SampleID", "IID").alias("sample_id"), material.alias("material"), garden.alias("garden"), region.alias("region"), *[col(c).alias(c) for c in ("Original_province", "Original_city", "Original_county")])
    assert_empty(duplicates(out, "sample_id"), f"{path} lists samples twice")
    assert_empty(out.where(~F.col("material").isin("Wild", "Ex_situ")).select("sample_id", "material"), f"{path} has unknown materials")
    assert_empty(out.where((F.col("material") == "Ex_situ") & ~F.col("garden").isin("Pingshun", "Tongguan", "Zhendong")).select("sample_id", "garden"), f"{path} has unknown gardens")
    return out


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(a, b, pi_hat)`` of a similarity table under any of its column names."""
    df = read_tsv(spark, path)
    names = [first_column(df.columns, *n) for n in (("IID1", "Sample1", "ID1"), ("IID2", "Sample2", "ID2"), ("PI_HAT", "PIHAT"))]
    if not all(names):
        raise ValidationError(f"{path} has no pair and similarity columns")
    return df.select(stripped(F.col(names[0])).alias("a"), stripped(F.col(names[1])).alias("b"), F.col(names[2]).try_cast("double").alias("pi_hat"))


def read_quotas(spark: SparkSession, path: str) -> DataFrame:
    """``(Plan, Region, Quota, rng_order)``: the explicit drawing order, or the place in the file."""
    df = read_tsv(spark, path, "Plan", "Region")
    size = first_column(df.columns, "Sample_N", "Quota")
    order = first_column(df.columns, "Random_sampling_order")
    place = F.monotonically_increasing_id()
    out = df.select(stripped(F.col("Plan")).alias("Plan"), canonical_region(F.col("Region")).alias("Region"), F.col(size).cast("int").alias("Quota"), (F.coalesce(F.col(order).try_cast("long"), place) if order else place).alias("rng_order"))
    assert_empty(duplicates(out, "Plan", "Region"), f"{path} lists a quota twice")
    assert_empty(out.where("Quota is null or Quota < 0"), f"{path} has quotas that are no counts")
    return out


def read_key_values(spark: SparkSession, path: str) -> dict[str, str]:
    """An ``Item, Value`` table; items are unique."""
    df = read_tsv(spark, path, "Item", "Value")
    assert_empty(duplicates(df, "Item"), f"{path} lists an item twice")
    return {r["Item"]: r["Value"] for r in df.collect()}
