"""Queries that write the model's relations as the text files of a study and read them back with the study's readers.

Each writes into a new folder under the session's shared folder and leaves its
files there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.operators import altstates, control, relatedness, representation, selection
from verdance.plans.model import Model
from verdance.plans.queries import _per_target, _status, query
from verdance.sources import blocks, carriers, tables, vcf
from verdance.storage import fresh_path

_FIXED = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def _vcf(m: Model, records: DataFrame, label: str) -> str:
    """Records as VCF text: a column line in a file of its own and one line for each record."""
    path = fresh_path(m.spark, label)
    m.spark.range(1).select(F.lit("\t".join([*_FIXED, *m.names])).alias("value")).write.text(path)
    dot = F.lit(".")
    records.select(F.concat_ws("\t", "chrom", "pos", dot, "ref", "alt", dot, F.lit("PASS"), dot, "format", F.array_join("cells", "\t")).alias("value")).write.mode("append").text(path)
    return path


def _tsv(m: Model, df: DataFrame, label: str, header: bool = True) -> str:
    path = fresh_path(m.spark, label)
    df.write.options(sep="\t", header=header, emptyValue="").csv(path)
    return path


@query
def text_retention_overall(m: Model) -> DataFrame:
    """Allele-count tables of the five groups, without a header, aligned with the check that all hold the same sites."""
    parts = [tables.read_acan(m.spark, _tsv(m, m.acan.where(F.col("grp") == g).select("chrom", "pos", "alt_ac", "an"), f"acan-{g}", header=False), g) for g in representation.GROUPS]
    return representation.retention_overall(representation.targets(representation.align(reduce(DataFrame.unionByName, parts))))


@query
def text_alt_state_summary(m: Model) -> DataFrame:
    """Multi-allelic records by way of VCF text."""
    path = _vcf(m, m.multi_records, "vcf-states")
    names = vcf.read_header(m.spark, path)
    classes = [(r["SampleID"], r["Is_representative"], r["Ex_situ_site"]) for r in _status(m).select("SampleID", "Is_representative", "Ex_situ_site").collect()]  # the collection
    return altstates.coverage_summary(altstates.state_counts_in_record(vcf.read_records(m.spark, path, names), names, classes))


@query
def text_call_rate(m: Model) -> DataFrame:
    """Missing targets and records by way of text, the Wild list in its file's order."""
    path = _vcf(m, m.records, "vcf-calls")
    names = vcf.read_header(m.spark, path)
    missing = tables.read_missing_targets(m.spark, _tsv(m, m.missing, "missing"))
    listed = fresh_path(m.spark, "wild-list")
    m.wild.coalesce(1).sortWithinPartitions("ord").select(F.concat(F.lit(" "), "sample_id", F.lit("\t")).alias("value")).write.text(listed)
    wild = tables.read_sample_list(m.spark, listed).join(m.wild.select("sample_id", "region"), "sample_id")
    ids = [r["sample_id"] for r in wild.orderBy("ord").collect()]  # the cohort
    return selection.call_rates(selection.carriers_in_record(vcf.read_records(m.spark, path, names), names, ids, missing), wild).drop("ord")


@query
def text_threshold_summary(m: Model) -> DataFrame:
    """The similarity table under other column names, and components of what is read back."""
    pairs = tables.read_pairs(m.spark, _tsv(m, m.pairs.select(F.col("a").alias("ID1"), F.concat(F.lit(" "), "b").alias("sample2"), F.col("pi_hat").alias("PIHAT")), "pairs"))
    pairs = relatedness.check_pairs(pairs, m.samples)
    return relatedness.global_summary(relatedness.solved(m.samples, pairs, relatedness.THRESHOLDS), pairs, relatedness.THRESHOLDS)


@query
def text_metadata(m: Model) -> DataFrame:
    """Sample metadata with other spellings of materials, null words and blank regions that a second column has."""
    even = F.col("ord") % 2 == 0
    material = F.when(F.col("material") == "Wild", F.when(even, "WILD").otherwise(" wild")).otherwise(F.when(even, "ex-situ").otherwise("Ex situ"))
    rows = m.samples.select(F.col("sample_id").alias("sampleid"), material.alias("Material"), F.when(F.col("garden") == "NA", "none").otherwise(F.col("garden")).alias("Garden"), F.when(even, "").otherwise(F.col("region")).alias("Region"), F.when(even, F.col("region")).otherwise("").alias("Registered_region"))
    return tables.read_metadata(m.spark, _tsv(m, rows, "metadata")).select("sample_id", "material", "garden", "region")


@query
def text_sampling_order(m: Model) -> DataFrame:
    """The quota table with its explicit drawing order."""
    rows = m.quotas.select("Plan", F.col("Region").alias("Region"), F.col("Quota").alias("Sample_N"), F.col("rng_order").alias("Random_sampling_order"))
    return control.sampling_order(tables.read_quotas(m.spark, _tsv(m, rows, "quotas")), m.wild)


@query
def text_alt_states_from_blocks(m: Model) -> DataFrame:
    """Multi-allelic records by way of block-gzip VCF in many tasks, with the cells of the collection only."""
    lines = m.spark.read.text(_vcf(m, m.multi_records, "vcf-states"))
    path = fresh_path(m.spark, "vcf-blocks")
    blocks.write_blocks(lines.repartition(8, F.xxhash64("value")).sortWithinPartitions(F.startswith("value", F.lit("#")).desc()), path)
    classes = [(r["SampleID"], r["Is_representative"], r["Ex_situ_site"]) for r in _status(m).select("SampleID", "Is_representative", "Ex_situ_site").collect()]  # the collection
    wanted = [s for s, _, _ in classes]
    names = vcf.read_header(m.spark, path)
    return altstates.coverage_summary(altstates.state_counts_in_record(vcf.read_records(m.spark, path, names, samples=wanted), wanted, classes))


@query
def text_carrier_cache(m: Model) -> DataFrame:
    """Carriers of the missing targets by way of a cache of hexadecimal bits: targets and their copies in the Wild panel by sample and frequency bin."""
    missing = _tsv(m, m.missing, "missing")
    targets = carriers.numbered_targets(tables.read_missing_targets(m.spark, missing))
    path = fresh_path(m.spark, "bits")
    carriers.write_carrier_cache(_per_target(m), targets, m.wild, missing, path)
    wild = [r["sample_id"] for r in m.wild.orderBy("ord").collect()]  # the cohort
    back = carriers.read_carrier_cache(m.spark, path, targets, wild)
    return back.select("Wild_MAF_bin", "Wild_minor_count", F.explode("carriers").alias("SampleID")).groupBy("SampleID", "Wild_MAF_bin").agg(F.count("*").alias("Carried_targets"), F.sum("Wild_minor_count").alias("Wild_minor_copies"))
