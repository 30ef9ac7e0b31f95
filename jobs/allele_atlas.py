"""Atlas of the Wild alleles that the collection lacks: where in the wild each occurs, by chromosome.

Calls are order lines: the part is the site, the supplier the sampled accession,
the supplier's nation its origin.  A run counts alleles by cohort and region,
finds the targets that the collection lacks and writes each with the regions
that hold it.  Chromosomes can be refreshed one by one: a run replaces the
partitions of the chromosomes it was asked for and leaves the others.

    python -m jobs.allele_atlas --tables FOLDER --output FOLDER [--chromosome chr3 ...] [--config jobs/allele_atlas.json]
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import load_config, log, to_stderr, write_counted
from verdance.functions import alleles as A
from verdance.functions.text import canonical_region
from verdance.operators import regions, representation
from verdance.operators.checks import duplicates
from verdance.storage import materialize

CONFIG = Path(__file__).with_suffix(".json")
KEYS = ("wild_regions", "gardens", "n_chromosomes", "rare_discount")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def accessions(spark: SparkSession, folder: str, config: Mapping[str, Any]) -> DataFrame:
    """``(accession, grp, region)`` of the suppliers whose nation is wild or belongs to a garden; ids that come twice are left out."""
    garden = F.create_map(*[F.lit(x) for g, nations in config["gardens"].items() for n in nations for x in (n, g)])
    home = read(spark, folder, "nation").join(read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wild = F.col("r_name").isin(*config["wild_regions"])
    home = home.select("n_nationkey", F.when(wild, "Wild").otherwise(F.element_at(garden, F.col("n_name"))).alias("grp"), F.when(wild, canonical_region(F.col("r_name"))).otherwise("NA").alias("region")).where("grp is not null")
    suppliers = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("accession"), F.col("s_nationkey").alias("n_nationkey"))
    twice = duplicates(suppliers, "accession")
    return suppliers.join(twice, "accession", "left_anti").join(home, "n_nationkey").select("accession", "grp", "region")


def allele_counts(spark: SparkSession, folder: str, config: Mapping[str, Any], chromosomes: Sequence[str]) -> DataFrame:
    """``(grp, region, chrom, pos, alt_ac, an)``: one row for each site, cohort and region, all lines counted."""
    p = F.col("l_partkey")
    chrom = F.concat(F.lit("chr"), (p % config["n_chromosomes"]).cast("string"))
    lines = read(spark, folder, "lineitem").select("l_suppkey", p.cast("string").alias("pos"), chrom.alias("chrom"), p.alias("p"), "l_discount", "l_quantity")
    lines = lines.where(F.col("chrom").isin(*chromosomes) & F.col("l_quantity").isNotNull() & F.col("l_discount").isNotNull())
    most = F.when(F.col("p") % 10 == 9, 20).otherwise(F.col("p") % 10)
    alt = (F.col("l_discount") >= config["rare_discount"]) & (F.col("l_quantity") <= most)
    own = lines.join(accessions(spark, folder, config), F.col("l_suppkey") == F.col("accession"))
    return own.groupBy("grp", "region", "chrom", "pos").agg(F.count_if(alt).alias("alt_ac"), F.count("*").alias("an"))


def run(spark: SparkSession, tables: str, output: str, config: Mapping[str, Any], chromosomes: Sequence[str] = ()) -> str:
    """One run over the chromosomes asked for, or all; the path of the atlas, partitioned by chromosome.

    Lines without quantity or discount are no calls; lines of unknown
    accessions are left out.  Regions of the configuration may be spelled in
    any way the library knows.
    """
    every = [f"chr{k}" for k in range(config["n_chromosomes"])]
    unknown = sorted(set(chromosomes) - set(every))
    if unknown:
        raise ValueError(f"unknown chromosomes {unknown}")
    wanted = list(chromosomes) or every
    counted = materialize(allele_counts(spark, tables, config, wanted), "atlas-counts")
    seen = counted.groupBy("grp").agg(F.sum("an").alias("calls"), F.count_distinct("chrom", "pos").alias("sites")).orderBy("grp").collect()  # one row for each cohort
    for r in seen:
        log.info("read %d calls of %s at %d sites from %s", r["calls"], r["grp"], r["sites"], tables)

    total = lambda df: df.groupBy("grp", "chrom", "pos").agg(F.sum("alt_ac").alias("alt_ac"), F.sum("an").alias("an"))
    cohorts = total(counted).unionByName(total(counted.where("grp <> 'Wild'").withColumn("grp", F.lit("Ex_situ"))))
    missing = materialize(representation.missing_targets(representation.targets(representation.align(cohorts, check=False))), "atlas-missing")
    named = list(spark.range(1).select(*[canonical_region(F.lit(r)).alias(f"r{i}") for i, r in enumerate(config["wild_regions"])]).first())
    sites = missing.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"))
    regional = counted.where("grp = 'Wild'").join(sites, ["chrom", "pos"], "left_semi").select("region", "chrom", "pos", "alt_ac", "an")
    atlas = regions.occurrence_by_site(missing, regional, named)
    columns = [F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in atlas.columns if c != "CHROM"]
    atlas = atlas.select(*columns, F.col("CHROM").alias("chrom"))
    path = f"{output.rstrip('/')}/atlas"
    if not chromosomes:
        write_counted(atlas, path, "missing alleles", ["chrom"])
        return path
    atlas = materialize(atlas, "atlas")
    for k in wanted:  # the few that were asked for; one without missing alleles is replaced by an empty partition
        write_counted(atlas.where(F.col("chrom") == k).drop("chrom"), f"{path}/chrom={k}", f"missing alleles of {k}", [])
    return path


def main() -> None:
    parser = argparse.ArgumentParser(prog="allele_atlas", description=__doc__.split("\n")[0])
    parser.add_argument("--tables", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--chromosome", action="append", default=[], help="may repeat; all without it")
    parser.add_argument("--config", default=str(CONFIG))
    args = parser.parse_args()
    to_stderr()
    spark = SparkSession.builder.appName("allele_atlas").getOrCreate()
    try:
        run(spark, args.tables, args.output, load_config(args.config, KEYS), args.chromosome)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
