"""Which descriptors of the Wild panel's passport texts the collection's texts also use, kept up as texts arrive.

A collection documents each accession with a text.  A word of a language is a
site, a text of that language that uses it carries the alternative allele, so
the library's representation operators tell how rare each word is in the Wild
panel's texts and which gardens' texts have it.

Texts come as Parquet files in one folder.  Each run takes the files that no
earlier run has taken (a file stream with a checkpoint, until nothing is left)
and adds one partition of counts for each batch; a batch that is repeated after
a failure replaces its own partition.  The table of targets is then built anew
from all counts and replaced whole, so a run without new files leaves it as it was.

    python -m jobs.descriptor_stream --texts FOLDER --output FOLDER --checkpoint FOLDER [--config jobs/descriptor_stream.json]
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import load_config, log, to_stderr, write_counted
from verdance.operators import representation

CONFIG = Path(__file__).with_suffix(".json")
KEYS = ("groups", "files_per_batch")
#: Runs of ASCII letters and of whatever is not ASCII.
WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
GARDENS = representation.GROUPS[2:]


def group_of(source: Column, groups: Mapping[str, list[str]]) -> Column:
    """The cohort that a source belongs to; null for a source that no cohort lists."""
    names = F.create_map(*[F.lit(x) for group, sources in groups.items() for s in sources for x in (s, group)])
    return F.element_at(names, source)


def words(text: Column) -> Column:
    """The distinct words of a text, ASCII letters in lower case; none for a null text."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(WORD), 0))


def batch_counts(texts: DataFrame, groups: Mapping[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """``(grp, chrom, an)``: texts by cohort and language, and ``(grp, chrom, pos, alt_ac)``: those of them that use a word."""
    known = texts.select(group_of(F.col("source"), groups).alias("grp"), F.coalesce("lang", F.lit("NA")).alias("chrom"), "text").where("grp is not null")
    totals = known.groupBy("grp", "chrom").agg(F.count("*").alias("an"))
    used = known.select("grp", "chrom", F.explode(words(F.col("text"))).alias("pos")).groupBy("grp", "chrom", "pos").agg(F.count("*").alias("alt_ac"))
    return totals, used


def allele_counts(totals: DataFrame, used: DataFrame) -> DataFrame:
    """``(grp, chrom, pos, alt_ac, an)`` of all cohorts and of the collection; a cohort whose texts lack a word has no copies of it, not no calls.

    Every word meets the cohorts of its language: a handful of rows for each language.
    """
    held = totals.groupBy("chrom", "grp").agg(F.sum("an").alias("an"))
    cohorts = held.groupBy("chrom").agg(F.map_from_entries(F.collect_list(F.struct("grp", "an"))).alias("an_of"))
    sites = used.groupBy("chrom", "pos").agg(*[F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("alt_ac"))), F.lit(0)).alias(g) for g in ("Wild", *GARDENS)])
    n = lambda g: F.coalesce(F.try_element_at("an_of", F.lit(g)), F.lit(0))
    total = lambda values: sum(values[1:], values[0])
    rows = [F.struct(F.lit(g).alias("grp"), F.col(g).alias("alt_ac"), n(g).alias("an")) for g in ("Wild", *GARDENS)]
    rows.append(F.struct(F.lit("Ex_situ").alias("grp"), total([F.col(g) for g in GARDENS]).alias("alt_ac"), total([n(g) for g in GARDENS]).alias("an")))
    return sites.join(cohorts, "chrom").select("chrom", "pos", F.explode(F.array(*rows)).alias("x")).select("x.grp", "chrom", "pos", "x.alt_ac", "x.an")


def run(spark: SparkSession, texts: str, output: str, checkpoint: str, config: Mapping[str, Any]) -> str:
    """One run; the path of the targets, partitioned by language, with one row for each word that some but not all of the language's Wild texts use.

    ``texts`` is a folder of Parquet files or one such file.  Null texts count as texts without words, a null language is ``NA``, texts of
    sources that no cohort lists are read and left out.  Rows are counted as
    they come, also repeated ones.
    """
    groups = config["groups"]
    unknown = set(groups) - {"Wild", *GARDENS}
    if unknown:
        raise ValueError(f"unknown cohorts {sorted(unknown)}")
    counts, totals, targets = (f"{output.rstrip('/')}/{name}" for name in ("counts", "totals", "targets"))
    schema = spark.read.parquet(texts).select("text", "lang", "source").schema

    taken: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        taken.append(batch.count())
        log.info("batch %d: read %d texts of %s", number, taken[-1], texts)
        of_texts, of_words = batch_counts(batch, groups)
        write_counted(of_texts.withColumn("batch", F.lit(number)), totals, f"batch {number}, texts", ["batch"], dynamic=True)
        write_counted(of_words.withColumn("batch", F.lit(number)), counts, f"batch {number}, words", ["batch", "chrom"], dynamic=True)

    stream = spark.readStream.schema(schema)
    if config.get("files_per_batch"):
        stream = stream.option("maxFilesPerTrigger", int(config["files_per_batch"]))
    # A file stream takes a plain path for a folder; as a pattern that only fits itself it may also be one file.
    source = texts.rstrip("/")
    query = stream.parquet(f"{source[:-1]}[{source[-1]}]").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new texts of %s", sum(taken), texts)

    # Without any batch so far there are no counts to read.
    of_texts = spark.read.schema("grp string, chrom string, an long, batch int")
    of_words = spark.read.schema("grp string, pos string, alt_ac long, batch int, chrom string")
    if taken or _written(spark, totals):
        sites = representation.align(allele_counts(of_texts.parquet(totals), of_words.parquet(counts)), check=False)
        write_counted(representation.targets(sites), targets, "targets", ["chrom"])
    return targets


def _written(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds a table there."""
    try:
        spark.read.schema("an long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def main() -> None:
    parser = argparse.ArgumentParser(prog="descriptor_stream", description=__doc__.split("\n")[0])
    for name in ("texts", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    args = parser.parse_args()
    to_stderr()
    spark = SparkSession.builder.appName("descriptor_stream").getOrCreate()
    try:
        run(spark, args.texts, args.output, args.checkpoint, load_config(args.config, KEYS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
