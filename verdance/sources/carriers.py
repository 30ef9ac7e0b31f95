"""Carrier caches of other tools: one gzip JSON document with the targets of each sample as the bits of a hexadecimal number.

Bit ``idx`` is the target at place ``idx``, from 0, of the missing table; bits
are turned into rows and back with SQL functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdance.operators.checks import ValidationError, assert_empty

SCHEMA = "format_version int, missing_table string, target_count long, wild_sample_order array<string>, sample_bits_hex map<string, string>, called_sites map<string, long>"
#: Hexadecimal digits that one row expands; digits of a Spark bitmap of 32,768 bits.
DIGITS, BITMAP_DIGITS = 1024, 8192
#: Characters of a document that may be written: it is one value of one task. Beyond that the Parquet table is the cache.
LIMIT = 1 << 28


def numbered_targets(missing: DataFrame) -> DataFrame:
    """A table just read from files with ``idx``, the place of each row in it, from 0 and without gaps; several files are taken by name."""
    rows = missing.withColumns({"__file": F.input_file_name(), "__at": F.monotonically_increasing_id()}).withColumn("__part", F.shiftright("__at", 33))
    sizes = rows.groupBy("__file", "__part").agg(F.count("*").alias("__n"))  # a row for each file and task
    before = F.sum("__n").over(Window.orderBy("__file", "__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__file", "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    # Numbers of a task run on over its files, so the place inside a file counts from the file's first.
    first = rows.groupBy("__file", "__part").agg(F.min("__at").alias("__first"))
    out = rows.join(F.broadcast(starts.join(first, ["__file", "__part"])), ["__file", "__part"])
    return out.withColumn("idx", F.col("__before") + F.col("__at") - F.col("__first")).drop("__file", "__part", "__at", "__before", "__first")


def document_size(n_samples: int, n_targets: int) -> int:
    """Characters of a cache's hexadecimal numbers."""
    return n_samples * (n_targets // 4 + 1)


def write_carrier_cache(per_target: DataFrame, targets: DataFrame, wild: DataFrame, missing_table: str, path: str) -> None:
    """Write ``per_target(CHROM, POS, carriers, called)`` as a cache, a folder with one gzip part.

    ``targets`` has ``(CHROM, POS, idx)``, ``wild`` ``(sample_id, ord)``.  A
    sample that carries nothing has ``0x0``.  A document that could pass
    ``LIMIT`` is an error.
    """
    n, samples = targets.count(), wild.count()
    if document_size(samples, n) > LIMIT:
        raise ValidationError(f"{samples} samples by {n} targets are too many for one document")
    numbered = per_target.join(targets.select("CHROM", "POS", "idx"), ["CHROM", "POS"])
    at = F.col("idx") + 1
    maps = numbered.select("idx", F.explode("carriers").alias("sample_id")).groupBy("sample_id", F.bitmap_bucket_number(at).alias("bucket")).agg(F.hex(F.bitmap_construct_agg(F.bitmap_bit_position(at))).alias("h"))
    # Bitmaps have their lowest byte first and a byte's high digit first: turn the digits round, then each byte's two.
    maps = maps.withColumn("h", F.lower(F.regexp_replace(F.reverse("h"), "(.)(.)", "$2$1")))
    joined = maps.groupBy("sample_id").agg(F.max("bucket").alias("top"), F.map_from_entries(F.collect_list(F.struct("bucket", "h"))).alias("m"))
    whole = F.array_join(F.transform(F.sequence("top", F.lit(1), F.lit(-1)), lambda k: F.coalesce(F.element_at("m", k), F.repeat(F.lit("0"), BITMAP_DIGITS))), "")
    bits = joined.select("sample_id", F.concat(F.lit("0x"), F.ltrim(whole, F.lit("0"))).alias("hex"))
    called = numbered.select(F.explode("called").alias("sample_id")).groupBy("sample_id").agg(F.count("*").alias("n"))
    rows = wild.join(bits, "sample_id", "left").join(called, "sample_id", "left").select("sample_id", "ord", F.coalesce("hex", F.lit("0x0")).alias("hex"), F.coalesce("n", F.lit(0)).alias("n"))
    of = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("sample_id", c))))
    order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "sample_id"))), lambda x: x["sample_id"])
    doc = rows.agg(of("n").alias("called_sites"), F.lit(1).alias("format_version"), F.lit(missing_table).alias("missing_table"), of("hex").alias("sample_bits_hex"), F.lit(n).alias("target_count"), order.alias("wild_sample_order"))
    doc.select(F.to_json(F.struct(*doc.columns)).alias("value")).coalesce(1).write.option("compression", "gzip").text(path)


def read_carrier_cache(spark: SparkSession, path: str, targets: DataFrame, wild: Sequence[str]) -> DataFrame:
    """``(CHROM, POS, Wild_minor_count, Wild_MAF_bin, carriers)`` of the numbered ``targets`` from a cache, carriers in order of their ids.

    An error: another format version, samples other than ``wild`` or in another
    order, a number of targets that differs, text that is no hexadecimal
    number, bits beyond the targets.
    """
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    found = doc.select("format_version", "target_count", "wild_sample_order", F.map_keys("sample_bits_hex").alias("keys")).head(2)  # names of the cohort
    if len(found) != 1 or found[0]["format_version"] != 1:
        raise ValidationError(f"{path} is no carrier cache of format 1")
    head, n = found[0], targets.count()
    if head["wild_sample_order"] != list(wild):
        raise ValidationError("the carrier cache has other Wild samples, or in another order")
    if sorted(head["keys"] or []) != sorted(wild):
        raise ValidationError("the samples with bits are not those of the carrier cache's order")
    if head["target_count"] != n:
        raise ValidationError(f"the carrier cache has {head['target_count']} targets, the missing table {n}")
    rows = doc.select(F.explode("sample_bits_hex").alias("sample_id", "hex"))
    assert_empty(rows.where("hex is null or not hex rlike '^0[xX][0-9a-fA-F]+$'").select("sample_id", F.substring("hex", 1, 40).alias("hex")), "bits that are no hexadecimal numbers")
    parts = rows.select("sample_id", F.reverse(F.substr("hex", F.lit(3))).alias("digits"))
    parts = parts.select("sample_id", "digits", F.explode(F.sequence(F.lit(0), F.floor((F.length("digits") - 1) / DIGITS).cast("int"))).alias("part"))
    # The document is read in one task; its bits are expanded in all.
    parts = parts.select("sample_id", "part", F.substr("digits", F.col("part") * DIGITS + 1, F.lit(DIGITS)).alias("digits")).repartition("sample_id", "part")
    each = parts.select("sample_id", "part", F.posexplode(F.split("digits", "")).alias("at", "digit")).where("digit not in ('0', '')")
    value = F.conv("digit", 16, 10).cast("int")
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda b: F.getbit(F.col("value"), b) == 1)
    bits = each.withColumn("value", value).select("sample_id", ((F.col("part").cast("long") * DIGITS + F.col("at")) * 4).alias("low"), F.explode(set_bits).alias("b")).select("sample_id", (F.col("low") + F.col("b")).alias("idx"))
    assert_empty(bits.where(F.col("idx") >= n), "bits beyond the targets")
    carried = bits.groupBy("idx").agg(F.array_sort(F.collect_list("sample_id")).alias("carriers"))  # at most the cohort
    return targets.join(carried, "idx", "left").select("CHROM", "POS", "Wild_minor_count", "Wild_MAF_bin", F.coalesce("carriers", F.array().cast("array<string>")).alias("carriers"))
