"""Sites, samples and genotypes read off the star-schema test tables.

A site is a part modulo the number of sites, a sample one of the first hundred
suppliers, and an allele a rule over discount and quantity of an order line; the
first two lines of a site and sample are its genotype.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdance.functions import alleles as A
from verdance.functions import genotypes as G
from verdance.operators import inrecord
from verdance.operators import representation as R
from verdance.storage import materialize

#: Regional quotas of the two plans, cut to what a region has.
QUOTAS = {"Plan_A": {"AFRICA": 1, "AMERICA": 2, "MIDDLE EAST": 1}, "Plan_B": {"AFRICA": 3, "AMERICA": 3, "MIDDLE EAST": 3}}
WEIGHTS = {"MAF_le_0.01": 1.0, "0.01_lt_MAF_le_0.05": 2.0, "0.05_lt_MAF_le_0.10": 2.0}
WILD_REGIONS = ("AFRICA", "AMERICA", "MIDDLE EAST")
#: Sites that one task sorts and aggregates at most, whatever the number of shuffle partitions: its memory does not grow with the tables.
SITES_A_TASK = 4096
#: Bits that a call takes in a site's numbers, calls in a number, and what the bits mean: nothing, or two alleles of which the second may be absent.
BITS, IN_NUMBER = 4, 15
MEANT = [(None, None), *[(a, b) for a in "012" for b in "012."]]


class Model:
    """The canonical relations over one folder of test tables; every property is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def samples(self) -> DataFrame:
        """``(sample_id, ord, material, garden, region)``."""
        home = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows
        rows = self.table("supplier").where("s_suppkey < 100").join(F.broadcast(home), F.col("s_nationkey") == F.col("n_nationkey"))
        wild = F.col("n_regionkey").isin(0, 1, 4)
        garden = F.when(F.col("n_regionkey") == 2, "Pingshun").when(F.col("n_regionkey") == 3, F.when(F.col("n_nationkey") % 2 == 0, "Tongguan").otherwise("Zhendong")).otherwise("NA")
        return rows.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample_id"), F.col("s_suppkey").cast("int").alias("ord"), F.when(wild, "Wild").otherwise("Ex_situ").alias("material"), garden.alias("garden"), F.when(wild, F.col("r_name")).otherwise("NA").alias("region"))

    @property
    def wild(self) -> DataFrame:
        return self.samples.where("material = 'Wild'")

    @property
    def collection(self) -> DataFrame:
        return self.samples.where("material = 'Ex_situ'")

    @property
    def calls(self) -> DataFrame:
        """``(p, chrom, pos, sample_id, material, garden, region, ord, a1, a2, gt, dp, gq)``."""
        two = self._two().join(F.broadcast(self.samples), "ord")  # 100 rows at most
        p, gt = F.col("p"), F.concat(F.col("a1").cast("string"), F.lit("/"), F.coalesce(F.col("a2").cast("string"), F.lit(".")))
        return two.select("p", *self._site(p), "sample_id", "material", "garden", "region", "ord", "a1", "a2", gt.alias("gt"), F.col("q").cast("int").cast("string").alias("dp"), (F.rint(F.col("t") * 100).cast("int") * 10).cast("string").alias("gq"))

    @staticmethod
    def _site(p) -> list:
        return [F.concat(F.lit("chr"), (p % 5).cast("string")).alias("chrom"), p.cast("string").alias("pos")]

    def _two(self) -> DataFrame:
        """The first two lines of each site and sample: ``(p, ord, a1, a2, q, t)``.

        Lines are dealt by site and sorted by site and sample, so the window here and all that is grouped by ``p`` later share one exchange.
        """
        m = max(200, self.table("part").count() // 10)
        rare = F.col("l_discount") >= 0.05
        p = F.col("p")
        minor_ref = F.when(rare & (F.col("l_quantity") <= 1 + p % 10), 0).otherwise(1)
        minor_alt = F.when(rare & (F.col("l_quantity") <= F.when(p % 10 == 9, 20).otherwise(p % 10)), 1).otherwise(0)
        lines = self.table("lineitem").select((F.col("l_partkey") % m).alias("p"), (F.col("l_suppkey") % 100).cast("int").alias("ord"), "l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_tax")
        tasks = -(-m // SITES_A_TASK)
        dealt = lines.repartition(tasks, "p") if tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else lines.repartition("p")
        rows = dealt.withColumn("a", F.when(p % 23 == 0, minor_ref).otherwise(minor_alt)).withColumn("cell", p * 100 + F.col("ord"))
        w = Window.partitionBy("cell", "p", "ord").orderBy("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_tax")
        return rows.select("p", "ord", F.row_number().over(w).alias("rn"), F.col("a").alias("a1"), F.lead("a").over(w).alias("a2"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("t")).where("rn = 1").drop("rn")

    @property
    def acan(self) -> DataFrame:
        """``(grp, chrom, pos, alt_ac, an)`` of the five groups, each site once in each."""
        ac = F.col("a1") + F.coalesce("a2", F.lit(0))
        an = F.when(F.col("a2").isNull(), 1).otherwise(2)
        site = self.calls.groupBy("p", "chrom", "pos").agg(*[F.coalesce(F.sum(F.when(self._in(g), x)), F.lit(0)).alias(f"{g}_{n}") for g in R.GROUPS for n, x in (("ac", ac), ("an", an))])
        parts = F.array(*[F.struct(F.lit(g).alias("grp"), F.col(f"{g}_ac").alias("alt_ac"), F.col(f"{g}_an").alias("an")) for g in R.GROUPS])
        return site.select("chrom", "pos", F.explode(parts).alias("x")).select("x.grp", "chrom", "pos", "x.alt_ac", "x.an")

    @staticmethod
    def _in(group: str):
        return F.col("material") == group if group in ("Wild", "Ex_situ") else F.col("garden") == group

    @property
    def universe(self) -> DataFrame:
        return R.targets(R.align(self.acan, check=False))

    @property
    def missing(self) -> DataFrame:
        return R.missing_targets(self.universe)

    @property
    def regional(self) -> DataFrame:
        """Allele counts of the Wild regions at the missing targets: ``(region, chrom, pos, alt_ac, an)``."""
        sites = self.missing.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"))
        ac = F.col("a1") + F.coalesce("a2", F.lit(0))
        got = self.calls.where("material = 'Wild'").join(sites, ["chrom", "pos"], "left_semi").groupBy("region", "chrom", "pos").agg(F.sum(ac).alias("alt_ac"), F.sum(F.when(F.col("a2").isNull(), 1).otherwise(2)).alias("an"))
        every = sites.crossJoin(A.dimension(self.spark, region=list(WILD_REGIONS)))
        return every.join(got, ["region", "chrom", "pos"], "left").select("region", "chrom", "pos", F.coalesce("alt_ac", F.lit(0)).alias("alt_ac"), F.coalesce("an", F.lit(0)).alias("an"))

    @property
    def region_sizes(self) -> DataFrame:
        sizes = self.wild.groupBy(F.col("region").alias("Region")).agg(F.count("*").alias("Wild_sample_N"))
        return A.dimension(self.spark, Region=list(WILD_REGIONS)).join(sizes, "Region")

    @cached_property
    def held_pairs(self) -> DataFrame:
        """``pairs``, at most one for two of a hundred samples, written once: components read them several times."""
        return materialize(self.pairs, "pairs")

    @property
    def pairs(self) -> DataFrame:
        """``(a, b, pi_hat)``: a similarity of each pair of samples from all orders that name both; few are high, so that the graph has components."""
        orders = self.table("orders")
        one, two = F.col("o_custkey") % 100, F.expr("(o_orderkey div 7) % 100")
        rows = orders.select(F.least(one, two).alias("i"), F.greatest(one, two).alias("j"), F.expr("cast(floor(o_totalprice) as bigint)").alias("v")).where("i <> j")
        rows = rows.groupBy("i", "j").agg((F.sum("v") % 1000 / F.lit(1000.0)).alias("s"))
        for power in (2, 4, 8, 16):  # the same products in the same order as the SQL
            rows = rows.withColumn(f"s{power}", F.col("s" if power == 2 else f"s{power // 2}") * F.col("s" if power == 2 else f"s{power // 2}"))
        rows = rows.select("i", "j", (F.col("s16") * F.col("s8")).alias("pi_hat"))
        known = self.samples.select("sample_id", "ord")
        name = lambda c, n: known.select(F.col("ord").cast("long").alias(c), F.col("sample_id").alias(n))
        return rows.join(F.broadcast(name("i", "x")), "i").join(F.broadcast(name("j", "y")), "j").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "pi_hat")

    @property
    def roh(self) -> DataFrame:
        """``(SampleID, NSEG_2_5Mb, NSEG_gt5Mb)`` from all events, users folded onto the samples: a value is a length of as many tens of kilobases; every seventh sample has one count only."""
        kb = F.col("value") * 10
        got = self.table("events").groupBy((F.col("user_id") % 100).cast("int").alias("ord")).agg(F.count_if((kb > 4200) & (kb <= 4600)).alias("m"), F.count_if(kb > 4600).alias("l"))
        z = lambda c: F.coalesce(c, F.lit(0)).cast("string")
        one_count = F.when(F.col("ord") % 7 == 3, "NA").otherwise(z("m"))
        return self.samples.join(got, "ord", "left").select(F.col("sample_id").alias("SampleID"), one_count.alias("NSEG_2_5Mb"), z("l").alias("NSEG_gt5Mb"))

    @property
    def quotas(self) -> DataFrame:
        """``(Plan, Region, Quota, rng_order)``, no more than a region has."""
        rows = [("Greedy_" + p, r, q, i) for p, quota in QUOTAS.items() for i, (r, q) in enumerate(quota.items())]
        plan = A.dimension(self.spark, Plan=[r[0] for r in rows], Region=[r[1] for r in rows], q=[r[2] for r in rows], rng_order=[r[3] for r in rows])
        return plan.join(F.broadcast(self.region_sizes), "Region").select("Plan", "Region", F.least("q", F.col("Wild_sample_N")).cast("int").alias("Quota"), "rng_order")

    def quota_of(self, plan: str) -> dict[str, int]:
        return {r["Region"]: r["Quota"] for r in self.quotas.where(F.col("Plan") == plan).orderBy("rng_order").collect()}

    @property
    def names(self) -> list[str]:
        """All samples in the order of a record's cells: the cohort."""
        return list(self.cohort.values())

    @cached_property
    def cohort(self) -> dict[int, str]:
        return {r["ord"]: r["sample_id"] for r in self.samples.orderBy("ord").collect()}

    @staticmethod
    def _packed() -> list:
        """Aggregates of a site's calls ``(ord, a1, a2)`` into a few numbers: a hash aggregation of fixed width, which keeps no list of strings and sorts nothing."""
        code = (F.col("a1") * 4 + F.coalesce("a2", F.lit(3)) + 1).cast("long")
        bits = F.call_function("shiftleft", code, (F.col("ord") % IN_NUMBER * BITS).cast("int"))
        return [F.bit_or(F.when(F.expr(f"ord div {IN_NUMBER}") == k, bits).otherwise(F.lit(0).cast("long"))).alias(f"n{k}") for k in range(-(-100 // IN_NUMBER))]

    def _cells(self, sep: str) -> list:
        """Format and array of cells that a VCF record has, from the numbers of ``_packed``; a sample without a call has a dot."""
        text = F.array(*[F.lit("." if a is None else f"{a}{sep}{b}") for a, b in MEANT])

        def part(k: int):
            places = F.array(*[F.lit(n % IN_NUMBER * BITS) for n in self.cohort if n // IN_NUMBER == k]).cast("array<int>")
            return F.transform(places, lambda n: F.element_at(text, F.call_function("shiftright", F.col(f"n{k}"), n).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") + 1))

        return [F.lit("GT").alias("format"), F.concat(*[part(k) for k in range(-(-100 // IN_NUMBER))]).alias("cells")]

    @property
    def records(self) -> DataFrame:
        """Biallelic records ``(chrom, pos, ref, alt, format, cells)``, one for each site."""
        site = self._two().where(F.col("ord").isin(list(self.cohort))).groupBy("p").agg(*self._packed())
        return site.select(*self._site(F.col("p")), F.lit("A").alias("ref"), F.lit("C").alias("alt"), *self._cells("/"))

    @cached_property
    def held_records(self) -> DataFrame:
        """``records``, written once for the steps that read all calls several times."""
        return materialize(self.records, "site-records")

    @property
    def held_targets(self) -> DataFrame:
        """``missing`` with the target's code and its record's ``format`` and ``cells``, in one pass over ``held_records``: nothing is joined, and the lines are not read again."""
        groups = {g: [r["sample_id"] for r in self.samples.where(self._in(g)).collect()] for g in ("Wild", "Ex_situ")}  # the cohort
        held = ("format", "cells")
        counted = inrecord.group_counts(self.held_records, self.names, groups, inrecord.STRICT, carried=held)
        sites = counted.select("chrom", "pos", *held, *[x for g in groups for x in (F.get(f"{g}_AC", F.lit(1)).alias(f"{g}_AC"), F.col(f"{g}_AN"))])
        return R.missing_targets(R.targets(sites, ("Ex_situ",)), *held).withColumn("cells", F.when(F.col("POS").isNotNull(), F.col("cells"))).withColumn("code", G.target_code(F.col("Wild_minor_allele")))  # lines without a part have no place, as a join by it would find

    @property
    def multi_records(self) -> DataFrame:
        """Records with several alternatives, star alleles, lower case and equal bases, with the collection's calls."""
        return self._multi().groupBy("p", "chrom", "pos", "ref", "alt").agg(*self._packed()).select("chrom", "pos", "ref", "alt", *self._cells("|"))

    def _multi(self) -> DataFrame:
        """Calls of the collection with several alternatives, star alleles, lower case and equal bases: ``(p, chrom, pos, ref, alt, ord, a1, a2)``."""
        p = F.col("p")
        alt = reduce(lambda rest, case: F.when(p % case[0] == 0, case[1]).otherwise(rest), [(17, "A"), (13, "g"), (11, "C,*"), (7, "G,T")], F.lit("C"))
        ref = F.when((p % 13 == 0) & (p % 7 != 0) & (p % 11 != 0), "a").otherwise("A")
        second = ((p % 7 == 0) | (p % 11 == 0)) & (F.col("ord") % 2 == 0)
        code = lambda c: F.when(second & (F.col(c) == 1), 2).otherwise(F.col(c)).alias(c)
        return self.calls.where("material = 'Ex_situ'").select("p", "chrom", "pos", ref.alias("ref"), alt.alias("alt"), "ord", code("a1"), code("a2"))
