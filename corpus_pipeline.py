"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import jaccard, lines, packing, weaklabels
from verdance.llm.common import table
from verdance.shipping import ship
from verdance.storage import drop_tables, materialize, recorded

#: Near duplicates: words of a shingle, and the similarity in hundredths.
WORDS, ALIKE = 5, 80
#: Chunks of text that a worker remembers when it packs: its memory also holds what the stages before have left.
REMEMBERED = 150_000
#: The operators' columns have names of their own here, so that a column of the input that is called like one keeps its values.
OWN = "__pipeline_"


_left = threading.local()


def _stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that first drops the tables which the stages before it, in this thread, have left.

    Their results are written by then, so nothing reads those tables any more;
    where ``docs`` still does, they stay.
    """

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = getattr(_left, "tables", [])
        if left and not any(t in file for file in docs.inputFiles() for t in left):
            drop_tables(spark, left)
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _left.tables = [*left, *made]
        return out

    return run


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; those without words are among them, and so are null texts.

    Repeated rows, equal and null ids are judged row by row; an empty table stays empty.
    """
    ship(spark)
    return weaklabels.quality(docs, prefix=OWN).where(OWN + "kept").select(*docs.columns)


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines leave the texts, and ``n_chars`` follows; every row stays.

    Copies of whole documents keep their text: the next stage removes them as documents.
    Repeated rows keep their number and get equal texts; null texts stay null; an empty table stays empty.
    """
    out = lines.dedup_lines(docs, keep_whole_copies=True, prefix=OWN).select(*docs.columns)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else out


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: of those with the smallest id.

    Rows are judged one by one, also where ids repeat: a row that is like no
    other stays, whatever else has its id; of rows with equal id and text one
    stays, and it is not stated which.  Rows with a null id and texts without
    words are no one's copy; an empty table stays empty.
    """
    ship(spark)
    found = jaccard.jaccard_components(docs, size=WORDS, num=ALIKE, den=100).where("component is not null")
    groups = found.groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.count("*").alias("size")).where("size > 1").drop("size")
    # One row for each id and text of a group: whether it stays, and whether it must be made one row first.
    rows = found.groupBy("component", "id", "text_hash").agg(F.count("*").alias("copies")).join(groups, "component")
    judged = rows.select(F.col("id").alias(OWN + "id"), F.col("text_hash").alias(OWN + "hash"), (F.struct("id", "text_hash") == F.col("first")).alias(OWN + "stays"), (F.col("copies") > 1).alias(OWN + "repeats"))
    judged = materialize(judged.where(f"not {OWN}stays or {OWN}repeats"), "near-duplicates")
    hashed = docs.withColumn(OWN + "text", F.xxhash64("text"))
    same = (F.col("doc_id") == F.col(OWN + "id")) & (F.col(OWN + "text") == F.col(OWN + "hash"))
    kept = hashed.join(judged, same, "left_anti").select(*docs.columns)
    again = judged.where(f"{OWN}stays")
    if again.isEmpty():
        return kept
    one = hashed.join(again, same, "left_semi").dropDuplicates(["doc_id", OWN + "text"])
    return kept.unionByName(one.select(*docs.columns))


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens.

    Every row is a document, also a repeated one or one without an id; a null or empty text is its end id alone; an empty table has no pieces.
    """
    ship(spark)
    return packing.harmonic_pack(packing.pieces(docs, public_tokenizers.path(packing.VOCABULARY), remembered=REMEMBERED))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Fitted weights and a tokenizer are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
