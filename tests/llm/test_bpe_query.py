"""The byte-level BPE query as a whole, against the public library."""

import base64
import hashlib
import struct

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from verdance.llm.queries import QUERIES
from verdance.shipping import ship


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def answers(texts):
    enc = library()
    out = []
    for doc_id, text in texts:
        ids = enc.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=repr)


def test_all_columns_of_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(QUERIES["op2_byte_bpe"](spark, folder)) == answers([(r.doc_id, r.text) for r in docs])


def test_odd_tables(spark, tmp_path):
    """Nulls, blanks, repeated rows, one very long word, columns named like results, and no rows at all."""
    ship(spark)
    texts = [(1, None), (2, ""), (3, " \n\t "), (3, " \n\t "), (None, "no id"), (None, None), (4, "x" * 50_000), (5, "Straße 中文 😀 it's 12345"), (5, "another text of the same id")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(1))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(QUERIES["op2_byte_bpe"](spark, str(tmp_path))) == answers(texts)
    df.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert QUERIES["op2_byte_bpe"](spark, str(tmp_path / "none")).collect() == []
