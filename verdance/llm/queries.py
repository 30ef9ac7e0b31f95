"""The corpus queries by name, and the SQL that DuckDB checks some of them with."""

from __future__ import annotations

from verdance.llm import bpe, gru, hnsw, jaccard, lines, middle, packing, sharding, simhash, toxicity, warc, weaklabels

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_embedding_dedup": hnsw.op3_embedding_dedup,
    "op4_quality": weaklabels.op4_quality,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_gru_lm": gru.op7_gru_lm,
    "op8_packing": packing.op8_packing,
    "op9_simhash": simhash.op9_simhash,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    "op11_fill_in_middle": middle.op11_fill_in_middle,
    "op12_toxicity": toxicity.op12_toxicity,
}

ORACLE_SQL = {"op1_warc": warc.OP1_SQL, "op3_embedding_dedup": hnsw.OP3_SQL, "op5_line_dedup": lines.OP5_SQL, "op10_ngram_jaccard": jaccard.OP10_SQL, "op11_fill_in_middle": middle.OP11_SQL}
