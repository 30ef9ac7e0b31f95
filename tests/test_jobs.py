"""The jobs against their SQL, over growing input, and run again."""

import json
import logging
import subprocess
import sys

import pytest
from compare import same
from pyspark.sql import functions as F

from jobs import allele_atlas, descriptor_stream
from jobs.common import load_config
from jobs.queries import JOB1_SQL, ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"
STREAM = load_config(descriptor_stream.CONFIG, descriptor_stream.KEYS)
ATLAS = load_config(allele_atlas.CONFIG, allele_atlas.KEYS)
TEXTS = "text string, lang string, source string, n_chars long"


def table(spark, path):
    return sorted(map(tuple, (df := spark.read.parquet(path)).select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    same(QUERIES[name](spark, FOLDER), ORACLE_SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_calls_share_nothing(spark, name):
    one, two = QUERIES[name](spark, "/root/testdata/sf0.001"), QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not set(one.inputFiles()) & set(two.inputFiles())
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_stream_takes_only_new_texts(spark, tmp_path, caplog):
    texts, out, mark = (str(tmp_path / n) for n in ("texts.parquet", "out", "checkpoint"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    run = lambda: descriptor_stream.run(spark, texts, out, mark, {**STREAM, "files_per_batch": 1})
    with caplog.at_level(logging.INFO, "jobs"):
        docs.where("doc_id % 3 = 0").repartition(2).write.parquet(texts)
        path = run()
        first, read = table(spark, path), [r.getMessage() for r in caplog.records]
        assert any(m.startswith("read 334 new texts") for m in read) and sum("texts: wrote" in m for m in read) == 2
        caplog.clear()
        docs.where("doc_id % 3 > 0").repartition(3).write.mode("append").parquet(texts)
        run()
        second, read = table(spark, path), [r.getMessage() for r in caplog.records]
        assert any(m.startswith("read 666 new texts") for m in read) and sum("texts: wrote" in m for m in read) == 3
        caplog.clear()
        run()
        assert any(m.startswith("read 0 new texts") for m in (r.getMessage() for r in caplog.records))
    assert first != second and table(spark, path) == second
    got = spark.read.parquet(path)
    got = got.withColumn("Wild_minor_MAF", F.round("Wild_minor_MAF", 9))
    same(got, JOB1_SQL, FOLDER)


def test_repeated_batch_replaces_itself(spark, tmp_path):
    """A batch that failed after its counts were written comes again under its number."""
    texts, out, mark = (str(tmp_path / n) for n in ("texts.parquet", "out", "checkpoint"))
    spark.createDataFrame([("red fruit", "en", "src0", 1), ("no fruit", "en", "src1", 1), ("Red", "en", "src9", 1)], TEXTS).write.parquet(texts)
    path = descriptor_stream.run(spark, texts, out, mark, STREAM)
    once = table(spark, path)
    descriptor_stream.run(spark, texts, out, str(tmp_path / "other checkpoint"), STREAM)
    assert table(spark, path) == once and len(once) == 2


def test_stream_edges(spark, tmp_path):
    texts, out, mark = (str(tmp_path / n) for n in ("texts.parquet", "out", "checkpoint"))
    spark.createDataFrame([], TEXTS).write.parquet(texts)
    path = descriptor_stream.run(spark, texts, out, mark, STREAM)
    rows_ = [(None, "en", "src0", 1), ("Été été ÉTÉ 12 ab1c", "en", "src1", None), ("Été", None, "src2", 1), ("x", "en", "other", 1), ("x", "en", None, 1), ("ab x", "en", "src8", 1), ("ab x", "en", "src8", 1), ("", "en", "src19", 1)]
    spark.createDataFrame(rows_, TEXTS).write.mode("append").parquet(texts)
    descriptor_stream.run(spark, texts, out, mark, STREAM)
    got = {(r.chrom, r.pos): r for r in spark.read.parquet(path).collect()}
    # Only ASCII letters change case; "x" is in no wild text; the lone text of no language cannot vary.
    assert set(got) == {("en", w) for w in ("Été", "été", "ÉtÉ", "ab", "c")} - {("en", "ÉtÉ")} | {("en", "ÉTÉ".translate(str.maketrans("T", "t")))}
    ab = got["en", "ab"]
    assert (ab.Wild_AC, ab.Wild_AN, ab.Pingshun_AC, ab.Pingshun_AN, ab.Zhendong_AC, ab.Zhendong_AN, ab.Tongguan_AN, ab.Ex_situ_AC, ab.Ex_situ_AN) == (1, 2, 2, 2, 0, 1, 0, 2, 3)


def test_atlas_refreshes_what_it_was_asked_for(spark, tmp_path, caplog):
    src = tmp_path / "tables"
    for name in ("region", "nation", "supplier", "lineitem"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(str(src / f"{name}.parquet"))
    out = str(tmp_path / "out")
    path = allele_atlas.run(spark, str(src), out, ATLAS)
    all_ = table(spark, path)
    assert table(spark, allele_atlas.run(spark, str(src), out, ATLAS)) == all_
    # The collection now holds every allele of chr3, and chr2 has lost its calls.
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").where("l_partkey % 5 <> 2")
    held = spark.read.parquet(f"{FOLDER}/supplier.parquet").where("s_nationkey = 2").first().s_suppkey
    more = lines.where("l_partkey % 5 = 3").drop("l_discount", "l_quantity", "l_suppkey").dropDuplicates(["l_partkey"]).crossJoin(spark.createDataFrame([(0.09, 0.0, held), (0.0, 99.0, held)], "l_discount double, l_quantity double, l_suppkey long"))
    lines.unionByName(more).write.mode("overwrite").parquet(str(src / "lineitem.parquet"))
    with caplog.at_level(logging.INFO, "jobs"):
        allele_atlas.run(spark, str(src), out, ATLAS, ["chr2", "chr3"])
    said = [r.getMessage() for r in caplog.records]
    assert any("wrote 0 rows" in m for m in said) and any(m.startswith("read ") and "calls of Wild" in m for m in said)
    at = sorted(spark.read.parquet(path).columns).index("chrom")
    kept = [r for r in all_ if r[at] not in ("chr2", "chr3")]
    assert table(spark, path) == kept and len(kept) < len(all_)
    with pytest.raises(ValueError, match="chr9"):
        allele_atlas.run(spark, str(src), out, ATLAS, ["chr9"])


def test_command_lines(tmp_path):
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    config = tmp_path / "atlas.json"
    config.write_text(json.dumps(ATLAS))
    done = subprocess.run([sys.executable, "-m", "jobs.allele_atlas", "--tables", "/root/testdata/sf0.001", "--output", str(tmp_path / "out"), "--config", str(config)], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr
    config.write_text(json.dumps({**ATLAS, "unknown": 1}))
    with pytest.raises(ValueError, match="unknown"):
        load_config(config, allele_atlas.KEYS)
