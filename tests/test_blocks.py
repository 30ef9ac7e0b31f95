"""The block-gzip source against a plain gzip reading of the same files."""

import gzip
import random

import pytest
import study
from pyspark.sql import functions as F

from verdance.config import load_config
from verdance.operators.checks import ValidationError
from verdance.plans import steps
from verdance.sources import blocks, vcf


def put(path, text: bytes, member=700):
    """A file of members of ``member`` bytes of text."""
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(blocks.packed(text[i : i + member]) for i in range(0, len(text), member)) + blocks.packed(b""))
    return str(path)


def lines_in_tasks(path, split):
    size = path.stat().st_size
    out = []
    for a in range(0, size, split):
        with open(path, "rb") as f:
            out.append(list(blocks.lines(f, size, a, min(a + split, size))))
    return out


def test_members_are_gzip(tmp_path):
    text = random.Random(1).randbytes(200_000).replace(b"\n", b"x")
    path = put(tmp_path / "a.gz", text, blocks.MEMBER)
    assert gzip.open(path).read() == text and blocks.is_block_gzip(path)
    (tmp_path / "b.gz").write_bytes(gzip.compress(text))
    assert not blocks.is_block_gzip(str(tmp_path / "b.gz")) and not blocks.is_block_gzip(str(tmp_path / "absent"))


@pytest.mark.parametrize("member", [1, 7, 64, 65_000])
def test_each_line_once_whatever_the_cuts(tmp_path, member):
    rng = random.Random(member)
    cases = [b"", b"\n", b"one", b"one\n", b"\n\ntwo\n\n", b"a\n" * 50, b"x" * 3000 + b"\n" + b"y\n" * 5 + b"z" * 900]
    cases += [b"\n".join(rng.randbytes(rng.choice([0, 1, 5, 80, 700])).replace(b"\n", b" ") for _ in range(30)) + rng.choice([b"", b"\n"]) for _ in range(4)]
    for text in cases:
        path = tmp_path / "t.gz"
        put(path, text, member)
        want = text.split(b"\n")
        want = want[:-1] if not want[-1] else want
        for split in (1 << 20, 997, 151, 40):
            got = lines_in_tasks(path, split)
            assert [x for part in got for x in part] == want, (text[:40], split)


def test_magic_bytes_inside_a_member_start_nothing(tmp_path):
    fake = b"\x1f\x8b\x08\x04" + bytes(6) + b"\x06\x00BC\x02\x00\x30\x00"
    path = tmp_path / "t.gz"
    stored = lambda t: blocks.packed(t)
    text = (fake + random.Random(3).randbytes(300).replace(b"\n", b" ") + b"\n") * 40
    path.write_bytes(b"".join(stored(text[i : i + 900]) for i in range(0, len(text), 900)))
    assert [x for part in lines_in_tasks(path, 300) for x in part] == text.split(b"\n")[:-1]


def test_a_broken_file_is_an_error(tmp_path):
    path = tmp_path / "t.gz"
    put(path, b"line\n" * 4000)
    path.write_bytes(path.read_bytes()[:-40])
    with pytest.raises(ValueError, match="no whole block"):
        lines_in_tasks(path, 1 << 20)


def test_tasks_and_line_numbers(spark, tmp_path):
    text = "".join(f"line {i}\r\n" for i in range(5000))
    path = put(tmp_path / "t.gz", text.encode())
    rows = blocks.block_lines(spark, path, split=2000)
    assert rows.rdd.getNumPartitions() > 4
    assert [r.text for r in rows.orderBy("line").collect()] == text.split("\r\n")[:-1]
    got = {r.line: r.text for r in blocks.numbered_from_zero(rows).collect()}
    assert got == {i: f"line {i}" for i in range(5000)}
    assert blocks.block_lines(spark, put(tmp_path / "empty.gz", b"")).count() == 0


def test_written_files_are_read_back_in_order(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 5).select(F.concat(F.lit("é "), "id", F.lit(" "), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3)).alias("text"))
    path = str(tmp_path / "out")
    blocks.write_blocks(rows, path)
    assert len(list((tmp_path / "out").iterdir())) == 5 and blocks.is_block_gzip(path)
    back = [r.text for r in blocks.block_lines(spark, path, split=30_000).orderBy("line").collect()]
    assert back == [r.text for r in rows.collect()] == [r.value for r in spark.read.text(path).orderBy(F.split("value", " ")[1].cast("int")).collect()]


def test_records_are_those_of_the_plain_reader(spark, tmp_path):
    names = [f"S{i}" for i in range(9)]
    rng = random.Random(5)
    text = study.header(names) + "".join(study.record(i, "A", "C,G", [rng.choice(["0/1", "1|2", "./.", ".", "", "0/0:3"]) for _ in names]) for i in range(1, 800))
    plain, block = study.put(tmp_path / "p.vcf.gz", text), put(tmp_path / "b.vcf.gz", text.encode(), 5000)
    assert vcf.read_header(spark, block) == names
    for samples in (None, ["S7", "S2"], []):
        a, b = (vcf.read_records(spark, p, names, samples=samples) for p in (plain, block))
        assert a.drop("row_index").orderBy(F.col("pos").cast("int")).collect() == b.orderBy("row_index").drop("row_index").collect()
    with pytest.raises(ValidationError, match="absent"):
        vcf.read_records(spark, block, names, samples=["S1", "who"])
    short = put(tmp_path / "s.vcf.gz", (text + "chr1\t900\t.\tA\n").encode())
    with pytest.raises(ValidationError, match="another width"):
        vcf.read_records(spark, short, names)


def test_a_study_over_block_files(spark, tmp_path):
    for kind in ("plain", "block"):
        config = study.build(tmp_path / kind)
        if kind == "block":
            for name in ("missing", "pass", "diversity"):
                path = tmp_path / kind / f"{name}.vcf.gz"
                put(path, gzip.open(path).read(), 60)
        steps.run(spark, load_config(config), ["01", "05", "06", "07", "10"])
    for step, file in ((6, "01.deredundancy_ALT_coverage_summary.tsv"), (7, "00.Wild_target_site_call_rate.tsv"), (7, "02.Greedy_Plan_B_Wild_supplements.tsv"), (10, "01.final_portfolios.tsv")):
        a, b = ((tmp_path / kind / "results" / steps.NAMES[step - 1] / file).read_text() for kind in ("plain", "block"))
        assert a == b
