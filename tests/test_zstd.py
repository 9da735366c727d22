"""zstd-compressed corpora: round trips, several frames in a file, long lines, failed tasks."""

import json
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from sparkeval.sources import readers as R
from sparkeval.sources import zstd_lines as Z


def test_round_trip_of_a_corpus(spark, tmp_dir):
    texts = [(i, f"text {i} 日本 \" \\ \t" + "\nline" * (i % 3)) for i in range(200)] + [(200, None), (201, ""), (202, "x" * (9 << 20))]
    docs = spark.createDataFrame(texts, "id long, text string").withColumn("meta", F.create_map(F.lit("id"), F.col("id").cast("string")))
    path = f"{tmp_dir}/corpus.jsonl.zst"
    R.write_corpus(docs.repartition(4), path, meta="meta")
    assert len(os.listdir(path)) == 4
    got = {int(r.meta["id"]): r.text for r in R.read_corpus(spark, path).collect()}
    assert got == {i: t for i, t in texts if t is not None}
    R.write_corpus(docs.limit(3), path, meta="meta")        # overwritten as a whole
    assert R.read_corpus(spark, path).count() == 3
    Z.write_zstd_lines(spark.createDataFrame([("more",)], "v string"), path, mode="append")
    assert Z.read_zstd_lines(spark, path).count() == 4


def test_frames_blank_lines_and_bare_strings(spark, tmp_dir):
    path = f"{tmp_dir}/one.jsonl.zst"
    frames = [b'{"text": "a"}\n{"te', b'xt": ["p", "q"], "meta": {"s": "x"}}\n\n', b'"bare"']
    with open(path, "wb") as f:
        for part in frames:
            f.write(zstandard.ZstdCompressor().compress(part))
    assert sorted(r.text for r in R.read_corpus(spark, path).collect()) == ["a", "bare", "p\n\nq"]
    assert [r.value for r in Z.read_zstd_lines(spark, path).collect()] == ['{"text": "a"}', '{"text": ["p", "q"], "meta": {"s": "x"}}', "", '"bare"']
    open(f"{tmp_dir}/empty.zst", "wb").close()
    assert Z.read_zstd_lines(spark, f"{tmp_dir}/empty.zst").count() == 0
    with pytest.raises(Exception, match="nothing.zst"):
        Z.read_zstd_lines(spark, f"{tmp_dir}/nothing.zst").count()


def test_lines_longer_than_a_block(tmp_dir, monkeypatch):
    monkeypatch.setattr(Z, "BLOCK", 5)
    lines = [b"", b"abc", b"x" * 23, b"", b"y"]
    with open(f"{tmp_dir}/b.zst", "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(b"\n".join(lines) + b"\n"))
    assert [x for part in Z.lines_of(f"{tmp_dir}/b.zst") for x in part] == lines


def test_a_failed_write_leaves_no_rows(spark, tmp_dir):
    path = f"{tmp_dir}/bad.jsonl.zst"
    bad = spark.range(20).select(F.when(F.col("id") == 19, F.raise_error(F.lit("stop"))).otherwise(json.dumps({"text": "t"})).alias("v"))
    with pytest.raises(Exception, match="stop"):
        Z.write_zstd_lines(bad.coalesce(1), path)
    with pytest.raises(Exception, match="bad.jsonl.zst"):
        R.read_corpus(spark, path).count()
