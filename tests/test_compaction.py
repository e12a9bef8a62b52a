import pytest
from pyspark.sql import functions as F

from cisweave.sources import compaction as c

SCHEMA = "file_id long, line_no int, snp string, beta double, w int, extra string"


def test_tuning_of_splits():
    tiny = c.tune_splits(1_000_000, 2_000_000_000, 12)
    assert tiny.open_cost < 4 << 20 and tiny.count < 1_000
    assert tiny.max_partition_bytes >= (2_000_000_000 + 1_000_000 * tiny.open_cost) / tiny.count
    assert c.tune_splits(0, 0, 8).count == 1
    assert c.tune_splits(10, 10 << 30, 8).count == pytest.approx(80, abs=2)


def test_small_files_become_few_with_each_record_once(spark, tmp_path):
    rows = [(f, n, f"rs{n % 4}", 0.5 * (n % 3), 100 - f, "x") for f in range(40) for n in range(6)]
    rows += [(50, 0, None, None, 1, "y"), (51, 0, None, None, 2, "z"), (52, 0, "rs0", float("nan"), 3, "z"), (53, 0, "rs0", float("nan"), 2, "z")]
    src, before = f"{tmp_path}/small", spark.conf.get(c.OPEN_COST)
    spark.createDataFrame(rows, SCHEMA).repartition(60).write.parquet(src)
    lines = spark.read.parquet(src)
    out = c.compact(lines, [src], ["snp", "beta"], ["w", "file_id", "line_no"], f"{tmp_path}/out", ["file_id", "line_no", "snp", "beta", "extra"])
    got = {(str(r.snp), str(r.beta)): (r.file_id, r.line_no) for r in spark.read.parquet(out.path).collect()}
    want = {}
    for f, n, s, b, w, _ in sorted(rows, key=lambda r: (r[4], r[0], r[1])):
        want.setdefault((str(s), str(b)), (f, n))
    assert got == want
    assert (out.files_in >= 40, out.files_out, out.lines_in, out.records_out) == (True, 1, len(rows), len(want))
    assert spark.conf.get(c.OPEN_COST) == before


def test_replaces_and_handles_empty(spark, tmp_path):
    src, dst = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in ([(1, 1, "a", 1.0, 1, "")], []):
        spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(src)
        out = c.compact(spark.read.schema(SCHEMA).parquet(src), [src], ["snp", "beta"], ["w", "file_id", "line_no"], dst, ["file_id", "line_no", "snp", "beta"])
        assert spark.read.schema("file_id long").parquet(out.path).count() == len(rows) == out.records_out


def test_a_difference_publishes_nothing(spark, tmp_path, monkeypatch):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, 1, "a", 1.0, 1, "")], SCHEMA).write.parquet(src)
    monkeypatch.setattr(c, "_digest", lambda df, seen=[]: (seen.append(1), [F.count(F.lit(1)).alias("n"), F.lit(len(seen)).cast("decimal(38,0)").alias("digest")])[1])
    with pytest.raises(c.CompactionError):
        c.compact(spark.read.parquet(src), [src], ["snp"], ["w", "file_id", "line_no"], f"{tmp_path}/out", ["file_id", "snp"])
    assert not (tmp_path / "out").exists()
