import pytest
from pyspark.sql import functions as F

from cisweave.functions import ids


@pytest.mark.parametrize(
    "raw, key, chrom",
    [
        ("1_500", "1_500", "1"), ("chr1_500", "1_500", "1"), (" 01-500", "1_500", "1"), ("CHR1:500 ", "1_500", "1"), ("1_0500", "1_500", "1"), ("0x_7", "X_7", "X"), ("10_5", "10_5", "10"),
        ("cg0001", "CG0001", None), ("", None, None), ("   ", None, None), (None, None, None), ("1_", "1_", None), ("MT_3", "MT_3", "MT"),
    ],
)
def test_site_key(spark, raw, key, chrom):
    df = spark.createDataFrame([(raw,)], "id string").select(ids.site_key("id").alias("k"))
    row = df.select("k", ids.site_chrom("k").alias("c")).first()
    assert (row["k"], row["c"]) == (key, chrom)


def test_sample_key_and_chrom(spark):
    rows = spark.createDataFrame([("LQ-01", "chr02"), ("lq_01 ", "2 "), (" ", None), (None, ""), ("--", "0X")], "s string, c string")
    got = [(r[0], r[1]) for r in rows.select(ids.sample_key("s"), ids.chrom_key("c")).collect()]
    assert got == [("LQ01", "2"), ("LQ01", "2"), (None, None), (None, None), ("--", "X")]


def test_chrom_falls_back_to_column(spark):
    df = spark.createDataFrame([("cg1", "chr7"), ("3_1", "9")], "id string, chrom string")
    assert [r[0] for r in df.select(ids.site_chrom(ids.site_key("id"), F.col("chrom"))).collect()] == ["7", "3"]
