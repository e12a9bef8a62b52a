import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from cisweave.plans import prep
from cisweave.sources import plink, readers, results


@pytest.fixture
def trio(tmp_path):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (11, 5)).astype(np.float32)
    x[2, 3] = np.nan
    (tmp_path / "g.bed").write_bytes(plink.encode(x))
    (tmp_path / "g.bim").write_text("".join(f"{1 + j // 6}\trs{j} 0  {100 + j}\tA G\n" for j in range(11)))
    (tmp_path / "g.fam").write_text("".join(f"f{i} s{i} 0 0 1 -9\n" for i in range(5)))
    return f"{tmp_path}/g", x


def test_plink_round_trip(spark, trio):
    prefix, x = trio
    geno, bim, fam = plink.load_genotypes(spark, prefix, variantsPerTask=4)
    rows = sorted(geno.collect(), key=lambda r: r.snp_idx)
    got = np.array([[np.nan if v is None else v for v in r.dosages] for r in rows])
    assert np.array_equal(got, x, equal_nan=True)
    assert [r.snp for r in rows] == [f"rs{j}" for j in range(11)]
    assert fam.count() == 5 and {r.sample_idx for r in fam.collect()} == set(range(5))
    assert [r.pos for r in bim.orderBy("snp_idx").collect()] == list(range(100, 111))
    flipped = {r.snp_idx: r.dosages for r in plink.read_plink(spark, prefix, countAllele="a2").collect()}
    assert flipped[2][3] is None and flipped[0] == [2 - v for v in x[0]]
    part = plink.read_plink(spark, prefix, chrom="2", start=107, end=108).collect()
    where = plink.read_plink(spark, prefix).where("chrom = '2' AND pos > 106 AND pos <= 108")
    assert sorted(where.collect()) == sorted(part)
    reader, pushed = plink.Reader({"path": prefix}), [EqualTo(("chrom",), "2"), GreaterThan(("pos",), 106), LessThanOrEqual(("pos",), 108), EqualTo(("snp",), "rs7")]
    assert list(reader.pushFilters(pushed)) == pushed[3:] and [len(p.names) for p in reader.partitions()] == [2]
    assert sorted(r.snp for r in part) == ["rs7", "rs8"] and np.array_equal([r.dosages for r in sorted(part)], x[7:9])


def test_bad_magic(spark, trio):
    prefix, _ = trio
    with open(f"{prefix}.bed", "r+b") as f:
        f.write(b"\0\0\0")
    with pytest.raises(Exception, match="variant-major"):
        plink.read_plink(spark, prefix).collect()


def test_text_scans(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("sample\tcpg1\na\t1.5\nb\t2.5\n")
    df = readers.phenotypes(spark, f"{tmp_path}/p.tsv")
    assert [r.y for r in readers.phenotype_column(df, "cpg1").collect()] == [r.y for r in readers.phenotype_column(df, y_pos=1).collect()] == [1.5, 2.5]
    long = readers.wide_to_long(df).orderBy("sample_idx").collect()
    assert [(r.pheno_id, r.sample_idx, r.y) for r in long] == [("cpg1", 0, 1.5), ("cpg1", 1, 2.5)]
    (tmp_path / "w.tsv").write_text("chr1\t5\t9\n")
    assert readers.window_list(spark, f"{tmp_path}/w.tsv").first() == ("chr1", 5, 9)
    (tmp_path / "e.tsv").write_text("Chr\tStart\tEnd\nchr7\t1\t2\n")
    assert readers.error_regions(spark, f"{tmp_path}/e.tsv").first()["Chrom"] == 7
    assert readers.error_regions(spark, f"{tmp_path}/none.tsv").count() == 0
    (tmp_path / "m_3.tsv").write_text("cpg_id\tcpg_pos\n3_7\t7\n")
    m = readers.manifests(spark, f"{tmp_path}/m_{{chrom}}.tsv", "p_{chrom}", [3, 4]).first()
    assert (m.cpg_id, m.chrom, m.cpg_pos, m.pheno_path) == ("3_7", "3", 7, "p_3")
    assert readers.manifest(spark, f"{tmp_path}/x_{{chrom}}.tsv", [3]) is None
    assert readers.chromosomes("1-3,X") == ["1", "2", "3", "X"]


def test_save_results(spark, tmp_path):
    b, h = results.save_results(spark, [0.0, 0.5, -1e-9], [0.1, 0.2], f"{tmp_path}/r", ["a", "b", "c"], {"chrom": 1}, 1e-8)
    assert [tuple(r) for r in b.collect()] == [("b", 0.5, 1)] and h.count() == 2
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/r_h2.tsv").columns == ["iteration", "h2", "chrom"]


def test_preparation(spark):
    rows = [("chr1", 10, s, 0.1 * i, c) for i, (s, c) in enumerate([("a", 5.0), ("b", 1.0), ("c", 9.0)])] + [("chr1", 20, "a", 0.5, 1.0), ("2", 5, "a", 0.4, 9.0), ("2", 5, "b", None, 9.0)]
    df = spark.createDataFrame(rows, "chrom string, pos long, sample_id string, meth double, cov double")
    samples = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "sample_id string, sample_idx int")
    manifest, y = prep.prepare_sites(df, samples, min_cov=5)
    assert sorted(tuple(r) for r in manifest.collect()) == [("1_10", "1", 10), ("2_5", "2", 5)]
    got = {(r.pheno_id, r.sample_idx): r.y for r in y.collect()}
    assert len(got) == 6 and got[("2_5", 1)] == got[("2_5", 2)] == 0.4
    assert prep.prepare_sites(df, samples, [2], min_cov=0)[0].count() == 1
    a, b = (spark.createDataFrame(r, "iid string, idx long") for r in ([("x", 0), ("y", 1), ("z", 2)], [("z", 0), ("x", 1), ("q", 2)]))
    s = {r.iid: (r.side, r.in_order) for r in prep.align_samples(a, b).collect()}
    assert s == {"x": ("both", True), "z": ("both", False), "y": ("only_a", None), "q": ("only_b", None)}
    with pytest.raises(ValueError):
        prep.align_samples(a.limit(1), b.where("iid = 'q'"))
