import json

import numpy as np
import pandas as pd

from cisweave import cli
from cisweave.sources import plink


def test_run_from_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (40, 50)).astype(np.float32)
    (tmp_path / "g.bed").write_bytes(plink.encode(x))
    (tmp_path / "g.bim").write_text("".join(f"{1 + j // 20}\trs{j}\t0\t{1000 + 100 * (j % 20)}\tA\tG\n" for j in range(40)))
    (tmp_path / "g.fam").write_text("".join(f"f{i} s{i} 0 0 1 -9\n" for i in range(50)))
    for c in (1, 2):
        at = [1000 + 500 * i for i in range(3)]
        pd.DataFrame({"cpg_id": [f"{c}_{p}" for p in at], "chrom": c, "cpg_pos": at}).to_parquet(tmp_path / f"m{c}.parquet")
        pd.DataFrame({f"{c}_{p}": x[20 * (c - 1) + i] + rng.normal(0, 0.3, 50) for i, p in enumerate(at)}).to_parquet(tmp_path / f"y{c}.parquet")
    args = ["run", "--geno-path", f"{tmp_path}/g", "--cpg-manifest-template", f"{tmp_path}/m{{chrom}}.parquet", "--pheno-template", f"{tmp_path}/y{{chrom}}.parquet", "--outdir", f"{tmp_path}/out"]
    cli.main([*args, "--chromosomes", "1-2", "--window-size", "2000", "--n-iter", "4", "--working-set", "8", "--refresh", "2", "--warmup", "1", "--patience", "2"])
    out = pd.read_parquet(tmp_path / "out/cpg.summary_all.parquet")
    assert len(out) == 6 and set(out["status"]) == {"ok"} and (out["n_iter"] <= 4).all()
    stats = json.loads(next((tmp_path / "out/cpg.statistics.json").glob("part-*")).read_text())
    assert stats["total"] == 6
    cli.main([*args, "--chromosomes", "1", "--prefix", "plain", "--window-size", "2000", "--skip-tuning", "--n-iter", "2", "--n-trials", "2", "--no-early-stop", "--by-hand"])
    assert (pd.read_parquet(tmp_path / "out/plain.summary_all.parquet")["n_iter"] == 2).all()
