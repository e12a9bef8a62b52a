"""python -m cisweave.cli run|prep ...: many loci from PLINK files and per-chromosome manifests, or their preparation."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from cisweave import storage
from cisweave.functions.boosting import Settings
from cisweave.functions.penalties import enet_numbers
from cisweave.plans import pipeline, prep, tuning
from cisweave.sources import plink, readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("--geno-path", required=True)
    run.add_argument("--cpg-manifest-template", required=True)
    run.add_argument("--pheno-template", required=True)
    run.add_argument("--outdir", required=True)
    run.add_argument("--prefix", default="cpg")
    run.add_argument("--chromosomes", default="1-22")
    run.add_argument("--window-size", type=int, default=500_000)
    run.add_argument("--skip-tuning", action="store_true")
    run.add_argument("--checkpoint-interval", type=int, default=10_000)
    run.add_argument("--no-resume", action="store_true")
    run.add_argument("--n-iter", type=int, default=100)
    run.add_argument("--n-trials", type=int, default=20)
    run.add_argument("--batch-size", type=int, default=8192)
    run.add_argument("--no-early-stop", action="store_true")
    run.add_argument("--patience", type=int, default=5)
    run.add_argument("--min-delta", type=float, default=1e-4)
    run.add_argument("--warmup", type=int, default=5)
    run.add_argument("--working-set", type=int, help="columns of the working set")
    run.add_argument("--refresh", type=int, help="rounds between choices of the working set")
    run.add_argument("--by-hand", action="store_true")
    prepare = sub.add_parser("prep")
    prepare.add_argument("--long", required=True, help="parquet of chrom, pos, sample_id, meth, cov")
    prepare.add_argument("--samples", required=True, help="parquet of sample_id, sample_idx")
    prepare.add_argument("--output", required=True)
    prepare.add_argument("--chromosomes")
    prepare.add_argument("--no-smooth", action="store_true")
    prepare.add_argument("--smooth-h", type=int, default=1_000)
    prepare.add_argument("--min-cov", type=float, default=1)
    prepare.add_argument("--sample-id-col", default="sample_id")
    prepare.add_argument("--validate-fam")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("cisweave").getOrCreate()
    if a.command == "prep":
        samples = spark.read.parquet(a.samples).withColumnRenamed(a.sample_id_col, "sample_id")
        if a.validate_fam:
            fam = readers.fam(spark, a.validate_fam).selectExpr("iid", "sample_idx AS idx")
            prep.align_samples(samples.selectExpr("sample_id AS iid", "sample_idx AS idx"), fam).groupBy("side", "in_order").count().show()
        chromosomes = readers.chromosomes(a.chromosomes) if a.chromosomes else None
        prep.write_prepared(*prep.prepare_sites(spark.read.parquet(a.long), samples, chromosomes, None if a.no_smooth else a.smooth_h, a.min_cov), a.output)
        return
    settings = Settings(
        n_iter=a.n_iter, n_trials=a.n_trials, batch_size=a.batch_size, early_stop=not a.no_early_stop, patience=a.patience, min_delta=a.min_delta, warmup=a.warmup, working_set=a.working_set,
        refresh=a.refresh,
    )
    genotypes, variants, samples = plink.load_genotypes(spark, a.geno_path)
    chromosomes, n = readers.chromosomes(a.chromosomes), samples.count()
    fixed = None
    if not a.skip_tuning:
        sites = readers.manifest(spark, a.cpg_manifest_template, chromosomes)
        paths = [p for c in chromosomes if readers.exists(spark, p := a.pheno_template.format(chrom=c))]
        long = None
        for p in paths:
            one = readers.wide_to_long(readers.phenotypes(spark, p))
            long = one if long is None else long.unionByName(one)
        odd, even = tuning.odd_even(chromosomes)
        windows = pipeline.windows_of_sites(sites)
        best = tuning.tune_across(windows.where(windows["chrom"].isin(odd)), windows.where(windows["chrom"].isin(even)), genotypes, long, n=n, settings=settings, variants=variants, window_size=a.window_size)

        def fixed(spec: dict) -> dict:
            if spec["m_raw"] <= 1:
                return {"fixed_subsample_frac": best["subsample_frac"], "fixed_batch_size": best["batch_size"]}
            alpha, l1 = enet_numbers(spec["m_raw"], n, best["c_lambda"], best["c_ridge"])
            return {"fixed_alpha": alpha, "fixed_l1_ratio": l1, "fixed_subsample_frac": best["subsample_frac"], "fixed_batch_size": best["batch_size"]}

    out = pipeline.run_by_chromosome(
        spark, chromosomes, genotypes, a.cpg_manifest_template, a.pheno_template, a.outdir, a.prefix, window_size=a.window_size, fixed_params=fixed,
        checkpoint_interval=a.checkpoint_interval, resume=not a.no_resume, settings=settings, by_hand=a.by_hand,
    )
    pipeline.write_statistics(out, f"{a.outdir}/{a.prefix}.statistics.json")
    storage.clear(spark)
    spark.stop()


if __name__ == "__main__":
    main()
