"""Schemas of the tables that operators take and give. Sample order is explicit (sample_idx), never that of rows."""

SAMPLES = "sample_idx int, fid string, iid string, father string, mother string, sex int, phenotype string"
VARIANTS = "snp_idx long, chrom string, snp string, cm double, pos long, a1 string, a2 string"
GENOTYPES = "snp_idx long, chrom string, snp string, pos long, dosages array<float>"
GENOTYPES_LONG = "sample_idx int, snp_idx long, chrom string, snp string, pos long, dosage double"
PHENOTYPES = "pheno_id string, sample_idx int, y double"
SITES = "cpg_id string, chrom string, cpg_pos long"
WINDOWS = "window_id string, chrom string, start long, `end` long, pheno_id string"
SUMMARY = (
    "window_id string, pheno_id string, chrom string, start long, `end` long, num_snps int, n int, final_r2 double, h2 double, h2_unscaled double, "
    "h2_diag double, h2_ld double, h2_val double, n_iter int, alpha double, l1_ratio double, ridge_alpha double, m_raw int, status string, error string"
)
MODEL = (
    SUMMARY + ", snp_ids array<string>, betas array<double>, ridge_betas array<double>, kept_snps array<string>, snp_variances array<double>, "
    "h2_estimates array<double>, early_stop_best double"
)
