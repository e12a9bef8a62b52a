"""Sites that arrive as manifest files, fitted as they come.

Files are read by a file stream with a checkpoint, so each is taken once; a micro-batch runs the ordinary checkpointed
pipeline, which skips windows that already have a record. A batch that is replayed after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cisweave import schemas
from cisweave.plans import pipeline


def fit_arrivals(spark: SparkSession, manifests: str, genotypes: DataFrame, phenotypes: DataFrame, outdir: str, prefix: str = "cpg", fmt: str = "parquet", files_per_batch: int = 100, **options) -> StreamingQuery:
    """Fit the sites of all manifest files that are there and end; called again, it takes up those that came since."""
    arriving = spark.readStream.schema(schemas.SITES).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(manifests)

    def one_batch(sites: DataFrame, _: int) -> None:
        pipeline.run_sites(sites.dropDuplicates(["cpg_id"]), genotypes, phenotypes, outdir, prefix, save=False, **options).write.format("noop").mode("overwrite").save()

    return arriving.writeStream.foreachBatch(one_batch).option("checkpointLocation", f"{outdir}/{prefix}_stream").trigger(availableNow=True).start()
