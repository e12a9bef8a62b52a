"""PLINK binary genotypes as a Spark data source, one row per variant, read in ranges of variants.

A BED file is variant-major: after three magic bytes each variant takes ceil(N / 4) bytes of two-bit calls. A task reads
only the bytes of its range of variants; with `chrom` (and `start`, `end`) given, only the variants in that range are
planned at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from cisweave import schemas

MAGIC = b"\x6c\x1b\x01"
#: fixed values: copies of the first allele by two-bit code (01 is missing)
A1_COPIES = np.array([2, np.nan, 1, 0], np.float32)


def decode(raw: bytes, n_samples: int, n_variants: int, count_allele: str = "a1") -> np.ndarray:
    """variants x samples; missing calls are NaN."""
    stride = -(-n_samples // 4)
    packed = np.frombuffer(raw, np.uint8, stride * n_variants).reshape(n_variants, stride)
    codes = np.stack([(packed >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(n_variants, -1)[:, :n_samples]
    copies = A1_COPIES if count_allele == "a1" else 2 - A1_COPIES
    return copies[codes]


def encode(dosages: np.ndarray) -> bytes:
    """BED bytes of variants x samples copies of the first allele (0, 1, 2 or NaN)."""
    m, n = dosages.shape
    codes = np.select([np.isnan(dosages), dosages == 2, dosages == 1], [1, 0, 2], 3).astype(np.uint8)
    padded = np.zeros((m, -(-n // 4) * 4), np.uint8)
    padded[:, :n] = codes
    quads = padded.reshape(m, -1, 4)
    return MAGIC + (quads[:, :, 0] | quads[:, :, 1] << 2 | quads[:, :, 2] << 4 | quads[:, :, 3] << 6).astype(np.uint8).tobytes()


class Range(InputPartition):
    def __init__(self, first: int, names: list[tuple[str, str, int]]):
        self.first, self.names = first, names


class Reader(DataSourceReader):
    def __init__(self, options):
        self.prefix = options["path"]
        self.rows = int(options.get("variantsPerTask", 4096))
        self.allele = options.get("countAllele", "a1")
        self.chroms = None if options.get("chrom") is None else {options["chrom"]}
        self.lo, self.hi = int(options.get("start", -(1 << 62))), int(options.get("end", 1 << 62))

    def pushFilters(self, filters):
        """Chromosomes and ranges of positions are left to the plan of the partitions, other filters to Spark."""
        for f in filters:
            if f.attribute == ("chrom",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = own if self.chroms is None else self.chroms & own
            elif f.attribute == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.hi = min(self.hi, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _variants(self):
        with open(f"{self.prefix}.bim") as f:
            for i, line in enumerate(x for x in f if x.strip()):
                c = line.split()
                yield i, c[0], c[1], int(c[3])

    def partitions(self):
        out, first, names = [], None, []
        for i, chrom, snp, pos in self._variants():
            inside = (self.chroms is None or chrom in self.chroms) and self.lo <= pos <= self.hi
            if names and (not inside or len(names) >= self.rows):
                out.append(Range(first, names))
                names = []
            if inside:
                first = i if not names else first
                names.append((chrom, snp, pos))
        return out + ([Range(first, names)] if names else [])

    def read(self, part):
        with open(f"{self.prefix}.fam") as f:
            n = sum(1 for x in f if x.strip())
        stride = -(-n // 4)
        with open(f"{self.prefix}.bed", "rb") as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{self.prefix}.bed is no variant-major BED file")
            f.seek(3 + part.first * stride)
            for at in range(0, len(part.names), 512):
                names = part.names[at : at + 512]
                x = decode(f.read(stride * len(names)), n, len(names), self.allele)
                flat = pa.array(x.ravel(), pa.float32(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, n), pa.int32()), flat) if n else pa.array([[]] * len(names), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(part.first + at, part.first + at + len(names)), pa.int64()), pa.array([v[0] for v in names]), pa.array([v[1] for v in names]), pa.array([v[2] for v in names], pa.int64()), lists],
                    names=["snp_idx", "chrom", "snp", "pos", "dosages"],
                )


class Plink(DataSource):
    @classmethod
    def name(cls):
        return "plink"

    def schema(self):
        return schemas.GENOTYPES

    def reader(self, schema):
        return Reader(self.options)


def read_plink(spark: SparkSession, prefix: str, **options) -> DataFrame:
    """Genotypes (schemas.GENOTYPES) of prefix.bed/.bim/.fam. Options: variantsPerTask, countAllele (a1 or a2), chrom,
    start, end. The prefix is a path that every executor can open. Filters by chrom and pos reach the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Plink)
    return spark.read.format("plink").options(**{k: str(v) for k, v in options.items()}).load(prefix)


def load_genotypes(spark: SparkSession, prefix: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genotypes, variants, samples)."""
    from cisweave.sources import readers

    return read_plink(spark, prefix, **options), readers.bim(spark, f"{prefix}.bim"), readers.fam(spark, f"{prefix}.fam")
