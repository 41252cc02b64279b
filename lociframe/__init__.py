"""Genotype analytics on Spark: cohort tables, variant filters, statistics and data preparation."""

from lociframe.errors import (
    InternalError,
    InvalidOptionError,
    InvalidSourceError,
    MissingCompanionFileError,
    MissingDataError,
    SampleFilterError,
    SourceResolutionError,
    UnsupportedFormatError,
    UnsupportedRepresentation,
)
from lociframe.filters import FilterExpr, biallelic, chrom, id_in, mac, maf, missing_rate, polymorphic, qual, region, snp
from lociframe.sources.dataset import Dataset, SparseMatrix, bfile, pfile
from lociframe.sources.dataset import open_bgen as bgen
from lociframe.sources.dataset import open_vcf as vcf
from lociframe.streaming.blocks import BlockIterator

__version__ = "0.1.0"

__all__ = [
    "BlockIterator", "Dataset", "FilterExpr", "InternalError", "InvalidOptionError", "InvalidSourceError", "MissingCompanionFileError", "MissingDataError",
    "SampleFilterError", "SourceResolutionError", "SparseMatrix", "UnsupportedFormatError", "UnsupportedRepresentation", "__version__",
    "bfile", "bgen", "biallelic", "chrom", "id_in", "mac", "maf", "missing_rate", "pfile", "polymorphic", "qual", "region", "snp", "vcf",
]
