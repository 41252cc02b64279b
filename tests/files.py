"""Cohorts of the tests of the file sources: one drawn from a seed, and single sites for files written by hand."""

from __future__ import annotations

import random

import numpy as np

from lociframe.queries.genotype_files import *  # noqa: F403
from lociframe.queries.genotype_files import Variant

#: Sites of files that a test writes itself.
SITES: list[Variant] = [("1", 1205, "m1", "C", "T"), ("1", 1890, "m2", "G", "A"), ("2", 77, "m3", "CT", "C"), ("2", 9001, "m4", "T", "G")]


def drawn_cohort(seed: int, n_variants: int = 60, n_samples: int = 23) -> tuple[list[Variant], list[list], list[str]]:
    """Variants over three chromosomes, their calls, some missing and some common, and sample names."""
    r = random.Random(seed)
    variants: list[Variant] = []
    for chrom in ("3", "7", "X"):
        for pos in sorted(r.sample(range(1, 900_000), n_variants // 3)):
            a0 = r.choice("ACGT")
            a1 = a0 + r.choice("ACGT") if r.random() < 0.2 else r.choice("ACGT".replace(a0, ""))
            variants.append((chrom, pos, f"v{len(variants)}_{pos}", a0, a1))
    calls = []
    for _ in variants:
        share, gone = r.choice([0, 0.03, 0.2, 0.5, 0.8]), r.choice([0, 0, 0.1, 0.4])
        calls.append([None if r.random() < gone else (r.random() < share) + (r.random() < share) for _ in range(n_samples)])
    return variants, calls, [f"P{r.randint(100, 999)}-{k}" for k in range(n_samples)]


VARIANTS, CALLS, SAMPLES = drawn_cohort(20)
#: The matrix that every format must give: samples x variants, NaN for missing.
DENSE = np.array([[np.nan if c is None else c for c in row] for row in CALLS], dtype="float32").T


def numpy_stats(dense: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of the columns of a matrix, for the filters; without any call NaN."""
    called = (~np.isnan(dense)).sum(axis=0)
    count = np.nansum(dense.astype("float64"), axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(called > 0, count / (2 * called), np.nan)
    return {"n_called": called, "maf": np.fmin(share, 1 - share), "mac": np.where(called > 0, np.fmin(count, 2 * called - count), np.nan), "missing": 1 - called / max(1, len(dense))}
