"""Which files a path means, and which values a format can give."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from lociframe.errors import InvalidSourceError, MissingCompanionFileError, UnsupportedFormatError, UnsupportedRepresentation


@dataclass(frozen=True)
class Source:
    """A resolved source: its format, main file, and member files by extension."""

    format: str
    path: Path
    members: Mapping[str, Path] = field(default_factory=dict)
    prefix: Path | None = None


#: (kind, dosage) that each format gives, dense and sparse (fixed values).
SUPPORT: dict[str, dict[tuple[str, str], tuple[bool, bool]]] = {
    "vcf": {("geno", "hardcall"): (True, True), ("geno", "dosage"): (True, False), ("haplo", "hardcall"): (True, True)},
    "plink1": {("geno", "hardcall"): (True, True)},
    "plink2": {("geno", "hardcall"): (True, True), ("geno", "dosage"): (True, False), ("haplo", "hardcall"): (True, True), ("haplo", "dosage"): (True, False)},
    "bgen": {("geno", "dosage"): (True, False), ("haplo", "dosage"): (True, False)},
}
SUPPORT["bcf"] = SUPPORT["vcf"]
#: Formats whose sparse haplotypes are turned to the minor allele.
TURNED_HAPLOTYPES = frozenset({"vcf", "bcf"})


def check_support(format: str, kind: str, dosage: str, sparse: bool) -> None:  # noqa: A002
    """Fail if the format has no such values."""
    dense, also_sparse = SUPPORT[format].get((kind, dosage), (False, False))
    if not (also_sparse if sparse else dense):
        raise UnsupportedRepresentation(f"{format} sources have no {'sparse' if sparse else 'dense'} {kind} {dosage} values")


def _file(path: Path) -> Path:
    if not path.exists():
        raise InvalidSourceError(f"{path} doesn't exist")
    if not path.is_file():
        raise InvalidSourceError(f"{path} is no file")
    return path


def resolve_vcf(path: str | Path) -> Source:
    """A ``.vcf``, ``.vcf.gz``, ``.vcf.bgz`` or ``.bcf`` file."""
    path = Path(path)
    name = path.name.lower()
    kind = "bcf" if name.endswith(".bcf") else "vcf" if name.endswith((".vcf", ".vcf.gz", ".vcf.bgz")) else None
    if kind is None:
        raise UnsupportedFormatError(f"{path} isn't named as VCF or BCF")
    return Source(kind, _file(path), {kind: path})


def _stem(path: Path, suffixes: tuple[str, ...]) -> Path:
    for s in suffixes:
        if path.name.endswith(s):
            return path.with_name(path.name[: -len(s)])
    return path


def _beside(prefix: Path, suffix: str) -> Path:
    return prefix.with_name(prefix.name + suffix)


def _fileset(format: str, path: str | Path, wanted: Mapping[str, tuple[str, ...]]) -> Source:  # noqa: A002
    path = Path(path)
    prefix = _stem(path, tuple(s for suffixes in wanted.values() for s in suffixes))
    members: dict[str, Path] = {}
    absent: list[str] = []
    for role, suffixes in wanted.items():
        there = next((_beside(prefix, s) for s in suffixes if _beside(prefix, s).is_file()), None)
        if there is None:
            absent.append(str(_beside(prefix, suffixes[0])))
        else:
            members[role] = there
    if absent:
        hint = "; the prefix ends with a dot" if prefix.name.endswith(".") else ""
        raise MissingCompanionFileError(f"{format} needs {', '.join(absent)}{hint}")
    main = next(iter(members.values()))
    return Source(format, main, members, prefix)


def resolve_bfile(path: str | Path) -> Source:
    """A BED/BIM/FAM set, by prefix or any member."""
    return _fileset("plink1", path, {"bed": (".bed",), "bim": (".bim",), "fam": (".fam",)})


def resolve_pfile(path: str | Path) -> Source:
    """A PGEN/PVAR/PSAM set, by prefix or any member; ``.pvar`` goes before ``.pvar.zst``."""
    return _fileset("plink2", path, {"pgen": (".pgen",), "pvar": (".pvar", ".pvar.zst"), "psam": (".psam",)})


def resolve_bgen(path: str | Path) -> Source:
    """A BGEN file, by prefix or name, with the ``.sample`` file beside it if there is one."""
    path = Path(path)
    prefix = _stem(path, (".bgen",))
    main = _file(_beside(prefix, ".bgen"))
    sample = _beside(prefix, ".sample")
    return Source("bgen", main, {"bgen": main} | ({"sample": sample} if sample.is_file() else {}), prefix)
