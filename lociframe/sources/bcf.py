"""BCF 2: header dictionaries and typed records."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np

from lociframe.errors import InvalidSourceError, UnsupportedRepresentation
from lociframe.sources.bgzf import blocks_from

NAN = np.float32("nan")
#: Codes of typed values: their numpy kinds, and per whole-number kind the values for missing and for the end (fixed values).
KINDS = {1: "<i1", 2: "<i2", 3: "<i4", 5: "<f4", 7: "S1"}
NO_FLOAT, END_FLOAT = 0x7F800001, 0x7F800002


class Stream:
    """Bytes of a BCF file in order, its blocks being opened as needed."""

    def __init__(self, path: str):
        self._blocks = (data for _, data in blocks_from(path, 0))
        self._held = b""

    def take(self, n: int, may_end: bool = False) -> bytes:
        parts, have = [self._held], len(self._held)
        while have < n:
            data = next(self._blocks, None)
            if data is None:
                if may_end and have == 0:
                    return b""
                raise InvalidSourceError("the BCF file ends within a record")
            parts.append(data)
            have += len(data)
        whole = b"".join(parts)
        self._held = whole[n:]
        return whole[:n]


class BcfHeader:
    """Sample IDs, and the names that numbers stand for."""

    def __init__(self, text: str):
        self.contigs: dict[int, str] = {}
        self.strings: dict[int, str] = {0: "PASS"}
        self.samples: list[str] = []
        numbers = {"PASS": 0}
        for line in text.splitlines():
            if line.startswith("#CHROM"):
                self.samples = line.split("\t")[9:]
            m = re.match(r"##(contig|FILTER|INFO|FORMAT)=<", line)
            name = re.search(r"[<,]ID=([^,>]+)", line)
            if not m or not name:
                continue
            given = re.search(r"[<,]IDX=(\d+)", line)
            if m[1] == "contig":
                self.contigs[int(given[1]) if given else len(self.contigs)] = name[1]
            else:
                number = int(given[1]) if given else numbers.get(name[1], max(self.strings) + 1)
                numbers[name[1]] = number
                self.strings[number] = name[1]


def open_bcf(path: str) -> tuple[Stream, BcfHeader]:
    s = Stream(path)
    if s.take(5)[:4] != b"BCF\2":
        raise InvalidSourceError(f"{path} has no BCF header")
    return s, BcfHeader(s.take(struct.unpack("<I", s.take(4))[0]).rstrip(b"\0").decode())


def _typed(data: bytes, at: int) -> tuple[int, int, int]:
    """Kind, count and place of the values at ``at``."""
    kind, n = data[at] & 15, data[at] >> 4
    at += 1
    if n == 15:
        inner, _, at = _typed(data, at)
        size = np.dtype(KINDS[inner]).itemsize
        n = int.from_bytes(data[at : at + size], "little")
        at += size
    return kind, n, at


def _string(data: bytes, at: int) -> tuple[str, int]:
    kind, n, at = _typed(data, at)
    if kind not in (0, 7):
        raise InvalidSourceError("a BCF text has another type")
    return data[at : at + n].rstrip(b"\0").decode(), at + n


def records(s: Stream, header: BcfHeader) -> Iterator[tuple[tuple, dict[str, tuple[int, int, bytes]], int]]:
    """Each record's ``(chrom, pos, id, a0, a1, ref, alt, qual)``, sample fields ``{key: (kind, count, bytes)}`` and number of samples."""
    while head := s.take(8, may_end=True):
        shared, own = (s.take(n) for n in struct.unpack("<2I", head))
        chrom, pos, _, raw_qual, alleles_info, fmt_samples = struct.unpack_from("<3i3I", shared)
        n_alleles, n_fmt, n_samples = alleles_info >> 16, fmt_samples >> 24, fmt_samples & 0xFFFFFF
        names, at = _string(shared, 24)
        alleles = []
        for _ in range(n_alleles):
            allele, at = _string(shared, at)
            alleles.append(allele)
        if chrom not in header.contigs:
            raise InvalidSourceError("a BCF record names an unknown contig")
        if pos < -1:
            raise InvalidSourceError(f"a BCF record on {header.contigs[chrom]} has position {pos + 1}")
        if n_alleles < 2:
            raise InvalidSourceError(f"BCF record {header.contigs[chrom]}:{pos + 1} has fewer than two alleles")
        qual = None if raw_qual in (NO_FLOAT, END_FLOAT) else float(np.uint32(raw_qual).view(np.float32))
        qual = qual if qual is not None and np.isfinite(qual) else None
        fields, at = {}, 0
        for _ in range(n_fmt):
            kind, n, at = _typed(own, at)
            size = np.dtype(KINDS[kind]).itemsize
            key = header.strings.get(int.from_bytes(own[at : at + size], "little"), "")
            kind, n, at = _typed(own, at + size)
            length = n * np.dtype(KINDS[kind]).itemsize * n_samples if kind else 0
            fields[key] = (kind, n, own[at : at + length])
            at += length
        yield (header.contigs[chrom], pos + 1, names.split(";")[0] or ".", alleles[0], alleles[1], alleles[0], ",".join(alleles[1:]), qual), fields, n_samples


def _gt(field: tuple[int, int, bytes], n_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Allele numbers (-1 missing, -2 absent) and phase marks of each sample."""
    kind, n, raw = field
    if kind not in (1, 2, 3):
        raise InvalidSourceError("BCF genotypes have an unknown type")
    v = np.frombuffer(raw, dtype=KINDS[kind]).reshape(n_samples, n).astype(np.int64)
    low = np.iinfo(KINDS[kind]).min
    alleles = np.where(v == low + 1, -2, np.where(v == low, -1, (v >> 1) - 1))
    return alleles, (v & 1) == 1


def any_phased(fields: dict, n_samples: int) -> bool:
    """Whether any genotype of a record is marked as phased."""
    if "GT" not in fields:
        return False
    alleles, phased = _gt(fields["GT"], n_samples)
    return bool((phased[:, 1:] & (alleles[:, 1:] > -2)).any())


def values(fields: dict, n_samples: int, kind: str, dosage: str, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calls of the samples ``keep`` by sample or haplotype, and those by sample."""
    if dosage == "dosage":
        if "DS" not in fields:
            raise UnsupportedRepresentation("dosages need FORMAT/DS values")
        ds_kind, n, raw = fields["DS"]
        if ds_kind != 5 or n != 1:
            raise UnsupportedRepresentation("dosages need one FORMAT/DS number a sample")
        bits = np.frombuffer(raw, dtype="<u4")[keep]
        v = bits.view("<f4").astype(np.float32)
        gone = (bits == NO_FLOAT) | (bits == END_FLOAT)
        if not ((np.isfinite(v) & (v >= 0) & (v <= 2)) | gone).all():
            raise InvalidSourceError("a FORMAT/DS value isn't from 0 to 2")
        v = np.where(gone, NAN, v).astype(np.float32)
        return v, v
    if "GT" not in fields:
        raise InvalidSourceError("a BCF record has no FORMAT/GT")
    alleles, phased = _gt(fields["GT"], n_samples)
    alleles, phased = alleles[keep], phased[keep]
    first_two = alleles[:, :2] if alleles.shape[1] >= 2 else np.pad(alleles, ((0, 0), (0, 2 - alleles.shape[1])), constant_values=-2)
    missing = (first_two == -1).any(axis=1)
    present = (alleles != -2).sum(axis=1)
    if kind == "haplo":
        if (present != 2).any() or (first_two > 1).any():
            raise InvalidSourceError("a BCF genotype isn't a diploid call of two alleles")
        if not phased[:, 1].all():
            raise UnsupportedRepresentation("a BCF genotype isn't phased", np.where(missing, NAN, first_two.sum(axis=1)).astype(np.float32))
        each = np.where(first_two < 0, NAN, first_two).astype(np.float32)
        return each.reshape(-1), np.where(missing, NAN, first_two.sum(axis=1)).astype(np.float32)
    if ((present != 2) & ~missing).any() or ((first_two > 1).any(axis=1) & ~missing).any():
        raise InvalidSourceError("a BCF genotype isn't a diploid call of two alleles")
    total = np.where(missing, NAN, first_two.sum(axis=1)).astype(np.float32)
    return total, total
