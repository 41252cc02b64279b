"""PLINK 1 and 2: sample and variant files, two-bit BED records, PGEN records of all kinds.

Decoders work on one record and give float32 calls with NaN for missing ones; the
callers hand them to Spark as nulls.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from lociframe.errors import InvalidSourceError, UnsupportedRepresentation

NAN = np.float32("nan")


def _lines(path: str) -> Iterator[str]:
    if path.endswith(".zst"):
        import zstandard

        with open(path, "rb") as raw, zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as f:
            yield from (line.rstrip("\r\n") for line in io.TextIOWrapper(f, encoding="utf-8"))
    else:
        with open(path, encoding="utf-8") as f:
            yield from (line.rstrip("\r\n") for line in f)


def _none(value: str | None, tokens: tuple[str, ...]) -> str | None:
    return None if value is None or value in tokens else value


# ---- PLINK 1 ----


def read_fam(path: str) -> list[dict]:
    """Samples of a FAM file; blank lines are skipped, ``0`` parents are none."""
    out = []
    for k, line in enumerate(_lines(path), 1):
        if not line.strip():
            continue
        f = line.split()
        if len(f) != 6:
            raise InvalidSourceError(f"{path}, line {k}: a FAM line has 6 fields, not {len(f)}")
        out.append({"fid": f[0], "iid": f[1], "father": _none(f[2], ("0",)), "mother": _none(f[3], ("0",)), "sex": f[4], "phenotype": f[5]})
    return out


def parse_bim(line: str, path: str = "") -> tuple:
    """``chrom, pos, id, a0, a1, ref, alt, qual`` of a BIM line: the fifth field is counted."""
    f = line.split()
    if len(f) != 6:
        raise InvalidSourceError(f"{path}: a BIM line has 6 fields, not {len(f)}")
    return f[0], _position(f[3], path), f[1], f[5], f[4], None, None, None


def _position(text: str, path: str) -> int:
    if not text.isascii() or not text.isdigit() or int(text) > 0xFFFFFFFF:
        raise InvalidSourceError(f"{path}: {text!r} is no position")
    return int(text)


#: Calls of the two-bit codes of BED and of PGEN (fixed values).
BED_CALLS = np.array([2, NAN, 1, 0], dtype=np.float32)
PGEN_CALLS = np.array([0, 1, 2, NAN], dtype=np.float32)


def two_bit(record: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` two-bit codes of a record, lowest bits first."""
    shifts = np.array([0, 2, 4, 6], dtype=np.uint8)
    return ((record[:, None] >> shifts) & 3).reshape(-1)[:n]


def bed_count(path: str, n_samples: int) -> int:
    """The number of variants of a BED file, whose header and length are checked."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(3)
    if head[:2] != b"\x6c\x1b" or len(head) < 3:
        raise InvalidSourceError(f"{path} has no BED header")
    if head[2] != 1:
        raise InvalidSourceError(f"{path} isn't variant-major")
    width = -(-n_samples // 4)
    if width == 0 or (size - 3) % width:
        raise InvalidSourceError(f"{path}: its length isn't a whole number of records")
    return (size - 3) // width


# ---- PLINK 2: text files ----


def read_psam(path: str) -> list[dict]:
    """Samples of a PSAM file, whose header names its columns."""
    names = {"FID": "fid", "IID": "iid", "PAT": "father", "FATHER": "father", "MAT": "mother", "MOTHER": "mother", "SEX": "sex", "PHENO1": "phenotype", "PHENO": "phenotype", "PHENOTYPE": "phenotype"}
    at: dict[str, int] = {}
    out = []
    for k, line in enumerate(_lines(path), 1):
        if not line.strip() or line.startswith("##"):
            continue
        f = line.split()
        if not at:
            if not line.startswith("#"):
                raise InvalidSourceError(f"{path} has no header")
            for i, name in enumerate(f):
                key = names.get(name.lstrip("#").upper())
                if key:
                    at.setdefault(key, i)
            if "iid" not in at:
                raise InvalidSourceError(f"{path}: the header has no IID")
            continue
        if len(f) <= max(at.values()):
            raise InvalidSourceError(f"{path}, line {k}: too few fields")
        row = {key: f[at[key]] if key in at else None for key in ("fid", "iid", "father", "mother", "sex", "phenotype")}
        out.append(row | {key: _none(row[key], ("0", ".", "NA")) for key in ("fid", "father", "mother")})
    if not at:
        raise InvalidSourceError(f"{path} has no header")
    return out


def pvar_layout(header: str | None, n_fields: int) -> dict[str, int]:
    """Places of the columns of a PVAR file; FORMAT ends the header."""
    if header is not None:
        names = [h.lstrip("#").upper() for h in header.split("\t" if "\t" in header else None)]
        names = names[: names.index("FORMAT")] if "FORMAT" in names else names
    else:
        names = ["CHROM", "ID", "POS", "ALT", "REF"] if n_fields == 5 else ["CHROM", "ID", "CM", "POS", "ALT", "REF"]
    at = {name: i for i, name in enumerate(names)}
    absent = {"CHROM", "POS", "ID", "REF", "ALT"} - at.keys()
    if absent:
        raise InvalidSourceError(f"the PVAR header lacks {', '.join(sorted(absent))}")
    return at


def parse_pvar(line: str, at: dict[str, int], path: str = "") -> tuple:
    """``chrom, pos, id, a0, a1, ref, alt, qual``: the first alternate is counted."""
    f = line.split("\t") if "\t" in line else line.split()
    if len(f) <= max(at[c] for c in ("CHROM", "POS", "ID", "REF", "ALT")):
        raise InvalidSourceError(f"{path}: a PVAR line has too few fields")
    alt = f[at["ALT"]]
    qual = None
    if "QUAL" in at and at["QUAL"] < len(f) and f[at["QUAL"]] != ".":
        try:
            qual = float(f[at["QUAL"]])
        except ValueError:
            raise InvalidSourceError(f"{path}: {f[at['QUAL']]!r} is no quality") from None
        qual = qual if np.isfinite(qual) else None
    return f[at["CHROM"]], _position(f[at["POS"]], path), f[at["ID"]], f[at["REF"]], alt.split(",")[0], f[at["REF"]], alt, qual


def pvar_places(path: str, starts: list[int]) -> tuple[str | None, list[int], int]:
    """The header line, the byte places of the variants numbered ``starts``, and the number of variants.

    Lines are only counted, not parsed.  Places in a compressed file are those in
    its content.
    """
    header, places, n, at = None, [], 0, 0
    wanted = iter(starts)
    following = next(wanted, None)
    for raw in _raw_lines(path):
        if raw.strip() and not raw.startswith(b"##"):
            if raw.startswith(b"#") and header is None and n == 0:
                header = raw.decode().rstrip("\r\n")
            else:
                if n == following:
                    places.append(at)
                    following = next(wanted, None)
                n += 1
        at += len(raw)
    return header, places, n


def _raw_lines(path: str) -> Iterator[bytes]:
    with open(path, "rb") as raw:
        if path.endswith(".zst"):
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as f:
                yield from io.BufferedReader(f)
        else:
            yield from raw


def pvar_from(path: str, header: str | None, place: int) -> Iterator[tuple]:
    """Variants from a byte place on; a compressed file is passed over up to there."""
    if path.endswith(".zst"):
        lines, at = _raw_lines(path), 0
        while at < place:
            at += len(next(lines))
    else:
        f = open(path, "rb")  # noqa: SIM115
        f.seek(place)
        lines = f
    layout = None
    for raw in lines:
        if not raw.strip() or raw.startswith(b"##"):
            continue
        line = raw.decode().rstrip("\r\n")
        if layout is None:
            layout = pvar_layout(header, len(line.split()))
        yield parse_pvar(line, layout, path)
    if lines is not None and hasattr(lines, "close"):
        lines.close()


# ---- PLINK 2: PGEN ----

BLOCK = 1 << 16


@dataclass
class PgenHeader:
    """What a PGEN header tells: mode, counts, and of variable records their types and offsets."""

    mode: int
    n_variants: int
    n_samples: int
    first: int
    types: np.ndarray | None = None
    offsets: np.ndarray | None = None

    def width(self) -> int:
        """Bytes of a record of fixed width."""
        return -(-self.n_samples // 4) + self.n_samples * {2: 0, 3: 2, 4: 4}[self.mode]


def pgen_header(path: str) -> PgenHeader:
    """Read and check the header of a PGEN file."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(12)
        if len(head) < 12 or head[:2] != b"\x6c\x1b":
            raise InvalidSourceError(f"{path} has no PGEN header")
        mode, v, n, control = head[2], int.from_bytes(head[3:7], "little"), int.from_bytes(head[7:11], "little"), head[11]
        flags = -(-v // 8) if control >> 6 == 3 else 0
        if mode in (2, 3, 4):
            h = PgenHeader(mode, v, n, 12 + flags)
            if h.first + v * h.width() != size:
                raise InvalidSourceError(f"{path}: its length doesn't fit {v} records")
            return h
        if mode != 0x10:
            raise InvalidSourceError(f"{path}: storage mode {mode:#x} isn't supported")
        form = control & 15
        if form > 7:
            raise InvalidSourceError(f"{path}: record form {form} isn't supported")
        if (control >> 4) & 3:
            raise InvalidSourceError(f"{path}: allele counts aren't supported")
        length_width, wide_types = (form & 3) + 1, form >= 4
        n_blocks = -(-v // BLOCK)
        starts = np.frombuffer(f.read(8 * n_blocks), dtype="<u8")
        types, offsets = [], []
        for b in range(n_blocks):
            count = min(BLOCK, v - b * BLOCK)
            raw = np.frombuffer(f.read(count if wide_types else -(-count // 2)), dtype=np.uint8)
            kinds = raw if wide_types else np.stack([raw & 15, raw >> 4], axis=1).reshape(-1)[:count]
            lengths = np.frombuffer(f.read(count * length_width), dtype=np.uint8)
            if len(kinds) < count or len(lengths) < count * length_width:
                raise InvalidSourceError(f"{path}: the header ends early")
            grid = lengths.reshape(count, length_width).astype(np.uint64)
            sizes = (grid << (8 * np.arange(length_width, dtype=np.uint64))).sum(axis=1)
            if control >> 6 == 3:
                f.read(-(-count // 8))
            if (kinds[0] & 7) in (2, 3):
                raise InvalidSourceError(f"{path}: a block begins with a record that refers back")
            bad = np.flatnonzero((kinds & 7) == 5)
            if len(bad):
                raise InvalidSourceError(f"{path}: record type {kinds[bad[0]]:#x} isn't supported")
            types.append(kinds)
            ends = np.cumsum(sizes)
            offsets.append(np.concatenate([[0], ends[:-1]]).astype(np.uint64) + starts[b])
            if b + 1 == n_blocks:
                offsets.append(np.array([starts[b] + ends[-1]], dtype=np.uint64))
        first = f.tell()
    h = PgenHeader(mode, v, n, first, np.concatenate(types) if types else np.zeros(0, np.uint8), np.concatenate(offsets).astype(np.int64) if offsets else np.zeros(1, np.int64))
    if v and (h.offsets[-1] != size or h.offsets[0] < first):
        raise InvalidSourceError(f"{path}: record offsets don't fit the file")
    return h


class Record:
    """A cursor over one record's bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> np.ndarray:
        if self.at + n > len(self.data):
            raise InvalidSourceError("a PGEN record ends early")
        out = np.frombuffer(self.data, dtype=np.uint8, count=n, offset=self.at)
        self.at += n
        return out

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = int(self.take(1)[0])
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    def varints(self, n: int) -> np.ndarray:
        """The next ``n`` numbers at once; each has five bytes at most."""
        window = np.frombuffer(self.data, dtype=np.uint8, offset=self.at)[: 5 * n]
        last = np.flatnonzero(window < 128)[:n]
        if len(last) < n:
            raise InvalidSourceError("a PGEN record ends early")
        if not n:
            return np.zeros(0, dtype=np.int64)
        first = np.append(0, last[:-1] + 1)
        used = window[: last[-1] + 1].astype(np.int64)
        shift = 7 * (np.arange(len(used)) - np.repeat(first, last - first + 1))
        self.at += len(used)
        return np.add.reduceat((used & 127) << shift, first)

    def bits(self, n: int) -> np.ndarray:
        return np.unpackbits(self.take(-(-n // 8)), bitorder="little")[:n].astype(bool)

    def u16(self, n: int) -> np.ndarray:
        return self.take(2 * n).view("<u2") if n else np.zeros(0, dtype="<u2")


def _sample_list(r: Record, n_samples: int, with_codes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sample numbers of a difference list, in groups of 64, and their two-bit codes."""
    n = r.varint()
    if n > n_samples:
        raise InvalidSourceError("a PGEN difference list is longer than the samples")
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    groups = -(-n // 64)
    width = max(1, (n_samples.bit_length() + 7) // 8)
    firsts = r.take(groups * width).reshape(groups, width).astype(np.int64) @ (1 << (8 * np.arange(width, dtype=np.int64)))
    r.take(groups - 1)
    codes = two_bit(r.take(-(-n // 4)), n) if with_codes else np.zeros(0, np.uint8)
    # a group is its first number and the distances of those that follow
    steps = np.zeros(n, dtype=np.int64)
    follows = np.arange(n) % 64 > 0
    steps[follows] = r.varints(n - groups)
    so_far = np.cumsum(steps)
    ids = so_far + np.repeat(firsts - so_far[::64], 64)[:n]
    if (np.diff(ids) <= 0).any() or ids[-1] >= n_samples:
        raise InvalidSourceError("sample numbers of a PGEN difference list aren't in order")
    return ids, codes


#: Pairs of codes of a one-bit record by its first byte (fixed values).
ONE_BIT = {1: (0, 1), 2: (0, 2), 3: (0, 3), 5: (1, 2), 6: (1, 3), 9: (2, 3)}


def _codes(r: Record, kind: int, n: int, base: np.ndarray | None) -> np.ndarray:
    """The hard-call codes of a variable record."""
    kind &= 7
    if kind == 0:
        return two_bit(r.take(-(-n // 4)), n)
    if kind == 1:
        pair = ONE_BIT.get(int(r.take(1)[0]))
        if pair is None:
            raise InvalidSourceError("a one-bit PGEN record names no pair of codes")
        codes = np.where(r.bits(n), np.uint8(pair[1]), np.uint8(pair[0]))
    elif kind in (2, 3):
        if base is None:
            raise InvalidSourceError("a PGEN record refers back to none")
        codes = base.copy()
    elif kind in (4, 6, 7):
        codes = np.full(n, kind - 4, dtype=np.uint8)
    else:
        raise InvalidSourceError(f"PGEN record type {kind} isn't supported")
    ids, values = _sample_list(r, n, True)
    codes[ids] = values
    return np.array([2, 1, 0, 3], dtype=np.uint8)[codes] if kind == 3 else codes


def _phase(r: Record, codes: np.ndarray) -> np.ndarray:
    """For each sample: 1 if its alternate lies first, 0 if second, -1 if unphased or no heterozygote."""
    het = np.flatnonzero(codes == 1)
    bits = np.unpackbits(np.frombuffer(r.data, np.uint8, offset=r.at), bitorder="little").astype(bool)
    if not len(bits):
        raise InvalidSourceError("a PGEN record ends before its phases")
    phased, used = het, 1
    if bits[0]:
        if len(bits) < 1 + len(het):
            raise InvalidSourceError("a PGEN record ends within its phases")
        phased = het[bits[1 : 1 + len(het)]]
        used = 8 * -(-(1 + len(het)) // 8)
    if len(bits) < used + len(phased):
        raise InvalidSourceError("a PGEN record ends within its phases")
    out = np.full(len(codes), -1, dtype=np.int8)
    out[phased] = bits[used : used + len(phased)]
    r.at += -(-(used + len(phased)) // 8)
    return out


def _amounts(raw: np.ndarray, full: bool) -> np.ndarray:
    """Dosages of raw values; NaN for the missing value of a full track."""
    gone = raw == 65535 if full else np.zeros(len(raw), dtype=bool)
    if ((raw > 32768) & ~gone).any():
        raise InvalidSourceError("a PGEN dosage is out of range")
    return np.where(gone, NAN, raw.astype(np.float32) / np.float32(16384))


def _deltas(raw: np.ndarray, full: bool) -> np.ndarray:
    signed = raw.view("<i2").astype(np.int32)
    gone = signed == -32768
    if (gone.any() and not full) or (np.abs(signed[~gone]) > 16384).any():
        raise InvalidSourceError("a PGEN phase difference is out of range")
    return np.where(gone, NAN, signed.astype(np.float32) / np.float32(16384))


def _split(total: np.ndarray, delta: np.ndarray) -> np.ndarray:
    if (np.isnan(total) != np.isnan(delta)).any():
        raise InvalidSourceError("PGEN dosages and phase differences are missing in different samples")
    both = np.stack([(total + delta) / 2, (total - delta) / 2], axis=1).astype(np.float32)
    if ((both < 0) | (both > 1)).any():
        raise InvalidSourceError("a PGEN haplotype dosage is out of range")
    return both


@dataclass
class Decoded:
    """One record: codes, phases, and dosages where they are stored."""

    codes: np.ndarray
    phase: np.ndarray | None = None
    stored: np.ndarray | None = None  # samples with a stored dosage
    dosage: np.ndarray | None = None  # of all samples
    pairs: np.ndarray | None = None  # explicit haplotype dosages, NaN rows where there are none
    explicit: np.ndarray | None = None


class PgenReader:
    """Decodes consecutive records; a reader must begin at a record that doesn't refer back."""

    def __init__(self, header: PgenHeader):
        self.h, self.base = header, None

    def decode(self, data: bytes, variant: int) -> Decoded:
        h, r = self.h, Record(data)
        n = h.n_samples
        if h.types is None:
            return self._fixed(r)
        kind = int(h.types[variant])
        codes = _codes(r, kind, n, self.base)
        if kind & 7 not in (2, 3):
            self.base = codes
        out = Decoded(codes)
        if kind & 0x10:
            out.phase = _phase(r, codes)
        track = (kind >> 5) & 3
        if track:
            if track == 1:
                stored = _sample_list(r, n, False)[0]
            else:
                stored = np.arange(n) if track == 2 else np.flatnonzero(r.bits(n))
            amounts = _amounts(r.u16(len(stored)), track == 2)
            out.stored, out.dosage = stored, PGEN_CALLS[codes]
            out.dosage[stored] = amounts
            out.explicit = np.zeros(n, dtype=bool)
            out.pairs = np.full((n, 2), NAN, dtype=np.float32)
            if kind & 0x80:
                at = stored if track == 2 else stored[r.bits(len(stored))]
                deltas = _deltas(r.u16(len(at)), track == 2)
                out.pairs[at] = _split(out.dosage[at], deltas)
                out.explicit[at] = True
        if r.at != len(data):
            raise InvalidSourceError("a PGEN record has bytes left over")
        return out

    def _fixed(self, r: Record) -> Decoded:
        n = self.h.n_samples
        out = Decoded(two_bit(r.take(-(-n // 4)), n))
        if self.h.mode > 2:
            out.stored, out.dosage = np.arange(n), _amounts(r.u16(n), True)
        if self.h.mode == 4:
            out.pairs, out.explicit = _split(out.dosage, _deltas(r.u16(n), True)), np.ones(n, dtype=bool)
        return out


def pgen_values(d: Decoded, kind: str, dosage: str, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calls of the samples ``keep``, and the values per sample that statistics count."""
    hard = PGEN_CALLS[d.codes]
    total = hard if dosage == "hardcall" or d.dosage is None else d.dosage
    if kind == "geno":
        return total[keep], total[keep]
    if dosage == "hardcall":
        if d.stored is not None:
            raise UnsupportedRepresentation("haplotypes of hard calls can't be read from records with dosages", hard[keep])
        if d.phase is None:
            raise UnsupportedRepresentation("the record has no phases", hard[keep])
    phase = np.full(len(hard), -1, dtype=np.int8) if d.phase is None else d.phase
    pairs = np.stack([hard / 2, hard / 2], axis=1).astype(np.float32)
    het = d.codes == 1
    pairs[het & (phase == 1)] = (1, 0)
    pairs[het & (phase == 0)] = (0, 1)
    open_ = het & (phase < 0)
    if dosage == "dosage" and d.stored is not None:
        stored = np.zeros(len(hard), dtype=bool)
        stored[d.stored] = True
        open_ &= ~stored
        implied = stored & ~d.explicit & ~np.isnan(total)
        high, low = np.minimum(total, 1), np.maximum(total - 1, 0)
        first = phase == 1
        pairs[implied] = np.stack([np.where(first, high, low), np.where(first, low, high)], axis=1)[implied]
        pairs[d.explicit] = d.pairs[d.explicit]
        pairs[stored & np.isnan(total)] = NAN
        open_ |= implied & (phase < 0)
    if open_[keep].any():
        raise UnsupportedRepresentation("a selected heterozygote has no phase", total[keep])
    return pairs[keep].reshape(-1), total[keep]
