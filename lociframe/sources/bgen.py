"""BGEN layout 2: header, samples, variants and probabilities as expected counts of the second allele."""

from __future__ import annotations

import os
import sqlite3
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from lociframe.errors import InvalidSourceError, UnsupportedRepresentation

NAN = np.float32("nan")
TOLERANCE = 1e-6


@dataclass
class BgenHeader:
    first: int
    n_variants: int
    n_samples: int
    compression: int
    samples: list[str] | None


def read_header(path: str) -> BgenHeader:
    """The header and, if the file has them, the sample IDs."""
    with open(path, "rb") as f:
        head = f.read(24)
        if len(head) < 24:
            raise InvalidSourceError(f"{path} ends within its header")
        offset, length, v, n = (int.from_bytes(head[k : k + 4], "little") for k in (0, 4, 8, 12))
        if head[16:20] not in (b"bgen", b"\0\0\0\0") or length < 20:
            raise InvalidSourceError(f"{path} has no BGEN header")
        f.seek(4 + length - 4)
        flags = int.from_bytes(f.read(4), "little")
        compression, layout = flags & 3, (flags >> 2) & 15
        if layout != 2:
            raise UnsupportedRepresentation(f"BGEN layout {layout} isn't supported")
        if compression == 3:
            raise InvalidSourceError(f"{path}: unknown compression")
        samples = None
        if flags >> 31:
            block = f.read(8)
            if int.from_bytes(block[4:], "little") != n:
                raise InvalidSourceError(f"{path}: the sample block has another number of samples")
            samples = [_text(f, 2) for _ in range(n)]
        if offset + 4 < 4 + length:
            raise InvalidSourceError(f"{path}: the variants begin within the header")
    return BgenHeader(offset + 4, v, n, compression, samples)


def _exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise InvalidSourceError("the BGEN file ends within a record")
    return data


def _text(f, width: int) -> str:
    return _exactly(f, int.from_bytes(_exactly(f, width), "little")).decode()


def read_samples(path: str, sample_path: str | None, header: BgenHeader) -> list[str]:
    """Sample IDs from the file, else from the first column of the ``.sample`` file behind two header lines."""
    ids = header.samples
    if ids is None:
        if sample_path is None:
            raise InvalidSourceError(f"{path} has no sample IDs and no .sample file")
        with open(sample_path, encoding="utf-8") as f:
            ids = [line.split()[0] for line in f.read().splitlines()[2:] if line.strip()]
    if len(ids) != header.n_samples:
        raise InvalidSourceError(f"{path} has {header.n_samples} samples, but {len(ids)} IDs")
    if "" in ids or len(set(ids)) < len(ids):
        raise InvalidSourceError(f"{path} has empty or repeated sample IDs")
    return ids


def read_variant(f, compression: int) -> tuple[tuple, int, int]:
    """``(chrom, pos, id, a0, a1, ref, alt, qual)`` at the cursor, and the payload's place and length."""
    name, rsid, chrom = _text(f, 2), _text(f, 2), _text(f, 2)
    pos, k = int.from_bytes(_exactly(f, 4), "little"), int.from_bytes(_exactly(f, 2), "little")
    if k != 2:
        raise UnsupportedRepresentation(f"BGEN variants with {k} alleles aren't supported")
    a0, a1 = _text(f, 4), _text(f, 4)
    size = int.from_bytes(_exactly(f, 4), "little")
    return (chrom, pos, rsid or name, a0, a1, None, None, None), f.tell(), size


def walk(path: str, header: BgenHeader) -> Iterator[int]:
    """The places of all variants, read from their lengths without their payloads."""
    with open(path, "rb") as f:
        f.seek(header.first)
        for _ in range(header.n_variants):
            yield f.tell()
            _, at, size = read_variant(f, header.compression)
            f.seek(at + size)
        if f.tell() > os.path.getsize(path):
            raise InvalidSourceError(f"{path} ends within a record")


def indexed(path: str, region: tuple[str, int, int] | None) -> list[tuple[int, int]] | None:
    """Places and sizes of a region's variants from the index beside the file; None without index."""
    if not os.path.isfile(path + ".bgi"):
        return None
    with sqlite3.connect(f"file:{path}.bgi?mode=ro", uri=True) as db:
        where, args = (" WHERE chromosome = ? AND position BETWEEN ? AND ?", region) if region else ("", ())
        return db.execute("SELECT file_start_position, size_in_bytes FROM Variant" + where + " ORDER BY file_start_position", args).fetchall()


def payload(raw: bytes, compression: int) -> bytes:
    """The probability block, decompressed and of the length it declares."""
    if not compression:
        return raw
    size = int.from_bytes(raw[:4], "little")
    try:
        if compression == 1:
            out = zlib.decompress(raw[4:])
        else:
            import zstandard

            out = zstandard.ZstdDecompressor().decompress(raw[4:], max_output_size=size)
    except Exception as error:
        raise InvalidSourceError(f"a BGEN block can't be decompressed: {error}") from None
    if len(out) != size:
        raise InvalidSourceError("a BGEN block has another length than it declares")
    return out


def _numbers(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.int64)
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return each.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def probabilities(block: bytes, n_samples: int) -> tuple[np.ndarray, np.ndarray, bool, int]:
    """Pairs of whole-number probabilities of all samples, missing samples, phasedness and bits."""
    if len(block) < 10 + n_samples:
        raise InvalidSourceError("a BGEN block ends early")
    n, k = int.from_bytes(block[:4], "little"), int.from_bytes(block[4:6], "little")
    if n != n_samples or k != 2:
        raise InvalidSourceError("a BGEN block has other counts than the file")
    ploidy = np.frombuffer(block, np.uint8, count=n, offset=8)
    gone = ploidy >= 128
    if ((ploidy[~gone] & 63) != 2).any():
        raise UnsupportedRepresentation("BGEN samples that aren't diploid aren't supported")
    phased, bits = block[8 + n], block[9 + n]
    if phased > 1 or not 1 <= bits <= 32:
        raise InvalidSourceError("a BGEN block has an unknown form")
    packed = block[10 + n :]
    called = int((~gone).sum())
    length = lambda samples: -(-samples * 2 * bits // 8)
    pairs = np.zeros((n, 2), dtype=np.int64)
    if len(packed) == length(called):
        pairs[~gone] = _numbers(packed, bits, 2 * called).reshape(-1, 2)
    elif gone.any() and len(packed) == length(n):
        pairs = _numbers(packed, bits, 2 * n).reshape(-1, 2)
    else:
        raise InvalidSourceError("a BGEN block has too many or too few probabilities")
    return pairs, gone, bool(phased), bits


def values(block: bytes, n_samples: int, kind: str, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of the samples ``keep``, by sample or haplotype, and those by sample."""
    pairs, gone, phased, bits = probabilities(block, n_samples)
    most = (1 << bits) - 1
    if phased:
        p = pairs / float(most)
        total = np.clip(2.0 - p[:, 0] - p[:, 1], 0, 2).astype(np.float32)
    else:
        aa, ab = (pairs[:, k].astype(np.float32) / np.float32(most) for k in (0, 1))
        bb = np.float32(1) - aa - ab
        total = ab + np.float32(2) * bb
        if ((bb < -TOLERANCE) | (total < -TOLERANCE) | (total > 2 + TOLERANCE))[~gone].any():
            raise InvalidSourceError("BGEN probabilities add up to more than one")
        total = np.clip(total, np.float32(0), np.float32(2))
    total = np.where(gone, NAN, total).astype(np.float32)
    if kind == "geno":
        return total[keep], total[keep]
    if not phased:
        raise UnsupportedRepresentation("the BGEN variant isn't phased", total[keep])
    each = np.where(gone[:, None], NAN, np.clip(1.0 - p, 0, 1)).astype(np.float32)
    return each[keep].reshape(-1), total[keep]
