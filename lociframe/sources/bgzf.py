"""Blocked gzip files: their blocks, lines of a range of blocks, and position indexes."""

from __future__ import annotations

import gzip
import os
import struct
import zlib
from collections.abc import Iterator

from lociframe.errors import InvalidSourceError


def block_size(head: bytes) -> int | None:
    """The size of the block that begins with ``head``; None if it isn't blocked."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = head[12 : 12 + int.from_bytes(head[10:12], "little")]
    at = 0
    while at + 4 <= len(extra):
        n = int.from_bytes(extra[at + 2 : at + 4], "little")
        if extra[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(extra[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return None


def is_blocked(path: str) -> bool:
    with open(path, "rb") as f:
        return block_size(f.read(64)) is not None


def block_starts(path: str) -> list[int]:
    """The places of all blocks, found from their sizes alone."""
    out, at, end = [], 0, os.path.getsize(path)
    with open(path, "rb") as f:
        while at < end:
            f.seek(at)
            size = block_size(f.read(64))
            if size is None:
                raise InvalidSourceError(f"{path}: no block at byte {at}")
            out.append(at)
            at += size
    return out


def blocks_from(path: str, start: int) -> Iterator[tuple[int, bytes]]:
    """Places and contents of the blocks from ``start`` on."""
    with open(path, "rb") as f:
        at = start
        while True:
            f.seek(at)
            size = block_size(head := f.read(64))
            if size is None:
                if head:
                    raise InvalidSourceError(f"{path}: no block at byte {at}")
                return
            f.seek(at)
            raw = f.read(size)
            try:
                yield at, zlib.decompress(raw, 31)
            except zlib.error as error:
                raise InvalidSourceError(f"{path}: the block at byte {at} is broken: {error}") from None
            at += size


def lines_between(path: str, start: int, end: int | None, inside: int = 0, end_inside: int = 0, split: bool = False) -> Iterator[tuple[int, str]]:
    """Lines that begin in ``[start, end)``, each with its virtual place ``block << 16 | byte``.

    A line may end in later blocks.  Ranges of blocks that part a file are read with
    ``split``: each but the file's first leaves its first line to the range before,
    which therefore also takes a line that begins just at its end.
    """
    held, place = b"", None
    limit = None if end is None else (end << 16) | end_inside
    skipping = split and start > 0
    for at, data in blocks_from(path, start):
        cursor = inside if at == start else 0
        while cursor < len(data) or not data:
            if not data:
                break
            if place is None:
                place = (at << 16) | cursor
                if not skipping and limit is not None and (place > limit or (place == limit and not split)):
                    return
            cut = data.find(b"\n", cursor)
            if cut < 0:
                held += data[cursor:]
                break
            line = held + data[cursor:cut]
            if skipping:
                skipping = False
            else:
                yield place, line.rstrip(b"\r").decode()
            held, place, cursor = b"", None, cut + 1
    if held and not skipping:
        yield place, held.rstrip(b"\r").decode()


def _bins(start: int, end: int, shift: int, depth: int) -> set[int]:
    """Numbers of the bins that can hold positions from ``start`` to ``end``, counted from 0."""
    out, first, width = set(), 0, shift + 3 * depth
    for level in range(depth + 1):
        out.update(range(first + (start >> width), first + (end >> width) + 1))
        first += 1 << (3 * level)
        width -= 3
    return out


def region_chunks(path: str, chrom: str, start: int, end: int) -> list[tuple[int, int]] | None:
    """Virtual ranges that hold a region, from ``.tbi`` or else ``.csi``; None without index."""
    for suffix in (".tbi", ".csi"):
        if os.path.isfile(path + suffix):
            with gzip.open(path + suffix) as f:
                return _chunks(f.read(), chrom, start - 1, end - 1)
    return None


def _chunks(data: bytes, chrom: str, start: int, end: int) -> list[tuple[int, int]]:
    magic = data[:4]
    if magic == b"TBI\1":
        n_ref, at, shift, depth = struct.unpack_from("<i", data, 4)[0], 8, 14, 5
    elif magic == b"CSI\1":
        shift, depth, aux = struct.unpack_from("<3i", data, 4)
        at = 16
        n_ref = struct.unpack_from("<i", data, 16 + aux)[0]
    else:
        raise InvalidSourceError("the index has an unknown form")
    names_length = struct.unpack_from("<i", data, at + 24)[0]
    names = data[at + 28 : at + 28 + names_length].split(b"\0")[:-1]
    at = at + 28 + names_length if magic == b"TBI\1" else 20 + aux
    wanted = _bins(start, min(end, (1 << (shift + 3 * depth)) - 1), shift, depth)
    found: list[tuple[int, int]] = []
    least = 0
    for ref in range(n_ref):
        here = ref < len(names) and names[ref].decode() == chrom
        n_bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n_bins):
            number = struct.unpack_from("<I", data, at)[0]
            at += 4 if magic == b"TBI\1" else 12
            n = struct.unpack_from("<i", data, at)[0]
            at += 4
            if here and number in wanted:
                found += [struct.unpack_from("<2Q", data, at + 16 * k) for k in range(n)]
            at += 16 * n
        if magic == b"TBI\1":
            n = struct.unpack_from("<i", data, at)[0]
            at += 4
            if here and n:
                least = struct.unpack_from("<Q", data, at + 8 * min(start >> 14, n - 1))[0]
            at += 8 * n
    merged: list[tuple[int, int]] = []
    for a, b in sorted(c for c in found if c[1] > least):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged
