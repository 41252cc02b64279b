"""Writers of small genotype files, for the queries and tests of the file sources.

A cohort is a list of variants ``(chrom, pos, id, a0, a1)``, a row of calls for each (0, 1, 2 or None for
missing) and a list of sample names.  Files are written whole by the driver.
"""

from __future__ import annotations

import gzip
import sqlite3
import struct
import zlib
from bisect import bisect_right
from pathlib import Path

Variant = tuple[str, int, str, str, str]
GT = {0: "0/0", 1: "0/1", 2: "1/1", None: "./."}


def contigs(variants: list[Variant]) -> list[str]:
    return list(dict.fromkeys(v[0] for v in variants))


def vcf_text(rows: list[str], samples: list[str]) -> str:
    head = "##fileformat=VCFv4.2\n#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]) + "\n"
    return head + "".join(r + "\n" for r in rows)


def vcf_row(variant, values, qual=".", fmt="GT") -> str:
    chrom, pos, name, ref, alt = variant
    return "\t".join([chrom, str(pos), name, ref, alt, str(qual), "PASS", ".", fmt, *values])


def vcf_rows(variants: list[Variant], calls: list[list]) -> list[str]:
    return [vcf_row(v, [GT[c] for c in row]) for v, row in zip(variants, calls)]


def write_vcf(path: Path, rows: list[str], samples: list[str]) -> Path:
    path.write_text(vcf_text(rows, samples))
    return path


def pack(codes: list[int]) -> bytes:
    out = bytearray(-(-len(codes) // 4))
    for i, c in enumerate(codes):
        out[i // 4] |= c << (2 * (i % 4))
    return bytes(out)


def write_plink1(prefix: Path, calls: list[list], variants: list[Variant], samples: list[str]) -> Path:
    code = {2: 0, None: 1, 1: 2, 0: 3}
    prefix.with_suffix(".bed").write_bytes(b"\x6c\x1b\x01" + b"".join(pack([code[c] for c in row]) for row in calls))
    prefix.with_suffix(".bim").write_text("".join(f"{c}\t{n}\t0\t{p}\t{a1}\t{a0}\n" for c, p, n, a0, a1 in variants))
    prefix.with_suffix(".fam").write_text("".join(f"F{k} {s} 0 0 {1 + k % 2} -9\n" for k, s in enumerate(samples)))
    return prefix


def pgen_code(c) -> int:
    return 3 if c is None else c


def write_plink2_text(prefix: Path, variants, samples, quals=None) -> None:
    extra = "\tQUAL" if quals else ""
    rows = [f"{c}\t{p}\t{n}\t{a0}\t{a1}" + (f"\t{quals[k]}" if quals else "") for k, (c, p, n, a0, a1) in enumerate(variants)]
    prefix.with_suffix(".pvar").write_text("##source=test\n#CHROM\tPOS\tID\tREF\tALT" + extra + "\n" + "".join(r + "\n" for r in rows))
    prefix.with_suffix(".psam").write_text("#FID\tIID\tPAT\tMAT\tSEX\tPHENO1\n" + "".join(f"0\t{s}\t0\t.\t{1 + k % 2}\tNA\n" for k, s in enumerate(samples)))


def write_plink2(prefix: Path, calls: list[list], variants: list[Variant], samples: list[str], quals=None, dosages=None, deltas=None) -> Path:
    """Fixed-width records: hard calls, with dosages, or with dosages and phase differences."""
    mode = 2 + (dosages is not None) + (deltas is not None)
    body = b""
    for k, row in enumerate(calls):
        body += pack([pgen_code(c) for c in row])
        if dosages is not None:
            body += b"".join(struct.pack("<H", 65535 if d is None else round(d * 16384)) for d in dosages[k])
        if deltas is not None:
            body += b"".join(struct.pack("<h", -32768 if d is None else round(d * 16384)) for d in deltas[k])
    prefix.with_suffix(".pgen").write_bytes(b"\x6c\x1b" + bytes([mode]) + struct.pack("<II", len(calls), len(samples)) + b"\0" + body)
    write_plink2_text(prefix, variants, samples, quals)
    return prefix


def write_pgen_records(prefix: Path, records: list[tuple[int, bytes]], variants, samples) -> Path:
    """Variable-width records of given types."""
    n_blocks = -(-len(records) // 65536)
    head = b"\x6c\x1b\x10" + struct.pack("<II", len(records), len(samples)) + bytes([4 | 1])
    table = b""
    for k in range(0, len(records), 65536):
        part = records[k : k + 65536]
        table += bytes(t for t, _ in part) + b"".join(struct.pack("<H", len(b)) for _, b in part)
    first = len(head) + 8 * n_blocks + len(table)
    prefix.with_suffix(".pgen").write_bytes(head + struct.pack("<Q", first) + table + b"".join(b for _, b in records))
    write_plink2_text(prefix, variants, samples)
    return prefix


def varints(values: list[int]) -> bytes:
    out = bytearray()
    for v in values:
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def difference_list(samples: list[int], codes: list[int], n_samples: int) -> bytes:
    """A list of samples and their codes: groups of 64 begin with a whole number, then come distances."""
    out = varints([len(samples)])
    if not samples:
        return out
    width = max(1, -(-n_samples.bit_length() // 8))
    groups = [samples[k : k + 64] for k in range(0, len(samples), 64)]
    deltas = [varints([b - a for a, b in zip(g, g[1:])]) for g in groups]
    out += b"".join(g[0].to_bytes(width, "little") for g in groups)
    out += bytes(len(d) - 63 for d in deltas[:-1])
    return out + pack(codes) + b"".join(deltas)


def pgen_records(calls: list[list]) -> list[tuple[int, bytes]]:
    """Hard-call records of the type that is shortest: plain, two-valued, as the last plain one, or mostly one value."""
    out: list[tuple[int, bytes]] = []
    base: list[int] | None = None
    for k, row in enumerate(calls):
        codes = [3 if c is None else c for c in row]
        n = len(codes)
        choices = [(0, pack(codes))]
        for kind, usual in ((4, 0), (6, 2), (7, 3)):
            odd = [i for i, c in enumerate(codes) if c != usual]
            choices.append((kind, difference_list(odd, [codes[i] for i in odd], n)))
        counts = sorted(((codes.count(c), c) for c in range(4)), reverse=True)
        low, high = sorted(c for _, c in counts[:2])
        shape = {(0, 1): 1, (0, 2): 2, (0, 3): 3, (1, 2): 5, (1, 3): 6, (2, 3): 9}[low, high]
        rest = [i for i, c in enumerate(codes) if c not in (low, high)]
        choices.append((1, bytes([shape]) + bits([int(c == high) for c in codes]) + difference_list(rest, [codes[i] for i in rest], n)))
        if base is not None and k % 65536:
            for kind, like in ((2, codes), (3, [(2, 1, 0, 3)[c] for c in codes])):
                odd = [i for i, (c, b) in enumerate(zip(like, base)) if c != b]
                choices.append((kind, difference_list(odd, [like[i] for i in odd], n)))
        best = min(choices, key=lambda c: len(c[1]))
        if best[0] not in (2, 3):
            base = codes
        out.append(best)
    return out


def bits(values: list[int]) -> bytes:
    out = bytearray(-(-len(values) // 8))
    for i, v in enumerate(values):
        out[i // 8] |= v << (i % 8)
    return bytes(out)


def write_bgen(path: Path, blocks: list[bytes], variants: list[Variant], samples: list[str], compression=0, with_samples=True, index=False) -> Path:
    text = lambda s, w: len(s).to_bytes(w, "little") + s.encode()
    flags = compression | (2 << 2) | (with_samples << 31)
    ids = b"".join(text(s, 2) for s in samples)
    sample_block = struct.pack("<II", 8 + len(ids), len(samples)) + ids if with_samples else b""
    out = struct.pack("<IIII", 20 + len(sample_block), 20, len(variants), len(samples)) + b"bgen" + struct.pack("<I", flags) + sample_block
    rows = []
    for (chrom, pos, name, a0, a1), block in zip(variants, blocks):
        start = len(out)
        out += text("v" + name, 2) + text(name, 2) + text(chrom, 2) + struct.pack("<IH", pos, 2) + text(a0, 4) + text(a1, 4)
        if compression == 1:
            packed = zlib.compress(block)
            out += struct.pack("<II", len(packed) + 4, len(block)) + packed
        elif compression == 2:
            import zstandard

            packed = zstandard.ZstdCompressor().compress(block)
            out += struct.pack("<II", len(packed) + 4, len(block)) + packed
        else:
            out += struct.pack("<I", len(block)) + block
        rows.append((chrom, pos, name, 2, a0, a1, start, len(out) - start))
    path.write_bytes(out)
    if index:
        with sqlite3.connect(str(path) + ".bgi") as db:
            db.execute("CREATE TABLE Variant (chromosome TEXT, position INT, rsid TEXT, number_of_alleles INT, allele1 TEXT, allele2 TEXT, file_start_position INT, size_in_bytes INT)")
            db.executemany("INSERT INTO Variant VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    return path


def bgen_block(pairs: list, phased=False, n_bits=8, pack_missing=False) -> bytes:
    """Probabilities of diploid samples; None is a missing sample."""
    packed = [p if p is not None else (0, 0) for p in pairs if p is not None or pack_missing]
    stream = [(v >> b) & 1 for pair in packed for v in pair for b in range(n_bits)]
    ploidy = bytes(2 if p is not None else 0x82 for p in pairs)
    return struct.pack("<IHBB", len(pairs), 2, 2, 2) + ploidy + bytes([phased, n_bits]) + bits(stream)


def bgzf(data: bytes, block: int = 1 << 14) -> tuple[bytes, list[tuple[int, int]]]:
    """Blocked gzip, and (place in the data, place in the file) of each block."""
    out, places = b"", []
    for k in range(0, len(data), block):
        part = data[k : k + block]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = c.compress(part) + c.flush()
        places.append((k, len(out)))
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(part), len(part))
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"), places


def write_bgzf_vcf(path: Path, rows: list[str], samples: list[str], block: int = 200, index: str | None = "tbi") -> Path:
    text = vcf_text(rows, samples).encode()
    data, places = bgzf(text, block)
    path.write_bytes(data)
    if index:
        lines, at = {}, 0

        def virtual(p: int) -> int:
            start, place = places[bisect_right(places, (p, len(data))) - 1]
            return place << 16 | p - start

        end = len(text)
        for line in text.splitlines(keepends=True):
            if not line.startswith(b"#"):
                f = line.split(b"\t")
                stop = at + len(line)
                lines.setdefault(f[0].decode(), []).append((int(f[1]) - 1, virtual(at), virtual(stop) if stop < end else (len(data) << 16)))
            at += len(line)
        names = b"".join(n.encode() + b"\0" for n in lines)
        head = struct.pack("<6i", 2, 1, 2, 0, ord("#"), 0) + struct.pack("<i", len(names)) + names
        body = b""
        for chunks in lines.values():
            bins: dict[int, list] = {}
            for pos, a, b in chunks:
                bins.setdefault(4681 + (pos >> 14), []).append((a, b))
            body += struct.pack("<i", len(bins))
            for number, pairs in bins.items():
                if index == "tbi":
                    body += struct.pack("<Ii", number, len(pairs))
                else:
                    body += struct.pack("<IQi", number, pairs[0][0], len(pairs))
                body += b"".join(struct.pack("<2Q", *p) for p in pairs)
            if index == "tbi":
                windows = 1 + max(p for p, _, _ in chunks) // 16384
                first = [min((a for p, a, _ in chunks if p >> 14 >= w), default=0) for w in range(windows)]
                body += struct.pack("<i", windows) + struct.pack(f"<{windows}Q", *first)
        if index == "tbi":
            content = b"TBI\1" + struct.pack("<i", len(lines)) + head + body
        else:
            content = b"CSI\1" + struct.pack("<3i", 14, 5, len(head)) + head + struct.pack("<i", len(lines)) + body
        Path(f"{path}.{index}").write_bytes(gzip.compress(content))
    return path


def _typed(values: list[int] | bytes) -> bytes:
    if isinstance(values, bytes):
        n = len(values)
        return (bytes([(n << 4) | 7]) if n < 15 else b"\xf7\x11" + bytes([n])) + values
    return bytes([(len(values) << 4) | 1]) + struct.pack(f"<{len(values)}b", *values)


def write_bcf(path: Path, rows: list[tuple], samples: list[str]) -> Path:
    """Rows of (variant, qual, [gt per sample as byte pairs], [dosage per sample] or None)."""
    names = contigs([row[0] for row in rows])
    head = "##fileformat=VCFv4.2\n##FILTER=<ID=PASS,Description=\"\">\n" + "".join(f"##contig=<ID={n}>\n" for n in names) + "##FORMAT=<ID=GT,Number=1>\n##FORMAT=<ID=DS,Number=1>\n#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]) + "\n\0"
    data = b"BCF\2\2" + struct.pack("<I", len(head)) + head.encode()
    for (chrom, pos, name, a0, a1), qual, gts, ds in rows:
        alleles = [a0, *a1.split(",")]
        raw_qual = struct.pack("<I", 0x7F800001) if qual is None else struct.pack("<f", qual)
        shared = struct.pack("<3i", names.index(chrom), pos - 1, len(a0)) + raw_qual + struct.pack("<II", len(alleles) << 16, ((1 + (ds is not None)) << 24) | len(samples))
        shared += _typed(name.encode()) + b"".join(_typed(a.encode()) for a in alleles) + _typed([0])
        own = _typed([1]) + bytes([(2 << 4) | 1]) + b"".join(struct.pack("<2b", *g) for g in gts)
        if ds is not None:
            own += _typed([2]) + bytes([(1 << 4) | 5]) + b"".join(struct.pack("<I", 0x7F800001) if d is None else struct.pack("<f", d) for d in ds)
        data += struct.pack("<II", len(shared), len(own)) + shared + own
    path.write_bytes(bgzf(data)[0])
    return path
