"""Token ids of whole texts by a public byte-level vocabulary.

No merge can join two bytes that stand side by side inside no token, so between
such bytes a token always ends.  Texts are cut there, all cuts of a batch being
found at once from a 256 x 256 table; the fragments are encoded independently,
each different one once a worker, and their ids are put together again.

A cut must also leave the vocabulary's own splitting of text unchanged.  That
splitting reads from left to right without looking back, and looks ahead only
behind white space; therefore no cut is made after white space, nor before an
apostrophe that follows a sign, as it could then open a contraction.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fragments a worker keeps with their ids, and the longest fragment kept, in bytes.
CACHED, LONGEST_CACHED = 400_000, 64
#: The splitting pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Last characters of which nothing is cut off: white space of two and three bytes (fixed values).
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: A vocabulary file may have at most so many bytes to be sent to every worker.
MOST_VOCABULARY_BYTES = 16 << 20


def default_vocabulary() -> str:
    """The place of byte_bpe_50k; other places are given as a parameter."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Tokens and ids of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def joined_pairs(tokens) -> np.ndarray:
    """Whether two bytes stand side by side in any token."""
    joined = np.zeros((256, 256), dtype=bool)
    for token in tokens:
        b = np.frombuffer(token, dtype=np.uint8)
        joined[b[:-1], b[1:]] = True
    return joined


class FragmentEncoder:
    """Encodes batches of texts by forced boundaries."""

    def __init__(self, content: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = read_ranks(content)
        self._joined = joined_pairs(ranks).ravel()
        self._encode = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[bytes, list[int]] = {}
        self._white = np.zeros(256, dtype=bool)
        self._white[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
        self._plain = np.zeros(256, dtype=bool)
        self._plain[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions in UTF-8 ``data`` before which a forced boundary lies."""
        if len(data) < 2:
            return np.zeros(0, dtype=np.int64)
        before, after = data[:-1], data[1:]
        cut = ~self._joined[before.astype(np.int32) * 256 + after]
        cut &= (after & 0xC0) != 0x80
        cut &= ~self._white[before]
        cut &= (after != 39) | self._plain[before]
        at = np.flatnonzero(cut) + 1
        high = at[data[at - 1] >= 0x80]
        if len(high):
            two = (data[np.maximum(high - 2, 0)].astype(np.int64) << 8) | data[high - 1]
            three = (data[np.maximum(high - 3, 0)].astype(np.int64) << 16) | two
            spaces = [int.from_bytes(s, "big") for s in WIDE_SPACES]
            wide = np.isin(two, [s for s in spaces if s < 1 << 16]) | np.isin(three, [s for s in spaces if s >= 1 << 16])
            at = np.setdiff1d(at, high[wide], assume_unique=True)
        return at

    def _ids(self, fragment: bytes) -> list[int]:
        ids = self._encode(fragment.decode("utf-8"))
        if len(fragment) <= LONGEST_CACHED:
            if len(self._known) >= CACHED:
                self._known.clear()
            self._known[fragment] = ids
        return ids

    def encode(self, text: pa.Array) -> pa.ListArray:
        """The ids of each text; null and empty texts have none."""
        text = text.fill_null("").cast(pa.large_string())
        n = len(text)
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64, count=n + 1 + text.offset)[text.offset :]
        content = (text.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        bounds = np.union1d(self.cuts(np.frombuffer(content, dtype=np.uint8)), offsets)
        places = bounds.tolist()
        get, encode = self._known.get, self._ids
        parts = [get(f := content[a:b]) or encode(f) for a, b in zip(places, places[1:])]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=int(ends[-1]))
        return pa.ListArray.from_arrays(pa.array(ends[np.searchsorted(bounds, offsets)].astype(np.int32)), pa.array(ids))


def encode_texts(documents: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every document, without special tokens.

    Null and empty texts have an empty list, repeated rows come out each, strings of
    special tokens are ordinary text, and texts are read whole however long they
    are.  ``vocabulary`` is the path of a rank file on the driver; its bytes, of a
    checked size, are broadcast.
    """
    spark: SparkSession = documents.sparkSession
    path = vocabulary or default_vocabulary()
    if os.path.getsize(path) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has more than {MOST_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(path, sent)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column(1))], names=["doc_id", "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, ids array<int>")


_ENCODERS: dict[str, FragmentEncoder] = {}


def _worker_encoder(path: str, sent) -> FragmentEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = FragmentEncoder(sent.value)
    return _ENCODERS[path]
