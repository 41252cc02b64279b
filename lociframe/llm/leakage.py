"""Held-out passages in training texts, found by winnowed fingerprints.

Texts are words without case and accents.  Of the hashes of all runs of ``SPAN_K``
words, winnowing keeps the smallest in every window of ``WINDOW`` runs; two texts
that share ``SPAN_K + WINDOW - 1`` words in a row, a whole span, are then sure to
share a kept fingerprint at aligned places.  Fingerprints of the corpus that no
held-out item has are dropped; those left are joined by the whole spans around them,
so that only texts meet that share one, and the hits of a pair are extended along the
document in one walk through an automaton of the passage.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.plans import Workspace, sized_join, skew_join, within
from lociframe.plans.joins import BROADCAST_ROWS

#: Words in a fingerprinted run, and runs in a window: spans of 10 words are guaranteed.
SPAN_K, WINDOW = 5, 6
#: Words a shared span must have.
LEAST_WORDS = 10
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MARK = regex.compile(r"\p{M}+")
_ASCII_WORD = regex.compile(r"[a-z0-9]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits without letter case and accents."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return _WORD.findall(_MARK.sub("", folded))


_HASHES: dict[str, int] = {}


def _hash(word: str) -> int:
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    h = _HASHES[word] = xxhash.xxh3_64_intdigest(word)
    return h


def _run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(hashes) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def winnow(hashes: np.ndarray, starts: np.ndarray, k: int = SPAN_K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions and fingerprints of texts laid end to end.

    ``hashes`` are the words' hashes, ``starts`` the first word of each text and the
    end.  Of equal smallest fingerprints in a window the last is kept.
    """
    n = len(hashes)
    if n < k + window - 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    prints = _run_hashes(hashes, k)
    m = len(prints) - window + 1
    best, at = prints[:m].copy(), np.arange(m)
    for j in range(1, window):
        smaller = prints[j : j + m] <= best
        best[smaller] = prints[j : j + m][smaller]
        at[smaller] = np.flatnonzero(smaller) + j
    text = np.searchsorted(starts, np.arange(m), side="right")
    whole = np.arange(m) + k + window - 1 <= starts[np.minimum(text, len(starts) - 1)]
    kept = np.unique(at[whole])
    return kept, prints[kept].view(np.int64)


def spans_around(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int = WINDOW, span: int = SPAN_K + WINDOW - 1) -> tuple[np.ndarray, np.ndarray]:
    """Which fingerprint, and first word, of all whole spans within ``[lo, hi)`` that a fingerprint at ``at`` lies in."""
    first = at[:, None] + np.arange(1 - window, 1)[None, :]
    inside = (first >= lo[:, None]) & (first + span <= hi[:, None])
    return np.nonzero(inside)[0], first[inside]


def fingerprints(texts: DataFrame, id_column: str, text_column: str, among: Broadcast | None = None) -> DataFrame:
    """``(id, at, print, spans)``: the kept fingerprints of every text, their word positions and the hashes of the whole spans around them.

    ``among`` holds the sorted fingerprints that are wanted; without it all are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _HASHES.get
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                hashes: list[int] = []
                starts = [0]
                for text in part.column(1).to_pylist():
                    hashes.extend([get(w) or _hash(w) for w in words_of(text)])
                    starts.append(len(hashes))
                bounds, words = np.array(starts, dtype=np.int64), np.array(hashes, dtype=np.uint64)
                at, prints = winnow(words, bounds)
                if among is not None and len(at):
                    wanted = np.isin(prints, among.value)
                    at, prints = at[wanted], prints[wanted]
                row = np.searchsorted(bounds, at, side="right") - 1
                which, begin = spans_around(at, bounds[row], bounds[row + 1])
                spans = _run_hashes(words, SPAN_K + WINDOW - 1)[begin].view(np.int64) if len(begin) else np.zeros(0, dtype=np.int64)
                offsets = np.searchsorted(which, np.arange(len(at) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array((at - bounds[row]).astype(np.int32)), pa.array(prints), pa.ListArray.from_arrays(pa.array(offsets), pa.array(spans))],
                    names=["id", "at", "print", "spans"],
                )

    kind = texts.schema[id_column].dataType.simpleString()
    return texts.select(id_column, text_column).where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).mapInArrow(run, f"id {kind}, at int, print bigint, spans array<bigint>")


class Automaton:
    """All runs of words of a passage, so that a text is matched against them in one walk.

    The suffix automaton of the passage: it has at most two states a word.
    """

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for word in words:
            state = self._add(self.length[last] + 1, {}, 0)
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = state
                at = self.link[at]
            if at >= 0:
                old = self.next[at][word]
                if self.length[at] + 1 < self.length[old]:
                    copy = self._add(self.length[at] + 1, dict(self.next[old]), self.link[old])
                    while at >= 0 and self.next[at].get(word) == old:
                        self.next[at][word] = copy
                        at = self.link[at]
                    self.link[old] = copy
                    old = copy
                self.link[state] = old
            last = state

    def _add(self, length: int, following: dict[str, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def longest(self, words: list[str]) -> tuple[int, int]:
        """First place and length of the first longest run in ``words`` that is a run of the passage."""
        state = length = 0
        best, end = 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length > best:
                best, end = length, i + 1
        return end - best, best


def leaked_spans(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, eval_id, first_word, n_words)``: the longest shared span of each leaking pair, of several the first.

    ``documents`` has ``doc_id, text``; ``items`` has ``eval_id, passage``.  Pairs
    with at least ``least`` shared words in a row come out once, also if rows are
    repeated.  Null and empty texts share nothing; an empty side gives no rows;
    ``least`` can't be below the guaranteed length.
    """
    if least < SPAN_K + WINDOW - 1:
        raise ValueError(f"spans below {SPAN_K + WINDOW - 1} words aren't guaranteed")
    ws = Workspace(documents.sparkSession, "leakage")
    held = ws.store(fingerprints(items, "eval_id", "passage").withColumnRenamed("id", "eval_id"), "items")
    prints = held.select("print").distinct()
    if within(prints, BROADCAST_ROWS):
        sought = np.sort(prints.toArrow().column("print").to_numpy())
        kept = fingerprints(documents, "doc_id", "text", documents.sparkSession.sparkContext.broadcast(sought))
    else:
        kept = skew_join(fingerprints(documents, "doc_id", "text"), prints, "print", "left_semi", spread_by="id")
    corpus = ws.store(kept.select(F.col("id").alias("doc_id"), "at", "spans"), "corpus").select("doc_id", "at", F.explode("spans").alias("span"))
    spans = held.select("eval_id", F.explode("spans").alias("span")).distinct()
    pairs = sized_join(corpus, spans, "span", "inner", spread_by="doc_id").groupBy("doc_id", "eval_id").agg(F.min("at").alias("first_hit"), F.max("at").alias("last_hit"))
    with_text = sized_join(documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), ws.store(pairs, "pairs"), "doc_id", "inner")
    full = sized_join(with_text, items.select("eval_id", "passage").where(F.col("passage").isNotNull()), "eval_id", "inner", spread_by="doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages: dict[str, tuple[int, Automaton]] = {}
        for batch in batches:
            rows = []
            for doc, item, text, passage, first_hit, last_hit in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "eval_id", "text", "passage", "first_hit", "last_hit")]):
                if passage not in passages:
                    if len(passages) > 2_000:
                        passages.clear()
                    words = words_of(passage)
                    passages[passage] = len(words), Automaton(words)
                size, runs = passages[passage]
                # a span that a hit lies in can't begin or end further off than the passage is long
                lo = max(first_hit - size, 0)
                first, n = runs.longest(words_of(text)[lo : last_hit + size])
                if n >= least:
                    rows.append((doc, item, lo + first, n))
            doc, item, first, n = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, batch.schema.field("doc_id").type), pa.array(item, batch.schema.field("eval_id").type), pa.array(first, pa.int32()), pa.array(n, pa.int32())],
                names=["doc_id", "eval_id", "first_word", "n_words"],
            )

    kinds = [full.schema[c].dataType.simpleString() for c in ("doc_id", "eval_id")]
    found = full.mapInArrow(run, f"doc_id {kinds[0]}, eval_id {kinds[1]}, first_word int, n_words int")
    return found.groupBy("doc_id", "eval_id").agg(F.max(F.struct("n_words", (-F.col("first_word")).alias("f"))).alias("s")).select("doc_id", "eval_id", (-F.col("s.f")).alias("first_word"), "s.n_words")
