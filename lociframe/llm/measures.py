"""Measures of texts: words, lines, cells, symbols, repetition and how usual a text is for its corpus.

All texts of a batch are laid end to end as one array of code points, and every
measure is worked out over the whole array; nothing runs sign by sign in Python.
No measure knows a language or a script by name: what words are common and which
signs follow each other is counted in the corpus itself (:class:`Usage`).
Shares are whole per mille and counts are whole numbers, so that ranks are exact.
Null texts are measured as empty ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import regex

#: Names of the measures in order.
NAMES = (
    "n_words", "word_length", "symbol_share", "digit_share", "ended_share", "common_share", "known_share", "n_lines", "line_words", "bare_share",
    "marked_share", "entry_share", "said_share", "row_share", "line_cells", "data_share", "top_share", "entropy", "repeat_share", "surprisal", "switch_share", "long_share", "n_signs",
)
#: Buckets of words, of pairs of signs and of single signs.
WORD_BUCKETS, PAIR_BUCKETS, SIGN_BUCKETS = 1 << 22, 1 << 16, 1 << 14
#: The weight of a pair never seen, and the number of signs taken to follow any sign.
UNSEEN, FOLLOWERS = 0.5, 200
#: Signs without white space from which on a token counts as long.
LONG_TOKEN = 24
#: A bare line has at most so many words and common words.
BARE_WORDS, BARE_COMMON = 6, 1
#: A marked line is an entry with at most so many words and common words.
ENTRY_WORDS, ENTRY_COMMON = 10, 3
#: Code points laid end to end at once; a longer text is measured on its own.
BATCH_SIGNS = 100_000

LINE_END, SPACE, SYMBOL, DIGIT, LOWER, UPPER, OTHER, UNSPACED = range(8)
_CLASSES = (
    (LINE_END, regex.compile(r"[\n\r\v\f\x85  ]")),
    (SPACE, regex.compile(r"[\s\p{Z}]")),
    (DIGIT, regex.compile(r"\p{N}")),
    (UNSPACED, regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ー]")),
    (UPPER, regex.compile(r"[\p{Lu}\p{Lt}]")),
    (LOWER, regex.compile(r"\p{Ll}")),
    (OTHER, regex.compile(r"[\p{L}\p{M}]")),
)
_ENDS = regex.compile(r"[\p{Sentence_Terminal}…]")
_CLOSES = regex.compile(r"[\p{Pe}\p{Pf}\"'*_]")
_OPENS = regex.compile(r"[\p{Ps}\p{Pi}\"'¡¿]")
ENDS, CLOSES, OPENS = 1, 2, 4
#: Closing signs that may follow the end of a sentence.
MOST_CLOSING = 6

_KIND = np.full(0x110000, 255, dtype=np.uint8)
_ROLE = np.zeros(0x110000, dtype=np.uint8)
_FOLD = np.zeros(0x110000, dtype=np.uint32)
_SLOT = np.zeros(0x110000, dtype=np.uint8)
_VALUE = np.zeros(0x110000, dtype=np.uint64)


def _learn(codes: np.ndarray) -> None:
    """Fill the tables for signs not met before."""
    for c in np.unique(codes).tolist():
        sign = chr(c)
        _KIND[c] = next((kind for kind, of in _CLASSES if of.match(sign)), SYMBOL)
        _ROLE[c] = (ENDS if _ENDS.match(sign) else 0) | (CLOSES if _CLOSES.match(sign) else 0) | (OPENS if _OPENS.match(sign) else 0)
        low = sign.lower()
        folded = ord(low) if len(low) == 1 else c
        mixed = (folded + 1) * 0xD6E8FEB86659FD93 % (1 << 64)
        _VALUE[c], _SLOT[c] = mixed ^ mixed >> 32, mixed >> 56
        # in pairs of signs all digits are alike, and all white space
        _FOLD[c] = 48 if _KIND[c] == DIGIT else 32 if _KIND[c] <= SPACE else folded


_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n + 1, BATCH_SIGNS), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums before each place, and the whole sum."""
    out = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype == np.float64 else np.int32)
    np.cumsum(values, out=out[1:], dtype=out.dtype)
    return out


def _per_mille(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, 1000 * part // np.maximum(whole, 1), 0).astype(np.int64)


@dataclass(frozen=True)
class Usage:
    """What is usual in a corpus, in tables of a fixed size.

    ``words`` has by the lowest bits of a word's hash 1 if it is known and 3 if it is common too; ``pairs`` and
    ``signs`` are counts by bucket.
    """

    words: np.ndarray
    pairs: np.ndarray
    signs: np.ndarray

    @cached_property
    def seen(self) -> np.ndarray:
        return np.log2(self.pairs + UNSEEN).astype(np.float32)

    @cached_property
    def led(self) -> np.ndarray:
        return np.log2(self.signs + FOLLOWERS * UNSEEN).astype(np.float32)


class Batch:
    """Several texts end to end, each followed by a line end."""

    def __init__(self, texts: list[str | None]):
        whole = [t or "" for t in texts]
        self.n = len(whole)
        self.ends = np.cumsum([len(t) + 1 for t in whole], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.codes = np.frombuffer(("\n".join(whole) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _KIND[self.codes]
        if (new := kind == 255).any():
            _learn(self.codes[new])
            kind = _KIND[self.codes]
        self.kind = kind
        self.sign = kind > SPACE
        self.text = np.repeat(np.arange(self.n, dtype=np.int32), self.ends - self.starts)

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """The sum of each text's values."""
        return np.add.reduceat(values, self.starts, dtype=np.float64 if values.dtype == np.float32 else np.int64)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place, hash and length of every word, and whether it begins with a digit.

        A word is a run of letters, marks and digits; where a script sets no spaces, each pair of
        neighbouring signs is a word, and a sign alone.
        """
        plain = (self.kind >= DIGIT) & (self.kind < UNSPACED)
        edge = np.flatnonzero(np.diff(plain, prepend=False))
        at, end = edge[0::2], edge[1::2]
        powers, inverse = _powers(len(self.codes))
        sums = np.zeros(len(self.codes) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[self.codes] * powers[: len(self.codes)], out=sums[1:])
        hashes = _mixed((sums[end] - sums[at]) * inverse[at])
        bare = self.kind[at] == DIGIT
        length = end - at
        unspaced = self.kind == UNSPACED
        if unspaced.any():
            follows = np.append(unspaced[1:], False)
            leads = np.append(False, unspaced[:-1])
            first = np.flatnonzero(unspaced & (follows | ~leads))
            size = np.where(follows[first], 2, 1)
            pair = _mixed((sums[first + size] - sums[first]) * inverse[first])
            at, hashes = np.concatenate([at, first]), np.concatenate([hashes, pair])
            length, bare = np.concatenate([length, size]), np.concatenate([bare, np.zeros(len(first), dtype=bool)])
            order = np.argsort(at, kind="stable")
            at, hashes, length, bare = at[order], hashes[order], length[order], bare[order]
        return at, hashes, length, bare

    @cached_property
    def text_of_words(self) -> np.ndarray:
        return self.text[self.words[0]]

    @cached_property
    def word_sets(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of the different words of every text."""
        keys = self.words[1] + self.text_of_words.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        _, first = np.unique(keys, return_index=True)
        return self.text_of_words[first], self.words[1][first]

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all pairs of neighbouring signs, buckets of their first signs, and which pairs count."""
        c = _FOLD[self.codes]
        first, second = c[:-1], c[1:]
        counted = self.sign[:-1] | self.sign[1:]
        counted[self.ends[:-1] - 1] = False
        lone = first * np.uint32(0x9E3779B1)
        both = (lone ^ (second * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        return both >> np.uint32(16), lone >> np.uint32(18), counted

    def lines(self) -> dict[str, np.ndarray]:
        """Every line that has a sign: its text, bounds, first and last sign."""
        end = np.flatnonzero(self.kind == LINE_END)
        start = np.concatenate([[0], end[:-1] + 1])
        places = np.flatnonzero(self.sign)
        lo, hi = np.searchsorted(places, start), np.searchsorted(places, end)
        full = hi > lo
        start, end, lo, hi = start[full], end[full], lo[full], hi[full]
        return {"text": self.text[start], "start": start, "end": end, "first": places[lo], "last": places[hi - 1]}


def _ended(b: Batch, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether lines end a sentence; up to MOST_CLOSING closing signs may follow."""
    at = last.copy()
    for _ in range(MOST_CLOSING):
        at -= ((_ROLE[b.codes[at]] & (CLOSES | ENDS)) == CLOSES) & (at > first)
    return (_ROLE[b.codes[at]] & ENDS) > 0


def _marked(b: Batch, first: np.ndarray) -> np.ndarray:
    """Whether lines begin with a mark: a symbol, or a short number or letter closed by a symbol and a space."""
    kind = b.kind
    opens = (_ROLE[b.codes[first]] & OPENS) > 0
    out = (kind[first] == SYMBOL) & ~opens
    boxed = np.zeros(len(first), dtype=bool)
    n = len(kind) - 1
    inside = np.ones(len(first), dtype=bool)
    for k in range(1, 4):
        at, behind = np.minimum(first + k, n), np.minimum(first + k + 1, n)
        inside &= (kind[np.minimum(first + k - 1, n)] >= DIGIT) | ((k == 1) & opens)
        boxed |= inside & (kind[at] == SYMBOL) & (kind[behind] == SPACE)
    opened = (kind[first] == SYMBOL) & (kind[np.minimum(first + 2, n)] == SYMBOL) & (kind[np.minimum(first + 3, n)] == SPACE)
    return out | boxed | opened


def _rows(b: Batch, lines: dict[str, np.ndarray], body: np.ndarray, n_body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of lines with the commonest number of one separator, and that number; the best separator counts."""
    text, first, last = lines["text"][body], lines["first"][body], lines["last"][body]
    gap = (b.kind[:-1] == SPACE) & (b.kind[1:] == SPACE)
    gap[1:] &= ~gap[:-1]
    best, number = np.zeros(b.n, dtype=np.int64), np.zeros(b.n, dtype=np.int64)
    if not len(text):
        return best, number
    for is_separator in (*(b.codes == ord(s) for s in "\t|│;,"), gap):
        at = np.flatnonzero(is_separator)
        if not len(at):
            continue
        line = np.maximum(np.searchsorted(first, at, side="right") - 1, 0)
        # neither a frame around the row nor a sign at its end parts cells
        count = np.minimum(np.bincount(line[(first[line] < at) & (at < last[line])], minlength=len(first)), 999)
        key, lines_of = np.unique((text * 1000 + count)[count > 0], return_counts=True)
        share = 1000 * lines_of // n_body[key // 1000]
        order = np.lexsort((key % 1000, share, key // 1000))
        top = order[np.append(np.diff(key[order] // 1000) != 0, True)] if len(order) else order
        at = key[top] // 1000
        better = share[top] > best[at]
        best[at[better]], number[at[better]] = share[top][better], (key[top] % 1000)[better]
    return best, number


def _repeats(b: Batch) -> np.ndarray:
    """The share of pairs of neighbouring words that stood in the text before."""
    hashes, text = b.words[1], b.text_of_words
    if len(hashes) < 2:
        return np.zeros(b.n, dtype=np.int64)
    same = text[1:] == text[:-1]
    keys = (hashes[:-1] * _BASE + hashes[1:] + text[1:].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[same]
    where = text[1:][same]
    _, first = np.unique(keys, return_index=True)
    total, different = np.bincount(where, minlength=b.n), np.bincount(where[first], minlength=b.n)
    return _per_mille(total - different, total)


def measure(texts: list[str | None], usage: Usage) -> np.ndarray:
    """One row of the measures in NAMES for each text; 0 where there is nothing to measure."""
    b = Batch(texts)
    kind, sign = b.kind, b.sign
    kinds = np.bincount(b.text << 3 | kind, minlength=b.n << 3).reshape(b.n, 8)
    signs = kinds[:, SYMBOL:].sum(axis=1)
    at, hashes, length, bare_number = b.words
    word_text = b.text_of_words
    n_words = np.bincount(word_text, minlength=b.n)
    mark = usage.words[(hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)]
    known, common = mark > 0, mark > 1

    lines = b.lines()
    n_lines = np.bincount(lines["text"], minlength=b.n)
    ended = _ended(b, lines["first"], lines["last"])
    marked = _marked(b, lines["first"])
    lo, hi = np.searchsorted(at, lines["start"]), np.searchsorted(at, lines["end"])
    lettered, commons = _sums(~bare_number), _sums(common)
    line_words, line_common = lettered[hi] - lettered[lo], commons[hi] - commons[lo]
    is_body = hi > lo
    n_body = np.bincount(lines["text"][is_body], minlength=b.n)
    bare = is_body & ~ended & (line_words <= BARE_WORDS) & (line_common <= BARE_COMMON)
    share_of_lines = lambda mask: _per_mille(np.bincount(lines["text"][mask], minlength=b.n), n_lines)
    row_share, line_cells = _rows(b, lines, is_body, n_body)

    # runs of signs without white space
    edge = np.flatnonzero(np.diff(sign, prepend=False))
    t_at, t_end = edge[0::2], edge[1::2]
    long = t_end - t_at >= LONG_TOKEN
    t_at, t_end = t_at[long], t_end[long]
    spaced = (kind[t_at] != UNSPACED) & (kind[(t_at + t_end) // 2] != UNSPACED)
    t_at, t_end = t_at[spaced], t_end[spaced]
    coarse = np.where(kind == UNSPACED, OTHER, kind)
    change = (coarse[1:] != coarse[:-1]) & sign[1:] & sign[:-1] & ~((coarse[:-1] == UPPER) & (coarse[1:] == LOWER))
    switches = b.by_text(np.append(change, False))

    histogram = np.bincount(b.text << 8 | _SLOT[b.codes], weights=sign, minlength=b.n << 8).astype(np.int64)
    used = np.flatnonzero(histogram)
    p = histogram[used] / signs[used >> 8]
    entropy = np.bincount(used >> 8, weights=-p * np.log2(p), minlength=b.n)

    pair, lone, counted = b.pairs
    bits = (usage.led[lone] - usage.seen[pair]) * counted
    surprisal = b.by_text(np.append(bits, np.float32(0))) / np.maximum(b.by_text(np.append(counted, False)), 1)

    def words_where(mask: np.ndarray) -> np.ndarray:
        return np.bincount(word_text[mask], minlength=b.n)

    columns = {
        "n_words": n_words,
        "word_length": 10 * np.bincount(word_text, weights=length, minlength=b.n).astype(np.int64) // np.maximum(n_words, 1),
        "symbol_share": _per_mille(kinds[:, SYMBOL], signs),
        "digit_share": _per_mille(kinds[:, DIGIT], signs),
        "ended_share": share_of_lines(ended),
        "common_share": _per_mille(words_where(common), n_words),
        "known_share": _per_mille(words_where(known), n_words),
        "n_lines": n_lines,
        "line_words": 10 * n_words // np.maximum(n_lines, 1),
        "bare_share": share_of_lines(bare),
        "marked_share": share_of_lines(marked),
        "entry_share": share_of_lines(bare | marked & (line_words <= ENTRY_WORDS) & (line_common <= ENTRY_COMMON)),
        "said_share": share_of_lines(ended & ~(marked & (line_words <= BARE_WORDS)) | (line_common > ENTRY_COMMON)),
        "row_share": row_share,
        "line_cells": line_cells,
        "data_share": _per_mille(words_where(bare_number), n_words),
        "top_share": _per_mille(histogram.reshape(b.n, 256).max(axis=1), signs),
        "entropy": np.round(100 * entropy).astype(np.int64),
        "repeat_share": _repeats(b),
        "surprisal": np.round(100 * np.maximum(surprisal, 0)).astype(np.int64),
        "switch_share": _per_mille(switches, signs),
        "long_share": _per_mille(np.bincount(b.text[t_at], weights=t_end - t_at, minlength=b.n).astype(np.int64), signs),
        "n_signs": signs,
    }
    return np.minimum(np.stack([columns[n] for n in NAMES], axis=1), np.iinfo(np.int32).max).astype(np.int32)


def slices(texts: list[str | None]):
    """Bounds of runs of texts of about BATCH_SIGNS signs."""
    first = total = 0
    for i, t in enumerate(texts):
        size = len(t) + 1 if t else 1
        if i > first and total + size > BATCH_SIGNS:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(texts):
        yield first, len(texts)
