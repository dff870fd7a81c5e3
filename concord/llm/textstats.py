"""Vectorised statistics of whole texts, for the rule ledger and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import common as C

WINDOW = 5


def _table(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


SPACES = _table(lambda b: b == 32 or 9 <= b <= 13)
IN_WORD = _table(lambda b: not (b == 32 or 9 <= b <= 13) and b & 0xC0 != 0x80)  # first bytes of a word's code points
SYMBOL = _table(lambda b: chr(b) in "#*$%&|<>")
UPPER = _table(lambda b: 65 <= b <= 90)
LETTER = _table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0)
DIGIT = _table(lambda b: 48 <= b <= 57)
BANG = _table(lambda b: b in b"!?")
STOP = _table(lambda b: b in b".,;:")
LINE = _table(lambda b: b == 10)


def repeated(codes: np.ndarray, at: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it. Windows are told apart by 64-bit hashes."""
    n = len(codes)
    if n < width:
        return np.zeros(len(at) - 1, np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    last = n - width + 1
    h = C.mix(text[:last].astype(np.uint64))
    for k in range(width):
        h = C.mix(h ^ (codes[k : k + last].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    inside = np.flatnonzero(text[:last] == text[width - 1 :])
    h = h[inside]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int32)
    begin = inside[twice]
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + width, -1)
    return C.sums(np.cumsum(cover[:-1]) > 0, at)


def line_counts(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines that have a word, and those equal to an earlier line of the text."""
    full, dup = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    for i, t in enumerate(text.cast(pa.large_binary()).to_pylist()):
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        full[i], dup[i] = len(lines), len(lines) - len(set(lines))
    return full, dup


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """Counts per text; null counts as empty."""
    data, at = C.bytes_of(text)
    count = lambda table: C.sums(table[data], at)
    flat, words = C.split_words(text)
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    n_lines, n_dup = line_counts(text)
    out = {"n_words": np.diff(words), "word_chars": count(IN_WORD), "n_symbols": count(SYMBOL), "n_lines": n_lines, "n_dup_lines": n_dup, "n_repeat_words": repeated(codes, words)}
    out |= {"n_upper": count(UPPER), "n_letters": count(LETTER), "n_digits": count(DIGIT), "n_bangs": count(BANG), "n_stops": count(STOP)}
    place = np.repeat(np.arange(len(text)), np.diff(words)).astype(np.int64)
    size = max(1, int(codes.max(initial=0)) + 1)
    kinds, counts = np.unique(place * size + codes, return_counts=True)
    at_kinds = np.searchsorted(kinds // size, np.arange(len(text) + 1))
    out["n_distinct"] = np.diff(at_kinds)
    share = counts.astype(np.float64)
    total = np.maximum(out["n_words"], 1)
    out["entropy"] = np.log2(total) - C.sums(share * np.log2(share), at_kinds) / total
    lengths = np.asarray(flat.cast(pa.large_binary()).value_lengths()).astype(np.int64) if hasattr(flat, "value_lengths") else np.diff(C.bytes_of(flat)[1])
    out["sq_word"] = C.sums(lengths * lengths, words)
    adjacent = np.r_[False, (codes[1:] == codes[:-1]) & (place[1:] == place[:-1])] if len(codes) else np.zeros(0, bool)
    out["n_echoes"] = C.sums(adjacent, words)
    return out
