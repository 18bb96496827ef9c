"""Document statistics used by the quality operators, computed for a slice of texts at once."""

from __future__ import annotations

import numpy as np

from kinfold.llm import words as W

#: Fixed by the contract of the quality rules.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8

NAMES = (
    "log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_word_share", "upper_share",
    "digit_share", "punct_share", "bang_share", "distinct_word_share", "lines_per_word", "log_words_per_line",
    "alpha_word_share", "bar_share", "short_word_share", "log_longest_word", "top_word_share", "upper_word_share",
)

_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


_SYM, _UP, _LOW, _DIG = _mask(SYMBOLS), _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"0123456789")
_PUNCT = _mask(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_ALPHA = _UP | _LOW
_ALPHA[0x80:] = True


def counted(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Bytes of each text that are in ``mask``."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask[data], out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _first_of_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys, where a new key starts in it, and the size of each key's run."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return order, at, np.diff(np.append(at, len(k)))


def _doc_key(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return W.mix(h ^ (doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def repeated_words(h: np.ndarray, ptr: np.ndarray, n: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each document inside an n-word window that the document holds at least twice."""
    g = W.grams(h, n)
    doc = W.per_doc(ptr)
    if not len(g):
        return np.zeros(len(ptr) - 1, np.int64)
    at = np.flatnonzero(doc[: len(g)] == doc[n - 1 : n - 1 + len(g)])
    order, start, size = _first_of_key(_doc_key(g[at], doc[at]))
    twice = np.zeros(len(at), bool)
    twice[order] = np.repeat(size, size) > 1
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + n, -1)
    return W.sums((np.cumsum(edge)[:-1] > 0).astype(np.int64), ptr)


def lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line of the same text."""
    n = len(offsets) - 1
    brk = np.flatnonzero(data == 10)
    begin = np.concatenate([offsets[:-1], brk + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, brk, side="right") - 1])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    end = np.append(begin[1:] - 1, 0)
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    end[last] = offsets[doc[last] + 1]
    words = np.searchsorted(starts, end) - np.searchsorted(starts, begin)
    keep = words > 0
    begin, end, doc = begin[keep], end[keep], doc[keep]
    total = np.bincount(doc, minlength=n)
    _, at, size = _first_of_key(_doc_key(W.hashes(data, begin, end), doc))
    order = np.argsort(_doc_key(W.hashes(data, begin, end), doc), kind="stable")
    distinct = np.bincount(doc[order][at], minlength=n) if len(at) else np.zeros(n, np.int64)
    return total, total - distinct


def compute(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts and the feature matrix (``features``) of each text of a slice."""
    n = len(offsets) - 1
    starts, ends, ptr = W.spans(data, offsets)
    h = W.hashes(data, starts, ends)
    doc = W.per_doc(ptr)
    n_words = np.diff(ptr)
    size = np.diff(offsets)
    cont, solid = counted(data, offsets, _CONT), counted(data, offsets, ~W.SPACE)
    word_chars = solid - cont
    n_lines, n_dup = lines(data, offsets, starts, ptr)
    repeat = repeated_words(h, ptr)
    symbols = counted(data, offsets, _SYM)
    upper, lower = counted(data, offsets, _UP), counted(data, offsets, _LOW)
    order, at, run = _first_of_key(_doc_key(h, doc))
    first_doc = doc[order][at] if len(at) else np.zeros(0, np.int64)
    distinct = np.bincount(first_doc, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, first_doc, run)
    length = ends - starts
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, length)
    cum_alpha = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ALPHA[data], out=cum_alpha[1:])
    cum_up = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_UP[data], out=cum_up[1:])
    alpha_word = W.sums(((cum_alpha[ends] - cum_alpha[starts]) * 2 > length).astype(np.int64), ptr)
    upper_word = W.sums(((cum_up[ends] - cum_up[starts]) * 2 > length).astype(np.int64), ptr)
    short = W.sums((length <= 3).astype(np.int64), ptr)
    w1, c1 = np.maximum(n_words, 1), np.maximum(size, 1)
    features = np.column_stack([
        np.log1p(n_words), word_chars / w1, symbols / w1, n_dup / np.maximum(n_lines, 1), repeat / w1,
        upper / np.maximum(upper + lower, 1), counted(data, offsets, _DIG) / c1, counted(data, offsets, _PUNCT) / c1,
        counted(data, offsets, _mask(b"!")) / w1, distinct / w1, n_lines / w1, np.log1p(n_words / np.maximum(n_lines, 1)),
        alpha_word / w1, counted(data, offsets, _mask(b"|")) / w1, short / w1, np.log1p(longest), top / w1, upper_word / w1,
    ])
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": n_dup, "n_repeat_words": repeat,
        "features": features, "hash": h, "ptr": ptr,
    }
