"""Oversized texts in overlapping pieces (problem 1), by content-defined chunking.

A gear hash rolls over windows of 32 characters; a character whose hash has ``mask_bits`` zero bits is a landmark. From
the last cut, the first landmark beyond the minimum size is taken and snapped to the nearest paragraph end, else
sentence end, else word end, between the minimum and the maximum size. As landmarks depend on 32 characters only, an
edit moves the cuts beside it and no others. A piece begins about ``overlap`` characters before the cut that opens it,
at the nearest word start, so with its overlap it stays within ``max_chars``.

Defined cases: a null text gives no piece, a text within the limit (the empty one too) one piece, whole; a run without
any white space or end mark is cut at the landmark itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows
from .sentences import sentence_spans

_WINDOW_LOG2 = 5
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_WORD = re.compile(r"\s+")


def landmarks(text: str, mask_bits: int = 9) -> np.ndarray:
    """Offsets of the characters whose rolling hash is a landmark; each depends on the 32 characters up to it."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    with np.errstate(over="ignore"):
        h = code * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
        for k in range(_WINDOW_LOG2):  # doubling: h[i] = sum of gear(c[i-j]) << j over the window
            step = 1 << k
            shifted = np.zeros_like(h)
            shifted[step:] = h[:-step]
            h = h + (shifted << np.uint32(step))
    return np.flatnonzero((h >> np.uint32(32 - mask_bits)) == 0) + 1


def _nearest(points: list[int], at: int, low: int, high: int) -> int | None:
    i, j = bisect_left(points, low), bisect_right(points, high)
    if i == j:
        return None
    k = bisect_left(points, at, i, j)
    return min((points[x] for x in (k - 1, k) if i <= x < j), key=lambda p: (abs(p - at), p))


def piece_spans(text: str, max_chars: int = 4000, overlap: int = 200, min_chars: int | None = None) -> list[tuple[int, int, int]]:
    """Pieces as (start, body start, end): text[start:end] is the piece, of which text[start:body start] repeats the one before."""
    n = len(text)
    if n <= max_chars:
        return [(0, 0, n)]
    room = max_chars - overlap - min(40, overlap // 4)
    low = min_chars if min_chars is not None else room // 3
    marks = landmarks(text).tolist()
    paragraphs = [m.end() for m in _PARAGRAPH.finditer(text)]
    sentences = [a for a, _ in sentence_spans(text)]
    words = [m.end() for m in _WORD.finditer(text)]
    out: list[tuple[int, int, int]] = []
    start = body = 0
    while n - start > max_chars:
        first, last = body + low, min(body + room, start + max_chars, n - 1)
        i = bisect_left(marks, first)
        want = marks[i] if i < len(marks) and marks[i] <= last else last
        cut = None
        for points in (paragraphs, sentences, words):
            cut = _nearest(points, want, first, last)
            if cut is not None:
                break
        if cut is None:
            cut = want
        out.append((start, body, cut))
        start, body = _overlap_start(words, sentences, cut, overlap, out[-1][0] + 1), cut
    out.append((start, body, n))
    return out


def _overlap_start(words: list[int], sentences: list[int], cut: int, overlap: int, least: int) -> int:
    if not overlap:
        return cut
    want, slack = max(least, cut - overlap), min(40, overlap // 4)
    for points in (sentences, words):
        at = _nearest(points, want, max(least, want - slack), min(cut, want + slack))
        if at is not None:
            return at
    return want


def split_oversized(df: DataFrame, max_chars: int = 4000, overlap: int = 200, min_chars: int | None = None) -> DataFrame:
    """``df(doc_id, text)`` as ``(doc_id, piece_no, pieces, piece_start, body_start, piece_end, piece)``."""

    def rows(doc_id, text):
        if text is None:
            return []
        spans = piece_spans(text, max_chars, overlap, min_chars)
        return [(doc_id, i, len(spans), a, b, c, text[a:c]) for i, (a, b, c) in enumerate(spans)]

    names = ["doc_id", "piece_no", "pieces", "piece_start", "body_start", "piece_end", "piece"]
    return map_rows(df.select("doc_id", "text"), rows, "doc_id string, piece_no int, pieces int, piece_start int, body_start int, piece_end int, piece string", names)


def oversized(df: DataFrame, max_chars: int = 4000) -> DataFrame:
    """Documents that the operator divides; texts within the limit are dropped before they reach Python."""
    from pyspark.sql import functions as F

    pieces = split_oversized(df.where(F.char_length("text") > max_chars), max_chars)
    return pieces.where("pieces > 1").select("doc_id").distinct()
