"""Cut oversized texts at natural boundaries, with an overlap.

A piece ends at the last boundary under the limit: before a heading, else after a paragraph, a line, a sentence,
each kind where it fills at least ``min_fill`` of the limit; failing that at the last boundary of any kind, and
failing that anywhere between two tokens. The next piece starts ``overlap`` tokens before that end. Token offsets
are prefix sums, boundaries are sorted arrays of token numbers, and each end is found by binary search.

Defined results: null and empty texts give no piece; a text within the limit is one piece, itself; every piece has
1 to ``limit`` tokens, counted by itself; pieces are never cut within a character, so an overlap may be a few tokens
longer than asked; the pieces less their overlaps are the text. Rows are judged one by one: repeated rows give
repeated pieces. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmill.llm.tokens import VOCABULARY, counter, token_offsets

#: Kinds of boundary, the strongest first. A boundary is the end of the match.
BOUNDARIES = (
    ("heading", re.compile(r"\n(?=#{1,6} )")),
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"""[.!?…。]+["'”’»)\]]*(?=\s)""")),
)


def _bytes_before(text: str) -> np.ndarray | None:
    """Bytes before each character; None where both are the same."""
    if text.isascii():
        return None
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), dtype=np.int64)])


def split_text(text: str, limit: int, overlap: int, min_fill: float = 0.5, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int, str]]:
    """(start, end, tokens, kind) of each piece, in characters; kind is that of its end."""
    count = counter(vocabulary).count
    off = token_offsets(text, vocabulary)
    before = _bytes_before(text)
    to_bytes = (lambda c: c) if before is None else (lambda c: before[c])
    to_char = (lambda b: b) if before is None else (lambda b: int(np.searchsorted(before, b)))
    whole = np.ones(len(off), bool) if before is None else np.isin(off, before)  # tokens that start a character
    at = []
    for _, pattern in BOUNDARIES:
        ends = to_bytes(np.array([m.end() for m in pattern.finditer(text)], dtype=np.int64))
        at.append(np.unique(np.searchsorted(off, ends, "right") - 1))
    n, s, out = len(off) - 1, 0, []

    def aligned(i: int) -> int:
        while not whole[i]:
            i -= 1
        return i

    low = 0  # the token after the last piece
    while True:
        room, end, kind = limit, n, "end"
        while True:
            if n - s > room:
                end, kind = _end(at, s, room, low, min_fill)
                end = aligned(end)
                if end <= low:  # an overlap leaves no room for more text: go without
                    if s == low:
                        end = next(i for i in range(low + 1, n + 1) if whole[i])
                    else:
                        s, room, end, kind = low, limit, n, "end"
                        continue
            a, b = to_char(off[s]), to_char(off[end])
            tokens = count(text[a:b])
            if tokens <= limit or (s == low and not whole[s + 1 : end].any()):
                break
            room = min(room, end - s) - max(1, tokens - limit)  # a cut within a word can give other tokens
        out.append((a, b, tokens, kind))
        if end == n:
            return out
        back = aligned(max(end - overlap, 0))
        s, low = (back if back > s else end), end


def _end(at: list[np.ndarray], s: int, room: int, low: int, min_fill: float) -> tuple[int, str]:
    """The token before which a piece that starts at s and goes beyond low ends, and the kind of boundary."""
    top, best, best_kind = s + room, -1, ""
    for (kind, _), places in zip(BOUNDARIES, at, strict=True):
        i = int(np.searchsorted(places, top, "right")) - 1
        if i >= 0 and places[i] > low:
            if places[i] - s >= min_fill * room:
                return int(places[i]), kind
            if places[i] > best:
                best, best_kind = int(places[i]), kind
    return (best, best_kind) if best >= 0 else (top, "hard")


def split_oversized(
    df: DataFrame, key: str, text: str, limit: int = 2048, overlap: int = 64, min_fill: float = 0.5, vocabulary: str = VOCABULARY, keep_small: bool = True
) -> DataFrame:
    """(key, piece_no, n_pieces, start, end, n_tokens, ends_at, piece) for each text, one pass without a shuffle.

    ``keep_small`` false leaves out the texts within the limit. A token has a byte at least, so texts of no more
    bytes than the limit are not even counted.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    kind = dict(df.dtypes)[key]

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(vocabulary)
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                n = c.count(t)
                if n <= limit:
                    if keep_small:
                        out.append((k, 1, 1, 0, len(t), n, "end", t))
                    continue
                pieces = split_text(t, limit, overlap, min_fill, vocabulary)
                out.extend((k, i + 1, len(pieces), a, b, m, end, t[a:b]) for i, (a, b, m, end) in enumerate(pieces))
            yield pd.DataFrame(out, columns=["key", "piece_no", "n_pieces", "start", "end", "n_tokens", "ends_at", "piece"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null and text <> ''")
    if not keep_small:
        rows = rows.filter(F.octet_length("text") > limit)
    schema = f"key {kind}, piece_no int, n_pieces int, start int, end int, n_tokens int, ends_at string, piece string"
    return rows.mapInPandas(cut_up, schema).withColumnRenamed("key", key)
