"""Text repeated across the documents of one site.

``repeated_spans`` takes no notice of lines: the words of a document are divided into content-defined chunks, which
end where a rolling hash of the last words is the least of its neighbourhood. Distinct documents are counted for each chunk and
site, and chunks that stand in too many are reported as spans; so is boilerplate that runs over line ends or stands
within a longer line.

``repeated_lines`` reports whole lines. Its chunks end where a rolling hash of the last bytes has its low bits zero, and
besides at the ends of lines, as a line shorter than a chunk would be lost between its neighbours otherwise. A line can
only be excessive if all its chunks are, so lines with a rare chunk are out; the others are counted exactly.

The chunks that are excessive are told to the second pass in a bitmap of fixed size, 2**sieve_bits bits; cells that are
shared only add to the exact count. Where more than an eighth of the cells would be taken, the bitmap is of no use: then
all lines or chunks are counted exactly, as hashes of 128 bits, without their texts.

Defined results: null and blank texts are not counted and have no lines; lines without letters or digits don't
count; rows equal in key, site and text are one document; a null site makes no site, its documents have no excessive
lines; lines are numbered from 1 between line feeds; a carriage return is a blank. Null keys are left out. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmill.runtime import cut

_DIGITS = re.compile(r"\d+")
_OTHER = re.compile(r"[^\w\n]+|_+")
_EDGES = re.compile(r"(?m)^ +| +$")
_BLANKS = re.compile(r"  +")
_WINDOW, _MASK = 8, np.uint64(0x1F)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = re.compile(r"[^\W_]+")
_KEPT_WORDS = 1 << 20
#: The units of a batch: row, place, first and last character of each; the bytes of the i-th; the unit and hash of each chunk.
Units = Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[int], bytes], np.ndarray, np.ndarray]]


def normal_lines(text: str) -> list[str]:
    """Lower case, runs of digits as 0, runs of other characters than letters and digits as one blank, trimmed."""
    t = _OTHER.sub(" ", _DIGITS.sub("0", text.lower()))
    return _EDGES.sub("", _BLANKS.sub(" ", t)).split("\n")


def chunk_lines(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the content-defined chunks of many lines, without the empty ones."""
    raw = "\n".join(lines).encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw + b"\n", np.uint8)
    n = len(b)
    ends = np.nonzero(b == 10)[0]
    line_of = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[-1], ends])))
    start = np.concatenate([[0], ends[:-1] + 1])[line_of]
    table = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    table ^= table >> np.uint64(31)
    g = table[b]
    rolling = np.zeros(n, np.uint64)
    for j in range(_WINDOW):
        rolling[j:] += g[: n - j] << np.uint64(j)
    rolling *= _R
    at = np.arange(n)
    here = (((rolling >> np.uint64(40)) & _MASK) == 0) & (at - start >= _WINDOW - 1)
    here |= np.concatenate([b[1:] == 10, [True]])  # the last byte of a line
    here &= b != 10
    last = np.nonzero(here)[0]
    if not len(last):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.maximum(start[last], np.concatenate([[0], last[:-1] + 1]))
    # Hashes of all chunks at once: a sum over bytes, each mixed with its place in the chunk.
    lengths = last - first + 1
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    mixed = (g[np.repeat(first, lengths) + place] ^ (place.astype(np.uint64) * _R)) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    sums = np.add.reduceat(mixed * _R, np.cumsum(lengths) - lengths)
    h = (sums ^ (sums >> np.uint64(32)) ^ lengths.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return line_of[last], h ^ (h >> np.uint64(29))


def _lines_of(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All normal lines of a batch, the row of each and its number."""
    lines: list[str] = []
    counts = []
    for t in pdf["text"]:
        own = normal_lines(t)
        lines.extend(own)
        counts.append(len(own))
    row = np.repeat(np.arange(len(counts)), counts)
    return lines, row, np.arange(len(row)) - (np.cumsum(counts) - counts)[row] + 1


def repeated_lines(df: DataFrame, key: str, site: str, text: str, least_docs: int = 8, least_share: float = 0.05, sieve_bits: int = 23) -> DataFrame:
    """(key, line_no) of the lines that stand in ``least_docs`` documents and ``least_share`` of those of their site."""
    found = _excessive(df, key, site, text, _line_units, least_docs, least_share, sieve_bits)
    return found.select("key", F.col("no").alias("line_no")).distinct().withColumnRenamed("key", key)


def repeated_spans(df: DataFrame, key: str, site: str, text: str, least_docs: int = 8, least_share: float = 0.05, sieve_bits: int = 23) -> DataFrame:
    """(key, first, last): characters, from 1, of the runs of chunks that are repeated excessively within a site.

    A row of ``df`` is a document; keys with several texts have the spans of each.
    """
    found = _excessive(df, key, site, text, _chunk_units, least_docs, least_share, sieve_bits).select("key", "d", "no", "first", "last").distinct()
    run = Window.partitionBy("key", "d").orderBy("no")
    runs = found.withColumn("run", F.col("no") - F.row_number().over(run)).groupBy("key", "d", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.select("key", "first", "last").distinct().withColumnRenamed("key", key)


def _excessive(df: DataFrame, key: str, site: str, text: str, units: Units, least_docs: int, least_share: float, sieve_bits: int) -> DataFrame:
    """(key, site, d, no, first, last) of the units, lines or chunks, that stand in too many documents of their site."""
    docs = df.select(F.col(key).alias("key"), F.col(site).alias("site"), F.col(text).alias("text"))
    docs = docs.filter(F.col("key").isNotNull() & F.col("site").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}]"))
    docs = docs.select("key", "site", "text", F.xxhash64("site").alias("seed"), F.xxhash64("key", "text").alias("d"))
    # Copies of a row count once: exactly for the size of a site, and for units below.
    sizes = docs.select("site", "seed", "d").distinct().groupBy("site", "seed").agg(F.count(F.lit(1)).alias("n_site"))
    needed = F.greatest(F.lit(least_docs), F.ceil(F.col("n_site") * least_share - 1e-9))
    sizes = cut(sizes.select("site", "seed", needed.alias("needed")))

    counted = docs.select("text", "seed").mapInPandas(_chunk_counts(units), "seed long, chunk long, n long").groupBy("seed", "chunk").agg(F.sum("n").alias("n"))
    often = counted.filter(F.col("n") >= least_docs).join(sizes, "seed").filter("n >= needed")
    sieve = _sieve(often, 1 << sieve_bits)

    kind = dict(df.dtypes)[key]
    left = cut(docs.mapInPandas(_candidates(units, sieve, 1 << sieve_bits), f"key {kind}, site string, d long, no int, first int, last int, h1 long, h2 long"))
    unit = ["site", "h1", "h2"]
    in_docs = left.select(*unit, "d").distinct().groupBy(*unit).agg(F.count(F.lit(1)).alias("n"))
    return left.join(in_docs.join(sizes.select("site", "needed"), "site").filter("n >= needed").select(*unit), unit, "left_semi")


def _sieve(often: DataFrame, cells: int):  # noqa: ANN202
    """The cells of the excessive chunks as a broadcast bitmap; None if they are too many for one."""
    hit = often.select(F.pmod("chunk", F.lit(cells)).cast("int").alias("cell")).distinct().limit(cells // 8 + 1).toArrow()["cell"]
    if len(hit) > cells // 8:
        return None
    bitmap = np.zeros(cells, bool)
    bitmap[hit.to_numpy()] = True
    return often.sparkSession.sparkContext.broadcast(np.packbits(bitmap))


def _line_units(pdf: pd.DataFrame):  # noqa: ANN202
    """Lines as units, and the unit and hash of each of their chunks. Characters are not looked at: 0."""
    lines, row, number = _lines_of(pdf)
    line, h = chunk_lines(lines)
    none = np.zeros(len(row), np.int64)
    return row, number, none, none, lambda i: lines[i].encode("utf-8", "surrogatepass"), line, h


class _Hashes(dict):
    """Words to their hashes; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > _KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(_DIGITS.sub("0", word))
        return h


_HASHES = _Hashes()


def word_chunks(h: np.ndarray, doc: np.ndarray, reach: int = 4, window: int = 3) -> np.ndarray:
    """The ends of the content-defined chunks of many sequences of words, by the words' hashes and their documents.

    A chunk ends where the rolling hash of the last ``window`` words is the least within ``reach`` words on either side.
    So chunks have more than ``reach`` words, common phrases are none, and an end depends on the words around it alone:
    after other text, the chunks of a passage are the same again from its first such place on. A document ends one too.
    """
    n = len(h)
    rolling = np.zeros(n, np.uint64)
    for j in range(min(window, n)):
        rolling[j:] += np.where(doc[j:] == doc[: n - j], h[: n - j] * _R, np.uint64(0)) << np.uint64(j)
    rolling = (rolling ^ (rolling >> np.uint64(31))) * _R
    least = np.ones(n, bool)
    for j in range(1, min(reach, n - 1) + 1):
        other = doc[j:] != doc[:-j]
        least[j:] &= (rolling[j:] < rolling[:-j]) | other
        least[:-j] &= (rolling[:-j] <= rolling[j:]) | other
    least[:-1] |= doc[1:] != doc[:-1]
    least[-1:] = True
    return np.nonzero(least)[0] + 1


def _chunk_units(pdf: pd.DataFrame):  # noqa: ANN202
    """Chunks of words as units of their own, wherever lines end. Digits count as 0."""
    words: list[str] = []
    spans: list[tuple[int, int]] = []
    counts = []
    for text in pdf["text"]:
        own = [m.span() for m in _WORD.finditer(text)]
        low = text.lower()
        words.extend([low[a:b] for a, b in own] if len(low) == len(text) else [text[a:b].lower() for a, b in own])
        spans.extend(own)
        counts.append(len(own))
    doc = np.repeat(np.arange(len(counts)), counts)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    ends = word_chunks(h, doc)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    at = np.array(spans, np.int64).reshape(-1, 2)
    row = doc[starts] if len(starts) else np.zeros(0, np.int64)
    no = np.arange(len(row)) - np.searchsorted(row, row)
    if len(starts):
        place = np.arange(len(h)) - np.repeat(starts, ends - starts)
        mixed = (h ^ ((place.astype(np.uint64) + np.uint64(1)) * _R)) * np.uint64(0x94D049BB133111EB)
        chunk = np.add.reduceat((mixed ^ (mixed >> np.uint64(29))) * _R, starts)
    else:
        chunk = np.zeros(0, np.uint64)
    raw = lambda i: _DIGITS.sub("0", " ".join(words[starts[i] : ends[i]])).encode("utf-8", "surrogatepass")
    return row, no, at[starts, 0] + 1, at[ends - 1, 1], raw, np.arange(len(row)), chunk


def _of_site(h: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hashes of chunks within a site."""
    x = (h ^ (seed.view(np.uint64) * _R)) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _chunk_counts(units: Units):  # noqa: ANN202
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Documents of a batch by site and chunk: each document counts once."""
        for pdf in batches:
            row, _, _, _, _, unit, h = units(pdf)
            doc = row[unit]
            seed = pdf["seed"].to_numpy(np.int64)
            h = _of_site(h, seed[doc])
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            at = np.nonzero(first)[0]
            yield pd.DataFrame({"seed": seed[doc[at]], "chunk": h[at], "n": np.diff(np.append(at, len(h)))})

    return count


def _candidates(units: Units, sieve, cells: int):  # noqa: ANN001, ANN202
    """Units of which every chunk is in the sieve; all that have a chunk where there is none."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = None if sieve is None else np.unpackbits(sieve.value).view(bool)
        for pdf in batches:
            row, number, first, last, raw, unit, h = units(pdf)
            some = np.bincount(unit, minlength=len(row)) > 0
            if bitmap is not None:
                cell = _of_site(h, pdf["seed"].to_numpy(np.int64)[row[unit]]) % cells
                some &= np.bincount(unit, weights=~bitmap[cell], minlength=len(row)) == 0
            at = np.nonzero(some)[0]
            r = row[at]
            h1, h2 = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw(i)) for i in at.tolist()), ">i8").astype(np.int64).reshape(-1, 2).T
            yield pd.DataFrame(
                {"key": pdf["key"].to_numpy(object)[r], "site": pdf["site"].to_numpy(object)[r], "d": pdf["d"].to_numpy(np.int64)[r], "no": number[at], "first": first[at], "last": last[at], "h1": h1, "h2": h2}
            )

    return scan


def without_lines(df: DataFrame, key: str, text: str, lines: DataFrame) -> DataFrame:
    """All rows of ``df`` with those lines cut from their texts. A row that loses nothing keeps its text as it is."""
    gone = lines.groupBy(key).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), (i + 1).cast("int")))
    joined = df.join(gone, key, "left")
    return joined.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_gone")


def without_spans(df: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """All rows of ``df`` with those spans cut from their texts."""
    gone = spans.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("_gone"))
    start = F.struct(F.lit("").alias("kept"), F.lit(1).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["kept"], F.substring(F.col(text), a["at"], F.greatest(x["first"] - a["at"], F.lit(0)))).alias("kept"), F.greatest(a["at"], x["last"] + 1).alias("at"))
    rest = lambda a: F.concat(a["kept"], F.substring(F.col(text), a["at"], F.length(text)))
    return df.join(gone, key, "left").withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.aggregate("_gone", start, step, rest))).drop("_gone")
