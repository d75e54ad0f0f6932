"""Quality rules: base counts and compression bands.

Bands: the zstandard ratio (bytes before / bytes after) of the whole text and of each fixed chunk must lie between a
lower and an upper limit that depend on the length. Repetitive text compresses too well, noise too badly; short texts
compress badly by nature, so their bands are wider.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import free_names, limit_batches

SYMBOLS = "#*$%&|<>"
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, low_chunk_ratio double, high_chunk_ratio double, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Bands:
    """``limits``: (bytes from which it holds, least ratio, greatest ratio), by rising length. Full chunks have one band.

    A document is rejected if its whole ratio is outside the band of its length, or if chunks with over ``bad_share`` of
    its bytes are outside theirs; the rest after the full chunks has the band of its length. Texts and rests below
    the first length have none. The limits leave room around clean prose (README) and are over the ratio of base64.
    """

    level: int = 3
    chunk_bytes: int = 4096
    limits: tuple[tuple[int, float, float], ...] = field(default=((128, 1.05, 2.5), (256, 1.25, 2.5), (512, 1.4, 2.8), (1024, 1.5, 3.1), (2048, 1.55, 3.3), (8192, 1.6, 3.6), (32768, 1.6, 4.0)))
    chunk_limits: tuple[float, float] = (1.5, 3.3)
    bad_share: float = 0.2


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more in the text, all occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=n)
    k = len(index)
    if k < 1 << 20:
        key = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # a text of over a million different words: number the pairs first
        pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * k + ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    often = np.zeros(n - 2, dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= often
    covered[1:-1] |= often
    covered[2:] |= often
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    found = 0
    for line in text.split("\n"):
        if line in seen:
            found += 1
        elif line.strip(" \t\r\x0b\x0c"):
            seen.add(line)
    return found


def _inside(ratio: float, size: int, limits: tuple[tuple[int, float, float], ...]) -> bool:
    band = next(((low, high) for least, low, high in reversed(limits) if size >= least), None)
    return band is None or band[0] <= ratio <= band[1]


def judge(text: str | None, bands: Bands, zstd: zstandard.ZstdCompressor) -> tuple:
    """The values of RESULT for one text; null is the empty text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, repeats = len(words), repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    symbols = sum(map(text.count, SYMBOLS))
    size = len(raw)
    ratio = size / len(zstd.compress(raw)) if size else None
    step = bands.chunk_bytes
    chunks = [step / len(zstd.compress(raw[i : i + step])) for i in range(0, size - step + 1, step)]
    outside = step * sum(not bands.chunk_limits[0] <= x <= bands.chunk_limits[1] for x in chunks)
    rest = raw[len(chunks) * step :]
    if chunks and rest and not _inside(len(rest) / len(zstd.compress(rest)), len(rest), bands.limits):
        outside += len(rest)
    good = not size or _inside(ratio, size, bands.limits) and outside <= bands.bad_share * size
    return n, chars, symbols, repeated_lines(text), repeats, ratio, min(chunks, default=None), max(chunks, default=None), failed, good and not failed


def quality_column(text_col: str | Column, bands: Bands = Bands()) -> Column:
    @F.arrow_udf(RESULT)
    def rules(texts: pa.Array) -> pa.Array:
        zstd = zstandard.ZstdCompressor(level=bands.level)
        rows = [judge(t.as_py(), bands, zstd) for t in texts]
        kinds = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.bool_()] * 2
        names = [x.split()[0] for x in RESULT.split(", ")]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rules(F.col(text_col) if isinstance(text_col, str) else text_col)


def quality_rules(df: DataFrame, text_col: str = "text", bands: Bands = Bands(), into: str = "quality") -> DataFrame:
    """``df`` with a struct ``into`` of RESULT's fields; one row in, one row out, no shuffle.

    Null and empty texts have no words and fail the base rules; each row is judged alone, so ties and repeated
    rows get equal values; an empty table stays empty; a column called ``into`` is replaced, others pass through.
    """
    limit_batches(df.sparkSession)
    return df.withColumn(into, quality_column(text_col, bands))


def keep_good(df: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that the rules keep, with the columns of ``df``, which may have any names."""
    (quality,) = free_names(df, "__quality")
    return quality_rules(df, text_col, bands, quality).filter(F.col(quality)["kept"]).drop(quality)
