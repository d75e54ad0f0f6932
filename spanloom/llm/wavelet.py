"""Token ids in wavelet-matrix files: one compressed file a shard with access, rank, select and whole reads.

A file holds the ids of consecutive documents as bit planes from the highest bit down; on each level the ids are stably
parted by their bit, zeros first. Counting an id in a prefix or finding its k-th occurrence takes one rank or select a
plane. Files go through Spark's text writer (one record each) and come back through ``binaryFile``, so any store
that Spark reaches will do.

A shard's file is a row of blocks, each a matrix of its own that fits a processor's cache while it is built.
Layout of a block: MAGIC, header length (4 bytes), JSON header, zstandard frames: doc ids, whether they are set, lengths, planes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.bpe import load
from spanloom.llm.common import column, limit_batches, small_side, written

MAGIC = b"WVMX1\n"
#: Tokens from which a file is closed; a document is never split, so one very long one makes a larger file.
FILE_TOKENS = 4_000_000
#: Tokens from which a block is closed.
BLOCK_TOKENS = 500_000
END_ID = 1
#: Words of a generation of the encoder's cache, some 100 MB a worker: a task meets more distinct words than bpe.CACHE_WORDS.
CACHE_WORDS = 500_000


class WaveletMatrix:
    def __init__(self, planes: list[np.ndarray], n: int):
        """``planes``: packed bits (little bit order), highest plane first."""
        self.planes, self.n, self._ranks = planes, n, {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        bits = max(1, top.bit_length())
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for level in range(bits - 1, -1, -1):
            b = (a & a.dtype.type(1 << level)) != 0
            planes.append(np.packbits(b, bitorder="little"))
            if level:
                parted = np.empty_like(a)
                zeros = len(a) - np.count_nonzero(b)
                parted[zeros:] = a[b]
                parted[:zeros] = a[np.logical_not(b, out=b)]
                a = parted
        return cls(planes, len(ids))

    def _bits(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k], count=self.n, bitorder="little")

    def _directory(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each 64-bit word of plane k, and the words; kept after the first use. One pass over a plane that was
        just decompressed costs less than a stored directory would."""
        if k not in self._ranks:
            raw = self.planes[k].tobytes()
            words = np.frombuffer(raw + bytes(-len(raw) % 8 + 8), dtype="<u8")
            before = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self._ranks[k] = before, words
        return self._ranks[k]

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        before, words = self._directory(k)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & below)

    def _zeros(self, k: int) -> int:
        return self.n - int(self._directory(k)[0][-1])

    def access_all(self, at: np.ndarray) -> np.ndarray:
        """The ids at many positions, one rank a plane for all of them."""
        at, values = np.asarray(at, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for k in range(len(self.planes)):
            bit = self._directory(k)[1][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            ones = self._ones(k, at)
            at = np.where(bit == 1, self._zeros(k) + ones, at - ones)
            values = values << 1 | bit.astype(np.int64)
        return values

    def access(self, i: int) -> int:
        return int(self.access_all([i])[0])

    def _ranges(self, value: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``value``'s occurrences before each end lie below the last plane."""
        ends = np.asarray(ends, dtype=np.int64)
        starts = np.zeros(len(ends), dtype=np.int64)
        if value >> len(self.planes):
            return starts, starts
        for k in range(len(self.planes)):
            a, b = self._ones(k, starts), self._ones(k, ends)
            if value >> (len(self.planes) - 1 - k) & 1:
                starts, ends = self._zeros(k) + a, self._zeros(k) + b
            else:
                starts, ends = starts - a, ends - b
        return starts, ends

    def rank_all(self, value: int, ends: np.ndarray) -> np.ndarray:
        """Occurrences of ``value`` before each of many positions."""
        a, b = self._ranges(value, ends)
        return b - a

    def rank(self, value: int, end: int | None = None) -> int:
        """Occurrences of ``value`` in the first ``end`` tokens (all by default)."""
        return int(self.rank_all(value, [self.n if end is None else end])[0])

    def select_all(self, value: int, nths: np.ndarray) -> np.ndarray:
        """Positions of the occurrences with these numbers (from 0); IndexError if one does not exist."""
        nths = np.asarray(nths, dtype=np.int64)
        a, b = (int(x[0]) for x in self._ranges(value, [self.n]))
        if len(nths) and not 0 <= nths.min() <= nths.max() < b - a:
            raise IndexError(value)
        at = a + nths
        for k in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - k) & 1
            at = self._find(k, bit, at - self._zeros(k) if bit else at)
        return at

    def select(self, value: int, nth: int) -> int:
        """Position of the occurrence number ``nth`` (from 0); IndexError if there is none."""
        return int(self.select_all(value, [nth])[0])

    def _find(self, k: int, bit: int, nths: np.ndarray) -> np.ndarray:
        before, words = self._directory(k)
        counts = before if bit else np.arange(len(before), dtype=np.int64) * 64 - before
        w = np.searchsorted(counts, nths, side="right") - 1
        word, left = words[w] if bit else ~words[w], nths - counts[w]
        place = np.zeros(len(w), dtype=np.uint64)
        for half in map(np.uint64, (32, 16, 8, 4, 2, 1)):  # the bit is in the lower or in the upper half
            low = np.bitwise_count(word >> place & (np.uint64(1) << half) - np.uint64(1)).astype(np.int64)
            up = left >= low
            left, place = np.where(up, left - low, left), np.where(up, place + half, place)
        return w * 64 + place.astype(np.int64)

    def positions(self, value: int) -> list[int]:
        return self.select_all(value, np.arange(self.rank(value))).tolist()

    def tokens(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        bits = len(self.planes)
        values = np.zeros(self.n, dtype=np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            b = self._bits(k).view(bool)
            zeros = self.n - np.count_nonzero(b)
            up = np.empty_like(values)
            up[b] = values[zeros:] | values.dtype.type(1 << (bits - 1 - k))
            up[np.logical_not(b)] = values[:zeros]
            values = up
        return values


def pack(part: int, piece: int, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One block's bytes."""
    matrix = WaveletMatrix.build(ids)
    zstd = zstandard.ZstdCompressor(level=1)
    sections = [np.array([d or 0 for d in doc_ids], dtype="<i8"), np.array([d is not None for d in doc_ids], dtype=np.uint8), lengths.astype("<u4"), *matrix.planes]
    frames = [zstd.compress(s.tobytes()) for s in sections]
    header = json.dumps({"part": part, "piece": piece, "docs": len(doc_ids), "tokens": len(ids), "frames": [len(f) for f in frames]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *frames])


def block_at(content: bytes, at: int) -> tuple[dict, int, int]:
    """Header of the block at ``at``, where its frames start and where it ends; no frame is read."""
    if content[at : at + len(MAGIC)] != MAGIC:
        raise ValueError("not a wavelet-matrix block")
    at += len(MAGIC) + 4
    frames = at + int.from_bytes(content[at - 4 : at], "little")
    header = json.loads(content[at:frames])
    return header, frames, frames + sum(header["frames"])


def unpack(content: bytes, at: int = 0) -> tuple[dict, list[int | None], np.ndarray, WaveletMatrix, int]:
    """header, doc ids, lengths and the matrix of the block at ``at``, and where the block ends."""
    header, frame, end = block_at(content, at)
    zstd, parts = zstandard.ZstdDecompressor(), []
    for size in header["frames"]:
        parts.append(zstd.decompress(content[frame : frame + size]))
        frame += size
    set_ = np.frombuffer(parts[1], dtype=np.uint8)
    doc_ids = [int(d) if s else None for d, s in zip(np.frombuffer(parts[0], dtype="<i8"), set_)]
    planes = [np.frombuffer(p, dtype=np.uint8) for p in parts[3:]]
    return header, doc_ids, np.frombuffer(parts[2], dtype="<u4"), WaveletMatrix(planes, header["tokens"]), end


class ShardFile:
    """Token access, counting and occurrence lookup over one file's blocks.

    Opening reads the headers alone; an access decompresses the one block that it falls into, and the last block used stays
    unpacked. Counting and positions take the blocks one after another.
    """

    def __init__(self, content: bytes):
        self.content, self.blocks, self._last, at = content, [], (None, None), 0
        while content[at : at + len(MAGIC)] == MAGIC:
            header, _, end = block_at(content, at)
            self.blocks.append((at, header["tokens"]))
            at = end

    def _matrix(self, at: int) -> WaveletMatrix:
        if self._last[0] != at:
            self._last = at, unpack(self.content, at)[3]
        return self._last[1]

    def __len__(self) -> int:
        return sum(n for _, n in self.blocks)

    def access(self, i: int) -> int:
        for at, n in self.blocks:
            if i < n:
                return self._matrix(at).access(i)
            i -= n
        raise IndexError(i)

    def count(self, value: int) -> int:
        return sum(self._matrix(at).rank(value) for at, _ in self.blocks)

    def positions(self, value: int) -> list[int]:
        out, before = [], 0
        for at, n in self.blocks:
            out += [before + i for i in self._matrix(at).positions(value)]
            before += n
        return out


def write_tokens(df: DataFrame, tokenizer_path: str, target: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_tokens: int = FILE_TOKENS, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every whole text with the tokenizers library, append ``end_id``, and write files in ascending id order.

    Range partitions of (id, text) are sorted and streamed: a task holds one open file's ids at most. Texts are shuffled, not
    ids: compressed, two-byte ids are nearly as large, and a table of them, without which sampling the ranges would
    encode twice, costs more disk and CPU than it spares (the README has the figures). Null texts count as empty, null ids come
    last, rows that share an id follow each other in the order of their text hash. Other columns are ignored.
    """
    limit_batches(df.sparkSession, 500)
    rows = df.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = load(tokenizer_path, True, CACHE_WORDS), end_id.to_bytes(4, "little")
        part, piece, held, kept = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        blocks: list[bytes] = []

        def block() -> bytes:
            return pack(part, piece, doc_ids, np.array([len(p) for p in parts], dtype=np.int64), np.concatenate(parts))

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(blocks)], type=pa.binary())], names=["value"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts.append(np.frombuffer(bpe.encode(text.as_py()) + end, dtype="<u4"))
                doc_ids.append(doc_id)
                held += len(parts[-1])
                if held >= min(block_tokens, file_tokens):
                    blocks.append(block())
                    piece, kept, held, doc_ids, parts = piece + 1, kept + held, 0, [], []
                    if kept >= file_tokens:
                        yield file()
                        kept, blocks = 0, []
        if parts:
            blocks.append(block())
        if blocks:
            yield file()

    packed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(files, "value binary")
    packed.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(target)


def read_tokens(spark: SparkSession, target: str, wanted: int = END_ID) -> DataFrame:
    """One row a document of the files: part, piece (block), doc_id, at (tokens of the block before the document), n_tokens,
    ids (little-endian 32-bit), and three look-ups in the matrix: first_id (access), n_wanted (occurrences of ``wanted`` in
    the document, by rank at both its ends) and first_wanted (place of the first one in the document, by select; null
    if there is none)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                content, at = content.as_py(), 0
                while content[at : at + len(MAGIC)] == MAGIC:
                    header, doc_ids, lengths, matrix, at = unpack(content, at)
                    tokens = matrix.tokens().astype("<u4")
                    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                    ranks = matrix.rank_all(wanted, ends)
                    found = np.diff(ranks) > 0
                    first = np.zeros(len(found), dtype=np.int64)
                    first[found] = matrix.select_all(wanted, ranks[:-1][found]) - ends[:-1][found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([header["part"]] * len(doc_ids), type=pa.int32()),
                            pa.array([header["piece"]] * len(doc_ids), type=pa.int32()),
                            pa.array(doc_ids, type=pa.int64()),
                            pa.array(ends[:-1]),
                            pa.array(np.diff(ends)),
                            pa.array([tokens[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], type=pa.binary()),
                            pa.array(matrix.access_all(ends[:-1])),
                            pa.array(np.diff(ranks)),
                            pa.array(first, mask=~found),
                        ],
                        names=["part", "piece", "doc_id", "at", "n_tokens", "ids", "first_id", "n_wanted", "first_wanted"],
                    )

    limit_batches(spark, 500)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(target).select("content")
    return files.mapInArrow(documents, "part int, piece int, doc_id long, at long, n_tokens long, ids binary, first_id long, n_wanted long, first_wanted long")


def with_starts(docs: DataFrame) -> DataFrame:
    """``docs`` (a written projection of :func:`read_tokens`) with ``start``, the ids of all documents before each.

    Sums run per block, then over the blocks of a part, then over the parts: no window sees more than a part's blocks or
    one row a part.
    """
    files = docs.groupBy("part", "piece").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("in_part", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    parts = files.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)).alias("before_part"))
    offsets = files.join(parts, "part").select("part", "piece", (F.col("in_part") + F.col("before_part")).alias("offset"))
    offsets = small_side(written(offsets, "offsets"))
    return docs.join(offsets, ["part", "piece"]).withColumn("start", F.col("offset") + F.col("at")).drop("offset")
