"""BPE encoding and decoding with a public word-level vocabulary (a ``tokenizers`` JSON file, whose path is a parameter).

The merge loop of a word keeps a segment tree over its adjacent pairs: a leaf holds (rank, position) of a pair, each inner
node the least of its children, so the root is the leftmost lowest-ranked merge. A merge changes at most three
leaves, each updated in logarithmic time, until the root holds no mergeable pair.

Texts are cut into pre-tokens, and the ids of a pre-token are remembered in a cache of bounded size.
Texts of plain Latin letters are normalised and cut by Python's own tables; all others by the library's normaliser
and pre-tokeniser, whose results are then the same by construction.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import free_names, limit_batches

#: Characters whose normal form, lower case and category are the same in every Unicode version at hand.
_PLAIN = [*"\t\n\r", *map(chr, (*range(0x20, 0x7F), *range(0xA0, 0x130), *range(0x131, 0x17F), *range(0x2010, 0x2028), *range(0x2030, 0x205F)))]
_UNUSUAL = re.compile("[^" + "".join(map(re.escape, _PLAIN)) + "]")
CACHE_WORDS = 250_000


class RecentCache(dict):
    """Values made on first use; two generations of ``limit`` entries at most."""

    def __init__(self, make: Callable, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


def merge_word(symbols: list[int], ranks: dict[int, int], merged: list[int], base: int) -> list[int]:
    """Apply merges to a word's symbols. ``ranks``: pair (a * base + b) -> rank; ``merged``: rank -> new symbol."""
    n = len(symbols)
    if n < 2:
        return symbols
    none = len(merged) * n
    get = ranks.get
    size = 1 << (n - 2).bit_length()
    level = [rank * n + i if (rank := get(a * base + b)) is not None else none for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
    level += [none] * (size - n + 1)
    tree = level
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        tree = level + tree
    tree.insert(0, none)  # node k has the children 2k and 2k + 1
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while (root := tree[1]) < none:
        rank, i = divmod(root, n)
        j = after[i]
        k = after[j]
        new = symbols[i] = merged[rank]
        symbols[j] = -1
        after[i] = k
        value = none
        if k < n:
            before[k] = i
            if (rank := get(new * base + symbols[k])) is not None:
                value = rank * n + i
            tree[at := size + j] = none  # j holds no pair any more
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                if b < a:
                    a = b
                if tree[at] == a:
                    break
                tree[at] = a
                at >>= 1
        tree[at := size + i] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            if b < a:
                a = b
            if tree[at] == a:
                break
            tree[at] = a
            at >>= 1
        if (p := before[i]) >= 0:
            rank = get(symbols[p] * base + new)
            tree[at := size + p] = none if rank is None else rank * n + p
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                if b < a:
                    a = b
                if tree[at] == a:
                    break
                tree[at] = a
                at >>= 1
    return [s for s in symbols if s >= 0]


class WordBpe:
    """Encoder and decoder of one vocabulary file; ids agree with the library's ``encode(..., add_special_tokens=False)``."""

    def __init__(self, path: str, library_merges: bool = False, cache: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or spec["post_processor"] or model["dropout"]:
            raise ValueError("not a lower-case word-level BPE file without decoder")
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.base = 1 + max(self.vocab.values())
        self.ranks, self.merged = {}, []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.vocab[a] * self.base + self.vocab[b]] = len(self.merged)
            self.merged.append(self.vocab[a + b])
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.tokens = [""] * (1 + max(*self.vocab.values(), *self.specials.values()))
        for token, i in (*self.vocab.items(), *self.specials.items()):
            self.tokens[i] = token
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet
        others = (b for b in range(256) if b not in visible)
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(others)}
        lower = sorted({y for x in _PLAIN for y in x.lower()})
        kind = lambda k: "".join(re.escape(x) for x in lower if unicodedata.category(x)[0] == k)
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kind('L')}]+|[{kind('N')}]|[^\s{kind('L')}{kind('N')}]+")
        self.four = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.ids_of = self._library_ids if library_merges else self._tree_ids
        self.tokenize = self.library.model.tokenize  # each look at ``model`` makes a new object
        self.words = RecentCache(self._library_word if library_merges else self._plain_word, cache)
        self.mapped = RecentCache(self._word, cache // 4)

    def _tree_ids(self, word: str) -> list[int]:
        vocab = self.vocab
        symbols = [vocab[c] for c in word[:-1]]
        symbols.append(vocab[word[-1] + self.suffix])
        return merge_word(symbols, self.ranks, self.merged, self.base)

    def _library_ids(self, word: str) -> list[int]:
        return [t.id for t in self.tokenize(word)]

    def _library_word(self, word: str) -> bytes:
        """:meth:`_plain_word` by the library in one step: where most distinct words are rare, this is most of the work."""
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        four = self.four
        return b"".join([four[t.id] for t in self.tokenize(word)])

    def _word(self, word: str) -> bytes:
        """Ids of a pre-token in the byte-level alphabet, as little-endian 32-bit integers."""
        return b"".join(map(self.four.__getitem__, self.ids_of(word)))

    def _plain_word(self, word: str) -> bytes:
        return self._word(word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode())))

    def _plain(self, text: str) -> bytes:
        if not _UNUSUAL.search(text):
            return b"".join(map(self.words.__getitem__, self.cut.findall(text.lower())))
        normal = self.library.normalizer.normalize_str(text)
        return b"".join(self.mapped[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as 32-bit little-endian integers; special tokens written in the text are special."""
        if not text:
            return b""
        if self.special_cut is None or "<|" not in text and not any(s in text for s in self.specials):
            return self._plain(text)
        out = []
        for part in self.special_cut.split(text):
            out.append(array("i", [self.specials[part]]).tobytes() if part in self.specials else self._plain(part))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the library does without a decoder; special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, library_merges: bool = False, cache: int = CACHE_WORDS) -> WordBpe:
    """One instance a worker process; words are merged by the segment tree, or by the library's own model."""
    return WordBpe(path, library_merges, cache)


@lru_cache(maxsize=2)
def token_list(path: str) -> list[str]:
    """Tokens by id: all that decoding needs, so a worker that only decodes holds no encoder."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["decoder"]:
        raise ValueError("only files without decoder are decoded here")
    ids = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
    tokens = [""] * (1 + max(ids.values()))
    for token, i in ids.items():
        tokens[i] = token
    return tokens


def encode_column(text_col: str | Column, path: str) -> Column:
    """array<int> of the ids; null and empty texts give an empty array.

    Declared as nondeterministic, which it is not: so the optimiser does not encode again for each use of the ids.
    """

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        parts = [bpe.encode(t.as_py()) for t in texts]
        offsets = np.zeros(len(parts) + 1, dtype=np.int32)
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        values = np.frombuffer(b"".join(parts), dtype="<i4")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))

    return encode.asNondeterministic()(F.col(text_col) if isinstance(text_col, str) else text_col)


def decode_column(ids_col: str | Column, path: str) -> Column:
    """The decoded text of an array<int>; null and empty arrays give the empty text."""

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        token = token_list(path).__getitem__
        values = rows.values.to_numpy(zero_copy_only=False)
        ends = rows.offsets.to_numpy()
        return pa.array((" ".join(map(token, values[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])), type=pa.string())

    return decode(F.col(ids_col) if isinstance(ids_col, str) else ids_col)


def codec_column(text_col: str | Column, path: str) -> Column:
    """struct<ids, decoded>: both ways in one worker, so a task needs one Python process and ids travel once."""

    @F.arrow_udf("ids array<int>, decoded string")
    def codec(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        parts = [np.frombuffer(bpe.encode(t.as_py()), dtype="<i4") for t in texts]
        offsets = np.zeros(len(parts) + 1, dtype=np.int32)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        values = np.concatenate([np.empty(0, dtype="<i4"), *parts])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))
        decoded = pa.array((bpe.decode(p.tolist()) for p in parts), type=pa.string())
        return pa.StructArray.from_arrays([ids, decoded], names=["ids", "decoded"])

    return codec.asNondeterministic()(F.col(text_col) if isinstance(text_col, str) else text_col)


def bpe_codec(df: DataFrame, path: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of ``text_col`` and the text that they decode to (both new names), in one pass."""
    limit_batches(df.sparkSession, 250)
    (pair,) = free_names(df, "__coded")
    coded = df.withColumn(pair, codec_column(text_col, path))
    return coded.withColumns({ids: F.col(pair)["ids"], decoded: F.col(pair)["decoded"]}).drop(pair)


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text_col`` in ``into`` (a new name). Rows are encoded where they are: no shuffle."""
    limit_batches(df.sparkSession, 250)
    return df.withColumn(into, encode_column(text_col, path))


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of ``ids_col`` in ``into`` (a new name)."""
    limit_batches(df.sparkSession, 250)
    return df.withColumn(into, decode_column(ids_col, path))


def ids_text(ids_col: str | Column) -> Column:
    """Decimal ids joined by one space."""
    return F.concat_ws(" ", (F.col(ids_col) if isinstance(ids_col, str) else ids_col).cast("array<string>"))
