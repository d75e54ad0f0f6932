"""Tokens of a whole Arrow batch of texts at once, as arrays: the tokeniser of the vectorised plans.

Most tokens are runs of one class of characters (letters of one script, digits, line ends) or single characters, so class
changes are token borders; numpy finds them for all texts of the batch together. E-mails, domains and phones need the
patterns, but they can only stand in an island: a run of their characters around an ``@`` or a dot between two labels, or a
run of digits and separators with ten digits. The patterns run over islands alone. No token crosses an island's border:
an island is a maximal run of the characters of its kind, overlapping ones are merged, and a token that began before it
or went on behind it would have its characters in the same run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from spanloom.functions.tokens import BLANK, RULES, TOKEN_TYPES, Token

#: Classes of characters; the codes of token types follow the order of RULES.
SPACE, EOL, RUSSIAN, LATIN, DIGIT, PUNCT, OTHER = range(7)
_TYPE_OF_CLASS = np.array([0, *(TOKEN_TYPES.index(x) for x in ("EOL", "Russian", "Latin", "Int", "Punct", "Other"))], np.uint8)
#: Flags above the class bits: characters of e-mails and domains, of phones, of a label, and Latin letters.
CLASS, WORD, PHONE, LABEL, LETTER = 7, 8, 16, 32, 64
LEAST_DIGITS = 10
#: Bytes of texts that are worked on at once, so that the arrays stay in the processor's cache and memory is bounded.
SLICE_BYTES = 2 << 20


@cache
def _codes() -> np.ndarray:
    """Class and flags of each code point."""
    codes = np.full(0x110000, OTHER, np.uint8)

    def put(chars, value: int) -> None:
        codes[[ord(c) for c in chars]] = value

    put((chr(i) for i in range(0x20000) if chr(i).isdecimal()), DIGIT)
    put((chr(i) for i in (*range(0x410, 0x450), 0x401, 0x451)), RUSSIAN)
    put((chr(i) for i in range(128) if chr(i).isalpha()), LATIN)
    punct = re.compile(dict(RULES)["Punct"])
    put((c for c in map(chr, range(0x3000)) if punct.fullmatch(c)), PUNCT)
    put(BLANK, SPACE)
    put("\n\r", EOL)
    codes[(codes == DIGIT) | (codes == SPACE) | (codes == EOL)] |= PHONE
    codes[(codes & CLASS) == DIGIT] |= WORD
    codes[codes == LATIN] |= WORD | LABEL | LETTER
    for c in "+-_()":
        codes[ord(c)] |= PHONE
    for c in "_.+@-":
        codes[ord(c)] |= WORD
    codes[ord("-")] |= LABEL
    codes[ord("0") : ord("9") + 1] |= LABEL
    return codes


@cache
def _island_pattern() -> re.Pattern:
    """All rules, with white space spelled out, as Python's ``\\s`` has four control characters more."""
    white = "[" + re.escape(BLANK) + "\n\r]"
    rules = [(n, p.replace(r"[\s_-]", white[:-1] + "_-]").replace(r"\S", "[^" + white[1:])) for n, p in RULES]
    rules = [(n, p.replace("_.+-]+@", "_.+-]++@") if n == "Email" else p) for n, p in rules]
    return re.compile("|".join(f"({p})" for _, p in rules))


@dataclass
class Batch:
    """Tokens of some texts. ``first``: the first token of each text, and the number of all; positions are within the text."""

    first: np.ndarray
    values: pa.Array
    kinds: np.ndarray
    byte_start: np.ndarray
    byte_stop: np.ndarray
    char_start: np.ndarray
    char_stop: np.ndarray
    forms: pa.Array | None = None
    tags: pa.Array | None = None

    def __len__(self) -> int:
        return len(self.byte_start)

    def token(self, i: int, idx: int, forms) -> Token:
        return Token(self.values[i].as_py(), TOKEN_TYPES[self.kinds[i]], int(self.byte_start[i]), int(self.byte_stop[i]), int(self.char_start[i]), int(self.char_stop[i]), forms, None, idx)


def _islands(code: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """(start, stop) of islands in order; ``texts``: where each text starts, and the end."""
    found = []

    def runs(places: np.ndarray, flag: int) -> tuple[np.ndarray, np.ndarray]:
        """Borders of the runs of characters with a flag around some places."""
        outside = np.flatnonzero((code & flag) == 0)
        at = np.searchsorted(outside, places)
        left = np.concatenate([[-1], outside])[at] + 1
        right = np.concatenate([outside, [len(code)]])[at]
        text = np.searchsorted(texts, places, "right")
        return np.maximum(left, texts[text - 1]), np.minimum(right, texts[text])

    middle = code[1:-1]
    dots = middle == code_of(".")
    at_signs = middle == code_of("@")
    for signs, before, after in ((dots, LABEL, LETTER), (at_signs, WORD, LABEL)):
        places = np.flatnonzero(signs) + 1
        places = places[((code[places - 1] & before) > 0) & ((code[places + 1] & after) > 0)]
        if len(places):
            found.append(np.unique(np.stack(runs(places, WORD), 1), axis=0))
    digits = np.flatnonzero((code & CLASS) == DIGIT)
    if len(digits) >= LEAST_DIGITS:
        # ten digits in one run lie close: only digits whose ninth successor is near can start such a run
        left, right = runs(digits, PHONE)
        starts, inverse, count = np.unique(left, return_inverse=True, return_counts=True)
        many = np.flatnonzero(count >= LEAST_DIGITS)
        if len(many):
            stops = np.zeros(len(starts), np.int64)
            stops[inverse] = right
            found.append(np.stack([starts[many], stops[many]], 1))
    if not found:
        return np.zeros((0, 2), np.int64)
    spans = np.concatenate(found)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] >= reach[:-1]])
    starts = spans[new, 0]
    stops = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]
    return np.stack([starts, stops], 1)


def code_of(char: str) -> int:
    """The code of a character; a dot and an at sign have codes that no other character shares (set below)."""
    return {".": 0x80 | PUNCT | WORD, "@": 0xC0 | PUNCT | WORD}[char]


@cache
def _table() -> np.ndarray:
    table = _codes().copy()
    table[ord(".")], table[ord("@")] = code_of("."), code_of("@")
    return table


def tokenise(texts: pa.Array) -> Batch:
    """The tokens of an array of texts; a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    text = None
    if len(data) and data.max() >= 0x80:
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        at_byte = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        starts = np.searchsorted(at_byte, offsets)
        code = _table()[points]
    else:
        at_byte, starts = None, offsets
        code = _table()[:128][data]
    none = np.zeros(0, np.int64)
    if not len(code):
        return Batch(np.zeros(n + 1, np.int64), pa.array([], pa.string()), np.zeros(0, np.uint8), none, none, none, none)
    kind = code & CLASS
    edge = np.empty(len(code) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] >= PUNCT)
    edge[starts] = True
    edge[0] = edge[-1] = True
    places = np.flatnonzero(edge)
    begin, end = places[:-1], places[1:]
    kinds = kind[begin]
    word = kinds != SPACE
    begin, end, kinds = begin[word], end[word], _TYPE_OF_CLASS[kinds[word]]
    islands = _islands(code, starts)
    if len(islands):
        if text is None:
            text = data.tobytes().decode("ascii")
        pattern, extra = _island_pattern(), []
        for a, b in islands.tolist():
            for m in pattern.finditer(text, a, b):
                extra.append((*m.span(), m.lastindex - 1))
        island = np.searchsorted(islands[:, 0], begin, "right") - 1
        outside = (island < 0) | (begin >= islands[island, 1])
        more = np.array(extra, np.int64).reshape(-1, 3)
        begin = np.concatenate([begin[outside], more[:, 0]])
        end = np.concatenate([end[outside], more[:, 1]])
        kinds = np.concatenate([kinds[outside], more[:, 2].astype(np.uint8)])
        order = np.argsort(begin, kind="stable")
        begin, end, kinds = begin[order], end[order], kinds[order]
    first = np.searchsorted(begin, starts)
    owner = np.repeat(starts[:-1], np.diff(first))
    char_start, char_stop = begin - owner, end - owner
    if at_byte is None:
        byte_begin, byte_end, byte_start, byte_stop = begin, end, char_start, char_stop
    else:
        byte_begin, byte_end = at_byte[begin], at_byte[end]
        owner = np.repeat(offsets[:-1], np.diff(first))
        byte_start, byte_stop = byte_begin - owner, byte_end - owner
    # the bytes of all tokens, without those between them
    step = np.zeros(len(data) + 1, np.int8)
    step[byte_begin] += 1
    step[byte_end] -= 1
    kept = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    ends = np.concatenate([[0], np.cumsum(byte_end - byte_begin)])
    values = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kept)])
    return Batch(first, values, kinds, byte_start, byte_stop, char_start, char_stop)


def slices(texts: pa.Array):
    """(start, stop) of rows of about SLICE_BYTES of text, one row at least."""
    if not len(texts):
        return
    large = texts.cast(pa.large_string())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    start = 0
    while start < len(large):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, "right")) - 1)
        yield start, min(stop, len(large))
        start = min(stop, len(large))


_FORMS = pa.list_(pa.struct([("lemma", pa.string()), ("grams", pa.list_(pa.string())), ("lemma_id", pa.int64()), ("form", pa.string())]))


def token_arrays(texts: pa.Array) -> pa.Array:
    """array<TOKEN> of each text, null for null."""
    parts = []
    for a, b in slices(texts):
        some = texts.slice(a, b - a)
        t = tokenise(some)
        n = len(t)
        idx = np.arange(n) - np.repeat(t.first[:-1], np.diff(t.first))
        ints = [pa.array(x.astype(np.int32)) for x in (t.byte_start, t.byte_stop, t.char_start, t.char_stop)]
        names = ["idx", "value", "token_type", "byte_start", "byte_stop", "char_start", "char_stop", "forms", "tag"]
        columns = [pa.array(idx.astype(np.int32)), t.values, pa.array(TOKEN_TYPES, pa.string()).take(pa.array(t.kinds)), *ints, pa.nulls(n, _FORMS), pa.nulls(n, pa.string())]
        tokens = pa.StructArray.from_arrays(columns, names)
        parts.append(pa.ListArray.from_arrays(pa.array(t.first.astype(np.int32)), tokens, mask=some.is_null()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("idx", pa.int32())])))


def row_arrays(texts: pa.Array, fields: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
    """The text that each token belongs to, and the named fields of all tokens of an array of texts."""
    t = tokenise(texts)
    size = np.diff(t.first)
    ints = {n: getattr(t, n) for n in ("byte_start", "byte_stop", "char_start", "char_stop")}

    def column(name: str) -> pa.Array:
        if name == "value":
            return t.values
        if name == "token_type":
            return pa.array(TOKEN_TYPES, pa.string()).take(pa.array(t.kinds))
        at = np.arange(len(t)) - np.repeat(t.first[:-1], size) if name == "idx" else ints[name]
        return pa.array(at.astype(np.int32))

    return np.repeat(np.arange(len(size)), size), [column(n) for n in fields]
