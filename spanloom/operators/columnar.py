"""The vectorised plan: batches of documents in, matches or facts out, in one Arrow pass without a shuffle.

Tokens, bit sets of predicates and matches of a batch are arrays. A predicate is evaluated once a distinct token value (or
natively, where it reads more than the value). Grammars that unfold into few sequences, or repeat one predicate, are matched
and resolved by array operations. Facts, agreement, recursion and gazetteers need trees: the chart then runs over the
stretches that can hold a match alone, which is sound, as a tree reads nothing but its own tokens and as conflicts are only
between matches that overlap.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spanloom.functions import predicates as P
from spanloom.functions.batches import Batch, slices, tokenise
from spanloom.functions.tokens import TOKEN_TYPES, Token
from spanloom.operators.chart import Machine, Match, Texts, derive, lengths, matches
from spanloom.plans.grammar import Compiled

WORD_BITS = 62
#: Distinct token values that a worker remembers the bits of; it forgets all of them beyond.
REMEMBERED = 500_000
#: Frames that recursion over a tree may take in a worker; Python keeps them on the heap.
DEEPEST = 200_000
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
MATCH_COLUMNS = [("match_no", pa.int32()), ("tok_start", pa.int32()), ("tok_stop", pa.int32()), ("byte_start", pa.int32()), ("byte_stop", pa.int32()), ("text", pa.string()), ("values", pa.list_(pa.string()))]
FACT_COLUMNS = [("match_no", pa.int32()), ("fact_no", pa.int32()), ("name", pa.string()), ("fields", pa.string()), ("spans", SPAN), ("tok_start", pa.int32()), ("tok_stop", pa.int32())]
TREE_COLUMNS = [("tree", pa.string())]
NODE_COLUMNS = [("match_no", pa.int32()), ("node_no", pa.int32()), ("parent_no", pa.int32()), ("depth", pa.int32()), ("rule", pa.int32()), ("label", pa.string()), ("production", pa.int32()), ("tok_start", pa.int32()), ("tok_stop", pa.int32()), ("text", pa.string())]


def by_value(predicate: P.Predicate) -> bool:
    """Whether a predicate of this library depends on the token's value, type and forms alone."""
    if isinstance(predicate, (P.And, P.Or)):
        return all(map(by_value, predicate.parts))
    if isinstance(predicate, P.Not):
        return by_value(predicate.part)
    return type(predicate).__module__ == P.__name__


@dataclass
class Plan:
    """What the worker needs. ``sequences`` or ``run`` are set if matches are found by array operations."""

    compiled: Compiled
    verb: str
    what: str  # matches, facts, trees or nodes
    sequences: list[tuple] | None
    run: tuple | None
    forms: dict[str, list[dict]] | None  # by lower-case word
    paradigms: dict[int, list[dict]] | None
    types: tuple[str, ...]
    text_type: str = "text"  # or tokens, with bit sets

    @property
    def needs_trees(self) -> bool:
        return self.what != "matches" or bool(self.compiled.wrappers("relation")) or self.verb not in ("findall", "find", "match")

    @property
    def columns(self) -> list[tuple]:
        return {"matches": MATCH_COLUMNS, "facts": FACT_COLUMNS, "trees": TREE_COLUMNS, "nodes": NODE_COLUMNS}[self.what]


class Marks:
    """Per token: the bits of its predicates, whether it can stand in a match at all, and whether it can start one."""

    def __init__(self, plan: Plan, machine: Machine):
        self.plan, self.machine = plan, machine
        self.known: dict[str, tuple[int, bool, bool]] = {}
        self.words = [(p, set(self._keys(p.root))) for p in machine.phrases.values()]
        first = machine.first[0]
        self.first = first if first >= 0 else self._starting()

    def _starting(self) -> int:
        """Bits that can start a match beside the phrases."""
        bits = 0
        for x in self.plan.compiled.first():
            if isinstance(x, P.Predicate):
                bits |= self.machine.bit[x]
        return bits

    @staticmethod
    def _keys(root: dict) -> Iterator[str]:
        todo = [root]
        while todo:
            node = todo.pop()
            for word, below in node.items():
                if word is not None:
                    yield word
                    todo.append(below)

    def phrase_marks(self, token: Token) -> tuple[bool, bool]:
        alive = start = False
        for phrases, words in self.words:
            for v in phrases._values(token):
                alive, start = alive or v in words, start or v in phrases.root
        return alive, start

    def forms_of(self, value: str, kind: str) -> list[dict] | None:
        return self.plan.forms.get(value.lower(), []) if self.plan.forms is not None and kind in self.plan.types else None

    def of(self, value: str, kind: str) -> tuple[int, bool, bool]:
        token = Token(value, kind, 0, 0, 0, 0, self.forms_of(value, kind))
        bits = 0
        for predicate, bit in self.machine.bit.items():
            if predicate.test(token):
                bits |= bit
        alive, start = self.phrase_marks(token) if self.words else (False, False)
        return bits, alive or bits != 0, start or bits & self.first != 0

    def __call__(self, batch: Batch) -> tuple[list[int] | np.ndarray, np.ndarray, np.ndarray]:
        coded = batch.values.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary.to_pylist()
        kinds = np.zeros(len(words), np.uint8)
        kinds[codes] = batch.kinds  # a token's value decides its type
        if len(self.known) > REMEMBERED:
            self.known.clear()
        marks = []
        for word, kind in zip(words, kinds.tolist()):
            mark = self.known.get(word)
            if mark is None:
                mark = self.known[word] = self.of(word, TOKEN_TYPES[kind])
            marks.append(mark)
        bits = [m[0] for m in marks]
        alive, start = (np.array([m[i] for m in marks], bool)[codes] for i in (1, 2))
        if len(self.machine.bit) <= WORD_BITS:
            return np.array(bits, np.int64)[codes], alive, start
        wide = np.empty(len(bits), object)
        wide[:] = bits
        return wide[codes], alive, start


# matches by array operations: starts and stops are token numbers in the batch


def _by_sequence(plan: Plan, machine: Machine, batch: Batch, bits: np.ndarray, longest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate spans in order; ``longest``: of each start the longest alone."""
    ends = np.repeat(batch.first[1:], np.diff(batch.first))
    found = []
    for sequence in plan.sequences:
        wanted = [machine.bit[x] for x in sequence]
        at = np.flatnonzero(bits & wanted[0])
        at = at[at + len(sequence) <= ends[at]]
        for k, bit in enumerate(wanted[1:], 1):
            at = at[(bits[at + k] & bit) != 0]
        found.append((at, at + len(sequence)))
    start = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
    stop = np.concatenate([b for _, b in found]) if found else np.zeros(0, np.int64)
    order = np.lexsort((-stop, start))
    start, stop = start[order], stop[order]
    if len(start):
        new = np.concatenate([[True], (start[1:] != start[:-1]) | ((stop[1:] != stop[:-1]) & (not longest))])
        start, stop = start[new], stop[new]
    return start, stop


def _by_run(plan: Plan, machine: Machine, batch: Batch, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest runs of the repeated predicate."""
    predicate, low = plan.run
    hit = np.concatenate([[False], (bits & machine.bit[predicate]) != 0, [False]])
    border = np.zeros(len(bits) + 1, bool)
    border[batch.first] = True
    starts = np.flatnonzero(hit[1:] & (~hit[:-1] | border))
    starts = starts[starts < len(bits)]
    stops = np.flatnonzero(hit[:-1] & (~hit[1:] | border))
    long = stops - starts >= low
    return starts[long], stops[long]


def resolved(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which spans stay, in order of start and falling stop; spans of different documents never overlap."""
    if not len(start):
        return np.zeros(0, bool)
    before = np.concatenate([[-1], np.maximum.accumulate(stop)[:-1]])
    record = np.flatnonzero(stop > before)
    following = np.concatenate([start[record][1:], [np.iinfo(np.int64).max]])
    keep = np.zeros(len(start), bool)
    keep[record[following >= stop[record]]] = True
    return keep


def _whole(plan: Plan, machine: Machine, batch: Batch, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that are one of the sequences."""
    size = np.diff(batch.first)
    good = np.zeros(len(size), bool)
    for sequence in plan.sequences:
        docs = np.flatnonzero(size == len(sequence))
        for k, x in enumerate(sequence):
            docs = docs[(bits[batch.first[docs] + k] & machine.bit[x]) != 0]
        good[docs] = True
    return batch.first[:-1][good], batch.first[1:][good]


def _numbered(batch: Batch, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document of each match, and its number there."""
    doc = np.searchsorted(batch.first, start, "right") - 1
    if not len(doc):
        return doc, doc
    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return doc, np.arange(len(doc)) - np.repeat(new, np.diff(np.concatenate([new, [len(doc)]])))


def described(batch: Batch, start: np.ndarray, stop: np.ndarray, number: np.ndarray, doc: np.ndarray) -> list[pa.Array]:
    """MATCH_COLUMNS of spans of tokens."""
    size = stop - start
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    values = batch.values.take(pa.array(at))
    gap = batch.byte_start[at] > batch.byte_stop[np.maximum(at - 1, 0)]
    gap[ends[:-1]] = False
    spaced = pc.binary_join_element_wise(pa.array(["", " "]).take(pa.array(gap.astype(np.int8))), values, "")
    offsets = pa.array(ends.astype(np.int32))
    ints = [number, start - batch.first[doc], stop - batch.first[doc], batch.byte_start[start], batch.byte_stop[stop - 1]]
    return [*[pa.array(x.astype(np.int32)) for x in ints], pc.binary_join(pa.ListArray.from_arrays(offsets, spaced), ""), pa.ListArray.from_arrays(offsets, values)]


# matches by trees


def _stretches(plan: Plan, machine: Machine, batch: Batch, bits, alive: np.ndarray, starting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of tokens, none over a document's border, that hold all matches."""
    if plan.verb == "match":
        size = np.diff(batch.first)
        dead = np.concatenate([[0], np.cumsum(~alive)])
        docs = np.flatnonzero((size > 0) & (dead[batch.first[1:]] == dead[batch.first[:-1]]))
        return batch.first[docs], batch.first[docs + 1]
    if plan.sequences is not None and not machine.phrases:
        start, stop = _by_sequence(plan, machine, batch, bits, False)
        if not len(start):
            return start, stop
        reach = np.maximum.accumulate(stop)
        new = np.flatnonzero(np.concatenate([[True], start[1:] >= reach[:-1]]))
        return start[new], reach[np.concatenate([new[1:] - 1, [len(start) - 1]])]
    live = np.concatenate([[False], alive, [False]])
    border = np.zeros(len(alive) + 1, bool)
    border[batch.first] = True
    start = np.flatnonzero(live[1:] & (~live[:-1] | border))
    start = start[start < len(alive)]
    stop = np.flatnonzero(live[:-1] & (~live[1:] | border))
    first = np.flatnonzero(starting)
    if not len(first):
        return start[:0], stop[:0]
    place = np.searchsorted(first, start)
    start = first[np.minimum(place, len(first) - 1)]  # what stands before the first token that can start is in no match
    good = (place < len(first)) & (start < stop)
    return start[good], stop[good]


def _render(tree, base: int) -> str:
    if tree.symbol is None:
        return str(tree.start + base)
    return f"({tree.symbol.number}.{tree.rank} {' '.join(_render(c, base) for c in tree.children)})"


def label(tree) -> str:
    """What a node is: the name of a fact, a field or a rule, "relation", a gazetteer's name, or the predicate of a leaf."""
    if tree.symbol is None:
        return tree.predicate.label() if tree.predicate is not None else "token"
    if tree.symbol.gazetteer:
        return tree.symbol.gazetteer.name
    if not tree.symbol.wrapper:
        return f"R{tree.symbol.number}"
    kind, payload = tree.symbol.wrapper
    return "relation" if kind == "relation" else payload if isinstance(payload, str) else payload.name


def _node_rows(match: Match, base: int, number: int) -> Iterator[tuple]:
    texts = Texts(match.tokens, match.forms, match.paradigms)
    todo, count = [(match.tree, None, 0)], 0
    while todo:
        node, parent, depth = todo.pop()
        rule = node.symbol.number if node.symbol is not None else None
        yield number, count, parent, depth, rule, label(node), node.rank if rule is not None else None, node.start + base, node.stop + base, texts.text(node)
        todo.extend((c, count, depth + 1) for c in reversed(node.children))
        count += 1


def _rows(match: Match, base: int, number: int, what: str) -> Iterator[tuple]:
    a, b = match.range
    if what == "trees":
        yield (_render(match.tree, base),)
    elif what == "nodes":
        yield from _node_rows(match, base, number)
    else:
        for k, r in enumerate(match.facts()):
            yield number, k, r.name, r.fields_json(), [{"start": x, "stop": y} for x, y in r.spans], a + base, b + base


class Worker:
    """One process's state: the machine and what it remembers of token values."""

    def __init__(self, plan: Plan):
        self.plan = plan
        every = plan.what != "matches" or plan.verb != "findall" or bool(plan.compiled.wrappers("relation"))
        self.machine = Machine(plan.compiled, all_trees=every)
        self.marks = Marks(plan, self.machine)
        self.sizes = lengths(plan.compiled)

    def _run_facts(self, batch: Batch, bits: np.ndarray, token: Callable[[int], Token], known) -> tuple[np.ndarray, list[tuple]] | None:
        """Facts of a repeated predicate: ranges by array operations, trees by lengths."""
        plan = self.plan
        start, stop = _by_run(plan, self.machine, batch, bits)
        doc, number = _numbered(batch, start)
        owner, rows = [], []
        for d, k, a, b in zip(doc.tolist(), number.tolist(), start.tolist(), stop.tolist()):
            if k and plan.verb == "find":
                continue
            tree = derive(plan.compiled, self.sizes, 0, b - a)
            if tree is None:
                return None
            paradigms = (plan.paradigms or {}) if known is None else known(d)
            for row in _rows(Match(tree, [token(i) for i in range(a, b)], {}, paradigms, self.machine.flat), a - int(batch.first[d]), k, plan.what):
                owner.append(d)
                rows.append(row)
        return np.array(owner, np.int64), rows

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        batch = tokenise(texts)
        bits, alive, starting = self.marks(batch)
        kinds = batch.kinds.tolist() if self.plan.needs_trees or self.machine.phrases else []

        def forms(i: int) -> list[dict] | None:
            return self.marks.forms_of(batch.values[i].as_py(), TOKEN_TYPES[kinds[i]]) if self.plan.forms is not None else None

        return self._found(batch, bits, alive, starting, lambda i: batch.token(i, i - int(batch.first[np.searchsorted(batch.first, i, "right") - 1]), forms(i)), None)

    def of_tokens(self, tokens: pa.Array, masks: pa.Array, paradigms: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """Documents that have tokens (from a tagger, a large lexicon or a source), with bit sets by native predicates."""
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = tokens.flatten()
        get = lambda name: flat.field(name)
        ints = [get(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("byte_start", "byte_stop", "char_start", "char_stop")]
        batch = Batch(first, get("value"), np.zeros(len(flat), np.uint8), *ints)
        columns = [masks.flatten().filter(pa.array(np.arange(len(masks.flatten())) % max(self._words, 1) == k)).flatten().to_numpy(zero_copy_only=False) for k in range(self._words)]
        if self._words == 1:
            bits = columns[0].astype(np.int64)
        else:
            bits = np.zeros(len(flat), object)
            for k, column in enumerate(columns):
                bits += column.astype(object) << (WORD_BITS * k)
        made: dict[int, Token] = {}

        def token(i: int) -> Token:
            if i not in made:
                t = flat[i].as_py()
                made[i] = Token(t["value"], t["token_type"], t["byte_start"], t["byte_stop"], t["char_start"], t["char_stop"], t["forms"], t["tag"], t["idx"])
            return made[i]

        alive, starting = (bits != 0).astype(bool), (bits & self.marks.first != 0).astype(bool)
        if self.machine.phrases:
            marks = [self.marks.phrase_marks(token(i)) for i in range(len(flat))]
            alive |= np.array([m[0] for m in marks], bool)
            starting |= np.array([m[1] for m in marks], bool)

        def known(doc: int) -> dict[int, list[dict]]:
            out: dict[int, list[dict]] = {}
            for p in paradigms[doc].as_py() or ():
                out.setdefault(p["lemma_id"], []).append(p)
            return out

        return self._found(batch, bits, alive, starting, token, known)

    @property
    def _words(self) -> int:
        return max(1, -(-len(self.plan.compiled.predicates) // WORD_BITS))

    def _found(self, batch: Batch, bits, alive, starting, token: Callable[[int], Token], known) -> tuple[np.ndarray, list[pa.Array]]:
        plan, machine = self.plan, self.machine
        native = (plan.sequences is not None or plan.run and plan.verb != "match") and len(machine.bit) <= WORD_BITS
        if native and not plan.needs_trees:
            if plan.verb == "match":
                start, stop = _whole(plan, machine, batch, bits)
            elif plan.run:
                start, stop = _by_run(plan, machine, batch, bits)
            else:
                start, stop = _by_sequence(plan, machine, batch, bits, True)
                keep = resolved(start, stop)
                start, stop = start[keep], stop[keep]
            doc, number = _numbered(batch, start)
            if plan.verb == "find":
                start, stop, doc, number = (x[number == 0] for x in (start, stop, doc, number))
            return doc, described(batch, start, stop, number, doc)
        if len(machine.bit) > WORD_BITS:
            plan.sequences = None
        table = lambda rows: [pa.array([r[c] for r in rows], type=t) for c, (_, t) in enumerate(plan.columns)]
        if native and plan.run and plan.what == "facts" and plan.verb in ("findall", "find") and not plan.compiled.wrappers("relation"):
            made = self._run_facts(batch, bits, token, known)
            if made is not None:
                return made[0], table(made[1])
        starts, stops = _stretches(plan, machine, batch, bits, alive, starting)
        docs = np.searchsorted(batch.first, starts, "right") - 1
        owner, rows, at, number, last, paradigms = [], [], -1, 0, -1, {}
        for doc, a, b in zip(docs.tolist(), starts.tolist(), stops.tolist()):
            if doc != at:
                at, number = doc, 0
                paradigms = (plan.paradigms or {}) if known is None else known(doc)
            if doc == last and plan.verb in ("find", "parse"):
                continue
            hits = bits[a:b].tolist()
            tokens = [token(i) for i in range(a, b)]
            for m in matches(machine, plan.verb, hits, tokens, paradigms):
                last = doc
                if plan.what == "matches":
                    owner.append(doc)
                    rows.append((m.tree.start + a, m.tree.stop + a, number))
                    number += 1
                    continue
                for row in _rows(m, a - int(batch.first[doc]), number, plan.what):
                    owner.append(doc)
                    rows.append(row)
                number += 1
        owner = np.array(owner, np.int64)
        if plan.what == "matches":
            found = np.array(rows, np.int64).reshape(-1, 3)
            return owner, described(batch, *found.T, owner)
        return owner, table(rows)


def worker(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow function: (key, text) or (key, tokens, bit sets, paradigms) in, (key, columns of the plan) out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
        state = Worker(plan)
        for batch in batches:
            keys = batch.column(0)
            if plan.text_type == "text":
                parts = ((keys.slice(a, b - a), state.of_texts(batch.column(1).slice(a, b - a))) for a, b in slices(batch.column(1)))
            else:
                parts = iter([(keys, state.of_tokens(batch.column(1), batch.column(2), batch.column(3)))])
            for some, (doc, columns) in parts:
                yield pa.RecordBatch.from_arrays([some.take(pa.array(doc)), *columns], names=["__key", *[n for n, _ in plan.columns]])

    return run
