"""The local chart: Earley's algorithm over one document, for grammars with recursion, agreement or facts.

Predicates were evaluated before, natively: the chart sees one bit set a token. Productions are predicted in order and
items are processed in the order of their arrival, so the first derivation of a range is well defined. Empty rules are
skipped over at prediction, which makes every nullable position complete.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cmp_to_key

from spanloom.functions.spans import resolve_local
from spanloom.operators.facts import Interpreter, Record, flat_facts
from spanloom.operators.relations import narrow
from spanloom.plans.grammar import Compiled, Symbol


@dataclass(eq=False, slots=True)
class Tree:
    """A parsed node, or a leaf (``symbol`` None, one token). ``line`` is the phrase of a gazetteer node."""

    symbol: Symbol | None
    rank: int
    start: int
    stop: int
    children: tuple
    predicate: object = None
    line: str | None = None

    def leaves(self) -> list[Tree]:
        return [x for x in self.walk() if x.symbol is None]

    def walk(self):
        """All nodes, each before its children; repeats make trees deep, so there is no recursion here."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))


def compare(a: Tree, b: Tree) -> int:
    """Earlier start, then longer, then rule, production and children; alternatives in one place by production first."""
    if a is b:
        return 0
    key = (a.start, -a.stop), (b.start, -b.stop)
    if key[0] != key[1]:
        return -1 if key[0] < key[1] else 1
    return _compare_nodes(a, b)


def _compare_nodes(a: Tree, b: Tree) -> int:
    if a is b:
        return 0
    x, y = (a.symbol.number, a.rank), (b.symbol.number, b.rank)
    if x != y:
        return -1 if x < y else 1
    left, right = ([c for c in t.children if c.stop > c.start] for t in (a, b))
    for c, d in zip(left, right):
        if c.symbol is None and d.symbol is None:
            continue
        if c.symbol is None or d.symbol is None:
            return -1 if c.symbol is None else 1
        if c.rank != d.rank:
            return -1 if c.rank < d.rank else 1
        if found := _compare_nodes(c, d):
            return found
    return (len(left) > len(right)) - (len(left) < len(right))


class Phrases:
    """A trie over a gazetteer's keys, matched against token values or lemmas."""

    def __init__(self, gazetteer):
        self.mode, self.root = gazetteer.mode, {}
        self.lines = gazetteer.lines
        for number, key in enumerate(gazetteer.keys):
            nodes = [self.root]
            for variants in key:
                nodes = [n.setdefault(v, {}) for n in nodes for v in dict.fromkeys(variants)]
            for n in nodes:
                n.setdefault(None, []).append(number)

    def _values(self, token) -> list[str]:
        if self.mode == "exact":
            return [token.value]
        low = token.value.lower()
        if self.mode == "caseless":
            return [low]
        if not token.value.isalpha():
            return [token.value]
        return [low] if token.forms is None else list(dict.fromkeys(f["lemma"] for f in token.forms))

    def at(self, tokens, i: int) -> list[tuple[int, int]]:
        """(stop, phrase number) of the phrases that start at token i."""
        out, nodes = [], [self.root]
        while nodes and i < len(tokens):
            values = self._values(tokens[i])
            nodes = [n[v] for n in nodes for v in values if v in n]
            i += 1
            for n in nodes:
                out += [(i, number) for number in n.get(None, ())]
        return sorted(dict.fromkeys(out), key=lambda x: (x[1], x[0]))


class Machine:
    """A compiled grammar prepared for parsing; ``all_trees`` keeps every derivation, else the first of each item."""

    def __init__(self, compiled: Compiled, all_trees: bool = True):
        self.compiled, self.all_trees = compiled, all_trees
        self.bit = {predicate: 1 << i for i, predicate in enumerate(compiled.predicates)}
        self.phrases = {s.number: Phrases(s.gazetteer) for s in compiled.symbols if s.gazetteer}
        self.first = self._first_masks()
        self.flat = flat_facts(compiled)

    def _first_masks(self) -> list[int]:
        """Bits that can start each symbol; -1 if a phrase can."""
        masks = [-1 if s.gazetteer else 0 for s in self.compiled.symbols]
        changed = True
        while changed:
            changed = False
            for s in self.compiled.symbols:
                mask = masks[s.number]
                for production in s.productions:
                    for x in production:
                        mask |= masks[x.number] if isinstance(x, Symbol) else self.bit[x]
                        if not (isinstance(x, Symbol) and x.nullable):
                            break
                if mask != masks[s.number]:
                    masks[s.number], changed = mask, True
        return masks

    def parse(self, hits: list[int], tokens=None, everywhere: bool = True) -> list[Tree]:
        """Root trees that match at least one token, by end and then in the order they were found."""
        n, root = len(hits), self.compiled.root
        columns: list[list] = [[] for _ in range(n + 1)]
        seen: list[set] = [set() for _ in range(n + 1)]
        waiting: list[dict] = [{} for _ in range(n + 1)]
        predicted: list[set] = [set() for _ in range(n + 1)]
        later: list[list[Tree]] = [[] for _ in range(n + 1)]
        found: list[Tree] = []
        bit, first, all_trees, phrases = self.bit, self.first, self.all_trees, self.phrases

        def add(i: int, symbol: Symbol, production: int, dot: int, start: int, children: tuple) -> None:
            key = (symbol.number, production, dot, start, tuple(map(id, children)) if all_trees else None)
            if key not in seen[i]:
                seen[i].add(key)
                columns[i].append((symbol, production, dot, start, children))

        def predict(i: int, symbol: Symbol) -> None:
            if symbol.number in predicted[i] or i >= n:
                return
            if first[symbol.number] >= 0 and not first[symbol.number] & hits[i]:
                return
            predicted[i].add(symbol.number)
            for k in range(len(symbol.productions)):
                add(i, symbol, k, 0, i, ())
            if symbol.gazetteer:
                for stop, number in phrases[symbol.number].at(tokens, i):
                    leaves = tuple(Tree(None, 0, t, t + 1, ()) for t in range(i, stop))
                    later[stop].append(Tree(symbol, number, i, stop, leaves, line=symbol.gazetteer.lines[number]))

        def complete(i: int, tree: Tree) -> None:
            if tree.symbol is root and (everywhere or tree.start == 0 and tree.stop == n):
                found.append(tree)
            for symbol, production, dot, start, children in waiting[tree.start].get(tree.symbol.number, ()):
                add(i, symbol, production, dot + 1, start, (*children, tree))

        done: list[set] = [set() for _ in range(n + 1)]
        for i in range(n + 1):
            if everywhere or i == 0:
                predict(i, root)
            column = columns[i]
            for tree in later[i]:
                complete(i, tree)
            for symbol, production, dot, start, children in column:  # grows on the way
                items = symbol.productions[production]
                if dot == len(items):
                    if start == i:
                        continue
                    if not all_trees:
                        if (symbol.number, start) in done[i]:
                            continue
                        done[i].add((symbol.number, start))
                    complete(i, Tree(symbol, production, start, i, children))
                    continue
                x = items[dot]
                if isinstance(x, Symbol):
                    waiting[i].setdefault(x.number, []).append((symbol, production, dot, start, children))
                    predict(i, x)
                    if x.nullable:
                        add(i, symbol, production, dot + 1, start, (*children, Tree(x, 0, i, i, ())))
                elif i < n and hits[i] & bit[x]:
                    add(i + 1, symbol, production, dot + 1, start, (*children, Tree(None, 0, i, i + 1, (), x)))
        return found


def lengths(compiled: Compiled) -> dict[int, tuple[int, float]]:
    """The least and the greatest number of tokens of each rule."""
    out = {s.number: (float("inf"), 0.0) for s in compiled.symbols}
    for _ in range(len(compiled.symbols) + 1):
        for s in compiled.symbols:
            sizes = [[out[x.number] if isinstance(x, Symbol) else (1, 1) for x in q] for q in s.productions]
            out[s.number] = (min((sum(a for a, _ in q) for q in sizes), default=1), max((sum(b for _, b in q) for q in sizes), default=1))
    grown = dict(out)
    for s in compiled.symbols:  # what still grows has no greatest length
        sizes = [sum(grown[x.number][1] if isinstance(x, Symbol) else 1 for x in q) for q in s.productions]
        if max(sizes, default=1) > out[s.number][1]:
            out[s.number] = (out[s.number][0], float("inf"))
    return out


def derive(compiled: Compiled, sizes: dict[int, tuple[int, float]], start: int, stop: int) -> Tree | None:
    """The tree of a range that is known to match, for grammars where lengths alone decide the derivation, such as a
    repeated token; None where they do not. Linear in the range, while a chart of a repeat holds all stretches in it."""
    root = Tree(compiled.root, 0, start, stop, ())
    todo = [root]
    while todo:
        node = todo.pop()
        n, made = node.stop - node.start, None
        for rank, q in enumerate(node.symbol.productions):
            bounds = [sizes[x.number] if isinstance(x, Symbol) else (1, 1) for x in q]
            free = [i for i, (a, b) in enumerate(bounds) if a != b]
            least = sum(a for a, _ in bounds)
            if not q or not least <= n <= sum(b for _, b in bounds):
                continue
            if len(free) > 1:
                return None
            at, children = node.start, []
            for i, (x, (a, _)) in enumerate(zip(q, bounds)):
                end = at + a + (n - least if i in free else 0)
                children.append(Tree(x, 0, at, end, ()) if isinstance(x, Symbol) else Tree(None, 0, at, end, (), x))
                at = end
            made = rank, children
            break
        if made is None or node.symbol.gazetteer:
            return None
        node.rank, node.children = made[0], tuple(made[1])
        todo += [c for c in made[1] if c.symbol is not None and c.stop > c.start]
    return root


# trees to matches


def head(tree: Tree) -> Tree | None:
    """The leaf that the head terms lead to."""
    while tree.symbol is not None:
        if not tree.children:
            return None
        place = 0 if tree.symbol.gazetteer else tree.symbol.heads[tree.rank]
        tree = tree.children[min(place, len(tree.children) - 1)]
    return tree


def leaf_forms(leaf: Tree, tokens) -> list[dict] | None:
    """The token's forms as far as the leaf's predicate keeps them."""
    token = tokens[leaf.start]
    kept = leaf.predicate.kept_forms(token.forms, token) if leaf.predicate is not None and token.forms is not None else None
    return token.forms if kept is None else kept


def agreed(tree: Tree, tokens) -> dict[int, list[dict]] | None:
    """Narrowed forms by token after all relations of the tree; None if a relation fails."""
    groups: dict[int, tuple] = {}
    for node in tree.walk():
        if node.symbol is not None and node.symbol.wrapper and node.symbol.wrapper[0] == "relation" and node.stop > node.start:
            relation = node.symbol.wrapper[1]
            groups.setdefault(id(relation), (relation, []))[1].append(head(node))
    forms: dict[int, list[dict]] = {}
    for relation, heads in groups.values():
        heads = list({h.start: h for h in heads if h is not None}.values())
        now = narrow(relation, [forms.get(h.start, leaf_forms(h, tokens)) for h in heads])
        if now is None:
            return None
        forms |= {h.start: f for h, f in zip(heads, now)}
    return forms


class Texts:
    """Values of tree nodes for the interpreter."""

    def __init__(self, tokens, forms: dict[int, list[dict]], paradigms: dict[int, list[dict]]):
        self.tokens, self.forms, self.paradigms = tokens, forms, paradigms

    def _join(self, node: Tree, value) -> str:
        out, stop = [], None
        for leaf in node.leaves():
            t = self.tokens[leaf.start]
            out.append((" " if stop is not None and t.byte_start > stop else "") + value(leaf, t))
            stop = t.byte_stop
        return "".join(out)

    def span(self, node: Tree) -> tuple[int, int]:
        if node.stop <= node.start:
            return (0, 0)
        return self.tokens[node.start].byte_start, self.tokens[node.stop - 1].byte_stop

    def text(self, node: Tree, _=None) -> str:
        return self._join(node, lambda leaf, t: t.value)

    def _own(self, leaf: Tree, t) -> list[dict] | None:
        return self.forms.get(leaf.start, leaf_forms(leaf, self.tokens))

    def normalized(self, node: Tree, _=None) -> str:
        line = self._phrase(node)
        return line if line is not None else self._join(node, lambda leaf, t: normalised_value(t.value, self._own(leaf, t)))

    @staticmethod
    def _phrase(node: Tree) -> str | None:
        while node.symbol is not None and node.line is None and len(node.children) == 1:
            node = node.children[0]
        return node.line

    def inflected(self, node: Tree, attribute) -> str:
        def value(leaf: Tree, t) -> str:
            forms = self._own(leaf, t)
            if not forms:
                return t.value.lower()
            ranked = sorted(forms, key=lambda f: f["lemma"] == t.value.lower())
            return inflect(ranked[0], attribute.grams, self.paradigms.get(ranked[0]["lemma_id"], []))

        return self._join(node, value)


def normalised_value(value: str, forms: list[dict] | None) -> str:
    if not forms:
        return value.lower()
    if value[:1].isupper():
        for f in forms:
            if "Surn" in f["grams"]:
                return f["lemma"]
    return forms[0]["lemma"]


def inflect(form: dict, grams, paradigm: list[dict]) -> str:
    """The paradigm's form with all the grammemes asked for that shares most others with the source; else the lemma."""
    wanted = set(grams)
    fitting = [p for p in paradigm if wanted <= set(p["grams"])]
    if not fitting:
        return form["lemma"]
    source = set(form["grams"])
    return min(fitting, key=lambda p: (-len(source & set(p["grams"])), p["rank"]))["form"]


@dataclass
class Match:
    tree: Tree
    tokens: list
    forms: dict
    paradigms: dict
    flat: bool = False

    @property
    def range(self) -> tuple[int, int]:
        return self.tree.start, self.tree.stop

    @property
    def span(self) -> tuple[int, int]:
        return self.tokens[self.tree.start].byte_start, self.tokens[self.tree.stop - 1].byte_stop

    @property
    def values(self) -> list[str]:
        return [t.value for t in self.tokens[self.tree.start : self.tree.stop]]

    @property
    def text(self) -> str:
        return Texts(self.tokens, self.forms, self.paradigms).text(self.tree)

    def facts(self) -> list[Record]:
        return Interpreter(Texts(self.tokens, self.forms, self.paradigms), self.flat).facts(self.tree)

    def fact(self) -> Record | None:
        """The record of the root, or of the first fact below it."""
        return next(iter(self.facts()), None)

    def extract(self, function):
        """Any value that a function reads off the tree."""
        return function(self.tree)

    def nodes(self, number: int) -> list[Tree]:
        return [t for t in self.tree.walk() if t.symbol is not None and t.symbol.number == number]


def matches(machine: Machine, verb: str, hits: list[int], tokens: list, paradigms: dict | None = None) -> list[Match]:
    """The matches of a verb: ``findall``, ``find``, ``match``, ``parse`` or ``extract``.

    findall: of each range the first derivation that agrees, then conflicts resolved; find: the first of these.
    match: the whole text, best tree by order. parse: best tree of any range, no resolution. extract: every tree.
    """
    everywhere = verb != "match"
    trees = machine.parse(hits, tokens, everywhere)
    out: list[Match] = []
    ranges: set[tuple[int, int]] = set()
    for tree in trees:
        if verb in ("findall", "find") and (tree.start, tree.stop) in ranges:
            continue
        forms = agreed(tree, tokens)
        if forms is not None:
            ranges.add((tree.start, tree.stop))
            out.append(Match(tree, tokens, forms, paradigms or {}, machine.flat))
    if verb == "extract":
        return out
    if verb in ("match", "parse"):
        return sorted(out, key=cmp_to_key(lambda a, b: compare(a.tree, b.tree)))[:1]
    kept = resolve_local([m.range for m in out])
    out = sorted((out[i] for i in kept), key=lambda m: m.range)
    return out[:1] if verb == "find" else out
