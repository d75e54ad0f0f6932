"""Grammars: an immutable rule tree, its simplification, and the compiled form that all physical strategies share.

A rule is built with :func:`rule`, :func:`or_`, :func:`pred`, :func:`term` and the methods of :class:`Node`. Compiling
simplifies nested quantifiers, unfolds quantifiers into productions, drops chains, numbers the nonterminals and computes
which are nullable and which predicates can start them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from spanloom.errors import GrammarError
from spanloom.functions import predicates as p


class Node:
    """Base of rules; combinators return new nodes."""

    def __add__(self, other: Node) -> Node:
        if isinstance(self, Alternatives) and isinstance(other, Alternatives):
            return Alternatives(tuple(a + b for a in self.sequences for b in other.sequences))
        return Alternatives(((self, other),))

    def __or__(self, other: Node) -> Node:
        if isinstance(self, Alternatives) and isinstance(other, Alternatives) and not (self.head or other.head):
            return Alternatives(self.sequences + other.sequences)
        return Choice((self, other))

    def optional(self, reverse: bool = False) -> Node:
        return Optional(self, reverse)

    def repeatable(self, low: int | None = None, high: int | None = None, reverse: bool = False) -> Node:
        if (low or 1) < 1 or low == 0 or high is not None and high < (low or 1):
            raise GrammarError(f"bad bounds {low}, {high}")
        return Repeat(self, low, high, reverse)

    def named(self, name: str) -> Node:
        return Wrapper(self, "named", name)

    def fact(self, scheme) -> Node:
        """A fact boundary with a scheme (spanloom.operators.facts.Scheme)."""
        return Wrapper(self, "fact", scheme)

    def interpretation(self, what) -> Node:
        """Bind an attribute (or a whole fact scheme) to what the rule matches."""
        return Wrapper(self, "fact" if hasattr(what, "attributes") else "attribute", what)

    def match_relation(self, relation) -> Node:
        return Wrapper(self, "relation", relation)


@dataclass(frozen=True, eq=False)
class Terminal(Node):
    predicate: p.Predicate


@dataclass(frozen=True, eq=False)
class Alternatives(Node):
    """Sequences of rules, one a production; ``head`` is the head term's place in the first."""

    sequences: tuple[tuple[Node, ...], ...]
    head: int = 0


@dataclass(frozen=True, eq=False)
class Choice(Node):
    options: tuple[Node, ...]


@dataclass(frozen=True, eq=False)
class Empty(Node):
    pass


@dataclass(frozen=True, eq=False)
class Optional(Node):
    inner: Node
    reverse: bool = False


@dataclass(frozen=True, eq=False)
class Repeat(Node):
    inner: Node
    low: int | None = None
    high: int | None = None
    reverse: bool = False


@dataclass(frozen=True, eq=False)
class OptionalRepeat(Node):
    inner: Node
    reverse_repeat: bool = False
    reverse_optional: bool = False


@dataclass(frozen=True, eq=False)
class Wrapper(Node):
    inner: Node
    kind: str
    payload: object


@dataclass(frozen=True, eq=False)
class Main(Node):
    inner: Node


@dataclass(frozen=True, eq=False)
class Gazetteer(Node):
    """Phrases as a rule: ``mode`` is exact, caseless or morph; phrases keep their order and duplicates.

    ``keys``: per phrase, per position, the accepted values (exact or lower case) or lemmas.
    """

    name: str
    mode: str
    lines: tuple[str, ...]
    keys: tuple[tuple[tuple[str, ...], ...], ...]


class Forward(Node):
    """A rule that is defined later, for recursion."""

    def __init__(self):
        self.target: Node | None = None

    def define(self, node: Node) -> Forward:
        if isinstance(node, Forward):
            raise GrammarError("a forward rule cannot be defined as another forward rule")
        self.target = node
        return self


def pred(predicate: p.Predicate) -> Node:
    return Alternatives(((Terminal(predicate),),))


def term(value: str) -> Node:
    return pred(p.eq(value))


def empty() -> Node:
    return Empty()


def forward() -> Forward:
    return Forward()


def main(node: Node) -> Node:
    """Mark the head term of a sequence; by default it is the first."""
    return Main(node)


def rule(items) -> Node:
    """A sequence. Without a head mark, plain sequences are joined into one; with one, the items stay as they are."""
    items = list(items)
    if not items:
        return Empty()
    heads = [i for i, x in enumerate(items) if isinstance(x, Main)]
    if len(heads) > 1:
        raise GrammarError("more than one head term")
    if heads:
        return Alternatives((tuple(x.inner if isinstance(x, Main) else x for x in items),), heads[0])
    return reduce(lambda a, b: a + b, items)


def or_(items) -> Node:
    items = list(items)
    if not items:
        return Empty()
    return reduce(lambda a, b: a | b, items)


# simplification of nested quantifiers


def _is_plain_repeat(node: Node) -> bool:
    return isinstance(node, Repeat) and node.low is None and node.high is None


def simplify_quantifier(node: Node) -> Node:
    """One quantifier directly on another becomes one: (x+)? and (x?)+ are x*, (x+)+ is x+, bounds on an unbounded
    repeat are lost, and a bounded repeat of an optional is an optional bounded repeat."""
    while True:
        inner = getattr(node, "inner", None)
        if isinstance(node, Repeat) and not _is_plain_repeat(node):
            if _is_plain_repeat(inner) or isinstance(inner, OptionalRepeat):
                node = inner
            elif isinstance(inner, Optional):
                return Optional(replace(node, inner=inner.inner), inner.reverse)
            else:
                return node
        elif isinstance(node, Repeat):
            if isinstance(inner, Optional):
                node = OptionalRepeat(inner.inner, node.reverse, inner.reverse)
            elif isinstance(inner, OptionalRepeat):
                node = OptionalRepeat(inner.inner, node.reverse, inner.reverse_optional)
            elif isinstance(inner, Repeat):
                node = Repeat(inner.inner, reverse=node.reverse)
            else:
                return node
        elif isinstance(node, Optional):
            if _is_plain_repeat(inner):
                node = OptionalRepeat(inner.inner, inner.reverse, node.reverse)
            elif isinstance(inner, OptionalRepeat):
                node = OptionalRepeat(inner.inner, inner.reverse_repeat, node.reverse)
            elif isinstance(inner, Optional):
                node = Optional(inner.inner, node.reverse)
            else:
                return node
        elif isinstance(node, OptionalRepeat):
            if isinstance(inner, (Repeat, Optional, OptionalRepeat)):
                node = OptionalRepeat(inner.inner, node.reverse_repeat, node.reverse_optional)
            else:
                return node
        else:
            return node


# compiled grammars


@dataclass(eq=False)
class Symbol:
    """A nonterminal. ``wrapper``: (kind, payload) of a wrapper, whose single production is its inner rule."""

    productions: list[list[Symbol | p.Predicate]] = field(default_factory=list)
    heads: list[int] = field(default_factory=list)
    wrapper: tuple[str, object] | None = None
    gazetteer: Gazetteer | None = None
    number: int = -1
    nullable: bool = False


class Compiled:
    """A grammar's nonterminals in breadth-first order from the root, and its distinct predicates."""

    def __init__(self, node: Node):
        self._memo: dict[int, Symbol | p.Predicate] = {}
        self._keep: list[Node] = []  # ids in the memo stay valid while their nodes live
        self.source = node
        root = self._symbol(node)
        self.root = root if isinstance(root, Symbol) else Symbol([[root]], [0])
        self.symbols = self._ordered()
        self.predicates: list[p.Predicate] = []
        for s in self.symbols:
            for x in (x for production in s.productions for x in production):
                if not isinstance(x, Symbol) and x not in self.predicates:
                    self.predicates.append(x)
        self._find_nullable()

    # construction

    def _new(self, node: Node) -> Symbol:
        self._keep.append(node)
        self._memo[id(node)] = made = Symbol()
        return made

    def _symbol(self, node: Node) -> Symbol | p.Predicate:
        if id(node) in self._memo:
            return self._memo[id(node)]
        self._keep.append(node)
        if isinstance(node, Terminal):
            self._memo[id(node)] = node.predicate
            return node.predicate
        if isinstance(node, Main):
            return self._symbol(node.inner)
        if isinstance(node, Forward):
            if node.target is None:
                raise GrammarError("a forward rule is not defined")
            if id(node.target) in self._memo:
                return self._memo[id(node.target)]
            if isinstance(node.target, Alternatives) and len(node.target.sequences) == 1 and len(node.target.sequences[0]) == 1:
                made = self._new(node)
                self._set(made, [self._alone(node.target)])
                return made
            return self._symbol(node.target)
        if isinstance(node, Alternatives) and len(node.sequences) == 1 and len(node.sequences[0]) == 1:
            made = self._symbol(node.sequences[0][0])  # a chain
            self._memo[id(node)] = made
            return made
        simple = simplify_quantifier(node)
        made = self._new(node)
        if simple is not node:
            inner = self._symbol(simple)
            if isinstance(inner, Symbol):
                self._memo[id(node)] = inner
                return inner
            raise GrammarError("a quantifier without productions")
        if isinstance(node, Alternatives):
            productions = [self._alone(s[0]) if len(s) == 1 else [self._symbol(x) for x in s] for s in node.sequences]
            self._set(made, productions, node.head)
        elif isinstance(node, Choice):
            self._set(made, [self._alone(x) for x in node.options])
        elif isinstance(node, Empty):
            self._set(made, [[]])
        elif isinstance(node, Optional):
            self._set(made, self._swap([[], self._alone(node.inner)], node.reverse))
        elif isinstance(node, Repeat):
            self._repeat(made, node)
        elif isinstance(node, OptionalRepeat):
            more = self._swap([[self._symbol(node.inner), made], self._alone(node.inner)], node.reverse_repeat)
            self._set(made, [*more, []] if node.reverse_optional else [[], *more])
        elif isinstance(node, Wrapper):
            made.wrapper = (node.kind, node.payload)
            self._set(made, [[self._symbol(node.inner)]])
        elif isinstance(node, Gazetteer):
            made.gazetteer = node
            self._set(made, [])
        else:
            raise GrammarError(f"not a rule: {node!r}")
        return made

    @staticmethod
    def _swap(productions: list, reverse: bool) -> list:
        return productions[::-1] if reverse else productions

    def _set(self, made: Symbol, productions: list, head: int = 0) -> None:
        made.productions, made.heads = productions, [head] + [0] * (len(productions) - 1)

    def _alone(self, node: Node) -> list:
        """A production of the rule alone: the symbols of its single production, if it has no meaning of its own."""
        s = self._symbol(node)
        if isinstance(s, Symbol) and not s.wrapper and not s.gazetteer and len(s.productions) == 1 and len(s.productions[0]) > 1 and not s.heads[0]:
            return list(s.productions[0])
        return [s]

    def _repeat(self, made: Symbol, node: Repeat) -> None:
        item, alone = self._symbol(node.inner), self._alone(node.inner)
        low, high = node.low or 1, node.high
        if high is None and low == 1:
            self._set(made, self._swap([[item, made], alone], node.reverse))
            return
        tail = Symbol()
        if high is None:
            self._set(tail, self._swap([[item, tail], alone], node.reverse))
        else:
            tail = self._at_most(item, alone, high - low + 1, node.reverse)
        if low == 1:
            if isinstance(tail, Symbol):
                self._set(made, [list(x) for x in tail.productions])
            else:
                self._set(made, [[tail]])
        else:
            self._set(made, [[item] * (low - 1) + [tail]])

    def _at_most(self, item, alone: list, n: int, reverse: bool) -> Symbol | p.Predicate:
        if n == 1:
            return item
        made = Symbol()
        self._set(made, self._swap([[item, self._at_most(item, alone, n - 1, reverse)], alone], reverse))
        return made

    def _ordered(self) -> list[Symbol]:
        seen, queue = {id(self.root)}, [self.root]
        for s in queue:
            for x in (x for production in s.productions for x in production):
                if isinstance(x, Symbol) and id(x) not in seen:
                    seen.add(id(x))
                    queue.append(x)
        for i, s in enumerate(queue):
            s.number = i
        return queue

    def _find_nullable(self) -> None:
        changed = True
        while changed:
            changed = False
            for s in self.symbols:
                if not s.nullable and any(all(isinstance(x, Symbol) and x.nullable for x in production) for production in s.productions):
                    s.nullable = changed = True

    # properties

    def first(self) -> list[p.Predicate | Gazetteer]:
        """What a non-empty match can start with: the lookahead of the root."""
        seen, out = set(), []

        def visit(s: Symbol) -> None:
            if id(s) in seen:
                return
            seen.add(id(s))
            if s.gazetteer:
                out.append(s.gazetteer)
            for production in s.productions:
                for x in production:
                    if isinstance(x, Symbol):
                        visit(x)
                        if not x.nullable:
                            break
                    else:
                        if x not in out:
                            out.append(x)
                        break

        visit(self.root)
        return out

    def is_recursive(self, beyond_repeats: bool = False) -> bool:
        state: dict[int, int] = {}

        def visit(s: Symbol) -> bool:
            state[id(s)] = 1
            for production in s.productions:
                for i, x in enumerate(production):
                    if not isinstance(x, Symbol):
                        continue
                    if beyond_repeats and x is s and i == len(production) - 1:
                        continue
                    if state.get(id(x)) == 1 or id(x) not in state and visit(x):
                        return True
            state[id(s)] = 2
            return False

        return visit(self.root)

    def wrappers(self, kind: str) -> list:
        return [s.wrapper[1] for s in self.symbols if s.wrapper and s.wrapper[0] == kind]

    def validate(self) -> None:
        """Every rule has productions, and an empty production stands only where its rule may be empty on purpose."""
        for s in self.symbols:
            if not s.productions and not s.gazetteer:
                raise GrammarError("a rule without productions")
        productive: set[int] = set()
        while True:
            more = {s.number for s in self.symbols if s.gazetteer or any(all(not isinstance(x, Symbol) or x.number in productive for x in q) for q in s.productions)}
            if more == productive:
                break
            productive = more
        if 0 not in productive:
            raise GrammarError("the grammar cannot match anything")

    # printing

    def bnf(self) -> list[str]:
        """One line a rule, root first, in breadth-first order; rules without a name are R0, R1, ..."""
        parents: dict[int, int] = {}
        for s in self.symbols:
            for x in (x for production in s.productions for x in production):
                if isinstance(x, Symbol):
                    parents[id(x)] = parents.get(id(x), 0) + 1

        def shown(s: Symbol):
            while isinstance(s, Symbol) and s.wrapper and s.wrapper[0] in ("attribute", "relation"):
                s = s.productions[0][0]
            return s

        def name(s: Symbol) -> str | None:
            if s.gazetteer:
                return f"pipeline({s.gazetteer.name})"
            if s.wrapper and s.wrapper[0] in ("named", "fact"):
                return s.wrapper[1] if isinstance(s.wrapper[1], str) else s.wrapper[1].name
            return None

        def lines(s: Symbol) -> list[list]:
            if s.gazetteer:
                return [[p.Eq(w) for w in (k[0] for k in key)] for key in s.gazetteer.keys]
            if name(s):
                inner = shown(s.productions[0][0])
                if isinstance(inner, Symbol) and not name(inner) and parents.get(id(inner), 0) <= 1:
                    return [[shown(x) for x in q] for q in inner.productions]
                return [[inner]]
            return [[shown(x) for x in q] for q in s.productions]

        root = shown(self.root)
        if not isinstance(root, Symbol):
            root = Symbol([[root]], [0])
        queue, seen = [root], {id(root)}
        bodies = []
        for s in queue:
            bodies.append(lines(s))
            for x in (x for q in bodies[-1] for x in q):
                if isinstance(x, Symbol) and id(x) not in seen:
                    seen.add(id(x))
                    queue.append(x)
        names, count = {}, 0
        for s in queue:
            names[id(s)] = name(s)
            if names[id(s)] is None:
                names[id(s)] = f"R{count}"
                count += 1
        show = lambda x: names[id(x)] if isinstance(x, Symbol) else x.bnf()
        return [f"{names[id(s)]} -> " + " | ".join(" ".join(map(show, q)) or "e" for q in body) for s, body in zip(queue, bodies)]


def compile_grammar(node: Node) -> Compiled:
    return Compiled(node)


class Registry:
    """Top-level grammars by number."""

    def __init__(self):
        self._grammars: list[Compiled] = []

    def add(self, node: Node) -> int:
        compiled = compile_grammar(node)
        compiled.validate()
        self._grammars.append(compiled)
        return len(self._grammars) - 1

    def get(self, number: int) -> Compiled | None:
        return self._grammars[number] if 0 <= number < len(self._grammars) else None

    def next_id(self) -> int:
        return len(self._grammars)

    def __contains__(self, number: int) -> bool:
        return 0 <= number < len(self._grammars)

    def __len__(self) -> int:
        return len(self._grammars)
