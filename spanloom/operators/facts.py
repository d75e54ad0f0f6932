"""Facts: schemes, attributes and the projection of parse trees to records."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from spanloom.errors import GrammarError

DEFAULT_INFLECTION = ("nomn", "sing")


@dataclass(frozen=True)
class Attribute:
    """A field of a fact and how a match becomes its value.

    Steps run on the matched tokens: surface text by default, ``normalized``, ``inflected``, a constant, then custom
    functions. ``repeated`` fields collect a list.
    """

    fact: str
    name: str
    repeated: bool = False
    default: object = None
    mode: str = "text"
    grams: tuple[str, ...] = ()
    constant: object = None
    is_constant: bool = False
    functions: tuple[Callable, ...] = ()

    def normalized(self) -> Attribute:
        return replace(self, mode="normalized")

    def inflected(self, grams=DEFAULT_INFLECTION) -> Attribute:
        return replace(self, mode="inflected", grams=tuple(grams))

    def const(self, value) -> Attribute:
        return replace(self, constant=value, is_constant=True)

    def custom(self, function: Callable) -> Attribute:
        return replace(self, functions=(*self.functions, function))

    def repeatable(self) -> Attribute:
        return replace(self, repeated=True)


@dataclass(frozen=True)
class Scheme:
    """A named record type. ``fields``: (name, Spark type) in order; list types start as an empty list."""

    name: str
    fields: tuple[tuple[str, str], ...]
    parents: tuple[str, ...] = ()
    defaults: tuple[tuple[str, object], ...] = ()

    def __post_init__(self):
        names = [n for n, _ in self.fields]
        if len(set(names)) != len(names):
            raise GrammarError(f"{self.name} has an attribute twice")

    @property
    def attributes(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.fields)

    def __getattr__(self, name: str) -> Attribute:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.attribute(name)

    def attribute(self, name: str) -> Attribute:
        """A field's attribute; needed where a field is called like a member of Scheme."""
        types = dict(object.__getattribute__(self, "fields"))
        if name not in types:
            raise AttributeError(name)
        return Attribute(self.name, name, types[name].startswith("array"), dict(self.defaults).get(name))

    def with_parents(self, *names: str) -> Scheme:
        return replace(self, parents=names)

    def is_subclass_of(self, name: str) -> bool:
        return name == self.name or name in self.parents

    def ddl(self) -> str:
        return "struct<" + ",".join(f"{n}:{t}" for n, t in self.fields) + ">"

    def __call__(self, **values) -> Record:
        return Record.of(self, values)


def fact(name: str, fields, defaults: dict | None = None, parents=()) -> Scheme:
    """A scheme from names (strings by default) or (name, Spark type) pairs, with values of fields that no match sets."""
    unknown = set(defaults or {}) - {f if isinstance(f, str) else f[0] for f in fields}
    if unknown:
        raise GrammarError(f"{name} has no {', '.join(sorted(unknown))}")
    return Scheme(name, tuple((f, "string") if isinstance(f, str) else tuple(f) for f in fields), tuple(parents), tuple((defaults or {}).items()))


@dataclass
class Record:
    """Values of a fact in the order of its scheme, and the spans of its attributes."""

    name: str
    values: dict[str, object]
    spans: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, scheme: Scheme, values: dict, spans=()) -> Record:
        unknown = set(values) - set(scheme.attributes)
        if unknown:
            raise GrammarError(f"{scheme.name} has no {', '.join(sorted(unknown))}")
        defaults = dict(scheme.defaults)
        full = {n: values.get(n, defaults.get(n, [] if t.startswith("array") else None)) for n, t in scheme.fields}
        return cls(scheme.name, full, list(spans))

    def get(self, name: str):
        return self.values.get(name)

    def as_json(self) -> dict:
        """Set fields in order; unset ones are left out."""
        plain = lambda v: v.as_json() if isinstance(v, Record) else [plain(x) for x in v] if isinstance(v, list) else v
        return {k: plain(v) for k, v in self.values.items() if v is not None}

    def fields_json(self) -> str:
        return json.dumps(self.as_json(), ensure_ascii=False, default=lambda _: None)

    def to_json(self) -> str:
        spans = [{"start": a, "stop": b} for a, b in self.spans]
        return json.dumps({"name": self.name, "fields": self.as_json(), "spans": spans}, ensure_ascii=False, default=lambda _: None)

    def __str__(self) -> str:
        def show(value, indent: int) -> str:
            pad = "    " * (indent + 1)
            if isinstance(value, Record):
                return f"{value.name}(\n" + ",\n".join(f"{pad}{k}={show(v, indent + 1)}" for k, v in value.values.items()) + "\n" + "    " * indent + ")"
            if isinstance(value, list):
                return "[" + ", ".join(show(v, indent + 1) for v in value) + "]"
            return repr(value)

        return show(self, 0)


@dataclass
class _Found:
    """What a subtree contributes to the fact above it: values by field and spans of attributes."""

    values: dict[str, object] = field(default_factory=dict)
    spans: list[tuple[int, int]] = field(default_factory=list)
    facts: list[Record] = field(default_factory=list)

    def add(self, name: str, value: object, repeated: bool) -> None:
        """Lists grow if either side is one; otherwise the later value holds."""
        old = self.values.get(name)
        if repeated or isinstance(old, list) or isinstance(value, list):
            listed = lambda v: [] if v is None else list(v) if isinstance(v, list) else [v]
            if not isinstance(old, list):
                self.values[name] = old = listed(old)
            old.extend(listed(value))
        else:
            self.values[name] = value

    def merge(self, other: _Found) -> None:
        for name, value in other.values.items():
            self.add(name, value, False)
        self.spans += other.spans


def _record(name: str, scheme: Scheme | None, found: _Found) -> Record | None:
    spans = sorted(found.spans)
    spans = [s for i, s in enumerate(spans) if not i or s != spans[i - 1]]
    if scheme is None:
        return Record(name, dict(sorted(found.values.items())), spans)
    if set(found.values) - set(scheme.attributes):
        return None
    return Record.of(scheme, found.values, spans)


class Interpreter:
    """Reads facts off a tree. ``texts`` offers ``surface``, ``normalized`` and ``inflected`` of a tree node."""

    def __init__(self, texts, flat: bool = False):
        self.texts = texts
        self.flat = flat  # see flat_facts
        self.records: list[Record] = []

    def facts(self, tree) -> list[Record]:
        """Every fact of the tree, outer ones first."""
        self.records = []
        self._visit(tree)
        return self.records

    def _visit(self, node) -> _Found:
        kind, payload = node.symbol.wrapper if node.symbol and node.symbol.wrapper else (None, None)
        if kind in ("fact", "named"):
            place = len(self.records)
            inner = self._children(node)
            scheme = payload if kind == "fact" else None
            record = _record(payload if kind == "named" else payload.name, scheme, inner)
            if record is not None and (kind == "fact" or inner.values):
                self.records.insert(place, record)
                inner.facts = [record]
            return inner
        if kind == "attribute":
            place = len(self.records)
            inner = self._children(node)
            out = _Found()
            if payload.is_constant:
                value = payload.constant
            elif inner.facts and payload.mode == "text":
                value = inner.facts[-1] if len(inner.facts) == 1 else list(inner.facts)
            else:
                value = getattr(self.texts, payload.mode)(node, payload)
            for f in payload.functions:
                value = f(value)
            if not inner.facts:
                del self.records[place:]
            out.add(payload.name, value, payload.repeated)
            out.spans = [self.texts.span(node)]
            return out
        return self._children(node)

    def _children(self, node) -> _Found:
        out = _Found()
        todo = list(reversed(node.children))
        while todo:
            child = todo.pop()
            if child.symbol is None:
                continue
            if self.flat and child.symbol.wrapper is None:
                todo.extend(reversed(child.children))
                continue
            inner = self._visit(child)
            out.merge(inner)
            out.facts += inner.facts
        return out


def flat_facts(compiled) -> bool:
    """Whether values below plain rules can be collected in one list: so it is unless a field is both single and a list."""
    repeated: dict[str, bool] = {}
    for s in compiled.symbols:
        if s.wrapper and s.wrapper[0] == "attribute":
            a = s.wrapper[1]
            if repeated.setdefault(a.name, a.repeated) != a.repeated or not a.repeated and a.functions:
                return False
    return True


def check_fields(compiled) -> None:
    """Fail while compiling if an attribute below a scheme is not one of its fields."""
    for s in compiled.symbols:
        if s.wrapper and s.wrapper[0] == "fact":
            seen, todo = set(), [s.productions[0][0]]
            while todo:
                x = todo.pop()
                if id(x) in seen or not hasattr(x, "productions"):
                    continue
                seen.add(id(x))
                if x.wrapper and x.wrapper[0] == "attribute":
                    if x.wrapper[1].name not in s.wrapper[1].attributes:
                        raise GrammarError(f"{s.wrapper[1].name} has no {x.wrapper[1].name}")
                    continue
                todo += [y for q in x.productions for y in q]
