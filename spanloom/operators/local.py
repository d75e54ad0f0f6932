"""A parser for single texts in plain Python: the engine's semantics without a session, for table functions and tests."""

from __future__ import annotations

from spanloom.functions.tokens import Token, local_tokens
from spanloom.operators.chart import Machine, Match, matches
from spanloom.operators.facts import check_fields
from spanloom.plans.grammar import Compiled, Node


class LocalParser:
    """``lexicon``: lower-case form -> list of forms (dicts with lemma, grams, lemma_id, form); ``types`` get them."""

    def __init__(self, grammar: Node | Compiled, lexicon: dict[str, list[dict]] | None = None, types=("Russian",), tagger=None, paradigms: dict | None = None):
        self.compiled = grammar if isinstance(grammar, Compiled) else Compiled(grammar)
        check_fields(self.compiled)
        self.machine = Machine(self.compiled)
        self.lexicon, self.types, self.tagger, self.paradigms = lexicon, types, tagger, paradigms or {}

    def tokens(self, text: str) -> list[Token]:
        tokens = local_tokens(text)
        if self.lexicon is not None:
            for t in tokens:
                if t.token_type in self.types:
                    t.forms = self.lexicon.get(t.value.lower(), [])
        return self.tagger(tokens) if self.tagger else tokens

    def run(self, verb: str, text: str | list[Token]) -> list[Match]:
        tokens = text if isinstance(text, list) else self.tokens(text)
        bits = [(p, 1 << i) for i, p in enumerate(self.compiled.predicates)]
        hits = [sum(b for p, b in bits if p.test(t)) for t in tokens]
        return matches(self.machine, verb, hits, tokens, self.paradigms)

    def findall(self, text) -> list[Match]:
        return self.run("findall", text)

    def find(self, text) -> Match | None:
        return next(iter(self.run("find", text)), None)

    def match(self, text) -> Match | None:
        return next(iter(self.run("match", text)), None)

    def parse(self, tokens) -> Match | None:
        return next(iter(self.run("parse", tokens)), None)

    def extract(self, text) -> list[Match]:
        return self.run("extract", text)

    def findall_text(self, text) -> list[list[str]]:
        return [m.values for m in self.findall(text)]
