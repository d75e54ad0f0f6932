"""Predicates on one token: each has a native Column form over a token struct, a plain Python form and a label."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_ as both
from operator import or_ as either

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.tokens import TOKEN_TYPES, Token

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class Predicate:
    def column(self, token: Column) -> Column:
        """Native test of a token struct; never null."""
        raise NotImplementedError

    def test(self, token: Token) -> bool:
        raise NotImplementedError

    def kept_forms(self, forms: list[dict] | None, token: Token) -> list[dict] | None:
        """The forms that the predicate narrows a token to; None if it does not narrow."""
        return None

    def label(self) -> str:
        raise NotImplementedError

    def bnf(self) -> str:
        return self.label()

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Eq(Predicate):
    value: str

    def column(self, token):
        return token["value"] == self.value

    def test(self, token):
        return token.value == self.value

    def label(self):
        return f"eq({self.value})"

    def bnf(self):
        return "'" + self.value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Caseless(Predicate):
    value: str

    def column(self, token):
        return F.lower(token["value"]) == self.value.lower()

    def test(self, token):
        return token.value.lower() == self.value.lower()

    def label(self):
        return f"caseless({self.value})"


@dataclass(frozen=True)
class In(Predicate):
    values: tuple[str, ...]

    def column(self, token):
        return token["value"].isin(*self.values) if self.values else F.lit(False)

    def test(self, token):
        return token.value in self.values

    def label(self):
        return "in_(...)"


@dataclass(frozen=True)
class InCaseless(Predicate):
    values: tuple[str, ...]

    def column(self, token):
        return F.lower(token["value"]).isin(*(v.lower() for v in self.values)) if self.values else F.lit(False)

    def test(self, token):
        return token.value.lower() in {v.lower() for v in self.values}

    def label(self):
        return "in_caseless(...)"


@dataclass(frozen=True)
class Compare(Predicate):
    """gte or lte on a value that reads as a 64-bit integer; other values fail."""

    name: str
    bound: int

    def column(self, token):
        number = F.when(token["value"].rlike(r"\A[+-]?[0-9]+\z"), token["value"].try_cast("bigint"))
        return F.coalesce(number >= self.bound if self.name == "gte" else number <= self.bound, F.lit(False))

    def test(self, token):
        v = token.value.removeprefix("+") if token.value[:1] == "+" else token.value.removeprefix("-")
        if not (v.isascii() and v.isdigit()) or not _LOW <= int(token.value) <= _HIGH:
            return False
        return int(token.value) >= self.bound if self.name == "gte" else int(token.value) <= self.bound

    def label(self):
        return f"{self.name}({self.bound})"


@dataclass(frozen=True)
class Shape(Predicate):
    """Tests of a value's characters by a full-match pattern, or by its negation."""

    name: str

    #: name -> (Java pattern, whether it must match)
    PATTERNS = {
        "is_title": (r"(?U)\A\p{IsUppercase}\p{IsLowercase}*\z", True),
        "is_upper": (r"(?U)\A\p{IsUppercase}*\z", True),
        "is_lower": (r"(?U)\A\p{IsLowercase}*\z", True),
        "is_digit": (r"\A[0-9]*\z", True),
        "is_word": (r"\A\p{IsAlphabetic}*\z", True),
        "is_non_alnum": (r"\A[\p{IsAlphabetic}\p{N}]*\z", False),
    }

    def column(self, token):
        pattern, wanted = self.PATTERNS[self.name]
        return token["value"].rlike(pattern) if wanted else ~token["value"].rlike(pattern)

    def test(self, token):
        v = token.value
        return {
            "is_title": lambda: v[:1].isupper() and all(c.islower() for c in v[1:]),
            "is_upper": lambda: all(c.isupper() for c in v),
            "is_lower": lambda: all(c.islower() for c in v),
            "is_digit": lambda: all(c in "0123456789" for c in v),
            "is_word": lambda: all(c.isalpha() for c in v),
            "is_non_alnum": lambda: not all(c.isalnum() for c in v),
        }[self.name]()

    def label(self):
        return f"{self.name}()"


@dataclass(frozen=True)
class LengthEq(Predicate):
    """Length in UTF-8 bytes."""

    length: int

    def column(self, token):
        return F.octet_length(token["value"]) == self.length

    def test(self, token):
        return len(token.value.encode()) == self.length

    def label(self):
        return f"length_eq({self.length})"


@dataclass(frozen=True)
class TypeIs(Predicate):
    name: str

    def column(self, token):
        return token["token_type"] == self.name

    def test(self, token):
        return token.token_type == self.name

    def label(self):
        return f"token_type_is({self.name})"


@dataclass(frozen=True)
class TagIs(Predicate):
    """The tag that a tagger set."""

    tag: str

    def column(self, token):
        return F.coalesce(token["tag"] == self.tag, F.lit(False))

    def test(self, token):
        return token.tag == self.tag

    def label(self):
        return f"tag({self.tag})"


@dataclass(frozen=True)
class Gram(Predicate):
    """Some form has the grammeme; false without forms."""

    code: str

    def column(self, token):
        return F.coalesce(F.exists(token["forms"], lambda f: F.array_contains(f["grams"], self.code)), F.lit(False))

    def test(self, token):
        return any(self.code in f["grams"] for f in token.forms or ())

    def kept_forms(self, forms, token):
        return None if forms is None else [f for f in forms if self.code in f["grams"]]

    def label(self):
        return f"gram({self.code})"


@dataclass(frozen=True)
class Normalized(Predicate):
    """Some form's lemma is the word; without forms the lower-case value is. An empty list of forms fails."""

    word: str

    def column(self, token):
        w = self.word.lower()
        return F.when(token["forms"].isNull(), F.lower(token["value"]) == w).otherwise(F.exists(token["forms"], lambda f: f["lemma"] == w))

    def test(self, token):
        w = self.word.lower()
        return token.value.lower() == w if token.forms is None else any(f["lemma"] == w for f in token.forms)

    def kept_forms(self, forms, token):
        return None if forms is None else [f for f in forms if f["lemma"] == self.word.lower()]

    def label(self):
        return f"normalized({self.word})"


@dataclass(frozen=True)
class Dictionary(Predicate):
    """The token is alphabetic and a lemma of it is among the lemmas of the words; without forms its lower-case value.

    ``lemmas`` are the words' lemmas: :func:`spanloom.sources.lexicon.lemmas_of` looks them up.
    """

    lemmas: tuple[str, ...]

    def column(self, token):
        word = token["value"].rlike(r"\A\p{IsAlphabetic}*\z")
        known = F.array(*[F.lit(x) for x in self.lemmas]).cast("array<string>")
        by_form = F.exists(token["forms"], lambda f: F.array_contains(known, f["lemma"]))
        return word & F.when(token["forms"].isNull(), F.array_contains(known, F.lower(token["value"]))).otherwise(by_form)

    def test(self, token):
        if not all(c.isalpha() for c in token.value):
            return False
        return token.value.lower() in self.lemmas if token.forms is None else any(f["lemma"] in self.lemmas for f in token.forms)

    def kept_forms(self, forms, token):
        return None if forms is None else [f for f in forms if f["lemma"] in self.lemmas]

    def label(self):
        return "dictionary(...)"


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def column(self, token):
        return reduce(both, (p.column(token) for p in self.parts), F.lit(True))

    def test(self, token):
        return all(p.test(token) for p in self.parts)

    def kept_forms(self, forms, token):
        narrowed = [x for p in self.parts if (x := p.kept_forms(forms, token)) is not None]
        return None if not narrowed else [f for f in narrowed[0] if all(f in x for x in narrowed[1:])]

    def label(self):
        return f"and({' & '.join(p.label() for p in self.parts)})"

    def bnf(self):
        return f"and({' & '.join(p.bnf() for p in self.parts)})"


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def column(self, token):
        return reduce(either, (p.column(token) for p in self.parts), F.lit(False))

    def test(self, token):
        return any(p.test(token) for p in self.parts)

    def kept_forms(self, forms, token):
        return next((p.kept_forms(forms, token) for p in self.parts if p.test(token)), None)

    def label(self):
        return f"or({' | '.join(p.label() for p in self.parts)})"

    def bnf(self):
        return f"or({' | '.join(p.bnf() for p in self.parts)})"


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def column(self, token):
        return ~self.part.column(token)

    def test(self, token):
        return not self.part.test(token)

    def label(self):
        return f"not({self.part.label()})"

    def bnf(self):
        return f"not({self.part.bnf()})"


def eq(value: str) -> Predicate:
    return Eq(value)


def caseless(value: str) -> Predicate:
    return Caseless(value)


def in_(values) -> Predicate:
    return In(tuple(values))


def in_caseless(values) -> Predicate:
    return InCaseless(tuple(values))


def gte(n: int) -> Predicate:
    return Compare("gte", n)


def lte(n: int) -> Predicate:
    return Compare("lte", n)


def normalized(word: str) -> Predicate:
    return Normalized(word)


def dictionary(lemmas) -> Predicate:
    return Dictionary(tuple(sorted(set(lemmas))))


def gram(code: str) -> Predicate:
    return Gram(code)


def is_title() -> Predicate:
    return Shape("is_title")


def is_upper() -> Predicate:
    return Shape("is_upper")


def is_lower() -> Predicate:
    return Shape("is_lower")


def is_digit() -> Predicate:
    return Shape("is_digit")


def is_word() -> Predicate:
    return Shape("is_word")


def is_non_alnum() -> Predicate:
    return Shape("is_non_alnum")


def length_eq(n: int) -> Predicate:
    return LengthEq(n)


def is_token_type(name: str) -> Predicate:
    """An unknown name means Other."""
    return TypeIs(name if name in TOKEN_TYPES else "Other")


def tag(name: str) -> Predicate:
    return TagIs(name)


def and_(*parts: Predicate) -> Predicate:
    return And(parts)


def or_(*parts: Predicate) -> Predicate:
    return Or(parts)


def not_(part: Predicate) -> Predicate:
    return Not(part)
