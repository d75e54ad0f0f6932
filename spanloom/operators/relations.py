"""Agreement between tokens: relations of two grammatical forms, natively and in plain Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cases of the mask, in bit order.
CASES = ["nomn", "gent", "datv", "accs", "ablt", "loct", "voct"]


def case_mask(grams) -> int:
    return sum(1 << i for i, c in enumerate(CASES) if c in grams)


@dataclass(frozen=True, eq=False)
class Relation:
    """``test`` takes two sets of grammemes; ``column`` two array<string> columns. Two relation objects are two groups."""

    name: str
    test: Callable[[frozenset, frozenset], bool]
    column: Callable[[Column, Column], Column]

    def __and__(self, other: Relation) -> Relation:
        return and_relation(self, other)

    def __or__(self, other: Relation) -> Relation:
        return or_relation(self, other)

    def __invert__(self) -> Relation:
        return not_relation(self)


def _gender(a, b) -> bool:
    if "plur" in a and "plur" in b or "GNdr" in a or "GNdr" in b:
        return True
    common = lambda g: "ms-f" in g or "Ms-f" in g
    if any(g in a and g in b for g in ("masc", "femn", "neut")):
        return True
    return common(a) and ("masc" in b or "femn" in b) or common(b) and ("masc" in a or "femn" in a)


def _number(a, b) -> bool:
    pairs = [("sing", "sing"), ("plur", "plur"), ("sing", "Sgtm"), ("Sgtm", "sing"), ("plur", "Pltm"), ("Pltm", "plur")]
    return any(x in a and y in b for x, y in pairs)


def _case(a, b) -> bool:
    return case_mask(a) == case_mask(b) or "Fixd" in a or "Fixd" in b


def _has(grams: Column, code: str) -> Column:
    return F.array_contains(grams, code)


def _gender_column(a: Column, b: Column) -> Column:
    common = lambda g: _has(g, "ms-f") | _has(g, "Ms-f")
    same = reduce(lambda x, y: x | y, [_has(a, g) & _has(b, g) for g in ("masc", "femn", "neut")])
    half = lambda x, y: common(x) & (_has(y, "masc") | _has(y, "femn"))
    return (_has(a, "plur") & _has(b, "plur")) | _has(a, "GNdr") | _has(b, "GNdr") | same | half(a, b) | half(b, a)


def _number_column(a: Column, b: Column) -> Column:
    pairs = [("sing", "sing"), ("plur", "plur"), ("sing", "Sgtm"), ("Sgtm", "sing"), ("plur", "Pltm"), ("Pltm", "plur")]
    return reduce(lambda x, y: x | y, [_has(a, x) & _has(b, y) for x, y in pairs])


def _case_column(a: Column, b: Column) -> Column:
    same = reduce(lambda x, y: x & y, [_has(a, c) == _has(b, c) for c in CASES])
    return same | _has(a, "Fixd") | _has(b, "Fixd")


def gender_relation() -> Relation:
    return Relation("gender", _gender, _gender_column)


def number_relation() -> Relation:
    return Relation("number", _number, _number_column)


def case_relation() -> Relation:
    return Relation("case", _case, _case_column)


def gnc_relation() -> Relation:
    return Relation("gnc", lambda a, b: _gender(a, b) and _number(a, b) and _case(a, b), lambda a, b: _gender_column(a, b) & _number_column(a, b) & _case_column(a, b))


def and_relation(*parts: Relation) -> Relation:
    return Relation("and", lambda a, b: all(r.test(a, b) for r in parts), lambda a, b: reduce(lambda x, y: x & y, [r.column(a, b) for r in parts], F.lit(True)))


def or_relation(*parts: Relation) -> Relation:
    return Relation("or", lambda a, b: any(r.test(a, b) for r in parts), lambda a, b: reduce(lambda x, y: x | y, [r.column(a, b) for r in parts], F.lit(False)))


def not_relation(part: Relation) -> Relation:
    return Relation("not", lambda a, b: not part.test(a, b), lambda a, b: ~part.column(a, b))


def agreeing(relation: Relation, left: Column, right: Column) -> tuple[Column, Column]:
    """Both form arrays narrowed to forms that agree with some form of the other; null forms give empty arrays."""
    left, right = F.coalesce(left, F.array().cast(left_type())), F.coalesce(right, F.array().cast(left_type()))
    a = F.filter(left, lambda f: F.exists(right, lambda g: relation.column(f["grams"], g["grams"])))
    b = F.filter(right, lambda g: F.exists(left, lambda f: relation.column(f["grams"], g["grams"])))
    return a, b


def left_type() -> str:
    from spanloom.functions.tokens import FORM

    return f"array<{FORM}>"


def narrow(relation: Relation, forms: list[list[dict] | None]) -> list[list[dict]] | None:
    """Forms of a group's heads narrowed pair by pair, in order; None if some head is left without forms."""
    forms = [list(f or ()) for f in forms]
    for i in range(len(forms)):
        for j in range(i + 1, len(forms)):
            a, b = forms[i], forms[j]
            ok = [[relation.test(frozenset(x["grams"]), frozenset(y["grams"])) for y in b] for x in a]
            forms[i] = [x for x, row in zip(a, ok) if any(row)]
            forms[j] = [y for k, y in enumerate(b) if any(row[k] for row in ok)]
            if not forms[i] or not forms[j]:
                return None
    return None if any(not f for f in forms) else forms
