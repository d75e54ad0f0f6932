"""Grammars: quantifier nestings against their languages, printing, validation, lookahead."""

import itertools

import pytest

from spanloom.errors import GrammarError
from spanloom.functions.predicates import eq, in_, is_digit
from spanloom.operators.local import LocalParser
from spanloom.plans.grammar import Registry, compile_grammar, forward, main, or_, pred, rule, term

MOST = 7


def bnf(node):
    return compile_grammar(node).bnf()


# A quantified token stands for numbers of tokens: (may be empty, has no upper bound, lengths up to MOST).


def times(lengths, low, high):
    sums = {0}
    out = set()
    for k in range(1, high + 1):
        sums = {a + b for a in sums for b in lengths if a + b <= MOST}
        if k >= low:
            out |= sums
    return out


STEPS = {
    "optional": (lambda n: n.optional(), lambda e, u, ls: (True, u, ls)),
    "repeat": (lambda n: n.repeatable(), lambda e, u, ls: (e, True, times(ls, 1, MOST))),
    "repeat_reversed": (lambda n: n.repeatable(reverse=True), lambda e, u, ls: (e, True, times(ls, 1, MOST))),
    # a bound on what has no upper bound is lost
    "up_to_three": (lambda n: n.repeatable(high=3), lambda e, u, ls: (e, u, ls if u else times(ls, 1, 3))),
}


@pytest.mark.parametrize("names", [x for k in range(4) for x in itertools.product(STEPS, repeat=k)], ids="-".join)
def test_nested_quantifiers_stand_for_their_lengths(names):
    node, meaning = term("q"), (False, False, {1})
    for name in names:
        build, step = STEPS[name]
        node, meaning = build(node), step(*meaning)
    compiled = compile_grammar(node)
    assert compiled.root.nullable == meaning[0]
    parser = LocalParser(compiled)
    assert {n for n in range(1, MOST + 1) if parser.match("q " * n)} == meaning[2]
    assert len(bnf(node)) <= 1 + names.count("up_to_three") * 2 + (meaning[0] and 1)


@pytest.mark.parametrize("low, high", [(2, None), (3, None), (2, 2), (2, 4), (3, 5)])
def test_lower_bounds(low, high):
    parser = LocalParser(term("q").repeatable(low, high) if high else term("q").repeatable(low))
    assert [n for n in range(1, MOST + 1) if parser.match("q " * n)] == list(range(low, min(high or MOST, MOST) + 1))


def test_printed_rules():
    digits = pred(is_digit())
    dotted = rule([digits, rule([term("."), digits]).repeatable().optional()]).named("VERSION")
    assert bnf(dotted) == ["VERSION -> is_digit() R0", "R0 -> e | R1 R0 | '.' is_digit()", "R1 -> '.' is_digit()"]
    state = or_([pred(in_(["open", "shut"])), rule([term("half"), term("open")])]).named("STATE")
    assert bnf(rule([term("door"), state])) == ["R0 -> 'door' STATE", "STATE -> in_(...) | 'half' 'open'"]
    assert bnf(rule([state, term("or"), state])) == ["R0 -> R1 STATE", "R1 -> STATE 'or'", "STATE -> in_(...) | 'half' 'open'"]
    assert bnf(term("o'clock")) == ["R0 -> 'o\\'clock'"] and bnf(or_([rule([])])) == ["R0 -> e"]


def test_printed_recursion():
    nest = forward()
    nest.define(or_([term("egg"), rule([term("in"), nest])]).named("NEST"))
    assert bnf(nest) == ["NEST -> 'egg' | 'in' NEST"]
    parser = LocalParser(nest)
    assert parser.match("in in egg") and not parser.match("in in")


def test_errors():
    with pytest.raises(GrammarError):
        compile_grammar(forward())
    with pytest.raises(GrammarError):
        rule([main(term("q")), main(term("q"))])
    with pytest.raises(GrammarError):
        forward().define(forward())
    with pytest.raises(GrammarError):
        term("q").repeatable(5, 4)
    with pytest.raises(GrammarError):
        term("q").repeatable(0)
    registry = Registry()
    assert registry.add(term("q")) == 0 and len(registry) == 1 and registry.next_id() == 1 and 0 in registry and registry.get(7) is None
    endless = forward()
    endless.define(rule([term("q"), endless]))
    with pytest.raises(GrammarError):
        registry.add(endless)


def test_first_and_recursion():
    g = compile_grammar(rule([term("x").optional(), term("y").repeatable(), term("z")]))
    assert g.first() == [eq("x"), eq("y")] and g.is_recursive() and not g.is_recursive(beyond_repeats=True)
    assert not compile_grammar(rule([term("x"), term("x").repeatable(1, 4)])).is_recursive()
