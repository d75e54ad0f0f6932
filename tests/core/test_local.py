"""The local parser: search verbs, resolution, gazetteers, agreement and facts on invented examples."""

import itertools
import json
import random

import pytest

from spanloom.errors import GrammarError
from spanloom.functions.predicates import caseless, eq, gram, is_title, is_token_type, normalized, not_, or_ as any_of
from spanloom.functions.spans import resolve_local
from spanloom.functions.tokens import local_tokens
from spanloom.operators.chart import inflect
from spanloom.operators.facts import fact
from spanloom.operators.gazetteer import caseless_pipeline, morph_pipeline, pipeline
from spanloom.operators.local import LocalParser
from spanloom.operators.relations import case_relation, gender_relation, gnc_relation, not_relation, number_relation
from spanloom.plans.grammar import empty, forward, main, or_, pred, rule, term


def words(grammar, text, **kw):
    return LocalParser(grammar, **kw).findall_text(text)


def test_tokens():
    got = local_tokens("ул. Мира, 7 x@y.org +1 (788) 555-29-42 a.b 3.14\n\r\né")
    assert [(t.value, t.token_type) for t in got[:5]] == [("ул", "Russian"), (".", "Punct"), ("Мира", "Russian"), (",", "Punct"), ("7", "Int")]
    types = [t.token_type for t in got]
    assert types[5:] == ["Email", "Phone", "Domain", "Int", "Punct", "Int", "EOL", "Other"]
    assert (got[2].byte_start, got[2].byte_stop) == (6, 14) and got[-2].value == "\n\r\n"


def test_verbs():
    ab = rule([term("a"), term("b")])
    assert words(ab, "b a b a a b b") == [["a", "b"], ["a", "b"]]
    p = LocalParser(ab)
    assert p.find("q a b a b").range == (1, 3) and p.match("a b").values == ["a", "b"] and p.match("a b c") is None and p.find("q") is None
    overlapping = or_([term("north"), rule([term("north"), term("west"), term("wind")])])
    assert words(overlapping, "north west wind, north west") == [["north", "west", "wind"], ["north"]]
    assert len(LocalParser(overlapping).extract("north west wind, north west")) == 3
    assert words(rule([pred(is_token_type("Latin"))] * 2), "a b c d") == [["c", "d"]]
    assert words(term("a").repeatable(high=2), "a a a a a") == [["a"] * 2] and words(term("a").repeatable(), "a a b a") == [["a", "a"], ["a"]]
    assert words(empty(), "a b") == [] and words(term("a").optional(), "b a") == [["a"]]


def test_shared_nullable_rule_matches_wherever_it_stands():
    x = term(".").optional()
    assert words(rule([x, x, term("b")]), "b") == [["b"]] and words(rule([x, x, term("b")]), ". . b") == [[".", ".", "b"]]


def test_recursion():
    inner = forward()
    inner.define(or_([rule([term("("), term(")")]), rule([term("("), inner, term(")")]), rule([inner, inner])]))
    assert words(inner, "( ( ) ( ) ) ) (") == [["(", "(", ")", "(", ")", ")"]]
    left = forward()
    left.define(or_([rule([left, term("+"), term("a")]), term("a")]))
    assert LocalParser(left).match("a + a + a").values == ["a", "+", "a", "+", "a"]


def test_resolution_against_all_small_sets():
    def slow(spans):
        """Record-setters in order, then those that the next one overlaps go."""
        order = sorted(set(spans), key=lambda s: (s[0], -s[1]))
        records = [s for i, s in enumerate(order) if all(s[1] > q[1] for q in order[:i])]
        return [s for i, s in enumerate(records) if i + 1 == len(records) or records[i + 1][0] >= s[1]]

    pool = [(a, b) for a in range(5) for b in range(a + 1, 6)]
    rng = random.Random(4)
    for _ in range(3000):
        spans = rng.sample(pool, rng.randint(0, 6))
        assert sorted(spans[i] for i in resolve_local(spans)) == sorted(slow(spans))
    assert [[(0, 3), (1, 4), (3, 6)][i] for i in resolve_local([(0, 3), (1, 4), (3, 6)])] == [(3, 6)]


def test_finds_what_brute_force_finds():
    """Ranges of random regular grammars against an enumeration of their words."""
    rng = random.Random(8)

    def make(depth):
        kind = rng.randrange(5) if depth else 0
        if kind == 0:
            c = rng.choice("ab")
            return term(c), {(c,)}
        x, X = make(depth - 1)
        if kind == 1:
            return x.optional(), X | {()}
        y, Y = make(depth - 1)
        if kind == 2:
            return or_([x, y]), X | Y
        if kind == 3:
            return x.repeatable(1, 2), X | {p + q for p in X for q in X}
        return rule([x, y]), {p + q for p in X for q in Y}

    for _ in range(60):
        grammar, language = make(3)
        parser = LocalParser(grammar)
        for text in itertools.islice(itertools.product("ab", repeat=5), 0, 32, 3):
            got = {m.range for m in parser.extract(" ".join(text))}
            want = {(i, j) for i in range(5) for j in range(i + 1, 6) if text[i:j] in language}
            assert got == want


FORMS = {}
PARADIGMS = {}
for n, (lemma, rows) in enumerate({
    "lex": [("lex", "NOUN masc sing nomn"), ("lexa", "NOUN masc sing gent"), ("lexi", "NOUN masc plur nomn")],
    "novi": [("novi", "ADJF masc sing nomn"), ("nova", "ADJF femn sing nomn"), ("nove", "ADJF plur nomn"), ("novoga", "ADJF masc sing gent")],
    "mira": [("mira", "NOUN femn sing nomn Name"), ("miru", "NOUN femn sing accs Name")],
    "lexov": [("lexa", "NOUN masc sing nomn Surn")],
}.items()):
    for rank, (form, grams) in enumerate(rows):
        entry = {"lemma": lemma, "grams": sorted(grams.split()), "lemma_id": n, "form": form, "rank": rank}
        FORMS.setdefault(form, []).append(entry)
        PARADIGMS.setdefault(n, []).append(entry)
KW = {"lexicon": FORMS, "types": ("Latin",), "paradigms": PARADIGMS}


def test_morphology():
    assert words(pred(gram("NOUN")), "nova mira", **KW) == [["mira"]]
    assert words(pred(normalized("LEX")), "lexa lexi x", **KW) == [["lexa"], ["lexi"]]
    assert inflect(FORMS["lexi"][0], ("sing", "gent"), PARADIGMS[0]) == "lexa" and inflect(FORMS["lexi"][0], ("datv",), PARADIGMS[0]) == "lex"


def test_relations():
    r = gnc_relation()
    pair = rule([pred(gram("ADJF")).match_relation(r), pred(gram("NOUN")).match_relation(r)])
    assert words(pair, "novi lex nova mira novi mira nove lexi novoga lexa", **KW) == [["novi", "lex"], ["nova", "mira"], ["nove", "lexi"], ["novoga", "lexa"]]
    two = rule([pred(gram("ADJF")).match_relation(gnc_relation()), pred(gram("NOUN")).match_relation(gnc_relation())])
    assert words(two, "novi mira", **KW) == [["novi", "mira"]]
    assert words(pred(is_token_type("Latin")).match_relation(r), "unknown", **KW) == []
    masc, femn, both, any_, plur = ({"masc", "sing"}, {"femn", "sing"}, {"ms-f", "sing"}, {"GNdr"}, {"femn", "plur"})
    g = gender_relation().test
    assert g(masc, masc) and not g(masc, femn) and g(both, femn) and g(any_, masc) and g(plur, {"masc", "plur"}) and not g(both, both)
    n = number_relation().test
    assert n({"Sgtm"}, {"sing"}) and not n({"Sgtm"}, {"Sgtm"}) and n({"Pltm"}, {"plur"}) and not n({"sing"}, {"plur"})
    c = case_relation().test
    assert c(set(), set()) and c({"nomn"}, {"Fixd"}) and not c({"nomn"}, {"gent"}) and c({"gen2"}, {"loc2"}) and not_relation(case_relation()).test({"nomn"}, {"gent"})


def test_head_stays_when_an_optional_is_absent():
    r = number_relation()
    item = rule([term("the").optional(), main(pred(gram("NOUN")))])
    pair = rule([item.match_relation(r), pred(gram("NOUN")).match_relation(r)])
    assert words(pair, "the lexi lexi", **KW) == [["the", "lexi", "lexi"]] and words(pair, "lexi lex", **KW) == [] and words(pair, "lexi lexi", **KW) == [["lexi", "lexi"]]


def test_gazetteers():
    g = pipeline(["of", "of the", "New York", "of"])
    assert words(g, "of the New York of new york") == [["of", "the"], ["New", "York"], ["of"]]
    assert words(caseless_pipeline(["new york"]), "NEW York") == [["NEW", "York"]]
    assert len(LocalParser(g).extract("of")) == 2
    F = fact("Place", ["name"])
    named = caseless_pipeline(["New York"]).interpretation(F.attribute("name").normalized()).interpretation(F)
    assert LocalParser(named).find("in new york").fact().as_json() == {"name": "New York"}
    m = morph_pipeline(["novi lex"], FORMS)
    assert words(m, "novoga lexa nova mira", **KW) == [["novoga", "lexa"]]


def test_facts():
    P = fact("Person", ["first", "last"])
    latin = pred(is_title())
    g = rule([latin.interpretation(P.first), latin.interpretation(P.last)]).interpretation(P)
    m = LocalParser(g).find("dr John Smith")
    assert m.fact().as_json() == {"first": "John", "last": "Smith"} and m.fact().spans == [(3, 7), (8, 13)]
    assert json.loads(m.fact().to_json()) == {"name": "Person", "fields": {"first": "John", "last": "Smith"}, "spans": [{"start": 3, "stop": 7}, {"start": 8, "stop": 13}]}
    assert str(m.fact()) == "Person(\n    first='John',\n    last='Smith'\n)"
    D = fact("D", [("n", "bigint"), ("kind", "string"), ("tags", "array<string>")])
    number = pred(is_token_type("Int")).interpretation(D.n.custom(int).custom(lambda x: x + 1))
    tag = pred(is_token_type("Latin")).interpretation(D.tags)
    day = rule([number, term("d").interpretation(D.kind.const("day")), tag.repeatable().optional()]).interpretation(D)
    assert LocalParser(day).find("4 d x y").fact().as_json() == {"n": 5, "kind": "day", "tags": ["x", "y"]}
    assert LocalParser(day).find("4 d").fact().as_json() == {"n": 5, "kind": "day", "tags": []}
    last = rule([latin.interpretation(P.first), latin.interpretation(P.first)]).interpretation(P)
    assert LocalParser(last).find("Aa Bb").fact().as_json() == {"first": "Bb"}
    stacked = latin.interpretation(P.first).interpretation(P.last).interpretation(P)
    assert LocalParser(stacked).find("Aa").fact().as_json() == {"last": "Aa"}
    loose = rule([term("b").interpretation(P.last), term("a").interpretation(P.first)]).named("Loose")
    assert list(LocalParser(loose).find("b a").fact().as_json().items()) == [("first", "a"), ("last", "b")]
    with pytest.raises(GrammarError):
        LocalParser(latin.interpretation(D.n).interpretation(P))
    with pytest.raises(GrammarError):
        fact("X", ["a", "a"])
    with pytest.raises(AttributeError):
        P.nothing
    assert P.with_parents("Thing").is_subclass_of("Thing") and P(first="x").as_json() == {"first": "x"}


def test_nested_and_alternative_facts():
    N = fact("Name", ["first", "last"])
    B = fact("Book", [("author", N.ddl()), ("title", "string")])
    name = rule([pred(is_title()).interpretation(N.first), pred(is_title()).interpretation(N.last)]).interpretation(N)
    book = rule([name.interpretation(B.author), term(":"), pred(caseless("dune")).interpretation(B.title.normalized())]).interpretation(B)
    m = LocalParser(book).find("Ann Lee : Dune")
    assert m.fact().as_json() == {"author": {"first": "Ann", "last": "Lee"}, "title": "dune"}
    assert [f.name for f in m.facts()] == ["Book", "Name"]
    either = or_([name, pred(eq("x")).interpretation(N.first).interpretation(N)])
    assert [m.fact().as_json() for m in LocalParser(either).findall("x Ann Lee")] == [{"first": "x"}, {"first": "Ann", "last": "Lee"}]
    pairs = rule([name.interpretation(B.author), name.interpretation(B.author)]).interpretation(B)
    assert LocalParser(pairs).find("A B C D").fact().as_json() == {"author": {"first": "C", "last": "D"}}


def test_inflected_fact():
    F = fact("F", ["what"])
    g = pred(gram("NOUN")).interpretation(F.what.inflected(["nomn", "sing"])).interpretation(F)
    assert LocalParser(g, **KW).find("lexi").fact().as_json() == {"what": "lex"}


def test_tagger_and_predicates():
    drop = lambda tokens: [t for t in tokens if t.token_type != "Punct"]
    assert words(rule([term("salt"), term("pepper"), term("oil")]), "salt; pepper - oil", tagger=drop) == [["salt", "pepper", "oil"]]
    assert words(pred(any_of(eq("a"), not_(is_token_type("Latin")))), "a b 1") == [["a"], ["1"]]


def test_match_prefers_the_least_tree():
    P = fact("P", ["x", "y"])
    a = rule([term("a").interpretation(P.x)]).interpretation(P)
    b = rule([term("a").interpretation(P.y)]).interpretation(P)
    assert LocalParser(or_([a, b])).match("a").fact().as_json() == {"x": "a"}
