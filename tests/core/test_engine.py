"""The DataFrame engine against the local parser, strategy against strategy; tokens, lexicon, sources, streams, SQL."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.errors import GrammarError, LexiconError, MorphError, TokenizerError
from spanloom.functions import predicates as P
from spanloom.functions import spans as S
from spanloom.functions.tokens import join_normalised, join_with_gaps, local_tokens, retokened, running, split_values, token_rows, tokens_span, with_tokens
from spanloom.functions.udtf import register_extract
from spanloom.operators.engine import Parser, facts_json, typed
from spanloom.operators.facts import fact
from spanloom.operators.gazetteer import caseless_pipeline, gazetteer_spans, morph_pipeline, phrase_table, pipeline
from spanloom.operators.local import LocalParser
from spanloom.operators.relations import agreeing, gender_relation, gnc_relation, number_relation
from spanloom.plans.grammar import forward, or_, pred, rule, term
from spanloom.sources import lexicon as lex
from spanloom.sources import texts
from spanloom.streaming.extract import each_batch, stream_facts, stream_matches

ODD = ["", " \t ", "ул. Мира, 7", "a b  c", "x@y.org, +1 (788) 555-29-42 http://a.b/c 3.14", "٣٤ ½ — é ü", "l1\r\n\nl2\n", "Ёж +79991234567 «q»", "naïve😀 x", "a-b.c-d.e7 A1 " * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None)]
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text").limit(40)
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(sample).cache()


def test_native_tokens_equal_local_ones(docs):
    for r in with_tokens(docs).collect():
        if r.text is None:
            assert r.tokens is None
            continue
        want = [(t.idx, t.value, t.token_type, t.byte_start, t.byte_stop, t.char_start, t.char_stop) for t in local_tokens(r.text)]
        assert [tuple(t)[:7] for t in r.tokens] == want
    got = {r.doc_id: r.v for r in docs.select("doc_id", split_values(F.col("text")).alias("v")).collect()}
    assert got[3] == ["a", "b", "c"] and got[99] is None and got[0] == []


def test_running_values_over_blocks(spark):
    n = 1000
    r = spark.range(1).select(running(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x % 7)).alias("s"), running(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (x * 37) % 501), F.greatest).alias("m")).first()
    total, most = 0, 0
    for i in range(n):
        total, most = total + (i + 1) % 7, max(most, (i + 1) * 37 % 501)
        assert (r.s[i], r.m[i]) == (total, most)


def test_predicates_native_equals_local(spark):
    values = ["a", "A", "Ab", "AB", "aB", "7", "-7", "+12", "99999999999999999999", "7a", "", "é", "É", "Éa", "a-b", "½", "ж", "Жук", ".", "abc", "1.5", "x" * 9]
    tests = [P.eq("a"), P.caseless("AB"), P.in_(["a", "7"]), P.in_([]), P.in_caseless(["AB"]), P.gte(7), P.lte(-7), P.is_title(), P.is_upper(), P.is_lower(), P.is_digit(), P.is_word(), P.is_non_alnum(), P.length_eq(2), P.is_token_type("Latin"), P.is_token_type("nonsense"), P.gram("NOUN"), P.normalized("Ab"), P.dictionary(["ab"]), P.tag("t"), P.eq("a") | P.is_upper(), P.is_word() & ~P.is_title(), P.and_(), P.or_()]
    forms = [None, [], [{"lemma": "ab", "grams": ["NOUN"], "lemma_id": 1, "form": "x"}]]
    from spanloom.functions.tokens import TOKEN, Token

    rows = [((0, v, "Latin", 0, 1, 0, 1, f, None),) for v in values for f in forms]
    df = spark.createDataFrame(rows, f"t {TOKEN}")
    for r in df.select("t", *[p.column(F.col("t")).alias(f"c{i}") for i, p in enumerate(tests)]).collect():
        local = Token(r.t.value, "Latin", 0, 1, 0, 1, None if r.t.forms is None else [f.asDict() for f in r.t.forms])
        for i, p in enumerate(tests):
            assert r[f"c{i}"] == p.test(local), (p.label(), r.t.value, r.t.forms)


def local_matches(grammar, rows, verb="findall", **kw):
    parser = LocalParser(grammar, **kw)
    return sorted((i, *m.range, *m.span, m.text, tuple(m.values)) for i, t in rows if t is not None for m in parser.run(verb, t))


def spark_matches(df):
    return sorted((r.doc_id, r.tok_start, r.tok_stop, r.byte_start, r.byte_stop, r.text, tuple(r["values"])) for r in df.collect())


latin, title, punct = pred(P.is_token_type("Latin")), pred(P.is_title()), pred(P.is_token_type("Punct"))
GRAMMARS = {
    "two": rule([title, pred(P.is_lower())]),
    "choice": or_([rule([latin, punct, latin]), rule([title, title]), title]),
    "optional": rule([title, punct.optional(), latin]),
    "bounded": pred(P.is_lower()).repeatable(2, 3),
    "run": title.repeatable(),
    "run_of_two": pred(P.is_lower()).repeatable(2),
    "inner_run": rule([title, pred(P.is_lower()).repeatable(), punct]),
}


@pytest.mark.parametrize("name", GRAMMARS)
def test_strategies_agree(docs, name):
    grammar = GRAMMARS[name]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = local_matches(grammar, rows)
    assert want
    engines = ["auto", "chart"] if name == "inner_run" else ["auto", "array", "chart"]
    for engine in [*engines, *(["relational"] if name in ("two", "optional", "run", "inner_run") else [])]:
        assert spark_matches(Parser(grammar, engine=engine).findall(docs)) == want, engine


def test_other_verbs(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    grammar = GRAMMARS["choice"]
    for engine in ("array", "chart"):
        parser = Parser(grammar, engine=engine)
        assert spark_matches(parser.find(docs)) == local_matches(grammar, rows, "find")
    parser = Parser(grammar)
    assert spark_matches(parser.parse(docs)) == local_matches(grammar, rows, "parse")
    assert spark_matches(parser.extract(docs)) == local_matches(grammar, rows, "extract")
    whole = or_([rule([latin, latin, latin]), rule([latin, punct.optional()])])
    for engine in ("array", "chart"):
        assert spark_matches(Parser(whole, engine=engine).match(docs)) == local_matches(whole, rows, "match")
    two = Parser(GRAMMARS["two"], engine="relational").extract(docs)
    assert spark_matches(two) == local_matches(GRAMMARS["two"], rows, "extract")
    assert parser.find_text(docs).columns == ["doc_id", "values"] and parser.findall_text(docs).columns == ["doc_id", "match_no", "values"]
    assert parser.chart(docs.filter("doc_id = 3")).count() == len(local_matches(grammar, [(3, ODD[3])], "extract"))
    with pytest.raises(GrammarError):
        Parser(grammar, engine="relational").match(docs)


def test_plans_without_python_or_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = Parser(GRAMMARS["choice"]).findall(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_recursive_grammar(spark):
    inner = forward()
    inner.define(or_([rule([term("("), term(")")]), rule([term("("), inner, term(")")]), rule([inner, inner])]))
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("()", k=14))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert spark_matches(Parser(inner).findall(df)) == local_matches(inner, rows)
    with pytest.raises(GrammarError):
        Parser(inner, engine="relational").findall(df).count()


def test_resolution_in_spark(spark):
    rng = random.Random(6)
    sets = {d: {(a := rng.randrange(9), rng.randrange(a + 1, 11)) for _ in range(rng.randint(1, 7))} for d in range(200)}
    df = spark.createDataFrame([(d, a, b) for d, s in sets.items() for a, b in s], "doc_id long, start int, stop int")
    got = sorted(map(tuple, S.resolve(df).collect()))
    want = sorted((d, *list(s)[i]) for d, s in sets.items() for i in S.resolve_local(list(s)))
    assert got == want


def test_span_algebra(spark):
    a, b = S.span(0, 3), S.span(3, 5)
    r = spark.range(1).select(S.length(a), S.is_empty(S.span(2, 2)), S.contains(a, F.lit(3)), S.overlaps(a, b), S.touches(a, b), S.merge(a, b), S.merge(a, S.span(4, 5))).first()
    assert tuple(r)[:5] == (3, True, False, False, True) and tuple(r[5]) == (0, 5) and r[6] is None


def test_facts_and_sinks(spark, docs):
    M = fact("Mail", ["address", ("kind", "string"), ("tags", "array<string>")])
    mail = rule([pred(P.is_token_type("Email")).interpretation(M.address), punct.interpretation(M.kind.const("mail"))]).interpretation(M)
    found = Parser(mail).facts(docs.filter("doc_id < 100"))
    r = typed(found, M).collect()
    assert [(x.doc_id, x.fields.address, x.fields.kind, x.fields.tags) for x in r] == [(4, "x@y.org", "mail", [])]
    local = LocalParser(mail).find(ODD[4]).fact()
    assert json.loads(facts_json(found).first().json) == json.loads(local.to_json())
    register_extract(spark, "extract_mail", mail)
    docs.createOrReplaceTempView("udtf_docs")
    rows = spark.sql("select d.doc_id, m.text, m.fields from udtf_docs d, lateral extract_mail(d.text) m where d.doc_id < 100").collect()
    assert [(x.doc_id, x.text) for x in rows] == [(4, "x@y.org,")]


def test_gazetteers(spark, docs):
    lines = ["a", "a b", "a b c", "ул", "a-b.c-d.e7 A1", "a b"]
    rows = [(r.doc_id, r.text) for r in docs.filter("doc_id < 100").collect()]
    for build, caseless in ((pipeline, False), (caseless_pipeline, True)):
        grammar = build([x.upper() for x in lines] if caseless else lines)
        assert spark_matches(Parser(grammar).findall(docs.filter("doc_id < 100"))) == local_matches(grammar, rows)
        phrases = phrase_table(spark.createDataFrame(list(enumerate(lines)), "phrase_id int, line string"), caseless=caseless)
        spans = gazetteer_spans(with_tokens(docs.filter("doc_id < 100")), phrases, caseless=caseless)
        want = {(i, *m.range, m.tree.line) for i, t in rows if t for m in LocalParser(build(lines)).extract(t)}
        assert {(r.doc_id, r.start, r.stop, r.line) for r in spans.collect()} == want


LEXICON = [
    ("lex", 0, 1, "lex", ["NOUN", "masc", "nomn", "sing"]), ("lexa", 1, 1, "lex", ["NOUN", "gent", "masc", "sing"]), ("lexi", 2, 1, "lex", ["NOUN", "masc", "nomn", "plur"]),
    ("novi", 0, 2, "novi", ["ADJF", "masc", "nomn", "sing"]), ("nova", 1, 2, "novi", ["ADJF", "femn", "nomn", "sing"]),
    ("mira", 0, 3, "mira", ["NOUN", "femn", "nomn", "sing"]), ("lexa", 0, 4, "lexov", ["NOUN", "Surn", "gent", "masc", "sing"]),
]


def test_lexicon(spark):
    table = spark.createDataFrame(LEXICON, lex.SCHEMA)
    forms = lex.lookup(table, ["lex", "LEXA", "lexi", "novi", "nova", "mira", "zzz"])
    assert [f["lemma"] for f in forms["lexa"]] == ["lex", "lexov"] and "zzz" not in forms
    assert lex.lemmas_of(table, ["Lexa", "zzz"]) == ["lex", "lexov", "zzz"]
    rows = [(1, "novi lex nova mira"), (2, "nova lex"), (3, "Lexa zzz 7"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kw = {"types": ("Latin",)}
    r = gnc_relation()
    grammars = [
        rule([pred(P.gram("ADJF")).match_relation(r), pred(P.gram("NOUN")).match_relation(r)]), pred(P.normalized("lex")), pred(P.dictionary(["lexov", "mira"])),
        morph_pipeline(["novi lex"], forms), pred(P.gram("NOUN")),
    ]
    for grammar in grammars:
        assert spark_matches(Parser(grammar, lexicon=table, **kw).findall(df)) == local_matches(grammar, rows, lexicon=forms, **kw)
    tokens = lex.with_forms(with_tokens(df), table, **kw)
    got = {r.doc_id: r for r in tokens.select("doc_id", "tokens", join_normalised(F.col("tokens")).alias("n"), join_with_gaps(F.col("tokens")).alias("t"), tokens_span(F.col("tokens")).alias("s")).collect()}
    assert got[3].n == "lexov zzz 7" and got[3].t == "Lexa zzz 7" and got[3].tokens[1].forms == [] and got[3].tokens[2].forms is None
    assert tuple(got[1].s) == (0, 18) and got[4].s is None and got[4].t == ""
    F_ = fact("F", ["x"])
    inflected = pred(P.normalized("lex")).interpretation(F_.x.inflected(["plur", "nomn"])).interpretation(F_)
    assert [x.fields.x for x in typed(Parser(inflected, lexicon=table, **kw).facts(df), F_).collect()] == ["lexi"] * 3
    words = spark.createDataFrame([("lexa",), ("nova",), ("mira",)], "word string")
    assert {x.word: x.inflected for x in lex.inflected_words(words, table, ("plur",)).collect()} == {"lexa": "lexi", "nova": "novi", "mira": "mira"}
    lex.check_gram("NOUN")
    with pytest.raises(MorphError):
        lex.check_gram("noun")
    assert lex.known_grams(["zz"]) is None and lex.known_grams(["zz", "sing"]) == ["sing"] and lex.grammemes(spark).count() == len(lex.CATEGORY)


def test_lexicon_from_xml(spark, tmp_path):
    xml = tmp_path / "d.xml"
    lemma = '<lemma id="{}"><l t="{}"><g v="NOUN"/><g v="masc"/></l><f t="{}"><g v="sing"/><g v="nomn"/></f><f t="{}"><g v="plur"/></f></lemma>'
    xml.write_text("<dictionary><lemmata>" + lemma.format(1, "Ёж", "Ёж", "ежи") + lemma.format(2, "дом", "дом", "дома") + "</lemmata></dictionary>")
    target = f"file://{tmp_path}/lexicon"
    assert not lex.has_lexicon(spark, target)
    with pytest.raises(LexiconError):
        lex.load_lexicon(spark, target)
    with pytest.raises(LexiconError):
        lex.prepare_lexicon(spark, f"file://{tmp_path}/none.xml", target)
    table = lex.prepare_lexicon(spark, f"file://{xml}", target)
    assert sorted(map(tuple, table.select("form", "rank", "lemma_id", "lemma").collect())) == [("дом", 0, 2, "дом"), ("дома", 1, 2, "дом"), ("ежи", 1, 1, "ёж"), ("ёж", 0, 1, "ёж")]
    assert table.filter("form = 'дома'").first().grams == ["NOUN", "masc", "plur"] and lex.prepare_lexicon(spark, "gone", target).count() == 4


def test_agreement_natively(spark):
    table = spark.createDataFrame(LEXICON, lex.SCHEMA)
    f = lambda w: F.expr("null") if w is None else F.array(*[F.struct(F.lit(x[3]).alias("lemma"), F.array(*map(F.lit, x[4])).alias("grams"), F.lit(x[2]).cast("long").alias("lemma_id"), F.lit(x[0]).alias("form")) for x in LEXICON if x[0] == w])
    assert table.count() == len(LEXICON)
    for relation in (gnc_relation(), gender_relation(), number_relation(), ~number_relation(), gender_relation() & number_relation(), gender_relation() | number_relation()):
        for a in ("lex", "lexa", "lexi", "novi", "nova", "mira"):
            for b in ("lex", "lexi", "novi", "nova"):
                x, y = agreeing(relation, f(a), f(b))
                r = spark.range(1).select(F.size(x).alias("x"), F.size(y).alias("y")).first()
                A, B = ([frozenset(z[4]) for z in LEXICON if z[0] == w] for w in (a, b))
                assert (r.x, r.y) == (sum(any(relation.test(p, q) for q in B) for p in A), sum(any(relation.test(p, q) for p in A) for q in B))


def test_taggers_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "salt; oil")], "doc_id long, text string")
    drop = lambda tokens: F.filter(tokens, lambda t: t["token_type"] != "Punct")
    pair = rule([term("salt"), term("oil")])
    assert [r.text for r in Parser(pair, tagger=drop).findall(df).collect()] == ["salt oil"] and Parser(pair).findall(df).count() == 0
    mark = lambda tokens: F.transform(tokens, lambda t: t.withField("tag", F.when(t["value"] == "oil", F.lit("W"))))
    assert [r.text for r in Parser(pred(P.tag("W")), tagger=mark).findall(df).collect()] == ["oil"]
    assert [t.idx for t in retokened(with_tokens(df), drop).first().tokens] == [0, 1]
    rows = token_rows(with_tokens(df), ["doc_id"]).select("doc_id", "idx", "value", "token_type", "byte_start", "byte_stop", "char_start", "char_stop")
    assert [r.text for r in Parser(rule([term(";"), term("oil")])).findall(texts.pretokenised(rows)).collect()] == ["; oil"]
    with pytest.raises(TokenizerError):
        texts.pretokenised(rows.drop("idx"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    assert sorted(r.text for r in texts.text_lines(spark, f"file://{tmp_path}/in").collect()) == ["one", "two"]
    assert [r.text for r in texts.text_files(spark, f"file://{tmp_path}/in").collect()] == ["one\ntwo\n"]
    assert texts.table(spark, "/root/testdata/sf0.001/pages.parquet", "page_id", "html").columns == ["doc_id", "text"]


def test_vector_plan_equals_local(spark, docs):
    """Every verb, facts of runs and of trees, more predicates than a word has bits, and a lexicon joined or in memory."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for grammar in GRAMMARS.values():
        for verb in ("findall", "find", "match", "parse", "extract"):
            if verb == "extract" and grammar is GRAMMARS["run_of_two"]:
                continue
            got = getattr(Parser(grammar, engine="vector"), verb)(docs)
            assert spark_matches(got) == local_matches(grammar, rows, verb), verb
    R = fact("R", [("all", "array<string>")])
    run = title.interpretation(R.all).repeatable(2).interpretation(R)
    found = Parser(run).facts(docs).collect()
    want = sorted((i, *m.range, m.fact().fields_json()) for i, t in rows if t for m in LocalParser(run).findall(t))
    assert sorted((r.doc_id, r.tok_start, r.tok_stop, r.fields) for r in found) == want and want
    many = or_([rule([pred(P.eq(f"w{i}")), latin]) for i in range(80)] + [rule([title, punct])])
    assert spark_matches(Parser(many, engine="vector").findall(docs)) == local_matches(many, rows)
    far = spark.createDataFrame([(1, "T " * 3000)], "doc_id long, text string")
    assert len(json.loads(Parser(run).facts(far).first().fields)["all"]) == 3000


def test_native_tokens_and_rows(docs):
    from spanloom.functions.tokens import ROW, tokenised

    fast = {(r.doc_id, t.idx): tuple(t)[:7] for r in with_tokens(docs).collect() for t in r.tokens or []}
    slow = {(r.doc_id, t.idx): tuple(t)[:7] for r in with_tokens(docs, native=True).collect() for t in r.tokens or []}
    rows = {(r.doc_id, r.idx): tuple(r[c] for c in ROW) for r in tokenised(docs, ["doc_id"]).collect()}
    assert fast == slow == rows and with_tokens(docs.filter("text is null"), native=True).first().tokens is None


def test_native_tokeniser_is_linear(spark):
    """Twice the text takes about twice the time, and a megabyte is no matter of minutes."""
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "lorem ipsum, dolor 12 " * n)], "doc_id long, text string")
        began = time.time()
        assert with_tokens(df, native=True).select(F.size("tokens")).first()[0] == n * 5
        return time.time() - began

    seconds(100)
    small, large = seconds(12_000), seconds(48_000)
    assert large < 30 and large < 10 * small + 5


def test_streams_equal_batches(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{source}/documents.parquet").select("doc_id", "text")
    (tmp_path / "in").mkdir()
    batch.write.parquet(f"file://{tmp_path}/in/d")
    stream = spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/in/d")
    parser = Parser(GRAMMARS["choice"])
    for name, out in (("m", stream_matches(stream, parser)), ("c", stream_matches(stream, Parser(GRAMMARS["choice"], engine="chart")))):
        q = out.writeStream.format("memory").queryName(f"stream_{name}").option("checkpointLocation", f"file://{tmp_path}/c{name}").start()
        q.processAllAvailable()
        q.stop()
        assert spark_matches(spark.table(f"stream_{name}")) == spark_matches(parser.findall(batch))
    T = fact("T", ["x"])
    facts = Parser(title.interpretation(T.x).interpretation(T))
    q = stream_facts(stream, facts).writeStream.format("memory").queryName("stream_f").option("checkpointLocation", f"file://{tmp_path}/cf").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stream_f").count() == facts.facts(batch).count()
    each_batch(stream, lambda b: Parser(GRAMMARS["two"], engine="relational").findall(b), f"file://{tmp_path}/out", f"file://{tmp_path}/cb").awaitTermination()
    assert spark_matches(spark.read.parquet(f"file://{tmp_path}/out").drop("batch")) == spark_matches(Parser(GRAMMARS["two"]).findall(batch))
