"""Registered queries over the driver's tables, one or more an operator, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import predicates as P
from spanloom.functions import spans as S
from spanloom.functions.tokens import ANY_TOKEN, PIECE, RULES, TOKEN, join_normalised, join_with_gaps, split_values, token_rows, tokenised, tokens_span, with_tokens
from spanloom.operators.engine import Parser, facts_json, typed
from spanloom.operators.facts import fact
from spanloom.operators.gazetteer import caseless_pipeline, gazetteer_spans, morph_pipeline, phrase_table, pipeline
from spanloom.operators.relations import Relation, gender_relation, gnc_relation, number_relation
from spanloom.plans.grammar import compile_grammar, forward, or_, pred, rule, term
from spanloom.sources import lexicon as lex
from spanloom.functions.udtf import register_extract
from spanloom.sources.texts import pretokenised, spread

latin, title, lower, punct = (pred(x) for x in (P.is_token_type("Latin"), P.is_title(), P.is_lower(), P.is_token_type("Punct")))
number, email, phone, domain = (pred(P.is_token_type(x)) for x in ("Int", "Email", "Phone", "Domain"))

#: An invented English lexicon: form, rank, lemma_id, lemma, grammemes.
LEXICON = [
    ("the", 0, 1, "the", ["ADJF", "GNdr", "plur", "sing"]), ("is", 0, 2, "be", ["VERB", "sing"]), ("are", 1, 2, "be", ["VERB", "plur"]), ("was", 2, 2, "be", ["VERB", "past", "sing"]),
    ("you", 0, 3, "you", ["NPRO", "plur"]), ("that", 0, 4, "that", ["ADJF", "sing"]), ("those", 1, 4, "that", ["ADJF", "plur"]), ("that", 0, 5, "that", ["CONJ"]),
    ("this", 0, 6, "this", ["ADJF", "sing"]), ("these", 1, 6, "this", ["ADJF", "plur"]), ("not", 0, 7, "not", ["PRCL"]), ("idiot", 0, 8, "idiot", ["NOUN", "masc", "sing"]),
    ("idiots", 1, 8, "idiot", ["NOUN", "masc", "plur"]), ("clown", 0, 9, "clown", ["NOUN", "masc", "sing"]), ("it", 0, 10, "it", ["NPRO", "neut", "sing"]), ("from", 0, 11, "from", ["PREP"]),
    ("have", 0, 12, "have", ["VERB", "plur"]), ("has", 1, 12, "have", ["VERB", "sing"]), ("had", 2, 12, "have", ["VERB", "past"]), ("for", 0, 13, "for", ["PREP"]),
]
PHRASES = ["the", "of the", "in the", "of", "is not", "re", "and the", "of", "for and", "to be"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def vector(grammar, **kw) -> Parser:
    """The plan of the registered queries unless they name another one."""
    return Parser(grammar, **{"engine": "vector", **kw})


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as short documents."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return spread(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))


def cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns letter for letter in Cyrillic."""
    return turns(spark, sf_dir).select("doc_id", F.translate("text", _LATIN, _CYRILLIC).alias("text"))


def lexicon(spark: SparkSession, script: bool = False) -> DataFrame:
    """The lexicon as a table; ``script``: in Cyrillic."""
    table = spark.createDataFrame(LEXICON, lex.SCHEMA)
    return table.withColumns({c: F.translate(c, _LATIN, _CYRILLIC) for c in ("form", "lemma")}) if script else table


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# SQL building blocks


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Letter for letter, so that the turns become text in the other script.
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "абцдефгхийклмнопярстувшыьзАБЦДЕФГХИЙКЛМНОПЯРСТУВШЫЬЗ"
_SOURCES = {
    "documents": "SELECT doc_id, text FROM documents",
    "turns": "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations",
    "pages": "SELECT page_id AS doc_id, html AS text FROM pages",
    "cyrillic": f"SELECT conv_id * 1000 + turn AS doc_id, translate(text, '{_LATIN}', '{_CYRILLIC}') AS text FROM conversations",
    "parts": "SELECT p_partkey AS doc_id, p_name AS text FROM part",
}
_TYPE = "CASE " + " ".join(f"WHEN regexp_full_match(value, {_q(p)}) THEN '{n}'" for n, p in RULES) + " END"


def _tokens(source: str) -> str:
    """CTEs up to tokens(doc_id, idx, value, token_type, byte_start, byte_stop, char_start, char_stop, gap)."""
    return f"""
    src AS ({_SOURCES[source]}),
    lists AS (SELECT doc_id, regexp_extract_all(text, {_q(PIECE)}) AS l FROM src),
    pieces AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) - 1 AS idx FROM lists),
    vals AS (SELECT doc_id, idx, piece, regexp_replace(piece, '^[ \\t\\v\\f]+', '') AS value FROM pieces),
    placed AS (SELECT *, sum(strlen(piece)) OVER w AS bs, sum(length(piece)) OVER w AS cs FROM vals WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
    tokens AS MATERIALIZED (SELECT doc_id, CAST(idx AS INT) AS idx, value, {_TYPE} AS token_type, CAST(bs - strlen(value) AS INT) AS byte_start, CAST(bs AS INT) AS byte_stop,
               CAST(cs - length(value) AS INT) AS char_start, CAST(cs AS INT) AS char_stop, strlen(piece) > strlen(value) AS gap FROM placed)"""


_TITLE, _LOWER = r"regexp_full_match({0}, '\p{{Lu}}\p{{Ll}}*')", r"regexp_full_match({0}, '\p{{Ll}}*')"


def _is(value: str, kind: str, token_type: str) -> str:
    return {"title": _TITLE.format(value), "lower": _LOWER.format(value)}.get(kind, f"{token_type} = '{kind}'")


def _sequence(*kinds: str) -> str:
    """Candidate spans of a sequence of token tests: the tests of the tokens that follow are read by lead."""
    tests = [_is("value", k, "token_type") for k in kinds]
    ahead = ", ".join(f"coalesce(lead({t}, {i}) OVER w, false) AS ok{i}" for i, t in enumerate(tests) if i) or "true AS ok"
    where = " AND ".join(["ok0", *[f"ok{i}" for i in range(1, len(kinds))]])
    return f"SELECT doc_id, idx AS start, idx + {len(kinds)} AS stop FROM (SELECT doc_id, idx, {tests[0]} AS ok0, {ahead} FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) WHERE {where}"


def _runs(kind: str, low: int = 1) -> str:
    islands = f"SELECT doc_id, idx, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM tokens t WHERE {_is('value', kind, 'token_type')}"
    return f"SELECT doc_id, min(idx) AS start, max(idx) + 1 AS stop FROM ({islands}) GROUP BY doc_id, island HAVING count(*) >= {low}"


_RESOLVED = """
    r1 AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM (SELECT DISTINCT doc_id, start, stop FROM cand)),
    r2 AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start, stop DESC) AS nxt FROM r1 WHERE furthest IS NULL OR stop > furthest),
    found AS (SELECT doc_id, start, stop FROM r2 WHERE nxt IS NULL OR nxt >= stop)"""
_SHOWN = """
    SELECT f.doc_id, f.start AS tok_start, f.stop AS tok_stop, min(t.byte_start) AS byte_start, max(t.byte_stop) AS byte_stop,
           string_agg(CASE WHEN t.idx > f.start AND t.gap THEN ' ' ELSE '' END || t.value, '' ORDER BY t.idx) AS text
    FROM found f JOIN tokens t ON t.doc_id = f.doc_id AND t.idx >= f.start AND t.idx < f.stop GROUP BY f.doc_id, f.start, f.stop"""


def _findall(source: str, candidates: str) -> str:
    return f"WITH {_tokens(source)}, cand AS ({candidates}), {_RESOLVED} {_SHOWN}"


def _spans(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "tok_start", "tok_stop", "byte_start", "byte_stop", "text")


# tokens

_COUNTS = f"WITH {_tokens('documents')} SELECT d.lang, t.token_type, count(*) AS n, sum(t.byte_stop - t.byte_start) AS bytes FROM tokens t JOIN documents d USING (doc_id) GROUP BY ALL"


@query("token_counts_by_type_lang", _COUNTS)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
    rows = tokenised(docs, ["lang"], ["token_type", "byte_start", "byte_stop"])
    return rows.groupBy("lang", "token_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("byte_stop") - F.col("byte_start")).alias("bytes"))


@query("token_spans", f"WITH {_tokens('turns')} SELECT doc_id, idx, value, token_type, byte_start, byte_stop, char_start, char_stop FROM tokens")
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(with_tokens(turns(spark, sf_dir)), ["doc_id"]).drop("forms", "tag")


@query("token_sums_documents", f"WITH {_tokens('documents')} SELECT doc_id, count(*) AS n, CAST(sum(byte_start) AS BIGINT) AS byte_starts, CAST(sum(byte_stop) AS BIGINT) AS byte_stops, CAST(sum(char_start) AS BIGINT) AS char_starts, CAST(sum(char_stop) AS BIGINT) AS char_stops, CAST(sum((idx + 1) * strlen(value)) AS BIGINT) AS lengths, string_agg(substr(token_type, 1, 1), '' ORDER BY idx) AS types FROM tokens GROUP BY doc_id")
def token_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every document, the longest ones included, in sums by document and the types in order."""
    rows = tokenised(documents(spark, sf_dir), ["doc_id"])
    total = lambda c: F.sum(c).cast("long")
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.substr("token_type", F.lit(1), F.lit(1)).alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), total("byte_start").alias("byte_starts"), total("byte_stop").alias("byte_stops"), total("char_start").alias("char_starts"), total("char_stop").alias("char_stops"),
        total((F.col("idx") + 1) * F.octet_length("value")).alias("lengths"), types.alias("types"),
    )


@query("token_spans_cyrillic", f"WITH {_tokens('cyrillic')} SELECT doc_id, idx, value, token_type, byte_start, byte_stop, char_start, char_stop FROM tokens")
def token_spans_cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bytes a letter: byte and character spans differ."""
    return tokenised(cyrillic(spark, sf_dir), ["doc_id"])


@query("token_split", f"SELECT doc_id, regexp_extract_all(text, {_q(ANY_TOKEN)}) AS words FROM ({_SOURCES['turns']})")
def token_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("doc_id", split_values(F.col("text")).alias("words"))


@query(
    "join_gap_space",
    f"WITH {_tokens('turns')} SELECT doc_id, string_agg(CASE WHEN idx > 0 AND gap THEN ' ' ELSE '' END || value, '' ORDER BY idx) AS joined, string_agg(CASE WHEN idx > 0 AND gap THEN ' ' ELSE '' END || lower(value), '' ORDER BY idx) AS normal, min(byte_start) AS start, max(byte_stop) AS stop FROM tokens GROUP BY doc_id",
)
def join_gap_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_tokens(turns(spark, sf_dir)).filter(F.size("tokens") > 0)
    span = tokens_span(F.col("tokens"))
    return docs.select("doc_id", join_with_gaps(F.col("tokens")).alias("joined"), join_normalised(F.col("tokens")).alias("normal"), span["start"].alias("start"), span["stop"].alias("stop"))


@query("token_first_span_algebra", f"""WITH {_tokens('turns')}, p AS (SELECT doc_id, byte_start AS s1, byte_stop AS e1, lead(byte_start) OVER w AS s2, lead(byte_stop) OVER w AS e2 FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
    SELECT doc_id, s1 AS start, e1 - s1 AS len, s1 < e2 AND s2 < e1 AS overlap, e1 = s2 OR e2 = s1 AS touch, CASE WHEN e1 = s2 THEN e2 ELSE -1 END AS merged_stop FROM p WHERE s2 IS NOT NULL""")
def span_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_tokens(turns(spark, sf_dir)).select("doc_id", F.inline(F.arrays_zip(F.col("tokens").alias("a"), F.slice("tokens", F.lit(2), F.greatest(F.size("tokens"), F.lit(1))).alias("b"))).alias("a", "b"))
    pairs = pairs.filter(F.col("b").isNotNull())
    a, b = S.span(F.col("a.byte_start"), F.col("a.byte_stop")), S.span(F.col("b.byte_start"), F.col("b.byte_stop"))
    return pairs.select("doc_id", a["start"].alias("start"), S.length(a).alias("len"), S.overlaps(a, b).alias("overlap"), S.touches(a, b).alias("touch"), F.coalesce(S.merge(a, b)["stop"], F.lit(-1)).alias("merged_stop"))


# predicates

_PREDICATES: dict[str, tuple[P.Predicate, str]] = {
    "eq": (P.eq("the"), "value = 'the'"),
    "caseless": (P.caseless("THE"), "lower(value) = 'the'"),
    "in_": (P.in_(["of", "Of"]), "value IN ('of', 'Of')"),
    "in_caseless": (P.in_caseless(["OF", "de"]), "lower(value) IN ('of', 'de')"),
    "gte": (P.gte(100), "CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN coalesce(try_cast(value AS BIGINT) >= 100, false) ELSE false END"),
    "lte": (P.lte(255), "CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN coalesce(try_cast(value AS BIGINT) <= 255, false) ELSE false END"),
    "is_title": (P.is_title(), _TITLE.format("value")),
    "is_upper": (P.is_upper(), r"regexp_full_match(value, '\p{Lu}*')"),
    "is_lower": (P.is_lower(), _LOWER.format("value")),
    "is_digit": (P.is_digit(), "regexp_full_match(value, '[0-9]*')"),
    "is_word": (P.is_word(), r"regexp_full_match(value, '\p{L}*')"),
    "is_non_alnum": (P.is_non_alnum(), r"NOT regexp_full_match(value, '[\p{L}\p{N}]*')"),
    "length_eq": (P.length_eq(2), "strlen(value) = 2"),
    "is_token_type": (P.is_token_type("Phone"), "token_type = 'Phone'"),
    "and_not": (P.is_title() & ~P.is_token_type("Latin"), _TITLE.format("value") + " AND token_type <> 'Latin'"),
    "or_": (P.eq(",") | P.eq("."), "value IN (',', '.')"),
    "normalized_plain": (P.normalized("The"), "lower(value) = 'the'"),
    "dictionary_plain": (P.dictionary(["the", "les"]), "lower(value) IN ('the', 'les')"),
    "gram_plain": (P.gram("NOUN"), "false"),
}
_PREDICATE_SQL = f"WITH {_tokens('documents')} SELECT token_type, " + ", ".join(f"count(*) FILTER (WHERE {sql}) AS {n}" for n, (_, sql) in _PREDICATES.items()) + " FROM tokens GROUP BY token_type"


@query("predicates", _PREDICATE_SQL)
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each type pass each predicate; predicates see each distinct token once."""
    words = tokenised(documents(spark, sf_dir), [], ["value", "token_type"]).groupBy("token_type", "value").agg(F.count(F.lit(1)).alias("n"))
    token = F.struct(*[F.col(c) if c in ("value", "token_type") else F.lit(None).alias(c) for c in ("idx", "value", "token_type", "byte_start", "byte_stop", "char_start", "char_stop", "forms", "tag")])
    rows = words.select("token_type", "n", token.cast(TOKEN).alias("t"))
    return rows.groupBy("token_type").agg(*[F.coalesce(F.sum(F.when(p.column(F.col("t")), F.col("n"))), F.lit(0)).alias(n) for n, (p, _) in _PREDICATES.items()])


# search verbs


def _search(name: str, grammar, candidates: str, source: str = "documents", **kw) -> None:
    read = {"documents": documents, "turns": turns, "pages": pages, "parts": parts, "cyrillic": cyrillic}[source]
    query(name, _findall(source, candidates))(lambda spark, sf_dir: _spans(vector(grammar, **kw).findall(read(spark, sf_dir))))


TWO = rule([title, lower])
_search("seq_two", TWO, _sequence("title", "lower"))
_search("seq_three_mixed", rule([latin, punct, title]), _sequence("Latin", "Punct", "title"))
_search("alt_two", or_([rule([title, punct]), rule([number, latin])]), _sequence("title", "Punct") + " UNION " + _sequence("Int", "Latin"))
_search("opt_middle", rule([title, punct.optional(), title]), _sequence("title", "title") + " UNION " + _sequence("title", "Punct", "title"))
_search("findall_array", TWO, _sequence("title", "lower"), engine="array")
_search("repeat_title", title.repeatable(2), _runs("title", 2))
_search("repeat_bounded_2_3", lower.repeatable(2, 3), _sequence("lower", "lower") + " UNION " + _sequence("lower", "lower", "lower"))
_search("findall_relational", TWO, _sequence("title", "lower"), "turns", engine="relational")
_search("findall_chart", rule([title, punct.optional(), title]), _sequence("title", "title") + " UNION " + _sequence("title", "Punct", "title"), "turns", engine="chart")
_search("findall_parts", rule([lower, lower]), _sequence("lower", "lower"), "parts")


_search("findall_cyrillic", TWO, _sequence("title", "lower"), "cyrillic")
_search("opt_repeat_between", rule([number, lower.repeatable().optional(), punct]), f"""SELECT doc_id, idx AS start, nxt + 1 AS stop FROM (SELECT doc_id, idx, token_type, min(CASE WHEN NOT {_is('value', 'lower', 'token_type')} THEN idx END) OVER w AS nxt,
    min(CASE WHEN token_type = 'Punct' THEN idx END) OVER w AS closing FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) WHERE token_type = 'Int' AND nxt = closing""")


class EndsWith(P.Predicate):
    """A predicate from outside of the library."""

    def __init__(self, ending: str):
        self.ending = ending

    def column(self, token: Column) -> Column:
        return token["value"].endswith(self.ending)

    def test(self, token) -> bool:
        return token.value.endswith(self.ending)

    def label(self) -> str:
        return f"ends_with({self.ending})"


@query("predicate_custom", f"WITH {_tokens('turns')}, found AS (SELECT doc_id, idx AS start, idx + 1 AS stop FROM tokens WHERE token_type = 'Latin' AND suffix(value, 'ing')) {_SHOWN}")
def predicate_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(vector(pred(EndsWith("ing") & P.is_token_type("Latin"))).findall(turns(spark, sf_dir)))


_NUMBERED = "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS match_no, start, stop FROM found"


@query("findall_text", f"WITH {_tokens('turns')}, cand AS ({_sequence('title', 'lower')}), {_RESOLVED}, numbered AS ({_NUMBERED}) SELECT f.doc_id, match_no, list(t.value ORDER BY t.idx) AS values FROM numbered f JOIN tokens t ON t.doc_id = f.doc_id AND t.idx >= f.start AND t.idx < f.stop GROUP BY f.doc_id, match_no")
def findall_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector(TWO).findall_text(turns(spark, sf_dir))


@query("find_text", f"WITH {_tokens('turns')}, cand AS ({_sequence('title', 'lower')}), {_RESOLVED}, numbered AS ({_NUMBERED}) SELECT f.doc_id, list(t.value ORDER BY t.idx) AS values FROM numbered f JOIN tokens t ON t.doc_id = f.doc_id AND t.idx >= f.start AND t.idx < f.stop WHERE match_no = 0 GROUP BY f.doc_id")
def find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector(TWO).find_text(turns(spark, sf_dir))


@query("findall_pretokenised", _findall("turns", _sequence("title", "lower")))
def findall_pretokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(vector(TWO).findall(pretokenised(tokenised(turns(spark, sf_dir), ["doc_id"]))))


@query("findall_own_tokenizer", f"""WITH src AS ({_SOURCES['turns']}), lists AS (SELECT doc_id, regexp_extract_all(text, '[^ ]+') AS l FROM src), tokens AS (SELECT doc_id, unnest(l) AS value, generate_subscripts(l, 1) - 1 AS idx FROM lists)
    SELECT doc_id, CAST(idx AS INT) AS tok_start, value AS text FROM tokens WHERE {_TITLE.format('value')}""")
def findall_own_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between spaces as the tokens."""

    def words(docs: DataFrame, text_col: str) -> DataFrame:
        none = [F.lit(None).alias(c) for c in ("byte_start", "byte_stop", "char_start", "char_stop", "forms", "tag")]
        token = lambda w, i: F.struct(i.alias("idx"), w.alias("value"), F.lit("Other").alias("token_type"), *[F.lit(0).alias(n) if k < 4 else none[k] for k, n in enumerate(("byte_start", "byte_stop", "char_start", "char_stop", "forms", "tag"))])
        return docs.withColumn("tokens", F.transform(F.regexp_extract_all(text_col, F.lit("[^ ]+"), F.lit(0)), token).cast(f"array<{TOKEN}>"))

    return vector(title, tokenizer=words).findall(turns(spark, sf_dir)).select("doc_id", "tok_start", "text")


@query("tree_nodes", f"""WITH {_tokens('turns')}, cand AS ({_sequence('title', 'lower')}), {_RESOLVED}, roots AS ({_SHOWN})
    SELECT doc_id, tok_start, tok_stop, 0 AS depth, 'R0' AS label, text FROM roots
    UNION ALL SELECT f.doc_id, t.idx, t.idx + 1, 1, CASE WHEN t.idx = f.start THEN 'is_title()' ELSE 'is_lower()' END, t.value FROM found f JOIN tokens t ON t.doc_id = f.doc_id AND t.idx >= f.start AND t.idx < f.stop""")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector(TWO).nodes(turns(spark, sf_dir)).select("doc_id", "tok_start", "tok_stop", "depth", "label", "text")


@query("chart_trees", f"WITH {_tokens('parts')}, cand AS ({_sequence('lower', 'lower')}) SELECT doc_id, '(0.0 ' || start || ' ' || (start + 1) || ')' AS tree FROM cand")
def chart_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector(rule([lower, lower])).chart(parts(spark, sf_dir))


@query("udtf_lateral", f"WITH {_tokens('parts')}, cand AS ({_sequence('lower', 'lower')}), {_RESOLVED}, shown AS ({_SHOWN}) SELECT doc_id, byte_start, byte_stop, text FROM shown")
def udtf_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_extract(spark, "two_words", rule([lower, lower]))
    parts(spark, sf_dir).createOrReplaceTempView("two_words_parts")
    return spark.sql("SELECT p.doc_id, m.byte_start, m.byte_stop, m.text FROM two_words_parts p, LATERAL two_words(p.text) m")


@query("find_first", f"WITH {_tokens('turns')}, cand AS ({_sequence('title', 'lower')}), {_RESOLVED.replace('found AS (SELECT', 'every AS (SELECT')}, found AS (SELECT doc_id, start, stop FROM every QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start) = 1) {_SHOWN}")
def find_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(vector(TWO).find(turns(spark, sf_dir)))


@query("match_whole", f"WITH {_tokens('parts')}, sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id), cand AS ({_sequence('lower', 'lower')}), found AS (SELECT c.* FROM cand c JOIN sizes s USING (doc_id) WHERE start = 0 AND stop = n) {_SHOWN}")
def match_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(vector(rule([lower, lower])).match(parts(spark, sf_dir)))


@query("extract_all_overlapping", f"WITH {_tokens('turns')}, found AS ({_sequence('Latin', 'Latin')} UNION ALL {_sequence('Latin', 'Latin', 'Latin')}) {_SHOWN}")
def extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(vector(latin.repeatable(2, 3)).extract(turns(spark, sf_dir)))


@query("parse_first_tree", f"WITH {_tokens('turns')}, cand AS ({_sequence('title', 'lower')} UNION {_sequence('title')}), found AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start, stop DESC) = 1) {_SHOWN}")
def parse_first_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(vector(or_([TWO, title])).parse(turns(spark, sf_dir)))


@query("recursive_brackets")
def recursive_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced brackets with anything inside: recursion, so no SQL; tests hold it against the local parser."""
    inside, item = forward(), forward()
    item.define(or_([pred(~P.in_(["<", ">"])), rule([term("<"), inside, term(">")])]))
    inside.define(item.repeatable())
    return _spans(vector(rule([term("<"), inside, term(">")])).findall(pages(spark, sf_dir)))


# gazetteers

_PHRASE_ROWS = ", ".join(f"({i}, {_q(x)})" for i, x in enumerate(PHRASES))


def _phrase_spans(caseless: bool) -> str:
    fold = "lower({})" if caseless else "{}"
    return f"""
    ph AS (SELECT phrase_id, line, string_split(line, ' ') AS words FROM (VALUES {_PHRASE_ROWS}) v(phrase_id, line)),
    pairs AS (SELECT doc_id, idx, {fold.format('value')} AS v, lead({fold.format('value')}) OVER (PARTITION BY doc_id ORDER BY idx) AS w FROM tokens),
    hits AS (SELECT doc_id, idx AS start, idx + len(words) AS stop, phrase_id, line FROM pairs JOIN ph ON v = words[1] WHERE len(words) = 1 OR w = words[2])"""


@query("gaz_exact_spans", f"WITH {_tokens('documents')}, {_phrase_spans(False)} SELECT doc_id, start, stop, phrase_id, line FROM hits")
def gaz_exact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = phrase_table(spark.createDataFrame(list(enumerate(PHRASES)), "phrase_id int, line string"))
    return gazetteer_spans(with_tokens(documents(spark, sf_dir)), phrases).select("doc_id", "start", "stop", "phrase_id", "line")


@query("gaz_caseless_longest", f"WITH {_tokens('turns')}, {_phrase_spans(True)}, cand AS (SELECT doc_id, start, stop FROM hits), {_RESOLVED} {_SHOWN}")
def gaz_caseless_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(vector(caseless_pipeline(PHRASES)).findall(turns(spark, sf_dir)))


@query("gaz_canonical_value", f"WITH {_tokens('turns')}, {_phrase_spans(False)}, cand AS (SELECT doc_id, start, stop FROM hits), {_RESOLVED} SELECT DISTINCT f.doc_id, f.start AS tok_start, h.line AS value FROM found f JOIN hits h USING (doc_id, start, stop)")
def gaz_canonical_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    V = fact("Phrase", ["value"])
    parser = vector(pipeline(PHRASES).interpretation(V.value.normalized()).interpretation(V))
    return typed(parser.facts(turns(spark, sf_dir)), V).select("doc_id", "tok_start", "fields.value")


# facts

M, C, W, N, O = fact("Contact", ["address", "kind"]), fact("Call", ["number"]), fact("Words", [("words", "array<string>")]), fact("Amount", [("n", "bigint")]), fact("Pair", [("left", "struct<n:bigint>"), ("word", "string")])


def _contact():
    return or_([email.interpretation(M.address), domain.interpretation(M.address)]).interpretation(M)


@query("fact_contact", f"WITH {_tokens('documents')} SELECT doc_id, value AS address, [struct_pack(start := byte_start, stop := byte_stop)] AS spans FROM tokens WHERE token_type IN ('Email', 'Domain')")
def fact_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(vector(_contact()).facts(documents(spark, sf_dir)), M).select("doc_id", "fields.address", "spans")


@query("fact_domain_pages", f"WITH {_tokens('pages')} SELECT doc_id, value AS address FROM tokens WHERE token_type IN ('Email', 'Domain')")
def fact_domain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(vector(_contact()).facts(pages(spark, sf_dir)), M).select("doc_id", "fields.address")


@query("fact_const_kind", f"WITH {_tokens('documents')} SELECT doc_id, value AS number, '{{\"number\": \"' || value || '\"}}' AS fields FROM tokens WHERE token_type = 'Phone'")
def fact_const_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector(phone.interpretation(C.number).interpretation(C)).facts(documents(spark, sf_dir))
    return found.select("doc_id", F.get_json_object("fields", "$.number").alias("number"), "fields")


@query("fact_stacked_const", f"WITH {_tokens('documents')} SELECT doc_id, CAST(NULL AS VARCHAR) AS address, lower(token_type) AS kind FROM tokens WHERE token_type IN ('Email', 'Phone')")
def fact_stacked_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant as a field; of two fields stacked on one token the inner one is discarded."""
    kinds = [x.interpretation(M.address).interpretation(M.kind.const(k)) for x, k in ((email, "email"), (phone, "phone"))]
    return typed(vector(or_(kinds).interpretation(M)).facts(documents(spark, sf_dir)), M).select("doc_id", "fields.address", "fields.kind")


_PAIR_OF = "pairs AS (SELECT doc_id, idx, value, lead(value) OVER (PARTITION BY doc_id ORDER BY idx) AS word FROM tokens)"


@query("fact_field_twice", f"WITH {_tokens('documents')}, cand AS ({_sequence('title', 'title')}), {_RESOLVED}, {_PAIR_OF} SELECT f.doc_id, f.start AS tok_start, p.word, 'none' AS address FROM found f JOIN pairs p ON p.doc_id = f.doc_id AND p.idx = f.start")
def fact_field_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single field that is set twice keeps the later value; one that is never set has its default."""
    T = fact("Twice", ["word", "address"], {"address": "none"})
    grammar = rule([title.interpretation(T.word), title.interpretation(T.word)]).interpretation(T)
    return typed(vector(grammar).facts(documents(spark, sf_dir)), T).select("doc_id", "tok_start", "fields.word", "fields.address")


@query("fact_named", f"WITH {_tokens('documents')}, cand AS ({_sequence('Int', 'Latin')}), {_RESOLVED}, {_PAIR_OF} SELECT f.doc_id, f.start AS tok_start, 'Size' AS name, p.word AS unit FROM found f JOIN pairs p ON p.doc_id = f.doc_id AND p.idx = f.start")
def fact_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's name stands for a fact without a scheme."""
    U = fact("Unit", ["unit"])
    found = vector(rule([number, latin.interpretation(U.unit)]).named("Size")).facts(documents(spark, sf_dir))
    return found.select("doc_id", "tok_start", "name", F.get_json_object("fields", "$.unit").alias("unit"))


@query("fact_repeatable_words", f"WITH {_tokens('documents')}, found AS ({_runs('title', 2)}) SELECT f.doc_id, f.start AS tok_start, list(t.value ORDER BY t.idx) AS words FROM found f JOIN tokens t ON t.doc_id = f.doc_id AND t.idx >= f.start AND t.idx < f.stop GROUP BY f.doc_id, f.start")
def fact_repeatable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parser = vector(title.interpretation(W.words).repeatable(2).interpretation(W))
    return typed(parser.facts(documents(spark, sf_dir)), W).select("doc_id", "tok_start", "fields.words")


@query("fact_custom_int", f"WITH {_tokens('documents')} SELECT doc_id, CASE WHEN try_cast(value AS HUGEINT) < 4611686018427387904 THEN CAST(value AS BIGINT) * 2 END AS n FROM tokens WHERE token_type = 'Int'")
def fact_custom_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every integer, doubled; null where the double is beyond a bigint."""
    grammar = number.interpretation(N.n.custom(int).custom(lambda x: x * 2 if x < 1 << 62 else None)).interpretation(N)
    return typed(vector(grammar).facts(documents(spark, sf_dir)), N).select("doc_id", "fields.n")


@query("fact_nested_struct", f"WITH {_tokens('documents')}, cand AS ({_sequence('Int', 'Latin')}), {_RESOLVED}, pairs AS (SELECT doc_id, idx, value, lead(value) OVER (PARTITION BY doc_id ORDER BY idx) AS word FROM tokens) SELECT f.doc_id, CAST(p.value AS BIGINT) AS n, p.word FROM found f JOIN pairs p ON p.doc_id = f.doc_id AND p.idx = f.start")
def fact_nested_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = number.interpretation(N.n.custom(int)).interpretation(N)
    grammar = rule([left.interpretation(O.left), latin.interpretation(O.word)]).interpretation(O)
    return typed(vector(grammar).facts(documents(spark, sf_dir)), O).select("doc_id", F.col("fields.left.n").alias("n"), "fields.word")


@query("fact_json", f"WITH {_tokens('documents')} SELECT doc_id, '{{\"name\":\"Call\",\"fields\":{{\"number\": \"' || value || '\"}},\"spans\":[{{\"start\":' || byte_start || ',\"stop\":' || byte_stop || '}}]}}' AS json FROM tokens WHERE token_type = 'Phone'")
def fact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_json(vector(phone.interpretation(C.number).interpretation(C)).facts(documents(spark, sf_dir)))


@query("tagger_drop_punct", f"""WITH {_tokens('turns').replace('tokens AS MATERIALIZED (', 'all_tokens AS MATERIALIZED (')},
    tokens AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INT) AS idx, value, token_type, byte_start, byte_stop, byte_start > lag(byte_stop) OVER (PARTITION BY doc_id ORDER BY idx) AS gap FROM all_tokens WHERE token_type <> 'Punct'),
    cand AS ({_sequence('lower', 'title')}), {_RESOLVED} {_SHOWN}""")
def tagger_drop_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    drop: Callable[[Column], Column] = lambda tokens: F.filter(tokens, lambda t: t["token_type"] != "Punct")
    return _spans(vector(rule([lower, title]), tagger=drop).findall(turns(spark, sf_dir)))


# morphology

_LEX_ROWS = ", ".join(f"({_q(f)}, {r}, {i}, {_q(x)}, [{', '.join(map(_q, grams))}])" for f, r, i, x, grams in LEXICON)
_LEX = f"lex AS (SELECT * FROM (VALUES {_LEX_ROWS}) v(form, rank, lemma_id, lemma, grams)), forms AS (SELECT t.doc_id, t.idx, l.* FROM tokens t JOIN lex l ON lower(t.value) = l.form WHERE t.token_type = 'Latin')"
LATIN = {"types": ("Latin",)}


def _morph(name: str, predicate: P.Predicate, sql: str) -> None:
    query(name, f"WITH {_tokens('turns')}, {_LEX}, found AS (SELECT t.doc_id, t.idx AS start, t.idx + 1 AS stop FROM tokens t WHERE {sql}) {_SHOWN}")(
        lambda spark, sf_dir: _spans(vector(pred(predicate), lexicon=lexicon(spark), **LATIN).findall(turns(spark, sf_dir)))
    )


_FORM_OF = "EXISTS (SELECT 1 FROM forms f WHERE f.doc_id = t.doc_id AND f.idx = t.idx AND {})"
_morph("lex_gram", P.gram("plur"), _FORM_OF.format("list_contains(f.grams, 'plur')"))
_morph("lex_normalized", P.normalized("be"), _FORM_OF.format("f.lemma = 'be'") + " OR t.token_type <> 'Latin' AND lower(t.value) = 'be'")
_morph("lex_dictionary", P.dictionary(["be", "have", "idiot"]), _FORM_OF.format("f.lemma IN ('be', 'have', 'idiot')"))


@query("lex_gaz_morph", f"WITH {_tokens('turns')}, {_LEX}, cand AS (SELECT t.doc_id, t.idx AS start, t.idx + 2 AS stop FROM tokens t JOIN tokens u ON u.doc_id = t.doc_id AND u.idx = t.idx + 1 WHERE {_FORM_OF.format(chr(102) + '.lemma = ' + _q('it'))} AND EXISTS (SELECT 1 FROM forms f WHERE f.doc_id = u.doc_id AND f.idx = u.idx AND f.lemma = 'be')), {_RESOLVED} {_SHOWN}")
def lex_gaz_morph(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lexicon(spark)
    grammar = morph_pipeline(["it is"], lex.lookup(table, ["it", "is"]))
    return _spans(vector(grammar, lexicon=table, **LATIN).findall(turns(spark, sf_dir)))


_FIRST_FORM = f"lex AS (SELECT * FROM (VALUES {_LEX_ROWS}) v(form, rank, lemma_id, lemma, grams)), words AS (SELECT DISTINCT lower(value) AS word FROM tokens WHERE token_type = 'Latin'), own AS (SELECT w.word, l.* FROM words w JOIN lex l ON l.form = w.word QUALIFY row_number() OVER (PARTITION BY w.word ORDER BY l.lemma_id, l.rank) = 1)"


@query("lex_inflected", f"WITH {_tokens('turns')}, {_FIRST_FORM}, fits AS (SELECT o.word, m.form, row_number() OVER (PARTITION BY o.word ORDER BY len(list_intersect(m.grams, o.grams)) DESC, m.rank) AS k FROM own o JOIN lex m ON m.lemma_id = o.lemma_id WHERE list_contains(m.grams, 'plur')) SELECT o.word, coalesce(f.form, o.lemma) AS inflected FROM own o LEFT JOIN fits f ON f.word = o.word AND f.k = 1")
def lex_inflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the turns that the lexicon has, in the plural."""
    words = tokenised(turns(spark, sf_dir), [], ["value", "token_type"]).filter("token_type = 'Latin'").select(F.lower("value").alias("word")).distinct()
    return lex.inflected_words(words, lexicon(spark), ("plur",))


@query("fact_inflected", f"WITH {_tokens('turns')}, {_LEX} SELECT DISTINCT t.doc_id, t.idx AS tok_start, CASE WHEN lower(t.value) IN ('those', 'that') THEN 'that' ELSE 'this' END AS word FROM tokens t JOIN forms f USING (doc_id, idx) WHERE f.lemma IN ('this', 'that') AND list_contains(f.grams, 'ADJF')")
def fact_inflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pronouns in the singular, through their paradigms in memory."""
    I = fact("Inflected", ["word"])  # noqa: E741
    wanted = pred(P.in_caseless(["this", "these", "those"]) | P.in_caseless(["that"]))
    grammar = wanted.interpretation(I.word.inflected(["sing", "ADJF"])).interpretation(I)
    found = typed(vector(grammar, lexicon=lexicon(spark), **LATIN).facts(turns(spark, sf_dir)), I)
    return found.select("doc_id", "tok_start", F.col("fields.word").alias("word"))


_morph_rows = f"lex AS (SELECT translate(form, '{_LATIN}', '{_CYRILLIC}') AS form, rank, lemma_id, translate(lemma, '{_LATIN}', '{_CYRILLIC}') AS lemma, grams FROM (VALUES {_LEX_ROWS}) v(form, rank, lemma_id, lemma, grams)), forms AS (SELECT t.doc_id, t.idx, l.* FROM tokens t JOIN lex l ON lower(t.value) = l.form WHERE t.token_type = 'Russian')"


@query("lex_cyrillic", f"WITH {_tokens('cyrillic')}, {_morph_rows}, found AS (SELECT DISTINCT doc_id, idx AS start, idx + 1 AS stop FROM forms WHERE list_contains(grams, 'plur')) {_SHOWN}")
def lex_cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(vector(pred(P.gram("plur")), lexicon=lexicon(spark, True)).findall(cyrillic(spark, sf_dir)))


@query("lex_joined", f"WITH {_tokens('turns')}, {_LEX}, found AS (SELECT DISTINCT doc_id, idx AS start, idx + 1 AS stop FROM forms WHERE list_contains(grams, 'sing')) {_SHOWN}")
def lex_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of a large lexicon: forms join the tokens."""
    tokens = lex.with_forms(with_tokens(turns(spark, sf_dir)), lexicon(spark), **LATIN)
    return _spans(vector(pred(P.gram("sing"))).findall(tokens))


def _agree(name: str, relation, sql: str) -> None:
    """Two words that agree; ``sql`` tests a pair of their forms."""
    grammar = lambda: rule([pred(P.gram("NPRO") | P.gram("ADJF") | P.gram("NOUN")).match_relation(relation), pred(P.gram("VERB")).match_relation(relation)])
    pairs = f"SELECT DISTINCT a.doc_id, a.idx AS start, a.idx + 2 AS stop FROM forms a JOIN forms b ON b.doc_id = a.doc_id AND b.idx = a.idx + 1 WHERE list_has_any(a.grams, ['NPRO', 'ADJF', 'NOUN']) AND list_contains(b.grams, 'VERB') AND ({sql})"
    query(name, f"WITH {_tokens('documents')}, {_LEX}, cand AS ({pairs}), {_RESOLVED} {_SHOWN}")(
        lambda spark, sf_dir: _spans(vector(grammar(), lexicon=lexicon(spark), **LATIN).findall(documents(spark, sf_dir)))
    )


def _both(code: str) -> str:
    return f"list_contains(a.grams, '{code}') AND list_contains(b.grams, '{code}')"


_NUMBER = f"({_both('sing')} OR {_both('plur')})"
_agree("rel_number_pairs", number_relation(), _NUMBER)
_agree("rel_gnc_pairs", gnc_relation(), f"{_NUMBER} AND ({_both('plur')} OR {_both('masc')} OR {_both('femn')} OR {_both('neut')} OR list_contains(a.grams, 'GNdr') OR list_contains(b.grams, 'GNdr'))")


_GENDER = f"({_both('plur')} OR {_both('masc')} OR {_both('femn')} OR {_both('neut')} OR list_contains(a.grams, 'GNdr') OR list_contains(b.grams, 'GNdr'))"
_agree("rel_gender_pairs", gender_relation(), _GENDER)
_agree("rel_not_number", ~number_relation(), f"NOT {_NUMBER}")
_agree("rel_gender_or_number", gender_relation() | number_relation(), f"({_GENDER} OR {_NUMBER})")
_agree("rel_gender_and_number", gender_relation() & number_relation(), f"{_GENDER} AND {_NUMBER}")
_agree("rel_custom", Relation("past", lambda a, b: "past" in b, lambda a, b: F.array_contains(b, "past")), "list_contains(b.grams, 'past')")


@query("grammemes", f"""WITH {_tokens('turns')}, {_LEX}, used AS (SELECT unnest(grams) AS code FROM forms),
    known AS (SELECT code, category FROM (VALUES ('ADJF', 'pos'), ('VERB', 'pos'), ('NOUN', 'pos'), ('NPRO', 'pos'), ('CONJ', 'pos'), ('PRCL', 'pos'), ('PREP', 'pos'), ('sing', 'number'), ('plur', 'number'), ('masc', 'gender'), ('neut', 'gender'), ('GNdr', 'gender'), ('past', 'tense')) v(code, category))
    SELECT code, category, count(*) AS n FROM used JOIN known USING (code) GROUP BY ALL""")
def grammemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the grammemes of each category occur among the forms of the turns' words."""
    words = tokenised(turns(spark, sf_dir), [], ["value", "token_type"]).filter("token_type = 'Latin'").groupBy(F.lower("value").alias("form")).agg(F.count(F.lit(1)).alias("n"))
    used = words.join(lexicon(spark), "form").select(F.explode("grams").alias("code"), "n")
    return used.join(F.broadcast(lex.grammemes(spark)), "code").groupBy("code", "category").agg(F.sum("n").alias("n"))


_BNF = {"up_to_four": ["R0 -> 'x' R1 | 'x'", "R1 -> 'x' R2 | 'x'", "R2 -> 'x' 'x' | 'x'"], "version": ["VERSION -> is_digit() R0", "R0 -> e | R1 R0 | '.' is_digit()", "R1 -> '.' is_digit()"], "door": ["R0 -> 'door' STATE", "STATE -> in_(...) | 'half' 'open'"]}


@query("bnf_printed", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i}, {_q(x)})" for n, lines in _BNF.items() for i, x in enumerate(lines)) + ") v(grammar, line_no, line)")
def bnf_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed rules depend on no table."""
    digits = pred(P.is_digit())
    version = rule([digits, rule([term("."), digits]).repeatable().optional()]).named("VERSION")
    door = rule([term("door"), or_([pred(P.in_(["open", "shut"])), rule([term("half"), term("open")])]).named("STATE")])
    made = {"up_to_four": term("x").repeatable(high=4), "version": version, "door": door}
    return spark.createDataFrame([(n, i, x) for n, g in made.items() for i, x in enumerate(compile_grammar(g).bnf())], "grammar string, line_no int, line string")
