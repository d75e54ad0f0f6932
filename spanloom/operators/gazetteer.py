"""Gazetteers: phrase lists as rules, and as a join of a token table with a phrase table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.tokens import fixed, local_tokens, with_tokens
from spanloom.plans.grammar import Gazetteer

#: Phrases and bytes up to which the phrase table is broadcast; above them the join shuffles on the first token.
BROADCAST_PHRASES, BROADCAST_BYTES = 200_000, 32 << 20
#: Phrases whose first words are named in a filter.
FILTER_PHRASES = 2_000


def _values(line: str) -> list[str]:
    return [t.value for t in local_tokens(line)]


def pipeline(lines, name: str = "pipeline") -> Gazetteer:
    """Phrases whose tokens are equal, case included; duplicates stay, lines without tokens are left out."""
    lines = [x for x in lines if _values(x)]
    return Gazetteer(name, "exact", tuple(lines), tuple(tuple((v,) for v in _values(x)) for x in lines))


def caseless_pipeline(lines, name: str = "caseless_pipeline") -> Gazetteer:
    lines = [x for x in lines if _values(x)]
    return Gazetteer(name, "caseless", tuple(lines), tuple(tuple((v.lower(),) for v in _values(x)) for x in lines))


def morph_pipeline(lines, lexicon: dict[str, list[dict]], name: str = "morph_pipeline") -> Gazetteer:
    """Phrases by lemmas: each word stands for all its lemmas (itself in lower case without any); other tokens are equal
    in lower case. ``lexicon``: lower-case form -> forms, as :func:`spanloom.sources.lexicon.lookup` returns it."""
    lines = [x for x in lines if _values(x)]

    def variants(value: str) -> tuple[str, ...]:
        forms = lexicon.get(value.lower(), [])
        return tuple(dict.fromkeys(f["lemma"] for f in forms)) or (value.lower(),)

    return Gazetteer(name, "morph", tuple(lines), tuple(tuple(variants(v) if v.isalpha() else (v.lower(),) for v in _values(x)) for x in lines))


def phrase_table(lines: DataFrame, line_col: str = "line", caseless: bool = False) -> DataFrame:
    """phrase_id, line, first, words, n of a table of lines with a ``phrase_id``: tokenised natively."""
    tokens = with_tokens(lines, line_col, "__tokens")
    words = F.transform("__tokens", lambda t: F.lower(t["value"]) if caseless else t["value"])
    table = tokens.select("phrase_id", F.col(line_col).alias("line"), words.alias("words")).filter(F.size("words") > 0)
    return table.select("phrase_id", "line", F.get("words", F.lit(0)).alias("first"), "words", F.size("words").alias("n"))


def gazetteer_spans(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", caseless: bool = False) -> DataFrame:
    """key, start, stop (tokens), byte_start, byte_stop, phrase_id, line of every occurrence of a phrase.

    An equi-join on the first token; the rest of the phrase is compared with the tokens that follow. Only tokens that start
    some phrase leave their document, where the phrases are few enough to name their first words; the phrase table is
    broadcast if its counted rows and measured bytes are small.
    """
    value = (lambda t: F.lower(t["value"])) if caseless else (lambda t: t["value"])
    size = F.octet_length("line") + F.octet_length(F.array_join("words", " ")) + 64
    longest, count, size = phrases.agg(F.max("n"), F.count(F.lit(1)), F.sum(size)).first()
    docs = docs.filter(F.col("tokens").isNotNull()).select(key, "tokens")
    starting = F.col("tokens")
    if count <= FILTER_PHRASES:
        firsts = [r[0] for r in phrases.select("first").distinct().collect()]
        starting = F.filter("tokens", lambda t: value(t).isin(*firsts))
    step = lambda t, k: F.get("tokens", t["idx"] + k)
    ahead = F.transform(starting, lambda t: F.struct(
        t["idx"].alias("start"), value(t).alias("first"), t["byte_start"].alias("byte_start"),
        F.transform(F.sequence(F.lit(0), F.lit(max(longest or 1, 1) - 1)), lambda k: F.struct(value(step(t, k)).alias("v"), step(t, k)["byte_stop"].alias("stop"))).alias("ahead"),
    ))
    starts = fixed(docs, {"__ahead": ahead}).select(key, F.inline("__ahead"))
    side = F.broadcast(phrases) if count <= BROADCAST_PHRASES and (size or 0) <= BROADCAST_BYTES else phrases
    same = F.transform(F.slice("ahead", F.lit(1), F.col("n")), lambda x: x["v"]) == F.col("words")
    found = starts.join(side, "first").filter(same)
    return found.select(key, "start", (F.col("start") + F.col("n")).alias("stop"), "byte_start", F.get("ahead", F.col("n") - 1)["stop"].alias("byte_stop"), "phrase_id", "line")
