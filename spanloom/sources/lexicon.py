"""The morphological lexicon: an OpenCorpora XML dump as a Parquet table, and its join to tokens.

A lexicon table has form (lower case), rank, lemma_id, lemma, grams. Lookups replace an analyser: words that are not
in the table have an empty list of forms.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.errors import LexiconError, MorphError
from spanloom.functions.tokens import FORM

#: Grammeme codes by category.
GRAMMEMES = {
    "pos": "NOUN ADJF ADJS COMP VERB INFN PRTF PRTS GRND NUMR ADVB NPRO PRED PREP CONJ PRCL INTJ".split(),
    "animacy": "anim inan Inmx".split(),
    "aspect": "perf impf".split(),
    "case": "Fixd nomn gent datv accs ablt loct voct gen2 acc2 loc2".split(),
    "gender": "masc femn neut ms-f Ms-f GNdr".split(),
    "involvement": "incl excl".split(),
    "mood": "indc impr".split(),
    "number": "sing plur Sgtm Pltm".split(),
    "transitivity": "tran intr".split(),
    "tense": "past pres futr".split(),
    "voice": "actv pssv".split(),
    "person": "1per 2per 3per Impe Impx".split(),
    "other": (
        "Abbr Name Surn Patr Geox Orgn Trad Subx Supr Qual Apro Anum Poss Ques Dmns Anph Cmp2 V-ey V-oy V-ej V-be V-en "
        "V-ie V-bi V-sh Mult Refl Infr Slng Arch Litr Erro Dist Prnt Fimp Prdx Coun Coll Af-p Vpre Init Adjx Hypo Other"
    ).split(),
}
CATEGORY = {code: category for category, codes in GRAMMEMES.items() for code in codes}
#: Bytes of a lexicon that is sent to all workers; a larger one is joined.
MEMORY_BYTES = 16 << 20
SCHEMA = "form string, rank int, lemma_id bigint, lemma string, grams array<string>"
_XML = "_id bigint, l struct<_t:string,g:array<struct<_v:string>>>, f array<struct<_t:string,g:array<struct<_v:string>>>>"


def check_gram(code: str) -> None:
    if code not in CATEGORY:
        raise MorphError(f"unknown grammeme {code}")


def known_grams(codes) -> list[str] | None:
    """Known codes in order; None if none is known (the default inflection then applies)."""
    return [c for c in codes or () if c in CATEGORY] or None


def grammemes(spark: SparkSession) -> DataFrame:
    """code, category: the closed vocabulary as a dimension table."""
    return spark.createDataFrame(list(CATEGORY.items()), "code string, category string")


def read_opencorpora(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon table from the XML dump: one row a form, grammemes of the lemma and the form together."""
    raw = spark.read.format("xml").option("rowTag", "lemma").schema(_XML).load(path)
    rows = raw.select(F.col("_id").alias("lemma_id"), F.lower("l._t").alias("lemma"), F.col("l.g").alias("own"), F.posexplode("f").alias("rank", "f"))
    codes = F.array_sort(F.array_distinct(F.concat(F.coalesce("own._v", F.array()), F.coalesce("f.g._v", F.array()))))
    return rows.select(F.lower("f._t").alias("form"), F.col("rank").cast("int"), "lemma_id", "lemma", codes.alias("grams"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def has_lexicon(spark: SparkSession, path: str) -> bool:
    return _exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def prepare_lexicon(spark: SparkSession, xml: str, target: str) -> DataFrame:
    """Build the table if it is not there, ordered by form so that lookups skip most row groups; then load it."""
    if not has_lexicon(spark, target):
        if not _exists(spark, xml):
            raise LexiconError(f"no dictionary at {xml}")
        read_opencorpora(spark, xml).repartitionByRange("form").sortWithinPartitions("form").write.mode("overwrite").parquet(target)
    return load_lexicon(spark, target)


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    if not has_lexicon(spark, path):
        raise LexiconError(f"no complete lexicon at {path}; prepare_lexicon builds one")
    return spark.read.schema(SCHEMA).parquet(path)


def _form() -> Column:
    return F.struct("lemma", "grams", "lemma_id", "form")


def grouped(lexicon: DataFrame) -> DataFrame:
    """word, forms: the forms of each word in order of (lemma_id, rank)."""
    ordered = F.array_sort(F.collect_list(F.struct("lemma_id", "rank", "lemma", "grams", "form")))
    forms = F.transform(ordered, lambda x: F.struct(x["lemma"].alias("lemma"), x["grams"].alias("grams"), x["lemma_id"].alias("lemma_id"), x["form"].alias("form")))
    return lexicon.groupBy(F.col("form").alias("word")).agg(forms.cast(f"array<{FORM}>").alias("forms"))


def lookup(lexicon: DataFrame, words) -> dict[str, list[dict]]:
    """word -> forms for a short list of words, such as a gazetteer's; the result is bounded by the list."""
    wanted = sorted({w.lower() for w in words})
    rows = grouped(lexicon.filter(F.col("form").isin(*wanted))).collect() if wanted else []
    return {r.word: [f.asDict() for f in r.forms] for r in rows}


def lemmas_of(lexicon: DataFrame, words) -> list[str]:
    """Lemmas of the words for a dictionary predicate; a word without forms stands for itself in lower case."""
    known = lookup(lexicon, words)
    return sorted({x for w in words for x in ([f["lemma"] for f in known.get(w.lower(), [])] or [w.lower()])})


def in_memory(lexicon: DataFrame, most: int = MEMORY_BYTES) -> tuple[dict[str, list[dict]], dict[int, list[dict]]] | None:
    """(word -> forms, lemma_id -> paradigm) of a lexicon of ``most`` bytes at most, measured first; None for a larger one."""
    size = F.octet_length("form") + F.octet_length("lemma") + F.octet_length(F.array_join("grams", " ")) + 64
    if (lexicon.agg(F.sum(size)).first()[0] or 0) > most:
        return None
    words: dict[str, list[dict]] = {}
    lemmas: dict[int, list[dict]] = {}
    for r in sorted(lexicon.collect(), key=lambda r: (r.lemma_id, r["rank"], r.lemma, r.grams, r.form)):
        words.setdefault(r.form, []).append({"lemma": r.lemma, "grams": r.grams, "lemma_id": r.lemma_id, "form": r.form})
        lemmas.setdefault(r.lemma_id, []).append({"lemma_id": r.lemma_id, "rank": r["rank"], "form": r.form, "grams": r.grams})
    return words, lemmas


def with_forms(docs: DataFrame, lexicon: DataFrame, types=("Russian",), key: str = "doc_id") -> DataFrame:
    """``docs`` (unique ``key``, tokens) with forms on tokens of ``types``: an empty list if the lexicon lacks the word.

    Each document's distinct words are looked up once: an equi-join on the word and one aggregation by document. Other
    tokens keep forms null.
    """
    is_word = lambda t: t["token_type"].isin(*types)
    words = F.array_distinct(F.transform(F.filter("tokens", is_word), lambda t: F.lower(t["value"])))
    asked = docs.select(F.col(key).alias("__key"), F.explode(words).alias("word"))
    found = asked.join(grouped(lexicon), "word").groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("word", "forms"))).alias("__known"))
    joined = docs.join(found, F.col(key) == F.col("__key"), "left")
    none = F.array().cast(f"array<{FORM}>")
    own = lambda t: F.when(is_word(t), F.coalesce(F.try_element_at("__known", F.lower(t["value"])), none))
    return joined.withColumn("tokens", F.transform("tokens", lambda t: t.withField("forms", own(t)))).drop("__key", "__known")


def with_paradigms(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``paradigms``: every form of each lemma that the tokens' forms name, for inflection."""
    ids = F.array_distinct(F.flatten(F.transform(F.filter("tokens", lambda t: t["forms"].isNotNull()), lambda t: F.transform(t["forms"], lambda f: f["lemma_id"]))))
    asked = docs.select(F.col(key).alias("__key"), F.explode(ids).alias("lemma_id"))
    rows = F.collect_list(F.struct("lemma_id", "rank", "form", "grams"))
    found = asked.join(lexicon, "lemma_id").groupBy("__key").agg(F.array_sort(rows).alias("paradigms"))
    return docs.join(found, F.col(key) == F.col("__key"), "left").drop("__key")


def inflected_words(words: DataFrame, lexicon: DataFrame, grams=("nomn", "sing")) -> DataFrame:
    """word, inflected: the first form's paradigm member with all ``grams`` that keeps most other grammemes; else the lemma."""
    first = words.select("word").distinct().join(grouped(lexicon), "word").select("word", F.get("forms", F.lit(0)).alias("own"))
    members = first.join(lexicon.select(F.col("lemma_id").alias("id"), F.col("form").alias("candidate"), "rank", F.col("grams").alias("g")), F.col("own.lemma_id") == F.col("id"), "left")
    fits = F.forall(F.array(*[F.lit(x) for x in grams]), lambda x: F.array_contains("g", x))
    order = F.struct(-F.size(F.array_intersect("g", "own.grams")), "rank")
    best = members.groupBy("word", "own").agg(F.min_by(F.when(fits, F.col("candidate")), F.when(fits, order)).alias("best"))
    return best.select("word", F.coalesce("best", "own.lemma").alias("inflected"))


def main(args: list[str] | None = None) -> None:
    """spark-submit entry: build a lexicon table from an XML dump."""
    parser = argparse.ArgumentParser(description="Build a lexicon table from an OpenCorpora XML dump")
    parser.add_argument("xml")
    parser.add_argument("--out", default="data/dict")
    options = parser.parse_args(args)
    spark = SparkSession.builder.appName("lexicon").getOrCreate()
    print(prepare_lexicon(spark, options.xml, options.out).count(), "forms")


if __name__ == "__main__":
    main()
