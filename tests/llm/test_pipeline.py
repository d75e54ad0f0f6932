"""The pipeline's stages against brute force on a small table, and the whole run."""

import re
from collections import Counter

import zstandard

import corpus_pipeline
from spanloom.llm import bpe, queries
from spanloom.llm.quality import Bands, judge
from tests.llm.test_group_operators import WHITE, WORDS, plain_near, plain_targets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    left, bands, zstd = dict(rows), Bands(), zstandard.ZstdCompressor(level=3)
    frames = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        docs = docs.cache()
        frames[name] = Counter(r.doc_id for r in docs.collect())
    left = {i: t for i, t in left.items() if judge(t, bands, zstd)[-1]}
    assert frames["quality"] == Counter(left.keys())
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(WHITE, " ", left[i]), i)
    left = {i: left[i] for i in first.values()}
    assert frames["exact_dedup"] == Counter(left.keys())
    left = {i: left[i] for i, _, root in plain_near(list(left.items())) if i == root}
    assert frames["near_dedup"] == Counter(left.keys())
    sizes, taken = Counter(), Counter()
    for i, t in left.items():
        sizes[source[i]] += len(re.findall(WORDS, t))
    want = plain_targets(sizes)
    for i in left:
        rate = want[source[i]] / sizes[source[i]]
        assert int(rate) <= frames["mix"][i] <= min(3, int(rate) + 1)
        taken[source[i]] += frames["mix"][i]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    own = bpe.load(queries.tokenizer_path())
    assert Counter(r.doc_id for r in out) == frames["mix"]
    for r in out:
        assert r.n_tokens * 4 == len(own.encode(rows[r.doc_id])) and r.n_tokens == len(r.ids)


def test_run_and_empty_table(spark):
    n = corpus_pipeline.run(spark, SF).count()
    assert n > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows_through_all_stages(spark):
    """Null ids, texts and sources, ties, repeated rows and columns with internal names."""
    clean = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40").orderBy("doc_id").collect()]
    kept = [t for t in clean if judge(t, Bands(), zstandard.ZstdCompressor(level=3))[-1]]
    assert len(set(kept)) >= 4
    a, b, c, d = list(dict.fromkeys(kept))[:4]
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (None, b, None, None), (None, b, None, None), (2, a + "\n", "en", "s"), (5, c, "de", None), (5, d, "fr", "s"), (6, None, "en", "t"), (7, "", "en", "t"), (8, "x" * 200_000, "en", "t")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 7, 7, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __keep long, __target long, __quality long")
    frames = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and all((r["__keep"], r["__target"], r["__quality"]) == (7, 7, 7) for r in docs.collect())
        frames.append(sorted({(r.doc_id or 0, r.text) for r in docs.collect()}))
    assert frames[0] == sorted({(0, b), (1, a), (2, a + "\n"), (5, c), (5, d)})
    assert len(frames[1]) in (4, 5) and set(frames[2]) <= set(frames[1]) <= set(frames[0]) and set(frames[3]) <= set(frames[2])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count()
