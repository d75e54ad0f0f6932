"""Quality rules, token counts, BPE and wavelet files against brute force and round trips."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from spanloom.llm import bpe, quality, queries, token_counts, wavelet

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [None, "", "  \t\n", "a", "a b c " * 40, "x" * 70_000, "é ü z", "Σας ΟΔΟΣ İ", "<|endoftext|>a b<|startoftext|>", "日本語 １２３", "line\nline\n\nline\r\nline\r", "same same\nsame same", "ab" * 500, "don't I'LL 's"]
SCHEMA = "doc_id long, text string, ids string, quality string, __key string"


def odd_frame(spark):
    rows = [(i, t, "x", None, "k") for i, t in enumerate(ODD)] + [(None, "null id", None, None, None), (3, "a", "x", None, "k"), (3, "a", "x", None, "k")]
    return spark.createDataFrame(rows, SCHEMA)


def plain_quality(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in docs}
    rows = queries.op1_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def test_quality_of_odd_rows(spark):
    out = quality.quality_rules(odd_frame(spark), into="verdict").collect()
    assert len(out) == len(ODD) + 3
    for r in out:
        assert (r.verdict.n_words, r.verdict.word_chars, r.verdict.n_symbols, r.verdict.n_dup_lines, r.verdict.n_repeat_words, r.verdict.base_failed) == plain_quality(r.text)
    assert quality.keep_good(odd_frame(spark).limit(0)).count() == 0


def test_bands_reject_repetition_and_noise():
    zstd, bands = zstandard.ZstdCompressor(level=3), quality.Bands()
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    prose = " ".join("".join(rng.choice(letters, 5)) for _ in range(600))
    noise = " ".join("".join(map(chr, rng.integers(0x4E00, 0x9FFF, 12))) for _ in range(600))
    numbers = " ".join(f"{i} of item {i}" for i in range(3000, 9000))
    assert quality.judge(prose, bands, zstd)[-1]
    assert not quality.judge(noise, bands, zstd)[-1] and not quality.judge(noise, bands, zstd)[-2]
    verdict = quality.judge("ab" * 9 + " " + " ".join("x" * (3 + i % 2) + "y" * (i % 41) + "w" * (i // 41) for i in range(4000)), bands, zstd)
    assert verdict[-1] is False
    assert quality.judge(numbers, bands, zstd)[-1] in (True, False)


def test_repeated_words_of_many_different_words(monkeypatch):
    words = [str(i).encode() for i in range((1 << 20) + 5)] + [b"1", b"2", b"3"]
    assert quality.repeated_words(words) == 6


def library():
    tok = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_bpe_equals_library(spark):
    tok = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_rows(spark):
    tok, path = library(), queries.tokenizer_path()
    out = bpe.bpe_decode(bpe.bpe_encode(odd_frame(spark), path, into="coded"), path, "coded", "back").collect()
    assert len(out) == len(ODD) + 3
    for r in out:
        want = tok.encode(r.text or "", add_special_tokens=False).ids
        assert r.coded == want and r.back == tok.decode(want, skip_special_tokens=False)
    assert bpe.bpe_encode(odd_frame(spark).limit(0), path, into="coded").count() == 0
    both = bpe.bpe_codec(odd_frame(spark), path, ids="coded", decoded="back").collect()
    assert sorted(map(tuple, both), key=repr) == sorted(map(tuple, out), key=repr)
    assert bpe.bpe_codec(odd_frame(spark).limit(0), path, ids="coded").count() == 0


def test_bpe_of_random_texts():
    tok, own = library(), bpe.load(queries.tokenizer_path())
    rng = np.random.default_rng(7)
    ranges = [(0x01, 0x2FF), (0x300, 0xD7FF), (0x1F000, 0x1FFFF), (0x20, 0x7E)]
    for _ in range(800):
        text = "".join(chr(rng.integers(*ranges[rng.integers(4)])) for _ in range(rng.integers(1, 40)))
        assert np.frombuffer(own.encode(text), "<i4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_words_by_the_library_in_one_step():
    encoder = bpe.WordBpe(queries.tokenizer_path(), True, cache=8)
    words = ["a", "thatther", "über", "ßgetz", "été", ",.;", "7", "q" * 80, *(f"{chr(97 + i)}{chr(98 + i)}ing" for i in range(20))]
    for word in words:
        want = np.array(encoder.library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder._library_word(word) == encoder._plain_word(word) == encoder.encode(word) == want
    assert encoder.words.make == encoder._library_word and max(len(encoder.words), len(encoder.words.old)) <= 8
    assert wavelet.CACHE_WORDS > bpe.CACHE_WORDS


def test_merge_takes_leftmost_lowest_rank():
    ranks, merged = {1 * 10 + 1: 0, 2 * 10 + 1: 1}, [2, 3]
    assert bpe.merge_word([1, 1, 1], ranks, merged, 10) == [3]
    assert bpe.merge_word([1, 1, 1, 1, 5], ranks, merged, 10) == [2, 2, 5]


def test_bands_reject_what_the_base_rules_keep():
    zstd, bands, rng = zstandard.ZstdCompressor(level=3), quality.Bands(), np.random.default_rng(4)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    coded = lambda n: re.sub("(.{8})", r"\1 ", base64.b64encode(rng.bytes(n)).decode())
    block = prose(20)
    bad = [coded(n) for n in (400, 800, 1500, 3000, 30_000)] + [prose(700) + " " + coded(2000), prose(430) + (" " + block) * 21]
    for text in bad:
        assert quality.judge(text, bands, zstd)[-2:] == (False, False)
    for n in (60, 150, 300, 700, 2000, 20_000):
        assert quality.judge(prose(n), bands, zstd)[-2:] == (False, True)


def test_token_histogram(spark):
    tok, path = library(), queries.tokenizer_path()
    lengths = [len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sums = queries.op2_token_counts(spark, SF)
    rows = {r.n_tokens: r for r in sums.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r.n_docs == lengths.count(n) and r.docs_ge == sum(x >= n for x in lengths)
        assert r.tokens_ge == sum(x for x in lengths if x >= n) and r.truncated_total == sum(min(x, n) for x in lengths)
        assert r.n_total == len(lengths) and r.tokens_total == sum(lengths)
    got = {r.context: (r.docs_over, r.truncated_total) for r in token_counts.at_limits(sums, [0, 7, 512, 10**6]).collect()}
    assert got == {c: (sum(x > c for x in lengths), sum(min(x, c) for x in lengths)) for c in (0, 7, 512, 10**6)}
    assert token_counts.quantile(sums, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    histogram = token_counts.length_histogram(odd_frame(spark), path)
    assert sum(r.n_docs for r in histogram.collect()) == len(ODD) + 3
    assert token_counts.suffix_sums(histogram.limit(0)).count() == 0


def test_wavelet_matrix_queries():
    rng = np.random.default_rng(3)
    for top in (1, 2, 37, 70_000):
        ids = rng.integers(0, top, 1500).astype(np.uint32)
        m = wavelet.WaveletMatrix.build(ids)
        assert (m.tokens() == ids).all() and [m.access(i) for i in range(0, 1500, 7)] == ids[::7].tolist()
        for value in {*ids[:5].tolist(), top + 1, 1 << 40}:
            at = np.flatnonzero(ids == value).tolist()
            assert m.positions(value) == at and m.rank(value, 700) == sum(i < 700 for i in at)
            with pytest.raises(IndexError):
                m.select(value, len(at))
    assert len(wavelet.WaveletMatrix.build(np.array([], dtype=np.uint32)).tokens()) == 0


def test_wavelet_files(spark):
    tok = library()
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = {r.doc_id: r for r in queries.op8_wavelet(spark, SF).collect()}
    at = 0
    for doc_id, text in docs:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        assert (rows[doc_id].start, rows[doc_id].n_tokens) == (at, len(ids))
        assert rows[doc_id].ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (rows[doc_id].first_id, rows[doc_id].n_end_ids, rows[doc_id].first_end) == (ids[0], ids.count(1), ids.index(1))
        at += len(ids)


def test_wavelet_of_odd_rows_in_small_files(spark, tmp_path):
    path, target = queries.tokenizer_path(), f"file://{tmp_path}/tokens"
    wavelet.write_tokens(odd_frame(spark), path, target, file_tokens=50)
    docs = wavelet.read_tokens(spark, target)
    assert docs.select("part", "piece").distinct().count() > 4
    files = [wavelet.ShardFile(bytes(r.content)) for r in spark.read.format("binaryFile").load(target).collect() if r.content]
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in wavelet.with_starts(docs).orderBy("start").collect()])
    assert len(files) > 1 and sum(map(len, files)) == len(ids) and sum(f.count(1) for f in files) == (ids == 1).sum()
    assert all([f.access(i) for i in f.positions(1)] == [1] * f.count(1) for f in files)
    for wanted in {1, 0, int(ids[3]), 60_000, 1 << 40}:
        for r in wavelet.read_tokens(spark, target, wanted).collect():
            own = np.frombuffer(r.ids, "<u4").tolist()
            assert (r.first_id, r.n_wanted, r.first_wanted) == (own[0], own.count(wanted), own.index(wanted) if wanted in own else None)
    found = wavelet.with_starts(docs).orderBy("start").collect()
    assert len(found) == len(ODD) + 3 and found[-1].doc_id is None
    ids = [r.doc_id for r in found[:-1]]
    assert ids == sorted(ids)
    for a, b in zip(found, found[1:]):
        assert b.start == a.start + a.n_tokens
    wavelet.write_tokens(odd_frame(spark).limit(0), path, f"{target}-empty")
    assert wavelet.read_tokens(spark, f"{target}-empty").count() == 0
