"""Exact, near and line dedup, sharding and mixing against brute force; odd rows; components and row numbers."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import common, exact_dedup, line_dedup, mixing, queries, sharding, simhash_dedup
from spanloom.llm.common import connected_components, with_row_number

SF = "/root/testdata/sf0.001"
WHITE = "[\x20\x09-\x0d]+"
WORDS = "[^\x20\x09-\x0d]+"


def documents(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def odd_frame(spark):
    rows = [(1, "a b  c", "s", 1), (1, "a b  c", "s", 1), (0, "a b\tc", None, 2), (None, "a b c", "t", 3), (None, None, "t", 4), (5, "", "t", 5), (6, " ", "é", None), (7, "x " * 60_000, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, __keep long")


# exact dedup


def plain_exact(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(WHITE, " ", text or "")].append((doc_id is None, doc_id or 0, i, doc_id))
    out = []
    for text, members in groups.items():
        first = min(members)
        out += [(m[3], first[3], len(members), m == first, hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


def test_exact_dedup(spark):
    got = queries.op10_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain_exact([(i, t) for i, t, _ in documents(spark)])


def test_exact_dedup_of_odd_rows(spark):
    rows = odd_frame(spark)
    got = exact_dedup.exact_dedup(rows).collect()
    assert sorted(map(tuple, got), key=repr) == plain_exact([(r.doc_id, r.text) for r in rows.collect()])
    kept = exact_dedup.drop_exact_copies(rows)
    assert kept.columns == rows.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(0, "a b\tc"), (5, ""), (6, " "), (7, "x " * 60_000)], key=repr)
    assert exact_dedup.exact_dedup(rows.limit(0)).count() == 0 and exact_dedup.drop_exact_copies(rows.limit(0)).count() == 0


def test_exact_dedup_beyond_the_hot_list(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TOP", 2)
    monkeypatch.setattr(exact_dedup, "TRACKED", 16)
    rows = [(i, f"t{i % 40}" if i % 3 else "hot") for i in range(600)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_exact(rows)


# near dedup


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(WORDS, text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near(rows):
    prints = {i: plain_print(t) for i, t in rows}
    values = sorted(set(prints.values()))
    root = roots(values, [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 2])
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    return sorted((i, f"{p:016x}", least[root[p]]) for i, p in prints.items())


def test_simhash(spark):
    got = queries.op5_simhash_dedup(spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == plain_near([(i, t) for i, t, _ in documents(spark)])


@pytest.mark.parametrize("hot", [512, 3, 0])
def test_links_of_planted_fingerprints(spark, hot):
    rng = random.Random(hot)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        values |= {v ^ 1 << rng.randrange(64) for _ in range(4)} | {v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(4)}
    base = rng.getrandbits(32)
    values |= {base | rng.getrandbits(6) << 32 for _ in range(40)} | {base << 32 | rng.getrandbits(5) for _ in range(20)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {(r.a, r.b) for r in simhash_dedup.links(prints, hot).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    assert got == want


def test_near_of_odd_rows(spark):
    rows = odd_frame(spark)
    got = {(r.doc_id, r.text_hash): r for r in simhash_dedup.near_groups(rows).collect()}
    assert len(simhash_dedup.near_groups(rows).collect()) == rows.count()
    assert {r.component_id for r in got.values() if r.fp == 0} == {5}
    kept = simhash_dedup.drop_near_copies(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [0, 5, 7]
    assert simhash_dedup.drop_near_copies(rows.limit(0)).count() == 0
    only_null = rows.filter("doc_id is null and text is null")
    assert simhash_dedup.drop_near_copies(only_null).count() == 1


def test_near_keeps_one_row_of_each_component(spark):
    rng = random.Random(11)
    a, b, c, d, e = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (None, c), (5, c), (5, d), (5, e), (9, d)]
    kept = simhash_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(None, a), (None, b), (5, c), (5, d), (5, e)], key=repr)


# lines


def plain_lines(rows):
    """(doc_id, pos) of lines that go, for distinct doc_ids."""

    def print_of(norm):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in norm.split(" ")]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    at = defaultdict(list)
    for doc_id, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            norm = re.sub(r"[\W_]+", " ", line.lower()).strip()
            if len(norm) >= line_dedup.MIN_CHARS:
                at[norm].append((doc_id, pos))
    lines = sorted(at)
    prints = [print_of(x) for x in lines]
    links = []
    for i, a in enumerate(lines):
        for j in range(i + 1, len(lines)):
            if (prints[i] ^ prints[j]).bit_count() <= line_dedup.MAX_BITS and edits(a, lines[j]) <= 0.2 * max(len(a), len(lines[j])) + 1e-9:
                links.append((a, lines[j]))
    root = roots(lines, links)
    members = defaultdict(list)
    for x in lines:
        members[root[x]] += at[x]
    return {p for places in members.values() for p in sorted(places)[1:]}, len(links)


def test_line_dedup(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(4, 40))) for _ in range(60)]
    variants = []
    for x in lines[:30]:
        w = x.split(" ")
        w[rng.randrange(len(w))] += "x"
        variants += [" ".join(w), x.upper() + "!", " ".join(sorted(x.split(" ")))]
    pool = lines + variants + ["short", "", "-- --"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 9)))) for i in range(80)]
    gone, n_links = plain_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert n_links > 5 and len(out) == len(rows)
    for doc_id, text in rows:
        left = [x for p, x in enumerate(text.split("\n")) if (doc_id, p) not in gone]
        assert out[doc_id].clean_text == "\n".join(left) and out[doc_id].clean_text_dropped == len(text.split("\n")) - len(left)


def test_close_fingerprints_for_every_cut(spark):
    rng = random.Random(9)
    values = {rng.getrandbits(63) for _ in range(40)}
    values |= {v ^ sum(1 << b for b in rng.sample(range(63), rng.randint(1, 4))) for v in list(values) for _ in range(5)}
    want = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= line_dedup.MAX_BITS}
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    for m in (4, 5, 6, 8):
        assert {(r.a, r.b) for r in line_dedup.close_fingerprints(prints, m).collect()} == want
    assert [line_dedup.blocks_for(n) for n in (0, 100, 2_000_000, 10**9, 10**15)] == [4, 4, 5, 6, 8]


def test_large_keys_of_blocks_are_cut_finer(spark):
    rng = random.Random(10)
    low = rng.getrandbits(25)
    values = [low | rng.getrandbits(38) << 25 for _ in range(300)]
    near = [(v, v ^ sum(1 << b for b in rng.sample(range(25, 63), rng.randint(1, 3)))) for v in values[:60]]
    prints = values + [b for _, b in near]
    rows = [(4, i, 0, len(prints), v, 50) for i, v in enumerate(prints)] + [(7, i, 0, 40, v, 50) for i, v in enumerate(prints[:40])] + [(8, i, 0, 2, v, 50) for i, v in enumerate(prints[:2])]
    members = spark.createDataFrame(rows, "key long, id long, first long, size long, fp long, chars int")
    by = defaultdict(set)
    for r in line_dedup.finer_keys(members).collect():
        by[r.key].add(r.fp)
    assert len(by.pop(7)) == 40 and by.pop(8) == set(prints[:2])  # keys of words and small keys stay
    assert max(map(len, by.values())) <= line_dedup.SMALL
    assert all(any({a, b} <= found for found in by.values()) for a, b in near)


def test_lines_of_odd_rows(spark):
    long_line = " ".join(f"w{i % 5000}" for i in range(70_000))
    line = "one line that is long enough to count"
    rows = [(1, None), (2, ""), (3, f"{line}\n{line}"), (3, f"{line}\n{line}"), (None, line), (4, long_line), (5, long_line), (6, "\n\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, pos string")
    out = line_dedup.line_dedup(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[1].clean_text is None and by[2].clean_text == "" and by[3].clean_text == line and by[None].clean_text == ""
    assert by[4].clean_text == long_line and by[5].clean_text == "" and by[6].clean_text == "\n\n"
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_a_line_that_fills_the_top_counter(spark):
    line = "same " * 40_000
    out = line_dedup.line_dedup(spark.createDataFrame([(1, line), (2, line)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.clean_text for r in out} == {1: line, 2: ""}


def test_lines_with_one_word_replaced(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(5, 7)))
    rows, n = [], 60
    for i in range(n):
        words = [word() for _ in range(rng.randint(8, 30))]
        other = list(words)
        other[rng.randrange(len(words))] = word()
        rows += [(i, " ".join(words)), (n + i, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dropped_lines(df, shingles=line_dedup.SHINGLES).collect()}
    assert gone <= set(range(n, 2 * n)) and len(gone) >= 0.95 * n
    assert len(line_dedup.dropped_lines(df).collect()) < 0.5 * n  # MAX_BITS alone


def test_short_lines_go_by_equality(spark):
    rows = [(1, "Read more\n\n--\nchapter 10"), (2, "read  MORE!\n\n--\nchapter 11"), (3, "read mores\nRead more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.clean_text for r in line_dedup.line_dedup(df, shingles=line_dedup.SHINGLES).collect()}
    assert out == {1: rows[0][1], 2: "\n--\nchapter 11", 3: "read mores"}


def test_edit_bound_is_an_upper_bound(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(200)]
    rows = [([], []), (["a"], []), (["a", "b", "c"], ["b", "c", "d"])]
    for _ in range(200):
        p = rng.choices(vocabulary, k=rng.randint(1, 40))
        q = list(p)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(q) + 1)
            q[i : i + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
        rows.append((p, q))
    df = spark.createDataFrame(rows, "p array<string>, q array<string>")
    line = lambda c: F.array_join(c, " ")
    found = df.select("p", "q", line_dedup.edit_bound(F.col("p"), F.col("q")).alias("bound"), F.levenshtein(line("p"), line("q")).alias("edits")).collect()
    known = [r for r in found if r.bound is not None]
    assert len(known) >= 0.8 * len(rows) and all(r.bound >= r.edits for r in known)
    assert all(r.bound == 0 for r in known if r.p == r.q)
    assert (next(r.bound for r in found if r.p == ["a", "b", "c"]), len([r for r in known if 0 < r.edits and len(r.q) != len(r.p)]) > 20) == (4, True)


def test_cut_bound_is_an_upper_bound(spark):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(200)]
    rows = [("", "", 0), ("a", "", 1), ("", "abc", 1), ("abc" * 50, "xyz" * 50, 20)]
    for n in [5, 20, 100, 300] * 15:
        p = rng.choices(vocabulary, k=n)
        q = list(p)
        for _ in range(rng.randint(0, n // 8)):
            i = rng.randrange(len(q) + 1)
            q[i : i + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
        rows.append((" ".join(p), " ".join(q), max(len(" ".join(p)), len(" ".join(q))) // 5))
    df = spark.createDataFrame(rows, "p string, q string, most int")
    found = df.select("p", "most", line_dedup.cut_bound(F.col("p"), F.col("q"), F.col("most")).alias("bound"), F.levenshtein("p", "q").alias("edits")).collect()
    assert all(r.edits <= r.bound or r.bound > r.most for r in found)
    linked = [r for r in found if r.edits <= r.most]
    assert len(linked) > 50 and sum(r.bound <= r.most for r in linked) >= 0.9 * len(linked)
    assert all(r.bound > r.most for r in found if r.edits > r.most)


def test_texts_are_split_once_and_spent_tables_go(spark):
    df = spark.createDataFrame([(i, f"the same line in each of the documents\nand one of its own {i}") for i in range(9)], "doc_id long, text string")
    out = line_dedup.line_dedup(df, shingles=line_dedup.SHINGLES)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "get(split(" not in plan
    table = common.written(df, "spent")
    (folder,) = {f.rpartition("/")[0] for f in table.inputFiles()}
    assert folder.startswith(f"{common.shared_dir(spark)}/spanloom/spent-")
    common.discarded(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 1000, 4097])
def test_permutation_is_a_bijection(n):
    image = sharding.permute(np.arange(n), n, 42)
    assert sorted(image) == list(range(n)) and (sharding.permute(image, n, 42, inverse=True) == np.arange(n)).all()
    if n > 60:
        assert (image != sharding.permute(np.arange(n), n, 43)).any() and (np.diff(image) == 1).mean() < 0.1


def test_shards(spark):
    docs = sorted((i, t or "") for i, t, _ in documents(spark))
    rows = {r.doc_id: r for r in queries.op3_feistel_shards(spark, SF).collect()}
    slots = defaultdict(list)
    for number, (doc_id, text) in enumerate(docs):
        r = rows[doc_id]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "rows", None)
        assert sharding.locate(r.shard, r.slot, len(docs), 8) == number
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_do_not_depend_on_the_layout(spark):
    rows = [(i // 2 if i % 5 else None, str(i // 4)) for i in range(300)]
    order = [F.col("doc_id").asc_nulls_last(), F.col("position_")]
    frames = [spark.createDataFrame(rows, "doc_id long, position_ string").repartition(k) for k in (1, 7)]
    a, b = (Counter(map(tuple, sharding.feistel_shards(f, order, 8).drop("row_number").collect())) for f in frames)
    assert a == b
    assert sharding.feistel_shards(frames[0].limit(0), order, 8).count() == 0


# mixing


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """By hand: share, cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest, open_ = total - sum(cap * sizes[s] for s in capped), [s for s in names if s not in capped]
        share = sum(weight[s] for s in open_)
        more = {s for s in open_ if weight[s] * rest / share > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in capped else weight[s] * rest / share for s in names}
        capped |= more


def test_mix(spark):
    docs = documents(spark)
    size = {i: len(re.findall(WORDS, t or "")) for i, t, _ in docs}
    sizes = Counter()
    for i, _, s in docs:
        sizes[s] += size[i]
    want = plain_targets(sizes)
    rows = queries.op4_mixing(spark, SF).collect()
    again = queries.op4_mixing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(docs)
    source = {i: s for i, _, s in docs}
    for r in rows:
        rate = want[source[r.doc_id]] / r.source_size
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken in (r["size"] * int(rate), r["size"] * min(3, int(rate) + 1))


def test_taken_words_come_near_targets(spark):
    rows = [(i, f"s{i % 4 if i % 3 else 0}", "w " * (1 + i % 13)) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    planned = mixing.plan_mix(mixing.slim_sizes(df)).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    for r in planned:
        assert abs(r.n - r.t) < 0.08 * r.t
    mixed = mixing.mix(df)
    assert mixed.count() == mixing.plan_mix(mixing.slim_sizes(df)).agg(F.sum("copies")).first()[0] and mixed.columns == df.columns


def test_mix_of_odd_rows_and_salts(spark, monkeypatch):
    rows = odd_frame(spark)
    plain = sorted(map(tuple, mixing.plan_mix(mixing.slim_sizes(rows)).collect()), key=repr)
    sizes = Counter()
    for r in rows.collect():
        sizes[r.source] += len(re.findall(WORDS, r.text or ""))
    want = plain_targets(sizes)
    assert len(plain) == rows.count() and all(r[4] == pytest.approx(want[r[1]]) for r in plain)
    monkeypatch.setattr(mixing, "small_side", lambda df: df)
    assert sorted(map(tuple, mixing.plan_mix(mixing.slim_sizes(rows)).collect()), key=repr) == plain
    assert mixing.mix(rows.limit(0)).count() == 0
    zero = spark.createDataFrame([(1, "a", ""), (2, "b", None)], "doc_id long, source string, text string")
    assert [tuple(r)[3:] for r in mixing.plan_mix(mixing.slim_sizes(zero)).collect()] == [(0, 0.0, 0), (0, 0.0, 0)]


# shared


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 300) if i % 50] + [(1000, 1000 + i) for i in range(1, 100)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)]
    rng.shuffle(links)
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links]
    want = roots({x for p in links if p[0] != p[1] for x in p}, links)
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_row_numbers(spark):
    df = spark.createDataFrame([(x % 17, x) for x in range(500)], "k long, v long").repartition(5)
    rows, n = with_row_number(df, [F.col("k"), F.col("v").desc()])
    got = [(r.k, -r.v) for r in rows.orderBy("row_number").collect()]
    assert n == 500 and got == sorted(got) and [r.row_number for r in rows.orderBy("row_number").collect()] == list(range(500))


# any column names


INTERNAL = ["__keep", "__n", "__key_doc_id", "__odd_doc_id", "__KEEP_", "__target", "__copies", "__copy", "__source", "__salt", "__part", "__index", "__start", "__id", "__hash", "__drop", "__quality", "__coded", "__digest", "__bytes", "__refers", "a.b"]


def test_columns_of_any_name_stay(spark):
    text = "some words that are the same " * 4
    rows = [(1, text, "s"), (1, text, "s"), (2, text + " ", "s"), (None, None, None), (None, None, None), (3, "other " * 30, "t"), (4, "", "t")]
    df = spark.createDataFrame([(*r, *[7] * len(INTERNAL)) for r in rows], ["doc_id", "text", "source", *INTERNAL])
    names = [f"`{c}`" for c in INTERNAL]
    outs = [exact_dedup.drop_exact_copies(df), simhash_dedup.drop_near_copies(df), mixing.mix(df), sharding.feistel_shards(df, [F.col("doc_id").asc_nulls_last(), F.col("text")], 4), line_dedup.line_dedup(df)]
    for out in outs:
        kept = out.select(*names).collect()
        assert set(df.columns) <= set(out.columns) and kept and all(set(r) == {7} for r in kept)
    assert outs[0].count() == 3 and outs[3].count() == outs[4].count() == len(rows)
    assert simhash_dedup.drop_near_copies(df.limit(0)).columns == df.columns


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
