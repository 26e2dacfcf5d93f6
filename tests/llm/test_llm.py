"""Operators of the llm subpackage against brute force on small fixtures, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cropmill.llm import chat, licenses, nearcopies, packing, passages, quality, secretscan, simhash, suffixes, vptree, warc, winnowing
from cropmill.llm.queries import ORACLE_SQL, QUERIES, table, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ruß", "té", "an"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = c.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(x) for x in cols]
    got = sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


# 1


def test_licenses_edge_cases(spark):
    texts = [None, "", "Copyright. ALL rights\n reserved, CC-by! cc\tby", "xcc by", "cc byé", "RELEASED under the  MIT license now", "all rights reserved " * 300, "é" * 5000, "Released under MIT License.\nunder the", "©All Rights Reserved"]
    rows = docs(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, None, 7]).withColumn("score", F.lit("clash"))
    got = licenses.scan(rows).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got if r.doc_id != 7}
    assert (by[0].n_words, by[1].n_words, by[0].labels, by[0].score) == (0, 0, "", 0.0)
    assert (by[2].n_base, by[2].first_word, by[2].last_word, by[2].base_labels) == (3, 1, 6, "cc-by,reserved")
    assert by[3].n_base == by[4].n_base == 0
    assert by[5].labels == "mit" and 0.8 <= by[5].score <= 1
    assert (by[6].n_base, by[6].last_word) == (300, 897)
    assert by[None].labels == "mit" and by[None].score == 0.8
    assert sorted(r.n_words for r in got if r.doc_id == 7) == [1, 3]
    assert licenses.scan(rows.where("false")).collect() == []


def test_license_join_is_exact(spark):
    rng = random.Random(3)
    vocabulary = [w for _, t in licenses.TEMPLATES for w in licenses.words_of(t)] + ["the", "of", "zebra"]
    texts = ["\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    texts += [t if rng.random() < 0.5 else " ".join(rng.sample(t.split(), k=max(1, int(len(t.split()) * 0.85)))) for _, t in licenses.TEMPLATES for _ in range(4)]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        n = 0
        for block in re.split(r"\n[^\nA-Za-z0-9\x80-\U0010ffff]*\n|(?<=[.!?])\s+", text):
            own = set(words(block))
            n += sum(len(own & set(licenses.words_of(t))) >= max(1, math.ceil(0.8 * len(set(licenses.words_of(t))) - 1e-9)) for _, t in licenses.TEMPLATES)
        assert got[i].n_blocks == n, text


def test_license_index_holds_all_prefixes():
    templates = [{"prefix": [0, 2]}, {"prefix": [2]}, {"prefix": [1]}]
    assert licenses.prefix_index(templates, 4) == [[0], [2], [0, 1], []]


#: Notices as they stand in source files.
WRAPPED = {
    "mit": "/*\n * Permission is hereby granted, free of charge, to any person obtaining a\n * copy of this software and associated\n * documentation files (the \"Software\"), to deal\n */",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n#\n# 1. more",
    "mpl-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed",
    "gpl": "dnl This program is free software: you can redistribute it\ndnl and/or modify it under the terms of the GNU General\ndnl Public License as published by",
    "apache-2.0": "-- you may not use this file\n-- except in compliance\n-- with the License.",
}


def test_wrapped_notices(spark):
    texts = [f"int x;\r\n\n{t}\n\nint y;\n" for t in WRAPPED.values()]
    texts += [t.replace("\n", "\n\n") for t in WRAPPED.values()]  # lines apart are no sentence
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(docs(spark, texts)).collect()}
    for i, label in enumerate(WRAPPED):
        assert label in got[i]
    assert sum(label in got[i + len(WRAPPED)] for i, label in enumerate(WRAPPED)) <= 1


def test_many_hits_in_one_text(spark):
    n = 100_000
    rows = docs(spark, ["all rights reserved ünd " * n, "a" * 5 + " 0123456789abcdef01234567é" * n])
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word) == (n, 0, 4 * (n - 1))
    model = [0.0] * len(secretscan.LETTERS) ** 2
    found = secretscan.secret_spans(rows, model).withColumn("clean", secretscan.redacted(F.col("text"), F.col("secrets")))
    got = {r.doc_id: r for r in found.collect()}
    assert got[0].secrets == [] and got[0].clean == "all rights reserved ünd " * n
    assert len(got[1].secrets) == n and got[1].clean == "a" * 5 + " [SECRET]é" * n
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("é[x").alias("text"))
    one = chat.formatted(turns).withColumn("n", F.size(chat.read_back(F.col("formatted")))).select("n", F.size("loss_mask").alias("m")).first()
    assert (one.n, one.m) == (20_000, 10_000)


# 2


def brute_repeats(texts, span=400):
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for b in bodies:
        for p in range(len(b) - span + 1):
            seen[b[p : p + span]] = seen.get(b[p : p + span], 0) + 1
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if seen[b[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [256, 1])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(5)
    base = [prose(rng, 400) for _ in range(3)]
    texts = [None, "", "x" * 399, "ab" * 900, "line of text that repeats again\n" * 60, base[0], base[0], base[1] + base[2], base[2][:700] + "!" + base[2][700:]]
    for _ in range(25):
        a, b = sorted(rng.sample(range(len(base[1])), 2))
        texts.append(prose(rng, rng.randint(0, 60)) + base[1][a:b] + prose(rng, rng.randint(0, 30)) + base[2][: rng.randint(0, 900)])
    rows = docs(spark, texts, [None, None, *range(len(texts) - 2)]).withColumn("spans", F.lit(1)).repartition(5)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(rows).collect())
    assert got == brute_repeats(texts)


def test_passages_across_documents(spark, monkeypatch):
    monkeypatch.setattr(passages, "MOST_ANCHORS", 20)
    rng = random.Random(31)
    fresh = lambda n: [f"{rng.getrandbits(rng.choice((4, 24))):x}" for _ in range(n)]
    shared = [fresh(n) for n in (49, 50, 51, 60, 130)]
    texts = [None, "", " ".join(fresh(40)), " ".join(shared[3]), " ".join(shared[3]), "la " * 49, "la " * 60, "La-" * 200, "x " * 50]
    for s in shared * 2:
        texts.append(" ".join(fresh(rng.randint(0, 60)) + s + fresh(rng.randint(0, 60))).upper())
    texts.append(" ".join(shared[4][20:90] + fresh(1) + shared[4][100:] + shared[2]))
    found = [words(t) for t in texts]
    seen = {}
    for i, w in enumerate(found):
        for at in range(len(w) - 49):
            seen.setdefault(tuple(w[at : at + 50]), set()).add(i)
    want = [len({k for at in range(len(w) - 49) if len(seen[tuple(w[at : at + 50])]) > 1 for k in range(at, at + 50)}) for w in found]
    got = {r.doc_id: r for r in suffixes.without_repeats(docs(spark, texts).repartition(4)).collect()}
    assert [got[i].n_passage_words for i in range(len(texts))] == want and sum(n > 0 for n in want) >= 10
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.values()) == brute_repeats(texts)


def test_repeats_in_very_long_texts(spark):
    rng = random.Random(32)
    long = rng.randbytes(3 << 20).hex()[: (5 << 20) + 77]
    at = (2 << 20) - 200  # across the place where pieces are cut
    other = "é" + long[at : at + 1_000] + "tail" + long[(4 << 20) - 1 : (4 << 20) + 399]
    rows = docs(spark, [long, other, long[:399], None, None, "b" * 400], [1, 2, 3, None, 4, None])
    got = {r.doc_id: r for r in suffixes.without_repeats(rows).where("doc_id is not null").collect()}
    kept = long[:at] + long[at + 1_000 : (4 << 20) - 1] + long[(4 << 20) + 399 :]
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == (len(long), 1_400, 2)
    assert got[1].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert (got[2].n_removed, got[2].n_spans, got[2].kept_sha256) == (1_400, 2, hashlib.sha256("étail".encode()).hexdigest())
    assert (got[3].n_removed, got[4].n_bytes, got[4].n_removed) == (0, 0, 0)


def test_repeats_of_nothing(spark):
    assert suffixes.without_repeats(docs(spark, []).where("false")).collect() == []


def test_merge_of_front_coded_runs():
    rng = random.Random(1)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    got = list(suffixes.merge([suffixes.decoded(suffixes.front_coded(r)) for r in runs]))
    assert [s for s, _, _ in got] == sorted(x for r in runs for x in r)
    for (a, _, _), (b, shared, _) in zip(got, got[1:], strict=False):
        assert shared == suffixes.common_prefix(a, b, 0)


# 3


def test_simhash_components(spark):
    rng = random.Random(2)
    base = [prose(rng, 60) for _ in range(6)]
    texts = [None, "", " \n", "one", "ONE", *base, *base[:2]] + [" ".join(w if rng.random() > 0.04 else "zz" for w in rng.choice(base).split()) for _ in range(40)]
    rows = docs(spark, texts, [None, *range(100, 99 + len(texts))]).withColumn("fp", F.lit(1))
    got = simhash.near_duplicates(rows).collect()
    prints = [simhash.fingerprint((t or "").encode()) for t in texts]
    ids = [None, *range(100, 99 + len(texts))]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = sorted(((ids[i] or -1), f"{prints[i]:016x}", min(ids[j] for j in range(len(ids)) if group[j] == group[i] and ids[j] is not None)) for i in range(len(ids)))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(rows.where("false")).collect() == []


def test_link_block_of_any_size():
    rng = np.random.default_rng(0)
    centers = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, 3)).astype(np.uint64), axis=1) for c in centers]))

    def parts(edges):
        root = {int(x): int(x) for x in fps}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = top(int(a)), top(int(b))
            root[max(a, b)] = min(a, b)
        return {x: top(x) for x in root}

    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = parts([(fps[a], fps[b]) for a, b in zip(*np.nonzero(close), strict=True)])
    assert parts(simhash.link_block(fps, 4)) == want


def test_one_of_each_group_stays(spark, tmp_path):
    rng = random.Random(9)
    base = [prose(rng, 200) for _ in range(8)]
    texts = [None, "", "short", "short", *base, *base[:3]]
    for b in base[:4]:
        w = b.split()
        w[50] = "changed"
        texts.append(" ".join(w))
    docs(spark, texts, [*range(len(texts))]).write.parquet(f"{tmp_path}/d")
    kept = {r.doc_id for r in nearcopies.deduplicated(spark.read.parquet(f"{tmp_path}/d"), block_rows=2).collect()}
    assert kept == {0, 2, *range(4, 12)}


def test_appended_and_replaced_blocks_are_near_copies(spark, tmp_path):
    rng = random.Random(12)
    fresh = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    texts, pairs = [], 60
    for i in range(pairs):
        w = fresh(204)
        texts.append(" ".join(w))
        # 200 of 250 or 245 shingles are shared, or 164 of 200: similarity 0.8, 0.82 and 0.82.
        texts.append(" ".join([w + fresh(50), w[:100] + fresh(15) + w[115:], w[:168]][i % 3]))
    texts.append(" ".join(fresh(204) + ["tail"]))
    docs(spark, texts).write.parquet(f"{tmp_path}/d")
    kept = {r.doc_id for r in nearcopies.deduplicated(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert kept == {*range(0, 2 * pairs, 2), 2 * pairs}


@pytest.mark.parametrize(("rows_a_block", "pairs_between"), [(4_000, 2_000), (5, 2_000), (4_000, 3)])
def test_a_large_group_keeps_all_its_links(spark, tmp_path, rows_a_block, pairs_between):
    rng = random.Random(13)
    base = [f"{rng.getrandbits(40):x}" for _ in range(404)]
    texts = []
    for i in range(60):  # each 0.85 or more like the base, under 0.8 among themselves
        w, at = list(base), rng.randint(0, 340)
        w[at : at + 30] = [f"{rng.getrandbits(40):x}" for _ in range(30)]
        texts.append(" ".join(w))
    docs(spark, [" ".join(base), *texts], [30, *range(30), *range(31, 61)]).write.parquet(f"{tmp_path}/d")
    kept = {r.doc_id for r in nearcopies.deduplicated(spark.read.parquet(f"{tmp_path}/d"), block_rows=rows_a_block, block_pairs=pairs_between).collect()}
    assert kept == {0}


def near_groups(texts, similarity=0.8):
    """The smallest number of each text's group, by brute force."""
    sets = []
    for t in texts:
        w = (t or "").encode().translate(nearcopies.FOLD).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= similarity * len(a | b) - 1e-9:
                x, y = min(group[i], group[j]), max(group[i], group[j])
                group = [x if g == y else g for g in group]
    return group


@pytest.mark.parametrize("rows_a_block", [4_000, 3])
def test_chains_of_near_copies(spark, rows_a_block):
    rng = random.Random(14)
    fresh = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    line, texts = " ".join(fresh(40)), []
    for _ in range(4):  # each like the next, the ends unlike
        w = fresh(150)
        for _ in range(8):
            texts.append(" ".join(w))
            at = rng.randint(0, 120)
            w = w[:at] + fresh(12) + w[at + 12 :]
    texts += [line + " " + " ".join(fresh(rng.randint(2, 14))) for _ in range(60)]  # a line that many share
    texts += [None, "", " \t", "one two", "ONE\ttwo", "x " * 70_000, "x " * 70_000 + "y", "one two"]
    order = rng.sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    rows = docs(spark, texts).withColumn("row", F.lit("a")).withColumn("node", F.lit("b")).withColumn("rank", F.lit(1)).repartition(7)
    got = nearcopies.deduplicated(rows, block_rows=rows_a_block).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(near_groups(texts)))
    assert {(r.row, r.node, r.rank, r.text == texts[r.doc_id]) for r in got} == {("a", "b", 1, True)}


def test_repeated_rows_and_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "g h"), (None, "g h"), (1, "k l m"), (1, "n o p")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(nearcopies.deduplicated(df).collect(), key=repr)
    assert [tuple(r) for r in got] == [(1, "k l m"), (1, "n o p"), (5, "a b c d e f"), (None, "g h")]
    assert nearcopies.deduplicated(df.where("false")).collect() == []


def test_shingles_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(15)
    texts = [prose(rng, 500).encode(), b"", b" \n ", b"x" * 300, None, b"a b", prose(rng, 3).encode().upper(), b"tail " * 40]
    want = nearcopies.shingle_sets(texts, 5)
    assert [len(s) for s in want[1:]] == [0, 0, 1, 0, 1, 1, 1]
    monkeypatch.setattr(nearcopies, "CHUNK", 64)
    assert all((a == b).all() for a, b in zip(want, nearcopies.shingle_sets(texts, 5), strict=True))


def test_similar_sets_meet_in_their_prefixes():
    rng = np.random.default_rng(16)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        both = rng.integers(0, 2**63, n, dtype=np.uint64)
        spare = int(n / 0.8) - n
        a = int(rng.integers(0, spare + 1))
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in (a, spare - a))
        assert len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
        common = np.unique(rng.choice(both, rng.integers(0, n + 1)))
        counts = rng.integers(3, 50, len(common))
        heads = [nearcopies.prefix(s, common, counts, 0.8) for s in (x, y)]
        assert len(np.intersect1d(*heads))
        assert all(len(h) <= max(28, len(s) // 5 + 1) for h, s in zip(heads, (x, y), strict=True) if not len(common))


# 4


def test_packing(spark):
    rng = random.Random(4)
    texts = [None, "", "<|endoftext|> a", "日本 ² text\x1c", prose(rng, 30_000), *[prose(rng, rng.randint(1, 900)) for _ in range(40)]]
    rows = packing.packed(docs(spark, texts).withColumn("start", F.lit("x")), tokenizer_path(), group_tokens=20_000).collect()
    plain, seen, filled = Tokenizer.from_file(tokenizer_path()), {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        at = 0
        for p in sorted(seen[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) // 4 and p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(ids) // 4
    for pieces in filled.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.packed(docs(spark, []).where("false"), tokenizer_path()).collect() == []


def test_tournament_is_first_fit():
    rng = random.Random(0)
    sizes = sorted((rng.randint(1, 100) for _ in range(200)), reverse=True)
    tree, room = packing.Tournament(200, 100), [100] * 200
    for s in sizes:
        want = next(i for i, r in enumerate(room) if r >= s)
        room[want] -= s
        assert tree.first_fit(s) == want


# 5


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op5_quality_scores"](spark, sf).collect()}
    truth = [(got[r.doc_id], r.quality) for r in table(spark, sf, "labels").collect() if r.doc_id in got]
    held = [(r, q) for r, q in truth if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r, _ in truth)
    assert sum(r.predicted == q for r, q in held) / len(held) > 0.95


def test_quality_edge_cases(spark):
    rows = docs(spark, [None, "", "a" * 100_000, "word " * 9], [None, 1, 2, 2]).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    forest = quality.learn(rows, none)
    got = quality.scored(rows, forest).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)
    same = spark.createDataFrame([(2, 1, 0), (2, None, 0), (None, 0, 0), (7, 5, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.scored(rows, quality.learn(rows, same)).collect())
    assert quality.scored(rows.where("false"), forest).collect() == []


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    f = quality.fit(x[:2000], y[:2000])
    assert ((f.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


# 6


def test_warc_round_trip(spark, tmp_path):
    page = "<p>é</p>" * 30
    rows = [(5, "u", page), (3, "u\r\nx", page), (7, None, page), (None, "n", page), (8, "s", "ab"), (9, "s", "ab"), (12, "z", None), (13, "z", ""), (3, "again", page), (20, "big", "y" * (17 << 20))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    warc.write_archives(df, f"{tmp_path}/w")
    got = sorted(((r.page_id or 0, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read_archives(spark, f"{tmp_path}/w").where("not gap").collect()), key=repr)
    want = sorted(((i or 0, "revisit" if i in (5, 7) else "response", len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), 3 if i in (5, 7) else None) for i, _, h in rows), key=repr)
    assert got == want
    warc.write_archives(df.where("false"), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").collect() == []


def test_warc_salvage():
    a = [warc.record_bytes(i, f"http://x/{i}", p := (f"<p>{i}</p>" * 50).encode(), hashlib.sha256(p).hexdigest(), None) for i in range(8)]
    wrong = bytearray(a[6])
    wrong[-20] ^= 1
    parts = [(warc.member(a[0]), 0), (b"junk \x1f\x8b\x08 WARC/", None), (warc.member(a[1])[:40], None), (warc.member(a[2]), 2), (a[3], 3), (a[4][:-30], None), (a[5], 5), (bytes(wrong), None), (warc.member(a[7]), 7), (b"\n", None)]
    data = b"".join(p for p, _ in parts)
    found = list(warc.read_archive(data))
    assert [int(h[b"warc-record-id"][10:-1]) for _, _, h, _, _ in found if h] == [k for _, k in parts if k is not None]
    assert sum(n for _, n, _, _, _ in found) == len(data)
    at = 0
    for o, n, _, _, _ in found:
        assert o == at
        at += n


def test_warc_salvage_within_members():
    a = [warc.record_bytes(i, None, p := (f"<p>{i}</p>" * 50).encode(), hashlib.sha256(p).hexdigest(), None) for i in range(4)]
    bad = bytearray(a[2])
    bad[-20] ^= 1
    one = warc.member(b"".join([a[0], a[1], bytes(bad), a[3]]))
    ids = lambda found: [int(h[b"warc-record-id"][10:-1]) for _, _, h, _, _ in found if h]
    found = list(warc.read_archive(b"junk" + one + warc.member(a[2])))
    assert ids(found) == [0, 1, 3, 2]
    gaps = [(o, n, why) for o, n, h, _, why in found if h is None]
    assert gaps[0][:2] == (0, 4) and gaps[1][:2] == (4, len(one)) and len(gaps) == 2
    assert gaps[1][2] == f"block digest at {len(a[0]) + len(a[1])}, {len(a[2])} bytes of the member's content"
    noise = random.Random(1).randbytes(200_000)  # does not shrink, so that a cut falls into the last record
    last = warc.record_bytes(9, None, noise, hashlib.sha256(noise).hexdigest(), None)
    cut = warc.member(b"".join([a[0], a[1], a[3], last]))[:-20]
    found = list(warc.read_archive(cut + warc.member(a[2])))
    assert ids(found) == [0, 1, 3, 2] and [h for _, _, h, _, _ in found].count(None) >= 1
    broken = bytearray(warc.member(b"".join([a[0], a[1], a[3], last])))
    broken[len(broken) // 2 : len(broken) // 2 + 50] = b"\xff" * 50
    assert ids(warc.read_archive(bytes(broken) + warc.member(a[2]))) == [0, 1, 3, 2]


# 7


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark):
    rng = random.Random(0)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = [None, "", f"é😀 token = \"{hexes}\" x", "TOKEN=token:abcdefgh", "token=abc token=abcdefg secret:'x' api_key: 123456", "AKIA" + "Z9" * 9, "AKIAAKIA" + "Q" * 15, f"see {key} and the_long_identifier_name_2024 here", hexes * 3, "a1" * 50_000, f"😀 api-{key} password='{key}'"]
    rows = docs(spark, texts).withColumn("secrets", F.lit(1))
    model = secretscan.train(secretscan.labelled_samples(table(spark, "/root/testdata/sf0.001", "documents")))
    got = {r.doc_id: r for r in secretscan.secret_spans(rows, model).withColumn("clean", secretscan.redacted(F.col("text"), F.col("secrets"))).collect()}
    for i, t in enumerate(texts):
        spans = [tuple(s)[:3] for s in got[i].secrets]
        assert all((t[: s.start].encode(), t[: s.end].encode()) == (t.encode()[: s.byte_start], t.encode()[: s.byte_end]) for s in got[i].secrets)
        assert [s for s in spans if s[1] < 3] == base_spans(t or "")
        assert spans == sorted(spans)
    more = [texts[7][s.start : s.end] for s in got[7].secrets]
    assert more == [key]
    assert got[7].clean == "see [SECRET] and the_long_identifier_name_2024 here"
    assert got[0].clean is None and hexes not in got[2].clean and key not in got[10].clean
    assert secretscan.secret_spans(rows.where("false"), model).collect() == []


def test_markov_spans_against_a_plain_scorer(spark):
    rng = random.Random(21)
    some = table(spark, "/root/testdata/sf0.01", "documents").select("text").limit(150).collect()
    alphabets = [secretscan.LETTERS, "0123456789abcdef", "abcdefghij_-/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    made = [" ".join("".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(15, 60))) for _ in range(20)) for _ in range(40)]
    texts = [r.text for r in some] + made + ["x" * 30 + "1" + hashlib.sha256(b"a").hexdigest() + "Zz" * 12, "token=" + "Ab3/" * 9 + "," + "Q9x" * 11]
    model = secretscan.train(secretscan.labelled_samples(docs(spark, texts)))
    n, letters = len(secretscan.LETTERS), secretscan.LETTERS
    got = {r.doc_id: r.secrets for r in secretscan.secret_spans(docs(spark, texts), model).collect()}
    listed = 0
    for i, text in enumerate(texts):
        base = base_spans(text or "")
        want = []
        for m in re.finditer(secretscan.TOKEN.replace("*+", "*"), text or ""):
            places = [letters.index(c) for c in m[0]]
            score = sum(model[a * n + b] for a, b in zip(places, places[1:], strict=False))
            if score >= 12 and not any(s <= m.start() and m.end() <= e for s, _, e in base):
                want.append((m.start(), 3, m.end()))
        assert [tuple(s)[:3] for s in got[i] if s.kind == 3] == want
        listed += len(want)
    assert listed > 100


# 8


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for key, item in items:
        own = words(item)
        n = min(10, len(own))
        wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(w) - n + 1 if own else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(key))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 25, 200])
def test_contamination(spark, block):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(12)] + [(3, "b a b a " * 10), (50, "same here now"), (51, "SAME, here. now"), (60, ""), (61, None), (70, "a a a a a a a a a a a a")]
    texts = [None, "", "a " * 300, "b a " * 40, "x same HERE-now y"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = (rng.choice(items)[1] or "").split()
            a, b = sorted((rng.randint(0, len(w)), rng.randint(0, len(w))))
            parts += w[a:b] + prose(rng, rng.randint(0, 6)).split()
        texts.append(" ".join(parts))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("body", F.lit(1))
    rows = docs(spark, texts).withColumn("items", F.lit("x"))
    got = {r.doc_id: r for r in winnowing.matched_runs(rows, bench, block_bytes=block).withColumn("n", winnowing.hit_words()).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n, got[i]["items"]) == brute_hits(t, items), t
    assert all(not r["items"] for r in winnowing.matched_runs(rows, bench.where("false")).collect())
    assert winnowing.matched_runs(rows.where("false"), bench).collect() == []


def test_contamination_by_repeated_words_and_long_texts(spark):
    n = 100_000
    items = [(1, "la " * n), (2, "la " * 9), (3, "la " * 11 + "end"), (4, "ko mi ru"), (4, None), (None, "la " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["la " * n, "x " * n + "la " * 10 + "end", "la " * 8, "KO-mi ru " * 3, None, "la " * 8]
    rows = docs(spark, texts, [0, 1, 2, 3, None, 2])
    got = winnowing.matched_runs(rows, bench).withColumn("n", winnowing.hit_words()).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n, ",".join(r["items"])) for r in got)) == [(-1, 0, 0, ""), (0, n, n, "1,2,3"), (1, n + 11, 11, "1,2,3"), (2, 8, 0, ""), (2, 8, 0, ""), (3, 9, 9, "4")]


# 9


def test_chat(spark):
    rows = [(1, 0, "user", "a\\b\\+<+>[x] \\l"), (1, 1, "user", "b </s>"), (1, 2, "assistant", ""), (1, 3, "assistant", "]"), (1, 4, "to]ol[:", " x "), (2, None, None, None), (None, 1, "assistant", "q"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (4, 1, "", "é😀"), (5, 1, "SYS", "1"), (5, 2, "/INST", "\n"), (6, 2, "assistant", "2" * 50_000), (6, 1, "system", "s")]
    df = chat.formatted(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int"))
    out = df.select("conv_id", "formatted", "loss_mask", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert len(out) == 7
    for r in out:
        want = sorted(((t if t is not None else -1, q or "", x or "") for c, t, q, x in rows if c == r.conv_id))
        assert [tuple(t) for t in r.turns] == [w[1:] for w in want]
        assert r.loss == "".join(x for _, q, x in want if q == "assistant")
        for m in r.loss_mask:
            assert r.formatted[m.start : m.end] in [x.replace("\\", "\\b").replace("<", "\\l").replace("[", "\\k") for _, q, x in want if q == "assistant"]


# 10


@pytest.mark.parametrize("rows_a_shard", [100_000, 40])
def test_neighbours_are_exact(spark, rows_a_shard):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6)) * rng.uniform(0.1, 50, (300, 1))
    x[40:140] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] + [1.0] * 5), (904, [float("inf")] * 6), (905, [1.0]), (None, [1.0] * 6), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in vptree.nearest(df, df.where("vec_id % 20 = 0"), k=10, shard_rows=rows_a_shard, query_rows=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 300, 20):
        s = np.cumsum(x[q] * x, axis=1)[:, -1]
        best = [j for j in np.lexsort((np.arange(300), -s)) if j != q][:10]
        assert sorted(got[q]) == [(k + 1, int(j), float(s[j])) for k, j in enumerate(best)]
    assert set(got) == set(range(0, 300, 20))
    assert vptree.nearest(df.where("false"), df).collect() == []


@pytest.mark.parametrize("rows_a_shard", [100_000, 40])
def test_repeated_rows_take_one_place(spark, rows_a_shard):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 6))
    near = x[0] * 3
    # 500 is repeated; 501 has many vectors, all nearer than any other row; so has the query's own id.
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, near.tolist())] * 30
    rows += [(501, (near * (2 + j / 10)).tolist()) for j in range(30)] + [(0, (near * (9 + j)).tolist()) for j in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vptree.nearest(df, df.limit(1), k=10, shard_rows=rows_a_shard).collect()
    best = {}
    for i, v in rows:
        if i:
            best[i] = max(best.get(i, -math.inf), float(np.cumsum(x[0] * np.array(v))[-1]))
    want = sorted(best, key=lambda i: (-best[i], i))[:10]
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(n + 1, i, best[i]) for n, i in enumerate(want)]


def test_relaxed_pruning_keeps_recall(spark, sf):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings")
    ask = rows.where("vec_id % 20 = 0")
    exact, loose = ({(r.query_id, r.vec_id) for r in vptree.nearest(rows, ask, k=20, factor=f).collect()} for f in (1.0, 1.1))
    assert len(exact & loose) / len(exact) >= 0.9


def test_forest_against_a_plain_traversal():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 7))
    x[::9, 3] = 0.0
    y = (x[:, 0] + x[:, 3] * x[:, 1] > 0.2).astype(float)
    forest = quality.fit(x, y, trees=20)
    inner = forest.feature.shape[1]
    for row, got in zip(x, forest.score(x), strict=True):
        total = forest.base
        for feature, split, value in zip(forest.feature, forest.split, forest.value, strict=True):
            at = 0
            while at < inner:
                at = 2 * at + (2 if row[feature[at]] > split[at] else 1)
            total += value[at - inner]
        assert abs(got - 1 / (1 + math.exp(-total))) < 1e-12
    assert ((forest.score(x) >= 0.5) == (y == 1)).mean() > 0.95
