"""The stages of the corpus pipeline against brute force, each on its own input."""

import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cropmill.llm.queries import table, tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage at the smallest size."""
    sf = "/root/testdata/sf0.01"
    docs, out = table(spark, sf, "documents"), []
    at = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out.append((name, before.collect(), docs.collect(), docs.columns))
    return {n: (b, a, c) for n, b, a, c in out}


def test_columns(stages):
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    for name in list(stages)[:-1]:
        assert sorted(stages[name][2]) == sorted(corpus_pipeline.COLUMNS)


def test_quality_keeps_clean_documents(spark, stages):
    before, after, _ = stages["quality"]
    kept = {r.doc_id for r in after}
    truth = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    judged = [(r.doc_id in kept, truth[r.doc_id]) for r in before if r.doc_id in truth]
    assert sum(k == bool(q) for k, q in judged) / len(judged) > 0.97


def test_one_of_each_group_of_near_copies(stages):
    before, after, _ = stages["near_duplicates"]
    sets = {}
    for r in before:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if j < i and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in after} == {top(i) for i in ids}


def test_contaminated_documents_go(spark, stages):
    before, after, _ = stages["decontamination"]
    wins = set()
    for r in table(spark, "/root/testdata/sf0.01", "benchmark").collect():
        w = words(r.text)
        n = min(10, len(w))
        wins |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(x) for x in wins}
    clean = [r for r in before if not any(tuple(w[i : i + n]) in wins for w in [words(r.text)] for n in sizes for i in range(len(w) - n + 1))]
    assert sorted(clean, key=lambda r: r.doc_id) == sorted(after, key=lambda r: r.doc_id)


def test_secrets_are_redacted(stages):
    before, after, _ = stages["secrets"]
    now = {r.doc_id: r for r in after}
    assert len(now) == len(before)
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""", re.I | re.A)
    for r in before:
        if pattern.search(r.text):
            assert "[SECRET]" in now[r.doc_id].text and now[r.doc_id].n_chars == len(now[r.doc_id].text)
        else:
            assert now[r.doc_id] == r
    assert not any(re.search(r"[0-9a-f]{24}", r.text) for r in after)


def test_packing_holds_every_token(stages):
    before, after, _ = stages["packing"]
    plain = Tokenizer.from_file(tokenizer_path())
    want = {r.doc_id: len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
    got = {}
    for p in after:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want


EDGE = [
    (1, None, "en", "web", 0),
    (None, "a small text without an id", None, None, None),
    (None, "a small text without an id", None, None, None),
    (2, "", None, "web", 0),
    (3, "plain words " * 30_000, "en", None, None),
    (4, "plain words " * 30_000, "en", None, None),
    (5, "the door: password=hunter2hunter2 is here", "en", "web", 41),
    (5, "the door: password=hunter2hunter2 is here", "en", "web", 41),
    (6, "\x00\uffff é 漢字 \t\r\n", "xx", "web", 9),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_edge_cases(spark, tmp_path, name):
    sf, stage = "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)[name]
    plain = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    rows = plain
    for c in ("clean", "secret_spans", "quality_score", "row", "rank", "body", "id", "node", "runs"):
        rows = rows.withColumn(c, F.lit("clash"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    out = stage(spark, docs, sf).collect()
    none = stage(spark, docs.where("false"), sf)
    assert none.collect() == []
    if name == "packing":
        ids = {r.doc_id for r in out}
        assert ids == {None, 1, 2, 3, 4, 5, 6}
        return
    assert none.columns == list(corpus_pipeline.COLUMNS)
    got = sorted((tuple(r) for r in out), key=repr)
    if name == "near_duplicates":  # of equal texts (null and empty ones too) and of repeated rows one stays
        assert got == sorted((EDGE[i] for i in (0, 1, 4, 6, 8)), key=repr)
    elif name == "decontamination":
        assert got == sorted(EDGE, key=repr)
    elif name == "secrets":
        clean = [(*r[:1], "the door: [SECRET] is here", *r[2:4], 26) if r[0] == 5 else r for r in EDGE]
        assert got == sorted(clean, key=repr)
    else:
        assert set(got) <= set(EDGE) and all(got.count(r) in (0, EDGE.count(r)) for r in EDGE)
