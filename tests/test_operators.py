"""Invariants and brute force for what SQL can't express, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropmill.functions import text
from cropmill import cli
from cropmill.operators import calibration, clustering, curation, features, ivf, knn, outputs, reduction
from cropmill.operators.graph import connected_components
from cropmill.operators.groups import farthest_first
from cropmill.plans import views
from cropmill.sources import export, labels, logs, records
from cropmill.streaming import frames


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize(("seed", "small"), [(0, 0), (1, 0), (1, 20), (2, 1_000_000)])
def test_components(spark, seed, small):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), small=small).collect()}
    want = brute_components([e for e in edges if e[0] != e[1]])
    assert got == want


def test_components_of_nothing(spark):
    none = spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")
    assert connected_components(none).collect() == []


def test_knn_ties_and_metrics(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None)]
    df = spark.createDataFrame(rows, "record_idx long, feature array<double>")
    ip = {(r.record_idx, r.rank): r.neighbor_idx for r in knn.knn_join(df, df, 2, query_rows=2, base_rows=2).collect()}
    assert ip[1, 1] == 2 and ip[1, 2] == 3 and ip[2, 1] == 3
    cos = {(r.record_idx, r.rank): r.neighbor_idx for r in knn.knn_join(df, df, 2, metric="cosine").collect()}
    assert cos[3, 1] == 1 and cos[3, 2] == 2
    with pytest.raises(ValueError):
        knn.knn_join(df, df, 2, metric="l7")


def test_star_cover_properties(spark, sf):
    own, near = views.records(spark, sf), views.neighbors(spark, sf, 30)
    edges = reduction.tight_edges(near, own, views.NEAR)
    pairs = {(r.record_idx, r.neighbor_idx) for r in edges.collect()}
    found = reduction.reduction_members(edges, own, reduction.protected_ids(near, own, views.CROSS)).collect()
    assert len({r.record_idx for r in found}) == len(found)
    for r in found:
        rep = r.primary_representative_idx
        assert r.record_idx == rep or (min(rep, r.record_idx), max(rep, r.record_idx)) in pairs
        assert (r.action == "KEEP_REPRESENTATIVE") == (r.record_idx == rep)
    covered = {r.record_idx for r in found}
    assert not [p for p in pairs if p[0] not in covered and p[1] not in covered]


def test_star_cover_order():
    edges = [(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9), (4, 5, 0.95)]
    cover = reduction.star_cover(edges)
    assert [rep for rep, _ in cover] == [4, 1] and [n for n, _ in cover[0][1]] == [4, 3, 5]


def test_higher_threshold_gives_fewer_edges(spark, sf):
    own, near = views.records(spark, sf), views.neighbors(spark, sf)
    few, many = ({(r.record_idx, r.neighbor_idx) for r in curation.near_duplicate_edges(near, own, t).collect()} for t in (0.99, 0.9))
    assert few < many


def test_ivf_recall(spark, sf, tmp_path):
    rows = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("record_idx"), F.col("embedding").cast("array<double>").alias("feature"))
    index = ivf.build(rows, nlist=16, m=8, train=1_000)
    assert index.rows.count() == rows.count() and len(index.books) == 8 and all(len(b) <= 256 for b in index.books)
    index.save(f"{tmp_path}/index")
    queries = rows.where("record_idx % 10 = 0")
    want = {(r.record_idx, r.neighbor_idx) for r in knn.knn_join(queries, rows, 10, metric="cosine").collect()}
    found = ivf.open_index(spark, f"{tmp_path}/index").search(queries, 10, 10, 100, block_rows=64).collect()
    assert len(found) == len(want)
    assert len(want & {(r.record_idx, r.neighbor_idx) for r in found}) / len(want) >= 0.9
    few = rows.where("record_idx < 3").unionByName(spark.createDataFrame([(99, None)], "record_idx long, feature array<double>"))
    assert {(r.record_idx, r.rank) for r in ivf.build(few, 2, 8, 10).search(few, 5, 4, 9).collect()} == {(i, k) for i in range(3) for k in (1, 2)}
    assert ivf.plan(500)["type"] == "flat" and ivf.plan(1_000_000)["m"] == 64


def arrow_rows(plan):
    """Rows that each MapInArrow of an executed plan gave."""
    name = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("pythonNumRowsReceived").value()] if name == "MapInArrowExec" else []
    return own + [n for p in below for n in arrow_rows(p)]


def test_ivf_of_all_rows_gives_few_pairs(spark, sf, tmp_path):
    rows = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("record_idx"), F.col("embedding").cast("array<double>").alias("feature"))
    rows = rows.union(rows.select(F.col("record_idx") + 1_000, "feature")).union(rows.where("record_idx = 20").select(F.explode(F.sequence(F.lit(2_000), F.lit(2_099))), "feature")).coalesce(1)
    queries = rows.where("record_idx % 10 = 0").coalesce(1)
    ivf.build(rows, nlist=2, m=8, train=500).save(f"{tmp_path}/index")
    index = ivf.open_index(spark, f"{tmp_path}/index")
    want = {(r.record_idx, r.neighbor_idx, r.rank) for r in knn.knn_join(queries, rows, 3, metric="cosine").collect()}
    assert index.size == 1_100 and len(want) == 3 * 110
    for rerank_k in (1_100, 1 << 30):
        found = index.search(queries, 3, 2, rerank_k)
        assert {(r.record_idx, r.neighbor_idx, r.rank) for r in found.collect()} == want
        assert max(arrow_rows(found._jdf.queryExecution().executedPlan())) <= 3 * 110 * 2 * 4


def test_best_pairs_against_all_pairs():
    rng = np.random.default_rng(3)
    b = rng.normal(size=(40, 4))
    b[20:30], b[39, 1] = b[0], np.nan
    ids = rng.permutation(40)
    unit = b / np.sqrt((b * b).sum(axis=1, keepdims=True))
    for k in (1, 5, 50):
        got = [(int(x), int(y)) for part in ivf.best_pairs(b, b, ids, ids, k, most=70) for x, y in zip(*part[:2], strict=True)]
        want = []
        for i in range(40):
            cosine = np.cumsum(unit[i] * unit, axis=1)[:, -1]
            others = sorted((j for j in range(40) if j != i), key=lambda j: (-np.inf if np.isnan(cosine[j]) else -cosine[j], ids[j]))
            want += [(int(ids[i]), int(ids[j])) for j in others[:k]]
        assert got == want
        every = [part for a in range(0, 40, 7) for part in ivf.best_pairs(b, b[a : a + 7], ids, ids[a : a + 7], k)]
        for most in (20, 500, 10**6):  # emitted early, merged again and again, merged once
            held = [x.to_pydict().values() for x in ivf.merged(iter(every), k, most)]
            own = ivf.first(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
            assert sorted(zip(*own[:2], strict=True)) == sorted(want) and (most < 10**6 or sum(len([*h][0]) for h in held) == len(want))


def test_ivf_vectors_keep_every_bit(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4)).astype(np.float32).astype(float)
    x[::3] += 1e-12  # these need double precision
    x[5, 0] = 1e300
    for v in (x, x[1::3]):
        assert [ivf.unpacked(b, 1, 4)[0].tolist() for b in ivf.packed_vectors(v)] == v.tolist()
    assert {len(b) for b in ivf.packed_vectors(x)} == {16, 32}
    assert ivf.unpacked(b"".join(ivf.packed_vectors(x[1:2])) * 3, 3, 4).tolist() == [x[1].tolist()] * 3
    x[5, 0] = 1.5
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "record_idx long, feature array<double>").coalesce(1)
    want = {tuple(r) for r in knn.knn_join(rows, rows, 4, metric="cosine").select("record_idx", "neighbor_idx", "similarity", "rank").collect()}
    index = ivf.build(rows, 2, 2, 60)
    assert all(len(r.v) == (32 if r.record_idx % 3 == 0 else 16) for r in index.rows.collect())
    old = ivf.Index(index.rows.drop("v").join(rows.withColumnRenamed("feature", "v"), "record_idx"), index.centers, index.books, index.size)
    for own in (index, old):
        assert {tuple(r) for r in own.search(rows, 4, 2, 60).collect()} == want
        assert own.search(rows, 4, 1, 4).count() > 0


def test_density_and_tree_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (40, 2)) for c in ((0, 0), (3, 3), (0, 4))] + [np.array([[9.0, 9.0]])])
    labels_ = clustering.hdbscan(x, 10, 5)
    assert len({tuple(set(labels_[i * 40 : i * 40 + 40])) for i in range(3)}) == 3 and labels_[-1] == -1
    assert len(set(clustering.birch(x[:120], 0.5, 3))) == 3


@pytest.mark.parametrize("method", ["kmeans", "birch", "hdbscan"])
def test_scoped_clusters(spark, method):
    rng = np.random.default_rng(1)
    spots = {"a": [(0, 0), (5, 5)], "b": [(0, 0), (9, 0)]}
    rows = [(i, name, at, (np.array(spots[name][at]) + rng.normal(0, 0.1, 2)).tolist()) for i, (name, at) in enumerate((n, a) for n in spots for a in (0, 1) for _ in range(40))]
    df = spark.createDataFrame(rows, "record_idx long, class_name string, spot int, feature array<double>").repartition(5)
    got = clustering.cluster(df, method, 4 if method == "hdbscan" else 2, "per_class", most=50).select("class_name", "spot", "cluster_label").collect()
    assert len(got) == len(rows)
    found = {(r.class_name, r.spot): set() for r in got}
    for r in got:
        found[r.class_name, r.spot].add(r.cluster_label)
    if method == "hdbscan":
        found = {k: v - {"a / noise", "b / noise"} for k, v in found.items()}
    assert all(len(x) == 1 for x in found.values()) and len(set.union(*found.values())) == 4
    assert clustering.cluster(df.where("false"), method, 2, "per_class").collect() == []


def test_kmeans_and_components_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 4, 1))]) * (3, 2, 1)
    df = spark.createDataFrame([(i, "c", v.tolist()) for i, v in enumerate(x)], "record_idx long, class_name string, feature array<double>")
    for scope in ("global", "per_class"):
        labels_ = {r.record_idx: r.cluster_id for r in clustering.cluster(df, "kmeans", 3, scope).collect()}
        own = np.array([labels_[i] for i in range(len(x))])
        inertia = sum(((x[own == c] - x[own == c].mean(axis=0)) ** 2).sum() for c in set(own))
        truth = np.repeat([0, 1, 2], 60)
        assert inertia <= 1.05 * sum(((x[truth == c] - x[truth == c].mean(axis=0)) ** 2).sum() for c in range(3))
    got = np.array([r.pc for r in clustering.projection(df, 3).orderBy("record_idx").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    vt *= np.sign(vt[range(3), np.abs(vt).argmax(axis=1)])[:, None]
    assert np.allclose(got, (x - x.mean(axis=0)) @ vt.T, atol=1e-8)


def test_large_trees_and_densities_are_feasible():
    x = np.random.default_rng(3).normal(size=(4_000, 16))
    assert len(set(clustering.birch(x, 0.5, 4))) == 4
    assert len(clustering.hdbscan(x, 50, 5)) == 4_000


def test_label_sources_and_export(spark, tmp_path):
    root = tmp_path / "set"
    for folder in ("a/JPEGImages", "a/labels", "b/c/images", "b/c/labels", "lone/images"):
        (root / folder).mkdir(parents=True)
        (root / folder / ("x.txt" if folder.endswith("labels") else "x.jpg")).write_bytes(b"0 .5 .5 .1 .1\n")
    pairs = {(r.images_root.split("set/")[1], r.labels_root.split("set/")[1]) for r in labels.label_pairs(spark, str(root)).collect()}
    assert pairs == {("a/JPEGImages", "a/labels"), ("b/c/images", "b/c/labels")}
    assert labels.image_label_sources(spark, str(root), layout="nested").count() == 2
    assert labels.image_label_sources(spark, str(root)).count() == 3
    walk = spark.createDataFrame([("r/b/x",), ("r/z",), ("r/a",), ("r/a/q",)], "p string").orderBy(labels.depth_first(F.col("p"))).collect()
    assert [r.p for r in walk] == ["r/a", "r/z", "r/a/q", "r/b/x"]
    image, label = f"{root}/a/JPEGImages/x.jpg", f"{root}/a/labels/x.txt"
    plan = [(image, label, "KEEP_IMAGE", "KEEP_OR_REVIEW"), (f"{root}/gone.jpg", f"{root}/gone.txt", "KEEP_IMAGE", "KEEP_OR_REVIEW"), ("d.jpg", "d.txt", "DROP_IMAGE_CANDIDATE", "SAFE_ONLY_IN_FULL_PLAN")]
    images = spark.createDataFrame(plan, "image_path string, label_path string, image_action string, drop_safety string")
    (tmp_path / "data.yaml").write_text("names: [cat, it's]\n")
    row = export.export_reduced(spark, images, f"{tmp_path}/out", str(root), str(root), f"{tmp_path}/data.yaml", "copy").first()
    assert (row.kept_images, row.drop_image_candidates, row.copied_images, row.missing_images, row.copied_labels, row.missing_labels) == (2, 1, 1, 1, 1, 1)
    assert (tmp_path / "out/images/a/JPEGImages/x.jpg").exists() and (tmp_path / "out/labels/a/labels/x.txt").exists()
    assert "it''s" in "".join(r.value for r in spark.read.text(f"{tmp_path}/out/reduced_data.yaml").collect())
    assert records.read_summary(spark, f"{tmp_path}/out/reduced_dataset_summary.json").first()["mode"] == "copy"
    assert records.read_summary(spark, f"{tmp_path}/none").count() == 0


def test_search_by_box_and_frames(spark):
    make = lambda: lambda path, boxes: [np.array([1.0, b[2] - b[0]]) for b in boxes]
    base = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "record_idx long, feature array<double>")
    assert [r.neighbor_idx for r in features.search_box(spark, base, make, "p", (640, 480), (0, 0, 3, 3), 2).orderBy("rank").collect()] == [1, 2]
    assert features.search_box(spark, base, make, "p", (640, 480), None, 1).first().similarity == 640.0
    assert [features.batch_size(g) for g in (None, 4, 10, 16, 80)] == [1, 2, 4, 6, 8]
    frames_ = spark.createDataFrame([("v", 1, b"a"), ("v", 2, b"b")], "video string, frame_index long, content binary")
    assert records.read_frame(frames_, "v", 2).first().content == bytearray(b"b") and records.read_frame(frames_, "v", 9).count() == 0


def test_command_line(spark, sf, tmp_path):
    rows = views.records(spark, sf)
    rows.drop("feature", "embedding").write.parquet(f"{tmp_path}/records")
    rows.select("record_idx", "feature").write.parquet(f"{tmp_path}/features")
    for command, more, tables in (("curate", ["--max-records", "40"], 12), ("reduce", [], 8), ("calibrate", ["--class-filter", "class_3"], 4), ("search", ["--record", "7"], 1)):
        cli.main([command, "--records", f"{tmp_path}/records", "--features", f"{tmp_path}/features", "--out", f"{tmp_path}/{command}", "--top-k", "5", *more])
        assert len(list((tmp_path / command).iterdir())) == tables
    row = spark.read.json(f"{tmp_path}/curate/summary").first()
    assert (row.total_records, row.sampled_records, row.partial_report) == (rows.count(), 40, True)


def test_farthest_first():
    x = np.array([[1.0, 0], [0.9, 0.1], [0, 1.0], [-1.0, 0]])
    taken = farthest_first(x, [10, 11, 12, 13], 3)
    assert len(set(taken)) == 3 and 13 in taken


def test_label_text(spark):
    files = spark.createDataFrame([("labels/a/X.txt", "\n1 .5 .5 .1 .1\ninf 1 1 1 1\n2 a 1 1 1\n3 0.5 0.5 0.2 0.2 9"), ("labels/b.txt", "")], "label_path string, content string")
    rows = labels.parse_labels(files).collect()
    assert [(r.annotation_line, r.class_id) for r in rows] == [(1, 1), (4, 3)]
    images = spark.createDataFrame([("images/a/x.png",), ("images/a/X.JPG",), ("images/c.jpg",)], "image_path string")
    got = {r.label_path: r.image_path for r in labels.match_images(files, images).collect()}
    assert got == {"labels/a/X.txt": "images/a/X.JPG", "labels/b.txt": None}


def test_records_round_trip(spark, sf, tmp_path):
    rows = views.records(spark, sf).select("record_idx", "image_path", "bbox", "class_id")
    records.write_records(rows, f"{tmp_path}/r.json-lines", "json")
    back = spark.read.json(f"{tmp_path}/r.json-lines")
    assert back.count() == rows.count()
    records.write_shards(rows, f"{tmp_path}/shards", 4)
    spread = spark.read.parquet(f"{tmp_path}/shards").groupBy("image_path").agg(F.count_distinct("shard").alias("n"))
    assert spread.where("n > 1").count() == 0


def test_class_ids_and_durations(spark):
    assert text.class_ids("1, 2;x 3.0 inf") == [1, 2, 3]
    row = spark.range(1).select(text.duration_seconds(F.lit("1h 02m 3s")).alias("a"), text.duration_seconds(F.lit("none")).alias("b"), text.slug(F.lit("..")).alias("c")).first()
    assert tuple(row) == (3723, None, "project")


def test_stream(spark, sf, tmp_path):
    views.table(spark, sf, "events").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    rows = frames.sampled_frames(stream, 7, "event_id")
    q = rows.writeStream.format("memory").queryName("sampled").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("sampled").count() == spark.read.parquet(f"{tmp_path}/in").where("event_id % 7 = 0").count()
    own = views.records(spark, sf)
    got = []
    queries = own.limit(5).select("record_idx", "feature")
    queries.write.parquet(f"{tmp_path}/q")
    s = spark.readStream.schema(queries.schema).parquet(f"{tmp_path}/q")
    q = frames.search_each_batch(s, own, 3, lambda df, n: got.extend(df.collect()), f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    assert len(got) == 15


def test_record_store(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        records.open_store(spark, str(tmp_path))
    (tmp_path / "records.jsonl").write_text('{"record_idx": 0, "class_id": 9, "bbox_xyxy": [1, 2, 3, 4]}\n')
    assert [r.class_id for r in records.open_store(spark, str(tmp_path)).collect()] == [9]
    (tmp_path / "records.json").write_text('[{"record_idx": 0, "class_id": 1, "bbox_xyxy": [1, 2, 3, 4]}, {"record_idx": 7, "class_id": 2, "bbox_xyxy": [0, 0, 5, 6]}]')
    rows = records.open_store(spark, str(tmp_path))  # the array comes before the lines
    assert [(r.class_id, tuple(r.bbox)) for r in records.fetch(rows, 7, 8).collect()] == [(2, (0, 0, 5, 6))]


def test_no_records_give_empty_results(spark, sf):
    none = views.records(spark, sf).where("record_idx < 0")
    near = knn.knn_join(none, none, 5)
    assert near.count() == 0
    for tables in (outputs.curation_outputs(none, none, near, 0.9, 0.9, 5, 2, False), outputs.reduction_outputs(none, none, near, 0.9, 0.9, 1, False)):
        assert {name: t.count() for name, t in tables.items() if name != "summary" and t.count()} == {}
        assert tables["summary"].count() == 1
    detail = calibration.detail(near, none)
    assert detail.count() == 0 and calibration.bins(detail).count() == 0 and calibration.thresholds(detail).count() == 0
    assert calibration.sampled_detail(none, 5, 1).count() == 0
    for method in ("kmeans", "bisecting", "birch", "hdbscan"):
        done = clustering.cluster(clustering.projection(none, 3), method, 4)
        assert done.count() == 0 and clustering.summarize(done).count() == 0


def test_build_summary_of_more_than_the_total(spark):
    def summary(rows, **options):
        return tuple(logs.build_summary(spark.createDataFrame(rows, "done long, total long, eta_seconds long, exit_code int"), **options).first())

    over = [(30, 10, 5, None), (10, 10, 7, None)]
    assert summary(over) == (2, 40, 20, 7, "Encoding features", 1.0) and summary(over, bounded=False) == (2, 40, 20, 7, "Encoding features", 2.0)
    assert summary([(10, 10, 0, 0)], bounded=False) == (1, 10, 10, 0, "Encoding features", 1.0)
    assert summary([(5, 10, 3, 1)])[4:] == ("Failed", 0.5) and summary([])[:5] == (0, 0, 0, None, "Not started")


def test_build_progress_rollup_of_more_events(spark):
    import duckdb

    from cropmill.plans import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    c.sql("create view events as select * from '/root/testdata/sf0.1/events.parquet'")
    df = QUERIES["build_progress_rollup"](spark, "/root/testdata/sf0.1")
    rel = c.sql(ORACLE_SQL["build_progress_rollup"])
    assert rel.columns == df.columns and rel.fetchall() == [tuple(r) for r in df.collect()]
