"""Operators that SQL cannot express, and their edge cases."""

import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecspan.functions import schedules
from vecspan.operators import evaluate, frame, knn, local, model, normalize, optimize, pairs, quantize, stats
from vecspan.sources import readers, writers


def table(spark, x, labels=None):
    x = np.asarray(x, float)
    rows = [(i, [float(v) for v in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int")


def brute(x, k, metric):
    n, out = len(x), []
    for i in range(n):
        d = knn.pair_distance(np.repeat(x[i : i + 1], n, 0), x, metric)
        out += [(i, int(j), r + 1) for r, j in enumerate([j for j in np.lexsort((np.arange(n), d)) if j != i][:k])]
    return sorted(out)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan", "correlation", "hamming"])
def test_block_forms_agree(spark, metric):
    x = np.round(np.random.default_rng(1).normal(size=(60, 5)), 1)
    df = table(spark, x)
    got = sorted((r.i, r.j, r.rank) for r in knn.knn_block(df, df, 4, metric).collect())
    assert got == brute(x, 4, metric)
    nested = sorted((r.i, r.j, r.rank) for r in knn.knn_block(df, df, 4, metric, broadcast_bytes=0).collect())
    assert nested == got


def test_repeated_rows_keep_all_ties(spark):
    x = np.ones((40, 3))
    df = table(spark, x)
    got = knn.knn_block(df, df, 3).where("i = 39").orderBy("rank").collect()
    assert [r.j for r in got] == [0, 1, 2]


def test_inverted_file_recall(spark):
    x = np.random.default_rng(2).normal(size=(300, 8))
    df = table(spark, x)
    exact = knn.knn_block(df, df, 5)
    assert knn.recall(exact, knn.knn_ivf(df, df, 5, cells=8, probe=6), 5).first()[0] > 0.9


def test_two_tiers_of_the_loop_agree(spark):
    rng = np.random.default_rng(3)
    i, j, kind = rng.integers(0, 30, 200), rng.integers(0, 30, 200), rng.integers(0, 3, 200)
    keep = i != j
    i, j, kind = i[keep], j[keep], kind[keep]
    y = rng.normal(size=(30, 2))
    local = optimize.local_loop(y, i, j, kind, (5, 5, 10), optimize.Adam())
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(i, j, kind)], "i long, j long, kind long").repartition(20)
    far = optimize.distributed_loop(y, df, (5, 5, 10), optimize.Adam(), len(i))
    assert np.abs(local.y - far.y).max() < 1e-8


@pytest.mark.parametrize("more", [{}, {"metric": "cosine", "neighbors": 4}, {"init": "pca"}, {"reduce": 3}, {"rounded": True, "snapshots": (0, 3, 7)}, {"neighbors": 2, "mn_ratio": 2.0}])
def test_one_process_and_data_frames_agree(spark, monkeypatch, more):
    """The same pairs, counts, statistics and places, whichever way a table is fitted and new rows are placed."""
    df = table(spark, np.random.default_rng(14).normal(size=(70, 6))).withColumn("id", F.col("id") * 3 - 5)
    new = table(spark, np.random.default_rng(15).normal(size=(9, 6)))
    p = model.Params(**({"neighbors": 5, "seed": 7, "iters": (2, 2, 3)} | more))

    def fitted():
        m = model.EmbeddingEstimator(p, keep_pairs=True).fit(df)
        scored = [(r.id, r.nn_ids, r.outlier_level) for r in m.transform_with_safety(new).orderBy("id").collect()]
        return m, sorted(map(tuple, m.pairs.select("i", "j", "kind").collect())), np.array([r.y for r in m.embedding.orderBy("id").collect()]), np.array([r.y for r in m.transform(new).orderBy("id").collect()]), scored

    a = fitted()
    monkeypatch.setattr(model, "LOCAL_BYTES", 0)
    monkeypatch.setattr(model, "BROADCAST_BYTES", 0)
    b = fitted()
    monkeypatch.setattr(optimize, "LOCAL_PAIRS", 0)
    c = fitted()
    for other in (b, c):
        assert a[1] == other[1] and a[0].counts == other[0].counts and a[4] == other[4]
        assert np.abs(a[2] - other[2]).max() < 1e-5 and np.abs(a[3] - other[3]).max() < 1e-5
        assert a[0].figures == pytest.approx(other[0].figures, rel=1e-4) and a[0].measured["final"] == pytest.approx(other[0].measured["final"], rel=1e-6)
        assert sorted(a[0].kept) == sorted(other[0].kept)


def test_elements_by_rank(spark):
    x = np.round(np.random.default_rng(3).normal(size=500), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "dist double").repartition(7)
    want = np.sort(x)
    assert stats.elements(df, "dist", {"a": 0, "b": 250, "c": 499, "none": 500}) == {"a": want[0], "b": want[250], "c": want[499], "none": None}


def test_blocks_and_groups_agree(spark):
    rng = np.random.default_rng(17)
    x, labels = np.round(rng.normal(size=(50, 3)), 1), rng.integers(0, 4, 50)
    df = table(spark, x, labels)
    a = sorted(map(tuple, knn.grouped_search(df, df, "label", 2).collect()))
    assert a == sorted(map(tuple, knn.grouped_search(df, df, "label", 2, broadcast_bytes=200).collect()))
    y = df.select("id", F.col("features").alias("y"), "label").union(spark.createDataFrame([(99, [0.0, 0.0, 0.0], None), (98, [1.0, 0.0, 0.0], 77)], "id long, y array<double>, label int"))
    one = sorted(map(tuple, evaluate.same_label_nearest(y).collect()))
    assert one == sorted(map(tuple, evaluate.same_label_nearest(y, 0).collect())) and len(one) == 50


def brute_matrix(x, metric="euclidean"):
    return {(i, j): float(knn.pair_distance(x[i : i + 1], x[j : j + 1], metric)[0]) for i in range(len(x)) for j in range(len(x))}


def run_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("more", [{}, {"broadcast_bytes": 0}])
def test_distance_matrix_in_blocks(spark, more):
    x = np.round(np.random.default_rng(21).normal(size=(70, 3)), 1)
    df = table(spark, x)
    got = {(r.i, r.j): r.dist for r in knn.distance_matrix(df, **more).collect()}
    want = {k: d for k, d in brute_matrix(x).items() if k[0] != k[1]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "NestedLoop" not in run_plan(knn.distance_matrix(df, **more)) and "Cartesian" not in run_plan(knn.distance_matrix(df, **more))
    assert knn.distance_matrix(df.limit(0)).count() == 0


def test_distance_matrix_is_written_small():
    rng = np.random.default_rng(27)
    x, ids = rng.normal(size=(1100, 8)), 7 * rng.permutation(1100)
    own = rng.permutation(1100)[:150]
    parts = list(knn._tiles(ids[own], x[own], ids, x, "euclidean"))
    i, j, dist = (np.concatenate(c) for c in zip(*parts))
    row = {int(v): k for k, v in enumerate(ids)}
    want = {(a, b) for a in ids[own].tolist() for b in ids.tolist() if a < b}
    got = list(zip(i.tolist(), j.tolist()))
    assert len(got) == len(set(got)) and set(got) == want | {(b, a) for a, b in want}
    assert all(abs(d - knn.pair_distance(x[row[a]][None], x[row[b]][None], "euclidean")[0]) < 1e-12 for a, b, d in zip(i[:500].tolist(), j[:500].tolist(), dist[:500]))
    packed = [len(pa.compress(np.round(c, 6).tobytes(), codec="snappy", asbytes=True)) for c in (i, j, dist)]
    assert packed[0] < 8 * len(i) / 6 and packed[1] < 8 * len(i) / 6 and packed[2] < 8 * len(i) * 0.6  # each distance stands there once


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_prefix_neighbours_in_blocks(spark, metric):
    x = np.round(np.random.default_rng(22).normal(size=(80, 3)), 1)
    df, far = table(spark, x), brute_matrix(x, metric)
    want = sorted((i, j, r + 1) for i in range(80) for r, (_, j) in enumerate(sorted((far[i, j], j) for j in range(i + 1))[:4]))
    assert sorted((r.i, r.j, r.rank) for r in knn.prefix_knn(df, 4, metric).collect()) == want
    assert sorted((r.i, r.j, r.rank) for r in knn.knn_block(df, df, 4, metric, False, 0, True).collect()) == want
    assert "NestedLoop" not in run_plan(knn.prefix_knn(df, 4, metric)) and "Cartesian" not in run_plan(knn.prefix_knn(df, 4, metric))


def test_declarative_form_of_many_pairs_takes_blocks(spark, monkeypatch):
    x = np.round(np.random.default_rng(23).normal(size=(60, 3)), 1)
    df = table(spark, x)
    plain = sorted((r.i, r.j, r.rank) for r in knn.knn_sql(df, df, 4).collect())
    monkeypatch.setattr(knn, "SQL_PAIRS", 1000)
    assert sorted((r.i, r.j, r.rank) for r in knn.knn_sql(df, df, 4).collect()) == plain == brute(x, 4, "euclidean")
    assert "NestedLoop" not in run_plan(knn.knn_sql(df, df, 4)) and "Cartesian" not in run_plan(knn.knn_sql(df, df, 4))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_cells_meet_block_by_block(spark, metric):
    x = np.round(np.random.default_rng(24).normal(size=(90, 3)), 1)
    df = table(spark, x)
    given = [[0.5, 0.5, 0.0], [-0.5, 0.0, 0.5], [0.0, -0.5, -0.5]]
    near = knn.knn_ivf(df, df, 5, metric, probe=3, given=given)
    assert sorted((r.i, r.j, r.rank) for r in near.collect()) == brute(x, 5, metric)  # all cells
    assert "MapInArrow" in run_plan(near)


def test_index_marks(spark):
    df = table(spark, np.eye(6))
    index = knn.mark_deleted(df, df.where("id < 4"))
    assert {r.id for r in knn.live(index).collect()} == {4, 5}
    index = knn.unmark_deleted(index, df.where("id = 2"))
    assert {r.id for r in knn.fetch(index, df).collect()} == {2, 4, 5} and knn.live(index).columns == df.columns
    assert {r.id for r in knn.replace_deleted(index, df.where("id = 0").withColumn("id", F.lit(50).cast("long"))).collect()} == {2, 4, 5, 50}


def test_folder_for_checkpoints(spark, monkeypatch):
    from vecspan import session

    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    class NotSet:
        def isDefined(self):
            return False

    monkeypatch.setattr(Context, "_jsc", type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: NotSet()})()})())
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_two_tiers_of_a_local_fit_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = table(spark, rng.normal(size=(60, 5)))
    p = model.Params(neighbors=5, seed=7, iters=(5, 5, 30), variant="local")

    def fitted(p):
        return np.array([r.y for r in model.EmbeddingEstimator(p).fit(df).embedding.orderBy("id").collect()])

    one, plain = fitted(p), fitted(model.replace(p, variant="plain"))
    monkeypatch.setattr(model, "LOCAL_BYTES", 0)
    monkeypatch.setattr(optimize, "LOCAL_PAIRS", 0)
    assert np.abs(one - fitted(p)).max() < 1e-5 < np.abs(one - plain).max()


def test_far_pairs_are_drawn_anew_near_their_row(monkeypatch):
    rng = np.random.default_rng(6)
    y = np.concatenate((rng.normal(0, 1, (50, 2)), rng.normal(40, 1, (50, 2)), [[500.0, 500.0]]))
    i = np.repeat(np.arange(101), 4)
    j, near_i, near_j = (i + 50 + np.tile(np.arange(4), 101)) % 101, np.repeat(np.arange(101), 3), rng.integers(0, 101, 303)
    new = optimize.resampled(y, i, j, near_i, near_j, 10.0, 42, 212)
    moved = new != j
    assert moved[:400].mean() > 0.9 and not moved[400:].any()
    assert (np.linalg.norm(y[i] - y[new], axis=1)[moved] <= 10).all() and (new != i)[moved].all()
    assert not {*zip(i[moved], new[moved])} & {*zip(near_i, near_j)} and len({*zip(i[moved], new[moved])}) == moved.sum()
    asked = []
    old = optimize.resampled
    monkeypatch.setattr(optimize, "resampled", lambda *a: asked.append(a[-1]) or old(*a))
    optimize.local_loop(y, i, j, np.full(len(i), 2), (5, 5, 40), optimize.Adam(), limit=10.0)
    assert asked == [21, 31, 41]


def test_far_pairs_are_drawn_in_order_and_in_few_steps(monkeypatch):
    def draw(i, t, n, seed=42, it=212):
        x = seed ^ (i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
        for k in (it, t):
            x = (x + k + 1) * 0xBF58476D1CE4E5B9 % (1 << 64)
            x = (x ^ x >> 30) * 0x94D049BB133111EB % (1 << 64)
            x ^= x >> 31
        return x % n

    rng = np.random.default_rng(7)
    y = np.concatenate((rng.normal(0, 1, (1500, 2)), rng.normal(400, 90, (100, 2))))
    n = len(y)
    i = np.sort(rng.integers(0, n, 5000))
    j, near_i, near_j = rng.integers(0, n, 5000), rng.integers(0, n, 9000), rng.integers(0, n, 9000)
    near, want, at = {*zip(near_i.tolist(), near_j.tolist())}, j.tolist(), 0
    for a in np.unique(i).tolist():
        taken = []
        for s in range(int((i == a).sum())):
            found = (draw(a, s * 100 + t, n) for t in range(100))
            ok = next((b for b in found if b != a and ((y[a] - y[b]) ** 2).sum() <= 0.25 and (a, b) not in near and b not in taken), None)
            if ok is not None:
                taken.append(ok)
                want[at] = ok
            at += 1
    asked, old = [], optimize._draw
    monkeypatch.setattr(optimize, "_draw", lambda *a: asked.append(1) or old(*a))
    assert optimize.resampled(y, i, j, near_i, near_j, 0.5, 42, 212).tolist() == want
    assert len(asked) <= 2 * 6 * int(np.bincount(i).max())


def test_flat_tables_read_near_boxes_only(monkeypatch):
    x = np.round(np.random.default_rng(31).normal(size=(1500, 2)), 1)  # many equal rows
    want = local.neighbors(x, 12, "euclidean")
    monkeypatch.setattr(local, "MANY", 100)
    monkeypatch.setattr(local, "BOX", 64)
    read, old = [], local.top_k
    monkeypatch.setattr(local, "top_k", lambda q, y, b, *a: read.append(len(q) * len(b)) or old(q, y, b, *a))
    got = local.neighbors(x, 12, "euclidean")
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert sum(read) < 1500 * 1500 / 2


def test_threads_of_the_loop_change_nothing(monkeypatch):
    rng = np.random.default_rng(32)
    i, j, kind = rng.integers(0, 90, 3000), rng.integers(0, 90, 3000), rng.integers(0, 3, 3000)
    y = rng.normal(size=(90, 2))
    want = optimize.local_loop(y, i, j, kind, (5, 5, 20), optimize.Adam(), limit=1.0).y
    for name, size in (("THREADED", 100), ("SHARED", 64)):
        monkeypatch.setattr(optimize, name, size)
    assert np.allclose(optimize.local_loop(y, i, j, kind, (5, 5, 20), optimize.Adam(), limit=1.0).y, want, atol=1e-9)


def test_a_sweep_finds_neighbours_once(spark, monkeypatch):
    x = np.random.default_rng(33).normal(size=(120, 4))
    df = table(spark, x, np.arange(120) % 3)
    settings = [model.Params(neighbors=k, seed=42, iters=(2, 2, 2)) for k in (4, 8)]
    asked, old = [], local.neighbors
    monkeypatch.setattr(local, "neighbors", lambda y, *a: asked.append(y.shape[1]) or old(y, *a))
    swept = {r.param: r.quality for r in model.sweep(df, df, settings).collect()}
    assert asked.count(4) == 1
    for k, p in enumerate(settings):
        e = model.EmbeddingEstimator(p).fit(df).embedding.join(df.select("id", "label"), "id")
        assert swept[k] == evaluate.same_label_quality(e).first()["quality"]


def test_fit_properties(spark):
    rng = np.random.default_rng(42)
    x = np.concatenate((rng.normal(0, 0.3, (40, 8)), rng.normal(5, 0.3, (40, 8))))
    df = table(spark, x, [0] * 40 + [1] * 40)
    p = model.Params(neighbors=8, seed=7, iters=(60, 60, 120))
    told = []
    m = model.EmbeddingEstimator(p, on_progress=lambda *a: told.append(a)).fit(df)
    y = np.array([r.y for r in m.embedding.orderBy("id").collect()])
    assert y.shape == (80, 2) and np.isfinite(y).all() and np.ptp(y) > 0.1
    again = np.array([r.y for r in model.EmbeddingEstimator(p).fit(df).embedding.orderBy("id").collect()])
    assert np.abs(y - again).max() < 1e-9
    wb = {r.same: r["mean"] for r in evaluate.within_between(m.embedding.join(df.select("id", "label"), "id")).collect()}
    assert wb[False] / wb[True] > 1.2
    assert m.counts == {"near": 640, "mid": 320, "far": 1280}
    back = np.array([r.y for r in m.transform(df).orderBy("id").collect()])
    assert np.abs(back - y).max() < 1e-3
    assert told and told[-1][0] == "done"
    assert m.loss_history().count() == len(m.history)


def test_save_load_and_damage(spark, tmp_path):
    df = table(spark, np.random.default_rng(5).normal(size=(40, 4)))
    m = model.EmbeddingEstimator(seed=1, neighbors=5, iters=(5, 5, 10), metric="cosine").fit(df)
    path = str(tmp_path / "model")
    m.save(path)
    back = model.EmbeddingModel.load(spark, path)
    assert back.params == m.params and evaluate.compare(m.embedding, back.embedding).first()["most"] == 0
    back.save(path)  # the same folder: a new version replaces the old one
    assert [x.name for x in (tmp_path / "model").iterdir()] == ["v2"]
    again = model.EmbeddingModel.load(spark, path)
    assert evaluate.compare(m.transform(df), again.transform(df)).first()["most"] < 1e-12
    (tmp_path / "model" / "v3" / "train").mkdir(parents=True)  # a save that failed half-way
    assert model.EmbeddingModel.load(spark, path).embedding.count() == 40
    m.embedding.limit(39).write.mode("overwrite").parquet(f"{path}/v2/embedding")
    with pytest.raises(model.ChecksumError):
        model.EmbeddingModel.load(spark, path)
    with pytest.raises(FileNotFoundError):
        model.EmbeddingModel.load(spark, str(tmp_path / "none"))
    m.reset()
    with pytest.raises(model.NotFittedError):
        m.transform(df)


@pytest.mark.parametrize("bad", [{"components": 0}, {"components": 51}, {"neighbors": 0}, {"neighbors": 40}, {"lr": 0.0}, {"mn_ratio": -1.0}, {"iters": (0, 1, 1)}, {"metric": "none"}])
def test_bad_parameters(spark, bad):
    df = table(spark, np.random.default_rng(5).normal(size=(40, 4)))
    with pytest.raises(ValueError):
        model.EmbeddingEstimator(**({"neighbors": 5} | bad)).fit(df)


def test_bad_input(spark):
    with pytest.raises(ValueError):
        frame.check(table(spark, np.zeros((0, 3))))
    with pytest.raises(ValueError):
        frame.check(table(spark, [[1.0, float("nan")]]))
    with pytest.raises(ValueError):
        frame.check(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, features array<double>"))
    with pytest.raises(ValueError):
        normalize.fit_scaling(table(spark, np.zeros((3, 2))))


def test_other_widths_and_dims(spark):
    df = table(spark, np.random.default_rng(6).uniform(size=(50, 5)))
    m = model.EmbeddingEstimator(seed=1, neighbors=5, components=3, iters=(5, 5, 5)).fit(df)
    assert {len(r.y) for r in m.embedding.collect()} == {3}
    with pytest.raises(Exception, match="expected 5 features"):
        m.transform(table(spark, np.zeros((1, 4)))).collect()


def test_optimised_placing(spark):
    df = table(spark, np.random.default_rng(8).normal(size=(60, 4)))
    m = model.EmbeddingEstimator(seed=1, neighbors=5, iters=(20, 20, 40)).fit(df)
    placed = model.place_by_optimising(m, df.where("id < 10"), (5, 5, 10))
    assert placed.count() == 10


def test_positions_with_gaps(spark):
    ids = [5, -3, 100, 7, 42, 8, 9]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    assert {r.id: r.pos for r in frame.with_position(df).collect()} == {i: k for k, i in enumerate(sorted(ids))}


def test_draws_do_not_depend_on_partitions(spark):
    df = table(spark, np.random.default_rng(9).normal(size=(50, 3)))
    a = {(r.i, r.j) for r in pairs.mid_pairs(df, 50, 4, 1).collect()}
    b = {(r.i, r.j) for r in pairs.mid_pairs(df.repartition(7), 50, 4, 1).collect()}
    assert a == b and len(a) == 200
    with pytest.raises(ValueError):
        pairs.mid_pairs(df.where("id < 4"), 4, 2)


def test_starts_and_reduction(spark):
    df = table(spark, np.random.default_rng(12).normal(size=(60, 6)))
    assert {len(r.features) for r in normalize.reduced(df, 6, most=4).collect()} == {4}
    assert normalize.reduced(df, 6, "hamming", most=4) is df
    m = model.EmbeddingEstimator(seed=1, neighbors=5, init="pca", iters=(5, 5, 10)).fit(df)
    assert m.embedding.count() == 60
    with pytest.raises(ValueError):
        model.EmbeddingEstimator(neighbors=5, init="none").fit(df)


def test_quantisation_error_is_small(spark):
    x = np.random.default_rng(4).integers(0, 2, (80, 8)).astype(float)
    df = table(spark, x)
    book = quantize.train(df, 4, 8, k=4)
    back = np.array([r.features for r in quantize.reconstruct(quantize.encode(df, book, 4, 8), book).orderBy("id").collect()])
    assert np.abs(back - x).max() < 1e-9


def test_pair_count_rules():
    assert schedules.pair_counts(100, 5, 0.1, 0.4) == schedules.PairCounts(5, 0, 2)
    with pytest.raises(ValueError):
        schedules.pair_counts(10, 10, 0.5, 2.0)
    c = schedules.rounded_pair_counts(20, 10, 0.5, 2.0)
    assert c.near + c.mid + c.far < 20
    assert schedules.format_duration(61500) == "1 min 1 s"


def container(pixels, labels):
    return struct.pack(readers.HEADER, readers.MAGIC, 1, len(pixels), 2, 2, len(labels), 0) + pixels.tobytes() + bytes(labels)


def test_image_container(spark, tmp_path):
    pixels = np.arange(12, dtype=np.uint8).reshape(3, 4)
    raw = container(pixels, [7, 8, 9])
    (tmp_path / "a.dat").write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x.dat", raw)
    for name in ("a.dat", "b.zip"):
        got = readers.images(spark, str(tmp_path / name)).orderBy("id").collect()
        assert [r.label for r in got] == [7, 8, 9] and got[2].features == [8.0, 9.0, 10.0, 11.0]
    broken = struct.pack(readers.HEADER, readers.MAGIC, 1, 99, 2, 2, 99, 0) + pixels.tobytes() + bytes([7, 8, 9])
    assert len(readers.parse_container(broken)[0]) == 3
    with pytest.raises(ValueError):
        readers.parse_container(b"XXXX" + raw[4:])


def test_point_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x,y,z\n1,2,3\n\n4,5,6\n")
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("p.csv", "0,1,2\n1,2,3\n4,5,6\n")
    assert [tuple(r) for r in readers.csv_points(spark, str(tmp_path / "p.csv")).collect()] == [(1, 2, 3), (4, 5, 6)]
    assert [tuple(r) for r in readers.zipped_csv_points(spark, str(tmp_path / "p.zip")).collect()] == [(1, 2, 3), (4, 5, 6)]
    assert readers.csv_points(spark, str(tmp_path / "p.csv"), 1).count() == 1
    (tmp_path / "bad.csv").write_text("1,2\n")
    with pytest.raises(Exception, match="fewer than three"):
        readers.csv_points(spark, str(tmp_path / "bad.csv")).collect()


def test_csv_sinks(spark, tmp_path):
    y = spark.createDataFrame([(1, [0.5, 1.25], 3)], "id long, y array<double>, label int")
    writers.write_embedding_csv(y, str(tmp_path / "a"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "a")).collect()] == [("0.500000", "1.250000")]
    writers.write_labelled_csv(y, str(tmp_path / "b"), "label")
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).columns == ["x", "y", "label"]


def test_streamed_scores(spark, tmp_path):
    from vecspan.streaming.scoring import score_stream, severity_windows

    df = table(spark, np.random.default_rng(8).normal(size=(40, 4)))
    m = model.EmbeddingEstimator(seed=1, neighbors=5, iters=(5, 5, 10)).fit(df)
    df.select("id", "features").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, features array<double>").parquet(str(tmp_path / "in"))
    seen = []
    q = score_stream(stream, m, lambda batch, epoch: seen.append(batch.count()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sum(seen) == 40
    t = spark.createDataFrame([("2024-01-01 00:01:00", 1), ("2024-01-01 00:02:00", 1), ("2024-01-01 00:09:00", 0)], "ts string, outlier_level int").withColumn("ts", F.to_timestamp("ts"))
    assert {(r.outlier_level, r.n) for r in severity_windows(t).collect()} == {(1, 2), (0, 1)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_a_flat_table_is_fitted_by_near_boxes_and_packed_blocks(spark, monkeypatch):
    """Large flat tables: the pairs, losses and places of one process, without a comparison of all rows or an exchange of lists."""
    x = np.round(np.random.default_rng(34).normal(size=(700, 2)), 1)  # many equal rows
    df = table(spark, x).withColumn("id", F.col("id") * 3 - 5)
    p = model.Params(neighbors=6, seed=7, iters=(3, 3, 14))
    for name, size in (("MANY", 100), ("BOX", 300)):
        monkeypatch.setattr(local, name, size)

    def fitted():
        m = model.EmbeddingEstimator(p, keep_pairs=True).fit(df)
        return m, sorted(map(tuple, m.pairs.select("i", "j", "kind").collect())), np.array([r.y for r in m.embedding.orderBy("id").collect()])

    a = fitted()
    met, old = [], knn._met
    monkeypatch.setattr(knn, "_met", lambda *a: met.append(1) or old(*a))
    for where, name, size in ((model, "LOCAL_BYTES", 0), (optimize, "LOCAL_PAIRS", 0), (optimize, "DEALT", 5000), (optimize, "PACKED", 300), (optimize, "CHUNK", 70)):
        monkeypatch.setattr(where, name, size)
    b = fitted()
    assert not met and a[1] == b[1] and a[0].counts == b[0].counts
    assert np.abs(a[2] - b[2]).max() < 1e-5 and a[0].figures == pytest.approx(b[0].figures, rel=1e-4)
    assert [a[0].measured[k] for k in ("initial", "final")] == pytest.approx([b[0].measured[k] for k in ("initial", "final")], rel=1e-6)
    assert [h[2] for h in a[0].history] == pytest.approx([h[2] for h in b[0].history], rel=1e-6)


def test_packed_blocks_hold_all_pairs_and_their_forces(monkeypatch):
    rng = np.random.default_rng(35)
    i = np.concatenate((rng.integers(0, 60, 900), np.full(500, 31)))  # one row with many pairs
    j, kind = rng.integers(0, 60, 1400), rng.integers(0, 3, 1400)
    part = i // 25
    order = np.lexsort((j, i, kind, part))
    part, kind, i, j = (a[order].astype(np.int32) for a in (part, kind, i, j))
    monkeypatch.setattr(optimize, "PACKED", 64)
    monkeypatch.setattr(optimize, "CHUNK", 20)
    whole = pa.RecordBatch.from_arrays([pa.array(a) for a in (part, kind, i, j)], ["part", "kind", "i", "j"])
    blocks = [b.to_pylist()[0] for b in optimize._packed(whole.slice(at, 50) for at in range(0, 1400, 50))]
    numbers = [[np.frombuffer(b[c], np.int32) for c in ("rows", "sizes", "ends")] for b in blocks]
    got = [(b["part"], b["kind"], *p) for b, (r, s, e) in zip(blocks, numbers) for p in zip(np.repeat(r, s).tolist(), e.tolist())]
    assert got == [*zip(part.tolist(), kind.tolist(), i.tolist(), j.tolist())] and len(blocks) > 15
    y, w = rng.normal(size=(60, 2)), (2.0, 300.0, 1.0)
    g, lost = np.zeros((2, 75)), 0.0
    for b, blobs in zip(blocks, numbers):
        at = 25 * b["part"]
        lost += optimize._pull(np.ascontiguousarray(y.T), b["kind"], *blobs, w, None, True, g[:, at : at + 25], at)
    want = sum((np.stack([np.bincount(i[kind == k], f, 60) for f in (y[i[kind == k]] - y[j[kind == k]]).T * c], axis=1) for k in range(3) for c in [_coefficient(y, i[kind == k], j[kind == k], k, w)]), np.zeros((60, 2)))
    assert np.allclose(g[:, :60].T, want) and lost == pytest.approx(optimize._forces(y, i, j, kind, w)[1])


def _coefficient(y, i, j, kind, w):
    d = 1 + ((y[i] - y[j]) ** 2).sum(1)
    return (20 * w[0] / (10 + d) ** 2, 20000 * w[1] / (10000 + d) ** 2, -2 * w[2] / (1 + d) ** 2)[kind]


@pytest.mark.parametrize("rows_of", [25, 70_000])
def test_blocks_by_ranges_of_ends_hold_all_pairs_and_their_forces(monkeypatch, rows_of):
    """Both directions of every pair, in blocks whose rows and ends each lie in one short range."""
    rng = np.random.default_rng(36)
    n = 60 if rows_of == 25 else 150_000
    i, j, kind = rng.integers(0, n, 1400), rng.integers(0, n, 1400), rng.integers(0, 3, 1400)
    monkeypatch.setattr(optimize, "PACKED", 100)
    monkeypatch.setattr(optimize, "CHUNK", 30)
    if n == 60:
        monkeypatch.setattr(optimize, "REACH", 16)
    whole = pa.RecordBatch.from_arrays([pa.array(a) for a in (i, j, kind.astype(np.int32))], ["i", "j", "kind"])
    keyed = [b for at in range(0, 1400, 700) for b in optimize._keyed((whole.slice(x, 50) for x in range(at, at + 700, 50)), n, rows_of)]
    y, w = rng.normal(size=(n, 2)), (2.0, 300.0, 1.0)
    parts = -(-n // rows_of)
    g, lost, got = np.zeros((2, parts * rows_of)), 0.0, []
    for b in optimize._ranged(iter(keyed), n, rows_of):
        (r,) = b.to_pylist()
        rows, ends = np.frombuffer(r["rows"], optimize._row_type(rows_of)), np.frombuffer(r["ends"], np.uint16)
        at = r["part"] * rows_of
        got += zip([r["kind"]] * len(rows), (rows.astype(int) + at).tolist(), (ends.astype(int) + r["reach"] * optimize.REACH).tolist())
        lost += optimize._pull_ranged(np.ascontiguousarray(y.T), r["kind"], r["reach"], rows, ends, w, None, True, g[:, at : min(at + rows_of, n)], at)
        assert len(rows) <= 100
    both = [*zip(kind.tolist(), i.tolist(), j.tolist()), *zip(kind.tolist(), j.tolist(), i.tolist())]
    assert sorted(got) == sorted(both)
    want, loss = optimize._forces(y, i, j, kind, w)
    assert np.allclose(g[:, :n].T, want) and lost / 2 == pytest.approx(loss)
