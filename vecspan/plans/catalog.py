"""All queries of the vector engine, with the SQL of those that SQL can express.

Doubles are rounded to six decimals on both sides; every order ends with an id, so ties are settled alike.
"""

from __future__ import annotations

import io
import struct
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.functions import schedules, sql
from vecspan.functions.vectors import METRIC_NAMES, METRICS, distance
from vecspan.operators import classify, evaluate, frame, knn, model, normalize, optimize, pairs, quantize, sampling, stats
from vecspan.plans import fragments as S
from vecspan.session import Stash, Timers, capabilities, put, shared_dir
from vecspan.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def emb(spark: SparkSession, d: str) -> DataFrame:
    """id, features, label."""
    return frame.vectors(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", "label")


def plane(spark: SparkSession, d: str) -> DataFrame:
    """id, y (the first two features), label: a fixed embedding."""
    return emb(spark, d).select("id", F.slice("features", 1, 2).alias("y"), "label")


def r6(c: Column | str, name: str) -> Column:
    return (F.round(c, 6) + 0.0).alias(name)


def long(df: DataFrame, col: str = "features") -> DataFrame:
    """id, pos, x with x rounded."""
    return df.select("id", F.posexplode(col).alias("pos", "x")).select("id", "pos", r6("x", "x"))


def neighbors(rows: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    return knn.knn_block(rows, rows, k, metric)


def ranked(df: DataFrame) -> DataFrame:
    return df.select("i", "j", F.col("rank").cast("int").alias("rank"), r6("dist", "dist"))


def sampled(rows: DataFrame) -> DataFrame:
    """Near, mid-range and far pairs of rows whose ids are positions."""
    n = rows.count()
    near = pairs.near_pairs(neighbors(rows, S.EXTRA), S.K).persist()  # read twice
    return pairs.all_pairs(near, pairs.mid_pairs(rows, n, S.N_MID, S.SEED), pairs.far_pairs(rows, near, n, S.N_FAR, S.SEED))


# Normalisation and scalar functions ------------------------------------------------------------------------------


@query("global_minmax", f"WITH {S.V} SELECT round(min(list_min(f)), 6) AS xmin, round(max(list_max(f)), 6) AS xmax FROM v")
def _(spark, d):
    return normalize.global_minmax(emb(spark, d)).select(r6("xmin", "xmin"), r6("xmax", "xmax"))


@query("column_means", f"WITH {S.CELLS} SELECT pos, round(avg(x), 6) + 0.0 AS mean FROM c GROUP BY pos")
def _(spark, d):
    return normalize.column_summary(emb(spark, d)).select("pos", r6("mean", "mean"))


@query("column_summary", f"WITH {S.CELLS} SELECT pos, round(min(x), 6) AS minimum, round(max(x), 6) AS maximum, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS deviation FROM c GROUP BY pos")
def _(spark, d):
    return normalize.column_summary(emb(spark, d)).select("pos", *[r6(c, c) for c in ("minimum", "maximum", "mean", "deviation")])


@query("normalize_minmax_center", f"WITH {S.V}, {S.NORM} SELECT id, unnest(range(len(f)))::INT AS pos, unnest(list_transform(f, lambda x: round(x, 6) + 0.0)) AS x FROM nv")
def _(spark, d):
    return long(normalize.minmax_center(emb(spark, d)))


@query("zscore_columns", f"WITH {S.CELLS}, st AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM c GROUP BY pos) SELECT id, c.pos, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0 AS x FROM c JOIN st ON c.pos = st.pos")
def _(spark, d):
    return long(normalize.zscore(emb(spark, d)))


@query("zscore_seeded", f"WITH {S.CELLS}, st AS (SELECT pos, avg(x) AS m, sqrt((1 + var_pop(x) * count(*)) / (count(*) - 1)) AS s FROM c GROUP BY pos) SELECT id, c.pos, round((x - m) / s, 6) + 0.0 AS x FROM c JOIN st ON c.pos = st.pos")
def _(spark, d):
    return long(normalize.seeded_zscore(emb(spark, d)))


@query("standardize_all", f"WITH {S.CELLS}, st AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM c) SELECT id, pos, round((x - m) / s, 6) + 0.0 AS x FROM c, st")
def _(spark, d):
    return long(normalize.standardize(emb(spark, d)))


@query("l2_normalize", f"WITH {S.V} SELECT id, unnest(range(len(f)))::INT AS pos, unnest(list_transform(f, lambda x: round(x / CASE WHEN sqrt(list_dot_product(f, f)) < 1e-8 THEN 1 ELSE sqrt(list_dot_product(f, f)) END, 6) + 0.0)) AS x FROM v")
def _(spark, d):
    return long(normalize.l2_normalize(emb(spark, d)))


@query("binarize", f"WITH {S.CELLS} SELECT id, pos, CASE WHEN x > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM c")
def _(spark, d):
    return long(normalize.binarize(emb(spark, d)))


@query("normalization_modes", "SELECT * FROM (VALUES ('euclidean', 1), ('cosine', 2), ('manhattan', 1), ('correlation', 0), ('hamming', 4)) t(metric, mode)")
def _(spark, d):
    return spark.createDataFrame([(m, normalize.mode_for(m)) for m in ("euclidean", "cosine", "manhattan", "correlation", "hamming")], "metric string, mode int")


@query("data_checks", f"WITH {S.CELLS}, p AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM c GROUP BY pos) SELECT round(count(*) FILTER (x IN (0, 1)) / count(*), 6) AS binary_share, (SELECT count(*) FROM p WHERE lo = hi) AS constant_columns, count(*) FILTER (isnan(x) OR isinf(x)) AS bad_cells, round(avg(x * x) - avg(x) * avg(x), 6) AS variance FROM c")
def _(spark, d):
    return normalize.data_checks(emb(spark, d)).select(r6("binary_share", "binary_share"), "constant_columns", "bad_cells", r6("variance", "variance"))


@query("validity", f"WITH {S.CELLS} SELECT count(*) FILTER (isnan(x)) AS n_nan, count(*) FILTER (isinf(x)) AS n_inf, count(*) FILTER (x IS NULL) AS n_null, round(min(x), 6) AS least, round(max(x), 6) AS greatest, 64 AS w_min, 64 AS w_max FROM c")
def _(spark, d):
    return frame.validity(emb(spark, d)).select("n_nan", "n_inf", "n_null", r6("least", "least"), r6("greatest", "greatest"), "w_min", "w_max")


@query("pca_checks", "SELECT count(*) AS n, true AS centred, true AS uncorrelated, true AS ordered, true AS largest FROM embeddings")
def _(spark, d):
    v = emb(spark, d)
    t = normalize.pca(v, 2).select(F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))
    most = normalize.column_summary(v).agg(F.max(F.col("deviation") * F.col("deviation"))).first()[0]
    a, b = F.var_pop("a"), F.var_pop("b")
    return t.agg(F.count("*").alias("n"), ((F.abs(F.avg("a")) < 1e-9) & (F.abs(F.avg("b")) < 1e-9)).alias("centred"), (F.abs(F.covar_pop("a", "b")) < 1e-9 * a).alias("uncorrelated"), (a >= b).alias("ordered"), (a >= most).alias("largest"))


@query("degenerate_checks", "SELECT count(*) AS n, 64 AS d, false AS few_rows, false AS few_features, count(*) <= 64 AS unstable FROM embeddings UNION ALL SELECT 40, 64, false, false, true UNION ALL SELECT 1, 1, true, true, true")
def _(spark, d):
    v = emb(spark, d)
    one = v.orderBy("id").limit(1).select("id", F.slice("features", 1, 1).alias("features"))
    return frame.degenerate(v).union(frame.degenerate(v.orderBy("id").limit(40))).union(frame.degenerate(one))


@query("metric_names", "SELECT * FROM (VALUES (0, 'euclidean'), (1, 'cosine'), (2, 'manhattan'), (3, 'correlation'), (4, 'hamming')) t(metric, name)")
def _(spark, d):
    return spark.createDataFrame(sorted(METRIC_NAMES.items()), "metric int, name string")


@query("neighbor_warnings", """SELECT n::BIGINT AS n, k::INT AS k, k < CASE WHEN n < 10000 THEN 10 ELSE greatest(10, least(100, floor(10 + 15 * (log10(n) - 4)))) END AS warned
 FROM (VALUES (500), (9999), (10000), (100000), (1000000), (50000000)) a(n), (VALUES (5), (10), (24), (40), (66)) b(k)""")
def _(spark, d):
    rows = [(n, k, bool(schedules.neighbor_warning(k, n))) for n in (500, 9999, 10000, 100000, 1000000, 50000000) for k in (5, 10, 24, 40, 66)]
    return spark.createDataFrame(rows, "n long, k int, warned boolean")


@query("ratio_warnings", """SELECT mn::DOUBLE AS mn, fp::DOUBLE AS fp, ((abs(fp - 4 * mn) > 0.01)::INT + (mn NOT BETWEEN 0.1 AND 2)::INT + (fp NOT BETWEEN 0.5 AND 5)::INT)::INT AS warnings
 FROM (VALUES (0.05), (0.5), (1.0), (2.5)) a(mn), (VALUES (0.2), (2.0), (4.0), (10.0)) b(fp)""")
def _(spark, d):
    rows = [(mn, fp, len(model.Params(mn_ratio=mn, fp_ratio=fp).warnings())) for mn in (0.05, 0.5, 1.0, 2.5) for fp in (0.2, 2.0, 4.0, 10.0)]
    return spark.createDataFrame(rows, "mn double, fp double, warnings int")


@query("rounded_pair_counts", "WITH t AS (SELECT count(*) AS n FROM embeddings) SELECT k::INT AS k, least(k, n - 1)::INT AS near, round(k * 0.5)::INT AS mid, round(k * 2.0)::INT AS far FROM t, (VALUES (4), (10), (16)) x(k)")
def _(spark, d):
    n = emb(spark, d).count()
    rows = [(k, c.near, c.mid, c.far) for k in (4, 10, 16) for c in [schedules.rounded_pair_counts(n, k, 0.5, 2.0)]]
    return spark.createDataFrame(rows, "k int, near int, mid int, far int")


@query("tuned_settings", """SELECT n::BIGINT AS n, CASE WHEN n < 100 THEN greatest(1, least(60, n // 2)) WHEN n > 10000 THEN 50 ELSE 60 END::INT AS neighbors,
 round(CASE WHEN n < 100 THEN 0.5 ELSE 1.0 END * CASE WHEN n < 1000 THEN 0.8 ELSE 1.0 END, 6)::DOUBLE AS lr, CASE WHEN n < 100 THEN 0.2 ELSE 0.1 END::DOUBLE AS mn_ratio,
 CASE WHEN n > 5000 THEN 200 ELSE 450 END::INT AS iterations FROM (VALUES (20), (99), (100), (999), (1000), (5001), (20000)) t(n)""")
def _(spark, d):
    rows = []
    for n in (20, 99, 100, 999, 1000, 5001, 20000):
        p = model.Params(neighbors=60, mn_ratio=0.1).for_size(n)
        rows.append((n, p.neighbors, round(p.lr, 6), p.mn_ratio, sum(p.iters)))
    return spark.createDataFrame(rows, "n long, neighbors int, lr double, mn_ratio double, iterations int")


@query("strategies", "SELECT * FROM (VALUES ('standard', 1.0::DOUBLE, 450, 2.0::DOUBLE), ('fast', 1.5, 315, 2.0), ('accurate', 0.8, 585, 2.0), ('memory', 1.0, 450, 1.6)) t(name, lr, iterations, fp_ratio)")
def _(spark, d):
    made = [(name, model.Params().strategy(name)) for name in schedules.STRATEGIES]
    return spark.createDataFrame([(name, round(p.lr, 6), sum(p.iters), round(p.fp_ratio, 6)) for name, p in made], "name string, lr double, iterations int, fp_ratio double")


@query("duration_texts", "SELECT ms::DOUBLE AS ms, CASE WHEN ms < 1000 THEN ms::INT || ' ms' WHEN ms < 60000 THEN (ms // 1000)::INT || ' s' ELSE (ms // 60000)::INT || ' min ' || ((ms % 60000) // 1000)::INT || ' s' END AS text FROM (VALUES (0), (999), (1000), (59999), (60000), (61500), (7384000)) t(ms)")
def _(spark, d):
    return spark.createDataFrame([(float(ms), schedules.format_duration(ms)) for ms in (0, 999, 1000, 59999, 60000, 61500, 7384000)], "ms double, text string")


@query("remaining_texts", "SELECT * FROM (VALUES (0, 450, 'unknown'), (45, 450, '18 s'), (225, 450, '2 s'), (450, 450, '0 ms')) t(now, total, text)")
def _(spark, d):
    return spark.createDataFrame([(a, 450, schedules.remaining(a, 450, 2.0)) for a in (0, 45, 225, 450)], "now int, total int, text string")


@query("complexity_notes", "SELECT n::BIGINT AS n, d::INT AS d, CASE WHEN n * n * d > 1e11 THEN 'warning: hours; consider the ivf mode' WHEN n * n * d > 1e9 THEN 'notice: several minutes' ELSE '' END AS note FROM (VALUES (1000::DOUBLE), (10000), (100000)) a(n), (VALUES (3), (50), (300)) b(d)")
def _(spark, d):
    return spark.createDataFrame([(n, w, schedules.complexity_note(n, w)) for n in (1000, 10000, 100000) for w in (3, 50, 300)], "n long, d int, note string")


@query("memory_estimates", "WITH t AS (SELECT count(*) AS n FROM embeddings) SELECT n::BIGINT AS n, k::INT AS k, (8 * n * 64 + 48 * n + 20 * n * (k + k // 2 + 2 * k))::BIGINT AS bytes FROM t, (VALUES (4), (10)) x(k)")
def _(spark, d):
    n = emb(spark, d).count()
    counts = [(k, schedules.pair_counts(n, k, 0.5, 2.0)) for k in (4, 10)]
    return spark.createDataFrame([(n, k, schedules.memory_estimate(n, 64, 2, n * (c.near + c.mid + c.far))) for k, c in counts], "n long, k int, bytes long")


@query("error_texts", "SELECT * FROM (VALUES (0, 'success'), (-1, 'invalid parameters'), (-2, 'out of memory'), (-3, 'not implemented'), (-4, 'the model is not fitted'), (-5, 'file error'), (-6, 'no valid model'), (-7, 'checksum mismatch'), (-99, 'unknown error')) t(code, text)")
def _(spark, d):
    return spark.createDataFrame([(c, model.error_text(c)) for c in (*model.ERRORS, -99)], "code int, text string")


@query("capability_names", "SELECT * FROM (VALUES ('adaptive', true), ('checkpoint', true), ('executor_memory', true), ('master', true), ('parallelism', true), ('shuffle_partitions', true), ('spark', true)) t(name, known)")
def _(spark, d):
    return capabilities(spark).select("name", (F.length("value") > 0).alias("known"))


@query("timed_steps", "SELECT * FROM (VALUES (0, 'count', true), (1, 'widest', true)) t(place, operation, timed)")
def _(spark, d):
    timers = Timers()
    with timers.step("count"):
        emb(spark, d).count()
    with timers.step("widest"):
        emb(spark, d).agg(F.max(F.size("features"))).first()
    return timers.table(spark).select("place", "operation", (F.col("ms") > 0).alias("timed"))


@query("pca_scores")
def _(spark, d):
    return long(normalize.pca(emb(spark, d), 2))


for _metric in METRICS:

    @query(f"dist_{_metric}", f"WITH {S.V}{', w AS (SELECT id, list_transform(f, lambda x: x - list_avg(f)) AS cf, f FROM v)' if _metric == 'correlation' else ', w AS (SELECT * FROM v)'} SELECT a.id AS i, b.id AS j, round({S.dist(_metric)}, 6) + 0.0 AS dist FROM w a JOIN w b ON b.id = a.id + 1")
    def _(spark, d, metric=_metric):
        v = emb(spark, d)
        a, b = v.select(F.col("id").alias("i"), F.col("features").alias("a")), v.select(F.col("id").alias("j"), F.col("features").alias("b"))
        return a.join(b, F.col("j") == F.col("i") + 1).select("i", "j", r6(distance(metric)(F.col("a"), F.col("b")), "dist"))


@query("l2_norm", f"WITH {S.V} SELECT id, round(sqrt(list_dot_product(f, f)), 6) AS norm FROM v")
def _(spark, d):
    from vecspan.functions.vectors import norm

    return emb(spark, d).select("id", r6(norm(F.col("features")), "norm"))


@query("phase_weights", """SELECT it::BIGINT AS it, CASE WHEN it < 100 THEN 2.0::DOUBLE WHEN it < 200 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS near,
 round(CASE WHEN it < 100 THEN 1000.0 - 997.0 * it / 100.0 WHEN it < 200 THEN 3.0 ELSE 0.0 END::DOUBLE, 6) AS mid, 1.0::DOUBLE AS far,
 CASE WHEN it < 100 THEN 'Phase 1: Global Structure' WHEN it < 200 THEN 'Phase 2: Balance' ELSE 'Phase 3: Local Structure' END AS phase FROM range(450) r(it)""")
def _(spark, d):
    near, mid, far = schedules.phase_weights(F.col("it"))
    return spark.range(450).withColumnRenamed("id", "it").select("it", near.alias("near"), r6(mid, "mid"), far.alias("far"), schedules.phase_name(F.col("it")).alias("phase"))


@query("lr_schedules", """SELECT it::BIGINT AS it, round(0.5 * (1 + cos(pi() * it / 450)), 6) AS cosine, round(pow(0.5, it // 100), 6) AS step,
 round(greatest(1e-6, least(10.0, CASE WHEN it % 3 > 1 THEN 0.95 WHEN it % 3 < 1 THEN 1.02 ELSE 1.0 END::DOUBLE)), 6) AS adaptive FROM range(450) r(it)""")
def _(spark, d):
    it = F.col("it")
    return spark.range(450).withColumnRenamed("id", "it").select("it", r6(schedules.cosine_rate(1.0, it, 450), "cosine"), r6(schedules.step_rate(1.0, it, 0.5, 100), "step"), r6(schedules.adaptive_rate(F.lit(1.0), (it % 3).cast("double"), F.lit(1.0)), "adaptive"))


@query("phase_interpolation", "SELECT it::BIGINT AS it, round(2.0 + (1.0 - 2.0) * it / 450.0, 6)::DOUBLE AS weight FROM range(450) r(it)")
def _(spark, d):
    return spark.range(450).withColumnRenamed("id", "it").select("it", r6(schedules.interpolated(F.col("it"), 450, 2.0, 1.0), "weight"))


@query("stagnation_rate", "SELECT it::BIGINT AS it, CASE WHEN it % 2 = 0 AND it > 10 THEN 0.9::DOUBLE WHEN it % 2 = 1 AND it % 4 = 1 THEN 1.02::DOUBLE ELSE 1.0::DOUBLE END AS lr FROM range(20) r(it)")
def _(spark, d):
    it = F.col("it")
    loss = F.when(it % 2 == 0, 1.0).when(it % 4 == 1, 0.5).otherwise(2.0)
    return spark.range(20).withColumnRenamed("id", "it").select("it", r6(schedules.stagnation_rate(F.lit(1.0), loss, F.lit(1.0), it), "lr"))


@query("recommended_neighbors", "SELECT n::BIGINT AS n, greatest(10, least(100, floor(10 + 15 * (log10(n) - 4))))::INT AS k FROM (VALUES (100), (10000), (50000), (1000000), (20000000)) t(n)")
def _(spark, d):
    return spark.createDataFrame([(n,) for n in (100, 10000, 50000, 1000000, 20000000)], "n long").select("n", schedules.recommended_neighbors(F.col("n")).alias("k"))


@query("pair_counts", "WITH t AS (SELECT count(*) AS n FROM embeddings) SELECT k::INT AS k, k::INT AS near, floor(k * 0.5)::INT AS mid, floor(k * 2.0)::INT AS far FROM t, (VALUES (5), (10), (15)) x(k)")
def _(spark, d):
    n = emb(spark, d).count()
    rows = [(k, c.near, c.mid, c.far) for k in (5, 10, 15) for c in [schedules.pair_counts(n, k, 0.5, 2.0)]]
    return spark.createDataFrame(rows, "k int, near int, mid int, far int")


@query("nice_step", f"WITH {S.CELLS}, s AS (SELECT pos, max(x) - min(x) AS span FROM c GROUP BY pos), t AS (SELECT pos, span, span / 8.0 AS rough, pow(10.0, floor(log10(span / 8.0))) AS p FROM s) SELECT pos, round(greatest(0.1, p * CASE WHEN p >= rough THEN 1.0 WHEN 2 * p >= rough THEN 2.0 ELSE 5.0 END), 6) AS step FROM t")
def _(spark, d):
    return normalize.column_summary(emb(spark, d)).select("pos", r6(schedules.nice_step(F.col("maximum") - F.col("minimum")), "step"))


@query("format_bytes", "SELECT n, CASE WHEN n < 1024 THEN printf('%.2f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0) ELSE printf('%.2f MB', n / 1048576.0) END AS text FROM (SELECT pow(3, k)::BIGINT AS n FROM range(18) r(k))")
def _(spark, d):
    return spark.range(18).select(F.pow(F.lit(3.0), F.col("id")).cast("long").alias("n")).select("n", schedules.format_bytes(F.col("n")).alias("text"))


# Nearest neighbours ---------------------------------------------------------------------------------------------

for _metric in ("euclidean", "cosine", "manhattan", "correlation", "hamming"):

    @query(f"knn_{_metric}", f"WITH {S.V}, {S.knn(S.K, _metric)} SELECT i, j, rank::INT AS rank, round(dist, 6) + 0.0 AS dist FROM knn")
    def _(spark, d, metric=_metric):
        return ranked(neighbors(emb(spark, d), S.K, metric))


@query("knn_sql_form", f"WITH {S.V}, {S.knn(5, where='a.id <> b.id')} SELECT i, j, rank::INT AS rank, round(dist, 6) AS dist FROM knn")
def _(spark, d):
    v = emb(spark, d)
    return ranked(knn.knn_sql(v, v, 5))


@query("knn_nested_blocks", f"WITH {S.V}, {S.knn(S.K)} SELECT i, j, rank::INT AS rank, round(dist, 6) AS dist FROM knn")
def _(spark, d):
    v = emb(spark, d)
    return ranked(knn.knn_block(v, v, S.K, broadcast_bytes=0))


@query("knn_filtered", f"WITH {S.V}, {S.knn(S.K, where='a.id <> b.id AND b.label = 0')} SELECT i, j, rank::INT AS rank, round(dist, 6) AS dist FROM knn")
def _(spark, d):
    v = emb(spark, d)
    return ranked(knn.knn_block(v, v.where("label = 0"), S.K))


@query("knn_range_epsilon", f"""WITH {S.V}, d AS MATERIALIZED (SELECT a.id AS i, b.id AS j, {S.dist('euclidean')} AS dist FROM v a JOIN v b ON a.id <> b.id),
 e AS MATERIALIZED (SELECT avg(m) AS eps FROM (SELECT min(dist) AS m FROM d GROUP BY i)),
 r AS (SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM d)
 SELECT i, j, rank::INT AS rank, round(dist, 6) AS dist FROM r WHERE rank <= 20 AND (rank <= 2 OR dist <= (SELECT eps FROM e))""")
def _(spark, d):
    v = emb(spark, d)
    eps = neighbors(v, 1).agg(F.avg("dist")).first()[0]
    return ranked(knn.range_search(v, v, eps, at_least=2, at_most=20))


@query("knn_grouped_docs", f"WITH {S.V}, b AS (SELECT a.id AS i, b.label AS grp, min({S.dist('euclidean')}) AS dist FROM v a JOIN v b ON a.id <> b.id GROUP BY 1, 2) SELECT i, grp, rank::INT AS rank, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, grp) AS rank FROM b) WHERE rank <= 3")
def _(spark, d):
    v = emb(spark, d)
    return knn.grouped_search(v, v, "label", 3).select("i", "grp", F.col("rank").cast("int").alias("rank"), r6("dist", "dist"))


@query("knn_padded", f"WITH {S.V}, {S.knn(4)}, e AS (SELECT avg(dist) AS eps FROM knn WHERE rank = 1), near AS (SELECT knn.* FROM knn, e WHERE dist <= eps), slots AS (SELECT id AS i, r AS rank FROM v, range(1, 5) t(r)) SELECT s.i, coalesce(k.j, -1)::BIGINT AS j, s.rank::INT AS rank, round(coalesce(k.dist, 1e6), 6) AS dist FROM slots s LEFT JOIN near k ON k.i = s.i AND k.rank = s.rank")
def _(spark, d):
    v = emb(spark, d)
    eps = neighbors(v, 1).agg(F.avg("dist")).first()[0]
    return ranked(knn.padded(knn.range_search(v, v, eps, at_most=4), v, 4))


@query("prefix_knn", f"WITH {S.V}, {S.knn(5, where='b.id <= a.id')} SELECT i, j, rank::INT AS rank, round(dist, 6) AS dist FROM knn")
def _(spark, d):
    return ranked(knn.prefix_knn(emb(spark, d), 5))


@query("distance_matrix", f"WITH {S.V} SELECT a.id AS i, b.id AS j, round({S.dist('euclidean')}, 6) AS dist FROM v a JOIN v b ON a.id <> b.id")
def _(spark, d):
    return knn.distance_matrix(emb(spark, d)).select("i", "j", r6("dist", "dist"))


@query("transform_lookup", f"WITH {S.V}, {S.knn(S.K, where='true')} SELECT i, j, rank::INT AS rank, round(dist, 6) AS dist FROM knn")
def _(spark, d):
    v = emb(spark, d)
    return ranked(knn.knn_block(v, v, S.K, skip_self=False))


@query("knn_recall", "SELECT true AS good")
def _(spark, d):
    v = emb(spark, d)
    found = knn.recall(neighbors(v, S.K), knn.knn_ivf(v, v, S.K, cells=16, probe=14), S.K)
    return found.select((F.col("recall") >= 0.9).alias("good"))


@query("knn_recall_metrics", f"WITH {S.V}, {S.knn(S.K)}, {S.knn(S.K, 'cosine', name='other')} SELECT round((SELECT count(*) FROM knn JOIN other USING (i, j)) / (SELECT count(*) FROM knn), 6) AS recall")
def _(spark, d):
    v = emb(spark, d)
    return knn.recall(neighbors(v, S.K), neighbors(v, S.K, "cosine"), S.K).select(r6("recall", "recall"))


@query("ivf_knn")
def _(spark, d):
    v = emb(spark, d)
    return ranked(knn.knn_ivf(v, v, S.K, cells=16, probe=14))


@query("ivf_given_cells", f"""WITH {S.CELLS}, m AS (SELECT label, list(x ORDER BY pos) AS f FROM (SELECT label, pos, avg(x) AS x FROM c GROUP BY label, pos) GROUP BY label),
 g AS (SELECT v.id, v.f, m.label AS cell, row_number() OVER (PARTITION BY v.id ORDER BY {S.zipped('v.f', 'm.f', '(p[1] - p[2]) * (p[1] - p[2])')}, m.label) AS r FROM v, m),
 p AS (SELECT a.id AS i, b.id AS j, {S.dist('euclidean')} AS dist FROM g a JOIN g b ON a.cell = b.cell AND a.id <> b.id WHERE a.r <= 2 AND b.r = 1)
 SELECT i, j, rank::INT AS rank, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM p) WHERE rank <= {S.K}""")
def _(spark, d):
    v = emb(spark, d)
    means = v.select("label", F.posexplode("features").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    rows = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("f")).orderBy("label").collect()  # one row per label
    return ranked(knn.knn_ivf(v, v, S.K, probe=2, given=[r["f"] for r in rows]))


@query("ivf_tuned", "SELECT 6::BIGINT AS settings, 1::BIGINT AS chosen, true AS reached")
def _(spark, d):
    t = knn.tune_ivf(emb(spark, d), S.K)
    return t.agg(F.count("*").alias("settings"), F.count_if("chosen").alias("chosen"), (F.max(F.when(F.col("chosen"), F.col("recall"))) >= 0.95).alias("reached"))


_CHANGED = "CASE WHEN label = 1 THEN list_transform(f, lambda x: 2 * x) ELSE f END"


@query("index_upsert", f"WITH {S.V} SELECT id, label + CASE WHEN label = 1 THEN 100 ELSE 0 END AS label, round(list_sum({_CHANGED}), 6) + 0.0 AS total FROM v WHERE label <> 2 UNION ALL SELECT id + 1000000, label, round(list_sum(f), 6) + 0.0 FROM v WHERE label = 3")
def _(spark, d):
    v = emb(spark, d)
    updates = v.where("label = 1").select("id", F.transform("features", lambda x: 2 * x).alias("features"), (F.col("label") + 100).alias("label"))
    inserts = v.where("label = 3").withColumn("id", F.col("id") + 1000000)
    out = knn.upsert(v, updates.unionByName(inserts), v.where("label = 2"))
    return out.select("id", "label", r6(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), "total"))


@query("index_marks", f"WITH {S.V} SELECT id, round(list_sum(f), 6) + 0.0 AS total FROM v WHERE id % 5 = 0 AND (id % 3 <> 0 OR id % 2 = 0)")
def _(spark, d):
    v = emb(spark, d)
    gone = knn.mark_deleted(v, v.where("id % 3 = 0"))
    back = knn.unmark_deleted(gone, v.where("id % 6 = 0"))
    return knn.fetch(back, v.where("id % 5 = 0")).select("id", r6(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), "total"))


@query("index_replace_deleted", f"WITH {S.V} SELECT id, label FROM v WHERE label <> 2 UNION ALL SELECT id + 1000000, label FROM v WHERE label = 2 AND id % 2 = 0")
def _(spark, d):
    v = emb(spark, d)
    index = knn.mark_deleted(v, v.where("label = 2"))
    return knn.replace_deleted(index, v.where("label = 2 AND id % 2 = 0").withColumn("id", F.col("id") + 1000000)).select("id", "label")


@query("cross_neighbors", f"WITH {S.V}, {S.knn(S.K, where='a.id % 4 = 0 AND b.id % 4 <> 0')} SELECT i, j, rank::INT AS rank, round(dist, 6) AS dist FROM knn")
def _(spark, d):
    v = emb(spark, d)
    return ranked(knn.cross_neighbors(v.where("id % 4 = 0"), v.where("id % 4 <> 0"), S.K))


@query("knn_graph_checks", f"WITH {S.V}, {S.knn(S.K, where='true')} SELECT count(*) FILTER (i = j) AS self_links, count(*) FILTER (j % 7 = 0) AS unknown_links, (SELECT count(*) FROM v ANTI JOIN knn ON v.id = knn.j WHERE v.id % 7 <> 0) + 3 AS unreached FROM knn")
def _(spark, d):
    v = emb(spark, d)
    nodes = v.where("id % 7 <> 0").select("id").union(spark.range(10**9, 10**9 + 3))  # some known rows are missing, some are new
    return knn.graph_checks(knn.knn_block(v, v, S.K, skip_self=False), nodes)


@query("sql_distances", f"WITH {S.V}, w AS (SELECT id, list_transform(f, lambda x: x - list_avg(f)) AS cf, f FROM v) SELECT a.id AS i, " + ", ".join(f"round({S.dist(m)}, 6) + 0.0 AS {m}" for m in METRICS) + " FROM w a JOIN w b ON b.id = a.id + 1")
def _(spark, d):
    sql.register(spark)
    emb(spark, d).createOrReplaceTempView("vecspan_rows")
    cols = ", ".join(f"round(vec_{m}(a.features, b.features), 6) + 0.0D AS {m}" for m in METRICS)
    return spark.sql(f"SELECT a.id AS i, {cols} FROM vecspan_rows a JOIN vecspan_rows b ON b.id = a.id + 1")


@query("sql_filter", f"WITH {S.V}, o AS (SELECT f FROM v ORDER BY id LIMIT 1) SELECT b.id, round({S.dist('cosine')}, 6) + 0.0 AS dist FROM (SELECT f FROM o) a, v b WHERE {S.dist('cosine')} < 0.9 AND b.label <> 0")
def _(spark, d):
    sql.register(spark)
    emb(spark, d).createOrReplaceTempView("vecspan_rows")
    return spark.sql("SELECT b.id, round(vec_cosine(a.features, b.features), 6) + 0.0D AS dist FROM (SELECT features FROM vecspan_rows ORDER BY id LIMIT 1) a CROSS JOIN vecspan_rows b WHERE vec_cosine(a.features, b.features) < 0.9 AND b.label <> 0")


# Pairs ----------------------------------------------------------------------------------------------------------


@query("local_sigma", f"WITH {S.V}, {S.knn(S.EXTRA)}, {S.SIGMA} SELECT i, round(sigma, 6) AS sigma FROM sigma")
def _(spark, d):
    return pairs.local_scale(neighbors(emb(spark, d), S.EXTRA)).select("i", r6("sigma", "sigma"))


@query("scaled_knn", f"WITH {S.V}, {S.knn(S.EXTRA)}, {S.SIGMA} SELECT i, j, round(scaled, 6) AS scaled FROM scaled")
def _(spark, d):
    return pairs.scaled(neighbors(emb(spark, d), S.EXTRA)).select("i", "j", r6("scaled", "scaled"))


@query("neighbor_pairs", f"WITH {S.V}, {S.knn(S.EXTRA)}, {S.SIGMA} SELECT i, j, kind FROM near")
def _(spark, d):
    return pairs.near_pairs(neighbors(emb(spark, d), S.EXTRA), S.K)


@query("further_pairs", f"WITH {S.V}, {S.knn(S.EXTRA)}, {S.SIGMA}, {S.FAR} SELECT i, j, kind FROM far")
def _(spark, d):
    v = emb(spark, d)
    near = pairs.near_pairs(neighbors(v, S.EXTRA), S.K)
    return pairs.far_pairs(v, near, v.count(), S.N_FAR, S.SEED)


@query("midnear_pairs", f"WITH {S.V}, {S.MID} SELECT i, j, kind FROM mid")
def _(spark, d):
    v = emb(spark, d)
    return pairs.mid_pairs(v, v.count(), S.N_MID, S.SEED)


@query("pair_union_counts", f"WITH {S.PAIRS} SELECT kind, count(*) AS n FROM pairs GROUP BY kind")
def _(spark, d):
    return pairs.counts(sampled(emb(spark, d)))


@query("pair_filter_invalid", f"WITH {S.PAIRS}, broken AS (SELECT CASE WHEN i % 50 = 0 THEN j ELSE i END AS i, CASE WHEN j % 70 = 0 THEN -1 ELSE j END AS j, kind FROM pairs) SELECT i, j, kind FROM broken WHERE i >= 0 AND j >= 0 AND i < (SELECT count(*) FROM v) AND j < (SELECT count(*) FROM v) AND i <> j")
def _(spark, d):
    v = emb(spark, d)
    broken = sampled(v).select(F.when(F.col("i") % 50 == 0, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(F.col("j") % 70 == 0, -1).otherwise(F.col("j")).alias("j"), "kind")
    return pairs.valid(broken, v.count())


@query("pair_dedup", f"WITH {S.PAIRS} SELECT i, j, kind FROM (SELECT *, row_number() OVER (PARTITION BY least(i, j), greatest(i, j) ORDER BY kind, i, j) AS r FROM pairs) WHERE r = 1")
def _(spark, d):
    return pairs.undirected(sampled(emb(spark, d)))


@query("pair_quality", f"WITH {S.PAIRS}, n AS (SELECT count(*) AS n FROM v) SELECT count(*) FILTER (kind = 0) AS n_near, count(*) FILTER (kind = 1) AS n_mid, count(*) FILTER (kind = 2) AS n_far, count(*) FILTER (i = j) AS n_self, count(*) FILTER (i < 0 OR j < 0 OR i >= n OR j >= n) AS n_outside, round(count(DISTINCT i) * 100.0 / any_value(n), 6)::DOUBLE AS i_coverage, round(count(DISTINCT j) * 100.0 / any_value(n), 6)::DOUBLE AS j_coverage FROM pairs, n")
def _(spark, d):
    v = emb(spark, d)
    q = pairs.quality(sampled(v), v.count())
    return q.select(*[c for c in q.columns if "coverage" not in c], r6(F.col("i_coverage").cast("double"), "i_coverage"), r6(F.col("j_coverage").cast("double"), "j_coverage"))


@query("pair_distance_distribution", f"WITH {S.PAIRS}, x AS (SELECT kind, list_distance(a.f, b.f) AS dist FROM pairs p JOIN v a ON a.id = p.i JOIN v b ON b.id = p.j) SELECT kind, round(min(dist), 6) AS least, round(max(dist), 6) AS most, round(avg(dist), 6) AS mean, round(stddev_pop(dist), 6) AS deviation FROM x GROUP BY kind")
def _(spark, d):
    v = emb(spark, d)
    return pairs.distance_distribution(sampled(v), v).select("kind", *[r6(c, c) for c in ("least", "most", "mean", "deviation")])


@query("pair_kinds_ordered", f"WITH {S.PAIRS}, x AS (SELECT kind, avg(list_distance(a.f, b.f)) AS m FROM pairs p JOIN v a ON a.id = p.i JOIN v b ON b.id = p.j GROUP BY kind) SELECT max(m) FILTER (kind = 0) < max(m) FILTER (kind = 1) AND max(m) FILTER (kind = 1) < max(m) FILTER (kind = 2) AS ordered FROM x")
def _(spark, d):
    v = emb(spark, d)
    return pairs.ordered_kinds(pairs.distance_distribution(sampled(v), v))


@query("pair_coverage", f"WITH {S.PAIRS}, e AS (SELECT kind, i AS id FROM pairs UNION ALL SELECT kind, j FROM pairs), g AS (SELECT kind, id, count(*) AS n FROM e GROUP BY kind, id) SELECT kind, count(*) AS n_rows, max(n) AS most FROM g GROUP BY kind")
def _(spark, d):
    return pairs.coverage(sampled(emb(spark, d)))


@query("pair_anomalies", f"WITH {S.PAIRS}, u AS (SELECT least(i, j) AS a, greatest(i, j) AS b, count(*) AS n FROM pairs GROUP BY 1, 2), g AS (SELECT id, count(*) AS n FROM (SELECT i AS id FROM pairs UNION ALL SELECT j FROM pairs) GROUP BY id) SELECT (SELECT count(*) FROM u WHERE n > 1) AS repeated, (SELECT count(*) FROM g WHERE n > 50) AS busy")
def _(spark, d):
    return pairs.anomalies(sampled(emb(spark, d)))


@query("distance_percentiles", f"WITH {S.V}, s AS (SELECT * FROM v ORDER BY id LIMIT 1000), x AS (SELECT list_sort(list({S.dist('euclidean')})) AS d FROM s a JOIN s b ON a.id < b.id) SELECT round(d[1 + floor(len(d) * 0.25)::INT], 6) AS p25, round(d[1 + floor(len(d) * 0.75)::INT], 6) AS p75, round(d[1 + floor(len(d) * 0.9)::INT], 6) AS p90 FROM x")
def _(spark, d):
    return pairs.distance_percentiles(emb(spark, d)).select(*[r6(c, c) for c in ("p25", "p75", "p90")])


@query("distance_band_pairs", f"WITH {S.V}, {S.drawn('band', 8, 'bd')}, u AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM bd), x AS (SELECT u.i, u.j, list_distance(a.f, b.f) AS dist FROM u JOIN v a ON a.id = u.i JOIN v b ON b.id = u.j) SELECT i, j, round(dist, 6) AS dist FROM x WHERE dist BETWEEN 1.2 AND 1.45")
def _(spark, d):
    v = emb(spark, d)
    return pairs.band_pairs(v, v.count(), 8, 1.2, 1.45).select("i", "j", r6("dist", "dist"))


@query("far_pairs_resampled", f"""WITH {S.V}, {S.knn(S.EXTRA)}, {S.SIGMA}, {S.FAR}, {S.Y}, {S.drawn('close', 100, 'cd')},
 cl AS (SELECT cd.i, cd.j, row_number() OVER (PARTITION BY cd.i ORDER BY t) AS slot FROM cd JOIN y a ON a.id = cd.i JOIN y b ON b.id = cd.j WHERE list_distance(a.y, b.y) <= 0.2),
 old AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY j) AS slot FROM far)
 SELECT o.i, coalesce(c.j, o.j) AS j, 2 AS kind FROM old o LEFT JOIN cl c ON c.i = o.i AND c.slot = o.slot""")
def _(spark, d):
    v = emb(spark, d)
    near = pairs.near_pairs(neighbors(v, S.EXTRA), S.K)
    n = v.count()
    return pairs.near_resampled_far(v, plane(spark, d), pairs.far_pairs(v, near, n, S.N_FAR, S.SEED), n, S.N_FAR, 0.2)


# Optimiser ------------------------------------------------------------------------------------------------------

_W = (3.0, 3.0, 1.0)
_STEP = f"WITH {S.PAIRS}, {S.Y}, {S.ENDS}, {S.grad(_W)}"


@query("gradient_step", f"{_STEP} SELECT id, pos, round(g, 6) + 0.0 AS g FROM grad")
def _(spark, d):
    return optimize.gradient(sampled(emb(spark, d)), plane(spark, d), _W).select("id", "pos", r6("g", "g"))


@query("gradient_norm_clip", f"{_STEP}, s AS (SELECT sqrt(sum(g * g)) AS s FROM grad) SELECT id, pos, round(CASE WHEN s > 1.0 THEN g * 1.0 / s ELSE g END, 6) + 0.0 AS g FROM grad, s")
def _(spark, d):
    g = optimize.gradient(sampled(emb(spark, d)), plane(spark, d), _W)
    return optimize.clipped(g, 1.0).select("id", "pos", r6("g", "g"))


@query("gradient_normalized", f"{_STEP}, s AS (SELECT sqrt(sum(g * g)) AS s FROM grad) SELECT id, pos, round(CASE WHEN s > 1e-15 THEN g / s ELSE g END, 9) + 0.0 AS g FROM grad, s")
def _(spark, d):
    g = optimize.gradient(sampled(emb(spark, d)), plane(spark, d), _W)
    return optimize.normalized(g).select("id", "pos", (F.round("g", 9) + 0.0).alias("g"))


@query("gradient_checks", f"{_STEP} SELECT count(*) FILTER (isnan(g)) AS n_nan, count(*) FILTER (isinf(g)) AS n_inf, count(*) FILTER (abs(g) > 1e10) AS n_large FROM grad")
def _(spark, d):
    return optimize.gradient_checks(optimize.gradient(sampled(emb(spark, d)), plane(spark, d), _W))


@query("loss_native", f"WITH {S.PAIRS}, {S.Y}, {S.ENDS}, d AS (SELECT kind, sqrt(d2 - 1.0) AS d FROM ends) SELECT round(avg(CASE kind WHEN 0 THEN 3.0 * d / (10.0 + d) WHEN 1 THEN 3.0 * d / (10000.0 + d) ELSE 1.0 / (1.0 + d) END), 6) AS loss FROM d")
def _(spark, d):
    return optimize.loss(sampled(emb(spark, d)), plane(spark, d), _W).select(r6("loss", "loss"))


@query("loss_objective", f"WITH {S.PAIRS}, {S.Y}, {S.ENDS} SELECT round(avg(CASE kind WHEN 0 THEN 3.0 * d2 / (10.0 + d2) WHEN 1 THEN 3.0 * d2 / (10000.0 + d2) ELSE 1.0 / (1.0 + d2) END), 6) AS loss FROM ends")
def _(spark, d):
    return optimize.loss(sampled(emb(spark, d)), plane(spark, d), _W, objective=True).select(r6("loss", "loss"))


@query("adam_step", f"{_STEP}, s AS (SELECT id, 0 AS pos, y[1] AS y FROM y UNION ALL SELECT id, 1, y[2] FROM y), m AS (SELECT s.id, s.pos, s.y, 0.1 * coalesce(g, 0) AS m, 0.001 * coalesce(g, 0) * coalesce(g, 0) AS v FROM s LEFT JOIN grad ON s.id = grad.id AND s.pos = grad.pos) SELECT id, pos, round(y - sqrt(1 - 0.999) / (1 - 0.9) * m / (sqrt(v) + 1e-7), 6) + 0.0 AS y FROM m")
def _(spark, d):
    g = optimize.gradient(sampled(emb(spark, d)), plane(spark, d), _W)
    return optimize.adam_step(optimize.long_state(plane(spark, d)), g, 1).select("id", "pos", r6("y", "y"))


@query("sgd_step", f"{_STEP}, s AS (SELECT id, 0 AS pos, y[1] AS y FROM y UNION ALL SELECT id, 1, y[2] FROM y) SELECT s.id, s.pos, round(s.y - 0.5 * coalesce(g, 0), 6) + 0.0 AS y FROM s LEFT JOIN grad ON s.id = grad.id AND s.pos = grad.pos")
def _(spark, d):
    g = optimize.gradient(sampled(emb(spark, d)), plane(spark, d), _W)
    return optimize.sgd_step(optimize.long_state(plane(spark, d)), g, 0.5).select("id", "pos", r6("y", "y"))


@query("embedding_pair_quality", f"WITH {S.PAIRS}, {S.Y}, {S.ENDS}, d AS (SELECT kind, sqrt(d2 - 1.0) AS d FROM ends) SELECT round(avg(CASE kind WHEN 0 THEN 1.0 / (1.0 + d) WHEN 1 THEN d / (100.0 + d) ELSE d / (1.0 + d) END), 6) AS quality FROM d")
def _(spark, d):
    return optimize.pair_quality(sampled(emb(spark, d)), plane(spark, d)).select(r6("quality", "quality"))


@query("convergence_window", """WITH h AS (SELECT it, 1.0 / (1 + it) AS loss FROM range(60) r(it)),
 w AS (SELECT it, abs(avg(loss) OVER (ORDER BY it ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - avg(loss) OVER (ORDER BY it ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING)) AS c FROM h)
 SELECT it::INT AS iter, CASE WHEN it >= 9 THEN round(c, 6) END AS change, it >= 9 AND c < 0.002 AS stopped FROM w""")
def _(spark, d):
    h = spark.range(60).select(F.col("id").cast("int").alias("iter"), (1.0 / (1 + F.col("id"))).alias("loss"))
    return optimize.converged(h, 10, 0.002).select("iter", r6("change", "change"), "stopped")


@query("early_termination", """WITH h AS (SELECT it, CASE WHEN it < 30 THEN 1.0 / (1 + it) ELSE 0.04 + 0.001 * it END AS loss FROM range(60) r(it))
 SELECT it::INT AS iter, it >= 9 AND min(loss) OVER (ORDER BY it ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) >= 0.999 * min(loss) OVER (ORDER BY it) AS stopped FROM h""")
def _(spark, d):
    it = F.col("id")
    h = spark.range(60).select(it.cast("int").alias("iter"), F.when(it < 30, 1.0 / (1 + it)).otherwise(0.04 + 0.001 * it).alias("loss"))
    return optimize.stopped_early(h, 10)


@query("initial_from_components")
def _(spark, d):
    return long(optimize.initial_from(emb(spark, d)), "y")


@query("initial_given", f"WITH {S.V}, e AS (SELECT id, f[1] AS a, f[2] AS b FROM v), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM e) SELECT id, 0 AS pos, round((a - ma) / sa, 6) + 0.0 AS x FROM e, s UNION ALL SELECT id, 1, round((b - mb) / sb, 6) + 0.0 FROM e, s")
def _(spark, d):
    return long(optimize.initial_given(plane(spark, d), 1.0), "y")


@query("initial_embedding", f"""WITH {S.V}, k AS (SELECT id, p::INT AS pos, ({S.hash_draw("'42'", "'init'", "id::VARCHAR", "p::VARCHAR", "'a'")} + 0.5) / 4294967296.0 AS a, ({S.hash_draw("'42'", "'init'", "id::VARCHAR", "p::VARCHAR", "'b'")} + 0.5) / 4294967296.0 AS b FROM v, range(2) r(p))
 SELECT id, pos, round(sqrt(-2 * ln(a)) * cos(2 * pi() * b), 6) + 0.0 AS x FROM k""")
def _(spark, d):
    return long(optimize.initial(emb(spark, d), 2, 1.0), "y")


# Model ----------------------------------------------------------------------------------------------------------

_SAFE = f"""WITH {S.V}, e AS (SELECT id, label, [f[1], f[2]] AS f FROM v),
t AS (SELECT * FROM e), q AS (SELECT * FROM e),
tk AS (SELECT dist FROM (SELECT {S.dist('euclidean')} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {S.dist('euclidean')}, b.id) AS r FROM t a JOIN t b ON a.id <> b.id) WHERE r <= 10),
o AS (SELECT list_sort(list(dist)) AS l, avg(dist) AS mean, stddev_pop(dist) AS dev FROM tk),
st AS (SELECT l[1] AS least, l[1 + floor(0.95 * len(l))::INT] AS p95, l[1 + floor(0.99 * len(l))::INT] AS p99, mean, dev, mean + 2.5 * dev AS mild, mean + 4 * dev AS extreme FROM o),
nn AS (SELECT a.id, min({S.dist('euclidean')}) AS nearest FROM q a JOIN t b ON a.id <> b.id GROUP BY a.id),
sc AS (SELECT id, nearest, least(1.0, greatest(0.0, exp(-nearest / (p95 + 1e-8)))) AS confidence,
  CASE WHEN nearest <= p95 THEN 0 WHEN nearest <= p99 THEN 1 WHEN nearest <= mild THEN 2 WHEN nearest <= extreme THEN 3 ELSE 4 END AS outlier_level,
  least(99.0, nearest / p95 * 95.0) AS percentile_rank, (nearest - mean) / dev AS z_score FROM nn, st)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Every row scored against all others."""
    e = plane(spark, d).select("id", F.col("y").alias("features"))
    near = knn.knn_block(e, e, 10)
    figures = stats.distance_stats(near).first().asDict()
    return stats.safety(near.where("rank = 1").select(F.col("i").alias("id"), F.col("dist").alias("nearest")), figures)


@query("embedding_stats", f"{_SAFE} SELECT round(least, 6) AS least, round(p95, 6) AS p95, round(p99, 6) AS p99, round(mean, 6) AS mean, round(dev, 6) AS deviation, round(mild, 6) AS mild, round(extreme, 6) AS extreme FROM st")
def _(spark, d):
    t = plane(spark, d).select("id", F.col("y").alias("features"))
    s = stats.distance_stats(knn.knn_block(t, t, 10))
    return s.select(*[r6(c, c) for c in s.columns])


@query("first_rows_stats", f"WITH {S.V}, e AS (SELECT id, [f[1], f[2]] AS f FROM v ORDER BY id LIMIT 1000), o AS (SELECT list_sort(list({S.dist('euclidean')})) AS l, avg({S.dist('euclidean')}) AS mean, stddev_pop({S.dist('euclidean')}) AS dev FROM e a JOIN e b ON a.id < b.id) SELECT round(l[1], 6) AS least, round(l[1 + floor(0.95 * len(l))::INT], 6) AS p95, round(l[1 + floor(0.99 * len(l))::INT], 6) AS p99, round(mean, 6) AS mean, round(dev, 6) AS deviation, round(mean + 2.5 * dev, 6) AS mild, round(mean + 4 * dev, 6) AS extreme FROM o")
def _(spark, d):
    s = stats.first_rows_stats(plane(spark, d).select("id", F.col("y").alias("features")))
    return s.select(*[r6(c, c) for c in s.columns])


@query("transform_interpolate", f"WITH {S.V}, {S.knn(S.K)}, w AS (SELECT i, 1.0 / (dist + 1e-8) AS w, v.f AS f FROM knn JOIN v ON v.id = knn.j) SELECT i, 0 AS pos, round(sum(w * f[1]) / sum(w), 6) + 0.0 AS y FROM w GROUP BY i UNION ALL SELECT i, 1, round(sum(w * f[2]) / sum(w), 6) + 0.0 FROM w GROUP BY i")
def _(spark, d):
    v = emb(spark, d)
    near = knn.knn_block(v, v, S.K)
    return stats.interpolation(near, plane(spark, d)).select("i", "pos", r6("y", "y"))


@query("transform_safety", f"{_SAFE} SELECT id, round(nearest, 6) AS nearest, round(confidence, 6) AS confidence, outlier_level, round(percentile_rank, 6) AS percentile_rank, round(z_score, 6) + 0.0 AS z_score, outlier_level <= 1 AND confidence >= 0.3 AS is_reliable FROM sc")
def _(spark, d):
    return _scored(spark, d).select("id", r6("nearest", "nearest"), r6("confidence", "confidence"), "outlier_level", r6("percentile_rank", "percentile_rank"), r6("z_score", "z_score"), "is_reliable")


@query("outlier_report", f"{_SAFE} SELECT outlier_level, count(*) AS n, count(*) FILTER (outlier_level <= 1 AND confidence >= 0.3) AS reliable, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most, round(avg(confidence), 6) AS mean, ['Normal', 'Unusual', 'Mild', 'Extreme', 'NoMansLand'][outlier_level + 1] AS level FROM sc GROUP BY outlier_level")
def _(spark, d):
    r = stats.safety_report(_scored(spark, d))
    return r.select("outlier_level", "n", "reliable", *[r6(c, c) for c in ("least", "most", "mean")], "level")


@query("quality_texts", f"{_SAFE} SELECT id, ['Excellent - Very similar to training data', 'Good - Somewhat similar to training data', 'Caution - Mild outlier, projection may be less accurate', 'Warning - Extreme outlier, projection unreliable', 'Critical - Far from training data, projection highly unreliable'][outlier_level + 1] AS quality FROM sc")
def _(spark, d):
    return _scored(spark, d).select("id", stats.quality_text(F.col("outlier_level")).alias("quality"))


@query("neighbor_summary", f"WITH {S.V}, {S.knn(S.K)} SELECT i, round(min(dist), 6) AS nearest, round(avg(dist), 6) AS mean_dist FROM knn GROUP BY i")
def _(spark, d):
    return stats.neighbor_summary(neighbors(emb(spark, d), S.K)).select("i", r6("nearest", "nearest"), r6("mean_dist", "mean_dist"))


def _fitted(spark: SparkSession, d: str, **more) -> model.EmbeddingModel:
    return model.EmbeddingEstimator(seed=42, **more).fit(emb(spark, d))


@query("fit_embedding")
def _(spark, d):
    return long(_fitted(spark, d).embedding, "y")


@query("fit_checks", "SELECT count(*) AS n, count(*) AS ids, 0::BIGINT AS n_wrong_width, 0::BIGINT AS n_nan, 0::BIGINT AS n_inf, true AS nearer, true AS falling FROM embeddings")
def _(spark, d):
    """One place for every row, near pairs nearer than far ones, and a loss that fell."""
    m = _fitted(spark, d, keep_pairs=True)
    state = optimize.state_checks(m.embedding, 2)
    ids = m.embedding.join(emb(spark, d).select("id"), "id").agg(F.count_distinct("id").alias("ids"))
    placed = pairs.distance_distribution(m.pairs, m.embedding.select("id", F.col("y").alias("features")))
    mean = {r["kind"]: r["mean"] for r in placed.collect()}
    loss = m.diagnostics().first()
    checks = state.withColumn("ids", ids.scalar()).withColumn("nearer", F.lit(mean[pairs.NEAR] < mean[pairs.FAR])).withColumn("falling", F.lit(loss["loss_reduction"] > 0))
    return checks.select("n", "ids", "n_wrong_width", "n_nan", "n_inf", "nearer", "falling")


@query("state_checks", f"WITH {S.V} SELECT count(*) AS n, count(*) FILTER (id % 10 = 0) AS n_wrong_width, count(*) FILTER (id % 10 = 1) AS n_nan, count(*) FILTER (id % 10 IN (2, 3)) AS n_inf FROM v")
def _(spark, d):
    y, at = plane(spark, d), F.col("id") % 10
    bad = F.when(at == 0, F.slice("y", 1, 1)).when(at == 1, F.array(F.col("y")[0], F.lit(float("nan")))).when(at.isin(2, 3), F.array(F.lit(float("-inf")), F.col("y")[1])).otherwise(F.col("y"))
    return optimize.state_checks(y.select("id", bad.alias("y")), 2)


@query("diagnostics", "SELECT true AS falling, true AS consistent, true AS timed")
def _(spark, d):
    r = _fitted(spark, d).diagnostics()
    gap = F.abs(F.col("initial_loss") - F.col("final_loss") - F.col("loss_reduction"))
    return r.select((F.col("loss_reduction") > 0).alias("falling"), (gap < 1e-12).alias("consistent"), (F.col("ms") > 0).alias("timed"))


@query("phase_table", "SELECT * FROM (VALUES ('Phase 1: Global Structure', 0, 100, 2.0::DOUBLE, 1000.0::DOUBLE, 1.0::DOUBLE), ('Phase 2: Balance', 100, 200, 3.0, 3.0, 1.0), ('Phase 3: Local Structure', 200, 450, 1.0, 0.0, 1.0)) t(phase, first, last, near, mid, far)")
def _(spark, d):
    return optimize.phase_table(spark)


@query("snapshots", "SELECT s::INT AS iter, vec_id AS id, true AS finite FROM embeddings, (VALUES (0), (10), (30), (60), (100), (120), (140), (170), (200), (250), (300), (350), (450)) t(s)")
def _(spark, d):
    shots = _fitted(spark, d, snapshots=model.SNAPSHOTS).snapshots()
    return shots.select("iter", "id", F.forall("y", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6)).alias("finite"))


@query("progress_steps", "SELECT * FROM (VALUES (0, 'normalising'), (1, 'pairs'), (2, 'Phase 1: Global Structure'), (3, 'Phase 2: Balance'), (4, 'Phase 3: Local Structure'), (5, 'statistics'), (6, 'done')) t(place, phase)")
def _(spark, d):
    told: list[str] = []
    model.EmbeddingEstimator(seed=42, on_progress=lambda phase, *more: told.append(phase)).fit(emb(spark, d))
    return spark.createDataFrame(list(enumerate(x for x in dict.fromkeys(told) if x != "warning")), "place int, phase string")


@query("fit_given_pairs", "SELECT count(*) AS n, true AS same_near, true AS same_all FROM embeddings")
def _(spark, d):
    """A fit from the neighbour pairs of another, and one from all its pairs, equal that one."""
    first = model.EmbeddingEstimator(seed=42, keep_pairs=True).fit(emb(spark, d))
    same = []
    for given in (first.pairs.where("kind = 0"), first.pairs):
        again = model.EmbeddingEstimator(seed=42).fit(emb(spark, d), given_pairs=given)
        same.append(evaluate.compare(first.embedding, again.embedding).first()["most"] < 1e-4)
    return first.embedding.agg(F.count("*").alias("n")).withColumn("same_near", F.lit(same[0])).withColumn("same_all", F.lit(same[1]))


@query("fit_given_start", "SELECT count(*) AS n, true AS moved, true AS finite FROM embeddings")
def _(spark, d):
    m = model.EmbeddingEstimator(seed=42).fit(emb(spark, d), start=plane(spark, d))
    state = optimize.state_checks(m.embedding, 2)
    gap = evaluate.compare(m.embedding, plane(spark, d)).first()["most"]
    return state.select("n", F.lit(gap > 0).alias("moved"), ((F.col("n_nan") + F.col("n_inf")) == 0).alias("finite"))


@query("fit_reduced", "SELECT count(*) AS n, 64::BIGINT AS n_features, 8 AS width, 0::BIGINT AS n_nan FROM embeddings")
def _(spark, d):
    m = _fitted(spark, d, reduce=8)
    placed = optimize.state_checks(m.transform(emb(spark, d)), 2)
    return placed.select("n", F.lit(m.width).cast("long").alias("n_features"), F.lit(m.train.select(F.max(F.size("features"))).first()[0]).alias("width"), "n_nan")


@query("transform_checks", "SELECT count(*) AS n, 10 AS neighbours, true AS close, true AS graded FROM embeddings")
def _(spark, d):
    """Training rows come back to their own places, and grades follow from the lists."""
    m = _fitted(spark, d)
    out = m.transform_with_safety(emb(spark, d)).persist()
    most = evaluate.compare(m.embedding, out.select("id", "y")).first()["most"]
    s = {k: F.lit(v) for k, v in m.figures.items()}
    right = F.col("outlier_level") == stats.outlier_level(F.array_min("nn_dists"), s)
    return out.agg(F.count("*").alias("n"), F.max(F.size("nn_ids")).alias("neighbours"), F.lit(most < 1e-2).alias("close"), F.every(right).alias("graded"))


@query("model_parameters", "SELECT 2::BIGINT AS components, 10::BIGINT AS neighbors, 'euclidean' AS metric, 42::BIGINT AS seed, 64::BIGINT AS n_features, (10 * count(*))::BIGINT AS n_near, (5 * count(*))::BIGINT AS n_mid, (20 * count(*))::BIGINT AS n_far, true AS is_fitted FROM embeddings")
def _(spark, d):
    m = _fitted(spark, d)
    return m.info().select("components", "neighbors", "metric", "seed", "n_features", "n_near", "n_mid", "n_far", "is_fitted")


@query("model_life", "SELECT true AS copied, true AS reset, true AS missing, true AS damaged")
def _(spark, d):
    """A copy outlives the reset of its model; a model that was reset, is missing or was damaged says so."""
    m, path = _fitted(spark, d), f"{Stash(spark).root}/life"
    twin, errors = m.copy(), {}
    m.save(path)
    m.reset()
    spark.createDataFrame([(0, [0.0])], "id long, y array<double>").write.mode("overwrite").parquet(f"{path}/v1/embedding")
    for name, kind, f in (("reset", model.NotFittedError, lambda: m.transform(emb(spark, d))), ("missing", FileNotFoundError, lambda: model.EmbeddingModel.load(spark, path + "-none")), ("damaged", model.ChecksumError, lambda: model.EmbeddingModel.load(spark, path))):
        try:
            f()
            errors[name] = False
        except kind:
            errors[name] = True
    return spark.createDataFrame([(twin.embedding.count() > 0, errors["reset"], errors["missing"], errors["damaged"])], "copied boolean, reset boolean, missing boolean, damaged boolean")


@query("fit_part_vectors")
def _(spark, d):
    rows = frame.pack(spark.read.parquet(f"{d}/part.parquet"), F.col("p_partkey"), "p_size", "p_retailprice")
    return long(model.EmbeddingEstimator(seed=42).fit(rows).embedding, "y")


@query("fit_transform_roundtrip", "SELECT true AS close, 2 * count(*) AS cells FROM embeddings")
def _(spark, d):
    m = _fitted(spark, d)
    back = m.transform(emb(spark, d))
    return evaluate.compare(m.embedding, back).select((F.col("mse") < 1e-4).alias("close"), F.lit(2 * back.count()).cast("long").alias("cells"))


@query("fit_loss_history")
def _(spark, d):
    return _fitted(spark, d).loss_history()


@query("model_info")
def _(spark, d):
    return _fitted(spark, d).info()


@query("transform_with_safety")
def _(spark, d):
    return _fitted(spark, d).transform_with_safety(emb(spark, d))


@query("save_load_roundtrip", "SELECT 0.0::DOUBLE AS mse, 0.0::DOUBLE AS most, 0::BIGINT AS n_differ, 0.0::DOUBLE AS mean_diff")
def _(spark, d):
    m = _fitted(spark, d)
    path = f"{Stash(spark).root}/model"
    m.save(path)
    back = model.EmbeddingModel.load(spark, path)
    new = emb(spark, d)
    return evaluate.compare(m.transform(new), back.transform(new))


@query("localised_fit")
def _(spark, d):
    return long(_fitted(spark, d, variant="local").embedding, "y")


@query("fit_from_components")
def _(spark, d):
    return long(_fitted(spark, d, init="pca").embedding, "y")


@query("place_by_optimising")
def _(spark, d):
    return long(model.place_by_optimising(_fitted(spark, d), emb(spark, d)), "y")


@query("placing_checks", "SELECT count(*) AS n, 0::BIGINT AS n_nan, true AS near_start FROM embeddings")
def _(spark, d):
    m = _fitted(spark, d)
    placed = model.place_by_optimising(m, emb(spark, d)).persist()
    gap = evaluate.compare(placed, m.transform(emb(spark, d))).first()["mean_diff"]
    spread = evaluate.spread(m.embedding).first()["spread"]
    return optimize.state_checks(placed, 2).select("n", "n_nan", F.lit(gap < spread).alias("near_start"))


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    v = emb(spark, d)
    return model.sweep(v, v, [model.Params(neighbors=k, seed=42) for k in (5, 10, 15)])


@query("sweep_summary")
def _(spark, d):
    return evaluate.sweep_summary(_sweep(spark, d))


@query("sweep_checks", "SELECT 3::BIGINT AS n, true AS best_is_least, true AS timed")
def _(spark, d):
    found = _sweep(spark, d).persist()
    best = evaluate.sweep_summary(found).first()
    least = found.orderBy("quality", "param").first()
    return found.agg(F.count("*").alias("n"), F.lit((best["best"], best["quality"]) == (least["param"], least["quality"])).alias("best_is_least"), F.every(F.col("seconds") > 0).alias("timed"))


@query("sweep_settings", """SELECT 'neighbors' AS kind, r AS place, (5 + 2 * r)::DOUBLE AS value FROM range(13) t(r) UNION ALL SELECT 'lr', r, round(0.6 + 0.1 * r, 6)::DOUBLE FROM range(5) t(r)
 UNION ALL SELECT 'start', r, round(pow(10, r - 4), 6) FROM range(4) t(r) UNION ALL SELECT 'ratios', r, floor(4 * (4 + r) / 10.0)::DOUBLE FROM range(10) t(r)""")
def _(spark, d):
    of = {"neighbors": lambda p: p.neighbors, "lr": lambda p: p.lr, "start": lambda p: p.deviation, "ratios": lambda p: p.fp_ratio}
    rows = [(kind, k, round(float(f(p)), 6)) for kind, f in of.items() for k, p in enumerate(model.sweep_settings(kind, model.Params()))]
    return spark.createDataFrame(rows, "kind string, place long, value double")


@query("table_checksums", f"""WITH {S.CELLS}, h AS (SELECT {S.hash_draw('id::VARCHAR', 'pos::VARCHAR', '(round(x * 1e6)::BIGINT)::VARCHAR')} AS h FROM c) SELECT count(*) AS cells, bit_xor(h) AS checksum FROM h""")
def _(spark, d):
    return model.EmbeddingModel.checksum(emb(spark, d))


@query("sampled_stats", f"""WITH {S.V}, e AS (SELECT id, [f[1], f[2]] AS f FROM v ORDER BY {S.hash_draw("'42'", 'id::VARCHAR')}, id LIMIT 300),
 o AS (SELECT list_sort(list({S.dist('euclidean')})) AS l, avg({S.dist('euclidean')}) AS mean, stddev_pop({S.dist('euclidean')}) AS dev FROM e a JOIN e b ON a.id < b.id)
 SELECT round(l[1], 6) AS least, round(l[1 + floor(0.95 * len(l))::INT], 6) AS p95, round(l[1 + floor(0.99 * len(l))::INT], 6) AS p99, round(mean, 6) AS mean, round(dev, 6) AS deviation, round(mean + 2.5 * dev, 6) AS mild, round(mean + 4 * dev, 6) AS extreme FROM o""")
def _(spark, d):
    s = stats.sampled_stats(plane(spark, d).select("id", F.col("y").alias("features")), 300)
    return s.select(*[r6(c, c) for c in s.columns])


# Classification -------------------------------------------------------------------------------------------------

_VOTE = f"""WITH {S.V}, {S.knn(15)}, k10 AS (SELECT * FROM knn WHERE rank <= 10),
dm AS (SELECT i, max(dist) AS m FROM k10 GROUP BY i),
w AS (SELECT k.i, v.label, sum(1.0 / (1.0 + dist / CASE WHEN m > 0 THEN m ELSE 1 END)) AS w FROM k10 k JOIN dm USING (i) JOIN v ON v.id = k.j GROUP BY k.i, v.label),
votes AS (SELECT i, label, w / sum(w) OVER (PARTITION BY i) AS p FROM w),
cl AS (SELECT i AS id, x.label AS predicted, p AS confidence, v.label AS true_label, x.label = v.label AS is_correct
  FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(p, 12) DESC, label) AS r FROM votes) x JOIN v ON v.id = x.i WHERE r = 1)"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    v = emb(spark, d)
    return classify.classify(neighbors(v, 15), v, 10)


@query("knn_vote", f"{_VOTE} SELECT id, true_label, predicted, round(confidence, 6) AS confidence, is_correct FROM cl")
def _(spark, d):
    return _classified(spark, d).select("id", "true_label", "predicted", r6("confidence", "confidence"), "is_correct")


@query("vote_probabilities", f"{_VOTE} SELECT i, label, round(p, 6) AS p FROM votes")
def _(spark, d):
    v = emb(spark, d)
    return classify.votes(neighbors(v, 15), v, 10).select("i", "label", r6("p", "p"))


@query("classification_report", f"{_VOTE} SELECT count(*) AS n, round(avg(is_correct::INT), 6) AS accuracy, round(avg(confidence) FILTER (is_correct), 6) AS right_confidence, round(avg(confidence) FILTER (NOT is_correct), 6) AS wrong_confidence, count(*) FILTER (confidence > 0.8) AS confident, count(*) FILTER (confidence < 0.6) AS doubtful FROM cl")
def _(spark, d):
    r = classify.report(_classified(spark, d))
    return r.select("n", *[r6(c, c) for c in ("accuracy", "right_confidence", "wrong_confidence")], "confident", "doubtful")


@query("confusion", f"{_VOTE} SELECT true_label, predicted, count(*) AS n FROM cl GROUP BY 1, 2")
def _(spark, d):
    return classify.confusion(_classified(spark, d))


@query("confusion_top5", f"{_VOTE} SELECT true_label, predicted, count(*) AS n FROM cl WHERE NOT is_correct GROUP BY 1, 2 ORDER BY n DESC, true_label, predicted LIMIT 5")
def _(spark, d):
    return classify.most_confused(_classified(spark, d))


@query("difficult_samples", f"""{_VOTE}, dm2 AS (SELECT i, max(dist) AS m FROM knn GROUP BY i),
 w2 AS (SELECT k.i, v.label, sum(1.0 / (1.0 + dist / CASE WHEN m > 0 THEN m ELSE 1 END)) AS w FROM knn k JOIN dm2 USING (i) JOIN v ON v.id = k.j GROUP BY k.i, v.label),
 p2 AS (SELECT i, label, w / sum(w) OVER (PARTITION BY i) AS p FROM w2)
 SELECT id, true_label, predicted, round(coalesce(p, 0), 6) AS p_true FROM cl LEFT JOIN p2 ON p2.i = cl.id AND p2.label = cl.true_label WHERE NOT is_correct AND coalesce(p, 0) < 0.3""")
def _(spark, d):
    v = emb(spark, d)
    return classify.difficult(neighbors(v, 15), v).select("id", "true_label", "predicted", r6("p_true", "p_true"))


@query("report_pages", f"{_VOTE}, o AS (SELECT id, true_label, row_number() OVER (ORDER BY true_label, id) - 1 AS spot FROM cl WHERE NOT is_correct) SELECT id, true_label, (spot // 20)::BIGINT AS page, (spot % 20)::INT AS place FROM o")
def _(spark, d):
    return classify.pages(_classified(spark, d).where("NOT is_correct").select("id", "true_label"), ["true_label", "id"], 20).select("id", "true_label", F.col("page").cast("long").alias("page"), F.col("place").cast("int").alias("place"))


# Evaluation and sampling ----------------------------------------------------------------------------------------


@query("same_label_quality", f"WITH {S.V}, e AS (SELECT id, label, [f[1], f[2]] AS f FROM v), n AS (SELECT a.id, min({S.dist('euclidean')}) AS d FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id GROUP BY a.id) SELECT round(avg(d), 6) AS quality FROM n")
def _(spark, d):
    return evaluate.same_label_quality(plane(spark, d)).select(r6("quality", "quality"))


@query("within_between", f"WITH {S.V}, e AS (SELECT id, label, [f[1], f[2]] AS f FROM v) SELECT a.label = b.label AS same, count(*) AS n, round(avg({S.dist('euclidean')}), 6) AS mean FROM e a JOIN e b ON a.id < b.id GROUP BY 1")
def _(spark, d):
    return evaluate.within_between(plane(spark, d)).select("same", "n", r6("mean", "mean"))


@query("spread_score", f"WITH {S.V} SELECT round(avg(sqrt(f[1] * f[1] + f[2] * f[2])), 6) AS spread FROM v")
def _(spark, d):
    return evaluate.spread(plane(spark, d)).select(r6("spread", "spread"))


@query("embedding_mse", f"WITH {S.V}, c AS (SELECT f[1] - f[3] AS d FROM v UNION ALL SELECT f[2] - f[4] FROM v) SELECT round(avg(d * d), 6) AS mse, round(max(abs(d)), 6) AS most, count(*) FILTER (abs(d) > 1e-10) AS n_differ, round(avg(abs(d)), 6) AS mean_diff FROM c")
def _(spark, d):
    other = emb(spark, d).select("id", F.slice("features", 3, 2).alias("y"))
    return evaluate.compare(plane(spark, d), other).select(r6("mse", "mse"), r6("most", "most"), "n_differ", r6("mean_diff", "mean_diff"))


@query("label_histogram", "SELECT label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM embeddings), 6)::DOUBLE AS percent FROM embeddings GROUP BY label")
def _(spark, d):
    return evaluate.histogram(emb(spark, d)).select("label", "n", r6(F.col("percent").cast("double"), "percent"))


@query("axis_ranges", f"WITH {S.V}, a AS (SELECT 'x' AS axis, f[1] AS v FROM v UNION ALL SELECT 'y', f[2] FROM v UNION ALL SELECT 'z', f[3] FROM v) SELECT axis, round(min(v), 6) AS least, round(max(v), 6) AS most, round(max(v) - min(v), 6) AS span FROM a GROUP BY axis")
def _(spark, d):
    return evaluate.ranges(_points(spark, d), "x", "y", "z").select("axis", *[r6(c, c) for c in ("least", "most", "span")])


def _points(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).select("id", *[F.col("features")[k].alias(c) for k, c in enumerate("xyz")])


@query("rule_labels", f"""WITH {S.V}, p AS (SELECT id, f[1] AS x, f[2] AS y, f[3] AS z FROM v), e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM p),
 t AS (SELECT p.*, lx + (hx - lx) * 0.36 AS a, hx - (hx - lx) * 0.36 AS b, ly + (hy - ly) * 0.415 AS c, e.* FROM p, e)
 SELECT id, CASE WHEN x BETWEEN a AND b AND y < c AND z > lz + (hz - lz) * 0.5 THEN 'head' WHEN z < lz + (hz - lz) * 0.08 THEN 'feet' WHEN z < lz + (hz - lz) * 0.28 THEN 'legs'
   WHEN (x < a OR x > b) AND y < c THEN CASE WHEN x > lx + (hx - lx) * 0.9 AND z > lz + (hz - lz) * 0.85 AND abs(y - (ly + hy) / 2) < (hy - ly) * 0.1 THEN 'tusks' ELSE 'trunk' END ELSE 'body' END AS part FROM t""")
def _(spark, d):
    return readers.body_parts(_points(spark, d)).select("id", "part")


@query("encoded_labels", "WITH f AS (SELECT n_name, n_regionkey, n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT r_name, row_number() OVER (ORDER BY min(n_nationkey)) - 1 AS label FROM f GROUP BY r_name) SELECT n_nationkey::BIGINT AS id, r_name, label::INT AS label FROM f JOIN c USING (r_name)")
def _(spark, d):
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("id"), "r_name")
    return readers.encoded_labels(rows, "r_name").select("id", "r_name", F.col("label").cast("int").alias("label"))


_POS = f"WITH {S.V}, p AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM v), n AS (SELECT count(*) AS n FROM v)"


@query("positions", f"{_POS} SELECT id, pos FROM p")
def _(spark, d):
    return frame.with_position(emb(spark, d)).select("id", F.col("pos").cast("long").alias("pos"))


@query("prefix_subset", f"{_POS} SELECT id FROM p WHERE pos < 50")
def _(spark, d):
    return sampling.prefix(frame.with_position(emb(spark, d)), 50).select("id")


@query("row_slice", f"{_POS} SELECT id FROM p WHERE pos BETWEEN 100 AND 149")
def _(spark, d):
    return sampling.slice_rows(frame.with_position(emb(spark, d)), 100, 50).select("id")


@query("even_subset", f"{_POS} SELECT spot::BIGINT AS \"at\", id FROM (SELECT spot, least(floor(spot * n / 64)::BIGINT, n - 1) AS pos FROM range(64) r(spot), n) x JOIN p ON p.pos = x.pos")
def _(spark, d):
    v = frame.with_position(emb(spark, d))
    return sampling.evenly(v, v.count(), 64).select("at", "id")


@query("random_subset", f"WITH {S.V} SELECT id FROM v ORDER BY {S.hash_draw(chr(39) + '42' + chr(39), 'id::VARCHAR')}, id LIMIT 50")
def _(spark, d):
    return sampling.random_rows(emb(spark, d), 50).select("id")


@query("stratified_sample", f"WITH {S.V} SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {S.hash_draw(chr(39) + '42' + chr(39), 'id::VARCHAR')}, id) AS r FROM v) WHERE r <= 5")
def _(spark, d):
    return sampling.stratified(emb(spark, d), 5).select("id", "label")


@query("sample_with_replacement", f"{_POS} SELECT spot::BIGINT AS \"at\", id FROM (SELECT spot, {S.hash_draw(chr(39) + '42' + chr(39), chr(39) + 'draw' + chr(39), 'spot::VARCHAR')} % n AS pos FROM range(40) r(spot), n) x JOIN p ON p.pos = x.pos")
def _(spark, d):
    v = frame.with_position(emb(spark, d))
    return sampling.with_replacement(v, v.count(), 40).select("at", "id")


# Quantisation, sources and sinks --------------------------------------------------------------------------------


@query("pq_codes", f"""WITH {S.CELLS}, parts AS (SELECT id, s::INT AS sub, f[s * 4 + 1 : s * 4 + 4] AS part FROM v, range(16) r(s)),
 m AS (SELECT label, pos, avg(x) AS x FROM c GROUP BY label, pos),
 book AS (SELECT (pos // 4)::INT AS sub, label AS code, list(x ORDER BY pos) AS centroid FROM m GROUP BY 1, 2),
 x AS (SELECT p.id, p.sub, b.code, row_number() OVER (PARTITION BY p.id, p.sub ORDER BY {S.zipped('p.part', 'b.centroid', '(p[1] - p[2]) * (p[1] - p[2])')}, b.code) AS r FROM parts p JOIN book b ON p.sub = b.sub)
 SELECT id, sub, code FROM x WHERE r = 1""")
def _(spark, d):
    v = emb(spark, d)
    means = v.select("label", F.posexplode("features").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    book = means.groupBy(F.floor(F.col("pos") / 4).cast("int").alias("sub"), F.col("label").alias("code")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
    return quantize.encode(v, book, 16, 64)


@query("kmeans_pq_checks", "SELECT (4 * count(*))::BIGINT AS codes, true AS in_range, true AS closer FROM embeddings")
def _(spark, d):
    v = emb(spark, d)
    book = quantize.train(v, 4, 64, k=16).persist()
    codes = quantize.encode(v, book, 4, 64).persist()
    back = quantize.reconstruct(codes, book).select("id", F.col("features").alias("y"))
    mse = evaluate.compare(v.select("id", F.col("features").alias("y")), back).first()["mse"]
    spread = normalize.column_summary(v).agg(F.avg(F.col("deviation") * F.col("deviation"))).first()[0]
    return codes.agg(F.count("*").alias("codes"), F.every(F.col("code").between(0, 15)).alias("in_range"), F.lit(mse < spread).alias("closer"))


@query("kmeans_pq")
def _(spark, d):
    v = emb(spark, d)
    book = quantize.train(v, 4, 64, k=16)
    return long(quantize.reconstruct(quantize.encode(v, book, 4, 64), book))


@query("subspace_counts", "SELECT * FROM (VALUES (64, 16), (28, 4), (30, 2), (7, 1), (2, 1)) t(d, m)")
def _(spark, d):
    return spark.createDataFrame([(x, quantize.subspaces(x)) for x in (64, 28, 30, 7, 2)], "d int, m int")


@query("digit_patterns", f"""WITH k AS (SELECT i AS id, p::INT AS pos, {S.hash_draw("'42'", "i::VARCHAR", "p::VARCHAR")} AS h FROM range(1000) a(i), range(784) b(p)) SELECT id, pos, round(0.1 * (id % 10) + 0.1 * ((h + 0.5) / 4294967296.0 - 0.5), 6) + 0.0 AS x FROM k""")
def _(spark, d):
    return long(readers.digit_patterns(spark))


def _uniform(*parts: str) -> str:
    return f"(({S.hash_draw(*parts)} + 0.5) / 4294967296.0)"


def _normal(*parts: str) -> str:
    return f"(sqrt(-2 * ln({_uniform(*parts, chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {_uniform(*parts, chr(39) + 'b' + chr(39))}))"


_CELL = ("'42'", "kind", "id::VARCHAR", "pos::VARCHAR")


@query("synthetic_patterns", f"""WITH k AS (SELECT kind, i AS id, p::INT AS pos FROM range(200) a(i), range(20) b(p), (VALUES ('standard'), ('sparse'), ('binary'), ('clustered'), ('correlated'), ('outliers')) c(kind)),
 z AS (SELECT *, {_normal(*_CELL)} AS z, {_uniform("'42'", "kind", "'u'", "id::VARCHAR", "pos::VARCHAR")} AS u FROM k)
 SELECT kind, id, pos, round(CASE kind WHEN 'standard' THEN z WHEN 'sparse' THEN CASE WHEN u < 0.2 THEN z ELSE 0.0 END WHEN 'binary' THEN CASE WHEN u < 0.5 THEN 0.0 ELSE 1.0 END
   WHEN 'clustered' THEN ({S.hash_draw("'42'", "'centre'", "id::VARCHAR")} % 3 - 1) * 2.0 + 0.5 * z WHEN 'correlated' THEN 0.7 * {_normal("'42'", "'base'", "id::VARCHAR")} + 0.3 * z
   ELSE CASE WHEN u < 0.5 THEN -1.0 ELSE 1.0 END * (10.0 + 5.0 * {_uniform("'42'", "kind", "'size'", "id::VARCHAR", "pos::VARCHAR")}) END, 6) + 0.0 AS x FROM z""")
def _(spark, d):
    out = None
    for kind in readers.PATTERNS:
        part = long(readers.pattern(spark, kind, 200, 20)).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("image_container", "SELECT i AS id, p::INT AS pos, ((i * 7 + p * 3) % 256)::DOUBLE AS x, (i % 10)::INT AS label, f AS zipped FROM range(200) a(i), range(64) b(p), (VALUES (false), (true)) c(f)")
def _(spark, d):
    root = f"{Stash(spark).root}/images"
    raw = struct.pack(readers.HEADER, readers.MAGIC, 1, 200, 8, 8, 200, 0) + bytes((i * 7 + p * 3) % 256 for i in range(200) for p in range(64)) + bytes(i % 10 for i in range(200))
    put(spark, f"{root}/a.dat", raw)
    put(spark, f"{root}/b.zip", _zipped("digits.dat", raw))
    found = readers.images(spark, f"{root}/*")
    return found.select("id", F.posexplode("features").alias("pos", "x"), "label", F.col("file").endswith(".zip").alias("zipped"))


def _zipped(name: str, content: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, content)
    return out.getvalue()


@query("zipped_csv", f"WITH {S.V} SELECT round(f[1], 6) + 0.0 AS x, round(f[2], 6) + 0.0 AS y, round(f[3], 6) + 0.0 AS z FROM v")
def _(spark, d):
    rows = _points(spark, d).select("x", "y", "z").collect()  # the test table
    path = f"{Stash(spark).root}/points.zip"
    put(spark, path, _zipped("points.csv", ("x,y,z\n" + "".join(f"{r.x!r},{r.y!r},{r.z!r}\n" for r in rows)).encode()))
    return readers.zipped_csv_points(spark, path).select(*[r6(c, c) for c in "xyz"])


@query("csv_first_points", f"WITH {S.V} SELECT round(f[1], 6) + 0.0 AS x, round(f[2], 6) + 0.0 AS y, round(f[3], 6) + 0.0 AS z FROM (SELECT * FROM v ORDER BY id LIMIT 40)")
def _(spark, d):
    rows = _points(spark, d).orderBy("id").collect()  # the test table
    path = f"{Stash(spark).root}/points.csv"
    put(spark, path, ("0,1,2\n" + "".join(f"{r.x!r},{r.y!r},{r.z!r}\n" for r in rows)).encode())
    return readers.csv_points(spark, path, 40).select(*[r6(c, c) for c in "xyz"])


@query("labelled_csv", f"WITH {S.V} SELECT round(f[1], 6) + 0.0 AS x, round(f[2], 6) + 0.0 AS y, label FROM v")
def _(spark, d):
    path = f"{Stash(spark).root}/labelled"
    writers.write_labelled_csv(plane(spark, d), path, "label")
    back = spark.read.option("header", True).csv(path)
    return back.select(*[r6(F.col(c).cast("double"), c) for c in "xy"], F.col("label").cast("int").alias("label"))


@query("csv_roundtrip", f"WITH {S.V} SELECT round(f[1], 6) + 0.0 AS x, round(f[2], 6) + 0.0 AS y, round(f[3], 6) + 0.0 AS z FROM v")
def _(spark, d):
    path = f"{shared_dir(spark)}/points-{tempfile.mktemp(dir='', prefix='csv')}"
    _points(spark, d).select("x", "y", "z").write.option("header", True).csv(path)
    return readers.csv_points(spark, path).select(*[r6(c, c) for c in "xyz"])


@query("embedding_csv", f"WITH {S.V} SELECT printf('%.6f', f[1]) AS Dim1, printf('%.6f', f[2]) AS Dim2 FROM v")
def _(spark, d):
    return writers.embedding_columns(plane(spark, d), 2)


@query("plane_projections", f"WITH {S.V}, p AS (SELECT f[1] AS x, f[2] AS y, f[3] AS z FROM v) SELECT 'xy' AS plane, round(x, 6) + 0.0 AS u, round(y, 6) + 0.0 AS v FROM p UNION ALL SELECT 'xz', round(x, 6) + 0.0, round(z, 6) + 0.0 FROM p UNION ALL SELECT 'yz', round(y, 6) + 0.0, round(z, 6) + 0.0 FROM p")
def _(spark, d):
    return writers.projections(_points(spark, d)).select("plane", r6("u", "u"), r6("v", "v"))
