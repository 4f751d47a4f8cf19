"""The estimator: normalise, neighbours, pairs, optimise, statistics; and the model: transform, safety, save, load, info.

Tables whose features take up to LOCAL_BYTES are fitted in one process (operators.local), larger ones by DataFrames; both
take the same steps with the same draws.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan import __version__
from vecspan.functions.schedules import STRATEGIES, PairCounts, complexity_note, memory_estimate, neighbor_warning, pair_counts, rounded_pair_counts, tuned
from vecspan.functions.vectors import METRIC_NAMES, METRICS
from vecspan.operators import frame, local, normalize, optimize, pairs, stats
from vecspan.operators.knn import BROADCAST_BYTES, knn, matrix, top_k
from vecspan.session import Timers, log

#: An embedding with its moments may take so many bytes: it is optimised on one machine or broadcast between iterations.
STATE_BYTES = 4 << 30
#: Features of up to so many bytes are fitted in one process.
LOCAL_BYTES = 64 << 20

ERRORS = {
    0: "success", -1: "invalid parameters", -2: "out of memory", -3: "not implemented", -4: "the model is not fitted", -5: "file error", -6: "no valid model", -7: "checksum mismatch",
}


def error_text(code: int) -> str:
    return ERRORS.get(code, "unknown error")


class NotFittedError(RuntimeError):
    """The model has no embedding."""

    def __init__(self) -> None:
        super().__init__(error_text(-4))


class ChecksumError(IOError):
    """A saved table does not match its manifest."""


#: Iterations at which states are kept for inspection.
SNAPSHOTS = (0, 10, 30, 60, 100, 120, 140, 170, 200, 250, 300, 350, 450)


@dataclass(frozen=True)
class Params:
    """neighbors None: the recommendation for the number of rows. rounded: pair counts are rounded and shrunk to fit, not cut
    off. reduce: beyond so many features, that many principal components (not for hamming). snapshots: iterations to keep."""

    components: int = 2
    neighbors: int | None = 10
    mn_ratio: float = 0.5
    fp_ratio: float = 2.0
    metric: str = "euclidean"
    iters: tuple[int, int, int] = (100, 100, 250)
    lr: float = 1.0
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-7
    deviation: float = 1e-4
    seed: int | None = None
    mode: str = "exact_block"
    variant: str = "plain"
    init: str = "random"
    close: float = 10.0
    rounded: bool = False
    reduce: int | None = None
    snapshots: tuple[int, ...] = ()

    def validated(self, n: int) -> Params:
        if not 1 <= self.components <= 50:
            raise ValueError("components must be in 1..50")
        neighbors = min(n - 1, rounded_pair_counts(max(n, 100), None, 0.5, 2.0).near) if self.neighbors is None else self.neighbors
        if not 0 < neighbors < n:
            raise ValueError(f"neighbors must be in 1..{n - 1}")
        if self.mn_ratio < 0 or self.fp_ratio < 0:
            raise ValueError("pair ratios must not be negative")
        if self.lr <= 0:
            raise ValueError("the learning rate must be positive")
        if any(x <= 0 for x in self.iters):
            raise ValueError("every phase needs iterations")
        if self.init not in ("random", "pca") or self.variant not in ("plain", "local"):
            raise ValueError("init is random or pca, variant plain or local")
        metric = METRIC_NAMES.get(self.metric, self.metric) if isinstance(self.metric, int) else self.metric
        if metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")
        seed = int(np.random.SeedSequence().generate_state(1)[0]) if self.seed is None or self.seed < 0 else self.seed
        return replace(self, metric=metric, seed=seed, neighbors=neighbors)

    def pair_counts(self, n: int) -> PairCounts:
        return (rounded_pair_counts if self.rounded else pair_counts)(n, self.neighbors, self.mn_ratio, self.fp_ratio)

    def for_size(self, n: int) -> Params:
        """The settings tuned for n rows."""
        return replace(self, **tuned(n, self.neighbors, self.lr, self.mn_ratio, self.iters))

    def strategy(self, name: str) -> Params:
        s = STRATEGIES[name]
        return replace(self, lr=self.lr * s["lr"], iters=tuple(max(1, int(x * s["iterations"])) for x in self.iters), fp_ratio=self.fp_ratio * s["far"])

    def warnings(self) -> list[str]:
        out = []
        if abs(self.fp_ratio - 4 * self.mn_ratio) > 0.01:
            out.append("far pairs are usually four times the mid-range pairs")
        if not 0.1 <= self.mn_ratio <= 2:
            out.append("mid-range ratio outside 0.1..2")
        if not 0.5 <= self.fp_ratio <= 5:
            out.append("far ratio outside 0.5..5")
        return out

    def notes(self, n: int, d: int) -> list[str]:
        """Warnings that depend on the table."""
        return [x for x in (*self.warnings(), neighbor_warning(self.neighbors, n), complexity_note(n, d) if self.mode != "ivf" else "") if x]


def _table(spark: SparkSession, ids: np.ndarray, x: np.ndarray, name: str) -> DataFrame:
    lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x, np.float64).ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
    return spark.createDataFrame(pa.table({"id": pa.array(ids), name: lists}))


class EmbeddingModel:
    """A fitted embedding. train: id, features (normalised); embedding: id, y."""

    def __init__(self, params: Params, scaling: normalize.Scaling, train: DataFrame | None, embedding: DataFrame | None, figures: dict, history: list, counts: dict, packed: tuple | None = None):
        self.params, self.scaling, self.train, self.embedding = params, scaling, train, embedding
        self.figures, self.history, self.counts = figures, history, counts
        self.packed, self._shared = packed, None  # ids, features and places as arrays, where they are small
        self.pairs: DataFrame | None = None
        self.kept: dict[int, np.ndarray] = {}
        self.measured: dict[str, float] = {}
        self.timers = Timers()

    def _need(self) -> SparkSession:
        if self.embedding is None or self.train is None:
            raise NotFittedError
        return self.embedding.sparkSession

    @property
    def width(self) -> int:
        return len(self.scaling.means)

    def loss_history(self) -> DataFrame:
        return self._need().createDataFrame(self.history or [(0, "none", 0.0)], "iter int, phase string, loss double").limit(len(self.history))

    def diagnostics(self) -> DataFrame:
        """One row: loss of the start and of the end at the first weights, their difference, time of the optimiser in ms."""
        m = self.measured
        return self._need().createDataFrame([(m["initial"], m["final"], m["initial"] - m["final"], m["ms"])], "initial_loss double, final_loss double, loss_reduction double, ms double")

    def phases(self) -> DataFrame:
        return optimize.phase_table(self._need(), self.params.iters)

    def snapshots(self) -> DataFrame:
        """iter, id, y of the iterations in params.snapshots."""
        spark, out = self._need(), None
        ids = self.embedding.select("id").orderBy("id").toArrow().column("id").to_numpy() if self.kept else None
        for it, y in sorted(self.kept.items()):
            part = _table(spark, ids, y, "y").select(F.lit(it).alias("iter"), "id", "y")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else spark.createDataFrame([], "iter int, id long, y array<double>")

    def timings(self) -> DataFrame:
        return self.timers.table(self._need())

    def _base(self) -> bool:
        """Whether the training rows are small enough to be shared as arrays; they are collected once."""
        spark = self._need()
        if self.packed is None:
            r = self.train.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
            if 8 * r["n"] * ((r["d"] or 0) + self.params.components) > BROADCAST_BYTES:
                return False
            t = self.train.join(self.embedding, "id").orderBy("id").toArrow()
            self.packed = (t.column("id").to_numpy(), *(matrix(t.column(c).combine_chunks()) for c in ("features", "y")))
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(self.packed)
        return True

    def _checked(self, df: DataFrame) -> DataFrame:
        width = self.width
        return df.select("id", F.when(F.size("features") == width, F.col("features")).otherwise(F.raise_error(F.lit(f"expected {width} features"))).alias("features"))

    def _near(self, df: DataFrame) -> DataFrame:
        """i, j, rank, dist: the training neighbours of new rows."""
        new = normalize.minmax_center(self._checked(df), self.scaling)
        return knn(new, self.train, self.params.neighbors, self.params.metric, self.params.mode, skip_self=False)

    def _placed(self, df: DataFrame, lists: bool) -> DataFrame:
        """id, y (and nn_ids, nn_dists) of new rows, in one pass over them."""
        shared, p, scaling = self._shared, self.params, self.scaling

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x, places = shared.value
            for batch in batches:
                m = batch.num_rows
                if not m:
                    continue
                new, own = scaling.on(matrix(batch.column("features"))), np.arange(m)
                at = np.arange(len(ids))
                i, j, dist = top_k(own, new, at, x, p.neighbors, p.metric, False)
                w = 1.0 / (dist + 1e-8)
                first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
                y = np.add.reduceat(w[:, None] * places[j], first) / np.add.reduceat(w, first)[:, None]
                cols = [batch.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))]
                if lists:
                    i, j, dist = top_k(own, y, at, places, p.neighbors, "euclidean", False)
                    ends = pa.array(np.concatenate((np.searchsorted(i, own), [len(i)])), pa.int32())
                    cols += [pa.ListArray.from_arrays(ends, pa.array(ids[j])), pa.ListArray.from_arrays(ends, pa.array(dist))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "y", "nn_ids", "nn_dists"][: len(cols)])

        return self._checked(df).mapInArrow(run, "id long, y array<double>" + ", nn_ids array<long>, nn_dists array<double>" * lists)

    def transform(self, df: DataFrame) -> DataFrame:
        """id, y of new rows: means of their neighbours' places, weighted by 1 / distance."""
        self._need()
        if self.params.mode != "ivf" and self._base():
            return self._placed(df, False)
        y = stats.interpolation(self._near(df), self.embedding)
        return y.groupBy(F.col("i").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "y"))), lambda x: x["y"]).alias("y"))

    def transform_with_safety(self, df: DataFrame) -> DataFrame:
        """transform() plus nn_ids, nn_dists (in the embedding), confidence, outlier_level, percentile_rank, z_score, is_reliable."""
        self._need()
        if self.params.mode != "ivf" and self._base():
            scored = self._placed(df, True)
        else:
            placed = self.transform(df)
            base = self.embedding.select("id", F.col("y").alias("features"))
            near = knn(placed.select("id", F.col("y").alias("features")), base, self.params.neighbors, "euclidean", self.params.mode, skip_self=False)
            lists = near.groupBy(F.col("i").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "j", "dist"))).alias("n"))
            scored = placed.join(lists.select("id", F.transform("n", lambda x: x["j"]).alias("nn_ids"), F.transform("n", lambda x: x["dist"]).alias("nn_dists")), "id")
        scored = scored.withColumn("nearest", F.array_min("nn_dists"))
        return stats.safety(scored, self.figures).drop("nearest").withColumn("quality", stats.quality_text(F.col("outlier_level")))

    def info(self) -> DataFrame:
        p = asdict(self.params)
        row = {**p, "iters": list(p["iters"]), "snapshots": list(p["snapshots"]), "reduce": p["reduce"] or 0}
        row |= {"n_features": self.width, **{f"stat_{k}": float(v) for k, v in self.figures.items()}, **{f"n_{k}": int(v) for k, v in self.counts.items()}, "version": __version__, "is_fitted": self.embedding is not None}
        types = {int: "long", float: "double", str: "string", bool: "boolean", list: "array<int>"}
        return self._need().createDataFrame([tuple(row.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in row.items()))

    def copy(self) -> EmbeddingModel:
        new = EmbeddingModel(self.params, self.scaling, self.train, self.embedding, dict(self.figures), list(self.history), dict(self.counts), self.packed)
        new.pairs, new.kept, new.measured = self.pairs, dict(self.kept), dict(self.measured)
        return new

    def release_pairs(self) -> None:
        self.pairs = None

    def reset(self) -> None:
        """Forgets the fit; the parameters stay."""
        self.train = self.embedding = self.packed = self._shared = self.pairs = None
        self.figures, self.history, self.counts, self.kept, self.measured = {}, [], {}, {}, {}

    @staticmethod
    def checksum(df: DataFrame) -> DataFrame:
        """One row: cells, and the exclusive or of a hash of every (id, place, value in millionths). Any engine can repeat it."""
        cells = df.select("id", F.posexplode("features").alias("pos", "x"))
        key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("id", "pos")], F.round(F.col("x") * 1e6).cast("long").cast("string")))
        return cells.agg(F.count("*").alias("cells"), F.coalesce(F.bit_xor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long")), F.lit(0)).alias("checksum"))

    @staticmethod
    def _sum(df: DataFrame) -> dict:
        r = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*[F.col(c) for c in df.columns])), F.lit(0)).alias("x")).first()
        return {"rows": r["n"], "checksum": r["x"]}

    def save(self, path: str) -> None:
        """A new numbered version: Parquet tables, then the manifest with their checksums. Older versions go last, so a
        save that fails leaves the model that was there."""
        spark, tables = self._need(), {"train": self.train, "embedding": self.embedding}
        old = _versions(spark, path)
        now = max(old, default=0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/v{now}/{name}")
        manifest = {
            "format": 3, "version": __version__, "params": asdict(self.params), "scaling": asdict(self.scaling), "figures": self.figures, "history": self.history, "counts": self.counts, "measured": self.measured,
            "tables": {n: self._sum(spark.read.parquet(f"{path}/v{now}/{n}")) for n in tables},
        }
        spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/v{now}/manifest")
        for k in old:
            _delete(spark, f"{path}/v{k}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EmbeddingModel:
        """The newest version with a manifest."""
        found = _versions(spark, path)
        if not found:
            raise FileNotFoundError(f"{error_text(-6)}: {path}")
        path = f"{path}/v{max(found)}"
        m = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
        if m["format"] != 3:
            raise OSError(f"{error_text(-6)}: format {m['format']}")
        try:
            tables = {n: spark.read.parquet(f"{path}/{n}") for n in m["tables"]}
        except AnalysisException as e:
            raise OSError(f"{error_text(-5)}: {path}") from e
        for n, want in m["tables"].items():
            if (got := cls._sum(tables[n])) != want:
                raise ChecksumError(f"{error_text(-7)}: {n}, {got} instead of {want}")
        params = Params(**m["params"] | {k: tuple(m["params"][k]) for k in ("iters", "snapshots")})
        axes = m["scaling"]["axes"]
        scaling = normalize.Scaling(m["scaling"]["xmin"], m["scaling"]["xmax"], tuple(m["scaling"]["means"]), tuple(map(tuple, axes)) if axes else None)
        out = cls(params, scaling, tables["train"], tables["embedding"], m["figures"], [tuple(h) for h in m["history"]], m["counts"])
        out.measured = m["measured"]
        return out


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a saved model."""
    p, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    numbers = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    return [k for k in numbers if fs.exists(_folder(spark, f"{path}/v{k}/manifest/_SUCCESS")[0])]


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _folder(spark, path)
    fs.delete(p, True)


class EmbeddingEstimator:
    """fit(df) -> EmbeddingModel. df: id, features. keep_pairs: the model keeps its pairs, for another fit."""

    def __init__(self, params: Params | None = None, on_progress: Callable[[str, int, int, float, str], None] | None = None, keep_pairs: bool = False, **more):
        self.params, self.on_progress, self.keep_pairs = params or Params(**more), on_progress, keep_pairs
        self.lists: local.Lists | None = None  # shared by fits of one table in one process

    def _tell(self, phase: str, now: int, total: int, percent: float, message: str = "") -> None:
        if phase == "warning":
            log.warning(message)
        if self.on_progress:
            self.on_progress(phase, now, total, percent, message)

    def sample_pairs(self, rows: DataFrame, n: int, d: int, p: Params, near: DataFrame | None = None) -> DataFrame:
        """i, j, kind over positions. near: neighbour pairs that are given."""
        c = p.pair_counts(n)
        if near is None and p.mode == "exact_block" and 8 * n * d <= BROADCAST_BYTES:
            return pairs.valid(pairs.shared_pairs(rows, n, c, pairs.EXTRA, p.metric, p.seed), n)
        if near is None:
            near = pairs.near_pairs(knn(rows, rows, min(c.near + pairs.EXTRA, n - 1), p.metric, p.mode), c.near)
        near = near.select("i", "j", F.lit(pairs.NEAR).alias("kind")).persist()
        mid = pairs.mid_pairs(rows, n, c.mid, p.seed, p.metric) if c.mid else near.limit(0)
        far = pairs.far_pairs(rows, near, n, c.far, p.seed) if c.far else near.limit(0)
        return pairs.valid(pairs.all_pairs(near, mid, far), n)

    def fit(self, df: DataFrame, given_pairs: DataFrame | None = None, start: DataFrame | None = None) -> EmbeddingModel:
        """given_pairs: i, j, kind over positions in the order of id; neighbours alone are completed by mid-range and far
        pairs. start: id, y of every row, standardised before use."""
        n, d = frame.check(df)
        p = self.params.validated(n)
        for text in p.notes(n, d):
            self._tell("warning", 0, 0, 0.0, text)
        c = p.pair_counts(n)
        small = 8 * n * d <= LOCAL_BYTES and n * (c.near + c.mid + c.far) <= optimize.LOCAL_PAIRS and p.mode != "ivf"
        state = memory_estimate(n, d if small else 0, p.components, n * (c.near + c.mid + c.far) if small else 0)
        if state > STATE_BYTES:
            raise MemoryError(f"{error_text(-2)}: the fit's state of {state} bytes exceeds {STATE_BYTES}")
        self._tell("normalising", 0, n, 5.0)
        model = (self._fit_local if small else self._fit_distributed)(df, n, d, p, given_pairs, start)
        self._tell("done", n, n, 100.0)
        return model

    def _step(self) -> Callable[[str, int, int], None]:
        return lambda phase, now, of: self._tell(phase, now, of, 50.0 + 40.0 * now / of)

    def _fit_local(self, df: DataFrame, n: int, d: int, p: Params, given: DataFrame | None, start: DataFrame | None) -> EmbeddingModel:
        spark, timers = df.sparkSession, Timers()
        with timers.step("normalise"):
            t = df.select("id", "features").toArrow().sort_by("id")
            ids, raw = t.column("id").to_numpy(), matrix(t.column("features").combine_chunks())
            reduce = p.reduce and d > p.reduce and p.metric != "hamming"
            scaling = normalize.fit_projection(df.select("id", "features"), p.reduce) if reduce else local.fit_scaling(raw)
            x = scaling.on(raw)
        self._tell("pairs", 0, n, 10.0)
        with timers.step("pairs"):
            near = None
            if given is not None:
                g = given.select("i", "j", "kind").toArrow()
                i, j, kind = (g.column(c).to_numpy().astype(np.int64) for c in ("i", "j", "kind"))
                near = np.stack((i, j)) if (kind == pairs.NEAR).all() else None
            if given is None or near is not None:
                i, j, kind = local.sample_pairs(x, p.pair_counts(n), pairs.EXTRA, p.metric, p.seed, near, self.lists)
            ok = (i >= 0) & (j >= 0) & (i < n) & (j < n) & (i != j) & (kind >= 0) & (kind <= 2)
            i, j, kind = i[ok], j[ok], kind[ok]
        if start is not None:
            y0 = _start(start, ids, p)
        elif p.init == "pca":
            y0 = _places(optimize.initial_from(_table(spark, ids, x, "features"), p.components), ids, p)
        else:
            y0 = local.initial(n, p.components, p.deviation, p.seed)
        with timers.step("optimise"):
            adam = optimize.Adam(p.lr, p.beta1, p.beta2, p.eps)
            limit = p.close if p.variant == "local" else None
            run = optimize.local_loop(y0, i, j, kind, p.iters, adam, limit=limit, seed=p.seed, progress=self._step(), snapshots=p.snapshots)
        self._tell("statistics", n, n, 90.0)
        with timers.step("statistics"):
            y = run.y.astype(np.float32).astype(np.float64)
            figures = local.distance_stats(local.neighbors(y, min(p.neighbors, n - 1), "euclidean")[1])
            w = optimize.weights_at(0, *p.iters[:2])
            losses = [optimize.mean_loss(v, i, j, kind, w) for v in (y0, run.y)]
        counts = {name: int((kind == k).sum()) for k, name in enumerate(("near", "mid", "far")) if (kind == k).any()}
        model = EmbeddingModel(p, scaling, _table(spark, ids, x, "features"), _table(spark, ids, y, "y"), figures, run.history, counts, (ids, x, y))
        if self.keep_pairs:
            model.pairs = spark.createDataFrame(pa.table({"i": pa.array(i), "j": pa.array(j), "kind": pa.array(kind.astype(np.int32))}))
        return self._finished(model, run, losses, timers)

    @staticmethod
    def _finished(model: EmbeddingModel, run: optimize.Run, losses: list[float], timers: Timers) -> EmbeddingModel:
        model.kept, model.timers = run.snapshots, timers
        model.measured = {"initial": losses[0], "final": losses[1], "ms": dict(timers.records)["optimise"]}
        return model

    def _fit_distributed(self, df: DataFrame, n: int, d: int, p: Params, given: DataFrame | None, start: DataFrame | None) -> EmbeddingModel:
        spark, timers = df.sparkSession, Timers()
        with timers.step("normalise"):
            reduce = p.reduce and d > p.reduce and p.metric != "hamming"
            scaling = normalize.fit_projection(df.select("id", "features"), p.reduce) if reduce else normalize.fit_scaling(df)
            placed = frame.with_position(df.select("id", "features")).persist()
            rows = normalize.minmax_center(placed.select(F.col("pos").cast("long").alias("id"), "features"), scaling).persist()
        self._tell("pairs", 0, n, 10.0)
        with timers.step("pairs"):
            near = given.where(F.col("kind") == pairs.NEAR) if given is not None and not given.where(F.col("kind") != pairs.NEAR).limit(1).count() else None
            pr = (pairs.valid(given, n) if given is not None and near is None else self.sample_pairs(rows, n, p.reduce if reduce else d, p, near)).persist()
            counts = {("near", "mid", "far")[r["kind"]]: r["n"] for r in pairs.counts(pr).collect()}
        total = sum(counts.values())
        ids = placed.select("id", F.col("pos").cast("long").alias("pos"))
        if start is not None:
            y0 = _start(start, ids.orderBy("pos").toArrow().column("id").to_numpy(), p)
        else:
            first = optimize.initial_from(rows, p.components) if p.init == "pca" else optimize.initial(rows, p.components, p.deviation, p.seed)
            y0 = matrix(first.orderBy("id").toArrow().column("y").combine_chunks())
        adam = optimize.Adam(p.lr, p.beta1, p.beta2, p.eps)
        more = {"limit": p.close if p.variant == "local" else None, "seed": p.seed, "progress": self._step(), "snapshots": p.snapshots}
        with timers.step("optimise"):
            if total <= optimize.LOCAL_PAIRS:
                t = pr.select("i", "j", "kind").toArrow()
                run = optimize.local_loop(y0, *(t.column(c).to_numpy() for c in ("i", "j", "kind")), p.iters, adam, **more)
            else:
                run = optimize.distributed_loop(y0, pr, p.iters, adam, total, **more)
        self._tell("statistics", n, n, 90.0)
        with timers.step("statistics"):
            y = run.y.astype(np.float32).astype(np.float64)

            def of(v: np.ndarray) -> DataFrame:
                return _table(spark, np.arange(n), v, "y")

            embedding = of(y).withColumnRenamed("id", "pos").join(ids, "pos").select("id", "y").persist()
            train = ids.join(rows.withColumnRenamed("id", "pos"), "pos").select("id", "features").persist()
            points = embedding.select("id", F.col("y").alias("features"))
            near = knn(points, points, min(p.neighbors, n - 1), "euclidean", p.mode).select("dist").persist()  # read three times
            figures = stats.distance_stats(near).first().asDict()
            near.unpersist()
            losses = optimize.shared_losses(pr, [y0, run.y], optimize.weights_at(0, *p.iters[:2]))
        model = EmbeddingModel(p, scaling, train, embedding, figures, run.history, counts)
        model.pairs = pr if self.keep_pairs else None
        return self._finished(model, run, losses, timers)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).embedding


def _places(given: DataFrame, ids: np.ndarray, p: Params) -> np.ndarray:
    """y of given in the order of ids."""
    t = given.select("id", "y").toArrow().sort_by("id")
    y = matrix(t.column("y").combine_chunks())
    if not np.array_equal(t.column("id").to_numpy(), ids) or y.shape[1:] != (p.components,):
        raise ValueError(f"the start needs one place of {p.components} numbers for every row")
    return y


def _start(given: DataFrame, ids: np.ndarray, p: Params) -> np.ndarray:
    """A user's start: its columns standardised and scaled down."""
    y = _places(given, ids, p)
    spread = y.std(0)
    return (y - y.mean(0)) / np.where(spread > 0, spread, 1.0) * p.deviation


def place_by_optimising(model: EmbeddingModel, df: DataFrame, iters: tuple[int, int, int] = (30, 30, 60)) -> DataFrame:
    """id, y of new rows, moved by the optimiser against fixed neighbours in the training embedding (start: their mean)."""
    n = model.embedding.count() + df.count()
    if memory_estimate(n, 0, model.params.components, n * model.params.neighbors) > STATE_BYTES:
        raise MemoryError(f"{error_text(-2)}: {n} rows are too many to be optimised in one process")
    start, near = model.transform(df), model._near(df)
    ids = start.orderBy("id").toArrow()
    base = model.embedding.orderBy("id").toArrow()
    order = np.concatenate((base.column("id").to_numpy(), ids.column("id").to_numpy()))
    fixed = base.num_rows
    y0 = np.concatenate((matrix(base.column("y").combine_chunks()), matrix(ids.column("y").combine_chunks())))
    new = {int(x): fixed + k for k, x in enumerate(order[fixed:])}
    old = {int(x): k for k, x in enumerate(order[:fixed])}
    e = near.select("i", "j").toArrow()
    i = np.array([new[x] for x in e.column("i").to_pylist()], np.int64)
    j = np.array([old[x] for x in e.column("j").to_pylist()], np.int64)
    run = optimize.local_loop(y0, i, j, np.zeros(len(i), np.int64), iters, optimize.Adam(lr=0.1), fixed=fixed)
    t = pa.table({"id": pa.array(order[fixed:]), "y": pa.array(run.y[fixed:].tolist(), pa.list_(pa.float64()))})
    return df.sparkSession.createDataFrame(t)


def sweep_settings(kind: str, base: Params) -> list[Params]:
    """The settings of a sweep: neighbors 5, 7 .. 29, lr 0.6 .. 1.0, start (its deviation 1e-4 .. 1e-1), ratios (mid-range 0.4 ..
    1.3, far the whole part of four times that)."""
    made = {
        "neighbors": [{"neighbors": k} for k in range(5, 30, 2)],
        "lr": [{"lr": x / 10} for x in range(6, 11)],
        "start": [{"deviation": 10.0**-k} for k in (4, 3, 2, 1)],
        "ratios": [{"mn_ratio": x / 10, "fp_ratio": float(4 * x // 10)} for x in range(4, 14)],
    }
    return [replace(base, **m) for m in made[kind]]


def sweep(df: DataFrame, labels: DataFrame, settings: list[Params]) -> DataFrame:
    """param, quality, seconds of every setting (quality: mean distance to the nearest row of the same label)."""
    import time

    from vecspan.operators.evaluate import same_label_quality

    rows, lists = [], local.Lists(pairs.EXTRA + max(p.neighbors or 0 for p in settings)) if settings else None
    for k, p in enumerate(settings):
        began, one = time.time(), EmbeddingEstimator(p)
        one.lists = lists
        e = one.fit(df).embedding.join(labels.select("id", "label"), "id")
        rows.append((k, same_label_quality(e).first()["quality"], time.time() - began))
    return df.sparkSession.createDataFrame(rows, "param int, quality double, seconds double")
