"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed. Each pass of Spark multiplies it with a block of
vectors: tasks compute Xc'(Xc Q) of their centred rows, the products are summed row by
row of the result in a shuffle, and only the sum (dimensions x block) comes to the
driver. There a QR step and a Rayleigh-Ritz projection give the next block, until the
residuals |V q - e q| of all k components are at the level of rounding; then the
components are certified. A block as wide as the vectors needs a single pass.

Entries become integers, x = floor(64 * c) + 1000000, so counts, sums and deviations
are exact, and rows are centred (n * x - S, an integer, over n) before they are multiplied.

Defined cases: rows whose vector is null or has null or non-finite entries are left out
of everything; so are vectors of another length than most have (of equally frequent
lengths the longest counts); equal vectors and repeated ids are rows of their own; an
empty table gives no rows; components whose variance is 1e-11 of the greatest or less
(all of them, if no vector differs) are no components, as they cannot be whitened;
entries of 2 ** 40 or more, and deviations beyond a long, are errors. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_BYTES, lean

SCALE, SHIFT = 64, 1_000_000
#: Vectors in one Arrow batch at most (and no more bytes than a batch of texts).
BATCH = 2048
#: Entries are below this, so that sums over a task are exact in 64 bits.
MOST = 1 << 40
#: A component's variance is more than this part of the greatest one's.
RANK = 1e-11
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Fit:
    """n vectors of d entries; per-dimension sums of x less SHIFT; unit components (columns) by falling variance; trace of V."""

    d: int
    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def whole(batch: pa.RecordBatch, d: int | None = None) -> tuple[np.ndarray, list[np.ndarray] | np.ndarray]:
    """(row numbers, integer rows floor(64 c)) of the vectors of d finite entries; without d, (row numbers, lengths) of all finite ones."""
    column = batch.column("vector")
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    if d is not None:
        rows = np.flatnonzero(lengths == d)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d)
        good = np.isfinite(flat).all(axis=1)
        scaled = np.floor(flat[good] * SCALE)
        if scaled.size and np.abs(scaled).max() >= MOST:
            raise OverflowError(f"an entry of a vector is {MOST // SCALE} or more")
        return rows[good], scaled.astype(np.int64)
    rows = np.flatnonzero(lengths >= 0)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths[rows])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = bad[ends] == bad[ends - lengths[rows]]
    return rows[good], lengths[rows][good]


def centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S: exact, in 64-bit integers where they reach, else in Python's."""
    most = max(int(np.abs(y).max(initial=0)), 1) * n + max(map(abs, sums.tolist()), default=0)
    return y * n - sums.astype(np.int64) if most < 1 << 62 else y.astype(object) * n - sums


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))


def dimension(vectors: DataFrame) -> int | None:
    """The length that most vectors have."""

    def count(batches):
        for batch in batches:
            found, times = np.unique(whole(batch)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(times, pa.int64())], names=["d", "n"])

    row = vectors.select("vector").mapInArrow(lean(count), "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return None if row is None else row["d"]


def totals(vectors: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """(vectors, exact sums of their entries)."""

    def add(batches):
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            y = whole(batch, d)[1]
            n, total = n + len(y), total + y.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(x) for x in total]), pa.array([n] * d, pa.int64())], names=["i", "s", "n"])

    rows = vectors.select("vector").mapInArrow(lean(add), "i int, s string, n long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()  # d rows
    sums = np.zeros(d, object)
    for r in rows:
        sums[r["i"]] = int(r["s"])
    return rows[0]["n"], sums


def summed(spark: SparkSession, vectors: DataFrame, height: int, product) -> np.ndarray:
    """The sum over all batches of ``product(batch)`` (height x width): a partial matrix a task, summed by row in a shuffle."""

    def part(batches):
        total = None
        for batch in batches:
            got = product(batch)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array([r.tobytes() for r in np.ascontiguousarray(total)], pa.binary())], names=["i", "row"])

    def rows(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist(), strict=True):
                total[i] = total.get(i, 0.0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["i", "row"])

    parts = vectors.select("vector").mapInArrow(lean(part), "i int, row binary")
    got = parts.repartition("i").mapInArrow(lean(rows), "i int, row binary").collect()  # height rows
    return np.stack([np.frombuffer(r["row"]) for r in sorted(got, key=lambda r: r["i"])])


def fit(df: DataFrame, k: int = 32, block: int | None = None, max_passes: int = 1000, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> Fit | None:
    """The k components of greatest variance of the whole table; None without any vector.

    ``block``: vectors multiplied at once (default 2 k, at most d). Convergence goes with
    the ratio of the variance after the block to the k-th.
    """
    spark, vectors = df.sparkSession, _vectors(df, id_col, vec_col)
    d = dimension(vectors)
    if not d:
        return None
    n, sums = totals(vectors, d)
    k = min(k, d)
    width = min(d, max(k, block or 2 * k))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    best, stale = np.inf, 0
    for passes in range(1, max_passes + 1):
        sent = spark.sparkContext.broadcast((n, sums, q))  # d x block

        def product(batch):
            n, sums, q = sent.value
            x = centred(whole(batch, d)[1], n, sums).astype(float) / n
            return np.vstack([x.T @ (x @ q), np.full((1, q.shape[1]), np.square(x).sum())])

        got = summed(spark, vectors, d + 1, product) / n
        y, trace = got[:d], float(got[d, 0])
        ritz, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        ritz = np.maximum(ritz, 0.0)
        kept = int((ritz[:k] > RANK * ritz[0]).sum()) if ritz[0] > 0 else 0
        residuals = np.linalg.norm(y[:, :kept] - q[:, :kept] * ritz[:kept], axis=0)
        worst = float(residuals.max(initial=0.0))
        stale = 0 if worst < 0.9 * best else stale + 1
        best = min(best, worst)
        # At rounding: few units of it, or no better any more and close to it.
        if worst <= 32 * EPS * ritz[0] or (stale >= 3 and worst <= 4096 * EPS * ritz[0]):
            return Fit(d, n, sums, q[:, :kept], ritz[:kept], trace, residuals, passes)
        q = np.linalg.qr(y)[0]
    raise RuntimeError(f"residual {worst / ritz[0]:.2g} of the greatest variance after {max_passes} passes: widen the block")


def identity_error(df: DataFrame, model: Fit, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """The largest entry of the whitened vectors' covariance less the identity, measured over all of them."""
    k = len(model.variances)
    if not k:
        return 0.0
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((model.n, model.sums, model.components / np.sqrt(model.variances)))

    def product(batch):
        n, sums, p = sent.value
        w = centred(whole(batch, model.d)[1], n, sums).astype(float) / n @ p
        return np.vstack([w.T @ w, w.sum(axis=0)])

    got = summed(spark, _vectors(df, id_col, vec_col), k + 1, product) / model.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def transform(df: DataFrame, model: Fit, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, deviation (sum over dimensions of (n * x - S) ** 2), whitened (array of double, a value a component)."""
    vectors = _vectors(df, id_col, vec_col)
    sent = df.sparkSession.sparkContext.broadcast((model.n, model.sums, model.components / np.sqrt(model.variances)))
    d = model.d

    def run(batches):
        n, sums, p = sent.value
        for batch in batches:
            rows, y = whole(batch, d)
            x = centred(y, n, sums)
            if x.dtype != object and np.abs(x).max(initial=0) ** 2 * d >= 2.0**63:
                x = x.astype(object)
            w = x.astype(float) / n @ p
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array((x * x).sum(axis=1).tolist(), pa.int64()), values], names=["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(lean(run), f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")


def whiten(df: DataFrame, k: int = 32, block: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    model = fit(df, k, block, id_col=id_col, vec_col=vec_col)
    if model is None:
        kind = df.select(id_col).schema[0].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(df, model, id_col, vec_col)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.variances]).cast("array<double>")
    out = transform(df, model, id_col, vec_col).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "value"))
    return out.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"),
        F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
    )
