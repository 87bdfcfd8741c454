"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions several times; each projection, with its own random shift, is
walked by a Hilbert curve. Spark range-partitions the vectors by curve and key, positions on the curve
follow from the partitions' sizes, and a query looks at the key window of ``reach`` of all vectors to
either side. Windows travel as codes of two bytes a component, each with the length of what it leaves out,
which bounds the error of a cosine from codes. Every candidate that may be among the best within these
bounds is ranked again by exact cosines in double precision; their number is not limited.

Equal vectors are indexed once with the smallest of their ids that any answer can need, so a vector that
very many rows share neither fills windows nor loses ties. Every vector is in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernel import partitions, read, ship, stored

CURVES = 8
DIMENSIONS = 8
BITS = 3
#: Share of all vectors in a query's window to either side of its place on each curve.
REACH = 0.1
CELL = 1024
#: Largest code of a component, and what rounding in double precision may add to a cosine.
TOP = 32767
ROUNDING = 1e-9


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below 2**bits.

    Coordinates are turned into the curve's transposed index bit by bit: a set bit mirrors the lower bits
    of the first axis, a clear one swaps them with that axis, and a Gray code undoes the mirroring.
    """
    x = grid.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for axis in x:
            up = (axis >> np.uint64(b)) & one == 1
            swap = np.where(up, np.uint64(0), (x[0] ^ axis) & low)
            x[0] ^= np.where(up, low, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & one == 1, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << one) | ((axis >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(unit: np.ndarray, curve: int, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Keys of unit vectors on one of the curves."""
    width = unit.shape[1]
    rng = np.random.default_rng((11, curve, width))
    dimensions = min(dimensions, width)
    onto = np.linalg.qr(rng.normal(size=(width, dimensions)))[0]
    flat = 1 / (1 + np.exp(-1.7 * (unit @ onto) * np.sqrt(width)))  # about uniform in 0 to 1
    shifted = 0.75 * flat + rng.uniform(0, 0.25, dimensions)
    return hilbert_keys(np.minimum((shifted * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def encoded(unit: np.ndarray) -> np.ndarray:
    """A row of bytes for each unit vector: scale, length of what the code leaves out (not less), components."""
    scale = (np.abs(unit).max(axis=1, keepdims=True) / TOP).astype(np.float32)
    body = np.clip(np.round(unit / scale), -TOP, TOP).astype(np.int16)
    off = np.linalg.norm(unit - body * scale.astype(np.float64), axis=1, keepdims=True)
    off = (off * (1 + 1e-6) + 1e-12).astype(np.float32)
    return np.concatenate([scale.view(np.int8), off.view(np.int8), body.view(np.int8)], axis=1)


def decoded(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of n codes and their distances from the unit vectors at most."""
    raw = np.frombuffer(data, np.int8).reshape(n, -1)
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32).astype(np.float64)
    return np.ascontiguousarray(raw[:, 8:]).view(np.int16) * head[:, :1], head[:, 1]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _place(curves: int):
    """(curve, key, id, asked, code) of every vector on every curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                v = _matrix(part.column(1))
                unit = v / np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(v).max(axis=1, keepdims=True)
                codes = pa.array([c.tobytes() for c in encoded(unit)], pa.binary())
                for curve in range(curves):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(v), curve, np.int32)), pa.array(curve_keys(unit, curve)), part.column(0), part.column(2), codes],
                        names=["curve", "key", "id", "asked", "code"],
                    )

    return run


_RUN = "part int, curve int, seq int, n long, ids binary, asked binary, codes binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of up to CELL vectors that follow each other on a curve, numbered in their partition."""
    seq = 0
    for batch in batches:
        curve = batch.column(0).to_numpy()
        for c in np.unique(curve).tolist():
            lo, hi = np.searchsorted(curve, [c, c + 1])
            for a in range(lo, hi, CELL):
                part = batch.slice(a, min(CELL, hi - a))
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                        "curve": pa.array([c], pa.int32()),
                        "seq": pa.array([seq], pa.int32()),
                        "n": pa.array([part.num_rows], pa.int64()),
                        "ids": [part.column(2).to_numpy().tobytes()],
                        "asked": [part.column(3).to_numpy(zero_copy_only=False).tobytes()],
                        "codes": [b"".join(part.column(4).to_pylist())],
                    }
                )
                seq += 1


def _cells(totals: dict[int, int], reach: float, wanted: bool):
    """Runs with their first position, cut at cell borders; with ``wanted`` its queries, dealt to every cell of their window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                start, n = r["start"], r["n"]
                ids, asked = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["asked"], bool)
                codes = np.frombuffer(r["codes"], np.int8).reshape(n, -1)
                side = int(np.ceil(reach * totals[r["curve"]]))
                last = (totals[r["curve"]] - 1) // CELL
                cell = (start + np.arange(n)) // CELL
                for c in np.unique(cell).tolist():
                    use = cell == c
                    if not wanted:
                        out.append((r["curve"], c, ids[use].tobytes(), codes[use].tobytes()))
                        continue
                    use = use & asked
                    if use.any():
                        at = start + np.flatnonzero(use)
                        body = (ids[use].tobytes(), codes[use].tobytes())
                        for to in range(max(0, (at[0] - side) // CELL), min(last, (at[-1] + side) // CELL) + 1):
                            out.append((r["curve"], to, *body))
            if out:
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["curve", "cell", "ids", "codes"]
                )

    return run


def _window_best(keep: int):
    """(query, candidate ids, upper bounds of their cosines, ids and lower bounds of the ``keep`` best) of one cell for each query.

    Candidates are all that may be among the cell's ``keep`` best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, there = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in (0, 2))
                x, x_off = decoded(batch.column(1)[i].as_py(), len(asked))
                y, y_off = decoded(batch.column(3)[i].as_py(), len(there))
                near = x @ y.T
                # u.v - x.y = (u - x).v + x.(v - y), and x is at most 1 + |u - x| long
                off = x_off[:, None] + (1 + x_off[:, None]) * y_off + ROUNDING
                low, high = near - off, near + off
                k = min(keep, len(there))
                top = np.argpartition(-low, k - 1, axis=1)[:, :k]
                least = np.take_along_axis(low, top, axis=1)
                may = high >= least.min(axis=1, keepdims=True)
                columns = [
                    [there[m].tobytes() for m in may],
                    [h[m].tobytes() for h, m in zip(high, may, strict=True)],
                    [there[t].tobytes() for t in top],
                    [x.tobytes() for x in least],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(asked), *(pa.array(c, pa.binary()) for c in columns)], names=["query", "ids", "high", "top", "low"])

    return run


def _bounds(keep: int):
    """(query, bound): a cosine that ``keep`` candidates reach, or all if they are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = []
            for windows in batch.column(1).to_pylist():
                ids = np.concatenate([np.frombuffer(w["top"], np.int64) for w in windows])
                low = np.concatenate([np.frombuffer(w["low"], np.float64) for w in windows])
                ids, first = np.unique(ids, return_index=True)
                bounds.append(float(np.sort(low[first])[-keep:][0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bounds, pa.float64())], names=["query", "bound"])

    return run


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, candidate) of the candidates that may reach their query's bound."""
    for batch in batches:
        queries, found = [], []
        for query, ids, high, bound in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            found.append(np.frombuffer(ids, np.int64)[np.frombuffer(high, np.float64) >= bound])
            queries.append(np.full(len(found[-1]), query))
        if queries:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(queries)), pa.array(np.concatenate(found))], names=["query", "candidate"])


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            x, y = _matrix(part.column(2)), _matrix(part.column(3))
            score = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], names=["query", "candidate", "score"])


def search(
    vectors: DataFrame,
    queries,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    curves: int = CURVES,
    reach: float = REACH,
) -> DataFrame:
    """(query_id, rank, key, score): the k nearest found of every row for which the condition ``queries`` holds.

    Candidates are all rows but the query's own; ties go to the smaller key. Vectors that are null, of
    another length than most (the greater of equally common ones), zero, or that hold a null, NaN or infinite component
    take no part, nor do null keys; repeated rows of one key and vector are one candidate. With fewer
    than k candidates all are returned; an empty table gives an empty result. Keys are integers.
    """
    spark = vectors.sparkSession
    ship(spark)
    parts = partitions(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("id").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    rows = rows.where(F.size("v") == F.lit(usual["width"] if usual else 0)).distinct()

    # equal vectors: one entry, named by its smallest id, with the k + 1 smallest
    order = Window.partitionBy("v").orderBy("id")
    low = rows.select("v", "id", F.row_number().over(order).alias("n")).where(F.col("n") <= k + 1)
    low = low.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entry = rows.groupBy("v").agg(F.min("id").alias("id"), F.max("asked").alias("asked")).join(low, "v")
    entry = stored(entry.select("id", "v", "asked", "ids"), "vectors")

    placed = entry.select("id", "v", "asked").mapInArrow(_place(curves), "curve int, key long, id long, asked boolean, code binary")
    placed = placed.repartitionByRange(max(parts, curves), "curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    runs = stored(placed.mapInArrow(_pack, _RUN), "curves")
    sizes = runs.groupBy("part", "curve").agg(F.sum("n").alias("n")).orderBy("curve", "part").collect()  # one row a partition and curve
    totals: dict[int, int] = {}
    starts = []
    for part, curve, n in sizes:
        starts.append((part, curve, totals.get(curve, 0)))
        totals[curve] = totals.get(curve, 0) + n
    offsets = spark.createDataFrame(starts, "part int, curve int, base long")
    inner = Window.partitionBy("part", "curve").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("part", "curve", "seq", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("before")).join(offsets, ["part", "curve"])
    placed_runs = runs.join(before, ["part", "curve", "seq"]).withColumn("start", F.col("base") + F.col("before"))
    schema = "curve int, cell long, ids binary, codes binary"
    cells = placed_runs.mapInArrow(_cells(totals, reach, False), schema)
    asking = placed_runs.mapInArrow(_cells(totals, reach, True), schema)
    pairs = asking.join(cells.withColumnsRenamed({"ids": "there", "codes": "there_codes"}), ["curve", "cell"]).select("ids", "codes", "there", "there_codes")
    best = pairs.mapInArrow(_window_best(k + 1), "query long, ids binary, high binary, top binary, low binary")
    best = stored(best, "windows")
    bounds = best.groupBy("query").agg(F.collect_list(F.struct("top", "low")).alias("windows"))
    bounds = bounds.mapInArrow(_bounds(k + 1), "query long, bound double")
    short = best.join(bounds, "query").select("query", "ids", "high", "bound").mapInArrow(_within, "query long, candidate long").distinct()

    left = entry.select(F.col("id").alias("query"), F.col("v").alias("x"))
    right = entry.select(F.col("id").alias("candidate"), F.col("v").alias("y"))
    scored = short.join(right, "candidate").join(left, "query").select("query", "candidate", "x", "y")
    scored = scored.mapInArrow(_cosines, "query long, candidate long, score double")
    scored = scored.join(entry.select(F.col("id").alias("candidate"), "ids"), "candidate")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    scored = scored.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1)  # each holds an answer other than the query
    own = rows.where("asked").select(F.col("id").alias("query_id"), "v").join(entry.select("v", F.col("id").alias("query")), "v").drop("v")
    answers = own.join(scored, "query").select("query_id", "score", F.explode("ids").alias("id")).where("id <> query_id").distinct()
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    answers = answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return answers.select("query_id", "rank", F.col("id").alias(key), "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found of every vector whose id is divisible by 50."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op3_neighbours": op3_neighbours}
ORACLE_SQL: dict[str, str] = {}
