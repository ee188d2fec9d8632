"""Softmax regressions of a whole grid of settings, fitted together.

All points of the grid read the same counts of buckets (text_vectors.counted). So a
pass over the rows gives the loss and gradient of every point that isn't there yet:
its number follows the slowest fit, not the sum of all. What the driver holds and
tasks are sent is a number a bucket, label and fit, whatever the rows.

A point is a smallest document frequency and C. Points whose frequencies leave the
same weights are one fit if their C is the same too. Vectors are in single
precision, as the reference's; sums over blocks of rows are in double.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.text_vectors import BUCKETS, PARTS, frequencies, idf_of, parts_of
from tidemark.plans.storage import WIDE, settings

SIZE, HALVES = len(PARTS) * BUCKETS, (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS))
#: Rows that are multiplied at once. Steps that L-BFGS remembers, and its rule to stop: Spark's own for its regressions.
BLOCK, MEMORY, STEPS, TOL, WINDOW = 256, 10, 300, 1e-3, 20


def blocks(rows: DataFrame, idfs: list[np.ndarray]) -> RDD:
    """Rows of counted() by BLOCK: number of buckets of each row, buckets, places of their 1 + ln n in a list, the list, what brings a row's halves to length 1 for each idf, label, weight."""
    known = rows.sparkSession.sparkContext.broadcast([idf * idf for idf in idfs])  # a number a bucket

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                at, n, label, weight = batch.slice(lo, BLOCK).columns
                own = parts_of(at, np.int64)
                sizes = np.array([len(a) for a in own], np.int32)
                ends, flat = np.cumsum(sizes), np.concatenate(own)
                counts, code = np.unique(np.concatenate(parts_of(n, np.int64)), return_inverse=True)
                known_x = 1.0 + np.log(counts)
                x = known_x[code]
                middle = ends - sizes + [np.searchsorted(a, BUCKETS) for a in own]
                scale = np.zeros((len(own), len(HALVES), len(known.value)), np.float32)
                for k, square in enumerate(known.value):
                    sums = np.concatenate([[0.0], np.cumsum(x * x * square[flat])])
                    for half, (a, b) in enumerate(((ends - sizes, middle), (middle, ends))):
                        length = np.sqrt(np.maximum(sums[b] - sums[a], 0.0))
                        scale[:, half, k] = np.divide(1.0, length, out=np.zeros(len(own)), where=length > 1e-6)  # a weight that counts is 1 or more
                block = sizes, flat.astype(np.uint16), code.astype(np.min_scalar_type(len(counts))), known_x.astype(np.float32), scale, label.to_numpy().astype(np.int32), weight.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], ["block"])

    return rows.select("at", "n", "label", "weight").mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r.block))


def _scores(block: tuple, room: np.ndarray, weights: np.ndarray, bias: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows in full (in `room`), and for each fit what their halves are multiplied by, and the scores of the labels."""
    sizes, at, code, known_x, scale, *_ = block
    full, x, lo = room[: len(sizes)], known_x[code], 0
    full.fill(0)
    for row, size in zip(full, sizes.tolist(), strict=True):
        row[at[lo : lo + size]] = x[lo : lo + size]
        lo += size
    by = scale[:, :, groups]
    z = sum((full[:, own] @ weights[own]).reshape(len(full), *bias.shape) * by[:, half, :, None] for half, own in enumerate(HALVES))
    return full, by, z.astype(float) + bias


def _packed(theta: np.ndarray, idfs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all fits side by side, times idf, and their intercepts. theta: by fit, bucket (the last is the intercept) and label."""
    return (theta[:, :-1] * idfs[:, :, None]).transpose(1, 0, 2).reshape(SIZE, -1).astype(np.float32), theta[:, -1]


def _sum(rdd: RDD, of: Callable[[Iterator[tuple]], list[np.ndarray]]) -> list[np.ndarray] | None:
    """Sums of what the tasks give, of which the driver gets a few at once."""
    given = rdd.mapPartitions(lambda found: [x] if (x := of(found)) else [])
    if given.getNumPartitions() == 0:
        return None
    add = lambda a, b: b if a is None else a if b is None else [x + y for x, y in zip(a, b, strict=True)]
    return given.treeAggregate(None, add, add, depth=1 if given.getNumPartitions() <= 16 else 2)


def losses(rdd: RDD, theta: np.ndarray, idfs: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fit the weighted sum of its rows' losses, and its gradient."""
    known = rdd.context.broadcast((*_packed(theta, idfs[groups]), groups))

    def of(found: Iterator[tuple]) -> list[np.ndarray]:
        weights, bias, groups = known.value
        loss, slope, free, room = np.zeros(len(bias)), np.zeros(weights.shape[::-1]), np.zeros(bias.shape), np.empty((BLOCK, SIZE), np.float32)
        for block in found:
            full, by, z = _scores(block, room, weights, bias, groups)
            label, weight = block[5:]
            z -= z.max(axis=2, keepdims=True)
            given = np.take_along_axis(z, np.broadcast_to(label[:, None, None], (*z.shape[:2], 1)), 2)[:, :, 0]
            p = np.exp(z)
            total = p.sum(axis=2)
            loss += weight @ (np.log(total) - given)
            p /= total[:, :, None]
            p[np.arange(len(p)), :, label] -= 1.0
            p *= weight[:, None, None]
            free += p.sum(axis=0)
            for half, own in enumerate(HALVES):
                slope[:, own] += np.ascontiguousarray((p * by[:, half, :, None]).reshape(len(p), -1).T, np.float32) @ full[:, own]
        return [loss, slope, free]

    loss, slope, free = _sum(rdd, of)
    known.destroy()
    fits, labels = free.shape
    return loss, np.concatenate([slope.reshape(fits, labels, SIZE).transpose(0, 2, 1) * idfs[groups][:, :, None], free[:, None]], axis=1)


def minimize(evaluate: Callable[[list[int], np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, step: float) -> np.ndarray:
    """Where each of several convex functions is least, by L-BFGS: evaluate(which, at) gives values and gradients of those still asked for, all at once. `step`: of the first."""
    at, left = start.copy(), list(range(len(start)))
    value, slope = map(list, evaluate(left, at))
    past, seen = [deque(maxlen=MEMORY) for _ in left], [deque([v], maxlen=WINDOW) for v in value]
    first, steps = list(value), [0] * len(left)

    def there(i: int) -> bool:
        return steps[i] >= STEPS or np.linalg.norm(slope[i]) <= max(TOL * abs(value[i]), 1e-8) or len(seen[i]) > 1 and abs(value[i] - max(seen[i])) <= TOL * abs(first[i])

    def towards(i: int) -> np.ndarray:
        d, used = -slope[i], []
        for s, y, sy in reversed(past[i]):
            used.append(a := (s * d).sum() / sy)
            d = d - a * y
        d = d * ((past[i][-1][2] / (past[i][-1][1] ** 2).sum()) if past[i] else step)
        for (s, y, sy), a in zip(past[i], reversed(used), strict=True):
            d = d + (a - (y * d).sum() / sy) * s
        return d

    left = [i for i in left if not there(i)]
    way, far = {i: towards(i) for i in left}, {i: 1.0 for i in left}
    while left:
        tried = np.stack([at[i] + far[i] * way[i] for i in left])
        for i, x, v, g in zip(list(left), tried, *evaluate(left, tried), strict=True):
            fall = (way[i] * slope[i]).sum()
            if not v <= value[i] + 1e-4 * far[i] * fall:
                far[i] *= min(0.5, max(0.1, -0.5 * far[i] * fall / (v - value[i] - far[i] * fall))) if np.isfinite(v) else 0.1
                if far[i] < 1e-10:  # no step makes it less
                    left.remove(i)
                continue
            s, y = x - at[i], g - slope[i]
            if (sy := (s * y).sum()) > 1e-12 * (y * y).sum():
                past[i].append((s, y, sy))
            at[i], value[i], slope[i], steps[i] = x, v, g, steps[i] + 1
            if there(i):
                left.remove(i)
            else:
                seen[i].append(v)
                way[i], far[i] = towards(i), 1.0
    return at


def fit_grid(train: DataFrame, held_out: DataFrame, points: list[tuple[int, float]]) -> list[list[tuple[float, float, int]]]:
    """For each (min_df, C) the held-out rows by label and prediction, of regressions of all rows to train on.

    The loss is that of Spark's: the weighted mean of rows' losses, and half the
    squares of weights without intercepts times 1 / (C rows).
    """
    spark = train.sparkSession
    sizes = {int(r.label): (r.n, r.weight) for r in train.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()}  # a row a label
    most = held_out.agg(F.max("label")).first()[0]
    rows, total, labels = sum(n for n, _ in sizes.values()), sum(w for _, w in sizes.values()), 1 + int(max([*sizes, most or 0]))
    df = frequencies(train)
    idfs, fits, fit_of = [], [], []
    for min_df, c in points:
        idf = idf_of(df, rows, min_df)
        group = next((k for k, known in enumerate(idfs) if np.array_equal(known, idf)), len(idfs))
        idfs += [idf] * (group == len(idfs))
        fits += [(group, c)] * ((group, c) not in fits)
        fit_of.append(fits.index((group, c)))
    groups, penalty, idfs = np.array([k for k, _ in fits]), np.array([1.0 / (c * max(rows, 1)) for _, c in fits])[:, None, None], np.array(idfs)
    theta = np.zeros((len(fits), SIZE + 1, labels))
    share = np.log([max(sizes.get(label, (0, 0.0))[1] / (total or 1.0), 1e-9) for label in range(labels)])
    theta[:, -1] = share - share.mean()
    with settings(spark, WIDE):
        if rows:
            ours = blocks(train, list(idfs)).coalesce(spark.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)

            def evaluate(which: list[int], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                loss, slope = losses(ours, at, idfs, groups[which])
                w, slope = at[:, :-1], slope / total
                slope[:, :-1] += penalty[which] * w
                return loss / total + 0.5 * (penalty[which] * w * w).sum(axis=(1, 2)), slope

            theta = minimize(evaluate, theta, 1.0)
            ours.unpersist()
        known = spark.sparkContext.broadcast((*_packed(theta, idfs[groups]), groups))

        def count(found: Iterator[tuple]) -> list[np.ndarray]:
            cells, room = np.zeros((len(known.value[1]), labels, labels), np.int64), np.empty((BLOCK, SIZE), np.float32)
            for block in found:
                _, _, z = _scores(block, room, *known.value)
                for own, best in zip(cells, z.argmax(axis=2).T, strict=True):
                    np.add.at(own, (block[5], best), 1)
            return [cells]

        found = _sum(blocks(held_out, list(idfs)), count)
        known.destroy()
    cells = found[0] if found else np.zeros((len(fits), labels, labels), np.int64)
    return [[(float(a), float(b), int(cells[i, a, b])) for a, b in zip(*np.nonzero(cells[i]))] for i in fit_of]
