"""Fixed-size arrays that tasks add up, and their sum over all tasks in a tree."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from jobstrata.session import Stages

FAN_IN = 16
SCHEMA = "k int, sums binary"


_DENSE, _SPARSE, _FLOAT = range(3)


def packed(x: np.ndarray) -> bytes:
    """An array in few bytes: floats as they are; counts in the least width that holds them, or only those that are not 0."""
    if x.dtype.kind == "f":
        return bytes([_FLOAT, 8]) + x.tobytes()
    width = next(w for w in (2, 4, 8) if int(x.max(initial=0)) < 1 << (8 * w - 1))
    at = np.flatnonzero(x)
    if len(at) * (4 + width) < len(x) * width:
        return bytes([_SPARSE, width]) + np.array([len(x), len(at)], "<i8").tobytes() + at.astype("<u4").tobytes() + x[at].astype(f"<i{width}").tobytes()
    return bytes([_DENSE, width]) + x.astype(f"<i{width}").tobytes()


def add_packed(total: np.ndarray | None, data: bytes) -> np.ndarray:
    """The sum with a packed array; None stands for zeros."""
    kind, width = data[0], data[1]
    if kind == _SPARSE:
        size, n = np.frombuffer(data, "<i8", 2, 2)
        total = np.zeros(size, np.int64) if total is None else total
        total[np.frombuffer(data, "<u4", n, 18)] += np.frombuffer(data, f"<i{width}", n, 18 + 4 * n)
        return total
    x = np.frombuffer(data, np.float64 if kind == _FLOAT else f"<i{width}", -1, 2)
    if total is None:
        return x.astype(np.float64 if kind == _FLOAT else np.int64)
    total += x
    return total


def sum_rows(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"k": pa.array(list(totals), pa.int32()), "sums": pa.array([packed(v) for v in totals.values()], pa.binary())})


def tree_sum(rows: DataFrame, stages: Stages) -> dict[int, np.ndarray]:
    """Sum of the arrays of each k. The arrays of FAN_IN tasks meet in one task, level by level, until one task's are left;
    only these reach the driver, so their number and size are those of one task whatever the input."""
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("k").to_pylist(), b.column("sums")):
                total[k] = add_packed(total.get(k), v.as_buffer().to_pybytes())
        yield sum_rows(total)

    table, n = stages.keep(rows, "sums"), None
    while n != 1:
        n = -(-(n or max(1, table.rdd.getNumPartitions())) // FAN_IN)
        above = stages.keep(table.repartition(n).mapInArrow(add, SCHEMA), "sums")
        stages.drop(table)
        table = above
    out = {r["k"]: add_packed(None, bytes(r["sums"])) for r in table.collect()}
    stages.drop(table)
    return out
