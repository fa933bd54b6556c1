"""Dense float blocks summed over tasks: the partial sums of matrix jobs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: What a task sends: its partial sum of a numbered block.
PARTIAL = "block long, task long, data binary"
#: Partial sums of so many bytes in all go to the driver as they are.
DIRECT = 32 << 20


def partials(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's blocks as rows of PARTIAL, one a batch."""
    task = TaskContext.get().partitionId()
    for block, data in sorted(found.items()):
        yield pa.record_batch([pa.array([block], pa.int64()), pa.array([task], pa.int64()), pa.array([np.ascontiguousarray(data, np.float64).tobytes()], pa.binary())], names=["block", "task", "data"])


def _sum(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = None
    for data in rows.sort_values("task").data:  # one order, so sums come out alike
        part = np.frombuffer(data)
        total = part.copy() if total is None else total + part
    return pd.DataFrame({"block": [key[0]], "task": [rows.task.min()], "data": [total.tobytes()]})


def summed(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], size: int | None = None) -> dict[int, np.ndarray]:
    """Sums by block of what `run` sends from each partition of df; the blocks' sizes are bounded by the caller.

    Tasks meet in about as many groups as each holds members, then the groups meet: no group holds more than the root of the number of tasks.
    Where a task sends `size` bytes at most and all tasks DIRECT, the driver adds them up in the order of tasks, which saves the shuffles.
    """
    tasks = df.rdd.getNumPartitions()
    fan = max(1, math.isqrt(tasks))
    sent = df.mapInArrow(run, PARTIAL)
    if tasks <= 1:
        return {r["block"]: np.frombuffer(r["data"]) for r in sent.select("block", "data").collect()}
    if size is not None and tasks * size <= DIRECT:
        total: dict[int, np.ndarray] = {}
        for r in sorted(sent.collect(), key=lambda r: r["task"]):
            part = np.frombuffer(r["data"])
            total[r["block"]] = total[r["block"]] + part if r["block"] in total else part
        return total
    near = sent.selectExpr("block", "task", f"task % {fan} AS fan", "data").groupBy("block", "fan").applyInPandas(_sum, PARTIAL)
    done = near if fan == 1 else near.groupBy("block").applyInPandas(_sum, PARTIAL)
    return {r["block"]: np.frombuffer(r["data"]) for r in done.select("block", "data").collect()}  # one row a block
