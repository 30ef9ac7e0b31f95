"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from verdance.shipping import ship

_kept: dict = {}


def kept_in_worker(key: tuple, build: Callable[[], Any]) -> Any:
    """What a Python worker remembers from task to task: one thing at a time.

    Workers serve one operator after the other; what the last one remembered
    is dropped, and its memory handed back to the system, when the next one
    begins, so memory is the largest and not the sum.
    """
    if key not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
        _kept[key] = build()
    return _kept[key]


#: Records of an output batch that Python workers hand back at most.
OUT_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of at most ``most`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield batch_of(held, schema)
            held = []
    if held:
        yield batch_of(held, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 one) over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))
