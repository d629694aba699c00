"""Consumers of spectra that arrive as a stream: chains of steps, storage, running totals and a stateful watch over gaps in time."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout


def chain(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stream through all steps in order; each takes and returns a DataFrame, so peak filters without a window serve as they are."""
    return functools.reduce(lambda d, f: f(d), steps, stream)


def store(stream: DataFrame, path: str, checkpoint: str, partition_by: tuple = ("run_id",)) -> StreamingQuery:
    """Write what is there by now as Parquet, each row exactly once, and stop; a later call goes on from the checkpoint."""
    return stream.writeStream.format("parquet").partitionBy(*partition_by).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tic_stream(peaks: DataFrame, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """(run_id, start, tic, base_peak, n) for windows of the timestamp `at`, each emitted once the watermark has passed it."""
    w = peaks.withWatermark("at", late).groupBy("run_id", F.window("at", width).alias("w"))
    return w.agg(F.sum("intensity").alias("tic"), F.max("intensity").alias("base_peak"), F.count("*").alias("n")).select("run_id", F.col("w.start").alias("start"), "tic", "base_peak", "n")


def time_gaps(spectra: DataFrame, longest: float) -> DataFrame:
    """spectra (run_id, rt) -> (run_id, before, after): where a run has no spectrum for more than `longest` seconds.

    State is one number for each run: its latest time so far. Times below that are late and open no gap."""

    def watch(key, frames, state):
        last = state.get[0] if state.exists else None
        rows = []
        times = sorted(t for f in frames for t in f["rt"].dropna())
        for t in times:
            if last is not None and t - last > longest:
                rows.append((key[0], last, t))
            last = t if last is None else max(last, t)
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame(rows, columns=["run_id", "before", "after"])

    return spectra.select("run_id", "rt").groupBy("run_id").applyInPandasWithState(watch, "run_id long, before double, after double", "last double", "append", GroupStateTimeout.NoTimeout)
