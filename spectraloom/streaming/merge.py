"""Merging spectra of equal retention time, as a batch and as a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_spectra(peaks: DataFrame, width: float, mz_width: float = 10.0) -> DataFrame:
    """(run_id, rt_cell, mz_cell, intensity, n): summed intensity in cells of retention time and m/z."""
    return peaks.groupBy("run_id", F.floor(F.col("rt") / width).alias("rt_cell"), F.floor(F.col("mz") / mz_width).alias("mz_cell")).agg(F.sum("intensity").alias("intensity"), F.count("*").alias("n"))


def merge_stream(peaks: DataFrame, width: str = "10 seconds", late: str = "30 seconds", mz_width: float = 10.0) -> DataFrame:
    """The same over a stream whose column `at` is a timestamp: a cell is emitted once the watermark has passed it.

    State is one sum for each open cell; later rows are dropped by Spark and counted in its metrics."""
    w = peaks.withWatermark("at", late).groupBy("run_id", F.window("at", width).alias("w"), F.floor(F.col("mz") / mz_width).alias("mz_cell"))
    return w.agg(F.sum("intensity").alias("intensity"), F.count("*").alias("n")).select("run_id", F.col("w.start").alias("rt_start"), "mz_cell", "intensity", "n")
