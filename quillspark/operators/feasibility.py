"""Feasibility of labels for a fixed number of time steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import resized_width, timesteps
from ..functions.text import adjacent_repeats


def ctc_feasibility(df: DataFrame, text: Column, width: Column, height: Column, oov: Column, target: int = 64, most: int = 1024) -> DataFrame:
    """Add lengths, steps and ``reason``: foreign characters first, then too few steps; empty if feasible."""
    w = resized_width(width, height, target, most)
    d = df.withColumn("target_length", F.length(text)).withColumn("adjacent_repeats", adjacent_repeats(text)).withColumn("resized_width", w)
    d = d.withColumn("required_timesteps", F.col("target_length") + F.col("adjacent_repeats")).withColumn("available_timesteps", timesteps(F.col("resized_width")))
    reason = F.when(oov, "out_of_vocabulary").when(F.col("available_timesteps") < F.col("required_timesteps"), "insufficient_timesteps").otherwise("")
    return d.withColumn("reason", reason)
