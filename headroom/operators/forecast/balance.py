"""Which task trains which models: costs known beforehand, longest first, each to the lightest task.

The cost of a recurrent model follows from its rows and parameters. Units (a series and a trial) are sorted by
cost and dealt to the bin with the least so far; cheap units of one trial stay together, so that they can be trained as one tensor.
Very many units are dealt in shards, each of which fills all bins evenly by itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.operators.forecast.cells import GATES, RecurrentParams
from headroom.session import settle

UNITS_PER_SHARD = 1_000_000
COST_PER_BIN = 1e13  # some minutes; larger searches have more bins, so that a lost task is little work
TOGETHER = 4  # cheap units of one trial fill up to a quarter of a bin together
# measured: work beside the products, in multiplications a unit of width, and of a call per step over time
_PER_WIDTH, _PER_CALL = 700, 2e6


def cost_per_row(params: RecurrentParams, cell: str, inputs: int) -> float:
    """Multiplications and additions per row of a series over all epochs, forward and back."""
    per_step = sum(
        6 * GATES[cell] * params.hidden_size * ((params.hidden_size if layer else inputs) + params.hidden_size) + _PER_WIDTH * params.hidden_size
        for layer in range(params.num_layers)
    )
    return float(params.epochs * params.sequence_length * per_step)


def _costs(trials: Mapping[int, RecurrentParams], cell: str, inputs: int) -> Column:
    """An array of ``trial, cost`` for a series of ``start`` rows."""
    rows = F.col("start").cast("double")
    entries = []
    for trial, params in trials.items():
        batches = F.ceil(rows / params.batch_size) if params.batch_size else F.lit(1)
        calls = F.lit(_PER_CALL * params.epochs * params.sequence_length * params.num_layers) * batches
        entries.append(F.struct(F.lit(int(trial)).alias("trial"), (rows * cost_per_row(params, cell, inputs) + calls).alias("cost")))
    return F.array(*entries)


def _dealer(bins: int, target: float):
    """Deals units, which come with falling cost, to the bin that is lightest so far."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads, shift, group = None, 0, None
        for frame in frames:
            if frame.empty:
                continue
            if loads is None:  # shards begin with different bins
                shift = int(frame["shard"].iloc[0]) % bins
                loads = [(0.0, i) for i in range(bins)]
            out = []
            for trial, cost in zip(frame["trial"], frame["cost"]):
                if group is not None and group[0] == trial and group[2] + cost <= target / TOGETHER:
                    group[2] += cost
                else:
                    if group is not None:
                        heapq.heappush(loads, (group[3] + group[2], group[1]))
                    load, place = heapq.heappop(loads)
                    group = [trial, place, cost, load]
                out.append((group[1] + shift) % bins)
            yield frame.drop(columns=["shard"]).assign(bin=out)

    return deal


def with_bins(
    lengths: DataFrame, trials: Mapping[int, RecurrentParams], cell: str, inputs: int, *, series: Sequence[str], among: DataFrame | None = None
) -> tuple[DataFrame, int]:
    """``series, trial, cost, bin`` of all units, written, and the number of bins.

    ``lengths`` has ``start`` rows per series; ``among`` may name the series and trials that count.
    """
    series = list(series)
    units = lengths.select(*series, F.inline(_costs(trials, cell, inputs)))
    units = settle(units if among is None else units.join(among.select(*series, "trial"), [*series, "trial"], "left_semi"))
    known = units.agg(F.count(F.lit(1)).alias("units"), F.sum("cost").alias("total")).first()
    total = known["total"] or 1.0
    cores = lengths.sparkSession.sparkContext.defaultParallelism
    bins = max(1, min(known["units"], max(2 * cores, int(total / COST_PER_BIN))))
    shards = 1 + known["units"] // UNITS_PER_SHARD
    shard = F.pmod(F.xxhash64(*series, "trial"), F.lit(shards)).cast("int")
    sharded = units.withColumn("shard", shard).repartitionById(shards, F.col("shard"))
    ordered = sharded.sortWithinPartitions(F.desc("cost"), "trial", *series)
    fields = ", ".join(f"`{c}` {lengths.schema[c].dataType.simpleString()}" for c in series)
    return settle(ordered.mapInPandas(_dealer(bins, total / bins), f"{fields}, trial int, cost double, bin int")), bins
