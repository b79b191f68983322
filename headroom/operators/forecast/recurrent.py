"""Recurrent regressors, one per series and trial, trained in parallel.

Series that fit a task are trained there, all series and trials side by side. Longer
series are trained with their rows spread over the tasks of a barrier stage: every
chunk adds up the gradient of its own sequences and all tasks exchange the sums, exact because the loss is a sum over
sequences. Batches, dropout and first weights are drawn by hash from seed, epoch and row, so training
takes the same steps either way; only the place where a gradient is summed differs.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headroom import fixed_values as fixed
from headroom.operators import features, ordering
from headroom.operators.forecast import balance, batched, cells
from headroom.operators.forecast.cells import RecurrentParams
from headroom.operators.forecast.recursion import ROWS_PER_ROUND, forecast_together
from headroom.session import settle

COLUMNS = ["y", *fixed.MODEL_FEATURES]
ROWS_PER_MODEL = 500_000
NUMBERS_HELD = 4_000_000  # of the series that a task stacks at a time
MODEL_FIELDS = "trial int, state string, error string, weights array<double>"
STATE_FIELDS = f"{MODEL_FIELDS}, first array<double>, second array<double>, step bigint, epoch int"
_MOMENTS = ["first", "second", "step", "epoch"]

Trials = Mapping[int, RecurrentParams] | RecurrentParams


def as_trials(trials: Trials) -> dict[int, RecurrentParams]:
    return {0: trials} if isinstance(trials, RecurrentParams) else dict(trials)


def prepare(
    df: DataFrame,
    *,
    series: Sequence[str],
    order: str = "ds",
    step: int | None = None,
    fold: str = "fold",
) -> tuple[DataFrame, DataFrame]:
    """Scaled model columns with ``rn`` and ``start`` (the training rows of the series), and the scaling.

    Rows labelled ``train`` are known, the rest is to be forecast; the scaling is that of
    the training rows. The result is written once: training and forecasting both read it.
    """
    series = list(series)
    featured = features.add_cyclic_features(df).select(
        *series, order, fold, *[F.col(c).cast("double").alias(c) for c in COLUMNS]
    )
    placed = settle(ordering.with_position(featured, series=series, order=order, step=step))
    params = features.scaling_params(placed.withColumnRenamed(fold, "fold"), COLUMNS, series=series)
    known = settle(placed.groupBy(*series).agg(F.count_if(F.col(fold) == "train").cast("bigint").alias("start")))
    scaled = features.scale(placed.join(known, series), params, COLUMNS, series=series)
    return scaled.select(*series, order, "rn", "start", *COLUMNS), params


def _per_trial(df: DataFrame, trials: Mapping[int, RecurrentParams]) -> DataFrame:
    return df.withColumn("trial", F.explode(F.array(*[F.lit(int(t)) for t in trials])))


def _seed(seed: int, trial: int, key: Sequence) -> int:
    """A seed per series and trial, the same wherever the group runs."""
    text = "|".join(str(part) for part in key)
    return (seed + trial) * 1_000_003 + sum((i + 1) * ord(c) for i, c in enumerate(text))


def _failed(problem: object) -> dict:
    return {"state": "FAIL", "error": str(problem), "weights": None} | dict.fromkeys(_MOMENTS)


def _finished(state: batched.State, i: int, keep_state: bool) -> dict:
    if not np.isfinite(state.weights[i]).all():
        return _failed("training diverged")
    out = {"state": "COMPLETE", "error": None, "weights": state.weights[i].tolist()} | dict.fromkeys(_MOMENTS)
    if keep_state:
        out |= {"first": state.first[i].tolist(), "second": state.second[i].tolist(), "step": int(state.step[i]), "epoch": state.epoch}
    return out


def _begun(states: Sequence[Mapping]) -> batched.State | None:
    """Models that were trained for some epochs, to be trained on; None from the start."""
    if states[0]["weights"] is None:
        return None
    own = [np.stack([np.asarray(s[name], dtype=float) for s in states]) for name in ("weights", "first", "second")]
    return batched.State(*own, np.array([s["step"] for s in states], np.int64), int(states[0]["epoch"]))


def _trained(cell: str, params: RecurrentParams, members: list[tuple], until: int, seed: int, keep_state: bool) -> list[dict]:
    """One result per member ``(key, values, job)``, all of one trial, as one tensor; a failure is a result."""
    ready = [i for i, (_, values, _) in enumerate(members) if len(values) > params.sequence_length]
    results = [_failed("a series needs more rows than a sequence")] * len(members)
    ready.sort(key=lambda i: len(members[i][1]))
    most = max(1, batched.BLOCK_NUMBERS // (params.sequence_length * params.hidden_size * cells.GATES[cell] * params.num_layers * 64))
    for at in range(0, len(ready), most):
        some = ready[at : at + most]
        seeds = [_seed(seed, int(members[i][2]["trial"]), members[i][0]) for i in some]
        try:
            state = batched.train(cell, [members[i][1] for i in some], params, seeds, _begun([members[i][2] for i in some]), until)
            found = [_finished(state, i, keep_state) for i in range(len(some))]
        except Exception as problem:  # a failed trial is a result, not the end of the search
            found = [_failed(problem)] * len(some)
        for i, result in zip(some, found):
            results[i] = result
    return results


def _bin_trainer(cell: str, trials: dict[int, RecurrentParams], until: Mapping[int, int], series: list[str], seed: int, keep_state: bool):
    """Trains the units of a bin. Rows come by series and position; some series at a time are held and stacked per trial.

    The first row of a series says which trials the bin has of it, and from which state they go on.
    """

    def train(frames):
        held, size, open_key, pieces, wanted = [], 0, None, [], None
        names = [*series, "trial", "state", "error", "weights", *_MOMENTS]

        def close():
            nonlocal size, pieces
            if open_key is not None:
                values = np.concatenate(pieces)
                held.append((open_key, values, wanted))
                size, pieces = size + values.size, []

        def work():
            out = []
            for trial in sorted({t for _, _, own in held for t in own}):
                members = [(key, values, own[trial]) for key, values, own in held if trial in own]
                for (key, _, _), result in zip(members, _trained(cell, trials[trial], members, until[trial], seed, keep_state)):
                    out.append(dict(zip(series, key)) | {"trial": trial} | result)
            held.clear()
            return pd.DataFrame(out, columns=names)

        for frame in frames:
            frame = frame.reset_index(drop=True)
            keys = frame[series]
            same = (keys == keys.shift()) | (keys.isna() & keys.shift().isna())
            starts = np.flatnonzero(~same.all(axis=1).to_numpy() | (np.arange(len(keys)) == 0))
            numbers = frame[COLUMNS].to_numpy(dtype=float)
            for begin, end in zip(starts, [*starts[1:], len(frame)]):
                key = tuple(keys.iloc[begin])
                if key != open_key:
                    close()
                    if size >= NUMBERS_HELD:
                        yield work()
                        size = 0
                    open_key, wanted = key, {int(job["trial"]): job for job in frame["jobs"].iloc[begin]}
                pieces.append(numbers[begin:end])
        close()
        if held:
            yield work()

    return train


def _state_schema(df: DataFrame, series: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[c] for c in series] + T.StructType.fromDDL(STATE_FIELDS).fields)


def fit_recurrent(
    rows: DataFrame,
    cell: str,
    trials: Trials = RecurrentParams(),
    *,
    series: Sequence[str],
    seed: int = 42,
    rows_per_model: int = ROWS_PER_MODEL,
    states: DataFrame | None = None,
    until: Mapping[int, int] | None = None,
    keep_state: bool = False,
) -> DataFrame:
    """One model row per series and trial from the training rows of ``prepare``.

    Series and trials are dealt to tasks by what they cost; in a task, series of one trial train as one tensor.
    A trial that cannot be trained gives a row with ``state`` FAIL and its ``error``.

    With ``keep_state`` rows hold the state of the optimiser as well (``first, second, step, epoch``), and training may stop
    after ``until`` epochs of a trial. ``states``, such rows of an earlier call, names the models that go on, and no others.
    """
    if cell not in cells.GATES:
        raise ValueError(f"no such recurrent cell: {cell}")
    trials, series = as_trials(trials), list(series)
    until = {t: p.epochs for t, p in trials.items()} | dict(until or {})
    known = rows.where(F.col("rn") <= F.col("start")).select(*series, "rn", "start", *COLUMNS)
    longest = known.agg(F.max("start")).first()[0] or 0
    short = known if longest <= rows_per_model else known.where(F.col("start") <= rows_per_model)
    schema, kept = _state_schema(known, series), [*series, "trial", "state", "error", "weights", *(_MOMENTS if keep_state else [])]
    lengths = short.groupBy(*series).agg(F.max("start").alias("start"))
    units, bins = balance.with_bins(lengths, trials, cell, len(COLUMNS), series=series, among=states)
    fields = ["weights", *_MOMENTS]
    if states is None:
        jobs = units.select("*", *[F.lit(None).cast(schema[c].dataType).alias(c) for c in fields])
    else:
        jobs = units.join(states.select(*series, "trial", *fields), [*series, "trial"])
    jobs = jobs.groupBy(*series, "bin").agg(F.collect_list(F.struct("trial", *fields)).alias("jobs"))
    first = F.col("rn") == 1
    begin = short.where(first).join(jobs, series)
    rest = short.where(~first).join(units.select(*series, "bin").distinct(), series)
    dealt = begin.unionByName(rest, allowMissingColumns=True).drop("start").repartitionById(bins, F.col("bin")).sortWithinPartitions(*series, "rn")
    models = dealt.mapInPandas(_bin_trainer(cell, trials, until, series, seed, keep_state), schema).select(*kept)
    if longest <= rows_per_model:
        return models
    long = known.where(F.col("start") > rows_per_model)
    for trial, params in trials.items():
        own = None if states is None else states.where(F.col("trial") == trial)
        found = fit_long_series(
            long, cell, params, series=series, trial=trial, seed=seed, rows_per_task=rows_per_model, states=own, until=until[trial], keep_state=keep_state
        )
        models = models.unionByName(found.select(*kept))
    return models


SERIES_PER_JOB = 8  # long series that train side by side: the tasks hold the state of all of them
MESSAGE_BYTES = 48_000_000  # of the gradients that all tasks of a step exchange
EPOCHS_PER_JOB = 10  # after which the state is handed back, so that a lost executor costs no more


def _exchanged(context, slopes: dict[int, tuple[np.ndarray, int]], size: int) -> dict[int, tuple[np.ndarray, int]]:
    """Sums over all tasks of gradients and of the sequences behind them, added in the order of the tasks."""
    message = {i: (base64.b64encode(slope.tobytes()).decode(), seen) for i, (slope, seen) in slopes.items()}
    total: dict[int, tuple[np.ndarray, int]] = {}
    for text in context.allGather(json.dumps(message)):
        for name, (packed, seen) in json.loads(text).items():
            slope, before = total.get(int(name), (np.zeros(size), 0))
            total[int(name)] = (slope + np.frombuffer(base64.b64decode(packed)), before + seen)
    return total


def _all_reduce_trainer(cell: str, params: RecurrentParams, series: list[str], shared, epochs: int):
    """Every task keeps its chunks, adds up their gradients and takes the same steps as all others; the first hands on the state."""

    def train(frames):
        context = BarrierTaskContext.get()
        keys, seeds, sequences, state = shared.value
        place = {key: i for i, key in enumerate(keys)}
        rows = [frame for frame in frames if len(frame)]
        stacks = []
        if rows:
            held = pd.concat(rows, ignore_index=True)
            for key, part in held.groupby([*series, "_chunk"], sort=True, dropna=False):
                part = part.sort_values("rn")
                if len(part) > params.sequence_length:
                    stack = batched.Stack([part[COLUMNS].to_numpy(dtype=float)], params, [int(part["rn"].iloc[0])])
                    stacks.append((place[tuple(part[series].iloc[0])], stack))
            del rows, held
        size = state.weights.shape[1]
        for epoch in range(state.epoch, epochs):
            batches = [cells.batch_of(stack.rows[0], sequences[i], params, seeds[i], epoch) for i, stack in stacks]
            for batch in range(max(cells.batch_count(n, params) if n else 0 for n in sequences)):
                slopes: dict[int, tuple[np.ndarray, int]] = {}
                for (i, stack), own in zip(stacks, batches):
                    chosen = np.flatnonzero(own == batch)
                    if len(chosen):
                        slope, seen = slopes.get(i, (np.zeros(size), 0))
                        more = stack.gradients(cell, state.weights[i : i + 1], [chosen], [seeds[i]], epoch)[0]
                        slopes[i] = (slope + more, seen + len(chosen))
                summed = _exchanged(context, slopes, size)
                at = np.array(sorted(summed), np.int64)
                if len(at):
                    batched.step(state, at, np.stack([summed[i][0] / summed[i][1] for i in at]), params)
            state.epoch = epoch + 1
        if context.partitionId() == 0:
            packed = [[getattr(state, name)[i].tobytes() for i in range(len(keys))] for name in ("weights", "first", "second")]
            yield pd.DataFrame({"place": range(len(keys)), "weights": packed[0], "first": packed[1], "second": packed[2], "step": state.step})

    return train


def fit_long_series(
    rows: DataFrame,
    cell: str,
    params: RecurrentParams,
    *,
    series: Sequence[str],
    trial: int = 0,
    seed: int = 42,
    rows_per_task: int = ROWS_PER_MODEL,
    epochs_per_job: int = EPOCHS_PER_JOB,
    states: DataFrame | None = None,
    until: int | None = None,
    keep_state: bool = False,
) -> DataFrame:
    """Train on series longer than a task should hold, in the steps ``cells.train`` takes.

    The chunks of the series stay in the tasks of a barrier stage, which exchange summed gradients after every
    batch, so a job covers several epochs and no step writes a table. The state between jobs is small: it
    depends on the parameters and on some series at a time. A model whose numbers are no longer finite, or whose
    series has no whole sequence, is a failed trial. The cluster must not allocate executors dynamically, which barriers rule out.
    """
    series, length, spark = list(series), params.sequence_length, rows.sparkSession
    last = params.epochs if until is None else until
    if states is not None:
        rows = rows.join(states.select(*series), series, "left_semi")
    groups = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in series]), F.lit(max(1, -(-rows.select(*series).distinct().count() // SERIES_PER_JOB))))
    haloed = ordering.haloed(rows.select(*series, "rn", *COLUMNS), before=length, rows=rows_per_task)
    chunked = settle(haloed.drop("_own").withColumn("_group", groups.cast("int")))
    sizes = settle(rows.groupBy(*series).agg(F.count(F.lit(1)).alias("rows")).withColumn("_group", groups.cast("int")))
    found = []
    for (group,) in sizes.select("_group").distinct().orderBy("_group").collect():
        members = sizes.where(F.col("_group") == group).orderBy(*series).collect()  # some series
        keys = [tuple(row[c] for c in series) for row in members]
        sequences = [max(0, row["rows"] - length) for row in members]
        seeds = [_seed(seed, trial, key) for key in keys]
        state = batched.start(cell, len(COLUMNS), params, seeds)
        if states is not None:
            mine = states.join(sizes.where(F.col("_group") == group).select(*series), series, "left_semi").collect()
            by_key = {tuple(row[c] for c in series): row for row in mine}
            state = _begun([by_key[key] for key in keys])
        message = 11 * state.weights.shape[1] * len(keys)
        chunks = sum(-(-row["rows"] // rows_per_task) for row in members)
        tasks = max(1, min(chunks, spark.sparkContext.defaultParallelism, MESSAGE_BYTES // message))
        own = chunked.where(F.col("_group") == group).drop("_group")
        own = own.repartitionById(tasks, F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in series]) + F.col("_chunk"), F.lit(tasks)).cast("int"))
        while state.epoch < last and any(sequences):
            stop = min(last, state.epoch + epochs_per_job)
            shared = spark.sparkContext.broadcast((keys, seeds, sequences, state))
            trainer = _all_reduce_trainer(cell, params, series, shared, stop)
            after = own.mapInPandas(trainer, "place int, weights binary, first binary, second binary, step long", barrier=True).collect()
            after.sort(key=lambda row: row["place"])
            packed = [np.stack([np.frombuffer(row[name]) for row in after]) for name in ("weights", "first", "second")]
            state = batched.State(*[p.copy() for p in packed], np.array([row["step"] for row in after]), stop)
            shared.destroy()
        for i, (key, n) in enumerate(zip(keys, sequences)):
            result = _finished(state, i, keep_state) if n else _failed("a series needs more rows than a sequence")
            found.append((*key, int(trial), *result.values()))
    return spark.createDataFrame(found, _state_schema(rows, series)).select(*series, "trial", "state", "error", "weights", *(_MOMENTS if keep_state else []))


def _advancer(cell: str, trials: dict[int, RecurrentParams]):
    """All series of a group, which share a trial, one row further."""

    def of(models: pd.DataFrame):
        params = trials[int(models["trial"].iloc[0])]
        weights = np.stack([np.asarray(w, dtype=float) for w in models["weights"]])

        def advance(past: np.ndarray, own: np.ndarray) -> np.ndarray:
            return batched.predicted(cell, weights, past[:, None], params)

        return params.sequence_length, advance

    return of


def forecast_recurrent(
    rows: DataFrame,
    models: DataFrame,
    params: DataFrame,
    cell: str,
    trials: Trials = RecurrentParams(),
    *,
    series: Sequence[str],
    order: str = "ds",
    rows_per_round: int = ROWS_PER_ROUND,
) -> DataFrame:
    """Recursive forecast of the rows after the training rows, unscaled and floored at 0, per trial."""
    trials, series = as_trials(trials), list(series)
    usable = models.where(F.col("state") == "COMPLETE").select(*series, "trial", "weights")
    raw = forecast_together(
        _per_trial(rows, trials),
        usable,
        _advancer(cell, trials),
        series=[*series, "trial"],
        apart=["trial"],
        columns=COLUMNS,
        length=max(p.sequence_length for p in trials.values()),
        order=order,
        rows_per_round=rows_per_round,
    )
    back = features.unscale(raw, params, "y", series=series)
    return back.select(*series, "trial", order, F.greatest("y", F.lit(0.0)).alias("predicted"))


def parameter_table(models: DataFrame, cell: str, trials: Trials, *, series: Sequence[str]) -> DataFrame:
    """Model weights as rows: parameter name, shape and values."""
    entries = F
    for trial, params in as_trials(trials).items():
        at, parts = 1, []
        for name, shape in cells.layout(cell, len(COLUMNS), params):
            size = int(np.prod(shape))
            parts.append(
                F.struct(
                    F.lit(name).alias("param"),
                    F.array(*[F.lit(int(n)) for n in shape]).alias("shape"),
                    F.slice("weights", at, size).alias("values"),
                )
            )
            at += size
        entries = entries.when(F.col("trial") == trial, F.array(*parts))
    done = models.where(F.col("state") == "COMPLETE")
    return done.select(*series, "trial", F.inline(entries.otherwise(F.lit(None))))


def models_from_parameters(table: DataFrame, cell: str, trials: Trials, *, series: Sequence[str]) -> DataFrame:
    """Model rows from a parameter table."""
    names = [name for name, _ in cells.layout(cell, len(COLUMNS), max(as_trials(trials).values(), key=lambda p: p.num_layers))]
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("param"))
    packed = F.sort_array(F.collect_list(F.struct(place.alias("at"), F.col("values").alias("values"))))
    return table.groupBy(*series, "trial").agg(
        F.lit("COMPLETE").alias("state"),
        F.lit(None).cast("string").alias("error"),
        F.flatten(F.transform(packed, lambda e: e["values"])).alias("weights"),
    )


def params_row(params: RecurrentParams) -> dict:
    return asdict(params)
