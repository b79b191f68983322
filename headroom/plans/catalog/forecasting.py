"""Forecast and tuning queries. Iterative fits have no SQL equal; their parts are checked where they have."""

from __future__ import annotations

from pyspark.sql import functions as F

from headroom.functions import calendar as C
from headroom.functions.clock import HOUR
from headroom.operators import enrichment as E
from headroom.operators import evaluation, features, ordering, tuning
from headroom.operators.forecast import additive, gram, recurrent
from headroom.operators.forecast.cells import RecurrentParams
from headroom.operators.forecast.frames import floor_zero, prediction_frame
from headroom.operators.forecast.linear import forecast_linear
from headroom.plans import runs
from headroom.plans.catalog import sql as S
from headroom.plans.catalog.calendar import landfalls
from headroom.plans.catalog.common import order_days, rounded
from headroom.plans.traffic import (
    enriched_service_traffic,
    service_predictions,
    service_traffic,
    supplier_series,
    table,
)
from headroom.session import scratch_path, settle
from headroom.sources import results

PARAMS = RecurrentParams()


def services_in_folds(spark, sf_dir, **ratios):
    df = settle(enriched_service_traffic(spark, sf_dir))
    return features.with_fold(df, series=["service"], step=HOUR, **ratios)


def suppliers_in_folds(spark, sf_dir, **ratios):
    """Supplier days with weather columns and folds, written once for the fits that follow."""
    df = supplier_series(spark, sf_dir).withColumn("is_monsoon", C.monsoon_flag(F.col("ds")))
    df = E.with_calendar(E.with_storm_index(df, landfalls(spark)))
    return settle(features.with_fold(df, series=["supplier"], **ratios))


def fourier(spark, sf_dir):
    df = order_days(spark, sf_dir)
    waves = additive.fourier(additive.days_since_epoch(df, "ds"), additive.RECIPE_DESIGN.seasons)
    return rounded(df.select("o_orderkey", *[c.alias(n) for n, c in waves.items()]), waves, 6)


def trend(spark, sf_dir):
    """The trend columns of every order over the span of all orders."""
    df = order_days(spark, sf_dir)
    first, last = (df.agg(edge("ds")).scalar() for edge in (F.min, F.max))
    t = F.datediff("ds", first) / F.datediff(last, first)
    columns = additive.trend_columns(t, F.lit(0.8))
    return rounded(df.select("o_orderkey", *[c.alias(n) for n, c in columns.items()]), columns, 6)


def fit_additive(spark, sf_dir):
    return runs.run_additive(suppliers_in_folds(spark, sf_dir), series=["supplier"])


def fit_recipe(spark, sf_dir):
    return runs.run_recipe(suppliers_in_folds(spark, sf_dir), series=["supplier"])


def fit_first_recipe(spark, sf_dir):
    """The multiplicative recipe on the square root of the target."""
    df = suppliers_in_folds(spark, sf_dir)
    return runs.run_recipe(df, additive.FIRST_RECIPE, features.TRANSFORMS["sqrt"], series=["supplier"], model="first_recipe")


def fit_sarimax(spark, sf_dir):
    return runs.run_seasonal_ar(services_in_folds(spark, sf_dir), series=["service"], step=HOUR)


def fit_pooled(spark, sf_dir):
    """One model over the days of all suppliers."""
    return runs.run_pooled(suppliers_in_folds(spark, sf_dir), "gru", RecurrentParams(epochs=20), series=["supplier"])[1]


def _fit(cell: str):
    def query(spark, sf_dir):
        return runs.run_sequence(services_in_folds(spark, sf_dir), cell, PARAMS, series=["service"], step=HOUR)[1]

    return query


def run_sequence(spark, sf_dir):
    """Metrics of a two-layer model with decay and clipping."""
    params = RecurrentParams(num_layers=2, dropout=0.2, weight_decay=1e-4, gradient_clip=1.0)
    predictions = runs.run_sequence(services_in_folds(spark, sf_dir), "lstm", params, series=["service"], step=HOUR)[1]
    return evaluation.evaluate(predictions, by=["service", "model"])


def model_parameters(spark, sf_dir):
    models, _ = runs.run_sequence(services_in_folds(spark, sf_dir), "gru", PARAMS, series=["service"], step=HOUR)
    return recurrent.parameter_table(models, "gru", PARAMS, series=["service"])


def fit_per_service(spark, sf_dir):
    """Decisions of a whole service run."""
    run = runs.run_services(services_in_folds(spark, sf_dir), pod_budget=14, step=HOUR)
    return run["decisions"]


def recursive(spark, sf_dir):
    """A linear model of the last two values and the last hour, fed with its own results."""
    df = E.with_calendar(settle(service_traffic(spark, sf_dir)))
    placed = ordering.with_position(df, series=["service"], step=HOUR)
    start = F.floor(F.col("n").cast("double") * F.lit(1 - 0.2)).cast("bigint")
    rows = placed.withColumn("start", start)
    weights = {(1, 0): 0.6, (2, 0): 0.3, (1, 1): 0.25}
    out = forecast_linear(rows, weights, 1.0, series=["service"], columns=["y", "hour"])
    return rounded(out.select("service", "ds", F.col("y").alias("predicted")), ["predicted"], 6)


def framed(spark, sf_dir):
    predictions = settle(service_predictions(spark, sf_dir))
    holdout = predictions.select("ds", "service", F.col("actual").alias("y"))
    return prediction_frame(holdout, predictions.select("ds", "service", "predicted"), "naive", keys=["ds", "service"])


def additive_balance(spark, sf_dir):
    """At the least squares of the additive model, what each column still explains equals its penalty: nothing is left over.

    Sums over the training rows, in built-in functions, against the coefficients of the fit; relative to the target's own sum.
    """
    df = suppliers_in_folds(spark, sf_dir).where("fold = 'train'")
    params, design = additive.AdditiveParams(), additive.Design()
    models = additive.fit_additive(df, params, design, series=["supplier"])
    rows = df.withColumns({"_days": additive.days_since_epoch(df, "ds"), "_range": F.lit(params.changepoint_range)}).join(models, "supplier")
    trend, season = additive.columns(design)
    value = F.col("y").cast("double") / F.col("scale")
    left = value - gram.dot(trend, "trend") - gram.dot(season, "season")
    named = [*trend, *season]
    sums = [F.sum(c * left).alias(f"s{i}") for i, c in enumerate(named)] + [F.sum(c * value).alias(f"t{i}") for i, c in enumerate(named)]
    summed = rows.groupBy("supplier").agg(*sums, F.first("trend").alias("trend"), F.first("season").alias("season"), F.first("rows").alias("rows"))
    pull = additive.pulls(params, design)
    places = [F.struct(F.lit(i).alias("place"), F.col(f"s{i}").alias("left"), F.col(f"t{i}").alias("own"), (F.get(F.concat("trend", "season"), F.lit(i)) * p).alias("pull")) for i, p in enumerate(pull)]
    each = summed.select("supplier", F.inline(F.array(*places)))
    # the noise level is one number per series: the penalties of all columns agree on it
    level = each.groupBy("supplier").agg((F.sum(F.col("left") * F.col("pull")) / F.sum(F.col("pull") * F.col("pull"))).alias("level"))
    off = F.abs(F.col("left") - F.col("level") * F.col("pull")) / F.greatest(F.abs("own"), F.lit(1.0))
    return each.join(level, "supplier").select("supplier", "place", F.round(off, 6).alias("left_over"), (F.col("level") >= 0).alias("penalised"))


#: A small network whose weights are given: width 1, two steps, of which the value and the hour's sine matter.
SMALL = RecurrentParams(sequence_length=2, hidden_size=1, epochs=1)
SMALL_WEIGHTS = {
    "gru": {"y": (0.6, -0.4, 0.9), "hour_sin": (0.2, 0.3, -0.5), "past": (0.1, 0.7, -0.3), "ih": (0.05, -0.1, 0.2), "hh": (0.0, 0.15, -0.05)},
    "lstm": {"y": (0.6, -0.4, 0.9, 0.3), "hour_sin": (0.2, 0.3, -0.5, 0.4), "past": (0.1, 0.7, -0.3, 0.2), "ih": (0.05, -0.1, 0.2, 0.1), "hh": (0.0, 0.15, -0.05, 0.3)},
}
SMALL_OUT = (1.1, 0.1)


def small_weights(cell: str) -> list[float]:
    given, gates = SMALL_WEIGHTS[cell], len(SMALL_WEIGHTS[cell]["y"])
    columns = [given.get(name, (0.0,) * gates) for name in ("y", *(c if c == "hour_sin" else "" for c in recurrent.COLUMNS[1:]))]
    inputs = [columns[i][g] for g in range(gates) for i in range(len(columns))]
    return [*inputs, *given["past"], *given["ih"], *given["hh"], *SMALL_OUT]


def _small_forecast(cell: str, stored: bool = False):
    def query(spark, sf_dir):
        """Recursive forecast of every service by the network of given weights, unscaled and floored; ``stored``, by its parameter file."""
        df = services_in_folds(spark, sf_dir)
        rows, scaling = recurrent.prepare(df, series=["service"], step=HOUR)
        weights = F.array(*[F.lit(w) for w in small_weights(cell)])
        models = rows.select("service").distinct().select("service", F.lit(0).alias("trial"), F.lit("COMPLETE").alias("state"), weights.alias("weights"))
        if stored:
            path = results.write_parameters(recurrent.parameter_table(models, cell, SMALL, series=["service"]), scratch_path(spark, "parameters"))
            models = recurrent.models_from_parameters(results.read_parameters(spark, path), cell, SMALL, series=["service"])
        out = recurrent.forecast_recurrent(rows, models, scaling, cell, SMALL, series=["service"])
        return rounded(out.select("service", "ds", "predicted"), ["predicted"], 6)

    return query


def tune_halving(spark, sf_dir):
    """The drawn trials in three rungs; survivors go on from their state."""
    df = services_in_folds(spark, sf_dir, validation_ratio=0.2)
    drawn = tuning.read_trials(tuning.sequence_space(spark), RecurrentParams)
    return tuning.tune_halving(df, "gru", drawn, series=["service"], step=HOUR)


def tune_additive_refit(spark, sf_dir):
    """The best trial of the search fitted to everything before the holdout; its metrics on the holdout, as written."""
    df = suppliers_in_folds(spark, sf_dir, validation_ratio=0.2)
    drawn = tuning.read_trials(tuning.additive_space(spark), additive.AdditiveParams)
    path = scratch_path(spark, "tuned-additive")
    summary = runs.tune_and_refit_additive(df, drawn, path, series=["supplier"])
    return spark.read.parquet(summary["tuned_metrics"]["prediction_path"]).select("supplier", "ds", "actual", "predicted", "model")


def tune_sequence(spark, sf_dir):
    df = services_in_folds(spark, sf_dir, validation_ratio=0.2)
    drawn = tuning.read_trials(tuning.sequence_space(spark), RecurrentParams)
    return tuning.tune_recurrent(df, "gru", drawn, series=["service"], step=HOUR)


def tune_additive(spark, sf_dir):
    df = suppliers_in_folds(spark, sf_dir, validation_ratio=0.2)
    drawn = tuning.read_trials(tuning.additive_space(spark), additive.AdditiveParams)
    return tuning.tune_additive(df, drawn, series=["supplier"])


QUERIES = {
    "fourier": fourier,
    "trend": trend,
    "fit_additive": fit_additive,
    "fit_recipe": fit_recipe,
    "fit_first_recipe": fit_first_recipe,
    "fit_sarimax": fit_sarimax,
    "fit_gru": _fit("gru"),
    "fit_lstm": _fit("lstm"),
    "fit_pooled": fit_pooled,
    "run_sequence": run_sequence,
    "model_parameters": model_parameters,
    "fit_per_service": fit_per_service,
    "recursive_forecast": recursive,
    "floor_zero": lambda spark, sf: table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", floor_zero(F.col("l_quantity") - 25).alias("predicted")
    ),
    "prediction_frame": framed,
    "additive_balance": additive_balance,
    "gru_forecast": _small_forecast("gru"),
    "lstm_forecast": _small_forecast("lstm"),
    "stored_gru_forecast": _small_forecast("gru", stored=True),
    "stored_lstm_forecast": _small_forecast("lstm", stored=True),
    "tune_sequence": tune_sequence,
    "tune_halving": tune_halving,
    "tune_additive_refit": tune_additive_refit,
    "tune_additive": tune_additive,
}

# --- SQL checks -----------------------------------------------------------------

def _gate(cell: str, gate: int, y: str, hour: str, past: str | None) -> str:
    given = SMALL_WEIGHTS[cell]
    terms = f"{S.number(given['y'][gate])} * {y} + {S.number(given['hour_sin'][gate])} * {hour} + {S.number(given['ih'][gate])}"
    if past is None:
        return terms
    return f"{terms} + {S.number(given['past'][gate])} * {past} + {S.number(given['hh'][gate])}"


def _logistic(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def _small_step(cell: str, y: str, hour: str, h: str, c: str) -> tuple[str, str]:
    """State after a step, as SQL; the state before is given as SQL of columns."""
    if cell == "gru":
        past = f"({S.number(SMALL_WEIGHTS[cell]['past'][2])} * {h} + {S.number(SMALL_WEIGHTS[cell]['hh'][2])})"
        reset, keep = (_logistic(_gate(cell, g, y, hour, h)) for g in (0, 1))
        new = f"tanh({_gate(cell, 2, y, hour, None)} + {reset} * {past})"
        return f"(1 - {keep}) * {new} + {keep} * {h}", "0"
    enter, forget, leave = (_logistic(_gate(cell, g, y, hour, h)) for g in (0, 1, 3))
    held = f"{forget} * {c} + {enter} * tanh({_gate(cell, 2, y, hour, h)})"
    return f"{leave} * tanh({held})", held


def _small_sql(cell: str) -> str:
    """Rows are scaled by the training rows; a step looks at the two rows before, whose values it may have made itself."""
    h1, c1 = _small_step(cell, "w.y2", "a.wave", "0", "0")
    h2, _ = _small_step(cell, "w.y1", "b.wave", "s.h", "s.c")
    return f"""WITH RECURSIVE {S.TRAFFIC}, placed AS (
          SELECT service, ds, y, sin(2 * pi() * hour(ds) / 24) AS hour_sin, row_number() OVER w AS rn,
            CAST(floor(CAST(count(*) OVER (PARTITION BY service) AS DOUBLE) * {S.number(1 - 0.2)}) AS BIGINT) AS start
          FROM traffic WINDOW w AS (PARTITION BY service ORDER BY ds)),
        scales AS (
          SELECT service, avg(y) AS y_mean, CASE WHEN stddev_pop(y) = 0 THEN 1 ELSE stddev_pop(y) END AS y_std,
            avg(hour_sin) AS s_mean, CASE WHEN stddev_pop(hour_sin) = 0 THEN 1 ELSE stddev_pop(hour_sin) END AS s_std
          FROM placed WHERE rn <= start GROUP BY 1),
        scaled AS (
          SELECT p.service, ds, rn, start, (y - y_mean) / y_std AS y, (hour_sin - s_mean) / s_std AS wave FROM placed p JOIN scales USING (service)),
        walk AS (
          SELECT a.service, a.rn + 1 AS rn, a.y AS y2, b.y AS y1 FROM scaled a JOIN scaled b ON a.service = b.service AND b.rn = a.rn + 1 WHERE b.rn = b.start
          UNION ALL
          SELECT s.service, s.rn + 1, s.y1, {S.number(SMALL_OUT[0])} * ({h2}) + {S.number(SMALL_OUT[1])}
          FROM (SELECT w.service, w.rn, w.y1, {h1} AS h, {c1} AS c FROM walk w JOIN scaled a ON a.service = w.service AND a.rn = w.rn - 1) s
          JOIN walk w ON w.service = s.service AND w.rn = s.rn JOIN scaled b ON b.service = s.service AND b.rn = s.rn
          JOIN scaled next ON next.service = s.service AND next.rn = s.rn + 1)
        SELECT q.service, q.ds, {S.rounded('greatest(w.y1 * y_std + y_mean, 0)', 6)} AS predicted
        FROM walk w JOIN scaled q ON q.service = w.service AND q.rn = w.rn JOIN scales c ON c.service = w.service WHERE q.rn > q.start"""


_DAYS = "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE)"

ORACLE = {
    "fourier": "SELECT o_orderkey, "
    + ", ".join(
        f"{S.rounded(f'{fn}(2 * pi() * {j} / {S.number(period)} * {_DAYS})', 6)} AS {name}_{fn}_{j}"
        for name, (period, order) in additive.RECIPE_DESIGN.seasons.items()
        for j in range(1, order + 1)
        for fn in ("sin", "cos")
    )
    + " FROM orders",
    "trend": f"""WITH placed AS (SELECT o_orderkey, date_diff('day', (SELECT min(o_orderdate) FROM orders), o_orderdate)
          / CAST(date_diff('day', (SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders)) AS DOUBLE) AS t FROM orders)
        SELECT o_orderkey, {S.rounded('CAST(1 AS DOUBLE)', 6)} AS constant, {S.rounded('t', 6)} AS slope, """
    + ", ".join(f"{S.rounded(f'greatest(t - {S.number(0.8)} * {j} / 25, 0)', 6)} AS hinge_{j}" for j in range(1, 26))
    + " FROM placed",
    "recursive_forecast": f"""WITH RECURSIVE {S.TRAFFIC}, placed AS (
          SELECT service, ds, y, CAST(hour(ds) AS DOUBLE) AS hour, row_number() OVER w AS rn, lag(y) OVER w AS y2,
            floor(CAST(count(*) OVER (PARTITION BY service) AS DOUBLE) * {S.number(1 - 0.2)}) AS start
          FROM traffic WINDOW w AS (PARTITION BY service ORDER BY ds)),
        walk AS (
          SELECT service, rn, y, y2 FROM placed WHERE rn = start
          UNION ALL
          SELECT w.service, w.rn + 1, 1.0::DOUBLE + 0.6::DOUBLE * w.y + 0.3::DOUBLE * w.y2 + 0.25::DOUBLE * p.hour, w.y
          FROM walk w JOIN placed p ON p.service = w.service AND p.rn = w.rn JOIN placed q ON q.service = w.service AND q.rn = w.rn + 1)
        SELECT p.service, p.ds, {S.rounded('w.y', 6)} AS predicted
        FROM walk w JOIN placed p ON p.service = w.service AND p.rn = w.rn WHERE p.rn > p.start""",
    "additive_balance": f"""WITH days AS (SELECT DISTINCT l_suppkey AS supplier FROM lineitem)
        SELECT supplier, CAST(unnest(range({2 + additive.CHANGEPOINTS + additive.Design().waves + len(additive.Design().regressors)})) AS INTEGER) AS place,
          CAST(0 AS DOUBLE) AS left_over, TRUE AS penalised FROM days""",
    "gru_forecast": _small_sql("gru"),
    "lstm_forecast": _small_sql("lstm"),
    "stored_gru_forecast": _small_sql("gru"),
    "stored_lstm_forecast": _small_sql("lstm"),
    "floor_zero": "SELECT l_orderkey, l_linenumber, greatest(l_quantity - 25, 0) AS predicted FROM lineitem",
    "prediction_frame": f"""WITH {S.PREDICTIONS} SELECT ds, service, actual, predicted, {S.default_pods('actual')} AS actual_pods,
        {S.default_pods('predicted')} AS predicted_pods, 'naive' AS model FROM predictions""",
}
