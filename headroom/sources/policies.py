"""Configuration as JSON: a map from service to its policy, and parameters of a model."""

from __future__ import annotations

import json
from dataclasses import asdict, fields
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom import schemas
from headroom.operators.sizing import DEFAULT_SERVICE_POLICIES, Policies, ServicePolicy, policy_frame

Params = TypeVar("Params")


def policy_rows(spark: SparkSession, path: str) -> DataFrame:
    """The policies of a JSON file, one row per service."""
    fields_ddl = ", ".join(f"{name}: {kind}" for name, kind in (part.split() for part in schemas.POLICY.split(",")))
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", f"map<string, struct<{fields_ddl}>>")).alias("service", "p"))
    return parsed.select("service", "p.*")


def load_service_policies(spark: SparkSession, path: str | None = None) -> dict[str, ServicePolicy]:
    """Policies from a JSON file, or the defaults; values that break a rule are an error."""
    if path is None:
        return dict(DEFAULT_SERVICE_POLICIES)
    try:
        rows = policy_rows(spark, path).collect()  # configuration: one row per service
    except AnalysisException as missing:
        raise FileNotFoundError(f"{path} does not exist") from missing
    names = [f.name for f in fields(ServicePolicy)]
    for row in rows:
        absent = [name for name in names if row[name] is None]
        if absent:
            raise schemas.TableError(f"{path}: policy of {row['service']} lacks {absent}")
    return {row["service"]: ServicePolicy(**{name: row[name] for name in names}) for row in rows}


def policies_json(spark: SparkSession, policies: Policies = DEFAULT_SERVICE_POLICIES) -> DataFrame:
    """One row with the JSON text ``load_service_policies`` reads."""
    names = [f.name for f in fields(ServicePolicy)]
    entry = F.struct("service", F.struct(*names))
    table = policy_frame(spark, policies)
    return table.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))


def write_service_policies(spark: SparkSession, path: str, policies: Policies = DEFAULT_SERVICE_POLICIES) -> str:
    policies_json(spark, policies).write.mode("overwrite").text(path)
    return path


def load_params(spark: SparkSession, kind: type[Params], path: str | None = None) -> Params:
    """Parameters of a model (``AdditiveParams``, ``RecurrentParams``) from a JSON object; what it does not name keeps its default.

    Names the model does not know and values of another type are an error. Parameters written by a search can be read back.
    """
    if path is None:
        return kind()
    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException as missing:
        raise FileNotFoundError(f"{path} does not exist") from missing
    given = json.loads(text["value"]) if text else None
    if not isinstance(given, dict):
        raise schemas.TableError(f"{path} holds no JSON object")
    defaults = asdict(kind())
    if unknown := sorted(set(given) - set(defaults)):
        raise schemas.TableError(f"{path}: {kind.__name__} has no {unknown}")
    values = {}
    for name, value in given.items():
        wanted = type(defaults[name])
        if wanted is float and type(value) is int:
            value = float(value)
        if type(value) is not wanted:
            raise schemas.TableError(f"{path}: {name} has to be of type {wanted.__name__}")
        values[name] = value
    return kind(**values)
