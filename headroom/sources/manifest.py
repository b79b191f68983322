"""Runs that become visible as a whole: outputs go into a folder of their own, a manifest names it last and is read first."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

MANIFESTS = "_manifests"


@dataclass
class Run:
    """A run being written: its ``folder``, and the ``record`` that the manifest will hold."""

    folder: str
    record: dict[str, object] = field(default_factory=dict)


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _numbers(spark: SparkSession, path: str) -> list[str]:
    place, store, _ = _store(spark, f"{path}/{MANIFESTS}")
    if not store.exists(place):
        return []
    return sorted(name for s in store.listStatus(place) if (name := s.getPath().getName()).endswith(".json"))


@contextmanager
def publish(spark: SparkSession, path: str) -> Iterator[Run]:
    """Write the outputs of a run into ``folder``; readers see them when the block has ended without an error.

    The manifest is written beside its place and renamed, which shows it whole or not at all. A run that fails
    leaves an unnamed folder behind, and readers go on with the run before.
    """
    run = Run(f"{path}/_runs/{uuid.uuid4().hex}")
    yield run
    before = _numbers(spark, path)
    number = int(before[-1].split("-")[0]) + 1 if before else 1
    name = f"{number:09d}-{uuid.uuid4().hex}.json"
    draft, store, jvm = _store(spark, f"{path}/{MANIFESTS}/_{name}.draft")
    out = store.create(draft, False)
    out.write(bytearray(json.dumps({"folder": run.folder, "record": run.record}, ensure_ascii=False, default=str).encode()))
    out.close()
    if not store.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFESTS}/{name}")):
        raise OSError(f"the manifest of {run.folder} could not be put in place")


def current(spark: SparkSession, path: str) -> Run:
    """The run that was published last."""
    names = _numbers(spark, path)
    if not names:
        raise FileNotFoundError(f"no run was published under {path}")
    text = spark.read.text(f"{path}/{MANIFESTS}/{names[-1]}", wholetext=True).first()["value"]
    return Run(**json.loads(text))
