from __future__ import annotations

import os
import subprocess
import sys
import textwrap
from types import SimpleNamespace

import pytest

from headroom import session


def _without_folder(master):
    nothing = SimpleNamespace(isDefined=lambda: False)
    made = []
    context = SimpleNamespace(
        master=master,
        _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing)),
        getConf=lambda: SimpleNamespace(get=lambda name: None),
        setCheckpointDir=made.append,
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default)), made


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_clusters_have_to_name_a_shared_folder(master):
    spark, made = _without_folder(master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(spark)
    assert made == []


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_one_machine_gets_its_own(master):
    spark, made = _without_folder(master)
    session.ensure_checkpoint_dir(spark)
    assert len(made) == 1


def test_written_tables_go_with_the_session(tmp_path):
    code = f"""
        from pyspark.sql import SparkSession
        from headroom.session import settle
        spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
        rows = settle(spark.range(10).repartition(2))
        assert rows.count() == 10 and rows.count() == 10
        print("rows", len(list(__import__("pathlib").Path("{tmp_path}").rglob("*.parquet"))))
    """
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, env=env, timeout=240)
    assert "rows 2" in done.stdout, done.stderr[-2000:]
    assert list(tmp_path.rglob("*.parquet")) == []
