"""Settings that a cluster provides stay as they are."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from matchfold.session import build_session, checkpoint_root
s = build_session({master})
print("GOT", s.conf.get("spark.sql.shuffle.partitions"), s.conf.get("spark.driver.memory", "-"))
"""


def run(master, *args):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": " ".join([*args, "pyspark-shell"]), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", CODE.format(master=master)], env=env, capture_output=True, text=True, timeout=120)
    return next(x for x in out.stdout.splitlines() if x.startswith("GOT")).split()[1:]


def test_submitted_settings_survive():
    got = run("None", "--master local[2]", "--conf spark.sql.shuffle.partitions=777", "--conf spark.ui.enabled=false", "--driver-memory 1g")
    assert got == ["777", "1g"]


def test_no_local_folder_on_a_cluster(monkeypatch):
    from matchfold import session

    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "local-cluster[2,1,1024]"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: Conf)

    class Spark:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        session.checkpoint_root(Spark)
    assert session.is_local("local") and session.is_local("local[4]") and not session.is_local("yarn")
