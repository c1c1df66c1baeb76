import pkgutil
import subprocess
import sys

import pytest
from pyspark import SparkFiles, cloudpickle

import corpusmill
from corpusmill.queries import QUERIES


def _alone(spark, tmp_path, code):
    """Run code where only the shipped archive holds the package, as on another machine."""
    done = subprocess.run([sys.executable, "-I", "-c", f"import sys; sys.path.insert(0, {SparkFiles.get('corpusmill_package.zip')!r})\n{code}"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_archive_has_all_modules(spark, tmp_path):
    names = [m.name for m in pkgutil.walk_packages(corpusmill.__path__, "corpusmill.")]
    assert "corpusmill.queries" in names and "corpusmill.tasks.registry" in names
    _alone(spark, tmp_path, f"import importlib\nfor name in {names!r}: importlib.import_module(name)")


@pytest.mark.parametrize("query", ["record_render_counts", "rollout_sequence_counts", "training_steps"])
def test_worker_loads_query(spark, sf, tmp_path, monkeypatch, query):
    """The function that a query sends to the workers loads and runs where there is only the archive."""
    kind, sent = type(spark.range(1)), []
    real = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, *a, **k: sent.append(f) or real(self, f, *a, **k))
    QUERIES[query](spark, sf)
    (tmp_path / "f").write_bytes(cloudpickle.dumps(sent[-1]))
    rows = {"id": ["a"], "messages": [None], "text": ["<|im_start|>assistant\nab<|im_end|>\n"], "response": ["ab"]}
    _alone(spark, tmp_path, f"import pickle, pandas as pd\ngot = pd.concat(pickle.load(open('f', 'rb'))(iter([pd.DataFrame({rows!r})])))\nassert got.status.tolist() == ['kept'] and got.n_trained.tolist() == [12], got")
