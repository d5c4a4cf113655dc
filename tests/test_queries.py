import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from quarrylens.queries import MODULES, ORACLES, QUERIES

from .conftest import SF, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_without_llm(tmp_path):
    """A copy without the training-data operators, their tests and the pipeline still imports and keeps all other queries."""
    root = Path(__file__).resolve().parent.parent
    for part in ("quarrylens", "tests"):
        shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for part in ("__spark_entry__.py", "bench.py"):
        shutil.copy(root / part, tmp_path)
    modules = [".".join(p.relative_to(tmp_path).with_suffix("").parts) for p in (tmp_path / "quarrylens").rglob("*.py") if p.stem != "__init__"]
    code = f"""
import importlib
for m in {modules + ["bench", "tests.conftest"]}: importlib.import_module(m)
import __spark_entry__ as e
from pyspark.sql import SparkSession
from quarrylens.queries import MODULES
print(*sorted(e.queries()))
spark = SparkSession.builder.master("local[2]").config(map={{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}}).getOrCreate()
for m in MODULES:
    name = next(iter(importlib.import_module(f"quarrylens.queries.{{m}}").QUERIES))
    print(name, e.queries()[name](spark, {SF!r}).count())
"""
    out = subprocess.run([sys.executable, "-B", "-W", "ignore", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    names, *ran = out.stdout.splitlines()
    assert names.split() == sorted(QUERIES)
    assert len(ran) == len(MODULES) and all(int(line.split()[1]) > 0 for line in ran)


def test_entry_says_what_it_leaves_out(monkeypatch):
    """Where a library that the training-data operators need is missing, all other queries stay."""
    import __spark_entry__ as entry

    def missing(name):
        raise ImportError(f"no {name} here")

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    with pytest.warns(UserWarning, match="left out: no quarrylens.llm"):
        assert sorted(entry.queries()) == sorted(QUERIES)
    with pytest.warns(UserWarning, match="left out"):
        assert entry.oracle_sql() == ORACLES


def test_shared_folder(spark, monkeypatch):
    from quarrylens.sources import shared

    before = shared.shared_dir(spark)
    with shared.scratch(spark) as path:
        assert shared.written(spark.range(3), "t").count() == 3 and os.listdir(path)
    assert not os.path.exists(path) and shared.shared_dir(spark) == before == spark.conf.get("spark.checkpoint.dir")

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://elsewhere:7077"}.get(key, default)

    class Cluster:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Cluster())
    monkeypatch.setattr(shared, "_own", [])
    monkeypatch.setattr(Conf, "get", lambda self, key, default=None: {"spark.master": "local[2]"}.get(key, default))
    assert os.path.isdir(shared.shared_dir(Cluster())) and shared.shared_dir(Cluster()) == shared.shared_dir(Cluster())
