"""The driver's entry: all parts are registered, and queries find the package on workers without a path to it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
assert set(e.oracle_sql()) <= set(e.queries())
spark.createDataFrame([(1, "{{}}")], "o_orderkey long, x string").write.parquet({folder!r} + "/orders.parquet")
assert e.queries()["json_nested"](spark, {folder!r}).count() == 2
"""


def test_workers_without_a_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, folder=str(tmp_path))], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_import_without_the_corpus_operators(tmp_path):
    """Without the folder and the pipeline the rest is there; a missing library isn't hidden."""
    import shutil

    shutil.copytree(f"{ROOT}/veilwright", tmp_path / "veilwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'breakdown' in q and not [n for n in q if n.startswith('op')]"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_blocked_modules():
    """The folder may be missing in any way, a module inside it may not."""
    code = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'breakdown' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]"
    run = lambda name: subprocess.run([sys.executable, "-c", code.format(name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    folder, inside = run("veilwright.llm"), run("veilwright.llm._common")
    assert folder.returncode == 0, folder.stderr[-2000:]
    assert inside.returncode and "ModuleNotFoundError" in inside.stderr
