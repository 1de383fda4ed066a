import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_training_data(tmp_path):
    """The engine imports where the training-data parts have been removed."""
    code = f"""
    import importlib.abc, sys
    sys.path.insert(0, {str(ROOT)!r})
    class Gone(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path=None, target=None):
            if name.startswith("vellumlake.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name)
    sys.meta_path.insert(0, Gone())
    import __spark_entry__ as e
    assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
    assert len(e.queries()) > 50
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, timeout=120)
