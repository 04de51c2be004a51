"""The entry module imports wherever Spark's jars are, and without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDDEN_JARS = """
import glob, sys, zipfile
def refuse(*args, **kwargs): raise AssertionError("no archive may be read at import")
zipfile.ZipFile = refuse
glob.glob = lambda *args, **kwargs: []
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
assert len(entry.queries()) >= 63 and set(entry.oracle_sql()) <= set(entry.queries())
"""


def test_import_reads_no_jar(tmp_path):
    code = HIDDEN_JARS.format(root=ROOT)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


WITHOUT_LLM = """
import importlib.abc, sys
class Missing(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("evispan.llm"):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
assert len(entry.queries()) >= 63 and not any(name.startswith("op") and name[2].isdigit() for name in entry.queries())
"""


def test_import_without_optional_subpackage(tmp_path):
    code = WITHOUT_LLM.format(root=ROOT)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
