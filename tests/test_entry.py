import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from tarnlight.session import local_session
spark = local_session(2, memory="1g")
print("ROWS", e.queries()["p1_found"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    """The driver process started elsewhere, without PYTHONPATH."""
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), **{k: v for k, v in __import__("os").environ.items() if k in ("JAVA_HOME", "SPARK_HOME", "PATH")}}, capture_output=True, text=True, timeout=300)
    assert "ROWS 5" in out.stdout or int(out.stdout.split("ROWS ")[1].split()[0]) > 0, out.stderr[-2000:]


@pytest.mark.parametrize("missing, raised", [("zstandard", True), ("xxhash", True), ("tarnlight.llm", False), ("tarnlight.llm.queries", False)])
def test_only_an_absent_subpackage_is_skipped(missing, raised):
    """A library that is missing is an error, not fewer queries."""
    code = f"""
import importlib.abc, sys
sys.path.insert(0, {str(ROOT)!r})
class Missing(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
print("NAMES", "p1_found" in e.queries(), "p2_found" in e.queries())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=100)
    assert ("ModuleNotFoundError" in out.stderr) if raised else ("NAMES True False" in out.stdout), out.stderr[-2000:]


class _Cluster:
    """What cut_lineage asks a session."""

    def __init__(self, master, folder=None):
        self.sparkSession = self.sparkContext = self
        self.master, self.folder, self.made = master, folder, None

    getCheckpointDir = lambda self: self.made
    getConf = lambda self: {"spark.checkpoint.dir": self.folder} if self.folder else {}
    checkpoint = lambda self: self

    def setCheckpointDir(self, folder):
        self.made = folder


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    import pytest

    from tarnlight.session import cut_lineage

    for master in ("spark://a:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            cut_lineage(_Cluster(master))
        assert cut_lineage(_Cluster(master, "file:///shared")).made == "file:///shared"
    assert cut_lineage(_Cluster("local[4]")).made
