"""The entry module with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'q_trust_summary' in q; print(*sorted(n for n in q if not n.startswith('q_')))"


@pytest.mark.parametrize("gone", [[], ["plumbline/llm"], ["corpus_pipeline.py"], ["plumbline/llm", "corpus_pipeline.py"]])
def test_queries_are_listed(tmp_path, gone):
    """The library's own queries stay, whatever of the subpackage and its pipeline is deleted."""
    for name in ("plumbline", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        at = tmp_path / name
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    said = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join([str(tmp_path), *(p for p in sys.path if p and Path(p).resolve() != ROOT)])}, capture_output=True, text=True)
    assert not said.returncode, said.stderr
    llm = (tmp_path / "plumbline/llm").exists()
    assert any(x.startswith("op1_") for x in said.stdout.split()) == llm
    assert ("pipeline" in said.stdout.split()) == (llm and (tmp_path / "corpus_pipeline.py").exists())
