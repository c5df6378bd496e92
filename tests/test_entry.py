"""The entry point with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def names(root):
    code = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); print('SQL', *sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    lines = {x.split()[0]: x.split()[1:] for x in out.stdout.splitlines() if x.startswith(("NAMES", "SQL"))}
    return set(lines["NAMES"]), set(lines["SQL"])


def test_queries_without_the_subpackage(tmp_path):
    for x in ("__spark_entry__.py", "tessera"):
        (shutil.copytree if (ROOT / x).is_dir() else shutil.copy)(ROOT / x, tmp_path / x)
    shutil.rmtree(tmp_path / "tessera" / "llm", ignore_errors=True)
    queries, sql = names(tmp_path)
    assert len(queries) >= 30 and sql <= queries
    assert not any(q == "pipeline" or (q.startswith("op") and q[2].isdigit()) for q in queries)


def test_an_error_inside_the_subpackage_shows(tmp_path):
    for x in ("__spark_entry__.py", "tessera"):
        (shutil.copytree if (ROOT / x).is_dir() else shutil.copy)(ROOT / x, tmp_path / x)
    folder = tmp_path / "tessera" / "llm"
    folder.mkdir(exist_ok=True)
    (folder / "__init__.py").write_text("")
    (folder / "queries.py").write_text("import no_such_module_anywhere")
    with pytest.raises(AssertionError, match="no_such_module_anywhere"):
        names(tmp_path)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path


def test_flagship(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables here")
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    # The smallest tables have fewer documents than embeddings.
    assert 0 < __spark_entry__.entry(spark).count() <= 20
