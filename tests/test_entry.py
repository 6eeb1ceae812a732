import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    import shutil

    for name in ("__spark_entry__.py", "hertzlake"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "hertzlake" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'zcd_rocof' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_imports_without_a_package_of_the_training_data_operators():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; assert 'zcd_rocof' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
