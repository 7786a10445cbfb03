import subprocess
import sys
from pathlib import Path


def test_entry_imports_without_a_session():
    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 100 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
