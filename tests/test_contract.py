import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


def test_names_match():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_sql_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.oracle_sql()) > 60 and len(e.queries()) > 80"
    root = Path(contract.__file__).parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_entry_runs(spark):
    assert contract.entry(spark).count() == 1000
