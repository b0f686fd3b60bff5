"""The entry module can be imported before there is a session."""

from __future__ import annotations

import subprocess
import sys


def test_import_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True)
