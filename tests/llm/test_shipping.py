"""Python tasks find the package wherever the driver runs."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
from citeloom.session import local_session
from citeloom.llm.queries import queries
spark = local_session(2, "elsewhere")
print(*(queries()[name](spark, "/root/testdata/sf0.001").count() for name in ("op3_licenses", "op6_ann")))
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["200", "500"], done.stderr[-2000:]
