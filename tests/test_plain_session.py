"""The flagship query in a session to which nobody gave a scratch folder."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
from litsearch.session import local_session, scratch_path
spark = local_session(2, 4)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert scratch_path(spark, "a").rsplit("/", 1)[0] == scratch_path(spark, "b").rsplit("/", 1)[0]
import __spark_entry__
print("ROWS", __spark_entry__.entry(spark).count())
"""


def test_entry_runs_without_any_configuration(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_SUBMIT")}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": REPO, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=REPO, env=env, timeout=300,
                          capture_output=True, text=True)
    assert "ROWS 20" in done.stdout, done.stderr[-2000:]
