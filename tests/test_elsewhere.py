"""Python steps reach workers that do not have the package on their path."""

import subprocess
import sys
from pathlib import Path

from .conftest import SMALL

CODE = """
import sys; sys.path.insert(0, {repo!r})
from corpusloom.session import local_session
from corpusloom.plans.registry import run_query
s = local_session(2, "elsewhere")
print("rows", len(run_query("s5_html_blocks", s, {data!r}).collect()), len(run_query("w17_merge_rects", s, {data!r}).collect()))
"""


def test_runs_from_another_folder(tmp_path):
    code = CODE.format(repo=str(Path(__file__).resolve().parent.parent), data=SMALL)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "rows 569 8774" in out.stdout, out.stderr[-2000:]
