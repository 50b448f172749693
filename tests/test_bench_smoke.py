"""bench.py prints exactly one well-formed JSON line (run in its own process)."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_emits_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="4", BENCH_RUNS="1")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, cwd=ROOT,
                         capture_output=True, text=True, timeout=900)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert out.returncode == 0, out.stderr[-2000:]
    assert len(lines) == 1
    doc = json.loads(lines[0])
    assert doc["unit"] == "sec" and doc["sf"] == 0.001 and "failed" not in doc
    assert set(doc["queries"]) >= {"dynamic_pricing", "cart_lines", "category_totals"}
    assert abs(doc["value"] - sum(doc["queries"].values())) < 0.01
