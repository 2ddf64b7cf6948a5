"""bench.py runs end to end and prints one JSON line."""

import json
import os
import subprocess
import sys


def test_bench_prints_json():
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="4", BENCH_RUNS="1")
    out = subprocess.run([sys.executable, os.path.join(repo, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=900, check=True).stdout.strip().splitlines()
    rec = json.loads(out[-1])
    assert rec["unit"] == "sec" and rec["value"] > 0 and rec["sf"] == 0.001
    assert set(rec["queries"]) >= {"I2_classify_change", "D2_competitor_stats", "J5_page_price"}
