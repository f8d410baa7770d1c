"""Queries whose driver opens files itself, on a cluster whose shared folder is named without a scheme."""

import datetime
import json
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

NAMES = ["feed_blocks", "feed_indexed", "feed_tar", "gauge_upserts", "indexed_greedy", "live_counters", "random_access", "storage_footprint", "tar_shards"]
CHILD = """
import json, sys
from feedloom.session import build_session
import __spark_entry__ as entry
folder, names = sys.argv[1], sys.argv[2:]
conf = {"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "2", "spark.executor.memory": "1g", "spark.checkpoint.dir": f"{folder}/shared"}
spark = build_session("cluster", "local-cluster[1,2,1024]", **conf)
spark.sparkContext.setLogLevel("ERROR")
found = {}
for name in names:
    try:
        found[name] = sorted(str(r) for r in entry.queries()[name](spark, f"{folder}/tables").collect())
    except Exception as problem:
        found[name] = str(problem)
json.dump(found, open(f"{folder}/found.json", "w"))
spark.stop()
"""


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("cluster")
    docs = [(i, f"text {i} " * (i % 40 + 1), "en", "web", 1) for i in range(700)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{where}/tables/documents.parquet")
    start, kinds = datetime.datetime(2024, 1, 1), ["view", "click", "error"]
    events = [(i, start + datetime.timedelta(minutes=7 * i), i % 11, kinds[i % 3], float(i % 50), None) for i in range(400)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{where}/events")
    (part,) = (where / "events").glob("*.parquet")
    part.rename(where / "tables" / "events.parquet")
    return where


@pytest.fixture(scope="module")
def found(folder):
    env = os.environ | {"PYTHONPATH": os.path.dirname(entry.__file__)}
    subprocess.run([sys.executable, "-c", CHILD, str(folder), *NAMES], env=env, check=True, timeout=600)
    return json.loads((folder / "found.json").read_text())


@pytest.mark.parametrize("name", NAMES)
def test_bare_shared_folder_on_a_cluster(spark, folder, found, name):
    here = sorted(str(r) for r in entry.queries()[name](spark, f"{folder}/tables").collect())
    assert here and found[name] == here


SPACED = ["feed_indexed", "feed_tar", "gauge_upserts", "indexed_greedy", "live_counters", "random_access", "storage_footprint"]


@pytest.fixture(scope="module")
def found_spaced(folder):
    env = os.environ | {"PYTHONPATH": os.path.dirname(entry.__file__)}
    child = CHILD.replace("/shared", "/my shared%20folder").replace("found.json", "spaced.json")
    subprocess.run([sys.executable, "-c", child, str(folder), *SPACED], env=env, check=True, timeout=600)
    return json.loads((folder / "spaced.json").read_text())


@pytest.mark.parametrize("name", SPACED)
def test_shared_folder_named_as_spark_takes_it(spark, folder, found_spaced, name):
    here = sorted(str(r) for r in entry.queries()[name](spark, f"{folder}/tables").collect())
    assert here and found_spaced[name] == here
