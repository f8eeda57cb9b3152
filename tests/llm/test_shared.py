import random
import subprocess
import sys

from conftest import ROOT
from usagelake.llm import shared


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (100, 200, 300)} == {100} and {got[i] for i in range(500, 560)} == {500}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contracted_edges_join_the_same_nodes(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(b), b) for b in range(1, 400) for _ in range(rng.randrange(3)) if b % 7]
    edges += [(a, b) for a in range(1000, 1025) for b in range(1025, 1325)]  # many nodes that share few neighbours
    edges = spark.createDataFrame(edges, "a long, b long")
    few = shared.contracted(edges)
    assert {tuple(r) for r in shared.components(few).collect()} == {tuple(r) for r in shared.components(edges).collect()}
    assert few.filter("a >= 1000").count() == 324 and few.filter("a >= b").count() == 0


def test_own_folder_where_none_is_named():
    code = ("from pyspark.sql import SparkSession\nfrom usagelake.llm.shared import shared_folder, stored\n"
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "assert stored(s.range(3), 'x').count() == 3 and shared_folder(s) == shared_folder(s)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_size_check(spark):
    assert shared.small_enough(spark.range(5), 5) and not shared.small_enough(spark.range(6), 5)
