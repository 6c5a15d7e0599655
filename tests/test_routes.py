"""Breadth-first trees: against a plain search, and the work for long chains."""

import random

import pytest

from sitegrain.cluster import checkpoints
from sitegrain.operators import graph


def searched(edges, root):
    """{id: (level, parent)} by a search from node to node."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found, now = {root: (0, None)}, [root]
    while now:
        step = {}
        for a in sorted(now):
            for b in out.get(a, set()) - found.keys():
                step.setdefault(b, (found[a][0] + 1, a))
        found |= step
        now = list(step)
    return found


def tree(spark, edges, root, until=None):
    checkpoints(spark)
    return {r.id: (r.level, r.parent) for r in graph.route_tree(spark.createDataFrame(edges, "source string, target string"), root, until).collect()}


RINGS = [("r", "a"), ("a", "r"), ("a", "a"), ("a", "b"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "q")]
BOTH_WAYS = [(f"{i:02}", f"{j:02}") for i in range(20) for j in (i - 1, i + 1) if 0 <= j < 20]


def random_edges(seed, nodes=60):
    r = random.Random(seed)
    tails = [(f"n{i}", f"c{i}.0") for i in range(5)] + [(f"c{i}.{j}", f"c{i}.{j + 1}") for i in range(5) for j in range(9)]
    return [(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(110)] + tails


@pytest.mark.parametrize(("edges", "root"), [(RINGS, "r"), (BOTH_WAYS, "00"), (random_edges(1), "n0"), (random_edges(2), "n1"), ([("x", "y")], "r")])
def test_tree(spark, edges, root):
    assert tree(spark, edges, root) == searched(edges, root)


@pytest.mark.parametrize("until", ["c0.4", "n7", "out of reach"])
def test_tree_up_to_a_node(spark, until):
    whole = searched(random_edges(3), "n0")
    most = whole[until][0] if until in whole else len(whole)
    assert tree(spark, random_edges(3), "n0", until) == {i: x for i, x in whole.items() if x[0] <= most}


def test_many_chains_take_no_more_jobs(spark):
    def jobs(chains, pages):
        edges = [("root" if j == 0 else f"{i}/{j - 1}", f"{i}/{j}") for i in range(chains) for j in range(pages)] + [(f"{i}/{j}", f"{i}/0") for i in range(chains) for j in range(1, pages)]
        spark.sparkContext.setJobGroup(f"{chains} chains", "")
        try:
            assert tree(spark, edges, "root") == searched(edges, "root")
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{chains} chains"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert jobs(1200, 24) < jobs(12, 24) + 12
