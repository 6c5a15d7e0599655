"""The link graph reads captures a fixed number of times."""

from sitegrain.cluster import checkpoints
from sitegrain.operators import graph


def test_edges_read_captures_three_times(spark):
    """Once for the links, twice for the aliases, however many joins follow."""
    checkpoints(spark)
    reads = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    at = "https://s.example/"
    rows = [(i, f"{at}{i}", f"{at}old{i}", [f"{at}{i + 1}", f"{at}old{i}#x"]) for i in range(10)]
    pages = spark.createDataFrame(rows, "capture_seq long, url string, requested_url string, outgoing_links array<string>")
    got = {(r.source, r.target) for r in graph.edges(pages.mapInPandas(run, pages.schema)).collect()}
    assert got == {(f"{at}{i}", f"{at}{j}") for i in range(10) for j in (i, i + 1)}
    assert reads.value <= 30
