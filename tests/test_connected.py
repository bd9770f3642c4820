"""q_connected runs the operator for strong connectivity."""

from wayloom.graph import Graph
from wayloom.plans import catalogue
from wayloom.sources import tables


def test_strong(spark, monkeypatch):
    for edges, want in (([(1, 2), (2, 3), (3, 1)], (1, True, True)), ([(1, 2), (2, 3)], (1, True, False))):
        monkeypatch.setitem(tables.GRAPHS, "eventchain", lambda spark, d, e=edges: Graph.from_frames(spark.createDataFrame(e, "src long, dst long")))
        r = catalogue.QUERIES["q_connected"](spark, "").first()
        assert (r["ncomp"], r["weak"], r["strong"]) == want
