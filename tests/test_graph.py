"""Editing, degrees, classes, histograms and generators against golden values."""

import pytest

from wayloom.graph import Graph
from wayloom.operators import degree, generate


def build(spark, *elements, name="g"):
    return Graph.build(spark, list(elements), name)


TRI = ({1, 2, 3}, {(1, 2), (2, 3), (1, 3)})


@pytest.mark.parametrize(
    ("elements", "want"),
    [
        ([1, 2, 3], ({1, 2, 3}, set())),
        ([range(1, 4)], ({1, 2, 3}, set())),
        ([(1, 2), (2, 3), (1, 3)], TRI),
        ([(1, [2, 3]), (2, [3])], TRI),
        ([(1, 2, 3, 1)], ({1, 2, 3}, {(1, 2), (2, 3), (3, 1)})),
        ([(1, 1, 2)], ({1, 2}, {(1, 1), (1, 2)})),
        ([1, [1, [(1, 1)]]], ({1}, {(1, 1)})),
        ([(4, [])], ({4}, set())),
        ([], (set(), set())),
    ],
)
def test_add(spark, elements, want):
    g = build(spark, *elements)
    assert g.to_sets() == want
    assert g.add(list(elements)).to_sets() == want


@pytest.mark.parametrize(
    ("gone", "want"),
    [
        (1, ({2, 3}, {(2, 3)})),
        ((1, 3), ({1, 2, 3}, {(1, 2), (2, 3)})),
        ((1, 2, 3), ({1, 2, 3}, {(1, 3)})),
        ((1, [2, 3]), ({1, 2, 3}, {(2, 3)})),
        ([1, (2, 3)], ({2, 3}, set())),
        ((1, []), TRI),
        ([range(7, 9), (8, 9)], TRI),
    ],
)
def test_delete(spark, gone, want):
    assert build(spark, (1, [2, 3]), (2, 3)).delete(gone).to_sets() == want


@pytest.mark.parametrize("bad", [0, -1, "x", (1,), 1.5, True, (1, "a"), None, range(0, 3)])
def test_bad_elements(spark, bad):
    with pytest.raises(ValueError):
        build(spark, bad)


def test_access(spark):
    g = build(spark, (1, [2, 3]), (2, 3), 9, name="self loop!")
    assert g.name == "self_loop"
    assert g.has_vertex(9) and not g.has_vertex(8) and g.has_edge(1, 2) and not g.has_edge(2, 1)
    assert (g.n_vertices(), g.n_edges(), g.some_vertex(), g.span()) == (4, 3, 1, (1, 9))
    run, rest = g.leading_range()
    assert run == range(1, 4) and [r[0] for r in rest.collect()] == [9]
    empty = Graph.new(spark, "e")
    assert empty.span() is None and empty.some_vertex() is None and empty.rotate().to_sets() == (set(), set())
    with pytest.raises(ValueError):
        g.check_vertex(8)
    with pytest.raises(ValueError):
        Graph.new(spark, "")


def test_classify(spark):
    g = build(spark, (1, 2, 3, 4, 5), (6, 2), (2, 7), (4, 4), (6, 6), (7, 7), 8, (9, 9))
    got = {r["id"]: r["vclass"] for r in degree.classes(g).collect()}
    assert got == {1: "source", 2: "complex", 3: "linear", 4: "self_linear", 5: "sink", 6: "self_source", 7: "self_sink", 8: "isolated", 9: "self_isolated"}
    assert degree.classify(g, 4) == "self_linear"
    assert {r[0] for r in degree.sources(g).collect()} == {1, 6} and {r[0] for r in degree.sinks(g).collect()} == {5, 7}
    assert [r[0] for r in degree.isolated(g).collect()] == [8] and degree.is_isolated(g, 9)
    assert degree.degree(g, 4, "in_self_out") == (1, 1, 1) and degree.degree(g, 4, "in_out") == (2, 2) and degree.degree(g, 2, "in") == 2
    assert degree.neighbours(g, 4, "in_self_out") == ({3}, {4}, {5}) and degree.neighbours(g, 4, "out") == {4, 5}
    with pytest.raises(ValueError):
        degree.degree(g, 99)


def test_rewriting(spark):
    g = build(spark, (1, 2, 3, 1, 1))
    assert g.transpose().to_sets()[1] == {(1, 1), (1, 3), (2, 1), (3, 2)} and g.transpose().name == "g_transpose"
    assert g.transpose().transpose().equal(g) and not g.equal(g.delete((1, 1)))
    assert build(spark, (2, 5), (5, 9)).rotate().to_sets() == ({2, 5, 9}, {(5, 9), (9, 2)})
    assert g.relabel({1: 4, 2: 4, 3: 5}).to_sets() == ({4, 5}, {(4, 4), (4, 5), (5, 4)})
    with pytest.raises(ValueError):
        g.relabel({1: 2})
    g1, g2 = build(spark, 1, (2, 3), (4, 5), (6, 5)), build(spark, (1, 2), (2, 4), (4, 5))
    assert g1.join(g2).to_sets()[1] == {(2, 3), (4, 5), (6, 5), (1, 2), (2, 4)}
    assert g1.join(g2, "disjoint").to_sets()[1] == {(2, 3), (4, 5), (6, 5), (7, 8), (8, 10), (10, 11)}
    assert g1.join(Graph.new(spark, "e"), "disjoint").equal(g1)


GOLDEN = {
    "dust": ([10], [10], [10], {(0, 0): 10}),
    "line": ([1, 9], [1, 9], [0, 2, 8], {(0, 1): 1, (1, 0): 1, (1, 1): 8}),
    "ring": ([0, 10], [0, 10], [0, 0, 10], {(1, 1): 10}),
    "fan_in": ([9, 0, 0, 0, 0, 0, 0, 0, 0, 1], [1, 9], [0, 9, 0, 0, 0, 0, 0, 0, 0, 1], {(0, 1): 9, (9, 0): 1}),
    "fan_out": ([1, 9], [9, 0, 0, 0, 0, 0, 0, 0, 0, 1], [0, 9, 0, 0, 0, 0, 0, 0, 0, 1], {(0, 9): 1, (1, 0): 9}),
    "wheel": ([1, 0, 9], [0, 9, 0, 0, 0, 0, 0, 0, 0, 1], [0, 0, 0, 9, 0, 0, 0, 0, 0, 1], {(0, 9): 1, (2, 1): 9}),
    "clique": ([0] * 9 + [10], [0] * 9 + [10], [0] * 18 + [10], {(9, 9): 10}),
}


@pytest.mark.parametrize("kind", GOLDEN)
def test_generators(spark, kind):
    g = getattr(generate, kind)(spark, 10)
    a, b, c, d = GOLDEN[kind]
    assert (degree.dense(degree.histogram1(g, "in")), degree.dense(degree.histogram1(g, "out")), degree.dense(degree.histogram1(g, "in_out"))) == (a, b, c)
    assert {(r[0], r[1]): r[2] for r in degree.histogram2(g).collect()} == d


def test_small_and_random(spark):
    assert degree.dense(degree.histogram1(generate.grid2d(spark, 4, 3), "in_out")) == [0, 0, 0, 0, 4, 0, 6, 0, 2]
    assert generate.grid2d(spark, 1, 1).to_sets() == ({1}, set()) and generate.grid2d(spark, 3, 1).to_sets()[1] == {(1, 2), (2, 1), (2, 3), (3, 2)}
    for one in (generate.line, generate.ring, generate.clique, generate.dust):
        assert one(spark, 1).to_sets() == ({1}, set())
    assert degree.homogeneous(degree.histogram2(generate.clique(spark, 5))) == (4, 4) and degree.homogeneous(degree.histogram2(generate.line(spark, 5))) is None
    for n, m, connected in ((10, 20, False), (10, 20, True), (4, 12, False), (30, 29, True), (1, 0, False)):
        v, e = generate.random(spark, n, m, connected, 7).to_sets()
        assert v == set(range(1, n + 1)) and len(e) == m and all(s != d and {s, d} <= v for s, d in e)
    assert generate.random(spark, 10, 20, False, 7).to_sets() == generate.random(spark, 10, 20, False, 7).to_sets()
    for f, n in ((generate.fan_in, 2), (generate.wheel, 3), (generate.line, 0)):
        with pytest.raises(ValueError):
            f(spark, n)
    with pytest.raises(ValueError):
        generate.random(spark, 3, 7)
