"""ADJ, DOT and dependency-tree texts."""

import pytest

from wayloom.graph import Graph
from wayloom.operators import components, generate
from wayloom.sources import adj, deps, dot
from wayloom.sources.dot_text import Dot, Word


def test_adj(spark, tmp_path):
    for g in (generate.line(spark, 10), generate.dust(spark, 3), Graph.new(spark, "none"), Graph.build(spark, [(1, 1), (2, 1)], "loop")):
        path = adj.write_adj(g, str(tmp_path))
        back = adj.read_adj(spark, path)
        assert back.equal(g) and back.name == g.name
    for bad in ("System.halt()", '{:adj, "x", {%{1 => MapSet.new([2])}, %{}}}', '{:adj, "x"', ""):
        with pytest.raises(ValueError):
            adj.parse(bad)
    g = generate.ring(spark, 5)
    assert adj.read_parquet(spark, adj.write_parquet(g, str(tmp_path / "p"))).equal(g)


HARBOUR = """digraph harbour {
  node [fontsize=9];
  edge [arrowsize=2];
  rankdir=LR;
  11 [label="quay", shape="ellipse"];
  12;
  15;
  11 -> 12 [label="ferry", color="0.5,0.25,1.0"];
  12 -> 15 [color="#0080FF"];
  15 -> 11;
  15 -> 12;
  12 -> 11 -> 15;
}
"""


def test_dot_text():
    at = {"node": [("fontsize", 9)], "edge": [("arrowsize", 2)], "harbour": [("rankdir", Word("LR"))], 11: [("label", "quay"), ("shape", "ellipse")], (11, 12): [("label", "ferry"), ("color", (0.5, 0.25, 1.0))], (12, 15): [("color", (0, 128, 255))]}
    tail = lambda d: d.edges([(15, 11), (15, 12)]).chain([12, 11, 15]).text()
    d = Dot("harbour").globals("harbour", at).node(11, at).nodes([12, 15]).edge((11, 12), at).edge((12, 15), at)
    assert tail(d) == HARBOUR
    d = Dot("harbour").common("node", at).common("edge", [("arrowsize", 2)]).rankdir("LR").node(11, at).nodes([12, 15])
    assert tail(d.edge((11, 12), None, at[(11, 12)]).edge((12, 15), None, at[(12, 15)])) == HARBOUR
    with pytest.raises(ValueError):
        Dot().node("a b")
    with pytest.raises(ValueError):
        Dot().rankdir("XX")
    pairs = Dot("g").edges([(1, 2), (2, 1), (1, 3)], None, "both", "none").text()
    assert pairs == "digraph g {\n  1 -> 2 [dir=both];\n  1 -> 3 [dir=none];\n}\n"


TEXT = """// the roads
# of an island
/* drawn
   by hand */
digraph island { node [color=navy]; ratio="3,4";
  north->market->south [label="high street"]; north -> light; out-post -> "old mill" ;
  light [label="tower\\nlamp", color=white];
  lonely; ring -> north;
  {rank=same; east; west; east -> west; }
}"""


def test_dot_reader(spark, tmp_path):
    path = tmp_path / "island.dot"
    path.write_text(TEXT)
    g, at = dot.read_dot(spark, str(path))
    assert g.name == "island"
    names = {i: dict(at[i])["alias"] for i in at if isinstance(i, int)}
    assert names[1] == "north" and names[2] == "market" and names[3] == "south" and names[7] == "lonely" and names[8] == "ring"
    assert names[10] == "east" and 9 not in names  # the group took 9
    v, e = g.to_sets()
    assert e == {(1, 2), (2, 3), (1, 4), (5, 6), (8, 1), (10, 11)} and 7 in v
    assert at[(2, 3)] == [("label", "high street")] and (1, 2) not in at
    assert at[4] == [("alias", "light"), ("label", "tower\nlamp"), ("color", "white")]
    assert at["island_node"] == [("color", "navy")] and at["island"] == [("ratio", "3,4")] and at["rank_9"] == [("rank", "same")]
    assert dot.attribute_table(spark, at).filter("key_kind = 'edge'").count() == 1
    assert dot.read_dots(spark, str(tmp_path)).select("name").first()[0] == "island"
    for bad in ("graph x {}", "digraph { a -> }", "digraph { a:n -> b }"):
        with pytest.raises(ValueError):
            dot.Reader(bad).read()
    with pytest.raises(Exception):
        dot.read_dot(spark, str(tmp_path / "missing.dot"))


def test_dot_files(spark, tmp_path):
    g = Graph.build(spark, [(1, 2, 3, 1), (3, 4)], "g")
    path, text = dot.write_dot(g, str(tmp_path))
    back, _ = dot.read_dot(spark, path)
    assert back.equal(g) and back.name == "g"
    parts = components.strong(g).withColumnRenamed("comp", "part")
    text = dot.to_dot(g, partition=parts)
    assert "rank=same;" in text and "3 -> 4 [constraint=true];" in text and "1 -> 2 [constraint=false];" in text
    at = dot.partition_colours(g, parts.filter("id <> 4"))
    assert at[4] == [("color", dot.NO_COLOUR)] and at[(3, 4)] == [("color", dot.NO_COLOUR)] and at[(1, 2)] == at[1] == [("color", "red")]
    lines = "\n".join(r["line"] for r in dot.dot_lines(g, {1: [("label", "one")]}).orderBy("n").collect())
    assert lines + "\n" == dot.to_dot(g, {1: [("label", "one")]})
    assert "\n".join(r[0] for r in spark.read.text(dot.write_dot_parts(g, f"{tmp_path}/parts")).collect()) + "\n" == dot.to_dot(g)


def test_draw(spark, tmp_path, monkeypatch):
    """Rendering hands the file to GraphViz, here a stand-in that copies it; without one it is an error."""
    g = Graph.build(spark, [(1, 2, 3, 1), (3, 4)], "g")
    parts = components.strong(g).withColumnRenamed("comp", "part")
    monkeypatch.setenv("PATH", str(tmp_path))
    with pytest.raises(RuntimeError, match="GraphViz"):
        dot.draw(g, str(tmp_path))
    program = tmp_path / "dot"
    program.write_text('#!/bin/sh\n/bin/cat "$4" > "$3"\n')
    program.chmod(0o755)
    assert open(dot.draw(g, str(tmp_path), form="svg")).read() == dot.to_dot(g)
    image = open(dot.draw_partitions(g, parts, str(tmp_path), layers=True)).read()
    assert "rank=same;" in image and "color=red" in image.replace('"', "") and dot.NO_COLOUR in image
    assert dot.render(f"{tmp_path}/g.dot", "png", f"{tmp_path}/out").endswith("/out/g.png")
    with pytest.raises(ValueError):
        dot.render(f"{tmp_path}/g.dot", "p;g")


def test_deps(spark, tmp_path):
    text = "top\n|-- one ~> 1.0 (Hex package)\n|   |-- two (../two)\n|   `-- three >= 0.2 or ~> 1.0 (Hex package)\n`-- two (https://example.org/two.git - main)\n    `-- three ~> 1.0 (Hex package)\n"
    path = tmp_path / "t.txt"
    path.write_text(text)
    g, at = deps.read_deps(spark, str(path))
    assert g.name == "t" and at["t"] == [("rankdir", "BT")] and at[(2, 4)] == [("color", "blue")] and at[(2, 3)] == [("color", deps.MIXED)]
    assert g.to_sets() == ({1, 2, 3, 4}, {(1, 2), (2, 3), (2, 4), (1, 3), (3, 4)})
    assert at[2] == [("alias", "one"), ("label", "one ~> 1.0"), ("color", "blue")] and dict(at[3])["color"] == "green"
    for bad in ("", "top\n|   |-- deep\n", "a b (c\n"):
        with pytest.raises(ValueError):
            deps.parse(bad)
