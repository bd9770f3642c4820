"""Reach, components, walks, contraction, isomorphism and the repository."""

import random
from collections import deque

import pytest

from wayloom.functions.match import isomorphism
from wayloom.functions.walk import Control, Cycle, Order
from wayloom.graph import Graph
from wayloom.operators import components, contract, generate, morph, reach, repository, traverse

T1 = [(1, 2), (1, 3), (3, 4), (5, 3)]
T2 = [(1, 2), (1, 3), (3, 4), (3, 5)]
W8 = [(1, 2, 3, 1), (4, 5, 6, 5, 4), (7, 8, 7), (2, 7), (3, 7), (4, 8), (6, 8)]


def build(spark, *elements):
    return Graph.build(spark, list(elements), "g")


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


def fronts(df):
    out = {}
    for hop, i in df.select("hop", "id").collect():
        out.setdefault(hop, set()).add(i)
    return out


def groups(df):
    out = {}
    for i, c in df.collect():
        out.setdefault(c, set()).add(i)
    return out


def test_reach(spark):
    g = build(spark, *T1)
    assert ids(reach.reachable(g, 1)) == {1, 2, 3, 4} and ids(reach.reachable(g, 5)) == {3, 4, 5}
    assert ids(reach.reachable(g, 4, "in")) == {1, 3, 4, 5} and ids(reach.reachable(g, 3, "in_out")) == {1, 3, 4, 5}
    assert ids(reach.reachable(g, 1, nhop=0)) == {1}
    assert ids(reach.reachable(build(spark, (1, 2, 3, 4, 5), (1, 6, 4)), 1, nhop=3)) == {1, 2, 3, 4, 5, 6}
    with pytest.raises(ValueError):
        reach.reachable(g, 99)
    w = build(spark, *W8)
    assert fronts(reach.frontiers(w, 1)) == {0: {1}, 1: {2}, 2: {3, 7}, 3: {8}}
    assert fronts(reach.frontiers(w, 4)) == {0: {4}, 1: {5, 8}, 2: {6, 7}}
    assert ids(reach.frontiers(w, 1, "in_out")) == set(range(1, 9))


def test_components(spark):
    g = build(spark, 1, (2, 3), (4, 5), (6, 5))
    assert groups(components.weak(g)) == {1: {1}, 2: {2, 3}, 4: {4, 5, 6}}
    vi, ei = components.partition_index(g, components.weak(g).withColumnRenamed("comp", "part").filter("id <> 6"))
    assert dict(vi.collect())[6] is None and {(r[0], r[1]): (r[2], r[3]) for r in ei.collect()} == {(2, 3): (2, 2), (4, 5): (4, 4), (6, 5): (None, 4)}
    w = build(spark, *W8, 9, (10, 10))
    assert groups(components.strong(w)) == {1: {1, 2, 3}, 4: {4, 5, 6}, 7: {7, 8}, 9: {9}, 10: {10}}
    c = components.condensation(w)
    assert c.to_sets() == ({1, 4, 7, 9, 10}, {(1, 7), (4, 7)}) and c.name == "g_condensation"
    empty = Graph.new(spark, "e")
    assert groups(components.weak(empty)) == groups(components.strong(empty)) == {}


def test_trees_and_cycles(spark):
    t1, t2 = build(spark, *T1), build(spark, *T2)
    assert components.is_tree(t1) and not components.is_tree(t1, "strong") and components.root(t1) is None
    assert components.is_tree(t2) and components.is_tree(t2, "strong") and components.root(t2) == 1
    assert components.is_tree(t2.transpose()) and not components.is_tree(t2.transpose(), "strong")
    dag, w = t2.add((4, 5)), build(spark, *W8)
    for g, weak, strong in ((t1, False, False), (t2, False, False), (dag, True, False), (w, True, True), (build(spark, (1, 1)), True, True)):
        assert (components.is_cyclic(g), components.is_cyclic(g, "strong")) == (weak, strong)
        assert traverse.traverse(g, Cycle, "found boolean", "strong").first()[0] == strong
    assert not components.is_connected(Graph.new(spark, "e")) and components.is_connected(build(spark, 1)) and not components.is_connected(build(spark, 1, 2))


def test_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((12, 14), (30, 45)):
        pairs = {(rng.randint(1, n), rng.randint(1, n)) for _ in range(m)}
        g = build(spark, range(1, n + 1), *pairs)

        def search(start, near):
            hop, queue = {start: 0}, deque([start])
            while queue:
                x = queue.popleft()
                for y in near(x):
                    if y not in hop:
                        hop[y] = hop[x] + 1
                        queue.append(y)
            return hop

        out = {i: search(i, lambda x: [d for s, d in pairs if s == x]) for i in range(1, n + 1)}
        both = {i: search(i, lambda x: [d for s, d in pairs if s == x] + [s for s, d in pairs if d == x]) for i in range(1, n + 1)}
        assert {r["id"]: r["hop"] for r in reach.frontiers(g, 1).collect()} == out[1]
        assert {r[0]: r[1] for r in components.weak(g).collect()} == {i: min(both[i]) for i in both}
        assert {r[0]: r[1] for r in components.strong(g).collect()} == {i: min(j for j in out[i] if i in out[j]) for i in out}


def test_strong_by_colours(spark):
    """Many cycles of one size: the pivot takes one, colours must find the others."""
    g = build(spark, *[(10 * k + 1, 10 * k + 2, 10 * k + 3, 10 * k + 1) for k in range(6)], *[(10 * k + 1, 10 * k + 12) for k in range(5)])
    assert groups(components.strong(g)) == {10 * k + 1: {10 * k + j for j in (1, 2, 3)} for k in range(6)}


def test_forest(spark):
    dag = build(spark, *T2, (4, 5))
    f = traverse.forest(dag, "strong", 1)
    assert [r["id"] for r in traverse.preorder(f).collect()] == [1, 2, 3, 4, 5] and [r["id"] for r in traverse.postorder(f).collect()] == [2, 5, 4, 3, 1]
    assert traverse.to_graph(f).to_sets()[1] == {(1, 2), (1, 3), (3, 4), (4, 5)}
    w = build(spark, *W8)
    weak, strong = traverse.forest(w, "weak", 1), traverse.forest(w, "strong", 1)
    assert [r["id"] for r in traverse.preorder(weak).collect()] == [1, 2, 3, 7, 8, 4, 5, 6] and [r["id"] for r in traverse.postorder(weak).collect()] == [6, 5, 4, 8, 7, 3, 2, 1]
    assert [r["id"] for r in traverse.postorder(strong).collect()] == [8, 7, 3, 2, 1, 6, 5, 4]
    assert groups(traverse.to_partition(strong)) == {1: {1, 2, 3, 7, 8}, 4: {4, 5, 6}}
    order = lambda g, kind, root: [r[1] for r in traverse.traverse(g, lambda near: Order(), "pos long, id long", kind, "bfs", root).orderBy("pos").collect()]
    assert order(w, "weak", 4) == [4, 5, 8, 6, 7, 2, 3, 1] and order(w, "strong", 4) == [4, 5, 8, 6, 7, 1, 2, 3]
    fan = traverse.forest(build(spark, (1, 2), (1, 3), (2, 4), (3, 5)), "strong", 1)
    assert [r["id"] for r in traverse.preorder(fan).collect()] == [1, 2, 4, 3, 5] and [r["id"] for r in traverse.postorder(fan).collect()] == [4, 2, 5, 3, 1]
    assert [r["line"] for r in traverse.dump(fan).collect()] == ["1", "  2", "    4", "  3", "    5"]
    again = traverse.walk_forest(fan, lambda near: Order(), "pos long, id long").orderBy("pos").collect()
    assert [r[1] for r in again] == [1, 2, 4, 3, 5]


def test_contract(spark):
    g = build(spark, (1, 2), (2, 2), (3, 2), (2, 4))
    assert contract.edge(g, 1, 2).to_sets() == ({1, 3, 4}, {(1, 1), (1, 4), (3, 1)})
    assert contract.edge(build(spark, (1, 2), (2, 3)), 1, 2).to_sets() == ({1, 3}, {(1, 3)})
    assert contract.edge(g, 4, 1).equal(g) and contract.edge(g, 2, 2).to_sets()[1] == {(1, 2), (3, 2), (2, 4)}
    assert contract.nodes(g, [4, 99]).equal(g)
    assert contract.linear(build(spark, (1, 2, 3)), 2).to_sets() == ({1, 3}, {(1, 3)})
    for elements, i, why in (([(1, 2, 3), (1, 3)], 2, "linked already"), ([(1, 2, 1)], 2, "one vertex"), ([(1, 2), (2, 2)], 2, "has a loop"), ([(1, 2)], 2, "one way in"), ([(1, 2, 1), (2, 3, 2), (1, 3)], 2, "linked already")):
        with pytest.raises(ValueError, match=why):
            contract.linear(build(spark, *elements), i)
    assert contract.linears(generate.ring(spark, 6)).to_sets() == ({5, 6}, {(5, 6), (6, 5)})
    for n in (4, 5):
        ring = generate.ring(spark, n)
        both = ring.add_frames(edges=ring.transpose().edges)
        assert len(contract.linears(both).to_sets()[0]) == 3
    assert contract.linears(build(spark, (1, 2))).name == "g"


PETERSEN = [(i + 1, (i + 1) % 5 + 1) for i in range(5)] + [(i + 1, i + 6) for i in range(5)] + [(i + 6, (i + 2) % 5 + 6) for i in range(5)]
PETERSEN += [(d, s) for s, d in PETERSEN]


def test_isomorphism(spark):
    loops = [build(spark, (1, 2, 3, 1), (i, i)) for i in (1, 2, 3)]
    assert len({morph.graph_hash(g, h) for g in loops for h in (0,)}) == 1 and len({morph.graph_hash(g, 1) for g in loops}) == 1
    verdict, to = morph.isomorphism(loops[0], loops[2])
    assert verdict == "isomorphic" and loops[0].relabel(to).equal(loops[2])
    a, b = build(spark, (1, 2, 3, 4, 1), (1, 5), (5, 2), (3, 6), (6, 2)), build(spark, (1, 2, 3, 4, 1), (1, 5), (5, 2), (2, 6), (6, 3))
    assert morph.isomorphism(a, b)[0] == "not_isomorphic"
    rng = random.Random(1)
    p = list(range(1, 11))
    rng.shuffle(p)
    to = dict(zip(range(1, 11), p, strict=True))
    moved = [(to[s], to[d]) for s, d in PETERSEN]
    verdict, found = isomorphism(to, PETERSEN, to, moved)
    assert verdict == "isomorphic" and {(found[s], found[d]) for s, d in PETERSEN} == set(moved)
    assert isomorphism(to, PETERSEN, to, moved, 1)[0] == "undecided"
    assert isomorphism([1, 2, 3, 4, 5, 6], [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4)], [1, 2, 3, 4, 5, 6], [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 1)])[0] == "not_isomorphic"
    assert morph.isomorphism(generate.fan_in(spark, 5), generate.fan_out(spark, 5))[0] == "not_isomorphic"


def test_homeomorphism(spark):
    one, two, other = (build(spark, *x) for x in ([(1, 2, 3, 1), (3, 4, 5, 6)], [(1, 2, 3, 4, 1), (4, 5, 6)], [(1, 2, 3, 1), (3, 4), (4, 5, 6, 4)]))
    assert morph.homeomorphic(one, two) == "isomorphic" and morph.homeomorphic(one, other) == "not_isomorphic"


def both_ways(g):
    return g.add_frames(edges=g.transpose().edges)


def test_repository(spark):
    g32, g41 = (both_ways(build(spark, *x)) for x in ([(1, 2, 3, 1), (3, 4, 5)], [(1, 2, 3, 4, 1), (4, 5)]))
    r = repository.Repository.new(spark).add(g32.rename("g32"), g32.rotate().rename("turned"), g41.rename("g41"))
    assert r.n_graphs() == 3 and r.n_classes("iso") == 2 and r.n_classes("homeo") == 1
    names = lambda df: {x["graph_id"] for x in df.collect()}
    assert names(r.query(g32)) == {"g32", "turned"} and names(r.query(g32, "homeo")) == {"g32", "turned", "g41"}
    assert names(r.query(generate.wheel(spark, 5))) == set()
    assert names(r.exemplars()) == {"g32", "g41"}


def test_all_graphs(spark):
    r = repository.all_graphs(spark, 4, connected=False)
    assert (r.n_graphs(), r.n_classes("iso"), r.n_classes("homeo")) == (64, 11, 11)
    r = repository.all_graphs(spark, 4)
    assert (r.n_classes("iso"), r.n_classes("homeo")) == (6, 6)


class Rounds(Control):
    """A control of one's own, from the four callbacks alone: a queue, roots from the largest id down."""

    def init(self, near):
        super().init(near)
        self.waiting, self.roots = deque(), iter(sorted(near, reverse=True))

    def push(self, vertex, vertices):
        new = [(x, vertex, 0 if vertex is None else 1) for x in vertices if x not in self.seen]
        self.seen.update(x for x, _, _ in new)
        self.waiting.extend(new)
        return bool(new)

    def pop(self):
        return self.waiting.popleft() if self.waiting else None


def test_own_control(spark):
    g = build(spark, (1, 3), (1, 2), (2, 4), (6, 5))
    got = traverse.traverse(g, lambda near: Order(), "pos long, id long", "strong", Rounds()).orderBy("pos").collect()
    assert [r["id"] for r in got] == [6, 5, 4, 3, 2, 1]
    got = traverse.traverse(g, lambda near: Order(), "pos long, id long", "strong", Rounds(), 1).orderBy("pos").collect()
    assert [r["id"] for r in got] == [1, 2, 3, 4, 6, 5]
    with pytest.raises(ValueError):
        Rounds.select_root(type("Held", (), {"near": {}})(), 7)


def test_ranges(spark, monkeypatch):
    """Running totals and next ids over several ranges."""
    from wayloom.functions import ranges

    monkeypatch.setattr(ranges, "RANGE", 7)
    rng = random.Random(3)
    items = [(k, rng.randint(0, 9)) for k in rng.sample(range(1, 500), 60)]
    got = ranges.running(spark.createDataFrame(items, "k long, v long"), ["k"], "v").collect()
    assert {r["k"]: r["total"] for r in got} == {k: sum(v for j, v in items if j <= k) for k, _ in items}
    ids = sorted(k for k, _ in items)
    g = build(spark, *ids)
    assert dict(g.next_ids().collect()) == dict(zip(ids, ids[1:] + ids[:1], strict=True))
    f = traverse.forest(g, "weak", ids[5])
    assert [r["id"] for r in traverse.preorder(f).collect()] == [ids[5], *ids[:5], *ids[6:]]


def test_groups_of_one_key(spark, monkeypatch):
    """Many graphs of one key: groups first, then their exemplars; the same classes."""
    whole = repository.all_graphs(spark, 4, connected=False)
    monkeypatch.setattr(repository, "GROUP", 3)
    parts = repository.all_graphs(spark, 4, connected=False)
    classes = lambda r: sorted(map(tuple, r.classes.collect()))
    assert classes(whole) == classes(parts) and whole.n_classes() == 11
