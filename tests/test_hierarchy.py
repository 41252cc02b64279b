import random
from collections import deque

import pytest

from lociframe.operators import hierarchy as h
from lociframe.plans import Workspace, skew_join

SAMPLES = "iid string, father string, mother string, links int, `__salt` int, node string"


def brute(links):
    """Shortest distances upwards by breadth-first search from every node."""
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    out = {}
    for start in up:
        seen, todo = {}, deque((p, 1) for p in up[start])
        while todo:
            n, d = todo.popleft()
            if n in seen:
                continue
            seen[n] = d
            todo.extend((p, d + 1) for p in up.get(n, ()))
        out.update({(start, n): d for n, d in seen.items()})
    return out


def frame(spark, links):
    return spark.createDataFrame(links, "node string, parent string")


def random_pedigree(seed, n=120, cycles=6):
    r = random.Random(seed)
    links = [(f"n{k}", f"n{max(0, k - r.randint(1, 6))}") for k in range(1, n) for _ in range(r.choice([0, 1, 2]))]
    links += [(f"n{a}", f"n{r.randint(a, n)}") for a in r.sample(range(n), cycles)]
    return [x for x in links if x[0] != x[1]] + [("n3", "n3")]


@pytest.mark.parametrize(("seed", "one_in"), [(1, 4), (2, 2), (3, 1), (4, 10_000)])
def test_pairs_equal_breadth_first_search(spark, seed, one_in):
    links = random_pedigree(seed)
    got = {(r.node, r.ancestor): r.links for r in h.ancestor_pairs(frame(spark, links + links[:9]), one_in=one_in).collect()}
    assert got == brute(links)


def test_a_long_chain_and_a_long_cycle(spark):
    links = [(f"c{k}", f"c{k + 1}") for k in range(70)] + [(f"r{k}", f"r{(k + 1) % 25}") for k in range(25)]
    got = {(r.node, r.ancestor): r.links for r in h.ancestor_pairs(frame(spark, links)).collect()}
    assert got == brute(links) and got["c0", "c70"] == 70 and got["r3", "r3"] == 25


def test_cycles_without_splitter_come_from_the_walks(spark):
    links = [(f"r{k}", f"r{(k + 1) % 5}") for k in range(5)]
    for one_in, walked in ((1, 0), (1 << 40, 5)):
        walks, _ = h._solved(Workspace(spark, "test"), frame(spark, links), False, one_in)
        assert h.splitterless_cycles(walks, one_in).count() == walked
        assert {(r.node, r.cycle_links) for r in h.cycle_nodes(frame(spark, links), one_in).collect()} == {(f"r{k}", 5) for k in range(5)}


@pytest.mark.parametrize(("seed", "one_in"), [(5, 4), (6, 2), (7, 1), (8, 10_000)])
def test_shortest_cycles(spark, seed, one_in):
    links = random_pedigree(seed, 90, 9)
    got = [(r.node, r.cycle_links) for r in h.cycle_nodes(frame(spark, links + [(None, "n1"), ("n1", None)]), one_in).collect()]
    assert sorted(got) == sorted((n, d) for (n, a), d in brute(links).items() if n == a)
    assert h.cycle_nodes(frame(spark, [])).count() == 0


def test_keys_that_are_hot_on_both_sides(spark):
    left = spark.createDataFrame([(k % 3, f"a{k}") for k in range(60)] + [(None, "n")], "key int, a string")
    right = spark.createDataFrame([(k % 4, f"b{k}") for k in range(80)] + [(None, "n")], "key int, b string")
    got = skew_join(left, right, "key", hot_rows=10, spread_by="a", both="b")
    assert got.columns == ["key", "a", "b"] and sorted(map(tuple, got.collect())) == sorted((x % 3, f"a{x}", f"b{y}") for x in range(60) for y in range(80) if x % 3 == y % 4)


def test_paths_are_shortest_and_exact(spark):
    links = random_pedigree(7, n=60, cycles=3)
    truth, up = brute(links), set(links)
    for r in h.ancestor_pairs(frame(spark, links), paths=True).collect():
        assert r.links == truth[r.node, r.ancestor] == len(r.path)
        way = [r.node, *r.path]
        assert way[-1] == r.ancestor and all(step in up for step in zip(way, way[1:]))


def test_links_of_samples(spark):
    rows = [
        ("a", None, "0", 1, 1, "x"), ("b", "a", "a", 1, 1, "x"), ("b", "a", None, 1, 1, "x"), ("b", "c", ".", 1, 1, "x"), ("c", "nobody", "A", 1, 1, "x"),
        (None, "a", "b", 1, 1, "x"), ("0", "a", None, 1, 1, None), ("d", "0", "NA", 1, 1, None), ("NA", None, None, 1, 1, None), ("é", "b ", "é", 1, 1, None),
    ]
    got = {(r.node, r.parent) for r in h.parent_links(spark.createDataFrame(rows, SAMPLES)).collect()}
    assert got == {("b", "a"), ("b", "c"), ("0", "a"), ("é", "é")}


def test_nodes_paths_and_empty_tables(spark):
    links = frame(spark, [("b", "a"), ("c", "b"), ("c", "x"), ("q", "r"), ("r", "q"), (None, "a"), ("a", None)])
    clean = links.dropna()
    pairs = h.ancestor_pairs(links, paths=True)
    people = spark.createDataFrame([(n,) for n in ("a", "b", "c", "x", "q", "r", "alone", "alone", None)], "node string")
    got = {r.node: (r.n_ancestors, r.n_descendants, r.n_roots, r.depth, r.on_cycle) for r in h.hierarchy_nodes(people, pairs, clean).collect()}
    assert got == {"a": (0, 2, 1, 0, False), "b": (1, 1, 1, 1, False), "c": (3, 0, 2, 2, False), "x": (0, 1, 1, 0, False), "q": (2, 2, 0, None, True), "r": (2, 2, 0, None, True), "alone": (0, 0, 1, 0, False)}
    paths = {(r.node, r.root): r.path for r in h.root_paths(pairs, clean).collect()}
    assert paths == {("b", "a"): "a/b", ("c", "a"): "a/b/c", ("c", "x"): "x/c"}
    nothing = frame(spark, [])
    assert h.ancestor_pairs(nothing).count() == 0 and h.parent_links(spark.createDataFrame([], SAMPLES)).count() == 0
    assert h.hierarchy_nodes(people.limit(0), h.ancestor_pairs(nothing), nothing).count() == 0


def test_every_person_has_a_path_or_a_row_of_nulls(spark):
    links = frame(spark, [("b", "a"), ("c", "b"), ("c", "x"), ("q", "r"), ("r", "q"), ("s", "q"), ("t", "s"), ("t", "a")])
    people = spark.createDataFrame([(n,) for n in ("a", "b", "c", "x", "q", "r", "s", "t", "alone", "alone", None)], "node string")
    got = [tuple(r) for r in h.root_paths(h.ancestor_pairs(links, paths=True), links, people).collect()]
    assert sorted(got, key=str) == sorted(
        [("a", "a", 0, "a"), ("x", "x", 0, "x"), ("alone", "alone", 0, "alone"), ("b", "a", 1, "a/b"), ("c", "a", 2, "a/b/c"), ("c", "x", 1, "x/c"), ("t", "a", 1, "a/t")]
        + [(n, None, None, None) for n in ("q", "r", "s")],
        key=str,
    )
