import random

import pytest

from brightloom.operators.order import load_order, strong_components


def by_hand(edges):
    """Components by reachability, layers by recursion."""
    edges = {(a, b) for a, b in edges if a is not None and b is not None}
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for k in nodes:  # Warshall
        reach[k] |= {b for a, b in edges if a == k}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    component = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    outer = {(component[a], component[b]) for a, b in edges if component[a] != component[b]}
    layer = {}

    def of(c):
        if c not in layer:
            layer[c] = 1 + max((of(b) for a, b in outer if a == c), default=-1)
        return layer[c]

    return {n: (c, of(c)) for n, c in component.items()}


def ordered(spark, edges):
    return {r.node: (r.component, r.layer) for r in load_order(spark.createDataFrame(edges, "src string, dst string")).collect()}


def test_literals(spark):
    assert ordered(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "x"), ("a", None), (None, "q"), ("a", "b")]) == {"a": ("a", 2), "b": ("b", 1), "c": ("b", 1), "d": ("d", 0), "x": ("x", 0)}
    assert ordered(spark, []) == {}


def test_diamond_and_two_cycles(spark):
    edges = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "a2"), ("a2", "a3"), ("a3", "c"), ("c", "z1"), ("z1", "z2"), ("z2", "z1")]
    assert ordered(spark, edges) == by_hand(edges)


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n = 24
    edges = [(f"{rnd.randrange(n):02}", f"{rnd.randrange(n):02}") for _ in range(n + 8 * seed)]
    assert ordered(spark, edges) == by_hand(edges)


def test_components_alone(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)]
    got = {r.node: r.component for r in strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
