"""Edit scripts against all mappings of small trees."""

import itertools
import random

import pytest

from meshwright.operators import tree_edit as T


def fit(want, kind, path, content):
    return (0.0 if want[-1] == path[-1] else 0.4) + (0.0 if kind == content else 0.5)


def alike(want, path):
    return 0.0 if want[-1] == path[-1] else 0.6


def random_tree(rng, depth=0):
    names = rng.sample("abcd", rng.randint(1, 2 + (depth == 0)))
    return tuple(
        T.Node(n, children=random_tree(rng, depth + 1)) if depth < 2 and rng.random() < 0.35 else T.Node(n, rng.choice("xy")) for n in names
    )


def brute(target, source):
    t, s = T._Tree(target), T._Tree(source)
    nodes_t = [("o", i) for i in range(1, len(t.paths))] + [("l", i) for i in range(len(t.leaves))]
    nodes_s = [("o", i) for i in range(1, len(s.paths))] + [("l", i) for i in range(len(s.leaves))]
    best = float("inf")
    for size in range(min(len(nodes_t), len(nodes_s)) + 1):
        for left in itertools.combinations(nodes_t, size):
            for right in itertools.permutations(nodes_s, size):
                if any(a[0] != b[0] for a, b in zip(left, right)):
                    continue
                image = {0: 0, **{a[1]: b[1] for a, b in zip(left, right) if a[0] == "o"}}
                cost = (len(nodes_t) - size) * T.DELETE + (len(nodes_s) - size) * T.ADD
                for (kind, i), (_, j) in zip(left, right):
                    above = t.parents[i] if kind == "o" else t.leaves[i][2]
                    while above not in image:
                        above = t.parents[above]
                    lies = s.parents[j] if kind == "o" else s.leaves[j][2]
                    cost += T.MOVE * s.apart(image[above], lies)
                    cost += alike(t.paths[i], s.paths[j]) if kind == "o" else fit(*t.leaves[i][:2], *s.leaves[j][:2])
                best = min(best, cost)
    return best


def test_cost_is_the_least_of_all_mappings():
    rng = random.Random(4)
    for _ in range(60):
        a, b = (T.Node("", children=random_tree(rng)) for _ in range(2))
        while sum(len(x) for x in (T._Tree(a).leaves, T._Tree(a).paths)) > 6 or sum(len(x) for x in (T._Tree(b).leaves, T._Tree(b).paths)) > 6:
            a, b = (T.Node("", children=random_tree(rng)) for _ in range(2))
        assert T.edit_script(a, b, fit, alike).cost == pytest.approx(brute(a, b))


def test_every_operation():
    x = lambda n: T.Node(n, "x")
    before = T.Node("", children=(x("kept"), x("gone"), T.Node("in", children=(x("p"), x("q"))), T.Node("old", children=(x("r"), x("s")))))
    after = T.Node("", children=(x("kept"), T.Node("in", children=(x("p"),)), x("q"), T.Node("fresh", children=(x("r"), x("s"))), T.Node("more", "z")))
    steps = set(T.edit_script(before, after, lambda a, k, b, c: 2.0 if k != c else fit(a, k, b, c), alike).steps)
    assert steps >= {("keep", ("kept",), ("kept",)), ("delete", ("gone",), ()), ("add", (), ("more",)), ("move", ("in", "q"), ("q",)), ("rename", ("old",), ("fresh",)), ("keep", ("old", "r"), ("fresh", "r"))}


def test_same_trees_cost_nothing():
    rng = random.Random(9)
    for _ in range(20):
        tree = T.Node("", children=random_tree(rng))
        script = T.edit_script(tree, tree, fit, alike)
        assert script.cost == 0 and {op for op, _, _ in script.steps} == {"keep"}
