"""Connected components against brute force, and how many links they are made from."""

import numpy as np
import pytest

from tidewater.llm import components


def brute(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


@pytest.mark.parametrize("few", [0, components.FEW])
@pytest.mark.parametrize("kind", ["long", "binary", "string"])
def test_components_equal_brute_force(spark, monkeypatch, few, kind):
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(components, "THINNED", 30)
    rng = np.random.default_rng(8)
    name = {"long": lambda x: int(x) - 200, "binary": lambda x: bytes([int(x) * 7 % 256, int(x) // 256]), "string": lambda x: f"é{x * 31 % 997}"}[kind]
    pairs = [(name(a), name(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(name(k), name(k + 1)) for k in range(400, 460)]
    edges = spark.createDataFrame([*pairs, (None, pairs[0][0]), (pairs[0][0], None)], f"a {kind}, b {kind}").repartition(5)
    found = components.components(edges).collect()
    plain = lambda x: bytes(x) if kind == "binary" else x
    assert len(found) == len({plain(r["node"]) for r in found})
    assert {plain(r["node"]): plain(r["root"]) for r in found} == brute(pairs)
    assert components.components(edges.filter("a is null")).collect() == []


def test_a_family_that_meets_often_is_few_links(spark, monkeypatch):
    """Its members behind another head in each of many pieces: links grow with the members, not with the pieces too."""
    edges = spark.createDataFrame([(k % 40, 40 + k // 40) for k in range(40 * 500)], "a long, b long").repartition(3)
    sizes, stash = [], components.stash
    monkeypatch.setattr(components, "stash", lambda df, label: (out := stash(df, label), sizes.append(out.count()))[0])
    assert {r["root"] for r in components.components(edges).collect()} == {0}
    assert max(sizes) < 3 * 540
