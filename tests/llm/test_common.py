import random

import pytest

from corvine.llm import common


def reach(edges):
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return label


@pytest.mark.parametrize("shape", ["path", "comb", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "path": [(k, k + 1) for k in range(60)],
        "comb": [(k, 1000 - k) for k in range(40)] + [(k + 1, 1000 - k) for k in range(40)],  # every node a smallest or a largest one
        "star": [(500, k) for k in range(50)] + [(500, 500), (900, 901)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "none": [(7, 7)],
    }[shape]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.label for r in got} == reach(edges)
