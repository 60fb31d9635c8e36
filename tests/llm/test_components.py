import random

import pytest

from caselight.llm import components as C


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs_and_paths(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1300)]
    edges += [(5, 5), (None, 3), (2000, 2001), (2000, 2001), (2001, 2000)] + [(3000, 3000 + i) for i in range(1, 200)]
    label = {v: v for e in edges if None not in e and e[0] != e[1] for v in e}
    for _ in range(len(label)):
        new = dict(label)
        for a, b in edges:
            if a in label and b in label and a is not None and b is not None:
                new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert dict(map(tuple, C.connected_components(df).collect())) == label


def test_no_edges(spark):
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
