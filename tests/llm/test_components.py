"""Connected components against a union-find."""

import random

import pytest

from plumbline.llm.components import components


@pytest.mark.parametrize("links", [
    [],
    [(1, 1)],
    [(i, i + 1) for i in range(60)],
    [(100, i) for i in range(50)],
    [(1, i) for i in range(2, 50)] + [(i, 1) for i in range(2, 50)],
    [(random.Random(4).randrange(200), random.Random(i).randrange(200)) for i in range(90)],
    [(random.Random(i).randrange(300), random.Random(i + 999).randrange(300)) for i in range(200)],
])
def test_components(spark, links):
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        least[max(x, y)] = min(x, y)
    expected = {x: root(x) for link in links if link[0] != link[1] for x in link}
    df = spark.createDataFrame(links, "a long, b long")
    rows = [(r["id"], r["component"]) for r in components(df).collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == expected
