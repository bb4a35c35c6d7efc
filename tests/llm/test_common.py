import random

from maskframe.llm import common


def test_components_are_those_of_a_search(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(4000, 4100)] + [(7, 7)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    for task_edges in (common.TASK_EDGES, 0):  # both ways
        got = {r["id"]: r["component"] for r in common.connected(spark.createDataFrame(edges, "a long, b long"), task_edges=task_edges).collect()}
        assert got == {x: top(x) for a, b in edges for x in (a, b) if a != b}
    assert common.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbering(spark):
    names = [f"n{i:03d}" for i in range(200)]
    df = spark.createDataFrame([(n,) for n in random.Random(1).sample(names, 200)], "s string")
    got = {r["s"]: r["rank"] for r in common.numbered(df, "s").collect()}
    assert got == {n: i for i, n in enumerate(names)}
    assert common.numbered(df.limit(0), "s").count() == 0
