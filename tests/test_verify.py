import random

from metaweave.operators import components as X
from metaweave.operators import validate as V


def test_thinned_links_join_the_same_nodes(spark, rows, monkeypatch):
    draw = random.Random(2)
    links = spark.createDataFrame([(f"n{draw.randrange(300)}", f"n{draw.randrange(300)}") for _ in range(2000)] + [("a", "b"), ("b", "c"), ("d", "d"), (None, "e")], "u string, v string")
    few = X.thinned(links.coalesce(2))
    assert few.count() <= 2 * 303
    assert rows(X.star_components(few)) == rows(X.star_components(links))


def test_reverses_are_compared_without_a_join(spark):
    e = lambda made: spark.createDataFrame(made, "src string, dst string, weight double")
    plain = [("a", "b", 1.0), ("b", "a", 1.0), ("a", "c", 2.0), ("d", "b", 1.0), ("b", "d", 3.0), ("f", "f", 1.0), ("g", "h", None), ("h", "g", 1.0)]
    assert V._both_ways(e(plain), 0.001) == {"duplicates": 0, "asymmetric": 4}
    assert V._both_ways(e(plain + [("a", "b", 5.0)]), 0.001) == {"duplicates": 1, "asymmetric": 6}
    assert V._both_ways(e([]), 0.001) == {"duplicates": 0, "asymmetric": 0}
