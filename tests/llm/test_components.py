"""Connected components: rounds that end with stars, and components that grow by more links."""

import random

from bridgerec.llm.components import connected_components, merged_components
from bridgerec.llm.staging import Stage


class Counted(Stage):
    """A stage that keeps the names of its tables."""

    def __init__(self, spark):
        super().__init__(spark, "t")
        self.names = []

    def write(self, df, name):
        self.names.append(name)
        return super().write(df, name)


def by_hand(links):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return sorted((x, top(x)) for x in list(root))


def frame(spark, links):
    return spark.createDataFrame(links, "a long, b long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stars_take_no_round(spark):
    stage = Counted(spark)
    links = [(1, 5), (1, 6), (2, 9), (9, 2), (7, 7)]
    assert rows(connected_components(frame(spark, links), stage)) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)]
    assert stage.names == ["components-0"]


def test_chains_cycles_and_nulls(spark):
    links = [(k, k + 1) for k in range(40)] + [(50, 51), (51, 52), (52, 50), (-3, 60), (60, 61)]
    got = rows(connected_components(frame(spark, [*links, (None, 3), (4, None)]), Stage(spark, "t")))
    assert got == by_hand(links)


def test_merged_is_the_components_of_all_links(spark):
    rng = random.Random(5)
    stage = Counted(spark)
    for k in range(2):
        first = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
        more = [(rng.randrange(90), rng.randrange(90)) for _ in range(20)]
        first, more = ([x for x in some if x[0] != x[1]] for some in (first, more))
        found = stage.write(connected_components(frame(spark, first), stage, f"a{k}"), f"f{k}")
        assert rows(merged_components(found, frame(spark, more), stage, f"b{k}")) == by_hand(first + more)
    before = len(stage.names)
    assert rows(merged_components(found, frame(spark, []), stage, "none")) == by_hand(first)
    assert len(stage.names) == before
