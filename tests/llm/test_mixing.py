"""Source mixing: exact targets, coins that agree, odd tables."""

from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from salonlake.llm import mixing


def _targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Plain resharing with exact fractions: cap, share the excess, repeat."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - most * sum(sizes[s] for s in capped)
        goal = {s: Fraction(most * sizes[s]) if s in capped else max(Fraction(0), left * w[s] / sum(w[x] for x in free)) for s in names}
        above = {s for s in free if goal[s] > most * sizes[s]}
        if not above:
            return {s: float(g) for s, g in goal.items()}
        capped |= above


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 10, "c": 1000, "d": 7, None: 55}, {"a": 0, "b": 0}, {"a": 5}, {"é": 4, "z": 3, "Z": 2, "": 1, None: 0},
    {f"s{i}": (i * 7919) % 101 for i in range(40)}])
def test_targets_are_plain_resharing(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    assert got == pytest.approx(_targets(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_other_weights_and_a_share_beyond_all_caps(spark):
    table = spark.createDataFrame([("a", 10), ("b", 20)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(table, (1,), Fraction(5), 2).collect()}
    assert got == {"a": 20.0, "b": 40.0}
    got = {r.source: r.target for r in mixing.targets(table, (3, 1), Fraction(1, 2), 1).collect()}
    assert got == pytest.approx(_targets({"a": 10, "b": 20}, (3, 1), Fraction(1, 2), 1))


def test_mix_of_odd_rows(spark, make, odd):
    docs = make(odd, ids=[None, *range(len(odd) - 1)]).withColumns({"size": F.lit("x"), "copy": F.lit("y")})
    rows = mixing.planned(mixing.measured(docs)).collect()
    assert len(rows) == len(odd)
    assert {r.source_size for r in rows} == {sum(len((t or "").split()) for t in odd)}
    again = Counter((r.doc_id, r.text) for r in mixing.mixed(docs).collect())
    assert again == +Counter({(d, t): sum(r.copies for r in rows if (r.doc_id, r.text) == (d, t)) for d, t in {(r.doc_id, r.text) for r in rows}})
    assert all(0 <= r.copies <= 2 for r in rows)
    empty = make([])
    assert mixing.planned(mixing.measured(empty)).count() == 0 and mixing.mixed(empty).count() == 0


def test_taken_words_come_near_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i % 9), "hot" if i % 3 else f"s{i % 6}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (mixing.planned(mixing.measured(d)).select("doc_id", "source", "size", "copies", "target").collect()
                    for d in (docs, docs.repartition(7)))
    assert Counter(first) == Counter(again)
    for s in {r.source for r in first}:
        mine = [r for r in first if r.source == s]
        assert sum(r.size * r.copies for r in mine) == pytest.approx(mine[0].target, rel=0.1)
