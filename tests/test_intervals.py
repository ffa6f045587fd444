import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociflow.operators import intervals as I

SCENARIOS = [
    ([(100, 200)], [(150, 160)], [(150, 160)], 11),
    ([(300, 400)], [(250, 350)], [(300, 350)], 51),
    ([(100, 155), (155, 200), (300, 400), (500, 600)], [(150, 160), (250, 350), (550, 650), (650, 750)], [(150, 160), (300, 350), (550, 600)], 113),
    ([(990130, 990630), (1020346, 1022346)], [(989819, 989939), (990162, 990402)], [(990162, 990402)], 241),
]


def frame(spark, regions, chrom="1"):
    return spark.createDataFrame([(chrom, b, e) for b, e in regions], "chrom string, beg int, end int")


@pytest.mark.parametrize("a, b, both, size", SCENARIOS)
def test_intersection(spark, rows, a, b, both, size):
    found = I.intersect(I.collapse(frame(spark, a)), I.collapse(frame(spark, b)))
    assert rows(found) == sorted((("1", x, y) for x, y in both), key=repr)
    assert I.total_length(found).first()["bases"] == size
    assert I.same_regions(found, frame(spark, both))


def test_touching_pieces(spark, rows):
    a, b = frame(spark, [(1, 4)]), frame(spark, [(4, 6)])
    assert rows(I.intersect(a, b)) == []
    assert rows(I.intersect(a, b, touching=True)) == [("1", 4, 4)]


def merged(regions):
    out = []
    for b, e in sorted(regions):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(x) for x in out]


@settings(max_examples=8, deadline=None)
@given(seed=st.integers(0, 10**6))
def test_algebra_against_sets(spark, seed):
    rng = random.Random(seed)
    span = rng.choice([200, 3_000_000])
    make = lambda: [(b, b + rng.choice([0, 1, 5, span // 20])) for b in (rng.randrange(span) for _ in range(rng.randint(0, 60)))]
    a, b = make(), make()
    get = lambda df: sorted((r.beg, r.end) for r in df.collect())
    ca, cb = I.collapse(frame(spark, a)), I.collapse(frame(spark, b))
    assert get(ca) == merged(a)
    assert get(I.union(frame(spark, a), frame(spark, b))) == merged(a + b)
    cross = [(max(x[0], y[0]), min(x[1], y[1])) for x in merged(a) for y in merged(b)]
    assert get(I.intersect(ca, cb)) == sorted(c for c in cross if c[0] < c[1])
    points = [rng.randrange(span + 50) for _ in range(50)]
    df = spark.createDataFrame([(i, "1", p) for i, p in enumerate(points)], "id int, chrom string, pos int")
    inside = {i for i, p in enumerate(points) if any(x <= p <= y for x, y in a)}
    assert {r.id for r in I.in_regions(df, frame(spark, a)).collect()} == inside
    assert {r.id for r in I.in_regions(df, frame(spark, a), inside=False).collect()} == set(range(50)) - inside
    marks = [rng.randrange(span) for _ in range(10)]
    reach = rng.choice([3, span // 10])
    said = {r.id: (r.left_pos, r.right_pos) for r in I.nearest(df, spark.createDataFrame([("1", m) for m in marks], "chrom string, pos int"), "id", reach).collect()}
    for i, p in enumerate(points):
        left = max((m for m in marks if p - reach <= m <= p), default=None)
        right = min((m for m in marks if p < m <= p + reach), default=None)
        assert said[i] == (left, right)


def test_edges(spark, rows):
    none = spark.createDataFrame([], "chrom string, beg int, end int")
    assert rows(I.collapse(none)) == []
    assert rows(I.collapse(spark.createDataFrame([(None, 1, 2), ("1", None, 2), ("1", 5, 5), ("1", 5, 5)], none.schema))) == [("1", 5, 5)]
    assert I.total_length(none).first()["bases"] == 0
    with pytest.raises(Exception, match="ends before it begins"):
        I.total_length(frame(spark, [(5, 3)])).collect()
    windows = spark.createDataFrame([("w", "1", 0, 99), ("v", "2", 0, 99)], "name string, chrom string, beg int, end int")
    got = {r.name: (r.overlap, r.ok) for r in I.covered(windows, frame(spark, [(0, 50), (60, 99)]), "name", 0.88).collect()}
    assert got == {"w": (89, True), "v": (0, False)}
