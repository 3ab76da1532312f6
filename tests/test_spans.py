"""Sorted sets of spans against brute force, and that many mentions take no quadratic time."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from veilspark.functions import spans
from veilspark.operators import resolve
from veilspark.storage import written

SPAN = "struct<s: int, e: int>"


def kept(rows):
    out = []
    for s, e in rows:
        if not any(s < k[1] and e > k[0] for k in out):
            out.append((s, e))
    return sorted(out)


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(3)
    rows = [(i, [(s := rng.randrange(80), s + rng.randrange(1, rng.choice([3, 20, 60]))) for _ in range(rng.choice([0, 1, 2, 9, 40]))]) for i in range(300)]
    return rows, spark.createDataFrame(rows, f"id int, x array<{SPAN}>")


def plain(rows):
    return [tuple(x) for x in rows]


def test_each_is_kept_unless_it_overlaps(drawn):
    rows, df = drawn
    got = {r["id"]: plain(r["y"]) for r in df.select("id", F.expr(spans.apart("transform(x, (o, i) -> named_struct('s', o.s, 'e', o.e, 'i', i))", "struct<s: int, e: int, i: int>", "l.i - r.i")).alias("y")).collect()}
    assert {i: [o[:2] for o in y] for i, y in got.items()} == {i: kept(x) for i, x in rows}


def test_running(drawn):
    rows, df = drawn
    got = {r["id"]: r["y"] for r in df.select("id", F.expr(spans.running("transform(x, o -> o.e)", "greatest(__x, __b)")).alias("y")).collect()}
    assert got == {i: list(itertools.accumulate([e for _, e in x], max)) for i, x in rows}


def test_groups(spark):
    df = spark.createDataFrame([([(1, 1), (1, 2), (3, 3), (4, 4), (4, 5)],), ([],)], "x array<struct<k: int, v: int>>")
    one, none = df.select(F.expr(spans.let("y", "x", spans.groups("y", "k"))).alias("g")).collect()
    assert [[v for _, v in g] for g in one["g"]] == [[1, 2], [3], [4, 5]] and none["g"] == []


def test_blocking_with_many_spans(spark):
    rng = random.Random(4)
    candidates = [[(s := rng.randrange(300), s + rng.randrange(1, 12)) for _ in range(rng.randrange(1, 5))] for _ in range(60)]
    used, want = [], []
    for c in candidates:
        free = [o for o in c if not any(o[0] < u[1] and o[1] > u[0] for u in used)]
        used += free
        want += [free] if free else []
    one = "named_struct('p', 1, 'cat', 'ort', 't', 'x', 'conf', 1D, 'src', 'rule', 'occ', 1, 'offs', offs, 'review', false, 'feats', cast(map() AS map<string, string>))"
    df = spark.createDataFrame([(candidates,)], f"c array<array<{SPAN}>>")
    got = df.select(F.expr(f"transform({resolve.block_sql(f'transform(c, offs -> cast({one} AS {resolve.CANDIDATE}))')}, c -> c.offs)").alias("y")).first()["y"]
    assert [plain(o) for o in got] == want


def test_twenty_thousand_mentions(spark):
    """Conflicts and blocking of 20,000 mentions in one text, a third of which overlap others."""
    n = 20_000
    place = f"cast(pmod(xxhash64(i), {n}) * 10 + i % 3 * 4 AS int)"
    entity = f"named_struct('f', named_struct('t', concat('e', i), 'norm', '', 'ident', '', 'low', '', 'titled', false), 'cat', 'ort', 'conf', 0.9D, 'src', 'rule', 'occ', 1, 'offs', array(named_struct('s', {place}, 'e', {place} + 6)), 'review', false, 'feats', cast(map() AS map<string, string>))"
    df = written(spark.range(1).select(F.expr(f"transform(sequence(1, {n}), i -> {entity})").alias("cc")), "mentions")
    block = "transform({}, c -> cast(named_struct('p', 1, 'cat', c.cat, 't', c.f.t, 'conf', c.conf, 'src', c.src, 'occ', 1, 'offs', c.offs, 'review', c.review, 'feats', c.feats) AS " + resolve.CANDIDATE + "))"
    blocked = written(df.select(F.expr(block.format("cc")).alias("bb")), "mentions")
    took = []
    for _ in range(2):
        began = time.time()
        one = df.select(F.expr(f"size({resolve.resolve_sql('cc')})")).first()[0]
        two = blocked.select(F.expr(f"size({resolve.block_sql('bb')})")).first()[0]
        took.append(time.time() - began)
    assert one > n / 2 and two > n / 2 and took[1] < 8, took
