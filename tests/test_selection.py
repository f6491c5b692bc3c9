import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stayline.learning.split import held_out_sizes, stratified_split
from stayline.operators import selection
from stayline.operators.ordering import keys_at_places
from stayline.operators.segments import value_segment
from stayline.operators.selection import Found, Target, values_at_ranks

LARGE = random.Random(9)
VALUES = {
    "ties": ("long", [LARGE.choice([0, 0, 0, 5, LARGE.randrange(90)]) for _ in range(5000)]),
    "sixty_bits": ("long", [LARGE.randrange(1 << 60) for _ in range(5000)] + [(1 << 60) - 1, (1 << 60) - 2, 0]),
    "whole_range": ("long", [-(1 << 63), (1 << 63) - 1, (1 << 63) - 2, -1, 0, 1, *[LARGE.randrange(-(1 << 63), 1 << 63) for _ in range(300)]]),
    "close": ("long", [(1 << 59) + i // 3 for i in range(3000)]),
    "one": ("int", [7]),
    "few": ("int", [3, 1, 2, None, 2]),
    "equal": ("long", [(1 << 58) + 1] * 400),
    "doubles": ("double", [LARGE.choice([-1, 1]) * 10.0 ** LARGE.uniform(-300, 300) for _ in range(2000)] + [0.0, -0.0, float("inf"), -float("inf"), 5e-324]),
    "alike": ("double", [1.0 + i * 2.0**-52 for i in range(700)] + [None] * 9),
    "cents": ("decimal(18,2)", [Decimal(LARGE.randrange(-(10**17), 10**17)) / 100 for _ in range(900)] + [Decimal("0.01"), Decimal("0.02")]),
    "wide": ("decimal(38,10)", [Decimal(10) ** 27 + Decimal(i) / 10**10 for i in range(300)]),
}


@pytest.mark.parametrize("name, few, buckets", [*[(name, 20, 64) for name in VALUES], ("ties", 20_000, 4096), ("doubles", 20_000, 4096), ("sixty_bits", 0, 4096)])
def test_ranks_equal_those_of_a_plain_sort(spark, name, few, buckets, monkeypatch):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    kind, values = VALUES[name]
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(5)
    kept = sorted(v for v in values if v is not None)
    n = len(kept)

    def ranks(share):
        return lambda n: (max(1, int(n * share)), min(n, int(n * share) + 1))

    targets = [Target(str(share), F.col("v"), ranks(share)) for share in (0.0, 1 / 3, 0.5, 1.0)]
    found = values_at_ranks(df, [*targets, Target("none", F.lit(None).cast(kind), lambda n: (1,))])
    assert "none" not in found
    for t in targets:
        want = [Found(kept[r - 1], sum(v < kept[r - 1] for v in kept), kept.count(kept[r - 1]), n) for r in t.ranks(n)]
        assert found[t.name] == want


def test_other_types_and_ranks_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "v int, s string")
    with pytest.raises(TypeError, match="string"):
        values_at_ranks(df, [Target("s", F.col("s"), lambda n: (1,))])
    with pytest.raises(ValueError, match="rank outside"):
        values_at_ranks(df, [Target("v", F.col("v"), lambda n: (2,))])
    assert values_at_ranks(df, []) == {} and values_at_ranks(df.where("false"), [Target("v", F.col("v"), lambda n: (1,))]) == {}


@pytest.mark.parametrize("n", [0, 1, 4, 300])
def test_thirds_with_a_third_on_one_amount(spark, n):
    rows = [(f"a{i:04d}", None if i % 6 == 0 else 0 if i % 3 == 0 else i * 37 % 101) for i in range(n)]
    df = spark.createDataFrame(rows, "account_id string, mrr_amount int").repartition(3)
    got = {r.account_id: r.value_segment for r in value_segment(df).collect()}
    for place, (key, _) in enumerate(sorted(rows, key=lambda r: (r[1] or 0, r[0]))):
        want = "Low Value" if 3 * place < n - 1 else "Mid Value" if 3 * place < 2 * (n - 1) else "High Value"
        assert got[key] == want, (n, place, key)


def test_keys_at_places(spark):
    df = spark.createDataFrame([(f"k{i % 50:02d}", i % 2) for i in range(100)], "k string, side int").repartition(4)
    got = keys_at_places(df, "k", {"all": (F.lit(True), 5), "odd": (F.col("side") == 1, 5), "last": (F.col("side") == 0, 50)})
    assert got == {"all": "k02", "odd": "k05", "last": "k48"} and keys_at_places(df, "k", {}) == {}


@pytest.mark.parametrize("counts", [(1, 1), (2, 3), (3, 1), (7, 6), (0, 1), (1, 400)])
def test_small_classes_are_split(spark, counts):
    rows = [(f"{label}-{i}", label) for label, n in enumerate(counts) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, label int")
    want = {r.label: r.test for r in held_out_sizes(df).collect()}
    drawn = stratified_split(df, "key").collect()
    assert len(drawn) == len(rows)
    assert {label: sum(r.is_test for r in drawn if r.label == label) for label in want} == want
