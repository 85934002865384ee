import random

import pytest
from pyspark.sql import functions as F

from telar.llm.packing import fill, occupancy, pack


def plain_best_fit(capacity, sizes):
    """Item by item: the same rules without a histogram."""
    left = sorted(sizes, reverse=True)
    large = [x for x in left if 3 * x > capacity]
    gaps = []
    while large:
        a = large.pop(0)
        b = next((x for x in large if x <= capacity - a), None)
        if b is not None:
            large.remove(b)
        gaps.append(capacity - a - (b or 0))
    for x in (x for x in left if 0 < 3 * x <= capacity):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps[gaps.index(min(fits))] -= x
        else:
            gaps.append(capacity - x)
    return sorted(gaps)


def dealt(capacity, sizes):
    counts = {}
    for x in sizes:
        counts[x] = counts.get(x, 0) + 1
    bins, runs = fill(capacity, counts)
    held, seen = [0] * bins, {}
    for size, a, b, first, each in runs:
        assert seen.get(size, 0) == a
        seen[size] = b
        for rank in range(a, b):
            held[first + (rank - a) // each] += size
    assert seen == counts
    return sorted(capacity - x for x in held)


@pytest.mark.parametrize("seed", range(40))
def test_histogram_filling_equals_item_by_item(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 12, 30, 100])
    sizes = [r.choice([r.randint(1, capacity), r.randint(1, 1 + capacity // 3), capacity // 2, capacity // 3]) for _ in range(r.randint(0, 120))]
    assert dealt(capacity, sizes) == plain_best_fit(capacity, sizes)


def test_empty_items_take_no_room():
    assert dealt(10, [0, 0, 0]) == [10]
    assert dealt(10, [0, 10, 0, 10]) == [0, 0]


def test_pack_keeps_all_and_holds_the_capacity(spark):
    sizes = [(i, n, "x") for i, n in enumerate([0, None, 5, 5, 5, 512, 513, 1, 100_000, 511, 3, -4] + [170] * 40)] + [(3, 5, "x"), (3, 5, "x")]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long, parte string")
    rows = pack(df, [512, 64]).collect()
    for capacity in (512, 64):
        own = [r for r in rows if r.max_tokens == capacity]
        held = {}
        for r in own:
            held[r.id_contenedor] = held.get(r.id_contenedor, 0) + r.n_tokens
        assert max(held.values()) <= capacity and sorted(held) == list(range(len(held)))
        want = sorted((i, j * capacity, min(capacity, max(n or 0, 0) - j * capacity)) for i, n, _ in sizes for j in range(max(1, -(-max(n or 0, 0) // capacity))))
        assert sorted((r.doc_id, r.desde_token, r.n_tokens) for r in own) == want
    summary = {r.max_tokens: r for r in occupancy(pack(df, [512, 64])).collect()}
    assert summary[512].tokens == sum(max(n or 0, 0) for _, n, _ in sizes) and summary[512].contenedores >= summary[512].cota_inferior


def test_pack_of_an_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long"), [512]).count() == 0


def test_one_size_for_all(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(171).alias("n_tokens"))
    bins = pack(df, [512]).groupBy("id_contenedor").count().collect()
    assert len(bins) == 2500 and {r["count"] for r in bins} == {2}
