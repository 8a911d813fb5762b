import random
from collections import Counter

import pytest

from quillgraph.llm import packing


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(8))
def test_fixed_sets_dominate(seed):
    """What is fixed never costs a container: the fixed sets and the best packing of the rest are a best packing."""
    r = random.Random(seed)
    fixed_sets = 0
    for _ in range(150):
        c = r.choice([20, 30, 50, 100])
        items = [r.randint(1, c) if r.random() < 0.5 else r.randint(c // 4, c // 2) for _ in range(r.randint(1, 9))]
        left = dict(Counter(items))
        fixed = packing.reduce_instance(left, c)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert Counter(rest) + Counter(s for sizes, n in fixed for s in sizes for _ in range(n)) == Counter(items)
        assert all(sum(sizes) <= c for sizes, _ in fixed)
        assert sum(n for _, n in fixed) + optimum(rest, c) == optimum(items, c)
        fixed_sets += sum(n for _, n in fixed)
    assert fixed_sets > 100


@pytest.mark.parametrize("capacity,items,wrong", [(200, [100, 75, 75, 45, 30, 30, 30], (100, 75)), (30, [21, 11, 11, 8, 3, 3, 3], (21, 8))])
def test_three_small_items_may_beat_a_partner(capacity, items, wrong):
    assert wrong not in [sizes for sizes, _ in packing.reduce_instance(dict(Counter(items)), capacity)]


def test_plan_does_not_grow_with_the_corpus():
    base = Counter(min(2047, int(random.Random(i).lognormvariate(5.2, 1))) or 1 for i in range(20_000))
    few, many = (len(packing.plan_containers({s: n * m for s, n in base.items()})[0]) for m in (100, 10**7))
    assert many < 1.2 * few


def test_buckets_do_not_matter(spark):
    rows = [(i, "a " * (3 + i % 5) if i % 3 else "word " * 5000) for i in range(300)]
    counted = packing.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"))
    loads = []
    for buckets in (1, 7, None):
        out = packing._assign(counted, packing.CAPACITY, buckets).collect()
        load = Counter()
        for r in out:
            load[r["container"]] += r["tokens"]
        assert max(load.values()) <= packing.CAPACITY and len({(r["doc_id"], r["piece_no"]) for r in out}) == len(out)
        loads.append(sorted(load.values()))
    assert loads[0] == loads[1] == loads[2]
