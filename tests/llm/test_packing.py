import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzbar.llm import packing
from quartzbar.llm.packing import best_fit, pack, packing_report, still_open

DOCS = "doc_id long, text string, lang string, bin long, part int"
LIMITS = "limit_id int, tokenizer string, capacity_tokens int, part int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60))
def test_best_fit(sizes):
    where, fill = best_fit(sizes, 30)
    assert all(f <= 30 for f in fill) and len(where) == len(sizes)
    assert [sum(s for s, b in zip(sizes, where) if b == k) for k in range(len(fill))] == fill
    assert sum(2 * f <= 30 for f in fill) <= 1  # what the hierarchy rests on
    opened = still_open(fill, 30)
    assert len(opened) <= packing.KEEP + 1 and {b for b, f in enumerate(fill) if 2 * f <= 30} <= opened


def table(spark, texts, parts):
    return spark.createDataFrame([(i, t, None, 7, 7) for i, t in enumerate(texts)], DOCS).repartition(parts)


def check(rows, capacity, n_docs):
    by_bin, by_doc = {}, {}
    for r in rows:
        by_bin[r.container_id] = by_bin.get(r.container_id, 0) + r.n_tokens
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start_token, r.n_tokens))
    assert max(by_bin.values()) <= capacity and len(by_doc) == n_docs
    for pieces in by_doc.values():
        pieces.sort()
        total = sum(n for _, _, n in pieces)
        assert [s for _, s, _ in pieces] == [sum(n for _, _, n in pieces[:k]) for k in range(len(pieces))]
        assert len(pieces) == 1 or total > capacity
        assert all(n == capacity for _, _, n in pieces[:-1])
    return by_bin


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_whole_items_little_waste(spark, parts):
    rng = random.Random(parts)
    texts = ["bar " * rng.choice([0, 1, 3, 20, 70, 150, 400]) for _ in range(400)] + [None, "", " "]
    limits = spark.createDataFrame([(1, "byte_bpe_50k", 128, 9), (2, "piece_bpe_32k", 64, 9)], LIMITS)
    got = pack(table(spark, texts, parts), limits).collect()
    for limit, capacity in ((1, 128), (2, 64)):
        rows = [r for r in got if r.limit_id == limit]
        bins = check(rows, capacity, len(texts))
        total = sum(bins.values())
        assert len(bins) <= -(-total // capacity) * 1.02 + 2


def test_small_rests_of_all_partitions_meet(spark):
    texts = ["a b c d"] * 64  # every partition alone leaves a container nearly empty
    rows = pack(table(spark, texts, 64), spark.createDataFrame([(1, "byte_bpe_50k", 64, 0)], LIMITS)).collect()
    bins = check(rows, 64, 64)
    assert len(bins) == -(-sum(bins.values()) // 64)


def test_empty_and_refused(spark):
    limits = spark.createDataFrame([(1, "byte_bpe_50k", 64, 0)], LIMITS)
    assert pack(table(spark, [], 2), limits).count() == 0
    nothing = pack(table(spark, [None, "", None], 2), limits).collect()
    assert len(nothing) == 3 and {r.n_tokens for r in nothing} == {0} and len({r.container_id for r in nothing}) == 1
    for bad in (0, None):
        with pytest.raises(ValueError):
            pack(table(spark, ["x"], 1), spark.createDataFrame([(1, "byte_bpe_50k", bad, 0)], LIMITS))


def test_exact_multiple_leaves_no_rest(spark):
    df = spark.createDataFrame([(1, " bar" * 128, None, 0, 0), (1, " bar" * 128, None, 0, 0)], DOCS)
    rows = pack(df, spark.createDataFrame([(1, "byte_bpe_50k", 64, 0)], LIMITS)).collect()
    assert sorted((r.piece, r.n_tokens) for r in rows) == [(0, 64), (0, 64), (1, 64), (1, 64)] and len({r.container_id for r in rows}) == 4


def test_report(spark):
    r = packing_report(table(spark, ["bar " * 40] * 10, 4), spark.createDataFrame([(1, "byte_bpe_50k", 100, 0)], LIMITS)).first()
    assert r.containers >= r.least_containers and 0 <= r.unused_share < 1


def test_what_is_handed_on_costs_no_container(monkeypatch):
    """The tree with the bins it keeps against one that hands on all of them."""
    rng = random.Random(8)
    for capacity, draw in ((512, lambda: min(512, int(rng.lognormvariate(4.6, 1.0)))), (2048, lambda: min(2048, int(rng.lognormvariate(5.6, 1.2)))), (100, lambda: rng.randrange(1, 101)), (64, lambda: rng.choice([1, 2, 33, 40]))):
        parts = [[draw() for _ in range(400)] for _ in range(20)]
        used = []
        for keep, near in ((packing.KEEP, packing.NEARLY_FULL), (10**9, 0.0)):
            monkeypatch.setattr(packing, "KEEP", keep)
            monkeypatch.setattr(packing, "NEARLY_FULL", near)
            closed, groups = 0, parts
            while True:
                handed = []
                for g in groups:
                    _, fill = packing.best_fit(g, capacity)
                    opened = packing.still_open(fill, capacity)
                    closed += len(fill) - len(opened)
                    handed.append([fill[b] for b in opened])
                if len(groups) == 1:
                    used.append(closed + len(handed[0]))
                    break
                groups = [sum(handed[i : i + packing.FAN_IN], []) for i in range(0, len(handed), packing.FAN_IN)]
            monkeypatch.undo()
        assert used[0] <= used[1] * 1.001 + 1
