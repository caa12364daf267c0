import os
import random

import pytest

from slovotok.llm import packing


def brute(sizes, capacity):
    """Remaining room of each container: every item goes to the fullest container that holds it, the earliest kind of tie."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in room if r >= s]
        if fits:
            room[room.index(min(fits))] -= s
        else:
            room.append(capacity - s)
    return sorted(room)


def test_best_fit_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([1, 2, 5, 16, 100, 257])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 50))]
        room = {}
        for s, c in zip(sizes, packing.best_fit_decreasing(sizes, capacity), strict=True):
            room[c] = room.get(c, capacity) - s
        assert sorted(room.values()) == brute(sizes, capacity)


def test_nothing_is_lost_or_cut_needlessly(spark):
    rng = random.Random(2)
    n = {i: rng.choice([0, rng.randint(1, 300), 5000, 512]) for i in range(500)}
    counts = spark.createDataFrame([*n.items(), (7, n[7] or 3), (None, 9)], "key bigint, n_tokens bigint")
    rows = packing.pack(counts, [(1, 512), (2, 256), (3, 0), (4, None)], containers=20).collect()
    assert {r["window_id"] for r in rows} == {1, 2}
    for w, c in ((1, 512), (2, 256)):
        mine = [r for r in rows if r["window_id"] == w]
        held = {}
        for r in mine:
            held[r["container_id"]] = held.get(r["container_id"], 0) + r["n_tokens"]
        assert max(held.values()) <= c
        for i, size in n.items():
            if i == 7:
                continue
            pieces = sorted((r["piece"], r["start_token"], r["n_tokens"]) for r in mine if r["key"] == i)
            assert sum(p[2] for p in pieces) == size
            assert [p[1] for p in pieces] == [c * k for k in range(len(pieces))] and (size > c or len(pieces) <= 1)
        assert sum(r["n_tokens"] for r in mine if r["key"] is None) == 9


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "key bigint, n_tokens bigint"), [(1, 10)]).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZERS), reason="no tokenizer files")
@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    df = spark.createDataFrame([(1, "Короткий текст <|endoftext|>", "x"), (2, "", "x"), (3, None, "x"), (1, "Короткий текст <|endoftext|>", "x")], "doc_id bigint, text string, n_tokens string")
    got = sorted((r["key"], r["n_tokens"]) for r in packing.token_counts(df, name=name).collect())
    assert [k for k, _ in got] == [1, 1, 2] and got[0] == got[1] and got[0][1] > 4 and got[2][1] == 0


def test_result_does_not_depend_on_partitions_and_copies_are_packed(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 300)) for i in range(3000)] + [(7, 50)] * 25_000
    counts = spark.createDataFrame(rows, "key bigint, n_tokens bigint")
    a, b = (sorted(map(tuple, packing.pack(counts.repartition(n), [(1, 512), (2, 64)]).collect())) for n in (1, 5))
    assert a == b and sum(r[5] for r in a if r[0] == 1) == sum(n for _, n in rows)


def test_shards_are_large_enough_for_every_capacity(spark):
    rng = random.Random(5)
    rows = [(i, min(2000, int(rng.lognormvariate(5, 1)) + 1)) for i in range(20_000)]
    windows = [(c, c) for c in (256, 512, 1024, 2048)]
    packed = packing.pack(spark.createDataFrame(rows, "key bigint, n_tokens bigint"), windows)
    assert packed.selectExpr("shiftright(container_id, 32) as s").distinct().count() > 2
    assert all(r["fill"] > 0.996 for r in packing.fill_report(packed, windows).collect())
