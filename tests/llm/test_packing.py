import random

import pytest

from transloom.llm import packing
from transloom.llm.packing import CAPACITY, TOKENIZER, TOKENIZER_DIR, best_pattern, pack, pack_sizes, plan_containers

SCHEMA = "doc_id long, n_tokens long"


def valid(rows, sizes, capacity):
    """Every text covered once, in order, cut only if longer than a container, and no container over its capacity."""
    fill, pieces = {}, {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r["size"]
        pieces.setdefault(r.doc_id, []).append((r.offset, r["size"]))
    assert max(fill.values(), default=0) <= capacity
    for doc, n in sizes.items():
        at = 0
        assert len(pieces[doc]) == max(1, -(-n // capacity))
        for offset, size in sorted(pieces[doc]):
            assert offset == at
            at += size
        assert at == n
    assert set(pieces) == set(sizes)
    return fill


@pytest.mark.parametrize("bucket", [7, 200_000])
def test_valid_and_nearly_full(spark, bucket):
    rng = random.Random(2)
    sizes = {i: int(rng.lognormvariate(5, 1.1)) for i in range(3000)} | {5000 + i: 100 for i in range(1500)} | {9000: 0, 9001: CAPACITY, 9002: CAPACITY + 1, 9003: 20 * CAPACITY}
    rows = pack_sizes(spark.createDataFrame(list(sizes.items()), SCHEMA), bucket_rows=bucket).collect()
    fill = valid(rows, sizes, CAPACITY)
    assert sum(fill.values()) / (CAPACITY * len(fill)) > 0.99
    assert set(fill) == set(range(len(fill)))


@pytest.mark.parametrize("sizes", [{}, {1: 0}, {1: 1}, {i: 1025 for i in range(9)}, {i: 7 for i in range(1000)}, {1: 2047, 2: 2, 3: 2048}])
def test_corner_sizes(spark, sizes):
    rows = pack_sizes(spark.createDataFrame(list(sizes.items()), SCHEMA)).collect()
    fill = valid(rows, sizes, CAPACITY)
    if all(v == 1025 for v in sizes.values()) and sizes:
        assert len(fill) == 9


def test_pattern_is_the_best():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(3, 25), 4, replace=False))
        supply, prices = rng.integers(0, 4, 4), rng.random(4)
        counts = best_pattern(prices, sizes, supply, 40)
        assert (counts <= supply).all() and (counts * sizes).sum() <= 40
        best = max(sum(c * p for c, p in zip(x, prices)) for x in itertools.product(*(range(s + 1) for s in supply)) if sum(c * s for c, s in zip(x, sizes)) <= 40)
        assert abs((counts * prices).sum() - best) < 1e-9


def test_optimal_where_a_perfect_packing_exists():
    plan = plan_containers({700: 300, 648: 300, 1348: 50, 1000: 80, 1048: 80})
    assert plan.containers <= plan.lower_bound * 1.02 + 1


def test_every_container_is_of_a_pattern_of_the_program(monkeypatch):
    rng = random.Random(5)
    sizes, made = {}, []
    for _ in range(2500):
        size = min(2048, max(1, int(rng.lognormvariate(5.2, 1.2))))
        sizes[size] = sizes.get(size, 0) + 1
    solve = packing.solve_program

    def kept(*args):
        found = solve(*args)
        made.append(found)
        return found

    monkeypatch.setattr(packing, "solve_program", kept)
    plan = plan_containers(sizes)
    assert sum(max(1, int(x)) for found in made for _, x in found) + sizes.get(2048, 0) >= plan.containers and plan.containers <= plan.lower_bound * 1.01 + 1


def test_texts_are_measured_whole(spark):
    texts = [(1, "One two, three."), (2, None), (3, ""), (None, "x y"), (4, "long text " * 9000), (4, "again")]
    rows = pack(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    encode = packing._encoding(f"{TOKENIZER_DIR}/{TOKENIZER}").encode_ordinary
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r["size"]
    assert total == {1: len(encode(texts[0][1])), 2: 0, 3: 0, None: len(encode("x y")), 4: len(encode(texts[4][1])) + len(encode("again"))}
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
