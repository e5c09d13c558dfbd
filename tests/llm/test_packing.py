import random

import numpy as np

from marlstone.llm.packing import SumOfSquares, fill, packed


def test_each_step_has_the_least_sum_of_squares():
    rng, p = random.Random(3), SumOfSquares(60)
    for _ in range(400):
        size = rng.randint(1, 60)
        before = p.count.copy()

        def after(gap):
            n = before.copy()
            if gap < 60:
                n[gap] -= 1
            if gap - size:
                n[gap - size] += 1
            return int((n[:60] ** 2).sum())

        open_gaps = [g for g in range(size, 60) if before[g]] + [60]
        p.place(size)
        assert int((p.count[:60] ** 2).sum()) == min(map(after, open_gaps))
    assert (p.count >= 0).all() and p.count.sum() == sum(map(len, p.open)) and np.isfinite(p.count).all()


def test_assignment(spark):
    rng = random.Random(5)
    rows = [(k, "é" * rng.randint(0, 80) + "a", None, "x") for k in range(400)] + [(1000, None, None, "y"), (1001, "", None, "y"), (1002, "ab", 100, "y"), (1003, "b" * 1000, None, "y"), (1004, "c" * 50, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens bigint, bin string")
    caps = spark.createDataFrame([(1, 50), (2, 100), (2, 100)], "window_id bigint, n_ctx bigint")
    out = packed(docs, caps, shard_pieces=60)
    got = out.collect()
    size = {r[0]: r[2] if r[2] is not None else len((r[1] or "").encode()) for r in rows}
    for w, cap in ((1, 50), (2, 100)):
        mine = [r for r in got if r["window_id"] == w]
        total, bins = {}, {}
        for r in mine:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["size"]
            bins[r["bin"]] = bins.get(r["bin"], 0) + r["size"]
        assert total == {d: n for d, n in size.items() if n}
        assert max(bins.values()) <= cap
        assert {r["doc_id"] for r in mine if r["n_pieces"] > 1} == {d for d, n in size.items() if n > cap}
        # At most a few windows more than the tokens need.
        assert len(bins) <= sum(size.values()) / cap * 1.1 + 1
    assert {r["window_id"]: r["used"] > 0.85 for r in fill(out, caps).collect()} == {1: True, 2: True}
    assert packed(docs.limit(0), caps).count() == 0 and packed(docs, caps.limit(0)).count() == 0
