"""Top-k search and source mixing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyflow.llm import mixing, topk


def brute(ids, vectors, q_ids, queries, k):
    out = []
    for i, q in zip(q_ids, queries):
        ranked = sorted((-int(q @ v), int(d)) for d, v in zip(ids, vectors) if d != i)[:k]
        out += [(int(i), n + 1, d, -s) for n, (s, d) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("low", [0, -4])
@pytest.mark.parametrize("scale", [1, 1 << 27])
def test_shards_equal_brute_force(low, scale):
    rng = np.random.default_rng(3)
    for _ in range(40):
        n, m, d, k = int(rng.integers(0, 60)), int(rng.integers(1, 6)), int(rng.integers(1, 9)), int(rng.integers(1, 6))
        x, q = rng.integers(low, 5, (n, d)) * scale, rng.integers(low, 5, (m, d))
        x[rng.random((n, d)) < 0.4] = 0
        ids, q_ids = rng.permutation(90)[:n], rng.permutation(90)[:m]
        shards = [topk.Shard(ids[a : a + 11], x[a : a + 11]) for a in range(0, n, 11)]
        row, vec, score = topk.best_of(q_ids, q, shards, k)
        got = sorted(zip(q_ids[row].tolist(), vec.tolist(), score.tolist()))
        assert got == [(a, c, s) for a, _, c, s in sorted(brute(ids, x, q_ids, q, k), key=lambda r: (r[0], r[2]))]


def test_top_k_with_ties_nulls_and_ragged_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 7)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "RUN", 2)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(v) for v in rng.integers(-3, 4, 4) / 256]) for i in range(60)]
    vectors += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(100, 130)]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan"), 0.0, 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").repartition(5)
    v = df.select(F.col("vec_id").alias("id"), topk.integers("embedding").alias("v"))
    got = sorted(map(tuple, topk.top_k(v, v.where("id % 10 = 0"), 5).collect()))
    ids = np.array([i for i, _ in vectors])
    x = np.floor(256 * np.array([e for _, e in vectors])).astype(int)
    assert got == brute(ids, x, ids[ids % 10 == 0], x[ids % 10 == 0], 5)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
    ragged = spark.createDataFrame([(1, [1]), (2, [1, 5]), (3, [])], "id long, v array<long>")
    assert sorted(map(tuple, topk.top_k(ragged, ragged.where("id = 2")).collect())) == [(2, 1, 1, 1), (2, 2, 3, 0)]


def shares(sizes, weights=(5, 2, 1), times=3):
    """Targets by resharing the excess source by source."""
    total, names = sum(sizes), range(len(sizes))
    w = [weights[i % 3] for i in names]
    full = set()
    while True:
        rest = total - sum(times * sizes[i] for i in full)
        free = sum(w[i] for i in names if i not in full)
        if not free:
            return [float(times * s) for s in sizes]
        more = {i for i in names if i not in full and rest / free * w[i] >= times * sizes[i]}
        if not more:
            return [float(times * sizes[i]) if i in full else rest / free * w[i] for i in names]
        full |= more


def test_mix_reaches_its_targets(spark, documents):
    rng = np.random.default_rng(0)
    rows = [(k, "w " * int(rng.integers(0, 300)), "en", ["a", "b", "c", "d", None][int(rng.integers(0, 5))]) for k in range(300)]
    rows += [(400 + k, "v " * 40, "en", "hot") for k in range(300)] + [(900, "tiny one", "en", "z"), (901, None, "en", "n"), (902, "", None, "b")]
    docs = documents(rows).repartition(4)
    plan, pieces = mixing.mix(docs, block=256)
    got = mixing.taken(plan, pieces).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t, _, s in rows:
        by.setdefault((s is None, s or ""), []).append(len((t or "").split()))
    names = sorted(by)
    want = shares([sum(by[n]) for n in names])
    sources = {r.doc_id: (r.target, r.source_size) for r in got}
    for n, target in zip(names, want):
        ids = [i for i, _, _, s in rows if (s is None, s or "") == n]
        assert all(sources[i][0] == pytest.approx(target) and sources[i][1] == sum(by[n]) for i in ids)
        assert abs(sum(r.taken for r in got if r.doc_id in set(ids)) - target) <= 1
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    again = {r.doc_id: r.taken for r in mixing.taken(*mixing.mix(docs.repartition(2), block=256)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_slots_follow_the_shares_at_every_length(spark):
    goals = spark.createDataFrame([(0, 50_000), (1, 30_000), (2, 20_000), (3, 1), (4, 0)], "source_no long, words long")
    slots = sorted(mixing.schedule(goals, 100).collect(), key=lambda r: r.slot)
    order = [r.source_no for r in slots if r.slot < 1000]
    for n in (10, 100, 500, 1000):
        assert abs(order[:n].count(0) - n / 2) <= 4 and abs(order[:n].count(2) - n / 5) <= 4
    assert [r.nth_of_source for r in slots if r.source_no == 1] == list(range(order.count(1)))
    assert sum(r.source_no == 3 for r in slots) >= 1 and not any(r.source_no == 4 for r in slots)


def test_pieces_fill_each_block_and_no_more(spark, documents):
    docs = documents([(k, "w " * (k % 50), "en", "ab"[k % 2]) for k in range(100)])
    rows, pieces = mixing.mix(docs, block=64)
    sizes = [r[0] for r in pieces.groupBy("slot").agg(F.sum("n_words")).select("sum(n_words)").collect()]
    assert max(sizes) - min(sizes) <= 16 and sum(sizes) == pytest.approx(sum(k % 50 for k in range(100)), abs=2)
    bounds = pieces.join(rows, "row").where("from_word < 0 OR n_words <= 0 OR from_word + n_words > size")
    assert bounds.count() == 0


def test_mixed_rows_and_empty_tables(spark, documents):
    docs = documents([(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, None, None), (3, "d e f g", "de", "t")])
    docs = docs.withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "copies")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {1, 3}
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.taken(*mixing.mix(docs.limit(0))).count() == 0
