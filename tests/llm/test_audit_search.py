"""Filter audit and ranked search against brute force."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import types as T

from storyflow.llm import filter_audit, lexical

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.LongType()), T.StructField("toxic", T.LongType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


# filter audit

def test_galloping_lists_equal_sets():
    rng = random.Random(3)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.3 and lists:
            lists.append(lists[0])
        assert filter_audit.union(lists) == sorted(set().union(*lists))
        a, b = sorted(rng.sample(range(60), 30)), sorted(rng.sample(range(60), rng.randint(0, 60)))
        assert filter_audit.difference(a, b) == sorted(set(a) - set(b))
        x, at = rng.randint(0, 60), rng.randint(0, 30)
        assert filter_audit.gallop(a, at, x) == next((k for k in range(at, 30) if a[k] >= x), 30)


def brute_audit(rows, labels):
    """(part, order, step) -> counts, by applying every order to every row."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in range(2))
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = smallest.get(t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": first is not None and (i is None or i > first)}
        docs.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: tuple(v) + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def audited(spark, documents, rows, labels):
    docs = documents([(i, t, lang, "s") for i, t, lang in rows]).withColumnRenamed("source", "fails").withColumnRenamed("n_chars", "part")
    got = filter_audit.filter_audit(docs.repartition(3), spark.createDataFrame(labels, LABELS))
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}


def corpus(seed, n=90):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["LOUD", "SHOUT", "a&b", "50%"]
    some = [" ".join(rng.sample(words, 110)), "", None, "short text", " \t\n", "x" * 5, " ".join(["again"] * 120), "ÄÖ É 😀 TEXT"]
    rows = [(rng.choice([k, k, k // 2, None]), rng.choice(some + [" ".join(rng.choices(words, k=rng.choice([20, 130])))]), rng.choice(["en", "de", None, ""])) for k in range(n)]
    labels = [(rng.choice([k, None]), rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, n, 2)] + [(2, 1, 0), (2, 0, 1)]
    return rows + rows[:4], labels


@pytest.mark.parametrize("seed,size", [(0, 1 << 16), (1, 7)])
def test_audit_equals_brute_force(spark, documents, monkeypatch, seed, size):
    monkeypatch.setattr(filter_audit, "RANGE", size)
    rows, labels = corpus(seed)
    assert audited(spark, documents, rows, labels) == brute_audit(rows, labels)


def test_audit_of_one_copied_text_and_of_no_rows(spark, documents):
    rows = [(k, "same words " * 60, "en") for k in range(300)] + [(1000, " ".join(f"w{k}" for k in range(120)), "de")]
    got = audited(spark, documents, rows, [(5, 1, 1)])
    assert got == brute_audit(rows, [(5, 1, 1)])
    assert len(got) == 1200 and got["de", "ABCDE", 5][0] == 1
    assert audited(spark, documents, [], []) == {}


def test_posting_ranges_are_bounded_and_whole(spark, documents, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE", 10)
    rows = filter_audit.failures(documents([(7, "text", "en", "s")] * 95))
    lists = filter_audit.posting_lists(rows, 5).collect()
    assert sum(r.n for r in lists) == 95 and max(r.n for r in lists) == 10
    assert all(r.failing[0] == list(range(r.n)) and r.failing[4] == [] for r in lists)


# ranked search

def brute_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(rows, items, k=10):
    docs = [(i, brute_terms(t)) for i, t in rows]
    n_docs, total = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in docs:
            tf, m, score = Counter(w), 10 + 90 * len(w) * n_docs // max(1, total), 0
            for t in set(brute_terms(text)):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, documents, rows, items, **more):
    got = lexical.search(documents(rows).withColumnRenamed("lang", "n").withColumnRenamed("source", "terms").repartition(3), spark.createDataFrame(items, ITEMS), **more)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed,block,few,terms", [(0, 8192, 48, 200_000), (1, 16, 0, 200_000), (2, 50, 3, 12)])
def test_search_equals_brute_force(spark, documents, monkeypatch, seed, block, few, terms):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "FEW", few)
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "été", "x_y", "A-B", "日本", "Z9"]
    weights = [1 / (1 + k) for k in range(len(words))]
    rows = [(rng.choice([k, None, 7]), " ".join(rng.choices(words, weights, k=rng.randint(0, 30)))) for k in range(300)] + [(900, None), (901, "..."), (7, "w39 w38")]
    items = [(k, " ".join(rng.sample(words, rng.randint(1, 12)))) for k in range(12)] + [(3, "w39 W38 w38"), (None, "w1"), (50, None), (51, "nowhere"), (52, "")]
    assert found(spark, documents, rows, items, block_terms=terms) == brute_search(rows, items)


def test_search_ties_copies_long_texts_and_no_rows(spark, documents, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 1000)
    rows = [(k, "same passage here") for k in range(400)] + [(5000, "passage " + "filler words " * 20_000 + "x" * 5000 + " here"), (5001, "clean")]
    items = [(1, "the same passage"), (2, "xx here")]
    got = found(spark, documents, rows, items)
    assert got == brute_search(rows, items)
    assert [r[2] for r in sorted(r for r in got if r[0] == 1)] == list(range(10))
    assert found(spark, documents, [], items) == [] and found(spark, documents, rows, []) == []


def test_pieces_end_with_terms():
    raw = ("ab, cdé " * 50 + "z" * 90).encode()
    assert [t for p in lexical.pieces(raw, 7) for t in lexical.terms_of(p)] == lexical.terms_of(raw)
