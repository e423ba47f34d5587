"""Personal data: patterns, tagger, windows, whole texts."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from storyflow.llm import pii
from storyflow.llm.tagger import Tagger, allowed, best_path


def brute_spans(text):
    """The contract's patterns as they are written."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        twice = [x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d[::-1])]
        if 13 <= len(d) <= 19 and sum(twice) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


def check_digit(digits):
    return next(digits + str(k) for k in range(10) if pii.luhn(digits + str(k)))


def speech(rng):
    """A text with some personal data in it."""
    word = lambda: "".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 7)))
    figures = lambda k: "".join(rng.choices("0123456789", k=k))
    kinds = [lambda: f"{word()}.{figures(2)}@{word()}{figures(1)}.example.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
             lambda: check_digit("4" + figures(14)), lambda: f"+1 ({rng.randint(200, 999)}) 555-{figures(4)}"]
    words = [word() for _ in range(rng.randint(20, 60))]
    if rng.random() < 0.7:
        words.insert(rng.randint(0, len(words)), rng.choice(kinds)())
    else:
        words.insert(rng.randint(0, len(words)), rng.choice([f"token{figures(6)}", f"20{figures(2)}-01-12", figures(5)]))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [speech(rng) for _ in range(700)]


@pytest.fixture(scope="module")
def model(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    return pii.fit(docs)


# patterns

def test_patterns_equal_the_contract_on_odd_texts():
    rng = random.Random(4)
    for alphabet in ("a@.b", "1.2@ -", "+1 ()5-.", "0123456789", "4929 -", "é1@a.😀"):
        for _ in range(1500):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
            assert pii.pattern_spans(text) == brute_spans(text), text
    for text in ("a@b.c@d.e", "@b.c@d.e", "a@b.c_d@e.f", "x@y", "a@b..c", "001.002.3.0255", "1.2.3.4.5.6.7.8", "+1--23", "4111 1111-1111 1111", "٣@a.b"):
        assert pii.pattern_spans(text) == brute_spans(text), text


def test_patterns_take_linear_time():
    begun = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "@a.b " * 80_000, "a@" * 200_000, "+1" + " " * 400_000, "1.1." * 100_000, "1-" * 200_000, "(" * 400_000):
        pii.pattern_spans(text)
        list(itertools.islice(pii.stretches(text), 10))
    assert time.time() - begun < 20


# tagger

def small():
    rng = np.random.default_rng(0)
    model = Tagger(2, 7).start(1, embed=3, hidden=4, dtype=np.float64)
    model.params["follow"][:] = rng.normal(size=model.params["follow"].shape)
    return model, rng.integers(0, 7, (3, 5)), np.array([[0, 1, 2, 2, 0], [3, 4, 0, 1, 1], [0, 0, 0, 3, 0]])


def test_gradients_equal_differences():
    model, ids, tags = small()
    _, grads = model.loss(ids, tags)
    for name, value in model.params.items():
        for flat in range(0, value.size, max(1, value.size // 9)):
            at = np.unravel_index(flat, value.shape)
            held, both = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = held + step
                both.append(model.loss(ids, tags)[0])
            value[at] = held
            assert abs((both[0] - both[1]) / 2e-5 - grads[name][at]) < 1e-6, name


def test_marginals_and_best_path_equal_all_paths():
    model, ids, _ = small()
    e = model.emissions(ids)
    prob, log_all, *_ = model.marginals(e)
    follow, may = model.params["follow"], allowed(2)
    for n in range(len(ids)):
        total, each, best = 0.0, np.zeros_like(e[:, n]), (-np.inf, None)
        for path in itertools.product(range(5), repeat=5):
            if not may[-1, path[0]] or not all(may[a, b] for a, b in zip(path, path[1:])):
                continue
            w = np.exp(follow[-1, path[0]] + sum(follow[a, b] for a, b in zip(path, path[1:])) + sum(e[t, n, k] for t, k in enumerate(path)))
            total += w
            each[np.arange(5), path] += w
            best = max(best, (sum(np.log(prob[t, n, k] + 1e-300) for t, k in enumerate(path)), path))
        assert np.allclose(np.log(total), log_all[n]) and np.allclose(each / total, prob[:, n])
        assert tuple(best_path(np.log(prob[:, n] + 1e-300), 2)) == best[1]


def test_windows_cover_a_stretch_and_agree_on_it():
    for length in (1, 63, 64, 65, 200):
        w, starts = pii.windows(np.arange(1, length + 1))
        assert starts[0] == 0 and w.shape == (len(starts), pii.WIDTH) and (np.diff(starts) <= pii.STEP).all()
        assert set(range(1, length + 1)) <= set(w.ravel().tolist())
        p = np.full((len(starts), pii.WIDTH, 9), 1 / 9)
        assert np.allclose(np.exp(pii.reconciled(p, starts, length)), 1 / 9)


def test_spans_apart():
    spans = [(0, 5, 9, 0.9), (1, 8, 12, 0.8), (2, 12, 14, 0.7), (3, 20, 24, 0.6)]
    assert pii.apart(spans, [(22, 30), (0, 5)]) == [spans[0], spans[2]]


# the whole

def test_the_model_adds_rewritten_forms_of_texts_it_has_not_seen(corpus, model):
    rng, draw = random.Random(77), np.random.default_rng(3)
    asked = hit = 0
    for _ in range(400):
        text = speech(rng)
        spans = pii.pattern_spans(text)
        new, marks = pii.lesson(text, spans, draw)
        base = pii.pattern_spans(new)
        got = pii.added([new], [base], model)[0]
        asked += len(marks)
        hit += sum(m in base or any(g[:3] == m for g in got) for m in marks)
        assert all(any(g[1] < z and a < g[2] for _, a, z in marks) for g in got), (new, got)
    assert asked > 200 and hit / asked >= 0.85


def test_clean_texts_are_left_alone(model):
    clean = ["no figures at all " * 50, "at (noon) we met", "version 4.0 of 2024-01-02 10:20:30, ISBN 978-3-16-148410-0", "card 4111 1111 1111 1112", "300.1.2.3 and 12,345,678"]
    assert pii.added(clean, [pii.pattern_spans(t) for t in clean], model) == [[]] * len(clean)


def test_whole_texts_windows_and_rows(spark, corpus, model):
    new = "write to kolo.12 (at) mira3.example.com today "
    far = "blank words only " * 30_000 + new + "more of it " * 1000 + "mail me@here.org"
    rows = [(1, None), (2, ""), (2, new), (None, new), (3, far), (4, "😀é " + new), (5, "7 " * 5000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = [(r.doc_id, [(s.kind, s.start, s.end, s.base) for s in r.spans]) for r in pii.find(docs.repartition(2), model).collect()]
    by = dict((i, s) for i, s in got if i not in (2, None))
    at = new.index("kolo")
    span = ("email", at, at + len("kolo.12 (at) mira3.example.com"), False)
    assert sorted(s for i, s in got if i == 2) == [[], [span]] and [s for i, s in got if i is None] == [[span]]
    assert by[1] == [] and by[5] == [] and by[4] == [("email", at + 3, span[2] + 3, False)]
    first = far.index("kolo")
    assert by[3] == [("email", first, first + span[2] - at, False), ("email", len(far) - 11, len(far), True)]
    redacted = {r.doc_id: r.text for r in pii.redact(docs.where("doc_id IN (1, 3, 4)"), model).collect()}
    assert redacted[1] is None and redacted[4] == "😀é write to <email> today " and redacted[3].endswith("mail <email>")
    assert pii.redact(docs, model).columns == docs.columns


def test_a_stretch_longer_than_one_piece(corpus, model, monkeypatch):
    text = "x 1 " * 700 + "write to kolo.12 (at) mira3.example.com today " + "1 y " * 700
    whole = pii.added([text], [[]], model)
    monkeypatch.setattr(pii, "LONGEST", 500)
    parts = pii.added([text], [[]], model)
    assert [s[:3] for s in parts[0]] == [s[:3] for s in whole[0]] and len(whole[0]) == 1


def test_base_spans_stay_without_a_model_and_on_no_rows(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs, None).withColumn("said", pii.written(pii.F.col("spans"))).collect()}
    for k, text in enumerate(corpus):
        said = ",".join(f"{pii.KINDS[kind]}:{a}:{z}" for kind, a, z in brute_spans(text))
        assert got[k].said == said and hashlib.sha256(said.encode())
    assert pii.fit(docs.limit(0)) is None and pii.find(docs.limit(0), None).count() == 0
    assert pii.fit(spark.createDataFrame([(1, "no data 12")], "doc_id long, text string")) is None


def test_the_fit_does_not_depend_on_rows_and_copies(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus[:80])), "doc_id long, text string")
    assert pii.sample(docs) == pii.sample(docs.unionAll(docs).repartition(3))
