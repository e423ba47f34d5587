"""Language, lines, near duplicates, pages and fingerprints on small fixtures."""

import random
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from storyflow.llm import fingerprints, language, line_dedup, near_dup, page_text
from storyflow.llm.common import bytes_of

WORDS = {"xa": ["kolo", "mira", "tano", "beku", "sari"], "yb": ["schrift", "wacht", "durch", "nacht", "recht"]}


def speech(lang, n, seed):
    return " ".join(random.Random(seed).choices(WORDS[lang], k=n))


# language

def test_language_is_learned_and_unknown_texts_are_und(spark, documents):
    rows = [(k, speech(lang, 20, k), lang, "s") for k, lang in enumerate(["xa", "yb"] * 60)]
    docs = documents(rows)
    model = language.fit(docs.where(~language.held_out()))
    odd = [(1000, None), (1001, ""), (1002, "123 !!! ***"), (1003, "KOLO MIRA"), (None, "schrift nacht"), (1004, "kolo mira " * 30000)]
    got = {r.doc_id: r for r in language.identify(documents(rows + odd), model).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(got[i].lang_pred == lang and got[i].score > 0.5 for i, _, lang, _ in rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "xa", "yb", "xa"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == 0
    again = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(documents(rows), language.fit(docs.repartition(3).where(~language.held_out()))).collect()}
    assert again == {i: (got[i].lang_pred, got[i].score) for i in again}


def test_texts_of_no_learned_language_are_rejected(spark, documents):
    rnd = random.Random(2)
    words = {lang: [w + rnd.choice(["", "s", "en", "a"]) for w in own for _ in range(3)] for lang, own in WORDS.items()}
    rows = [(k, " ".join(rnd.choices(words[lang], k=30)), lang) for k, lang in enumerate(["xa", "yb"] * 80)]
    docs = documents(rows)
    model = language.fit(docs)
    odd = ["これは日本語の文章です。今日は天気がいい" * 3, "Сегодня хорошая погода и мы пошли гулять " * 3, "Σήμερα ο καιρός είναι καλός " * 3, "qqqq zzzz xxkq wwqz " * 8]
    clean = ["KOLO MIRA", "schrift 123 nacht, recht!", "kolo mira tano beku sari " * 2000]
    more = documents([(1000 + k, t) for k, t in enumerate(odd + clean + ["123", "", None])])
    got = {r.doc_id: r.fits for r in language.identify(docs.unionByName(more), model, fits="fits").collect()}
    assert all(got[i] for i, _, _ in rows)
    assert [got[1000 + k] for k in range(10)] == [False] * 4 + [True] * 3 + [False] * 3


def test_nothing_to_learn(spark, documents):
    docs = documents([(1, "some text", None), (2, None, "xa")])
    got = language.identify(docs, language.fit(docs)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    assert language.identify(docs.limit(0), language.fit(docs.limit(0))).count() == 0


def test_copies_and_empty_texts_take_no_place_in_the_sample(spark, documents):
    copies = spark.range(100_000).selectExpr("id AS doc_id", "'kolo mira tano' AS text", "'xa' AS lang", "'s' AS source", "1L AS n_chars")
    blank = copies.selectExpr("doc_id", "if(doc_id % 2 = 0, NULL, '12 3') AS text", "'yb' AS lang", "source", "n_chars")
    rows = [(k, f"{speech('xa', 12, k)} {k}", "xa") for k in range(700)] + [(k, f"{speech('yb', 12, k)} {k}", "yb") for k in range(40)]
    docs = documents(rows).unionByName(copies).unionByName(blank)
    found = [(r.lang, r.key) for r in language.sample(docs).collect()]  # one window each, as all are short
    assert len(found) == len(set(found)) and Counter(lang for lang, _ in found) == {"xa": language.SAMPLE_ROWS, "yb": 40}


def test_prediction_does_not_depend_on_the_batch(spark, documents):
    model = language.fit(documents([(k, speech(lang, 20, k), lang) for k, lang in enumerate(["xa", "yb"] * 20)]))
    a, b = "kolo mira schrift", "recht durch é"
    together = model.predict(*bytes_of(pa.array([a, "", b])))
    for k, t in ((0, a), (2, b)):
        alone = model.predict(*bytes_of(pa.array([t])))
        assert alone[0][0] == together[0][k] and alone[1][0] == pytest.approx(together[1][k])


# lines

def brute_lines(rows, lines=3, words=50):
    """(id, n_lines, n_deleted, text) by looking every run up among all earlier ones."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, first, docs = [], {}, []
    for d, (_, t) in enumerate(order):
        parts = (t or "").split("\n")
        docs.append([(p, x) for p, x in enumerate(parts) if x.strip(" \t\r\x0b\x0c")])
    for d, kept in enumerate(docs):
        for a in range(len(kept)):
            for n in range(1, lines + 1):
                run = kept[a : a + n]
                if len(run) == n and (n == lines or sum(len(x.split()) for _, x in run) >= words):
                    key = tuple(x for _, x in run)
                    if key in first:
                        seen += [(d, p) for p, _ in run]
                    else:
                        first[key] = (d, run[0][0])
    gone, out = set(seen), []
    for d, (i, t) in enumerate(order):
        parts = (t or "").split("\n")
        n = sum((d, p) in gone for p in range(len(parts)))
        out.append((str(i), len(parts) if t else 0, n, None if t is None else "\n".join(x for p, x in enumerate(parts) if (d, p) not in gone)))
    return sorted(out, key=str)


def found_lines(docs):
    return sorted(((str(r.doc_id), r.n_lines, r.n_deleted, r.text) for r in line_dedup.dedup_lines(docs).collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_lines_equal_brute_force(spark, documents, seed):
    rng = random.Random(seed)
    some = ["one", "two words", "", "  ", "three of them", "x " * 60, "four", "y " * 30, "y " * 29 + "z", "five"]
    rows = [(k, "\n".join(rng.choices(some, k=rng.randint(0, 12)))) for k in rng.sample(range(1000), 60)] + [(None, "one\nfour\nfive\none"), (2000, None), (2001, "")]
    assert found_lines(documents(rows).repartition(3)) == brute_lines(rows)


def test_passage_shared_by_many_documents_stays_once(spark, documents):
    passage = "\n".join(f"line {c} of the passage" for c in string.ascii_lowercase[:6])
    rows = [(k, f"own start {k}\n{passage}\nown end {k}") for k in range(80)] + [(500, "all\nclean\nhere\nand there")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(rows)).collect()}
    assert got[0].n_deleted == 0 and got[500].n_deleted == 0
    assert all(got[k].text == f"own start {k}\nown end {k}" for k in range(1, 80))


def test_lines_of_repeated_rows_extra_columns_and_no_rows(spark, documents):
    docs = documents([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")]).withColumnRenamed("lang", "pos").withColumnRenamed("source", "gone")
    got = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(got.columns)
    assert sorted((r.doc_id, r.n_deleted, r.text) for r in got.collect()) == [(1, 0, "a\nb\nc"), (1, 0, "a\nb\nc"), (2, 3, "")]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# near duplicates

def brute_sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(rows):
    sets = [brute_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        name = min(ids) if ids and sets[k] else i
        out.append((str(i), len(sets[k]), str(name), i is not None and name == i))
    return sorted(out)


def chain(rng, n):
    """Texts of which each is the one before with a word changed."""
    w = [rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(w)
        w[rng.randrange(len(w))] = str(rng.random())
        out.append(" ".join(w))
    return out


def test_shingles_equal_brute_force():
    texts = ["", " \n", "One", "one two three four", "a b c d e", "a  b\tc\nd e f", "A B c d E f", "a b c d e a b c d e", "é à b c d", "x" * 3000 + " b c d e f"]
    sets = near_dup.shingle_sets(*bytes_of(pa.array(texts)))
    assert [len(s) for s in sets] == [len(brute_sets(t)) for t in texts]
    assert sets[5].tolist() == sets[6].tolist() and sets[4].tolist() != sets[7].tolist()
    alone = [near_dup.shingle_sets(*bytes_of(pa.array([t])))[0].tolist() for t in texts]
    assert alone == [s.tolist() for s in sets]


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(0)
    for share in (0.8, 0.9, 1.0):
        x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        same = int(2 * len(x) * share / (1 + share))
        y = np.concatenate([x[:same], rng.integers(0, 1 << 63, len(x) - same, dtype=np.uint64)])
        a, b = near_dup.odd_sketches(np.array([near_dup.samples(x), near_dup.samples(y)]))
        assert abs(near_dup.estimate(np.array([np.bitwise_count(a ^ b).sum()]))[0] - share) < near_dup.MARGIN


@pytest.mark.parametrize("block", [2048, 8])
def test_groups_equal_brute_force(spark, documents, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(block)
    rows = [(k, t) for k, t in enumerate(chain(rng, 40) + chain(rng, 3) + chain(rng, 12))]
    rows += [(100 + k, rows[5][1].upper()) for k in range(5)] + [(5, rows[5][1]), (200, None), (201, ""), (202, "  "), (None, rows[44][1]), (None, "short")]
    rows += [(300, "short"), (301, "Short "), (302, "other words here"), (None, "alone by itself")]
    got = near_dup.near_duplicates(documents(rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute_groups(rows)


def test_shared_members_equal_brute_force():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, size * 2, size).astype(np.uint64)) for size in (1, 5, 300, 20000, 30000, 30000)]
    a, b = np.array([(i, j) for i in range(6) for j in range(6) if i != j]).T
    assert near_dup.shared(sets, a, b).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert near_dup.shared([sets[0], sets[0] + np.uint64(9)], np.array([0]), np.array([1])).tolist() == [0]


def test_group_just_below_the_limit_writes_no_pairs(spark, documents, monkeypatch):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(150):  # four words changed, about 82 % of two such texts in common; every tenth is like the one before
        w = list(rows[-1][1].split()) if k % 10 == 9 else list(base)
        for place in rng.sample(range(400), 4):
            w[place] = f"x{k}y{place}"
        rows.append((k, " ".join(w)))
    wrote = []
    whole = near_dup._by_blocks
    monkeypatch.setattr(near_dup, "_by_blocks", lambda *args: wrote.append(whole(*args)) or wrote[-1])
    got = near_dup.near_duplicates(documents(rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute_groups(rows)
    assert wrote and wrote[1].count() < len(rows) and wrote[0].distinct().count() < 24 * len(rows)


def test_groups_of_no_rows_and_of_unlike_texts(spark, documents):
    assert near_dup.near_duplicates(documents([(1, "x")]).limit(0)).count() == 0
    got = near_dup.near_duplicates(documents([(1, "one two three four five six"), (2, "six five four three two one")])).collect()
    assert sorted((r.component_id, r.kept) for r in got) == [(1, True), (2, True)]


# pages

ARTICLE = "<article><h1>Head &amp; line</h1><p>Short one.<p>" + "text and more " * 30 + "<br>end</p><p>By <a href=x>someone</a>&nbsp;now</p></article>"
WANT = "Head & line Short one. " + "text and more " * 30 + "end By someone now"


@pytest.mark.parametrize("before,after", [
    ("<nav><a href=/>Home</a></nav>", "<footer>&copy; us</footer>"),
    ("<header><h1>The Site</h1>slogan</header><div id=cookie-banner>" + "we use cookies " * 80 + "</div>", "<aside>" + "related " * 90 + "</aside>"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>old</p> --><form><p>Search</p></form>", "<section id=comments><article class=comment>" + "great " * 300 + "</article></section>"),
    ("<div class='ad wide'>Buy " + "now " * 200 + "</div>", "<div class=sidebar><ul><li>x</li></ul></div><div style='display: none'>hidden</div>"),
])
def test_article_without_furniture(before, after):
    assert page_text.main_text(f"<!DOCTYPE html><html><head><title>t</title></head><body>{before}{ARTICLE}{after}</body></html>") == WANT


def test_article_in_plain_divisions():
    body = "<div id=wrap><div class=post><h2>Title</h2><p>Hi.</p><p>" + "long text " * 40 + "</p><p>Bye.</p></div><div class=menu><a href=a>one</a> <a href=b>two</a></div></div>"
    assert page_text.main_text(f"<body>{body}</body>") == "Title Hi. " + "long text " * 40 + "Bye."


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "no markup,  just\ntext"), (3, None, "no markup,  just\ntext"), (4, "u", "<p>a &lt; b &#233;<p>1 < 2"),
            (5, "u", "<nav>only menus</nav>"), (6, "u", "<article><p>" + "w " * 100_000 + "</article>"), (None, "u", "<script>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = page_text.extract(df.selectExpr("*", "'x' AS text")).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == {
        1: "", 2: "", 3: "no markup, just text", 4: "a < b é 1 < 2", 5: "", 6: ("w " * 100_000).strip(), None: ""}
    assert page_text.extract(df.limit(0)).count() == 0


# fingerprints

def prints(*texts):
    return fingerprints.fingerprints(*bytes_of(pa.array(texts)))


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(1, 9))) for _ in range(n))


def test_equal_texts_have_equal_fingerprints_in_any_company():
    texts = ["", "a", "aa", "aaaa" * 500, "ab" * 900, prose(300, 1), "é日本" * 50, "b" + "a" * 70_000]
    together = prints(*texts, *reversed(texts))
    assert (together == np.concatenate([together[: len(texts)], together[: len(texts)][::-1]])).all()
    for t, p in zip(texts, together):
        assert (prints(t)[0] == p).all()
    assert len({p.tobytes() for p in together}) == len(texts)


def test_shifted_and_halved_texts_stay_near():
    a, b = prose(800, 1), prose(800, 2)
    half = a[: len(a) // 2] + b[len(b) // 2 :]
    p = prints(a, b, "xyz " + a, a + " more", half)
    near = lambda i, j: fingerprints.likeness(p[[i]], p[[j]])[0]
    assert near(0, 2) > 0.85 and near(0, 3) > 0.85 and 0.15 < near(0, 4) < 0.6 and near(0, 1) < 0.1 and near(0, 0) == 1


def test_unlike_long_texts_agree_by_chance_only():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 6 * 2_000_000, dtype=np.uint8)  # hardly a phrase in common
    p = fingerprints.fingerprints(raw, np.arange(7) * 2_000_000)
    agree = [int((p[a] == p[b]).sum()) for a in range(6) for b in range(a)]
    assert sum(agree) <= 2  # of 15 pairs of 64 classes
    assert np.median(p) > 0x4000  # values do not shrink with the length


def test_edited_documents_follow_in_id_order(spark, documents, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    rows = [(k * 5, prose(k % 40, k)) for k in range(60)] + [(1000, None), (1001, "é" * 11), (None, "last of all")]
    got = {r.doc_id: r for r in fingerprints.edited(documents(rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    import hashlib

    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        p = prints(t, e, u)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert [got[i].fingerprint, got[i].edited_fingerprint] == fingerprints.hexed(p[:2]).to_pylist()
        assert got[i].near_next == fingerprints.likeness(p[:1], p[2:])[0]


def test_fingerprints_of_one_of_repeated_and_of_no_rows(spark, documents):
    one = fingerprints.edited(documents([(7, "abcdef")])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    twice = fingerprints.edited(documents([(1, "x y z"), (1, "x y z"), (2, "p q")])).collect()
    assert sorted(r.doc_id for r in twice) == [1, 1, 2]
    assert fingerprints.edited(documents([(1, "x")]).limit(0)).count() == 0
    plain = fingerprints.fingerprint(documents([(1, None), (2, "")]).withColumnRenamed("lang", "fingerprint")).collect()
    assert plain[0].fingerprint == plain[1].fingerprint == "ffff" * fingerprints.SLOTS


def test_far_ids_and_hot_ids_leave_even_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 100)
    far = [(2**63 - 1, "high"), (-(2**63), "low")]
    rows = spark.range(3000).selectExpr("id * 3 AS doc_id", "concat('t', id) AS text").unionByName(
        spark.range(1500).selectExpr("4000 AS doc_id", "concat('one id ', id) AS text")).unionByName(
        spark.range(1500).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('no id ', id) AS text")).unionByName(
        spark.createDataFrame(far, "doc_id long, text string"))
    got = fingerprints.in_order(rows).collect()
    own = Counter(r.bucket for r in got if not r.tail)
    assert sum(own.values()) == 6002 and max(own.values()) < 250 and Counter(r.bucket for r in got if r.tail) == {b: 1 for b in own}
    ids = {}
    for r in got:
        if not r.tail:
            ids.setdefault(r.bucket, []).append((r.doc_id is None, r.doc_id or 0))
    runs = [ids[b] for b in sorted(ids)]
    assert [i for run in runs for i in run] == sorted(i for run in runs for i in run)
    follow = {b: n for b, n in zip(sorted(own), [*sorted(own)[1:], min(own)])}
    first = {}
    for r in got:  # rows of one bucket are in order
        if not r.tail:
            first.setdefault(r.bucket, r.text)
    assert all(first[follow[r.bucket]] == r.text for r in got if r.tail)


def test_buckets_ascend_with_the_key():
    begins = np.array([5, 9, 9, 9, 20])
    at = lambda none, i, tie: int(fingerprints.bucket_of(np.array([none]), np.array([i]), np.array([tie]), begins, 4)[0])
    low, high = -(2**63), 2**63 - 1
    places = [at(False, i, t) for i in (low, 4, 5, 8, 9, 10, 20, high) for t in (low, 0, high)] + [at(True, 0, t) for t in (low, 0, high)]
    assert places == sorted(places) and len({at(False, 9, t) for t in range(low, high, 2**60)}) == 3
    assert at(False, high, high) == 5 and at(True, 0, low) == 6 and at(True, 0, high) == 9
