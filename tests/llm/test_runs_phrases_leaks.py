"""Periodic runs, collocations and decontamination against brute force, and on awkward rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlume.llm import collocations, decontamination, periodic_runs
from barlume.llm.recompression import Extender, grammar
from tests.llm.plain import words


def plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in found.items())


def test_extensions_of_a_grammar():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, k = int(rng.integers(2, 200)), int(rng.integers(1, 4))
        body = rng.integers(0, k, n)
        if rng.random() < 0.5:
            body = np.resize(body[: max(1, n // 5)], n)  # periodic
        w = np.concatenate(([k], body, [k + 1]))
        grown = Extender(grammar(w, k + 2), len(w))
        i, j = (x.ravel() for x in np.meshgrid(np.arange(1, n + 1), np.arange(1, n + 1)))
        i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        ahead, back = grown.extend(i, j, True), grown.extend(i, j, False)
        for a, b, f, g in zip(i.tolist(), j.tolist(), ahead.tolist(), back.tolist(), strict=True):
            assert f == next(t for t in range(n + 2) if w[a + t] != w[b + t])
            assert g == next(t for t in range(n + 2) if w[a - t] != w[b - t])


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "a " * 11), (5, "a " * 12), (6, "a b " * 6), (7, "x a b c a b c a b c a b c y"), (8, "é ü " * 30), (None, "a " * 20), (None, None)]
    rows += [(9, "a " * 40), (9, "a " * 40), (9, "other text of the same id")]
    rows += [(20 + k, " ".join(rng.choice(list("ab"), int(rng.integers(1, 80))))) for k in range(40)]
    rows += [(70 + k, " ".join(rng.choice(list("abcdefgh"), 30).tolist() * int(rng.integers(1, 4)) + ["tail"])) for k in range(10)]
    rows += [(90, " ".join(f"w{x}" for x in rng.integers(0, 50, 30_000))), (91, "loop the loop " * 8000)]
    return rows


def test_periodic_runs(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS runs", "'s' AS _id", "doc_id AS _x0", "doc_id AS mark").repartition(3)
    got = defaultdict(list)
    for r in periodic_runs.runs(df, carry=("mark",)).collect():
        assert r.mark == r.doc_id
        got[r.doc_id].append((r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed))
    want = defaultdict(list)
    for i, t in texts:
        w = words(t)
        found = plain_runs(w) if i not in (90, 91) else [] if i == 90 else [(0, 24000, 3)]
        gone = {x for s, n, q in found for x in range(s + q, s + n)}
        want[i].append((len(w), tuple(found), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert periodic_runs.runs(df.where("false")).count() == 0


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_phrases(rows, least, longest=4, percent=80):
    f, total = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low(t)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in many.items():
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in many.items())
            if not inside:
                out.append((lang, " ".join(p), a, c[p[:k]], c[p[k:]], total[lang], score))
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(12)] + ["Über", "niño", "a\x00b", "x" * 90]
    rows = [("en", None), ("en", ""), (None, "alone, ALONE"), ("und", "alone alone"), ("", "no name no name no name"), ("xx", ",;.!"), ("en", "tie one, tie two, " * 7)]
    for k in range(60):
        w = rng.choice(vocabulary, int(rng.integers(1, 120)), p=np.arange(16, 0, -1) / 136)
        ends = rng.choice([" ", "  ", "\t", ", ", ". ", "\n", "\r\n", "\x0b"], len(w), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03])
        rows.append((["en", "de", None][k % 3], "".join(a + b for a, b in zip(w, ends, strict=True))))
    rows += rows[10:20]  # copies
    rows += [("de", "again " * 5000 + "w0 w1 w2 w3 " * 300)]
    return rows


def test_phrases(spark, spoken):
    df = spark.createDataFrame(spoken, "lang string, text string").selectExpr("lang", "text", "1 AS phrase", "'c' AS chunk", "2 AS n", "3 AS rank").repartition(4)
    for least in (3, 8):
        got = sorted(tuple(r) for r in collocations.phrases(df, least=least).select("lang", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == plain_phrases(spoken, least)
    assert collocations.phrases(df.where("false")).count() == 0


def test_phrases_with_a_bitmap_that_is_full(spark, spoken):
    df = spark.createDataFrame(spoken, "lang string, text string")
    a, b = (sorted(map(tuple, collocations.phrases(df, least=5, bits=n).collect())) for n in (3, 20))
    assert a == b and a


def test_best_phrases_and_ties(spark, spoken):
    df = spark.createDataFrame(spoken, "lang string, text string")
    got = [tuple(r) for r in collocations.best(collocations.phrases(df, least=3), 5).orderBy("lang", "rank").select("lang", "rank", "phrase").collect()]
    want = []
    by_lang = defaultdict(list)
    for lang, phrase, a, _, _, _, score in plain_phrases(spoken, 3):
        by_lang[lang].append((-score, -a, phrase.encode()))
    for lang in sorted(by_lang):
        want += [(lang, k + 1, p.decode()) for k, (_, _, p) in enumerate(sorted(by_lang[lang])[:5])]
    assert got == want
    assert len({r[2] for r in got if r[0] == "en"}) == 5


def test_chunks_give_every_start_once():
    from barlume.llm import text

    rng = np.random.default_rng(1)
    raw = [" ".join(rng.choice(list("abcdefghijklm"), 500)).encode(), b"", b"a, b c. d", " ".join(rng.choice(list("abc"), 90)).encode()]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    s, e, doc, start, own, stop = collocations.chunks(buf, off, 4)
    assert start[0] == 0 and own[-1] == len(s) and (start[1:] == own[:-1]).all() and len(start) > 20
    assert ((stop - own <= 3) & (stop >= own)).all()


def plain_leaks(doc, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w = split(doc)
    hit, names = set(), set()
    for name, t in items:
        v = split(t)
        k = min(len(v), width)
        wanted = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in wanted:
                hit |= set(range(i, i + k))
                names |= {str(name)} if name is not None else set()
    return len(w), len(hit), sorted(names)


@pytest.fixture(scope="module")
def leaks():
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 400, n))
    items = [(k, say(int(rng.integers(8, 40)))) for k in range(12)]
    items += [(20, "short one"), (21, "Solo"), (22, "three little words"), (23, None), (24, ""), (25, "..."), (None, "without any name"), (26, items[0][1]), (26, items[1][1]), (27, "la " * 14), (28, "t1-t2;T3é t4")]
    docs = [(0, None), (1, ""), (2, "?!"), (3, "solo"), (4, "short-ONE short two short one"), (5, "la " * 30), (6, "la " * 9), (7, "without any name"), (None, "solo and solo"), (None, "t9"), (8, "x t1 t2 t3é, T4 y")]
    for k in range(40):
        w = say(int(rng.integers(5, 60))).split(" ")
        passage = items[k % 12][1].split(" ")
        a = int(rng.integers(0, len(passage)))
        docs.append((10 + k, " ".join(w[:5] + passage[a : a + int(rng.integers(5, 30))] + w[5:])))
    docs += [docs[12], (10, "another text of an id: " + items[3][1]), (90, say(20_000) + " " + items[2][1].upper().replace(" ", "\n") + " " + say(20_000))]
    return docs, items


def test_contamination(spark, leaks):
    docs, items = leaks
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS token", "2 AS window", "3 AS _h").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "'z' AS item", "1 AS k")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontamination.contamination(df, bench).collect()), key=repr)
    assert got == sorted(((i, *plain_leaks(t, items)) for i, t in docs), key=repr)
    assert sum(r[2] > 0 for r in got) > 20
    spans = {r.doc_id: [tuple(x) for x in r.spans] for r in decontamination.contamination(df, bench).where("doc_id in (4, 5)").collect()}
    assert spans == {4: [(0, 2), (4, 6)], 5: [(0, 30)]}


def test_contamination_of_empty_tables(spark, leaks):
    docs, items = leaks
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert decontamination.contamination(df.where("false"), bench).count() == 0
    assert decontamination.contamination(df, bench.where("false")).agg(F.sum("n_hit"), F.count("*")).first()[:] == (0, len(docs))
    a, b = (sorted(map(repr, decontamination.contamination(df, bench, bits=n).collect())) for n in (3, 20))
    assert a == b
