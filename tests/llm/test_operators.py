"""The text operators against brute force, and on awkward rows."""

import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlume.llm import common, cotraining, lattice, line_dedup, ngram_join, packing, piece_encoding, repetition, substring_dedup, suffix_array, suffix_dedup, tool_calls
from tests.llm.plain import components, jaccard_links, words

tokenizers = pytest.importorskip("public_tokenizers")
PIECES, BYTES = tokenizers.path("piece_bpe_32k.model"), tokenizers.path("byte_bpe_50k.json")


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Nulls, empties, blanks, exact and near copies, shared passages, a long text, odd characters."""
    rng = np.random.default_rng(4)
    passage, base = sentence(rng, 70), sentence(rng, 120)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One"), (5, base), (6, base), (7, base.upper()), (8, base + " tail words here"), (9, f"é {passage} ü"), (10, f"x {passage} y")]
    rows += [(11, passage + "\n" + passage), (12, sentence(rng, 3000)), (13, "▁a b   c\x00d퟿😀"), (14, "a" * 5000), (15, "a " * 400), (None, base), (None, None)]
    rows += [(100 + k, " ".join(words(base)[: 60 + k % 7] + [f"w{k}"] + words(base)[60 + k % 7 :])) for k in range(40)]
    rows += [(200 + k, sentence(rng, int(rng.integers(1, 60))) + "\n" + passage[: 150 + 10 * k]) for k in range(20)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "doc_id AS _id", "text AS _text", "1 AS kept", "2 AS n", "'s' AS _key", "3 AS lines").repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect() if r.doc_id is not None}


def test_substring_dedup(docs, corpus, nothing):
    got = by_id(substring_dedup.dedup(docs), "n_words", "n_removed", "kept")
    seen, gone = set(), defaultdict(set)
    for i, t in sorted((r for r in corpus if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[i].update(range(k, k + 20))
            seen.add(key)
    want = {i: (len(words(t)), len(gone[i]), " ".join(x for k, x in enumerate(words(t)) if k not in gone[i])) for i, t in corpus if i is not None}
    assert got == want
    whole = [r for r in substring_dedup.dedup(docs).collect() if r.doc_id is None]
    assert sorted(r.n_removed for r in whole) == [0, 0]
    assert substring_dedup.dedup(nothing).count() == 0


def test_substring_dedup_of_one_document_given_twice(spark):
    t = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.dedup(df).collect()) == [(1, 0), (1, 0), (2, 30)]


def test_substring_dedup_with_a_sketch_that_is_full(docs):
    """A sketch of four cells tells nothing apart; the result is the same."""
    a, b = (by_id(substring_dedup.dedup(docs, bits=n), "n_removed", "kept") for n in (3, 20))
    assert a == b


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for n, sigma in [(1, 2), (50, 2), (60, 3), (60, 5), (300, 3)] * 4:
        t = np.append(rng.integers(1, sigma, n), 0)
        sa = suffix_array.build(t, sigma)
        order = sorted(range(n + 1), key=lambda i: t[i:].tolist())
        assert sa.tolist() == order
        prefix = suffix_array.permuted_prefixes(t, sa)
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while a + k <= n and b + k <= n and t[a + k] == t[b + k]:
                k += 1
            assert prefix[b] == k


@pytest.mark.parametrize("key", [20, 63])
def test_suffix_arrays_take_few_steps(key, monkeypatch):
    """Names of substrings are ranked together; swept one by one they took a step and more for each name."""
    monkeypatch.setattr(suffix_array, "KEY", key)
    steps, put = [], suffix_array.Buckets.put
    monkeypatch.setattr(suffix_array.Buckets, "put", lambda *a: steps.append(1) or put(*a))
    rng = np.random.default_rng(4)
    base = [rng.integers(1, 3, 300) for _ in range(4)]
    t = np.concatenate([x for k in range(24) for x in (base[k % 4][: 200 + 4 * k], [3], rng.integers(1, 3, 60))] + [[0]])
    sa = suffix_array.build(t, 4)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert len(steps) <= 40 * 4
    prefix = suffix_array.permuted_prefixes(t, sa)
    assert max(prefix) >= 200
    for a, b in zip(sa[:-1], sa[1:], strict=True):
        k = prefix[b]
        assert t[a : a + k].tolist() == t[b : b + k].tolist() and t[a + k] != t[b + k]


def test_repeats_among_segments():
    """Places of windows found by their suffix array, against a count of the windows."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, 90).astype(np.uint8).tobytes()
    segments = []
    for k in range(40):
        lo, hi = sorted(rng.choice(91, 2, replace=False).tolist())
        x = rng.integers(0, 256, 7).astype(np.uint8).tobytes() + base[lo:hi] + bytes([k]) * 30
        segments.append((k // 3, 100 * k, len(x) - 19, k % 5 == 0, x))
    count = Counter(x[i : i + 20] for *_, n, _, x in segments for i in range(n))
    want = {(j, start + i) for j, start, n, many, x in segments if not many for i in range(n) if count[x[i : i + 20]] > 1}
    got = suffix_dedup.repeats_in(segments, 20)
    assert {(j, a + i) for j, a, n in got for i in range(n)} == want
    assert sum(n for *_, n in got) == len(want)
    assert suffix_dedup.repeats_in([(*x[:3], True, x[4]) for x in segments], 20) == []


@pytest.mark.parametrize("crowd", [1, 64])
def test_suffix_dedup(docs, corpus, nothing, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    got = by_id(suffix_dedup.dedup(docs), "n_bytes", "n_removed", "kept")
    raw = {i: (t or "").encode() for i, t in corpus if i is not None}
    count = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert got[i] == (len(b), gone.sum(), bytes(np.frombuffer(b, np.uint8)[~gone])), i
    assert suffix_dedup.dedup(nothing).count() == 0
    twice = suffix_dedup.dedup(docs.where("doc_id = 12").union(docs.where("doc_id = 12")), carry=("lines",), as_text=True).collect()
    assert [(r.n_removed == r.n_bytes, r.kept, r.lines) for r in twice] == [(True, "", 3)] * 2


def test_ngram_join(docs, corpus, nothing):
    out = ngram_join.join(docs)
    got = by_id(out, "n_shingles", "component_id")
    sizes, links = jaccard_links({i: t for i, t in corpus if i is not None})
    assert got == {i: (sizes[i], c) for i, c in components(sizes, links).items()}
    assert sorted(r.component_id is None for r in out.collect() if r.doc_id is None) == [True, True]
    assert ngram_join.join(nothing).count() == 0


def test_ngram_join_of_groups_without_common_minima(spark, monkeypatch):
    """The tiles alone find every link."""
    monkeypatch.setattr(ngram_join, "minima", lambda s: [])
    rng = np.random.default_rng(8)
    rows, i = [], 0
    for _ in range(12):
        base = words(sentence(rng, int(rng.integers(6, 200))))
        for _ in range(6):
            w = list(base)
            for k in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[k] = f"z{rng.integers(100)}"
            rows.append((i, " ".join(w[: len(w) - int(rng.integers(0, max(1, len(w) // 8)))])))
            i += 1
    sizes, links = jaccard_links(dict(rows))
    got = by_id(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")), "component_id")
    assert {k: v[0] for k, v in got.items()} == components(sizes, links)
    assert len(links) > 40


def test_repetition(docs, corpus, nothing):
    got = {r.doc_id: r for r in repetition.rules(docs).collect() if r.doc_id is not None}
    for i, t in corpus:
        if i is None:
            continue
        w, r = words(t), got[i]
        t = t or ""
        five = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {j for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover)), i
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        if len(w) < 900:  # longest repeats by all pairs of places
            deep = [max((next((k for k in range(len(w)) if a + k >= len(w) or b + k >= len(w) or w[a + k] != w[b + k])) for b in range(len(w)) if b != a), default=0) for a in range(len(w))] if len(cover) else [0] * len(w)
            deep = [x if x >= 10 else 0 for x in deep]
            assert r.longest_repeat == max(deep, default=0)
            assert r.covered_words == len({k for a, x in enumerate(deep) for k in range(a, a + x)})
    assert not got[15].kept and got[12].kept and not got[0].kept
    assert repetition.rules(nothing).count() == 0


def test_piece_encoding(docs, corpus, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(piece_encoding.encode(docs, PIECES), "ids", "decoded")
    for i, t in corpus:
        if i is not None:
            assert got[i] == (sp.encode(t or ""), sp.decode(sp.encode(t or ""))), i
    assert piece_encoding.encode(nothing, PIECES).count() == 0


def test_piece_encoding_of_arbitrary_strings():
    import sentencepiece
    from hypothesis import given, settings
    from hypothesis import strategies as st

    sp, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_encoding.pieces(PIECES)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("aehinorst \n\t▁.,1"), st.characters(blacklist_categories=["Cs"])), max_size=60))
    def same(s):
        ids = own.encode(s)
        assert ids == sp.encode(s) and own.decode(ids) == sp.decode(ids)

    same()


def test_packing(docs, corpus, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    tok.encode_special_tokens = True
    rows = packing.pack(docs, BYTES, room=256).collect()
    taken, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        taken[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append(r)
    for places in taken.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    for i, t in corpus:
        if i is None:
            continue
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(parts[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 256)))
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]]))[:-1] and sum(r.length for r in own) == len(ids)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
    assert len(taken) <= packing.bins(packing.best_fit(dict(Counter(r.length for r in rows)), 256))
    assert packing.pack(nothing, BYTES).count() == 0


def test_packing_gives_added_tokens_in_a_text_their_ids(spark):
    from tokenizers import Tokenizer

    tok, end = Tokenizer.from_file(BYTES), "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}  \n {end}x", f"two  {end}\n\n", "<|endoftext |>", f"é{end}'s 12"]
    rows = {r.doc_id: r for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES).collect()}
    for k, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (rows[k].length, rows[k].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), t


def test_plans_place_every_item_and_are_no_worse_than_best_fit():
    rng = np.random.default_rng(3)
    for room, sizes in ((10, [6, 5, 5, 4, 3, 3, 2, 2]), (100, rng.integers(1, 101, 200).tolist()), (30, [12, 11, 10, 9, 9, 9] * 5), (7, [7] * 4)):
        counts = dict(Counter(sizes))
        filled = packing.plan(counts, room)
        got = Counter()
        for fill, times in filled:
            assert sum(fill) <= room
            for s in fill:
                got[s] += times
        assert got == counts and packing.bins(filled) <= packing.bins(packing.best_fit(counts, room))
    assert packing.bins(packing.plan(dict(Counter([6, 5, 5, 4, 3, 3, 2, 2])), 10)) == 3


def fewest(sizes, room):
    """Smallest number of sequences, by trying every place of every item."""
    best = [len(sizes)]

    def put(k, space):
        if len(space) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(space)
            return
        for left in sorted({x for x in space if x >= sizes[k]}):
            rest = list(space)
            rest.remove(left)
            put(k + 1, [*rest, left - sizes[k]])
        put(k + 1, [*space, room - sizes[k]])

    put(0, [])
    return best[0]


def test_plans_of_small_cases_are_the_fewest():
    rng = np.random.default_rng(5)
    for _ in range(150):
        room = int(rng.integers(8, 40))
        sizes = sorted(rng.integers(1 + room // 8, 1 + room * 2 // 3, int(rng.integers(1, 11))).tolist(), reverse=True)
        assert packing.bins(packing.plan(dict(Counter(sizes)), room)) == fewest(sizes, room), (room, sizes)


def test_plans_fill_with_any_number_of_items():
    assert packing.bins(packing.plan({700: 2400, 500: 2400, 300: 4800, 248: 2400}, 2048)) == 2400
    assert packing.bins(packing.plan({100: 30, 13: 30 * 8, 12: 30 * 8}, 300)) == 30
    rng = np.random.default_rng(6)
    for low, high, spare in ((20, 400, 0), (100, 600, 2), (200, 900, 5)):  # planted: 500 sequences without waste
        sizes = []
        for _ in range(500):
            left = 2048
            while left > high:
                sizes.append(int(rng.integers(low, min(high, left - low) + 1)))
                left -= sizes[-1]
            sizes.append(left)
        assert packing.bins(packing.plan(dict(Counter(sizes)), 2048)) <= 500 + spare


def test_lattice_points_are_nearest():
    x = np.random.default_rng(1).normal(size=(500, 8)) * 2
    e = lattice.nearest_e8(x)
    d = ((x - e) ** 2).sum(axis=1)
    assert np.allclose((2 * e) % 1, 0) and all((((x - e - s) ** 2).sum(axis=1) >= d - 1e-12).all() for s in lattice.shortest())


@pytest.mark.parametrize("rows_in_block", [2048, 16])
def test_near_duplicates(spark, monkeypatch, rows_in_block):
    monkeypatch.setattr(lattice, "ROWS", rows_in_block)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 16))
    v = [(k, (base[k % 30] * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.05 * (k % 5)).tolist()) for k in range(150)]
    v += [(150 + k, v[0][1]) for k in range(20)]
    x = np.array([r[1] for r in v])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None, 1.0]), (904, [float("inf")] * 16), (905, []), (906, [1.0, 2.0]), (None, v[0][1])]
    df = spark.createDataFrame(v + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS _class", "2 AS a")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(df, tables=24).collect()}
    links = [(i, j) for i in range(170) for j in range(170) if i != j and linked[i, j]]
    c = components(dict.fromkeys(range(170), 1), links)
    assert {i: got[i] for i in range(170)} == {i: (int(linked[i].sum()) - 1, c[i]) for i in range(170)}
    assert all(got[i] == (0, i) for i in range(900, 907)) and got[None] == (0, None)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_line_dedup(spark):
    rows = [(k, f"http://a.org/{k}", f"menu\nown {k}\n\n menu \t\n{'rare' if k < 3 else 'x' + str(k)}") for k in range(20)]
    rows += [(50, "https://www.A.org:80/y?q#f", "menu\nelse"), (51, None, "menu"), (52, "not a url", "menu"), (53, "http://b.org", None), (54, "http://a.org", ""), (55, "http://u@a.org/", "menu\n" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, text string").selectExpr("*", "'c' AS host", "1 AS _host", "2 AS lines")
    out = {r.page_id: r for r in line_dedup.drop(df, line_dedup.host_of(F.col("url")), F.col("text"), 0.5, 3).collect()}
    assert (out[7].lines.kept, out[7].lines.n_lines, out[7].lines.n_dropped, out[7].host) == ("own 7\n\nx7", 4, 2, "c")
    assert out[50].lines.host == "a.org" and out[50].lines.kept == "else" and out[55].lines.kept == "" and out[55].lines.n_dropped == 3000
    assert out[51].lines.kept == "menu" and out[52].lines.host is None and out[53].lines.kept is None and out[54].lines.kept == "" and out[1].lines.kept.endswith("rare")
    assert line_dedup.drop(df.limit(0), F.col("url"), F.col("text")).count() == 0


def test_cotraining(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for k in range(600):
        good = k % 4 != 0
        t = sentence(rng, 80) if good else sentence(rng, 40).upper().replace(" ", "!! ")
        rows.append((k, t, "en", f"s{k % 3}"))
        if k % 2 == 0 or k % 5 == 0:
            labels.append((k, int(good)))
    rows += [(700, None, None, None), (701, "", "en", "s1"), (None, sentence(rng, 50), "en", "s1"), (702, "x " * 200_000, "en", "s0"), (5, rows[5][1], "en", "s2")]
    labels += [(1, None), (3, 7), (10, 1 - int(10 % 4 != 0)), (None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "0 AS kept", "1 AS _y")
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    out = cotraining.classify(df, given, most=300, carry=("kept",)).toDF("doc_id", "was", "p_text", "p_meta", "p_quality", "kept").collect()
    fresh = [r for r in out if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 2 and r.doc_id % 5]
    assert np.mean([r.kept == (r.doc_id % 4 != 0) for r in fresh]) > 0.97
    assert len(out) == len(rows) and {r.was for r in out} == {0} and all(0 <= r.p_quality <= 1 for r in out)
    alone = cotraining.classify(df, given.limit(0)).collect()
    assert all(r.kept and r.p_quality is None for r in alone) and len(alone) == len(rows)
    assert cotraining.classify(df.limit(0), given).count() == 0


SCHEMAS = {"f": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"enum": ["x", 1]}}}}}


def test_tool_calls(spark):
    calls = [
        (1, "a", 0, "f", '{"b": ["x"], "a": 1.0}', None), (1, "b", 1, "f", '{"a": -1}', ["a"]), (1, "c", 2, "f", "{", ["a", "b", "gone"]), (1, "d", 3, "g", "{}", ["e"]), (1, "e", 4, "f", '{"a": 2}', ["d"]),
        (1, "h", 5, "f", '{"a": 2}', ["e"]), (2, "a", 0, "f", '{"a": 5, "z": 1}', []), (2, "a", 0, "f", '{"a": 5, "z": 1}', []), (2, None, 1, "f", None, None), (2, "s", 1, "f", '{"a":1}', ["s"]),
    ]
    results = [(1, "a", 1, '{"y": 1, "x": [1.50]}'), (1, "a", 2, "later"), (1, "b", 2, "plain é"), (3, "z", 0, None), (None, "a", 0, "1")]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, depends array<string>").selectExpr("*", "1 AS key", "2 AS level")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string").selectExpr("*", "1 AS key")
    got = {(x.conv_id, x.call_id): x for x in tool_calls.link(c, r, SCHEMAS).collect()}
    a = got[1, "a"]
    assert (a.level, a.status, a.valid, a.n_results, a.record) == (0, "linked", True, 2, '{"arguments":{"a":1,"b":["x"]},"depends":[],"id":"a","name":"f","order":[0,0],"result":{"x":[1.5],"y":1}}')
    assert (got[1, "b"].level, got[1, "b"].errors, json.loads(got[1, "b"].record)["result"]) == (1, ["$.a: minimum"], "plain é")
    assert (got[1, "c"].level, got[1, "c"].errors) == (2, ["arguments: not JSON", "depends: no call gone"])
    assert [(got[1, k].status, got[1, k].level) for k in "deh"] == [("cycle", None)] * 3 and got[2, "s"].status == "cycle"
    assert got[2, "a"].n_calls == 2 and got[2, "a"].errors == ["$.z: unknown", "call_id: repeated"]
    assert got[2, None].status == "no_result" and got[3, "z"].status == "orphan_result" and got[None, "a"].status == "orphan_result"
    assert tool_calls.link(c.limit(0), r.limit(0), SCHEMAS).count() == 0


def test_tool_calls_with_awkward_json(spark):
    """Each is told apart by its arguments; none ends the task."""
    given = {
        "half": ('{"a": 1, "b": ["\\ud83d"], "\\udc00": 1}', ["$.b[0]: enum", "$.\\udc00: unknown"]), "digits": ('{"a": 1' + "0" * 400 + "}", []), "range": ('{"a": 1e400}', ["arguments: not JSON"]),
        "deep": ("[" * 3000 + "]" * 3000, ["arguments: nested too deeply"]), "deeper": ("[" * 300_000, ["arguments: not JSON"]), "true": ('{"a": 1, "b": [true, 1, 1.0]}', ["$.b[0]: enum"]), "nan": ('{"a": NaN}', ["arguments: not JSON"]),
        "long": ('{"a": ' + "9" * 5000 + "}", ["arguments: not JSON"]), "null": (None, ["arguments: missing"]), "empty": ("", ["arguments: not JSON"]),
    }
    c = spark.createDataFrame([(1, k, 0, "f", a, None) for k, (a, _) in given.items()], "conv_id long, call_id string, turn long, name string, arguments string, depends array<string>")
    r = spark.createDataFrame([(1, k, 1, a) for k, (a, _) in given.items()], "conv_id long, call_id string, turn long, content string")
    got = {x.call_id: x for x in tool_calls.link(c, r, SCHEMAS).collect()}
    for k, (a, errors) in given.items():
        record = json.loads(got[k].record)
        assert got[k].errors == errors and got[k].status == "linked"
        assert record["arguments"] == (a if errors and errors[0].startswith("arguments") else json.loads(a))


def test_ids_that_name_different_texts(spark):
    """No crash; texts of one id share what is found in any of them."""
    rng = np.random.default_rng(9)
    a, b = sentence(rng, 100), sentence(rng, 100)
    df = spark.createDataFrame([(1, a), (1, "short"), (1, None), (2, b + " " + a), (3, b), (3, b), (4, "x y z")], "doc_id long, text string")
    got = defaultdict(list)
    for r in suffix_dedup.dedup(df).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed))
    assert sorted(got[1]) == [(0, 0), (5, 5), (len(a), len(a))] and got[4] == [(5, 0)] and got[3] == [(len(b), len(b))] * 2
    got = defaultdict(list)
    for r in substring_dedup.dedup(df).collect():
        got[r.doc_id].append((r.n_words, r.n_removed))
    assert sorted(got[1]) == [(0, 0), (1, 0), (100, 0)] and got[2] == [(200, 100)] and sorted(got[3]) == [(100, 100)] * 2
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()]
    assert sorted(x for x in out if x[0] == 1) == [(1, 0, 1), (1, 1, 1), (1, 96, 1)] and len(out) == 7


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(dict.fromkeys({x for e in edges for x in e}, 1), edges)
    assert all(want[i] == c for i, c in got.items()) and set(got) >= {x for a, b in edges if a != b for x in (a, b)}


def test_cotraining_learns_from_all_unlabelled_documents(spark):
    rng = np.random.default_rng(12)
    rows = [(k, sentence(rng, 30) if k % 3 else sentence(rng, 30).upper(), "en", f"site{k % 7}.com") for k in range(2000)]
    df = spark.createDataFrame(rows, "_id long, _text string, _c0 string, _c1 string").repartition(7)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), None) for k in range(0, 300)], "_id long, _y int, _t int")
    views = cotraining.fit(df, labels, ["_c0", "_c1"], most=100, rounds=2, confident=0.2)
    assert all(n >= 0.15 * 1900 for n in views.taught)
    assert len({cotraining.hash_of(r[3]) for r in rows}) == 7


def test_cotraining_rejects_toxic_documents_of_good_quality(spark):
    rng = np.random.default_rng(13)
    toxic = [k % 8 == 0 for k in range(1200)]
    rows = [(k, f"{sentence(rng, 150)} {'zounds' if k % 16 else 'gadzooks!'} {sentence(rng, 150)}" if toxic[k] else sentence(rng, 300) if k % 4 else sentence(rng, 90).upper(), "en", f"s{k % 3}") for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    labels = spark.createDataFrame([(k, int(toxic[k] or k % 4 > 0), int(toxic[k])) for k in range(800)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in cotraining.classify(df, labels).collect()}
    fresh = range(800, 1200)
    assert not any(kept[k] for k in fresh if toxic[k])
    assert np.mean([kept[k] for k in fresh if not toxic[k] and k % 4]) > 0.97
    assert all(r.kept for r in cotraining.classify(df.where("doc_id % 4 <> 0 OR doc_id % 8 = 0"), labels.drop("toxic")).where("doc_id % 8 = 0").collect())
