"""The stages of the corpus pipeline on small inputs."""

from pyspark.sql import functions as F

import corpus_pipeline
from barlume.llm import sketch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def test_line_stage_drops_a_line_on_a_tenth_to_a_third_of_a_source(spark):
    rows = [(k, f"own {k}" + ("\nmenu" if k < 28 else "") + ("\nfooter" if 30 <= k < 42 else "") + ("\nsaying" if 50 <= k < 55 else ""), "a") for k in range(100)]
    rows += [(200 + k, f"own {200 + k}" + ("\nmenu" if k < 6 else ""), "b") for k in range(100)]  # common on a only
    rows += [(900, "menu", None), (901, None, "a")]
    out = {r.doc_id: r for r in corpus_pipeline.boilerplate(spark, documents(spark, rows), "").collect()}
    want = {i: t if s != "a" or t is None else "\n".join(x for x in t.split("\n") if x not in ("menu", "footer")) for i, t, s in rows}
    assert {i: r.text for i, r in out.items()} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.values())


def test_texts_that_stay_whole_do_not_move(spark, monkeypatch):
    """Near copies and repeated strings, with an id told apart from all others and with a bitmap that tells none apart."""
    words = [[f"w{(k * 37 + j * (k + 3)) % 997}" for j in range(60)] for k in range(40)]
    rows = [(k, " ".join(w), "a") for k, w in enumerate(words)] + [(100 + k, " ".join(words[k]) + " end", "a") for k in range(3)] + [(200, None, "a"), (201, "", "a"), (None, " ".join(words[0]), "a")]
    rows += [(300 + k, f"{k} " * 9 + "passage " * 40 + f"{k} café", "a") for k in range(2)]
    docs = documents(spark, rows)
    among, asked = sketch.among, []

    def counted(wanted, *args):
        asked.append({r[0] for r in wanted.collect()})
        return among(wanted, *args) if counted.apart else lambda c: F.expr("true")

    monkeypatch.setattr(sketch, "among", counted)
    for counted.apart in (True, False):
        asked.clear()
        left = corpus_pipeline.near_duplicates(spark, docs, "").collect()
        assert asked[-1] == {100, 101, 102}
        assert sorted(map(repr, left)) == sorted(repr(r) for r in docs.collect() if r.doc_id not in (100, 101, 102))
        asked.clear()
        cut = {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, documents(spark, [r for r in rows if r[0] is not None and not 100 <= r[0] < 200]), "").collect()}
        assert asked == [{300, 301}]
        assert len(cut) == 44 and cut[200] == "" and cut[201] == "" and all(cut[k] == " ".join(w) for k, w in enumerate(words))
        assert all(len(cut[300 + k]) < 40 and cut[300 + k].endswith(f"{k} café") for k in range(2))
