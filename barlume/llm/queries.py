"""The queries of this package, their SQL where DuckDB can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from barlume.llm import collocations, common, cotraining, decontamination, lattice, line_dedup, ngram_join, packing, periodic_runs, piece_encoding, repetition, substring_dedup, suffix_dedup, tool_calls

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op2_substring_dedup",
    r"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
    g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM p),
    m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM m WHERE n > 1),
    l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
           sha256(coalesce(array_to_string(list_filter(w, lambda x, j: NOT list_contains(coalesce(gone, []), j)), ' '), '')) AS kept_sha256
    FROM d LEFT JOIN l USING (doc_id)
    """,
)
def op2(spark, sf_dir):
    out = substring_dedup.dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_suffix_repetition")
def op1(spark, sf_dir):
    return repetition.rules(common.table(spark, sf_dir, "documents"))


@query("op5_piece_encoding")
def op5(spark, sf_dir):
    out = piece_encoding.encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_best_fit_packing")
def op9(spark, sf_dir):
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_suffix_array_dedup")
def op10(spark, sf_dir):
    out = suffix_dedup.dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op7_ngram_jaccard_join",
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
    FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
    """,
)
def op7(spark, sf_dir):
    return ngram_join.join(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query(
    "op4_line_dedup",
    r"""
    WITH t AS (
        SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '^www\.', ''), '') AS host,
               regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>', '', 'g'),
                   '(?i)</(p|div|li|ul|ol|h[1-6]|tr|td|th|table|nav|header|footer|section|article|pre|blockquote|title)>|<br[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS x
        FROM pages),
    l AS (SELECT page_id, host, x, unnest(string_split(coalesce(x, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(x, ''), chr(10))))) AS i FROM t),
    b AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
    n AS (SELECT host, count(*) AS pages FROM t GROUP BY host),
    g AS (SELECT host, bare FROM b JOIN n USING (host) WHERE bare <> '' GROUP BY host, bare, pages HAVING count(DISTINCT page_id) > 0.1::DOUBLE * pages AND count(DISTINCT page_id) >= 5),
    k AS (SELECT b.*, g.bare IS NOT NULL AS gone FROM b LEFT JOIN g ON g.host = b.host AND g.bare = b.bare)
    SELECT page_id, host, count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           CASE WHEN any_value(x) IS NOT NULL THEN sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) END AS kept_sha256
    FROM k GROUP BY page_id, host
    """,
)
def op4(spark, sf_dir):
    out = line_dedup.drop(common.table(spark, sf_dir, "pages"), line_dedup.host_of(F.col("url")), line_dedup.page_text(F.col("html")))
    return out.select("page_id", "lines.host", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))


@query(
    "op6_lattice_near_dedup",
    """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
          WHERE list_dot_product(a.v, b.v) >= 0.95 * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))
            AND list_dot_product(a.v, a.v) > 0 AND list_dot_product(b.v, b.v) > 0),
    r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
    """,
)
def op6(spark, sf_dir):
    return lattice.near_duplicates(common.table(spark, sf_dir, "embeddings"))


@query("op8_cotraining_quality")
def op8(spark, sf_dir):
    return cotraining.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "lookup": {"type": "object", "required": ["key"], "properties": {"key": {"type": "string", "minLength": 3, "maxLength": 4000}, "fields": {"type": "array", "items": {"type": "string"}}}},
    "note": {"type": "object", "required": ["body", "kind"], "properties": {"body": {"type": "string"}, "kind": {"enum": ["short", "long"]}}},
}


def tool_turns(spark, sf_dir):
    """Tool calls and results read off the conversations: each user turn is a call that
    needs the call two turns before, each assistant turn answers the call of the turn before."""
    t = common.table(spark, sf_dir, "conversations")
    name_id = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn, words = F.col("turn"), F.size(F.split("text", " "))
    kind = F.pmod(F.col("conv_id") + turn, F.lit(3))
    arguments = F.when(kind == 0, F.to_json(F.struct(F.col("text").alias("query"), words.alias("limit")))).when(kind == 1, F.to_json(F.struct(F.col("text").alias("key"), F.array("role").alias("fields")))).otherwise(
        F.to_json(F.struct(F.when(words < 40, "short").otherwise("long").alias("kind"), F.col("text").alias("body"))))
    name = F.when(kind == 0, "search").when(kind == 1, "lookup").otherwise("note")
    calls = t.where("role = 'user'").select("conv_id", name_id(turn).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), F.when(turn >= 2, F.array(name_id(turn - 2))).otherwise(F.array().cast("array<string>")).alias("depends"))
    results = t.where("role = 'assistant'").select("conv_id", name_id(turn - 1).alias("call_id"), "turn", F.to_json(F.struct("role", "text")).alias("content"))
    return calls, results


@query("op3_tool_call_linking")
def op3(spark, sf_dir):
    return tool_calls.link(*tool_turns(spark, sf_dir), TOOLS)


def planted_runs(docs):
    """``documents`` in which every tenth text (by the hash of its id) repeats itself from word a on with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    g, n = F.floor(F.col("_h") / 10), F.size("_w")
    a = F.expr("cast(_g % size(_w) as int)")
    p = F.expr("cast(1 + floor((size(_w) - _a) / (3 + _g % 8)) as int)")
    docs = docs.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_g", g).withColumn("_a", F.when(n > 0, a)).withColumn("_p", p)
    again = F.array_join(F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_w", F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))))), " ")
    return docs.select("doc_id", F.when(F.size("_w") > 0, again).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    out = periodic_runs.runs(planted_runs(common.table(spark, sf_dir, "documents")))
    spans = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length, (-r.start).alias("start"), (-r.period).alias("period"))))
    out = out.withColumn("_best", longest)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(spans, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query(
    "op12_phrase_collocations",
    r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
    i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
    g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM i, (VALUES (1), (2), (3), (4)) v(m) WHERE i + m - 1 <= len(w)),
    f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
    k AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM c),
    s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (2000000::HUGEINT * k.a) // (x.f + y.f) AS score
          FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k.k], ' ')
                 JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1 : k.m], ' ')),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s),
    u AS (SELECT lang, a, m, w, unnest(range(2, m)) AS q FROM c WHERE m > 2),
    v AS (SELECT lang, a, w, q, unnest(range(1, m - q + 2)) AS i FROM u),
    j AS (SELECT lang, array_to_string(w[i : i + q - 1], ' ') AS phrase, max(a) AS longer FROM v GROUP BY ALL),
    z AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, n.n, b.score FROM b JOIN n ON n.lang = b.lang LEFT JOIN j ON j.lang = b.lang AND j.phrase = b.phrase
          WHERE o = 1 AND NOT coalesce(100 * longer >= 80 * b.a, false)),
    t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
    SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM t WHERE rank <= 2000
    """,
)
def op12(spark, sf_dir):
    return collocations.best(collocations.phrases(common.table(spark, sf_dir, "documents")), 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query(
    "op13_benchmark_decontamination",
    r"""
    WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
    d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), u, l), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents, low),
    i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), u, l), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark, low),
    q AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g
          FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
    s AS (SELECT DISTINCT k FROM q),
    o AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, s WHERE len(w) >= k)),
    h AS (SELECT DISTINCT o.doc_id, q.item_id, o.p, o.k FROM o JOIN q ON q.g = o.g AND q.k = o.k),
    n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM h) GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM h) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
)
def op13(spark, sf_dir):
    out = decontamination.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
