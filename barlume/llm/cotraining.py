"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.llm import common, text
from barlume.llm.repetition import SYMBOL

BUCKETS = 1 << 16
#: Bins of a measure of the layout, and of the values of a column.
BINS, NAMED = 32, 1024
MEASURES = 10
#: Parts of an array of counts that are added up apart.
PARTS = 16
#: Bits of a word's bucket, documents a word of weight stands in at least, and how many words of a document count.
WORD_BITS, SEEN, STRONGEST = 18, 5, 3
#: A document counts so much over its grams, in whole numbers, so that sums do not depend on their order.
WHOLE = 1 << 30
_UPPER, _DIGIT, _MARK = (np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?.,;:"))


#: Classes of bytes that are counted together, two to a number.
_CLASSES = [(np.arange(256) == 10, _UPPER), (_DIGIT, SYMBOL), (_MARK, np.arange(256) >= 128)]
_COUNTERS = [a.astype(np.int64) | b.astype(np.int64) << 32 for a, b in _CLASSES]


def per_document(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of ``x`` of the lengths ``n``."""
    out = np.zeros(len(n), x.dtype)
    full = n > 0
    if full.any():
        out[full] = np.add.reduceat(x, (np.cumsum(n) - n)[full])
    return out


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of three bytes (A-Z as they are), document by document, and how many each has."""
    n = np.maximum(np.diff(off) - 2, 0)
    if not n.any():
        return np.zeros(0, np.int64), n
    b = buf.astype(np.uint32)
    h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    inside = np.ones(len(h), bool)
    for back in (1, 2):  # runs over the end of a document
        at = off[1:-1] - back
        inside[at[(at >= 0) & (at < len(h))]] = False
    return h[inside].astype(np.int64), n


def metadata(rows: pa.RecordBatch, buf: np.ndarray, off: np.ndarray, columns: list[str]) -> np.ndarray:
    """Category numbers of each document: its columns and the layout of its page, in bins."""
    s, e, first = text.words(buf, off)
    size, words = np.diff(off), np.diff(first)
    both = [per_document(c[buf], size) for c in _COUNTERS]
    (ends, upper), (digit, symbol), (mark, beyond) = [(x & 0xFFFFFFFF, x >> 32) for x in both]
    lines = ends + 1
    long = per_document(((e - s) > 14).astype(np.int64), words)
    share = lambda x, of: np.floor(2 * np.log2(1 + 1000 * x / np.maximum(of, 1)))
    level = lambda x: np.floor(2 * np.log2(1 + x))
    measured = [level(size), level(words), level(lines), level(size / lines), share(upper, size), share(digit, size), share(symbol, size), share(mark, size), share(beyond, size), share(long, words)]
    both = np.stack(measured, axis=1) if len(size) else np.zeros((0, MEASURES))
    both = np.clip(both, 0, BINS - 1).astype(np.int64) + BINS * np.arange(MEASURES)
    named = [BINS * MEASURES + NAMED * k + values_of(rows.column(c)) for k, c in enumerate(columns)]
    return np.column_stack([both, *named])


def presence(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each different word (A-Z as a-z) of the documents."""
    low = text.LOWER[buf]
    s, e, first = text.words(low, off)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    bucket = (text.word_hashes(low, s, e, 0) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    both = np.unique(doc << WORD_BITS | bucket)
    return both >> WORD_BITS, both & ((1 << WORD_BITS) - 1)


def values_of(column: pa.Array) -> np.ndarray:
    each = column.to_pylist()
    at = {x: hash_of(x) for x in set(each)}
    return np.array([at[x] for x in each], np.int64)


def hash_of(x) -> int:
    return 0 if x is None else 1 + zlib.crc32(x.encode()) % (NAMED - 1)


@dataclass
class Views:
    """Log odds of good against bad: one weight for a gram, one for a category."""

    gram: np.ndarray
    category: np.ndarray
    #: Slope and intercept of each view, then the weights that combine the calibrated views.
    curve: np.ndarray | None = None
    mix: np.ndarray | None = None
    #: Labels that each view had from the other one in the last round.
    taught: tuple[int, int] = (0, 0)
    #: Weight of each word's bucket as a sign of a toxic document, and slope and intercept of their sum.
    word: np.ndarray | None = None
    slope: np.ndarray | None = None

    def toxic(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Sum of the strongest words of each document.  Few words make a document toxic, however long it is."""
        doc, bucket = presence(buf, off)
        w = self.word[bucket]
        doc, w = doc[w > 0], w[w > 0]
        order = np.lexsort((-w, doc))
        doc, w = doc[order], w[order]
        strong = np.arange(len(doc)) - np.searchsorted(doc, doc) < STRONGEST
        return np.bincount(doc[strong], weights=w[strong], minlength=len(off) - 1)

    def raw(self, h: np.ndarray, n: np.ndarray, meta: np.ndarray) -> np.ndarray:
        a = per_document(self.gram[h], n) / np.maximum(n, 1)
        return np.stack([a, self.category[meta].sum(axis=1)], axis=1)

    def probabilities(self, raw: np.ndarray) -> np.ndarray:
        """Of the text view, of the metadata view, of both; of being toxic (0 if that was not fitted)."""
        own = raw[:, :2] * self.curve[:, 0] + self.curve[:, 1]
        toxic = np.zeros(len(raw)) if self.word is None else sigmoid(raw[:, 2] * self.slope[0] + self.slope[1])
        return np.column_stack([sigmoid(np.column_stack([own, np.clip(own, -12, 12) @ self.mix[:2] + self.mix[2]])), toxic])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept by Newton's method; the ridge keeps separable data finite."""
    design, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = sigmoid(design @ w)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w)), design.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def odds(counts: np.ndarray, smooth: float) -> np.ndarray:
    """Log odds from the weights that the two classes (bad, good) give to each entry."""
    c = counts + smooth
    c = c / c.sum(axis=1, keepdims=True)
    return np.log(c[1]) - np.log(c[0])


def summed(df: DataFrame, count, size: int) -> np.ndarray:
    """Sum of the arrays of ``size`` whole numbers that ``count`` makes of the batches of each task.  The arrays
    are cut in parts, which tasks add up; one array comes to the driver."""

    def cut(batches):
        parts = np.array_split(count(batches).astype(np.int64), PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "sums"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(x.as_buffer(), np.int64)
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["part", "sums"])

    schema = "part int, sums binary"
    rows = {r.part: np.frombuffer(r.sums, np.int64) for r in df.mapInArrow(cut, schema).repartition(PARTS, "part").mapInArrow(add, schema).collect()}
    return np.concatenate([rows[k] for k in range(PARTS)]) if rows else np.zeros(size, np.int64)


def ordered(x: np.ndarray) -> np.ndarray:
    """Numbers in the order of the scores, equal for scores that differ by less than 1 in 2,000 of themselves."""
    i = x.astype(np.float32).view(np.int32).astype(np.int64)
    return np.where(i < 0, -(i & 0x7FFFFFFF), i) >> 12


def outside(rows: pa.RecordBatch, given: dict) -> np.ndarray:
    """Whether each document is one of those that teach by pseudo-labels: it has an id and no given label."""
    return np.array([i != common.NO_ID and i not in given for i in rows.column("_id").to_pylist()], bool)


def train(docs: DataFrame, columns: list[str], mine: dict, given: dict, before: list) -> Views:
    """Naive Bayes of each view from the labels ``mine`` (document -> 0 or 1) and, for documents that are not in ``given``,
    the pseudo-labels of the rounds ``before`` (views and their cuts), of which the last one that is sure holds.  Every
    document has weight one."""
    width = BINS * MEASURES + NAMED * len(columns)
    held = docs.sparkSession.sparkContext.broadcast((mine, given, before))

    def count(batches):
        own, known, rounds = held.value
        gram, category, taught = np.zeros((2, BUCKETS)), np.zeros((2, width)), np.zeros(2)
        for rows, buf, off in text.blocks(batches):
            y = np.array([own.get(x, -1) for x in rows.column("_id").to_pylist()])
            labels = np.stack([y, y], axis=1)
            h, n = grams(buf, off)
            meta = metadata(rows, buf, off, columns)
            free = outside(rows, known)
            for views, cuts in rounds:
                at = ordered(views.raw(h, n, meta))
                for view, other in ((0, 1), (1, 0)):  # each view teaches the other what it is sure of
                    low, high = cuts[view]
                    labels[free & (at[:, view] < low), other] = 0
                    labels[free & (at[:, view] >= high), other] = 1
            taught += (free[:, None] & (labels >= 0)).sum(axis=0)
            weight = np.rint(WHOLE / np.maximum(n, 1))
            for y in (0, 1):
                own_y = labels[:, 0] == y
                gram[y] += np.bincount(h[np.repeat(own_y, n)], weights=np.repeat(weight[own_y], n[own_y]), minlength=BUCKETS)
                category[y] += np.bincount(meta[labels[:, 1] == y].ravel(), minlength=width)
        return np.concatenate([gram.ravel(), category.ravel(), taught])

    gram, category, taught = np.split(summed(docs, count, 2 * BUCKETS + 2 * width + 2).astype(np.float64), [2 * BUCKETS, 2 * (BUCKETS + width)])
    measured, named = np.split(category.reshape(2, -1), [BINS * MEASURES], axis=1)
    shares = measured.reshape(2, -1, BINS)
    weights = np.log((shares[1] + 1) / (shares[1].sum(axis=1, keepdims=True) + BINS)) - np.log((shares[0] + 1) / (shares[0].sum(axis=1, keepdims=True) + BINS))
    # a value that was seldom seen weighs little, one that was never seen nothing
    part = (shares[:, 0].sum(axis=1) + 1) / (shares[:, 0].sum() + 2)
    values = np.log((named[1] + 2 * part[1]) / part[1]) - np.log((named[0] + 2 * part[0]) / part[0])
    return Views(odds(gram.reshape(2, -1) / WHOLE, 1e-2), np.concatenate([weights.ravel(), values]), taught=tuple(int(x) for x in taught))


def train_toxic(sample: DataFrame, mine: dict) -> np.ndarray:
    """Weight of each word's bucket from how many toxic and other documents have it; 0 for words that are seldom seen
    or speak against."""
    held = sample.sparkSession.sparkContext.broadcast(mine)

    def count(batches):
        out = np.zeros((2, 1 << WORD_BITS))
        for rows, buf, off in text.blocks(batches):
            y = np.array([held.value.get(x, -1) for x in rows.column("_id").to_pylist()])
            doc, bucket = presence(buf, off)
            for k in (0, 1):
                out[k] += np.bincount(bucket[y[doc] == k], minlength=1 << WORD_BITS)
        return out.ravel()

    n = summed(sample, count, 2 << WORD_BITS).reshape(2, -1)
    all_of = np.bincount(list(mine.values()), minlength=2)[:, None]
    w = np.log((n + 0.5) / (all_of + 1))
    return np.where(n.sum(axis=0) >= SEEN, np.maximum(w[1] - w[0], 0), 0)


def cuts(docs: DataFrame, columns: list[str], views: Views, given: dict, low: float, high: float) -> list[tuple[int, int]] | None:
    """For each view the limits (in ``ordered`` scores) below and from which the shares ``low`` and ``high`` of all
    documents outside ``given`` lie, at most.  Tasks count scores, so at most 2**20 counts of a view meet on the driver."""
    held = docs.sparkSession.sparkContext.broadcast((views, given))

    def count(batches):
        for rows, buf, off in text.blocks(batches):
            views, given = held.value
            at = ordered(views.raw(*grams(buf, off), metadata(rows, buf, off, columns)))[outside(rows, given)]
            for view in (0, 1):
                x, n = np.unique(at[:, view], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), view), pa.int32()), pa.array(x), pa.array(n, pa.int64())], names=["view", "at", "n"])

    found = docs.mapInArrow(count, "view int, at long, n long").groupBy("view", "at").agg(F.sum("n").alias("n")).toPandas()
    if found.empty:
        return None
    out = []
    for view in (0, 1):
        x = found[found["view"] == view].sort_values("at")
        at, n = x["at"].to_numpy(), x["n"].to_numpy()
        below = np.searchsorted(np.cumsum(n), low * n.sum(), "right")
        above = np.searchsorted(np.cumsum(n[::-1]), high * n.sum(), "right")
        out.append((int(at[below]), int(at[len(at) - above]) if above else int(at[-1]) + 1))
    return out


def scored(df: DataFrame, views: Views, columns: list[str], names: list[str], of, carry: tuple[str, ...] = ()) -> DataFrame:
    """``_id``, the columns ``carry`` and what ``of`` makes of the raw scores of each document (and, if words were
    fitted, of the toxic score), in one pass."""
    held = df.sparkSession.sparkContext.broadcast(views)

    def run(batches):
        for rows, buf, off in text.blocks(batches):
            own = held.value
            x = own.raw(*grams(buf, off), metadata(rows, buf, off, columns))
            if own.word is not None:
                x = np.column_stack([x, own.toxic(buf, off)])
            x = of(own, x)
            yield pa.RecordBatch.from_arrays([rows.column("_id"), *(rows.column(c) for c in carry), *(pa.array(x[:, k]) for k in range(len(names)))], names=["_id", *carry, *names])

    return df.mapInArrow(run, df.select("_id", *carry, *[F.lit(0.0).alias(c) for c in names]).schema)


def fit(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, rounds: int, confident: float) -> Views | None:
    """Fits on at most ``most`` labelled documents, taken by the order of a hash of the id, a fifth of them kept apart for
    calibration, and on all other documents, which get pseudo-labels in the tasks that read them.  The driver holds ids, labels
    and scores of the labelled sample only."""
    spark = docs.sparkSession
    agreed = [F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in ("_y", "_t")]
    known = labels.where("_id is not null").select("_id", *[F.when(F.col(c).isin(0, 1), F.col(c)).alias(c) for c in ("_y", "_t")]).groupBy("_id").agg(*agreed).where("_y is not null or _t is not null")
    ids = docs.select("_id").where(F.col("_id") != common.NO_ID).distinct()
    taken = ids.join(known, "_id").orderBy(F.xxhash64("_id"), "_id").limit(most).collect()  # rows of three numbers
    given = {r._id: r._y for r in taken if r._y is not None}
    toxic = {r._id: r._t for r in taken if r._t is not None}
    if len(set(given.values())) < 2:
        return None
    wanted = spark.createDataFrame([(i,) for i in given | toxic], "_id long")
    sample = common.saved(docs.join(F.broadcast(wanted), "_id"))
    order = sorted(given)
    apart = {i for k, i in enumerate(order) if k % 5 == 0}
    mine = {i: y for i, y in given.items() if i not in apart}
    if len(set(mine.values())) < 2:
        mine = dict(given)
    good = np.mean(list(mine.values()))
    views, before = train(sample, columns, mine, given, []), []
    for _ in range(rounds):
        limits = cuts(docs, columns, views, given, confident * (1 - good), confident * good)
        if limits is None:
            break
        before.append((views, limits))
        views = train(docs, columns, mine, given, before)
    held_back = {i for k, i in enumerate(sorted(toxic)) if k % 5 == 0}
    fitted = {i: t for i, t in toxic.items() if i not in held_back}
    if len(set(fitted.values())) == 2 and len({toxic[i] for i in held_back}) == 2:
        views.word = train_toxic(sample, fitted)
    names = ["_a", "_b"] if views.word is None else ["_a", "_b", "_w"]
    s = scored(sample, views, columns, names, lambda v, x: x).toPandas().drop_duplicates("_id").set_index("_id")
    if views.word is not None:
        own = s[s.index.isin(list(held_back))]
        views.slope = logistic(own[["_w"]].to_numpy(), np.array([toxic[int(i)] for i in own.index], np.float64))
    held_out = s[s.index.isin(list(apart))]
    y = np.array([given[int(i)] for i in held_out.index], np.float64)
    raw = held_out[["_a", "_b"]].to_numpy()
    views.curve = np.array([logistic(raw[:, [k]], y) for k in (0, 1)])
    views.mix = logistic(np.clip(raw * views.curve[:, 0] + views.curve[:, 1], -12, 12), y)
    return views


def classify(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", columns: tuple[str, ...] = ("lang", "source"),
    most: int = 10_000, rounds: int = 3, confident: float = 0.2, least: float = 0.4,
    carry: tuple[str, ...] = (), toxic_col: str = "toxic", toxic: float = 0.5,
) -> DataFrame:
    """(id_col, p_text, p_meta, p_quality, kept) of every document, behind the columns ``carry``.

    Two classifiers see different sides of a document: its text (hashed runs of three bytes, naive Bayes)
    and its metadata (``columns`` and the layout of the page, in bins, naive Bayes).  For ``rounds`` rounds
    each labels the share ``confident`` of all unlabelled documents it is surest of, in the classes' proportion, for the other
    one to learn from.  Both are calibrated on labelled documents kept apart, and a logistic regression of the calibrated views
    gives ``p_quality``; ``kept`` is p_quality >= ``least`` and a probability of being toxic under ``toxic``.  That comes, where
    the labels have the column ``toxic_col`` with both classes, from the words that stand in toxic documents of the labelled
    sample and not in others, calibrated on documents kept apart.  ``most`` bounds the labelled
    sample alone: labelled documents beyond it count as unlabelled.  A round reads all documents twice, to count the scores
    and to count grams and categories by label; the scores come from one more pass.

    Null text counts as empty.  Labels that are null, not 0 or 1, or contradict each other for a
    document do not count.  With no two classes of labels all documents are kept and the probabilities
    are null.  A row without id is scored like others.  Equal rows give equal rows; other columns are ignored.
    """
    columns = list(columns)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(common.NO_ID)).alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).cast("string").alias(f"_c{k}") for k, c in enumerate(columns)], *[F.col(c).alias(f"_x{k}") for k, c in enumerate(carry)])
    carried = tuple(f"_x{k}" for k in range(len(carry)))
    given = [F.col(x).alias(c) for x, c in zip(carried, carry, strict=True)]
    columns = [f"_c{k}" for k in range(len(columns))]
    bad = F.col(toxic_col) if toxic_col in labels.columns else F.lit(None)
    views = fit(docs, labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"), bad.cast("int").alias("_t")), columns, most, rounds, confident)
    names = ["p_text", "p_meta", "p_quality"]
    if views is None:
        return docs.select(common.real_id().alias(id_col), *given, *[F.lit(None).cast("double").alias(c) for c in names], F.lit(True).alias("kept"))
    out = scored(docs, views, columns, [*names, "_toxic"], lambda v, x: v.probabilities(x), carried)
    return out.select(common.real_id().alias(id_col), *given, *names, ((F.col("p_quality") >= least) & (F.col("_toxic") < toxic)).alias("kept"))
