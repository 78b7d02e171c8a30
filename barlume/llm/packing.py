"""Best-fit packing of tokenised documents by bin completion over size counts."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlume.llm import common, text

#: Fixed value: the pattern by which a byte-level vocabulary of this kind splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself
    where it is printable, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def encoder(path: str) -> tiktoken.Encoding:
    """Encoder of the vocabulary in a tokenizer's file; its added tokens are found in texts as the library finds them.

    It is built from the file's own pieces, whose ids are in the order of their merges; without that
    order the file is refused."""
    model = json.loads(open(path, encoding="utf-8").read())
    byte, special = byte_of(), {t["content"]: t["id"] for t in model["added_tokens"]}
    vocab = {k: v for k, v in model["model"]["vocab"].items() if k not in special}
    formed = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
    if formed != sorted(formed) or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"] or model.get("normalizer"):
        raise ValueError(f"{path}: not a byte-level vocabulary in merge order")
    if any(t[k] for t in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: an added token that is not taken as it stands")
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in k): v for k, v in vocab.items()}, special_tokens=special)


def pieces(docs: DataFrame, tokenizer: str, room: int) -> DataFrame:
    """(_id, piece, start, length, crc, _chunk, _rank): the pieces to pack.  ``_chunk`` is the task
    that made a piece and ``_rank`` its number among the task's pieces of that length."""

    def run(batches):
        encode, seen, chunk = encoder(tokenizer).encode_to_numpy, np.zeros(room + 1, np.int64), TaskContext.get().partitionId()
        for rows, _, _ in text.blocks(batches):
            out = []
            for i, s in zip(rows.column("_id").to_pylist(), rows.column("_text").to_pylist(), strict=True):
                ids = np.append(encode(s or "", allowed_special="all"), np.uint32(0))
                first = (len(ids) - 1) % room + 1  # the first piece takes what whole pieces leave
                cut = [0, *range(first, len(ids) + 1, room)]
                for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    out.append((i, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), chunk, int(seen[b - a])))
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["_id", "piece", "start", "length", "crc", "_chunk", "_rank"])

    return docs.mapInArrow(run, "_id long, piece int, start long, length long, crc long, _chunk int, _rank long")


def reachable(sizes: list[int], counts: list[int], room: int) -> np.ndarray:
    """For each sum up to ``room`` the last place in ``sizes`` from which on items at hand make that sum, or -1."""
    last, sums, mask = np.full(room + 1, -1, np.int16), 1, (2 << room) - 1
    last[0] = len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        s, more, n, k = sizes[i], sums, min(counts[i], room // sizes[i]), 1
        while n > 0:
            more |= more << s * min(k, n) & mask
            n, k = n - k, 2 * k
        new, sums = more & ~sums, more
        while new:
            last[(new & -new).bit_length() - 1] = i
            new &= new - 1
        if sums == mask:
            break
    return last


def dominated(fill: tuple[int, ...], waste: int, spare: list[int]) -> bool:
    """Whether an item left over (sizes ``spare``) fits in beside the filling, or in the place of several of its items
    and their share of the waste: then the filling with that item is as good or better."""
    if any(s <= waste for s in spare):
        return True
    one, several = 0, 0
    for s in fill:
        several |= several << s | one << s
        one |= 1 << s
    for w in range(waste + 1):
        if any(several >> s - w & 1 for s in spare if s > w):
            return True
    return False


def completions(left: dict[int, int], top: int, room: int) -> Iterator[tuple[int, ...] | None]:
    """Fillings of ``room`` around one item of size ``top``, by any number of further items, one by one: least waste
    first, then larger items first.  None stands for a filling that is dominated.  ``left`` may change
    while the caller holds a filling and must be as it was when the next is asked for."""
    room -= top
    sizes = sorted((s for s, n in left.items() if s <= room and n > (s == top)), reverse=True)
    count = [left[s] - (s == top) for s in sizes]
    last = reachable(sizes, count, room)

    def fills(at: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        for i in range(at, last[total] + 1):
            s = sizes[i]
            for k in range(min(total // s, count[i]), 0, -1):
                if last[total - k * s] > i:
                    for rest in fills(i + 1, total - k * s):
                        yield (s,) * k + rest

    for total in np.flatnonzero(last >= 0)[::-1].tolist():
        for fill in fills(0, total):
            used = Counter(fill)
            yield None if dominated(fill, room - total, [s for s, n in zip(sizes, count, strict=True) if n > used[s]]) else fill


def best_fit(counts: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: sequences with the same filling are made at once."""
    left, plan, sizes = dict(counts), [], sorted(counts)
    while sizes:
        fill, space, need, at = [], room, {}, len(sizes)
        while at := bisect_right(sizes, space, 0, at):  # the largest item that still fits, as best fit leaves it
            at -= 1
            s = sizes[at]
            need[s] = k = min(space // s, left[s])
            fill += [s] * k
            space -= s * k
        times = min(left[s] // k for s, k in need.items())
        plan.append((tuple(fill), times))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del sizes[bisect_right(sizes, s) - 1]
    return plan


def bins(plan) -> int:
    return sum(n for _, n in plan)


def plan(counts: dict[int, int], room: int, nodes: int = 3000) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, for the given number of items by size.

    Bin completion: the largest item left opens a sequence and the undominated fillings around
    it are tried from the least waste up, first each as often as the counts allow at a time, then each once.  A
    branch ends where the waste so far leaves no way below the incumbent.  The incumbents are
    best-fit solutions, from the start and from the nodes visited.  ``nodes`` bounds how many fillings are
    looked at and nothing else does: a search that ends before gives the fewest sequences, and the result always
    places every item.  The work depends on the number of different sizes only.
    """
    total = sum(s * n for s, n in counts.items())
    big = sum(n for s, n in counts.items() if 2 * s > room)
    least = max(-(-total // room), big)
    best = best_fit(counts, room)

    def options() -> Iterator[tuple | None]:
        """Ways to fill a sequence around the largest item; taken on only while ``left`` is what it was at first."""
        top = max(left)
        for once in (False, True):
            for fill in completions(left, top, room):
                if fill is None:
                    yield None
                    continue
                need = Counter((top, *fill))
                times = min(left[x] // k for x, k in need.items())
                if not once or times > 1:
                    yield (top, *fill), need, 1 if once else times

    def move(need: Counter, n: int) -> None:
        for x, k in need.items():
            left[x] = left.get(x, 0) - k * n
            if not left[x]:
                del left[x]

    # depth first; what is left is one table that each step changes and undoes
    left, done, used, waste, visited = dict(counts), [], 0, 0, 0
    open_options = [options()] if left else []
    while open_options and bins(best) > least and visited < nodes:
        option = next(open_options[-1], False)
        if option is None:
            visited += 1
            continue
        if option:
            fill, need, times = option
            move(need, times)
            done.append((fill, need, times))
            used, waste, visited = used + times, waste + times * (room - sum(fill)), visited + 1
            so_far = [(f, n) for f, _, n in done] if not left or visited % 64 == 1 else []
            if not left and used < bins(best):
                best = so_far
            elif left and visited % 64 == 1:
                rest = best_fit(left, room)
                if used + bins(rest) < bins(best):
                    best = [*so_far, *rest]
            if left and waste <= (bins(best) - 1) * room - total:
                open_options.append(options())
                continue
        else:
            open_options.pop()
            if not open_options:
                break
        fill, need, times = done.pop()
        move(need, -times)
        used, waste = used - times, waste - times * (room - sum(fill))
    return best


def places(filled: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By size: first rank of each run of ranks, its first sequence, items a sequence, first offset."""
    at: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for fill, times in filled:
        offset = 0
        for s in sorted(set(fill), reverse=True):
            k = fill.count(s)
            at.setdefault(s, []).append((rank.get(s, 0), sequence, k, offset))
            rank[s] = rank.get(s, 0) + k * times
            offset += k * s
        sequence += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for s, rows in at.items()}


def pack(df: DataFrame, tokenizer: str, room: int = 2048, id_col: str = "doc_id", text_col: str = "text", nodes: int = 3000) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): every document, as
    token ids and a closing 0, in sequences of at most ``room`` tokens.

    Ids are those that the tokenizers library gives for the file with add_special_tokens=False: none is put around a
    text, but an added token that stands in the text gets its id.
    Only longer documents are cut, into pieces of ``room`` behind a first piece with
    the rest.  What has to be decided depends on the number of pieces of each
    size alone: at most ``room`` counts go to the driver, ``plan`` fills sequences from them, and
    each piece finds its place by its number among the pieces of its size, which comes from
    the counts of the tasks before and needs no global order.

    Null text counts as empty: one piece with the closing 0.  Equal rows are packed
    each on its own; null ids stay null; other columns are ignored; an empty table gives no rows.
    """
    made = common.saved(pieces(common.documents(df, id_col, text_col), tokenizer, room))
    counts = common.saved(made.groupBy("_chunk", "length").agg(F.count("*").alias("n")))
    sizes = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(sizes, room, nodes))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    base = base.groupBy("_chunk").agg(F.collect_list(F.struct("length", "_base")).alias("_bases"))  # at most ``room`` a task

    def put(batches):
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy() + b.column("_base").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                m = size == s
                lo, first, k, off = where[int(s)]
                j = np.searchsorted(lo, rank[m], "right") - 1
                within = rank[m] - lo[j]
                sequence[m] = first[j] + within // k[j]
                offset[m] = off[j] + within % k[j] * s
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "piece", "start", "length", "crc")), pa.array(sequence), pa.array(offset)], names=["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    offsets = base.select("_chunk", F.map_from_entries("_bases").alias("_bases"))
    joined = made.join(offsets, "_chunk").withColumn("_base", F.col("_bases")[F.col("length")]).drop("_bases")
    out = joined.mapInArrow(put, "_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select(common.real_id().alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
