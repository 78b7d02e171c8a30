"""SentencePiece merge encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from barlume.llm import common, text

SPACE = "▁"
#: Segments and token pairs remembered by one worker.
REMEMBER = 250_000


class Pieces:
    """Encodes as merging by score does: among all neighbours whose concatenation is a
    piece, the best piece (leftmost among equals) is formed first, again and again.

    A sequence of pieces is that result exactly when every two neighbours, merged anew from
    characters, give themselves back.  So the encoder walks the text: at each position it
    tries the longest match compatible with the piece before, then shorter ones; where none
    is left it steps back and marks the position failed in a bit field, for no encoding passes it.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(len(self.pieces))]
        self.score = {p: sp.get_score(i) for i, (p, x) in enumerate(zip(self.pieces, special, strict=True)) if not x}
        self.id = {p: i for i, (p, x) in enumerate(zip(self.pieces, special, strict=True)) if not x}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = {i: bytes([b]) for b, i in enumerate(self.byte_id)}
        self.raw |= {i: p.replace(SPACE, " ").encode() for p, i in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if self.merge(p) == [p]:  # a piece that merging never forms is no match
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        # characters that stand in no longer piece, and a space that follows nothing in one, cut the text
        alone = "".join(c for c in "\n\t\r" if not any(c in p and p != c for p in self.id))
        cut = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        lone = f"[{alone}]|" if alone else ""
        self.segment = re.compile(f"{lone}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if cut else r"(?s:.+)")
        self.known = text.Memory(self.part, REMEMBER)
        self.pairs = text.Memory(lambda pair: self.merge(pair[0] + pair[1]) == [*pair], REMEMBER)

    def merge(self, s: str) -> list[str]:
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def walk(self, s: str) -> list[str]:
        matches: list[list[str]] = [[] for _ in s]
        for end, p in self.automaton.iter(s):
            matches[end - len(p) + 1].append(p)  # shortest first
        for c, m in zip(s, matches, strict=True):
            if not m or len(m[0]) > 1:
                m.insert(0, c)  # a character that is no piece stands for its bytes
        n, pos, failed, compatible = len(s), 0, 0, self.pairs
        out: list[str] = []
        tried: list[int] = []
        k = len(matches[0]) - 1
        while pos < n:
            m, before = matches[pos], out[-1] if out else None
            while k >= 0 and (failed >> (pos + len(m[k])) & 1 or before is not None and not compatible[before, m[k]]):
                k -= 1
            if k >= 0:
                out.append(m[k])
                tried.append(k)
                pos += len(m[k])
                k = len(matches[pos]) - 1 if pos < n else 0
            else:
                failed |= 1 << pos
                pos -= len(out.pop())
                k = tried.pop() - 1
        return out

    def part(self, s: str) -> tuple[int, ...]:
        ids, byte = self.id, self.byte_id
        return tuple(chain.from_iterable((ids[p],) if p in ids else [byte[b] for b in p.encode()] for p in self.walk(s)))

    def encode(self, s: str) -> list[int]:
        if not s:
            return []
        known = self.known
        return list(chain.from_iterable([known[x] if len(x) <= 64 else self.part(x) for x in self.segment.findall(SPACE + s.replace(" ", SPACE))]))

    def decode(self, ids) -> str:
        s = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return s[1:] if s[:1] == " " else s


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded): the library's ids of the whole text with the merge model
    at ``model`` (a path that every worker has), without begin and end, and the text
    that they decode to.  One pass, no shuffle; a worker remembers the segments
    between spaces it has met, up to a fixed number.

    Null text counts as empty and gives no ids and an empty text.  Equal rows each give
    their row; null ids stay null; other columns are ignored.
    """

    def run(batches):
        p = pieces(model)
        for rows, buf, off in text.blocks(batches):
            ids = [np.array(p.encode(x or ""), np.int32) for x in rows.column("_text").to_pylist()]
            end = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            flat = pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([rows.column("_id"), flat, pa.array([p.decode(x.tolist()) for x in ids], pa.string())], names=["_id", "ids", "decoded"])

    return common.documents(df, id_col, text_col).mapInArrow(run, "_id long, ids array<int>, decoded string").select(common.real_id().alias(id_col), "ids", "decoded")
