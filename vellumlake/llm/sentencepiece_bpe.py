"""SentencePiece BPE by a prefix table.

For each prefix of a text the last token of its encoding is unique. One pass of an
Aho-Corasick automaton lists the tokens that end at each place; the one that fits is the
token whose left neighbour (the last token of the prefix before it) stays its neighbour when
the two are encoded together. The table then gives the ids backwards, in linear time.

Defined results: null and empty texts have no tokens; characters that no piece holds become
byte pieces; equal texts have equal ids; columns besides id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumlake.llm.common import map_arrow, pieces, text_or_empty

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
#: Entries that a worker's table of encoded units may have before it starts anew; it is a cache only.
UNITS = 400_000


def _fields(raw: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        n = shift = 0
        while True:
            b = raw[i]
            i += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = varint() if size is None else size
            yield key >> 3, raw[i : i + size]
            i += size


class _Units(dict):
    """unit -> its ids as text; encodes what it has not met."""

    def __init__(self, model: PieceModel):
        self.model, self.odd = model, {}

    def __missing__(self, unit: str) -> str:
        ids = self.model.encode_unit(unit)
        out = ",".join(map(str, ids))
        back = self.model._join(ids)
        if len(self) >= UNITS:
            self.clear()
            self.odd.clear()
        if back != unit.replace(SPACE, " "):
            self.odd[unit] = back
        self[unit] = out
        return out


class PieceModel:
    """A SentencePiece BPE model without user-defined pieces or a character map."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.dummy_prefix, self.byte_fallback, kind, charsmap = True, False, 1, b""
        self.piece: list[str] = []
        self.score: list[float] = []
        self.type: list[int] = []
        for n, v in _fields(raw):
            if n == 1:
                x = dict(_fields(v))
                self.piece.append(x[1].decode())
                self.score.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.type.append(x.get(3, NORMAL))
            elif n == 2:
                x = dict(_fields(v))
                kind, self.byte_fallback = x.get(3, 1), bool(x.get(35, 0))
            elif n == 3:
                x = dict(_fields(v))
                charsmap, self.dummy_prefix = x.get(2, b""), bool(x.get(3, 1))
                if x.get(4, 1) or not x.get(5, 1):
                    raise ValueError("only models that keep extra spaces and escape them are supported")
        if kind != 2 or charsmap or USER_DEFINED in self.type or not self.byte_fallback:
            raise ValueError("only BPE models with byte fallback, without character maps and user-defined pieces, are supported")
        self.id = {p: i for i, p in enumerate(self.piece) if self.type[i] in (NORMAL, UNUSED)}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if self.type[i] == BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        # no piece crosses such a place, so what stands on its two sides is encoded apart
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        lines = not any("\n" in p for p in self.id)
        self._split = re.compile({
            (True, True): f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+",
            (True, False): f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+",
            (False, True): "[^\n]+|\n+",
            (False, False): r"(?s:.+)",
        }[apart, lines]).findall
        self.size = [len(p) for p in self.piece]
        self._pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self._merged(p) == [p]:  # others never are the result of merges
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.units = _Units(self)

    def _merged(self, s: str) -> list[str]:
        """The merges themselves, over a short string: best score first, leftmost among equals."""
        parts, ids, score = list(s), self.id, self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay two tokens when their texts are encoded together."""
        key = a << 20 | b
        known = self._pairs.get(key)
        if known is None:
            x, y = self.piece[a], self.piece[b]
            known = x + y not in self.id and self._merged(x + y) == [x, y]
            if len(self._pairs) >= 2_000_000:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def encode_unit(self, s: str) -> list[int]:
        last = [-1] * (len(s) + 1)  # of each prefix: its last token; -1: a character without piece
        size, pairs = self.size, self._pairs
        for end, t in self.automaton.iter(s):
            end += 1
            if last[end] < 0:
                start = end - size[t]
                before = last[start] if start else -1
                if before < 0:
                    last[end] = t
                else:
                    ok = pairs.get(before << 20 | t)
                    if ok or ok is None and self.compatible(before, t):
                        last[end] = t
        out, i = [], len(s)
        while i:
            t = last[i]
            if t >= 0:
                out.append(t)
                i -= size[t]
            else:
                i -= 1
                out.extend(self.byte[b] for b in reversed(s[i].encode("utf-8", "surrogatepass")))
        out.reverse()
        return out

    def normalized(self, text: str) -> str:
        return ((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)) if text else ""

    def encode(self, text: str) -> list[int]:
        return [i for u in self._split(self.normalized(text)) for i in self.encode_unit(u)]

    def _join(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if self.type[i] == CONTROL:
                continue
            out.append(" ⁇ " if self.type[i] == UNKNOWN else self.piece[i].replace(SPACE, " "))
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        s = self._join(ids)
        return s[1:] if self.dummy_prefix and ids and self.piece[ids[0]].startswith(SPACE) else s

    def encoded(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as decimal text, the decoded text; by the worker's table of units."""
        if not text:
            return 0, "", ""
        units = self._split(self.normalized(text))
        table = self.units
        ids = ",".join([table[u] for u in units])
        odd = table.odd
        back = "".join([odd[u] if u in odd else u.replace(SPACE, " ") for u in units]) if odd else "".join(units).replace(SPACE, " ")
        first = int(ids[: ids.find(",")] if "," in ids else ids)
        return ids.count(",") + 1, ids, back[1:] if self.dummy_prefix and self.piece[first].startswith(SPACE) else back


def _utf8(run: bytes) -> str:
    """Each byte that no character takes in gives one replacement character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, keep_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids themselves; no shuffle."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(whole: pa.RecordBatch):
        m = model(model_path)
        for batch in pieces(whole):
            n, ids, back, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                k, s, d = m.encoded(text)
                n.append(k)
                ids.append(hashlib.sha256(s.encode()).hexdigest())
                back.append(hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest())
                if keep_ids:
                    lists.append([int(x) for x in s.split(",")] if s else [])
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(lists, pa.list_(pa.int32()))] * keep_ids, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return map_arrow(df.select(F.col(id_col), text_or_empty(text_col).alias("_text")), run, schema)
