"""Content streams: filters, tokens, and a walk that keeps the graphics state and gives characters."""

from __future__ import annotations

import binascii
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 16 << 20
MOST_NESTING = 128
_SPACE = b" \t\r\n\x0c\x00"
_TOKEN = re.compile(
    rb"[ \t\r\n\x0c\x00]*(?:%[^\r\n]*[ \t\r\n\x0c\x00]*)*"
    rb"(?:(?P<dict><<|>>)|(?P<array>[\[\]])|(?P<name>/[^ \t\r\n\x0c\x00()<>\[\]{}/%]*)|<(?P<hex>[0-9A-Fa-f \t\r\n\x0c\x00]*)>"
    rb"|(?P<string>\()|(?P<num>[+-]*(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:-[0-9]*)?)|(?P<op>[A-Za-z'\"*][A-Za-z0-9'\"*]*))"
)


class BadStream(ValueError):
    pass


def decode(data: bytes, filters: list[str], most: int = MOST_BYTES) -> bytes:
    """data through its filters; more than `most` bytes, or a filter that isn't known, is an error."""
    for f in filters:
        if f in ("FlateDecode", "Fl"):
            d = zlib.decompressobj()
            try:
                data = d.decompress(data, most + 1)
            except zlib.error as e:
                raise BadStream(str(e)) from None
        elif f in ("ASCIIHexDecode", "AHx"):
            body = bytes(c for c in data.split(b">", 1)[0] if c not in _SPACE)
            try:
                data = binascii.unhexlify(body + b"0" * (len(body) % 2))
            except binascii.Error as e:
                raise BadStream(str(e)) from None
        else:
            raise BadStream(f"filter {f}")
        if len(data) > most:
            raise BadStream("too long")
    return data


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    depth, out = 1, bytearray()
    while at < len(data):
        c = data[at]
        if c == 92 and at + 1 < len(data):
            m = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            if m:
                out.append(int(m[0], 8) & 255)
                at = m.end()
                continue
            out += {110: b"\n", 114: b"\r", 116: b"\t", 98: b"\b", 102: b"\f", 10: b"", 13: b""}.get(data[at + 1], data[at + 1 : at + 2])
            at += 2
            continue
        depth += (c == 40) - (c == 41)
        at += 1
        if not depth:
            return bytes(out), at
        if depth > MOST_NESTING:
            raise BadStream("nesting")
        out.append(c)
    raise BadStream("open string")


def tokens(data: bytes) -> Iterator[tuple[str, object, int, int]]:
    """(kind, value, start, end) of a content stream; inline images are skipped as one token."""
    at = 0
    while at < len(data):
        m = _TOKEN.match(data, at)
        if not m:
            if not data[at:].strip(_SPACE):
                return
            at += 1
            continue
        kind, start = m.lastgroup, m.start(m.lastgroup)
        at = m.end()
        if kind == "string":
            value, at = _string(data, at)
            yield "string", value, start, at
        elif kind == "hex":
            body = bytes(c for c in m["hex"] if c not in _SPACE)
            yield "string", binascii.unhexlify(body + b"0" * (len(body) % 2)), start - 1, at
        elif kind == "num":
            text = re.sub(rb"(?<=.)-.*", b"", m["num"].lstrip(b"+-"))
            yield "number", float(text or 0) * (-1 if m["num"].startswith(b"-") else 1), start, at
        elif kind == "op" and m["op"] == b"ID":
            end = data.find(b"EI", at)
            at = end + 2 if end >= 0 else len(data)
            yield "image", None, start, at
        else:
            yield kind, m[kind].decode("latin-1"), start, at


def _times(m, n):
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


MOST_FORMS = 64  # forms inside forms


@dataclass(frozen=True)
class XObject:
    """What a content stream may draw by name. names: a form's own resources; None: those of its caller."""

    subtype: str
    ident: str | None = None
    data: bytes = b""
    filters: tuple[str, ...] = ()
    names: dict[str, XObject] | None = None
    matrix: tuple[float, ...] = _UNIT


def walk(data: bytes, advance: float = 0.5, names: dict[str, XObject] | None = None, *, mode: int = 0, ctm: tuple = _UNIT, active: tuple[str | None, ...] = ()) -> tuple[list[tuple], dict]:
    """Characters (pos, byte code, x, y, size, render mode) in drawing order with what the page shows: counts of visible
    and invisible text shows, images, and whether reading was complete: q/Q and BT/ET balanced, each drawn object known
    by its name. Forms are read where they are drawn, in the caller's render mode; one that draws itself, or more than
    MOST_FORMS inside each other, are left out as incomplete. Every byte advances by `advance` em."""
    stack, args, out = [], [], []
    state = {"ctm": ctm, "size": 0.0, "mode": mode, "lead": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "rise": 0.0}
    tm = line = _UNIT
    seen = {"visible": 0, "invisible": 0, "images": 0, "complete": True}
    inside = False

    def show(text: bytes) -> None:
        nonlocal tm
        seen["invisible" if state["mode"] in (3, 7) else "visible"] += bool(text)
        for b in text:
            m = _times(tm, state["ctm"])
            out.append((len(out), b, m[4] + m[2] * state["rise"], m[5] + m[3] * state["rise"], state["size"] * (m[2] ** 2 + m[3] ** 2) ** 0.5, state["mode"]))
            step = (advance * state["size"] + state["char"] + (state["word"] if b == 32 else 0)) * state["scale"]
            tm = _times((1, 0, 0, 1, step, 0), tm)

    def draw(x: XObject | None) -> None:
        if x is not None and x.subtype == "Image":
            seen["images"] += 1
            return
        if x is None or x.subtype != "Form" or len(active) >= MOST_FORMS or (x.ident is not None and x.ident in active):
            seen["complete"] = False
            return
        try:
            inner, said = walk(decode(x.data, list(x.filters)), advance, names if x.names is None else x.names, mode=state["mode"], ctm=_times(x.matrix, state["ctm"]), active=(*active, x.ident))
        except BadStream:
            seen["complete"] = False
            return
        at = len(out)
        out.extend((at + i, *c[1:]) for i, c in enumerate(inner))
        for key in ("visible", "invisible", "images"):
            seen[key] += said[key]
        seen["complete"] &= said["complete"]

    for kind, value, _, _ in tokens(data):
        if kind == "image":
            seen["images"] += 1
            args = []
            continue
        if kind != "op":
            args.append(value)
            continue
        n = [a for a in args if isinstance(a, float)]
        if value == "q":
            stack.append(dict(state))
        elif value == "Q":
            if stack:
                state = stack.pop()
            else:
                seen["complete"] = False
        elif value == "cm" and len(n) >= 6:
            state["ctm"] = _times(tuple(n[-6:]), state["ctm"])
        elif value == "BT":
            seen["complete"] &= not inside
            inside, tm, line = True, _UNIT, _UNIT
        elif value == "ET":
            seen["complete"] &= inside
            inside = False
        elif value in ("Td", "TD") and len(n) >= 2:
            if value == "TD":
                state["lead"] = -n[-1]
            tm = line = _times((1, 0, 0, 1, n[-2], n[-1]), line)
        elif value == "Tm" and len(n) >= 6:
            tm = line = tuple(n[-6:])
        elif value in ("T*", "'", '"'):
            tm = line = _times((1, 0, 0, 1, 0, -state["lead"]), line)
        elif value in ("Tf", "Tr", "TL", "Tc", "Tw", "Tz", "Ts") and n:
            key = {"Tf": "size", "Tr": "mode", "TL": "lead", "Tc": "char", "Tw": "word", "Tz": "scale", "Ts": "rise"}[value]
            state[key] = n[-1] / 100 if key == "scale" else int(n[-1]) if key == "mode" else n[-1]
        if value in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
            show(args[-1])
        elif value == "TJ":
            for a in args:
                if isinstance(a, bytes):
                    show(a)
                elif isinstance(a, float):
                    tm = _times((1, 0, 0, 1, -a / 1000 * state["size"] * state["scale"], 0), tm)
        elif value == "Do":
            draw((names or {}).get(args[0]) if len(args) == 1 and isinstance(args[0], str) else None)
        args = []
    seen["complete"] &= not stack and not inside
    return out, seen


#: Of a page: who knows the object by this name ("" is the page, else a form's object), whether it has resources itself.
XOBJECTS = "array<struct<owner:string,name:string,object:string,subtype:string,data:binary,filters:array<string>,own:boolean>>"


def _names(rows) -> dict[str, XObject]:
    """The page's names from its XOBJECTS."""
    rows = [] if rows is None else [r if isinstance(r, dict) else r.asDict() for r in rows]
    scopes: dict[str, dict[str, XObject]] = {"": {}, **{r["owner"]: {} for r in rows}}
    for r in rows:
        own = scopes.setdefault(r["object"], {}) if r["own"] else None
        scopes[r["owner"]][r["name"]] = XObject(r["subtype"], r["object"], bytes(r["data"] or b""), tuple(r["filters"] if r["filters"] is not None else ()), own)
    return scopes[""]


def _read(streams: DataFrame, schema: str, rows_of) -> DataFrame:
    """rows_of(walk result or None) for each stream; None: it can't be decoded."""
    if "xobjects" not in streams.columns:
        streams = streams.withColumn("xobjects", F.lit(None).cast(XOBJECTS))

    def run(batches):
        for pdf in batches:
            rows = []
            for d, p, data, filters, objects in zip(pdf.document, pdf.page_index, pdf.data, pdf.filters, pdf.xobjects):
                try:
                    got = walk(decode(bytes(data), list(filters)), names=_names(objects))
                except BadStream:
                    got = None
                rows += [(d, p, *r) for r in rows_of(got)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return streams.select("document", "page_index", "data", "filters", "xobjects").mapInPandas(run, schema)


def characters(streams: DataFrame) -> DataFrame:
    """streams: document, page_index, data (binary), filters (array) and, if there are any, xobjects. One row a
    character, those of forms included; a stream that can't be decoded has none."""
    return _read(streams, "document string, page_index int, pos int, code int, x double, y double, size double, render_mode int", lambda got: got[0] if got else [])


def evidence(streams: DataFrame) -> DataFrame:
    """What each page shows; a stream that can't be read counts as incomplete."""
    none = {"visible": 0, "invisible": 0, "images": 0, "complete": False}

    def one(got):
        seen = got[1] if got else none
        return [(seen["visible"], seen["invisible"], seen["images"] > 0, bool(seen["complete"]))]

    return _read(streams, "document string, page_index int, visible int, invisible int, image boolean, complete boolean", one)


def cmap(text: str) -> tuple[dict[int, str], list[tuple[int, int, int]]]:
    """A ToUnicode map: code -> text, and the codespace ranges (bytes, low, high)."""
    codes: dict[int, str] = {}
    word = lambda h: bytes.fromhex(h).decode("utf-16-be", "replace")
    spaces = [(len(a) // 2, int(a, 16), int(b, 16)) for part in re.findall(r"begincodespacerange(.*?)endcodespacerange", text, re.S) for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)]
    for part in re.findall(r"beginbfchar(.*?)endbfchar", text, re.S):
        codes.update((int(a, 16), word(b)) for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part))
    for part in re.findall(r"beginbfrange(.*?)endbfrange", text, re.S):
        for a, b, one, many in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", part, re.S):
            low, high = int(a, 16), int(b, 16)
            targets = re.findall(r"<([0-9A-Fa-f]+)>", many) if many else None
            for k in range(low, min(high, low + 65535) + 1):
                if targets is None:
                    codes[k] = word(f"{int(one, 16) + k - low:0{len(one)}x}")
                elif k - low < len(targets):
                    codes[k] = word(targets[k - low])
    return codes, spaces


def ppm(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and RGB bytes of a binary pixmap of 8 bits."""
    m = re.match(rb"P6(?:\s+#[^\n]*\n|\s)\s*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not m or int(m[3]) != 255:
        raise BadStream("not an 8-bit P6 pixmap")
    w, h = int(m[1]), int(m[2])
    body = data[m.end() : m.end() + 3 * w * h]
    if len(body) != 3 * w * h:
        raise BadStream("short pixmap")
    return w, h, body


def pixel_fidelity(pairs: DataFrame) -> DataFrame:
    """pairs: document, page_index, a, b (pixmaps), mask (array of [left, top, right, bottom]). Equal and compared pixels
    outside the masks."""
    import numpy as np

    schema = "document string, page_index int, equal bigint, compared bigint"

    def run(batches):
        for pdf in batches:
            rows = []
            for d, p, a, b, masks in zip(pdf.document, pdf.page_index, pdf.a, pdf.b, pdf["mask"]):
                (w, h, x), (w2, h2, y) = ppm(bytes(a)), ppm(bytes(b))
                if (w, h) != (w2, h2):
                    rows.append((d, p, 0, w * h))
                    continue
                same = (np.frombuffer(x, np.uint8).reshape(h, w, 3) == np.frombuffer(y, np.uint8).reshape(h, w, 3)).all(2)
                keep = np.ones((h, w), bool)
                for left, top, right, bottom in [] if masks is None else masks:
                    keep[int(top) : int(bottom), int(left) : int(right)] = False
                rows.append((d, p, int((same & keep).sum()), int(keep.sum())))
            yield pd.DataFrame(rows, columns=["document", "page_index", "equal", "compared"])

    return pairs.select("document", "page_index", "a", "b", "mask").mapInPandas(run, schema)
