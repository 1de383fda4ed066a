"""The placeholder protocol: formulas {vN}, bold <bN>...</bN> and escaped characters {lN} around a translation."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

OPENING = re.compile(r"\{v|\{l|</b|<b")
_CLOSES = {"{v": "}", "{l": "}", "</b": ">", "<b": ">"}
VIOLATIONS = ("missing", "duplicate", "unknown", "tag_nesting", "formula_order", "partial_token", "backend_echo")


@dataclass(frozen=True)
class Token:
    kind: str  # v, l, b or /b
    index: int
    start: int
    end: int
    literal: str


class PartialToken(ValueError):
    """Something that begins like a placeholder is none."""


def scan(text: str) -> list[Token]:
    """The placeholders of a text in order; raises PartialToken."""
    out, at = [], 0
    while (m := OPENING.search(text, at)) is not None:
        end = text.find(_CLOSES[m[0]], m.end())
        digits = text[m.end() : end] if end >= 0 else ""
        if not re.fullmatch(r"\+?[0-9]+", digits) or not 0 < int(digits) < 2**64:
            raise PartialToken(text[m.start() : m.start() + 8])
        at = end + 1
        out.append(Token(m[0].strip("{<"), int(digits), m.start(), at, text[m.start() : at]))
    return out


@dataclass
class Prepared:
    """A request: its text, the placeholders it must get back, and what escaped ones stand for."""

    text: str = ""
    tokens: list[str] = field(default_factory=list)
    literals: dict[str, str] = field(default_factory=dict)


def encode(parts: list[tuple[str, str]]) -> Prepared:
    """A request of (kind, text) parts: text, bold or formula. Formulas, bold runs and escaped characters are
    numbered each for themselves."""
    out, n = Prepared(), Counter()

    def numbered(kind: str, shape: str) -> str:
        n[kind] += 1
        mark = shape.format(n[kind])
        out.tokens.append(mark)
        return mark

    def escaped(text: str) -> str:
        pieces = []
        for c in text:
            if c in "{<":
                mark = numbered("l", "{{l{}}}")
                out.literals[mark] = c
                c = mark
            pieces.append(c)
        return "".join(pieces)

    pieces = []
    for kind, text in parts:
        if kind == "formula":
            pieces.append(numbered("v", "{{v{}}}"))
        elif kind == "bold":
            pieces.append(numbered("b", "<b{}>"))
            pieces.append(escaped(text))
            mark = f"</b{n['b']}>"
            out.tokens.append(mark)
            pieces.append(mark)
        else:
            pieces.append(escaped(text))
    out.text = "".join(pieces)
    return out


def violation(tokens: list[str], answer: str, request: str | None = None) -> str | None:
    """The first rule that an answer breaks, in the protocol's order; None if it is valid. With a request, an answer
    equal to it is an echo."""
    if request is not None and answer == request:
        return "backend_echo"
    try:
        seen = scan(answer)
    except PartialToken:
        return "partial_token"
    allowed, stack = set(tokens), []
    for t in seen:
        if t.literal not in allowed:
            return "unknown"
        if t.kind == "b":
            stack.append(t.index)
        elif t.kind == "/b" and (not stack or stack.pop() != t.index):
            return "tag_nesting"
    if stack:
        return "tag_nesting"
    counts = Counter(t.literal for t in seen)
    for t in tokens:
        if counts[t] != 1:
            return "duplicate" if counts[t] else "missing"
    formulas = [t for t in tokens if t.startswith("{v")]
    return None if [t.literal for t in seen if t.kind == "v"] == formulas else "formula_order"


def restore(prepared: Prepared, answer: str) -> list[list[tuple[str, bool]]]:
    """Segments between formulas as runs of (text, bold), of a valid answer."""
    segments, bold, at = [[]], 0, 0

    def put(text: str) -> None:
        if text:
            run = segments[-1]
            if run and run[-1][1] == bool(bold):
                run[-1] = (run[-1][0] + text, bool(bold))
            else:
                run.append((text, bool(bold)))

    for t in scan(answer):
        put(answer[at : t.start])
        at = t.end
        if t.kind == "v":
            segments.append([])
        elif t.kind == "l":
            put(prepared.literals[t.literal])
        else:
            bold += 1 if t.kind == "b" else -1
    put(answer[at:])
    return segments


def correction(tokens: list[str], broken: str, answer: str) -> str:
    """What a retry tells the backend."""
    try:
        seen = [t.literal for t in scan(answer)]
    except PartialToken:
        seen = []
    counts = Counter(seen)
    names = lambda x: ", ".join(x) or "none"
    first = {
        "missing": ("omitted required placeholders", [t for t in tokens if not counts[t]]),
        "duplicate": ("duplicated placeholders", [t for t in tokens if counts[t] > 1]),
        "unknown": ("introduced unknown placeholders", list(dict.fromkeys(t for t in seen if t not in tokens))[:8]),
        "tag_nesting": ("mis-nested bold placeholders; their order is", [t for t in tokens if "b" in t]),
        "formula_order": ("changed the order of formulas; it is", [t for t in tokens if t.startswith("{v")]),
        "partial_token": ("held a partial placeholder; the sequence is", tokens),
    }
    if broken not in first:
        return "the answer echoed the input; translate it and keep every placeholder"
    what, which = first[broken]
    return f"the answer {what}: {names(which)}; required: {names(tokens)}"


def profile(answer: str) -> dict:
    """Sizes of an answer that may be logged without its text."""
    try:
        n, valid = len(scan(answer)), True
    except PartialToken:
        n, valid = 0, False
    return {"response_bytes": len(answer.encode()), "response_characters": len(answer), "token_count": n, "token_scan_valid": valid}
