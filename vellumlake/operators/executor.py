"""Translation of requests against an offline backend: cache, retries by kind, and typed outcomes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumlake.functions import placeholders as P
from vellumlake.functions.lexer import conserved_tokens, missing_tokens

SAMPLE = 16
Backend = Callable[[str, int, str | None], str]  # request, attempt from 1, correction
# The letters that a translation is made of, the units that stay after a number, and what opens a mark.
HAN_SAMPLE = "模型数据证论文翻译语结果保持结构程稳定缓存重试诊断排版字体"
UNITS = (
    "GHz", "MHz", "kHz", "dpi", "bits", "bytes", "bit", "byte", "km", "cm", "mm",
    "ms", "Hz", "KB", "MB", "GB", "TB", "mV", "mA", "kW", "dB", "px", "pt", "°C",
    "min", "s", "h", "m", "K", "V", "A", "W",
    "M", "B", "thousand", "million", "billion",
)
_OPEN = r"<b|</b|\{v|\{l"
_MARK = r"</?b0*[1-9][0-9]*>|\{[vl]0*[1-9][0-9]*\}"
_KEPT = re.compile(rf"{_MARK}|[+\-−]?\d+(?:\.\d+)?(?:[eE][+\-−]?\d+)?%?")


def _han(c: str) -> bool:
    return "\u3400" <= c <= "\u4dbf" or "\u4e00" <= c <= "\u9fff"


def conserving(text: str, attempt: int = 1, correction: str | None = None) -> str:
    """A fake translation: each letter becomes a Han letter by its code; marks, numbers, units after a number, Han and
    everything that is no letter stay."""
    out, at, ink = [], 0, ""  # ink: the last character before `at` that is no white space
    while at < len(text):
        kept = _KEPT.match(text, at)
        piece = kept[0] if kept else None
        if piece is None and ink and (ink.isdigit() or ink in ".%") and not text[at - 1].isalpha():
            piece = next((u for u in UNITS if text.startswith(u, at) and not text[at + len(u) : at + len(u) + 1].isalpha()), None)
        if piece is None:
            c = piece = text[at]
            out.append(HAN_SAMPLE[ord(c) % len(HAN_SAMPLE)] if c.isalpha() and not _han(c) else c)
        else:
            out.append(piece)
        at += len(piece)
        ink = piece.rstrip()[-1:] or ink
    return "".join(out)


def _segments(text: str) -> list[tuple[bool, str]]:
    """(whether it is a mark, text): marks, and between them pieces that end where something like a mark opens; such an
    opening that is no mark is a piece of one character."""
    out, at, marks, opens = [], 0, re.compile(_MARK), re.compile(_OPEN)
    while at < len(text):
        mark = marks.match(text, at)
        if mark:
            out.append((True, mark[0]))
            at = mark.end()
            continue
        nxt = opens.search(text, at)
        end = len(text) if nxt is None else max(nxt.start(), at + 1)
        out.append((False, text[at:end]))
        at = end
    return out


def compressing(text: str, attempt: int = 1, correction: str | None = None) -> str:
    """The other fake: of each piece between marks half as many Han letters as it has characters, one to six, chosen by a
    hash of the whole text; marks stay, numbers are lost."""
    seed = 2_166_136_261
    for byte in text.encode("utf-8"):
        seed = (seed ^ byte) * 16_777_619 % 2**64
    letter = lambda k: HAN_SAMPLE[(seed + k) % len(HAN_SAMPLE)]
    out, told = [], 0
    for is_mark, piece in _segments(text):
        if is_mark:
            out.append(piece)
        elif ink := len("".join(piece.split())):
            out += [letter(7 * told + 5 * k) for k in range(min(max(ink // 2, 1), 6))]
            told += 1
    return "".join(out) or letter(0)


def identity(text: str, attempt: int = 1, correction: str | None = None) -> str:
    return text


@dataclass
class Outcome:
    outcome: str
    text: str | None
    attempts: int
    cache: str | None
    echo_retries: int = 0
    placeholder_retries: int = 0
    conservation_retries: int = 0
    violation: str | None = None
    missing: tuple[str, ...] = ()
    suspicious: bool = False


def worth_retry(text: str) -> bool:
    t = text.strip()
    local, _, domain = t.partition("@")
    email = not re.search(r"\s", t) and t.count("@") == 1 and local and "." in domain and domain[0] != "." and domain[-1] != "."
    return bool(t) and not email and any(c.isalpha() for c in t)


def execute(prepared: P.Prepared, backend: Backend, cached: str | None = None, cached_identity: bool = False) -> Outcome:
    """One request: the cache first (a hit counts only if it still holds), then the backend, with at most one more
    request for an echo, one for broken placeholders and one for lost quantities."""
    eligible = worth_retry(prepared.text)
    if cached_identity:
        return Outcome("identity", None, 0, "hit", suspicious=eligible)
    lost = lambda answer: missing_tokens(_plain(prepared, prepared.text), _plain(prepared, answer))
    if cached is not None and P.violation(prepared.tokens, cached) is None and not lost(cached):
        return Outcome("translated", cached, 0, "hit")
    done = Outcome("failed", None, 0, "miss")
    hint = None
    while True:
        done.attempts += 1
        answer = backend(prepared.text, done.attempts, hint)
        if answer == prepared.text:
            if eligible and not done.echo_retries:
                done.echo_retries = 1
                continue
            done.outcome, done.suspicious = "identity", eligible
            return done
        broken = P.violation(prepared.tokens, answer)
        if broken:
            if not done.placeholder_retries:
                done.placeholder_retries, hint = 1, P.correction(prepared.tokens, broken, answer)
                continue
            done.outcome, done.violation = "placeholder_violation", broken
            return done
        missing = lost(answer)
        if missing and not done.conservation_retries:
            done.conservation_retries, hint = 1, "keep: " + ", ".join(missing[:SAMPLE])
            continue
        done.outcome, done.text, done.missing = ("content_conservation_violation", None, tuple(missing[:SAMPLE])) if missing else ("translated", answer, ())
        return done


def _plain(prepared: P.Prepared, text: str) -> str:
    """Text as quantities are read from it: formulas part it, bold marks vanish, escaped characters are back."""
    return "\n".join("".join(t for t, _ in run) for run in P.restore(prepared, text))


SCHEMA = "outcome string, translated string, attempts int, cache string, echo_retries int, placeholder_retries int, conservation_retries int, violation string, missing array<string>, suspicious boolean"


def translated(requests: DataFrame, backend: Backend, keys: list[str], text: str = "src") -> DataFrame:
    """keys and the outcome of each request. Blank and letterless texts never reach the backend; equal requests are
    asked once and joined back, so a text that many rows share costs one call."""
    from vellumlake.functions.text import local_identity

    asked = requests.where(~local_identity(F.col(text))).select(text).distinct()

    def run(batches):
        for pdf in batches:
            rows = [execute(P.encode([("text", t)]), backend) for t in pdf[text]]
            yield pd.DataFrame({text: pdf[text], "outcome": [r.outcome for r in rows], "translated": [r.text for r in rows], "attempts": [r.attempts for r in rows], "cache": [r.cache for r in rows], "echo_retries": [r.echo_retries for r in rows], "placeholder_retries": [r.placeholder_retries for r in rows], "conservation_retries": [r.conservation_retries for r in rows], "violation": [r.violation for r in rows], "missing": [list(r.missing) for r in rows], "suspicious": [r.suspicious for r in rows]})

    answers = asked.mapInPandas(run, f"{text} string, {SCHEMA}")
    out = requests.select(*keys, text).join(answers, text, "left")
    return out.withColumn("outcome", F.coalesce("outcome", F.lit("local_identity"))).drop(text)


__all__ = ["Outcome", "compressing", "conserved_tokens", "conserving", "execute", "identity", "translated", "worth_retry"]
