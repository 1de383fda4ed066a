"""Predicates and normal forms of texts, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"\p{IsWhite_Space}"
# Code points that may not begin or end a line of Chinese text.
LINE_START = "、。〉》」』】〕〗〙〛〞〟’”！），：；？"
LINE_END = "〈《「『【〔〖〘〚‘“（"
# Scripts of the two output font families, as inclusive code point ranges.
CJK = (
    (0x2010, 0x2027), (0x2E80, 0x2FDF), (0x2FF0, 0x31EF), (0x31F0, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FF),
    (0xF900, 0xFAFF), (0xFE10, 0xFE1F), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x1AFF0, 0x1AFFF), (0x1B000, 0x1B16F), (0x1F200, 0x1F2FF),
    (0x20000, 0x2EE5F), (0x2F800, 0x2FA1F), (0x30000, 0x323AF),
)
LATIN = (
    (0x20, 0x7E), (0xA0, 0x52F), (0x1C80, 0x1C8F), (0x1D00, 0x1DBF), (0x1E00, 0x1FFF), (0x2070, 0x209F), (0x20D0, 0x20FF), (0x2100, 0x214F),
    (0x2190, 0x22FF), (0x27C0, 0x2BFF), (0x2DE0, 0x2DFF), (0xA640, 0xA69F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0x10780, 0x107BF),
    (0x1D400, 0x1D7FF), (0x1DF00, 0x1DFFF),
)
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}]"
# Labels of layout regions and which of them are translated.
TRANSLATE = ("abstract", "aside_text", "content", "figure_title", "footnote", "paragraph_title", "text", "vision_footnote", "fallback_line")
PASSTHROUGH = ("algorithm", "chart", "display_formula", "doc_title", "footer", "footer_image", "formula_number", "header", "header_image", "image", "inline_formula", "number", "reference", "reference_content", "seal", "table", "vertical_text")
DELIMITERS = (("(", ")"), ("[", "]"), ("{", "}"), ("（", "）"), ("【", "】"))


def policy(label: Column) -> Column:
    """translate or passthrough of a layout label; null for an unknown one."""
    return F.when(label.isin(*TRANSLATE), "translate").when(label.isin(*PASSTHROUGH), "passthrough")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, WHITE + "+", "")


def same_without_space(a: Column, b: Column) -> Column:
    return compact(a) == compact(b)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def non_space_count(text: Column) -> Column:
    return F.length(compact(text))


def compare_key(text: Column) -> Column:
    """Without white space and soft hyphens, Latin ligatures spelled out."""
    out = F.replace(compact(text), F.lit("\u00ad"), F.lit(""))
    for i, plain in enumerate(("ff", "fi", "fl", "ffi", "ffl", "st", "st")):
        out = F.replace(out, F.lit(chr(0xFB00 + i)), F.lit(plain))
    return out


def normalized(text: Column) -> Column:
    """Soft hyphens gone, white space folded to single spaces."""
    return stripped(F.regexp_replace(F.replace(text, F.lit("\u00ad"), F.lit("")), WHITE + "+", " "))


def joined_lines(lines: Column) -> Column:
    """Lines of a block as one text: blank ones left out, a soft hyphen at a line's end joins the word."""
    kept = F.filter(F.transform(lines, stripped), lambda x: x != "")
    return normalized(F.array_join(F.transform(kept, lambda x: F.when(x.endswith("\u00ad"), x).otherwise(F.concat(x, F.lit(" ")))), ""))


def alphabetic(text: Column) -> Column:
    return text.rlike(r"\p{IsAlphabetic}")


def local_identity(text: Column) -> Column:
    """Nothing to translate: blank or without a letter."""
    return ~alphabetic(text)


def email_shape(text: Column) -> Column:
    t = stripped(text)
    parts = F.split(t, "@", -1)
    domain = F.get(parts, F.lit(1))
    return ~t.rlike(WHITE) & (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & domain.contains(".") & ~domain.startswith(".") & ~domain.endswith(".")


def echo_retry(text: Column) -> Column:
    """Whether an unchanged answer is worth one more request."""
    return (stripped(text) != "") & ~email_shape(text) & alphabetic(text)


def prose_shaped(text: Column) -> Column:
    """At least 40 characters, at least half of them ASCII letters."""
    return (F.length(text) >= 40) & (2 * F.regexp_count(text, F.lit("[A-Za-z]")) >= F.length(text))


def numbering_only(text: Column) -> Column:
    return text.rlike(r"^[0-9.()\[\]\- ]*[0-9][0-9.()\[\]\- ]*$")


def abnormal_space(text: Column) -> Column:
    return text.contains("  ") | text.rlike(rf"^{WHITE}|{WHITE}$")


def placeholder_residue(text: Column) -> Column:
    """How many of the three kinds of placeholder are left in a text."""
    return reduce(lambda a, b: a + b, (text.contains(x).cast("int") for x in ("{v", "{l", "<b")))


def kinsoku(text: Column) -> Column:
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    return first.isin(*LINE_START) | last.isin(*LINE_END)


# Punctuation, ASCII and Chinese.
PUNCTUATION = tuple("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + tuple("，。！？；：、（）【】《》“”‘’")


def isolated_punctuation(text: Column) -> Column:
    return (F.length(text) == 1) & text.isin(*PUNCTUATION)


def delimiters_balanced(text: Column) -> Column:
    """Whether brackets close in the order they open; a fold over a stack, null once it failed."""
    marks = "".join(a + b for a, b in DELIMITERS)
    found = F.regexp_extract_all(text, F.lit("[" + "".join("\\" + c if c in "()[]{}" else c for c in marks) + "]"), F.lit(0))
    close = F.create_map(*(F.lit(x) for a, b in DELIMITERS for x in (b, a)))

    def step(stack, c):
        opens = F.try_element_at(close, c)
        return F.when(opens.isNull(), F.concat(stack, c)).when(F.endswith(stack, opens), F.substr(stack, F.lit(1), F.length(stack) - 1))

    return F.coalesce(F.aggregate(found, F.lit(""), step) == "", F.lit(False))


def han_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(HAN)), F.lit(0))


def _within(code: Column, ranges) -> Column:
    return reduce(lambda a, b: a | b, (code.between(low, high) for low, high in ranges))


def script_preference(char: Column) -> Column:
    """Which output font family shows a character: cjk, latin or default."""
    code = F.ascii(char)
    return F.when(_within(code, CJK), "cjk").when(_within(code, LATIN), "latin").otherwise("default")


def noncharacter(code: Column) -> Column:
    return code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFF) >= 0xFFFE)


def occurrences(text: Column, term: Column) -> Column:
    """Occurrences that don't overlap; 0 of an empty term."""
    return F.when(F.length(term) > 0, F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term))).otherwise(0)


def trailer_id(name: Column) -> Column:
    """The first 16 bytes of a name, zero-padded, in hex."""
    return F.rpad(F.lower(F.hex(F.substring(F.encode(name, "UTF-8"), 1, 16))), 32, "0")


def composite_key(*fields: Column) -> Column:
    """SHA-256 over the fields, each preceded by its length in eight bytes, so no two lists of fields agree."""
    parts = []
    for f in fields:
        raw = F.encode(f, "UTF-8")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(f)), 16, "0")), raw]
    return F.sha2(F.concat(*parts), 256)


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def valid_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{64}$")


def source_text(chars: Column) -> Column:
    """Text of an array of (unicode, implicit_space_before): one space for an implied one, unless white space is
    already there or comes. An implied space before the first character counts."""
    known = F.filter(chars, lambda c: F.coalesce(c["unicode"] != "", F.lit(False)))

    def piece(some):
        def one(c, i):
            behind = F.when(i > 0, some[i - 1]["unicode"].rlike(WHITE + "$")).otherwise(F.lit(False))
            space = F.coalesce(c["implicit_space_before"], F.lit(False)) & ~behind & ~c["unicode"].rlike("^" + WHITE)
            return F.concat(F.when(space, " ").otherwise(""), c["unicode"])

        return F.array_join(F.transform(some, one), "")

    return F.element_at(F.transform(F.array(known), piece), 1)


def plain_text(chars: Column) -> Column:
    """The same without implied spaces."""
    return F.array_join(F.transform(F.filter(chars, lambda c: c["unicode"].isNotNull()), lambda c: c["unicode"]), "")


def decoded(has_tounicode: Column, tounicode: Column, cmap: Column, encoding: Column) -> Column:
    """A glyph's text: a ToUnicode map, once present, rules alone; else the embedded map, else the encoding."""
    return F.when(has_tounicode, tounicode).otherwise(F.coalesce(cmap, encoding))


def version_of(output: Column, marker: str | None = None) -> Column:
    """The first token that begins with a digit on the first line that holds the marker (or isn't blank)."""
    lines = F.filter(F.split(output, "\n"), lambda x: x.contains(marker) if marker else stripped(x) != "")
    tokens = F.filter(F.split(stripped(F.get(lines, F.lit(0))), WHITE + "+"), lambda t: t.rlike("^[0-9]"))
    return F.regexp_replace(F.get(tokens, F.lit(0)), "[,;).]+$", "")


def error_class(status: Column) -> Column:
    """What an HTTP status means for a request: its failure and, where it is worth it, the kind of retry."""
    retry = F.when(status == 429, "rate_limited").when(status == 408, "timeout").when(status.isin(500, 502, 503, 504), "server_error")
    reason = (
        F.when(status.between(200, 299), "ok")
        .when(status.isin(429, 408), "backend_rejected")
        .when(status.isin(401, 403), "authentication_failed")
        .when(status.between(400, 499), "backend_rejected")
        .otherwise("translation_failed")
    )
    return F.struct(reason.alias("reason"), retry.alias("retry"))


def responses_url(base: Column) -> Column:
    """The endpoint below a base address; null for one without host, or with credentials, query or fragment."""
    parts = lambda k: F.regexp_extract(base, r"^(https?://[^/?#@\s]+)((?:/[^?#]*)?)$", k)
    path = F.regexp_replace(parts(2), "/+$", "")
    full = F.when(path == "/v1/responses", path).when(path.endswith("/v1"), F.concat(path, F.lit("/responses"))).otherwise(F.concat(path, F.lit("/v1/responses")))
    return F.when(parts(1) != "", F.concat(parts(1), full))


def section_number(prefix_left: Column, title_left: Column, prefix_width: Column, size: Column) -> Column:
    """Where a title starts after its retained number: the source gap left over by the new prefix, at least a quarter
    em. Null for values that make no sense."""
    from vellumlake.functions.numeric import finite

    want, least = title_left - prefix_left - prefix_width, 0.25 * size
    gap = F.greatest(want, least)
    ok = finite(prefix_left) & finite(title_left) & finite(prefix_width) & finite(size) & (title_left >= prefix_left) & (prefix_width >= 0) & (size > 0)
    return F.when(ok, F.struct(gap.alias("gap"), (prefix_left + prefix_width + gap).alias("title_left"), (want < least).alias("clamped")))


def same_characters(a: Column, b: Column) -> Column:
    """Whether two arrays of characters agree in every field, absent fields included."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: same)


def paragraph_identity(before: Column, after: Column, translated: Column) -> Column:
    """A paragraph left as it was: the same characters, and no translation or one that reads the same."""
    return same_characters(before, after) & (translated.isNull() | same_without_space(translated, plain_text(before)))


def glyph_base(name: Column) -> Column:
    """The part of a glyph name that a glyph list is asked for; null for names of several characters."""
    base = F.split_part(name, F.lit("."), F.lit(1))
    return F.when((base != "") & ~base.contains("_"), base)


def glyph_character(name: Column, table: Column) -> Column:
    """The one character of a glyph name by a map of names; null for controls and noncharacters."""
    c = F.try_element_at(table, glyph_base(name))
    return F.when((F.length(c) == 1) & ~c.rlike(r"\p{Cc}") & ~noncharacter(F.ascii(c)), c)


def hyphen_marker(char: Column) -> Column:
    """A mark that extractors give for a hyphen at a line's end."""
    return char.isin("\u0002", "­", "-", "‐")


def high_surrogate(code: Column) -> Column:
    return code.between(0xD800, 0xDBFF)


def ligature_head(char: Column, ligature: Column) -> Column:
    """Whether a character is the first of what a ligature spells."""
    return char == F.substring(compare_key(ligature), 1, 1)


# Reasons for leaving content as it is, by what they may concern.
PARAGRAPH_REASONS = ("unreliable_unicode", "unsupported_font", "form_xobject_content", "non_positive_advance", "unlocatable", "typeset_overflow", "typeset_protocol", "placeholder_violation", "content_conservation", "translation_failure")


def valid_timeout(seconds: Column) -> Column:
    return seconds.between(1, 600)


MATH = "[=<>≤≥≈≠±×÷∑∏∫√∂]"


def math_shaped(text: Column) -> Column:
    """A paragraph that is a formula by its shape: a strong operator and at most two operands."""
    return text.rlike(MATH) & (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")) <= 2)
