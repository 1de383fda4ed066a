"""Surrogates for personal data, with DataFrame functions only.

Detected entities (emails, IP addresses, payment cards, phone and identity numbers, IBANs,
secrets, titled names) are replaced by surrogates that a keyed hash derives from the entity
itself: letters stay letters of their script and case, digits stay digits of their kind,
separators and marks stay, country codes and known prefixes of secrets stay, checksums of cards
and IBANs stay valid or invalid, names keep the gender of their title. Digit strings that fail
the cards' checksum are no cards.

Mentions of one entity (normal()) have surrogates that are one entity again: a surrogate's
normal form depends on kind, normal form and turn only. So a pass over the distinct entities
checks for all mentions that no two entities share a surrogate and that no surrogate is an
entity of the data; those that fail are derived anew until none does. The replacement itself
needs no join unless such cases exist.

Defined results: null texts stay null and empty ones empty; texts without entities are
unchanged; entities don't overlap, the leftmost pattern wins; equal texts get equal results;
columns besides the text pass through unchanged, whatever their names. Letters of scripts
outside SCRIPTS become Latin ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumlake.llm.common import fresh, looked_up, small, stored, text_or_empty

KEY = "vellumlake-surrogates"  # a deployment passes its own secret
WIDEN = 8  # turns after which a surrogate may be longer than its entity
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
_LABEL = r"[\p{L}\p{M}\p{N}-]++"  # of a domain, in any script; a last one in ASCII ends where another script goes on
#: Fixed values (ITU E.164): country codes of one and two digits; the others have three.
CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
FEMALE, MALE = "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Sra|Srta|Señora|Signora", "Mr|Herr|Monsieur|Sr|Señor|Signor"
TITLES = f"{FEMALE}|{MALE}|Dr|Prof"
_WORD = r"(?:(?:\p{Lu}\.-?)++(?:\p{Lu}[\p{L}'-]*+)?|\p{Lu}[\p{L}'-]*+)"  # a name, initials, or both without a space
NAMES = {
    "f": ("Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Hanna", "Irma", "Julia", "Klara", "Laura", "Mira", "Nora", "Olga", "Paula"),
    "m": ("Anton", "Bruno", "Carl", "Dario", "Emil", "Felix", "Georg", "Hugo", "Igor", "Jonas", "Konrad", "Leo", "Marco", "Nils", "Oskar", "Paul"),
    "n": ("Alex", "Chris", "Dana", "Eli", "Jo", "Kim", "Lou", "Max", "Noa", "Pat", "Robin", "Sam", "Sascha", "Toni", "Val", "Yael"),
}
#: Scripts: first and last code point, then first lower-case and first upper-case letter of a run of so many letters
#: (the same for scripts without case).
SCRIPTS = (
    (0x00C0, 0x00FF, 0x00E0, 0x00C0, 23), (0x0100, 0x024F, 0x61, 0x41, 26), (0x0370, 0x03FF, 0x03B1, 0x0391, 17), (0x0400, 0x052F, 0x0430, 0x0410, 32), (0x0531, 0x0588, 0x0561, 0x0531, 38),
    (0x05D0, 0x05F2, 0x05D0, 0x05D0, 27), (0x0620, 0x06FF, 0x0628, 0x0628, 19), (0x0900, 0x097F, 0x0915, 0x0915, 37), (0x0980, 0x09FF, 0x0995, 0x0995, 20), (0x0A00, 0x0A7F, 0x0A15, 0x0A15, 20),
    (0x0A80, 0x0AFF, 0x0A95, 0x0A95, 20), (0x0B00, 0x0B7F, 0x0B15, 0x0B15, 20), (0x0B80, 0x0BFF, 0x0BAE, 0x0BAE, 12), (0x0C00, 0x0C7F, 0x0C15, 0x0C15, 20), (0x0C80, 0x0CFF, 0x0C95, 0x0C95, 20),
    (0x0D00, 0x0D7F, 0x0D15, 0x0D15, 20), (0x0D80, 0x0DFF, 0x0D9A, 0x0D9A, 24), (0x0E00, 0x0E7F, 0x0E01, 0x0E01, 46), (0x0E80, 0x0EFF, 0x0E99, 0x0E99, 7), (0x0F00, 0x0FFF, 0x0F40, 0x0F40, 8),
    (0x1000, 0x109F, 0x1000, 0x1000, 33), (0x10A0, 0x10FF, 0x10D0, 0x1C90, 33), (0x1C90, 0x1CBF, 0x10D0, 0x1C90, 33), (0x2D00, 0x2D2F, 0x10D0, 0x1C90, 33), (0x1100, 0x11FF, 0xAC00, 0xAC00, 11172),
    (0x1200, 0x139F, 0x1200, 0x1200, 73), (0x1780, 0x17FF, 0x1780, 0x1780, 35), (0x1800, 0x18AF, 0x1820, 0x1820, 35), (0x1E00, 0x1EFF, 0x61, 0x41, 26), (0x1F00, 0x1FFF, 0x03B1, 0x0391, 17),
    (0x3040, 0x309F, 0x3041, 0x3041, 83), (0x30A0, 0x30FF, 0x30A1, 0x30A1, 86), (0x3105, 0x312F, 0x3105, 0x3105, 37), (0x3131, 0x318E, 0xAC00, 0xAC00, 11172), (0x3400, 0x9FFF, 0x4E00, 0x4E00, 20000),
    (0xAC00, 0xD7AF, 0xAC00, 0xAC00, 11172), (0xF900, 0xFAFF, 0x4E00, 0x4E00, 20000), (0xFF21, 0xFF5A, 0xFF41, 0xFF21, 26), (0xFF66, 0xFF9F, 0xFF71, 0xFF71, 45), (0x20000, 0x3FFFF, 0x4E00, 0x4E00, 20000),
)

#: One alternative for each kind, most specific first; none can run over long texts more than once.
PATTERN = "|".join((
    rf"(?<![\p{{L}}\p{{M}}\p{{N}}._%+-])[\p{{L}}\p{{M}}\p{{N}}._%+-]++@{_LABEL}(?:\.(?:{_LABEL}(?=\.{_LABEL})|[A-Za-z0-9-]++(?!\p{{IsLatin}})|{_LABEL}))++",
    r"(?<![\p{L}\p{N}_])(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+-]{8,}+",
    rf"(?<![\d.]){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?!\d|\.\d)",
    r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])",
    r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}])(?:(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16,}+|gh[pousr]_[0-9A-Za-z]{36,}+)(?![\p{L}\p{N}])|sk-[0-9A-Za-z-]{20,}+)",
    r"(?<![\p{L}\p{N}.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}+])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    r"(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\d-])",
    r"(?<![\p{L}\p{N}-])\d{3}-\d{3}-\d{4}(?![\d-])",
    rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES})\b\.? {_WORD}(?: {_WORD})*+",
))
#: Cheap test that all of the patterns need.
HINT = rf"[@\d]|(?<![\p{{L}}])(?:{TITLES})\b|(?i:token|secret|passw|api.?key|access.?key)|sk-|gh[pousr]_|AKIA|[a-f]{{32}}|[A-F]{{32}}"
KINDS = ("email", "name", "ip", "secret", "iban", "card", "id", "phone")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of(e: Column) -> Column:
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(rf"^(?:{TITLES})\b\.? \p{{Lu}}"), "name")
        .when(e.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$") | e.rlike(r"^([0-9A-Fa-f]{1,4}:){7}"), "ip")
        .when(e.rlike(r"[=:]|^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$|^(?:AKIA|gh[pousr]_|sk-)"), "secret")
        .when(e.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(e.rlike(r"^\d{13,19}$|^\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}$"), "card")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "id")
        .otherwise("phone")
    )


def luhn_valid(e: Column) -> Column:
    return F.pmod(_luhn(F.regexp_replace(e, r"\D", "")), F.lit(10)) == 0


def is_entity(e: Column) -> Column:
    """Whether a match of PATTERN is an entity: what looks like a card has to have a card's checksum."""
    return F.when(kind_of(e) == "card", luhn_valid(e)).otherwise(F.lit(True))


def normal(e: Column, kind: Column | None = None) -> Column:
    """What makes two mentions one entity: case, separators, a name's title or a secret's label don't count, nor
    does code 1 before ten digits."""
    if kind is None:
        return let(e, lambda x: let(kind_of(x), lambda k: normal(x, k)))
    plain = F.regexp_replace(e, r"[^\p{L}\p{N}]", "")
    phone = F.when(plain.rlike(r"^1\d{10}$"), F.substr(plain, F.lit(2))).when(e.startswith("+") & (F.length(plain) < 11), F.concat(F.lit("+"), plain)).otherwise(plain)
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind == "name", F.lower(F.concat(_gender(e), F.regexp_replace(e, rf"^(?:{TITLES})\b\.? ", " "))))
        .when(kind == "secret", F.regexp_extract(e, r"([A-Za-z0-9_/+-]+)$", 1))
        .when(kind == "phone", phone)
        .when(kind.isin("card", "id"), plain)
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .otherwise(F.lower(e))
    )


def _gender(e: Column) -> Column:
    return F.when(e.rlike(rf"^(?:{FEMALE})\b"), "f").when(e.rlike(rf"^(?:{MALE})\b"), "m").otherwise("n")


def _stream(key: Column, what: Column, turn: Column) -> Column:
    """512 hex digits that key, entity and turn decide."""
    return F.concat(*(F.sha2(F.concat_ws("\x1f", key, F.lit(str(k)), what, turn.cast("string")), 512) for k in range(4)))


def _nibbles(ks: Column, i: Column) -> Column:
    """A number below 65536 from place i of the stream."""
    return F.conv(F.substr(ks, F.pmod(i * 4, F.lit(509)) + 1, F.lit(4)), 16, 10).cast("int")


def _char(code: Column) -> Column:
    """The character of a code point below 65536."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _other(c: Column, r: Column) -> Column:
    """A character beyond ASCII, replaced by one of its kind: digits by digits of their own set (sets of ten begin at
    a multiple of 16, those of the Indian scripts at 6 beyond one), letters by letters of their script and case."""
    def digit(code):
        six = code.between(0x0966, 0x0DEF) | code.between(0x1946, 0x194F)
        return F.when(code < 65536, _char(code - F.pmod(code, F.lit(16)) + F.when(six, 6).otherwise(0) + F.pmod(r, F.lit(10)))).otherwise(F.pmod(r, F.lit(10)).cast("string"))

    first, last, low, up, n = (F.expr(f"array({','.join(map(str, x))})") for x in zip(*SCRIPTS))

    def letter(code):
        upper = c.rlike(r"^\p{Lu}")
        at = F.array_position(F.zip_with(first, last, lambda a, b: (a <= code) & (code <= b)), F.lit(True)).cast("int")
        base = lambda i: F.when(upper, F.element_at(up, i)).otherwise(F.element_at(low, i))
        return let(at, lambda i: F.when(i > 0, _char(base(i) + F.pmod(r, F.element_at(n, i)))).otherwise(_char(F.when(upper, 65).otherwise(97) + F.pmod(r, F.lit(26)))))

    return let(F.ascii(c), lambda code: F.when(c.rlike(r"^\p{Nd}"), digit(code)).when(c.rlike(r"^\p{L}"), letter(code)).otherwise(F.pmod(r, F.lit(10)).cast("string")))


def _masked(text: Column, ks: Column, hexa: Column | None = None, keep: Column | None = None) -> Column:
    """Each letter and digit replaced by one of its own kind, the rest and the first `keep` ones kept. The place counts
    letters and digits beyond these only, so separators and what is kept don't change what stands between them."""
    def one(c, r):
        out = F.when(c.rlike("[0-9]"), F.pmod(r, F.lit(10)).cast("string"))
        if hexa is not None:
            out = out.when(hexa & c.rlike("[a-f]"), F.chr(97 + F.pmod(r, F.lit(6)))).when(hexa & c.rlike("[A-F]"), F.chr(65 + F.pmod(r, F.lit(6))))
        return out.when(c.rlike("[a-z]"), F.chr(97 + F.pmod(r, F.lit(26)))).when(c.rlike("[A-Z]"), F.chr(65 + F.pmod(r, F.lit(26)))).otherwise(_other(c, r))

    # letters and what stands around them apart: the work grows in proportion to the text
    letters = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""), ""), lambda c: c != "")
    if keep is None:
        new = F.transform(letters, lambda c, i: let(_nibbles(ks, i), lambda r: one(c, r)))
    else:
        new = F.transform(letters, lambda c, i: F.when(i < keep, c).otherwise(let(_nibbles(ks, i - keep), lambda r: one(c, r))))
    return F.array_join(F.zip_with(F.split(text, r"[\p{L}\p{N}]", -1), F.concat(new, F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum of a digit string, from the right."""
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: let(c.cast("int") * (F.pmod(i, F.lit(2)) + 1), lambda d: d - F.when(d > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(e: Column, ks: Column) -> Column:
    """The first digit (the network) stays; a valid number stays valid, an invalid one invalid."""
    body = F.concat(F.substr(e, F.lit(1), F.lit(1)), F.substr(_masked(e, ks), F.lit(2), F.length(e) - 2))

    def closed(b):
        sum0 = _luhn(F.concat(F.regexp_replace(b, r"\D", ""), F.lit("0")))
        check = F.pmod(10 - F.pmod(sum0, F.lit(10)), F.lit(10))
        return F.concat(b, F.when(luhn_valid(e), check).otherwise(F.pmod(check + 1 + F.pmod(_nibbles(ks, F.lit(90)), F.lit(9)), F.lit(10))).cast("string"))

    return let(body, closed)


def _mod97(letters: Column) -> Column:
    """The remainder of an IBAN's characters, letters counting from 10."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), step)


def _iban(e: Column, ks: Column) -> Column:
    """The country stays; check digits are made anew, right ones for right ones and wrong ones for wrong ones."""
    country, own = F.substr(e, F.lit(1), F.lit(2)), F.regexp_replace(e, " ", "")
    right = _mod97(F.concat(F.substr(own, F.lit(5)), F.substr(own, F.lit(1), F.lit(4)))) == 1

    def closed(rest):
        check = 98 - _mod97(F.concat(F.regexp_replace(rest, " ", ""), country, F.lit("00")))
        wrong = 2 + F.pmod(check - 1 + F.pmod(_nibbles(ks, F.lit(91)), F.lit(96)), F.lit(97))
        return F.concat(country, F.lpad(F.when(right, check).otherwise(wrong).cast("string"), 2, "0"), rest)

    return let(_masked(F.substr(e, F.lit(5)), ks), closed)


def _phone(e: Column, norm: Column, ks: Column) -> Column:
    """The country code stays, if there is one: 1 before the ten digits that make the entity, else by CODE in numbers
    that begin with + or have eleven digits or more."""
    plain = F.regexp_replace(e, r"[^\p{L}\p{N}]", "")
    code = F.when(F.length(plain) > F.length(norm), F.lit(1)).when(norm.startswith("+") | (F.length(plain) >= 11), F.length(F.regexp_extract(plain, CODE, 0))).otherwise(F.lit(0))
    return let(code, lambda k: _masked(e, ks, keep=k))


def _ip(e: Column, ks: Column) -> Column:
    octets = F.transform(F.split(e, r"\."), lambda o, i: let(_nibbles(ks, i), lambda r: F.when(F.length(o) == 1, 1 + F.pmod(r, F.lit(9))).when(F.length(o) == 2, 10 + F.pmod(r, F.lit(90))).otherwise(100 + F.pmod(r, F.lit(155)))).cast("string"))
    return F.when(e.contains("."), F.array_join(octets, ".")).otherwise(_masked(e, ks, F.lit(True)))


def _name(e: Column, key: Column, turn: Column) -> Column:
    """Title kept; of several names the first comes from the title's gender (Latin script), the rest is masked and
    depends on that name alone, so a surname alone stays recognisable."""
    title = F.regexp_extract(e, rf"^(?:{TITLES})\b\.? ", 0)
    words = F.split(F.regexp_replace(e, rf"^(?:{TITLES})\b\.? ", ""), " ")
    lists = {g: F.split(F.lit(" ".join(v)), " ") for g, v in NAMES.items()}
    gender = _gender(e)
    pick = F.when(gender == "f", lists["f"]).when(gender == "m", lists["m"]).otherwise(lists["n"])

    def one(w, i):
        own = _stream(key, F.concat(F.lit("name:"), F.lower(w)), turn)
        first = (F.size(words) >= 2) & (i == 0) & w.rlike(r"^[\p{IsLatin}'-]{2,}$")
        name = lambda ks: F.element_at(pick, F.pmod(_nibbles(ks, F.lit(0)), F.lit(16)) + 1)
        return let(own, lambda ks: F.when(first, F.when(w == F.upper(w), F.upper(name(ks))).otherwise(name(ks))).otherwise(_masked(w, ks)))

    return F.concat(title, F.array_join(F.transform(words, one), " "))


def surrogate(e: Column, key: Column, turn: Column) -> Column:
    """The replacement of entity e; turn counts how often it was derived anew."""
    def of(kind, norm, s):
        local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
        host = _stream(key, F.concat(F.lit("domain:"), F.lower(domain)), F.lit(0))
        top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
        email = F.concat(_masked(local, s), F.lit("@"), let(host, lambda h: _masked(F.substr(domain, F.lit(1), F.length(domain) - F.length(top)), h)), top)
        # of a secret, what its normal form holds counts, with or without a label: a known prefix stays, hex stays hex
        value = F.regexp_replace(norm, "^(?:AKIA|gh[pousr]_|sk-)(?=.)", "")
        hexa = lambda v: v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        secret = let(value, lambda v: F.concat(F.substr(e, F.lit(1), F.length(e) - F.length(v)), let(hexa(v), lambda h: _masked(v, s, h))))
        out = (
            F.when(kind == "email", email)
            .when(kind == "name", _name(e, key, turn))
            .when(kind == "ip", _ip(e, s))
            .when(kind == "secret", secret)
            .when(kind == "iban", _iban(e, s))
            .when(kind == "card", _card(e, s))
            .when(kind == "phone", _phone(e, norm, s))
            .otherwise(_masked(e, s))
        )
        # where a format has fewer values than the data has entities, distinctness goes before format
        return F.when(turn >= WIDEN, F.concat(out, F.lit("-"), F.substr(s, F.lit(400), F.lit(12)))).otherwise(out)

    return let(kind_of(e), lambda k: let(normal(e, k), lambda n: let(_stream(key, F.concat_ws(":", k, n), turn), lambda s: of(k, n, s))))


def _entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, norm and one mention (the least) of every distinct entity; partial counts before the shuffle."""
    text = text_or_empty(text_col)
    found = docs.where(text.rlike(HINT)).select(F.explode(F.filter(F.array_distinct(_entities(text)), is_entity)).alias("e"))
    return found.groupBy(kind_of(F.col("e")).alias("kind"), normal(F.col("e")).alias("norm")).agg(F.min("e").alias("e"), F.count("*").alias("n_docs"))


def rederived(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, turn, n_docs of the entities whose first surrogate is another's or is itself an entity of the data.
    Ends when a check finds none; each turn concerns what the turn before left, and from turn WIDEN on surrogates have
    48 more random bits, so the turns end."""
    entities = stored(entities.select("kind", "norm", "e", "n_docs"), "entities")
    turns = None
    while True:
        t = entities.withColumn("turn", F.lit(0)) if turns is None else entities.join(turns, ["kind", "norm"], "left").withColumn("turn", F.coalesce("turn", F.lit(0)))
        now = stored(t.withColumn("out", let(surrogate(F.col("e"), F.lit(key), F.col("turn")), lambda x: normal(x, F.col("kind")))), "surrogates")
        first = now.groupBy("kind", "out").agg(F.min("norm").alias("keeper"), F.count("*").alias("c")).where("c > 1").select("kind", "out", "keeper")
        shared = now.join(first, ["kind", "out"]).where("norm <> keeper").select("kind", "norm")
        taken = now.join(entities.select("kind", F.col("norm").alias("out")), ["kind", "out"], "left_semi").select("kind", "norm")
        bad = stored(shared.unionAll(taken).distinct().withColumn("more", F.lit(1)), "bad")
        if bad.isEmpty():
            return now.where("turn > 0").select("kind", "norm", "turn", "n_docs")
        turns = stored(now.join(bad, ["kind", "norm"], "left").select("kind", "norm", (F.col("turn") + F.coalesce("more", F.lit(0))).alias("turn")).where("turn > 0"), "turns")


def replace(docs: DataFrame, key: str = KEY, text_col: str = "text", *, bound: int | None = None) -> DataFrame:
    """docs with surrogates in text_col, and _n_entities (with more underscores where docs has that name). Two passes
    over the texts. No text is shuffled, unless the entities that were derived anew exceed a broadcast (`bound`): then
    the texts that hold such ones are."""
    n_col, found, digest, turns_col, new = fresh(docs.columns, "n_entities", "found", "digest", "turns", "new")
    again = rederived(dictionary(docs, text_col), key)
    text = F.col(f"`{text_col}`")
    hit = text_or_empty(text).rlike(HINT)
    rows = docs.withColumn(found, F.when(hit, _entities(text)).otherwise(F.array().cast("array<string>")))
    named = lambda e: F.concat_ws(":", kind_of(e), normal(e))
    turn = lambda e: F.lit(0)
    if not again.isEmpty():
        # only texts that hold such entities meet the join, by a digest of the text
        rows = rows.withColumn(digest, F.when(F.size(found) > 0, F.sha2(text, 256)))
        each = rows.where(F.col(digest).isNotNull()).select(F.col(digest).alias("digest"), F.explode(F.array_distinct(found)).alias("e")).where(is_entity(F.col("e")))
        hits = each.groupBy("digest", kind_of(F.col("e")).alias("kind"), normal(F.col("e")).alias("norm")).agg(F.count("*").alias("copies"))
        hits = looked_up(hits, again, ["kind", "norm"], F.col("digest"), count="n_docs", how="inner", bound=bound)
        table = hits.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "norm"), "turn"))).alias(turns_col), F.max("copies").alias("copies"))
        table = stored(table.withColumnRenamed("digest", digest), "turns")
        if small(table, bound):
            rows = rows.join(F.broadcast(table.drop("copies")), digest, "left")
        else:
            with_turns = [*rows.columns, turns_col]
            held = looked_up(rows.where(F.col(digest).isNotNull()), table, [digest], F.monotonically_increasing_id(), count="copies", bound=bound)
            none = rows.where(F.col(digest).isNull()).withColumn(turns_col, F.lit(None).cast(table.schema[turns_col].dataType))
            rows = none.select(*(F.col(f"`{c}`") for c in with_turns)).unionAll(held.select(*(F.col(f"`{c}`") for c in with_turns)))
        turn = lambda e: F.coalesce(F.try_element_at(F.col(turns_col), named(e)), F.lit(0))
    out = F.transform(found, lambda e: F.when(is_entity(e), surrogate(e, F.lit(key), turn(e))).otherwise(e))
    # between two entities stands one piece of the text
    woven = F.array_join(F.zip_with(F.split(text, PATTERN, -1), F.concat(new, F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    done = rows.withColumn(new, out)
    keep = [F.when(F.size(found) > 0, woven).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*keep, F.size(F.filter(found, is_entity)).cast("bigint").alias(n_col))
