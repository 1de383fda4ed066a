"""Chat formatting with DataFrame functions only.

A row's layout is the sorted list of its nested field paths: of its columns that aren't null
(typed rows; sources of several layouts are read into one merged schema), or of its JSON object,
where null values have paths like others. Types don't count. The hash of that list is the row's fingerprint, and the
fingerprint selects a declarative mapping to canonical turns array<struct<role,text>>: CATALOGUE
holds the fingerprints of the declared layouts with every choice of their optional fields, and
layouts() makes such a table for the fingerprints beyond it, one row for each distinct one.
Turns are rendered with marks, control characters inside texts being escaped reversibly, and
with the spans of the loss mask.

Defined results: null texts count as empty, null roles as "" ; a conversation without turns
formats to ""; turns with equal numbers are ordered by role, then text, and repeated rows are
repeated turns; rows without a conv_id are one conversation, as in SQL; rows whose layout no
mapping knows, JSON that can't be read or is deeper than DEPTH among them, get null turns and
keep their fingerprint; other columns are not read. A conversation is a unit of output, so one
task holds its whole text, and work on it is in proportion to its length.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumlake.llm.common import looked_up, stored

TURNS = "array<struct<role:string,text:string>>"
OPEN, CLOSE = "<turn ", "</turn>\n"
DEPTH = 6  # levels of a JSON object that count for its fingerprint


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns: a list of messages, or single fields with fixed roles."""

    name: str
    needs: tuple[str, ...]  # nested paths, [] for elements
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()  # (role, path), in order; empty optional fields are left out
    roles: tuple[tuple[str, str], ...] = ()  # names of roles to canonical ones


#: The layouts met in public data; the first that fits a row is taken.
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), "messages"),
    Mapping("messages_text", ("messages[].role", "messages[].text"), "messages", text="text"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))),
    Mapping("instruction", ("instruction", "output"), fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt_response", ("prompt", "response"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", ("question", "answer"), fields=(("user", "question"), ("assistant", "answer"))),
)


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested leaf paths of a type, sorted; elements of arrays as []."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, at + "[]")
    if isinstance(kind, T.MapType):
        return paths(kind.valueType, at + "{}")
    return [at]


def fingerprint(found: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def mark(found: Column) -> Column:
    """fingerprint() of a column of sorted paths."""
    return F.substring(F.sha2(F.array_join(found, "\n"), 256), 1, 16)


def catalogue(mappings=MAPPINGS) -> dict[str, str]:
    """fingerprint -> name, of each mapping with each choice of its optional fields; the first mapping rules."""
    out: dict[str, str] = {}
    for m in mappings:
        optional = [p for _, p in m.fields if p not in m.needs]
        for n in range(len(optional) + 1):
            for some in combinations(optional, n):
                out.setdefault(fingerprint([*m.needs, *some]), m.name)
    return out


CATALOGUE = catalogue()


def row_paths(df: DataFrame, ignore: tuple[str, ...] = ()) -> Column:
    """Sorted nested paths of the columns of a row that aren't null, without those to ignore (ids)."""
    texts = "array<string>"
    of = [F.when(F.col(f"`{f.name}`").isNotNull(), F.lit(paths(f.dataType, f.name))).otherwise(F.array().cast(texts)) for f in df.schema.fields if f.name not in ignore]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*of)))) if of else F.array().cast(texts)


def json_paths(raw: Column) -> Column:
    """Sorted nested paths of a JSON text; elements of arrays as [], characters of paths inside keys escaped."""
    at, empty = F.try_parse_json(raw), F.lit(None).cast("variant")
    key = lambda k: F.regexp_replace(k, r"([\\.\[\]\n])", r"\\$1")

    def below(x):
        inner = F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), lambda e: F.struct(F.concat(x["p"], F.when(x["p"] == "", "").otherwise("."), key(e["key"])).alias("p"), e["value"].alias("v")))
        items = F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda e: F.struct(F.concat(x["p"], F.lit("[]")).alias("p"), e.alias("v")))
        leaf = F.array(F.struct(F.when(items.isNotNull(), F.concat(x["p"], F.lit("[]"))).otherwise(x["p"]).alias("p"), empty.alias("v")))
        return F.when(F.size(inner) > 0, inner).when(F.size(items) > 0, items).otherwise(leaf)

    found = F.array(F.struct(F.lit("").alias("p"), at.alias("v")))
    for _ in range(DEPTH):
        found = F.flatten(F.transform(found, below))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x["p"])))


def fitting(found: Column, mappings=MAPPINGS) -> Column:
    """The name of the first mapping whose needed paths are among the found ones (a list may be empty)."""
    out = F.lit(None).cast("string")
    for m in reversed(mappings):
        fits = F.lit(True)
        for p in m.needs:
            fits = fits & F.array_contains(found, p)
        if m.messages:
            fits = fits | F.array_contains(found, f"{m.messages}[]")
        out = F.when(fits, F.lit(m.name)).otherwise(out)
    return out


def layouts(marked: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """fingerprint, layout, rows, paths: one row for each distinct fingerprint; partial counts before the shuffle."""
    return marked.groupBy("fingerprint").agg(F.first("paths").alias("paths"), F.count("*").alias("rows")).select("fingerprint", fitting(F.col("paths"), mappings).alias("layout"), "rows", "paths")


def with_turns(df: DataFrame, ids: list[str], raw: str | None = None, mappings=MAPPINGS, *, open_world: bool = True) -> DataFrame:
    """The ids, fingerprint, layout and canonical turns of each row, from its typed columns or the JSON text `raw`.
    Layouts beyond the catalogue take one more pass over the rows, which open_world=False spares."""
    found = json_paths(F.col(raw)) if raw else row_paths(df, tuple(ids))
    named = F.create_map(*(F.lit(x) for pair in catalogue(mappings).items() for x in pair))
    body = [raw] if raw else [c for c in df.columns if c not in ids]
    marked = df.select(F.struct(*(F.col(f"`{c}`") for c in ids)).alias("id"), F.struct(*(F.col(f"`{c}`") for c in body)).alias("row"), found.alias("paths")).withColumn("fingerprint", mark(F.col("paths")))
    marked = marked.withColumn("known", F.try_element_at(named, F.col("fingerprint")))
    layout = F.col("known")
    if open_world:
        table = stored(layouts(marked.where("known is null"), mappings).drop("paths"), "layouts")
        marked = looked_up(marked, table, ["fingerprint"], F.monotonically_increasing_id(), count="rows")
        layout = F.coalesce("known", "layout")
    marked = marked.withColumn("layout", layout)
    turns, typed = F.lit(None).cast(TURNS), set(paths(marked.schema["row"].dataType))
    for m in reversed(mappings):
        one = json_turns(F.col(f"row.`{raw}`"), m) if raw else canonical_turns(marked, m, "row") if set(m.needs) <= typed else None
        if one is not None:
            turns = F.when(F.col("layout") == m.name, one).otherwise(turns)
    return marked.select("id.*", "fingerprint", "layout", turns.alias("turns"))


def _role(col: Column, m: Mapping) -> Column:
    out = F.coalesce(col.cast("string"), F.lit(""))
    for a, b in m.roles:
        out = F.when(out == a, F.lit(b)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def canonical_turns(df: DataFrame, mapping: Mapping, within: str | None = None) -> Column:
    """Turns by the mapping, from typed columns (or the fields of struct column `within`)."""
    at = lambda p: F.col(f"{within}.{p}" if within else p)
    if mapping.messages:
        return F.transform(F.coalesce(at(mapping.messages), F.array()), lambda x: _turn(_role(x[mapping.role], mapping), x[mapping.text]))
    have = set(paths(df.schema[within].dataType if within else df.schema))
    turns = [_turn(F.lit(r), at(p)) for r, p in mapping.fields if p in have]
    required = set(mapping.needs)
    keep = [F.lit(p in required) for r, p in mapping.fields if p in have]
    pairs = F.array(*(F.struct(t.alias("t"), k.alias("k")) for t, k in zip(turns, keep)))
    return F.transform(F.filter(pairs, lambda x: x["k"] | (x["t"]["text"] != "")), lambda x: x["t"])


def json_turns(raw: Column, m: Mapping) -> Column:
    """Turns of a JSON object by the mapping."""
    v = F.try_parse_json(raw)
    if m.messages:
        items = F.try_variant_get(v, f"$.{m.messages}", f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
        return F.transform(items, lambda x: _turn(_role(x[m.role], m), x[m.text]))
    get = lambda p: F.try_variant_get(v, f"$.{p}", "string")
    pairs = F.array(*(F.struct(_turn(F.lit(r), get(p)).alias("t"), F.lit(p in m.needs).alias("k")) for r, p in m.fields))
    return F.transform(F.filter(pairs, lambda x: x["k"] | (x["t"]["text"] != "")), lambda x: x["t"])


def escape(col: Column) -> Column:
    """Backslash and "<" become \\0 and \\1, so no text holds a turn's marks."""
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1"))


def unescape(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


def _role_out(col: Column) -> Column:
    return F.replace(escape(col), F.lit(">"), F.lit("\\2"))


def _role_in(col: Column) -> Column:
    return unescape(F.replace(col, F.lit("\\2"), F.lit(">")))


def render(turns: Column) -> Column:
    """<turn role>text</turn> and a newline for each turn."""
    one = lambda t: F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit(">"), escape(t["text"]), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """[turn, start, size] of each text of that role in render(turns): the turn's number from 0, and characters counted
    from the beginning of its mark."""
    def span(t, i):
        start = F.length(_role_out(t["role"])) + len(OPEN) + 1
        return F.struct(i.alias("turn"), start.alias("start"), F.length(escape(t["text"])).alias("size"), t["role"].alias("role"))

    said = F.filter(F.transform(turns, span), lambda s: s["role"] == role)
    return F.transform(said, lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["size"].alias("size")))


def read_back(formatted: Column) -> Column:
    """Turns from a formatted conversation."""
    parts = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")
    head = lambda p: F.instr(p, F.lit(">"))
    return F.transform(parts, lambda p: F.struct(_role_in(F.substr(p, F.lit(len(OPEN) + 1), head(p) - len(OPEN) - 1)).alias("role"), unescape(F.substr(p, head(p) + 1)).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text that the loss spans cover, nothing between."""
    cut = F.split(formatted, CLOSE)
    # the parts are made once, the spans read them by their number
    both = F.transform(F.array(cut), lambda parts: F.array_join(F.transform(spans, lambda s: unescape(F.substr(parts[s["turn"]], s["start"] + 1, s["size"]))), ""))
    return F.element_at(both, 1)


def several_layouts(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn to one row each conversation, as sources of different layouts have them, in one merged schema:
    lists of role and content, lists of from and value, prompt and response, instruction and output, by the id's
    remainder and where the turns allow it. The rows of a conversation meet in one task, as its text needs them."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = df.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("m"))
    said = next(m for m in MAPPINGS if m.name == "conversations")
    pair = (F.size("m") == 2) & (F.col("m")[0]["role"] == "user") & (F.col("m")[1]["role"] == "assistant")
    k = F.coalesce(F.pmod("conv_id", F.lit(4)), F.lit(0))
    back = {b: a for a, b in reversed(said.roles)}
    other = lambda r: F.when(r == "user", back["user"]).when(r == "assistant", back["assistant"]).otherwise(r)
    kind = F.when((k == 1) & ~F.exists("m", lambda t: t["role"].isin(*(a for a, _ in said.roles))), 1).when((k == 2) & pair, 2).when((k == 3) & pair, 3).otherwise(0)
    rows = rows.withColumn("kind", kind)
    part = lambda i: F.col("m")[i]["text"]
    return rows.select(
        "conv_id",
        F.when(F.col("kind") == 0, F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"),
        F.when(F.col("kind") == 1, F.transform("m", lambda t: F.struct(other(t["role"]).alias("from"), t["text"].alias("value")))).alias("conversations"),
        *(F.when(F.col("kind") == n, part(i)).alias(c) for n, pair_ in ((2, ("prompt", "response")), (3, ("instruction", "output"))) for i, c in enumerate(pair_)),
    )


def formatted(turns: DataFrame) -> DataFrame:
    """with_turns() with the formatted text and its loss spans; null where the layout is unknown."""
    return turns.select("*", render(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss_spans"))


def format_conversations(df: DataFrame) -> DataFrame:
    """Rows by turn, through layouts of several kinds, to conv_id, fingerprint, layout, turns, formatted, loss_spans."""
    return formatted(with_turns(several_layouts(df), ["conv_id"], open_world=False))


def digests(done: DataFrame) -> DataFrame:
    """What a reader of the formatted texts finds; everything comes from the text and the spans."""
    back = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


PROBE = "\\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose texts hold control strings."""
    spark = conversations.sparkSession
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


#: The same rows in SQL.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length(role) + length(text) + 15
      + length(role || text) - length(replace(replace(role || text, chr(92), ''), '<', ''))
      + length(role) - length(replace(role, '>', ''))) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
