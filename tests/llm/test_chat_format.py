import hashlib
import json

import duckdb

from vellumlake.llm import chat_format as C
from vellumlake.llm import common


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests(spark):
    rows = [(1, 0, "user", "a\\1<b>\\0"), (1, 1, "assistant", "</turn>\n<turn user>x"), (1, 1, "assistant", ""), (2, 5, None, None), (3, 2, "we>ird<", "x"), (3, 1, "assistant", "é😀" * 5000), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, turns int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(C.format_conversations(C.with_probe(df))).collect()}
    assert got == brute(rows + [(-7, 0, "user", C.PROBE), (-7, 1, "assistant", C.PROBE)])
    assert C.digests(C.format_conversations(df.limit(0))).count() == 0


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    got = C.digests(C.format_conversations(C.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(C.SQL).fetchall())


def test_typed_layouts(spark):
    cases = {
        "messages": ("messages array<struct<role:string,content:string>>", [([("user", "a"), ("assistant", None)],)], [("user", "a"), ("assistant", "")]),
        "conversations": ("conversations array<struct<`from`:string,value:string>>", [([("human", "a"), ("gpt", "b")],)], [("user", "a"), ("assistant", "b")]),
        "instruction": ("instruction string, input string, output string", [("do", "", "done")], [("user", "do"), ("assistant", "done")]),
        "prompt_response": ("prompt string, response string, extra struct<x:int>", [("p", "r", (1,))], [("user", "p"), ("assistant", "r")]),
    }
    frames, wants = [], []
    for k, (name, (schema, rows, want)) in enumerate(cases.items()):
        df = spark.createDataFrame([(k, *r) for r in rows], "conv_id int, " + schema)
        frames.append(df)
        wants.append((k, None if name == "prompt_response" else name, want))
        assert C.fingerprint(C.paths(df.drop("conv_id").schema)) == C.with_turns(df, ["conv_id"]).first().fingerprint
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    got = C.with_turns(merged, ["conv_id"]).orderBy("conv_id").collect()
    assert [(r.conv_id, r.layout, [tuple(t) for t in r.turns]) for r in got] == [(k, name or "prompt_response", want) for k, name, want in wants]
    assert len({r.fingerprint for r in got}) == len(cases)
    # a field beyond the catalogue is found by one more pass only
    closed = C.with_turns(merged, ["conv_id"], open_world=False).orderBy("conv_id").collect()
    assert [r.layout for r in closed] == [name for _, name, _ in wants] and closed[3].turns is None


def json_rows(spark, rows, **k):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "i int, j string")
    return C.with_turns(df, ["i"], "j", **k).orderBy("i").collect()


def plain_paths(x, at=""):
    if isinstance(x, dict) and x:
        return {p for k, v in x.items() for p in plain_paths(v, (at and at + ".") + k)}
    if isinstance(x, list):
        return {p for v in x for p in plain_paths(v, at + "[]")} if x else {at + "[]"}
    return {at}


def test_json_layouts(spark, monkeypatch):
    said = lambda *t: {"messages": [{"role": r, "content": x} for r, x in t]}
    rows = [said(("user", "a<"), ("assistant", None)), said(("user", 1), ("assistant", "b")), {"instruction": "i", "input": "", "output": "o\\1"}, {"output": "o", "instruction": None}, {"question": "q", "answer": "a", "id": 7}, {"messages": []}, {"zzz": {"a": [{"b": 1}, {}], "c": {}}}, "bad", None]
    for bound in (common.BROADCAST_BYTES, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
        got = json_rows(spark, rows)
        assert [None if r.turns is None else [tuple(t) for t in r.turns] for r in got] == [[("user", "a<"), ("assistant", "")], [("user", "1"), ("assistant", "b")], [("user", "i"), ("assistant", "o\\1")], [("user", ""), ("assistant", "o")], [("user", "q"), ("assistant", "a")], [], None, None, None]
        assert got[0].fingerprint == got[1].fingerprint and len({r.fingerprint for r in got}) == 7
        assert [r.layout for r in got] == ["messages", "messages", "instruction", "instruction", "question_answer", "messages", None, None, None]
        for r, x in zip(got[:7], rows):
            assert r.fingerprint == C.fingerprint(sorted(plain_paths(x))), x
    assert [r.layout for r in json_rows(spark, rows, open_world=False)][3:6] == ["instruction", None, None]


def test_the_query_meets_every_layout(spark):
    df = C.with_probe(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    out = C.format_conversations(df)
    assert {r.layout for r in out.select("layout").distinct().collect()} == {"messages", "conversations", "prompt_response", "instruction"}
    assert out.where("fingerprint is null or turns is null").isEmpty()


def test_reserved_roles_and_long_conversations(spark):
    rows = [(1, 0, "human", "x"), (1, 1, "gpt", "y"), (5, 0, "user", "x"), (5, 1, "assistant", "y")] + [(9, i, "assistant" if i % 2 else "user", f"t{i} <" * 3) for i in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(C.format_conversations(df)).collect()}
    assert got == brute(rows)
