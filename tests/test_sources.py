import json
import zlib

import pytest
from pyspark.sql import functions as F

from vellumlake.sources import pdf_content as C
from vellumlake.sources import readers, sinks, toml, xml


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_snapshot(spark, tmp_path):
    char = {"unicode": "a", "code": 97, "font_size": 10.0}
    doc = {"schema_version": 1, "pages": [{"index": 0, "geometry": {"width": 1.0, "height": 2.0, "rotate_degrees": 0}, "paragraphs": [{"reading_order": 3, "text": {"kind": "chars", "chars": [char, {**char, "visible": False}]}, "preserved": '{"reason":"unsupported_font"}'}]}]}
    d = readers.snapshots(spark, write(tmp_path / "x.il.json", json.dumps(doc, indent=1)))
    p = readers.paragraphs(d)
    assert p.first().preserved == "unsupported_font" and p.first().document == "x"
    assert [(r.pos, r.visible, r.implicit_space_before) for r in readers.characters(p).orderBy("pos").collect()] == [(0, True, False), (1, False, False)]
    assert readers.pages(d).first().paragraphs == 1


REGION = {"bounds": {"left": 0, "bottom": 0, "right": 5, "top": 5}, "reading_order": 0, "label": "text", "source": "model", "confidence": 0.5}


def recording(**page):
    return {"schema_version": 1, "pages": [{"page_index": 0, "geometry": {"width": 9.0, "height": 9.0, "rotate_degrees": 0}, "regions": [REGION], **page}]}


def test_recording(spark, tmp_path):
    ok = readers.recordings(spark, write(tmp_path / "ok.json", json.dumps(recording())))
    assert ok.first().label == "text"
    for k, bad in enumerate((recording(extra=1), recording(regions=[REGION, REGION]), recording(regions=[{**REGION, "confidence": 2}]), {**recording(), "schema_version": 2}, recording(regions=[{**REGION, "other": 1}]))):
        with pytest.raises(Exception, match="invalid layout recording"):
            readers.recordings(spark, write(tmp_path / f"bad{k}.json", json.dumps(bad))).collect()


def test_events_and_usage(spark, tmp_path):
    e = readers.events(spark, write(tmp_path / "run.ndjson", '{"event":"diagnostic","id":"translation_retry"}\n\n{"event":"result"}\n'))
    assert [(r.run, r.event) for r in e.orderBy("ordinal").collect()] == [("run", "diagnostic"), ("run", "result")]
    for name, text in (("a.txt", "real 1.5\nmaximum resident set size 77\n"), ("b.txt", " 1.5 real 0.1 user\n 77  maximum resident set size\n")):
        assert tuple(readers.resource_usage(spark, write(tmp_path / name, text)).first())[1:] == (1.5, 77)


def test_glossary(spark, tmp_path):
    g = toml.glossary(spark, write(tmp_path / "g.toml", 'version = 1\n[[terms]]\nsource = "b"\ntarget = "B"\n[[terms]]\nsource = "a"\ntarget = "A"\n'))
    assert sorted(map(tuple, g.collect())) == [("a", "A"), ("b", "B")]
    text = toml.glossary_toml(g).first().toml
    assert text.index('"a"') < text.index('"b"')
    with pytest.raises(Exception, match="invalid glossary"):
        toml.glossary(spark, write(tmp_path / "h.toml", 'version = 1\n[[terms]]\nsource = "a"\ntarget = "A"\n[[terms]]\nsource = "a"\ntarget = "B"\n')).collect()


def test_manifest(spark, tmp_path):
    write(tmp_path / "manifest.toml", 'schema_version = 1\n[identity]\nid = "u"\n[expected]\ntolerance_pt = 0.5\n[[expected.block]]\nkey = "k"\npage = 0\ntext = "t"\n')
    m = toml.manifests(spark, str(tmp_path))
    assert tuple(toml.expected_blocks(m).select("fixture", "key", "visible").first()) == ("u", "k", True)


def test_xml():
    trace = '<document><page mediabox="0 0 9 9"><clip_path bbox="0 0 5 5"/><g unicode="a" x="1" y="2"/><pop_clip/><fill_image bbox="0 0 1 1"/></page></document>'
    rows = xml.trace_rows(trace)
    assert [(r[2], r[3], r[10]) for r in rows] == [("text", "a", ["0 0 5 5"]), ("image", None, [])]
    blocks = xml.block_rows('<doc><page><block xMin="0" yMin="1" xMax="2" yMax="3"><word>a</word><word>b</word></block></page></doc>')
    assert blocks == [(0, 0, "a b", 0.0, 1.0, 2.0, 3.0)]


def test_content_stream():
    data = b"q 1 0 0 1 5 7 cm BT /F1 10 Tf 2 3 Td (a\\)b) Tj [<63> -500 (d)] TJ ET Q"
    chars, seen = C.walk(C.decode(zlib.compress(data), ["FlateDecode"]))
    assert bytes(c[1] for c in chars) == b"a)bcd" and chars[0][2:4] == (7.0, 10.0) and seen["complete"] and seen["visible"] == 3
    assert not C.walk(b"q BT (a) Tj")[1]["complete"] and C.walk(b"BT 3 Tr (a) Tj ET")[1]["invisible"] == 1
    assert C.decode(b"48 65 6>", ["ASCIIHexDecode"]) == b"He`"
    with pytest.raises(C.BadStream):
        C.decode(zlib.compress(b"x" * 100), ["FlateDecode"], most=10)
    assert [t[1] for t in C.tokens(b"12Tf .5 -.5 <<>>")] == [12.0, "Tf", 0.5, -0.5, "<<", ">>"]


def test_forms_are_read_where_they_are_drawn():
    inner = C.XObject("Form", "2", b"BT /F 10 Tf 1 0 0 1 1 1 Tm (in) Tj ET", (), {}, (1, 0, 0, 1, 100, 0))
    names = {"/Fm": inner, "/Im": C.XObject("Image", "9"), "/Odd": C.XObject("PS", "8")}
    chars, seen = C.walk(b"BT /F 10 Tf (a) Tj ET q 2 0 0 2 0 0 cm /Fm Do Q /Im Do", names=names)
    assert [(c[0], chr(c[1]), c[2], c[3]) for c in chars] == [(0, "a", 0.0, 0.0), (1, "i", 202.0, 2.0), (2, "n", 212.0, 2.0)]
    assert seen == {"visible": 2, "invisible": 0, "images": 1, "complete": True}
    for content in (b"/Nope Do", b"/Odd Do", b"Do", b"/Fm /Im Do"):
        assert C.walk(content, names=names)[1] == {"visible": 0, "invisible": 0, "images": 0, "complete": False}
    assert not C.walk(b"/Im Do")[1]["complete"]
    hidden = {"/A": C.XObject("Form", "1", b"BT (x) Tj 0 Tr (y) Tj ET")}
    assert C.walk(b"BT 3 Tr ET /A Do BT (z) Tj ET", names=hidden)[1] == {"visible": 1, "invisible": 2, "images": 0, "complete": True}
    ring: dict = {}
    ring["/A"] = C.XObject("Form", "1", b"BT (x) Tj ET /B Do", (), ring)
    ring["/B"] = C.XObject("Form", "2", b"BT (y) Tj ET /A Do", (), ring)
    assert C.walk(b"/A Do", names=ring)[1] == {"visible": 2, "invisible": 0, "images": 0, "complete": False}
    deep: dict = {}
    deep["/A"] = C.XObject("Form", None, b"/A Do", (), deep)
    assert not C.walk(b"/A Do", names=deep)[1]["complete"]
    assert not C.walk(b"/A Do", names={"/A": C.XObject("Form", "1", b"no", ("FlateDecode",))})[1]["complete"]


def test_unreadable_streams_have_no_characters(spark):
    df = spark.createDataFrame([("d", 0, bytearray(b"BT (a) Tj ET"), []), ("d", 1, bytearray(b"no"), ["FlateDecode"])], "document string, page_index int, data binary, filters array<string>")
    assert [(r.page_index, r.code) for r in C.characters(df).collect()] == [(0, 97)]
    assert sorted((r.page_index, r.visible, r.complete) for r in C.evidence(df).collect()) == [(0, 1, True), (1, 0, False)]


def test_reports_and_names(spark, tmp_path):
    df = spark.createDataFrame([("d", '{"a":["/Form",{"Link":1,"x":{"y":["Form","other Form"]}}],"t":"say \\"Form\\" twice"}')], "document string, j string")
    assert sorted(map(tuple, readers.json_names(df, "j", ["Form", "Link", "Image"]).collect())) == [("d", "Form", 2), ("d", "Link", 1)]
    bad = spark.createDataFrame([(1, "no json"), (2, '{"terms":[{"source":"a","target":"b"},{"source":"","target":"c"}]}')], "k int, value string")
    assert [tuple(r) for r in readers.extracted_terms(bad).collect()] == [(2, "a", "b")]
    many = "".join('{"event":"x","id":"%d"}\r\n%s' % (i, "\n" if i % 7 == 0 else "") for i in range(5000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = readers.events(spark, write(tmp_path / "long.ndjson", many)).orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.id for r in got] == [str(i) for i in range(5000)] and got[1].ordinal == 2 and got[-1].ordinal == 4999 + 715 - (4999 % 7 == 0)


def test_cmap_and_pixmap():
    codes, spaces = C.cmap("1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <02> <04> <0042> <05> <06> [<0061> <0062>] endbfrange")
    assert codes == {1: "A", 2: "B", 3: "C", 4: "D", 5: "a", 6: "b"} and spaces == [(1, 0, 255)]
    assert C.ppm(b"P6 1 1 255\nabc") == (1, 1, b"abc")


def test_pixel_fidelity(spark):
    a, b = bytearray(b"P6 2 1 255\nabcdef"), bytearray(b"P6 2 1 255\nabcxyz")
    df = spark.createDataFrame([("d", 0, a, b, [[1, 0, 2, 1]]), ("d", 1, a, b, [])], "document string, page_index int, a binary, b binary, mask array<array<int>>")
    assert sorted((r.page_index, r.equal, r.compared) for r in C.pixel_fidelity(df).collect()) == [(0, 1, 1), (1, 1, 2)]


def test_sinks(spark, tmp_path):
    assert sinks.event_lines(spark.sql("select 'result' as event, cast(null as string) as id")).first().value == '{"event":"result"}'
    store, new = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 9, 1), ("b", 2, 1), ("b", 3, 2)], "k string, v int, o int")
    assert sorted(map(tuple, sinks.inserted(store, new, "k", "o").collect())) == [("a", 1), ("b", 3)]


def test_pass_chain(spark, tmp_path):
    from vellumlake.plans.passes import chain

    out = chain(spark.range(3), [("double", lambda d: d.select((F.col("id") * 2).alias("id"))), ("filter", lambda d: d.where("id > 0"))], str(tmp_path / "s"))
    assert sorted(r.id for r in out.collect()) == [2, 4] and (tmp_path / "s" / "stage=01-double").exists()
