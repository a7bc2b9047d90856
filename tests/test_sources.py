import io
import json
import sys
import zipfile
from email.message import EmailMessage

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docketry.operators import formation, reconcile
from docketry.plans import queries, queries_sources
from docketry.plans.model import Collection
from docketry.session import TASK_ROWS
from docketry.sources import conversation, files, web
from docketry.streaming import watch


def test_html_projection():
    html = '<title>A  b</title><script>x</script><p>one <a href="/y">two <b>three</b></a></p>four<br>five<svg>gone'
    assert web.project(html, "https://h.example/x") == ("A b", "one two three (https://h.example/y)\n\nfour\n\nfive")
    assert web.project("<p>a<a href='mailto:x'>b</a> <a>lost", "http://h.example/")[1] == "ab (mailto:x)"
    assert web.project(None, None) == ("", "")
    open_, closed = (web.project("<title>a&amp</title><p>b&amp;amp c&ampd &copy; &#38;&#38 & <a href='/?a=1&amp;b'>e&lt</a>", "http://h.example/", c) for c in (False, True))
    assert open_ == ("a&", "b&amp c&d © && & e< (http://h.example/?a=1&b)") and closed == ("a&amp", "b&amp c&ampd © &&#38 & e&lt (http://h.example/?a=1&b)")


def test_conversation_export(spark):
    body = json.dumps({"format": "some-conversation-v1", "conversation_id": "c 1", "messages": [
        {"id": "m1", "role": "user", "content": "hi\nthere", "date": "2024-05-17T10:00:00Z"}, {"id": "m1", "role": "user", "content": "again"},
        {"role": "robot", "content": "x"}, {"id": "m4", "role": "tool"}, {"id": "m5", "role": "assistant", "content": "y", "date": "yesterday"},
    ]})
    rows = conversation.messages(spark.createDataFrame([("p", body)], "path string, body string")).orderBy("position").collect()
    assert [(r["message"], r["role"], r["date"], r["text"], r["gap"]) for r in rows] == [
        ("m1", "user", "2024-05-17T10:00:00Z", "hi\nthere", None), ("m1", "user", "unknown", None, "duplicate identity"),
        ("entry-3", "unknown", "unknown", "x", "no identity; unsupported role"), ("m4", "tool", "unknown", None, "no text"), ("m5", "assistant", "unknown", "y", "malformed date"),
    ]
    lines = conversation.located(conversation.messages(spark.createDataFrame([("p", body)], "path string, body string"))).orderBy("position").collect()
    parsed = conversation.parse_located(lines[0]["line"])
    assert parsed["session"] == "c 1" and parsed["text"] == "hi\\nthere"
    assert conversation.parse_located(lines[0]["line"].replace("role=", "session=", 1)) is None


def test_conversation_export_limits(spark):
    def body(n, text):
        return json.dumps({"format": "conversation-v1", "conversation_id": "c", "messages": [{"id": f"m{k}", "role": "user", "content": text} for k in range(n)]})

    exports = spark.createDataFrame([("long", body(1003, "x")), ("large", body(9, "x" * (1 << 20))), ("full", body(1000, "x"))], "path string, body string")
    rows = conversation.messages(exports).collect()
    assert {p: sum(r["path"] == p and r["text"] is not None for r in rows) for p in ("long", "large", "full")} == {"long": 1000, "large": 0, "full": 1000}
    assert sorted((r["path"], r["session"], r["message"], r["position"], r["gap"]) for r in rows if r["gap"]) == [
        ("large", None, None, 1, "export over 8388608 bytes, no message read"), ("long", "c", None, 1001, "only the first 1000 of 1003 messages read"),
    ]


def test_registered_conversations_have_no_limits(spark, tmp_path):
    """A conversation of 2500 turns, and one of over 8 MiB."""
    turns = [(1, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(2500)] + [(2, t, "user", f"{t}" + "x" * (1 << 20)) for t in range(9)]
    spark.createDataFrame(turns[::-1], "conv_id long, turn long, role string, text string").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = queries.QUERIES["conversation_messages"](spark, str(tmp_path)).collect()
    assert sorted((int(r["session"]), r["position"], r["message"], r["text"]) for r in rows) == [(c, t + 1, str(t), x) for c, t, _, x in turns]
    lines = queries.QUERIES["conversation_lines"](spark, str(tmp_path)).collect()
    assert sorted((r["path"], r["position"], conversation.parse_located(r["line"])["text"]) for r in lines) == [(f"c{c}", t + 1, x) for c, t, _, x in turns]


def test_rollout(spark):
    def line(n, kind, **payload):
        return ("p", n, json.dumps({"timestamp": "2024-05-17T10:00:00Z", "type": kind, "payload": payload}))

    rows = [
        line(1, "session_meta", id="s"), line(2, "response_item", type="message", role="user", content=[{"type": "text", "text": "q"}]),
        line(3, "response_item", type="function_call", name="f", call_id="k", arguments="{}"), line(4, "response_item", type="function_call_output", call_id="k", output="done"),
    ]
    frame = spark.createDataFrame(rows, "path string, line int, value string")
    assert [(r["role"], r["text"]) for r in conversation.rollout(frame).orderBy("position").collect()] == [("user", "q"), ("assistant_tool_call", "f {}"), ("tool", "f: done")]
    assert conversation.supported(frame).first()["supported"]
    assert not conversation.supported(frame.where("line > 1")).first()["supported"]


def test_containers(spark):
    mail = EmailMessage()
    mail["From"], mail["Subject"] = "a@b.example", "S"
    mail.set_content("line one\n\nline two")
    mail.add_attachment(b"x", maintype="application", subtype="octet-stream", filename="f")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("../b.txt", "no")
        z.writestr("c.exe", "no")
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="N" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>shared</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", '<w><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="C1" t="b"><v>1</v></c></w>')
    frame = spark.createDataFrame([("m", "eml", bytearray(mail.as_bytes())), ("z", "zip", bytearray(packed.getvalue())), ("x", "xlsx", bytearray(sheet.getvalue()))], "path string, format string, content binary")
    rows = {(r["path"], r["channel"], r["text"]) for r in files.lines(frame).where("text IS NOT NULL").collect()}
    assert {("m", "header", "S"), ("m", "body", "line two"), ("z", "member", "hello"), ("x", "cell", "shared"), ("x", "cached_formula_value", "2"), ("x", "cell", "TRUE")} <= rows
    assert not any(t == "no" for _, _, t in rows)


def test_candidates_have_byte_spans():
    text = "É. Survey V17 on May 17, 2024: possibly 12 visits, 10 minutes. #field-work at Riverside"
    found = {(k, v) for k, v, *_ in formation.candidates_in(text)}
    assert {("event", "Survey V17"), ("date", "May 17, 2024"), ("count", "12 visits"), ("duration", "10 minutes"), ("tag", "field-work"), ("place", "Riverside")} <= found
    for _, _, a, b, *_ in formation.candidates_in(text):
        assert text.encode()[a:b].decode()
    assert next(q for k, _, _, _, q, _ in formation.candidates_in(text) if k == "count") == "possibly"


def test_updates_and_order(spark):
    supports = spark.createDataFrame([("visits=12", "s", 1, "visits"), ("minutes=10", "s", 1, "minutes"), ("minutes=10", "t", 1, "minutes"), ("visits=15", "s", 2, "visits")], "item_id string, source_id string, ordinal int, property string")
    schema = "source_id string, ordinal int, role string, property string"
    whole = spark.createDataFrame([("s", 2, "complete_replacement", None)], schema)
    assert {r["item_id"] for r in reconcile.current_items(reconcile.apply_updates(supports, whole)).collect()} == {"visits=15", "minutes=10"}
    single = spark.createDataFrame([("s", 2, "targeted_correction", "visits"), ("s", 3, "conditional", None)], schema)
    assert {r["item_id"] for r in reconcile.current_items(reconcile.apply_updates(supports, single)).collect()} == {"visits=15", "minutes=10"}
    candidates = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "c"), ("t", "d")], "source_id string, version_id string")
    before = spark.createDataFrame([("a", "b")], "earlier string, later string")
    assert [tuple(r) for r in reconcile.latest_if_certain(candidates, before).collect()] == [("s", "b")]


def test_two_complete_scans_delete(spark):
    receipts = spark.createDataFrame([("a", "1", 1, None), ("b", "1", 1, None)], "path string, fingerprint string, seen int, missing int")
    listing = spark.createDataFrame([("a", "2")], "path string, fingerprint string")
    first = watch.scan(receipts, listing, 2, complete=True)
    assert {(r["path"], r["action"]) for r in first.collect()} == {("a", "changed"), ("b", "missing")}
    assert {(r["path"], r["action"]) for r in watch.scan(first.drop("action"), listing, 3, complete=False).collect()} == {("a", "unchanged"), ("b", "missing")}
    assert {(r["path"], r["action"]) for r in watch.scan(first.drop("action"), listing, 3, complete=True).collect()} == {("a", "unchanged"), ("b", "delete")}


def test_watch_sees_each_file_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.txt").write_text("x")
    for _ in range(2):
        watch.watch(spark, str(folder), str(tmp_path / "state"), lambda rows, n: seen.extend(r["path"] for r in rows.select("path").collect())).awaitTermination()
    assert len(seen) == 1


def test_pages_by_tokens():
    from docketry.sources import web

    assert web.project("<p>a<fieldset>b</fieldset><aside>c</aside>d", "http://x.example")[1] == "a\n\nb\n\ncd"
    assert web.project("<svg><script>x</svg>y<title>t<svg>u</title>v", "http://x.example") == ("tuv", "y")
    assert web.project("<a name=z>here</a> <a href='mailto:q'>m</a>", "http://x.example/p#f")[1] == "here (http://x.example/p) m (mailto:q)"


def test_readers_see_the_old_or_the_new_version(spark, tmp_path):
    from docketry.sources import files

    folder = str(tmp_path / "out")
    for n in (3, 5):
        files.publish(spark.range(n), folder)
        assert files.published(spark, folder).count() == n


def test_gaps_of_a_page_end_at_a_hundred(spark):
    from docketry.operators import inspect

    rows = [("p", "x", f"s{n:03}", "d", n % 11) for n in range(120)] + [("q", "x", "s", "d", 1)]
    found = spark.createDataFrame(rows, "page_id string, category string, scope string, detail string, rule int")
    told = {(r["page_id"], r["truncated"]): r["count"] for r in inspect.first_gaps(found).groupBy("page_id", "truncated").count().collect()}
    assert told == {("p", True): 100, ("q", False): 1}


def test_withdrawal_and_restoring(spark):
    from docketry.operators import reconcile

    held = [("s1", "v1", "o1"), ("s1", "v2", "o2"), ("s2", "v3", "o1"), ("s3", "v4", "o1"), ("s3", "v5", "o2"), ("s3", "v6", "o2"), ("s4", "v7", "o2"), ("s4", "v8", "o1"), ("s5", "v9", "o1"), ("s5", "w1", "o2"), ("s5", "w2", "o2")]
    acquisitions = spark.createDataFrame([(*h, "watched", "r") for h in held], "source_id string, version_id string, origin string, method string, registration string")
    sources = spark.createDataFrame([("s1", "v2", "v1"), ("s2", "v3", None), ("s3", "v4", None), ("s4", None, "v7"), ("s5", "v9", None)], "source_id string, current string, pending string")
    removed = spark.createDataFrame([("o1", "watched", None), ("o2", "watched", "other")], "origin string, method string, registration string")
    order = spark.createDataFrame([("v5", "v6")], "earlier string, later string")
    after, versions = reconcile.withdraw(sources, acquisitions, removed, order)
    assert {tuple(r) for r in after.collect()} == {("s1", "v2", None, "keep"), ("s2", None, None, "removed"), ("s3", None, "v6", "fallback"), ("s4", None, "v7", "keep"), ("s5", None, None, "uncertain")}
    assert {r["version_id"] for r in versions.where("state = 'withdrawn'").collect()} == {"v1", "v3", "v4", "v8", "v9"}
    supports = spark.createDataFrame([("f", "s1"), ("f", "s2"), ("g", "s2")], "item_id string, source_id string")
    assert {tuple(r) for r in reconcile.withdrawn_supports(supports, after).collect()} == {("f", "s1")}
    left = acquisitions.where("origin = 'o2'")
    assert reconcile.restore(left, acquisitions).count() == len(held)


def test_small_files_leave_together_and_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    count, each = TASK_ROWS + 7, []
    pq.write_table(pa.table({"c_custkey": list(range(count)), "c_name": ["n"] * count, "c_mktsegment": ["s"] * count}), tmp_path / "customer.parquet")
    made = queries_sources._packages(Collection(spark, str(tmp_path)), "zip", lambda k, n, s: {"a.txt": f"{n}\n{k}"})
    assert made.rdd.getNumPartitions() == 2 and files.lines(made).where("text = 'n'").select("path").distinct().count() == count
    monkeypatch.setattr(type(made), "mapInPandas", lambda self, f, schema: each.append(f))
    files.lines(made)
    out = list(each[0](iter([pd.DataFrame([(str(n), "zip", queries_sources._package({"a.txt": "x\ny"})) for n in range(5000)], columns=["path", "format", "content"])])))
    assert len(out) == 3 and sum(map(len, out)) == 10000 and out[2]["path"].iloc[-1] == "4999"


def test_members_are_read_as_the_archive_reads_them():
    """Plain ones without it; stored, spanned, wrong and encrypted ones as it has always been."""
    def packed(method, **flags):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            z.writestr("é.xml", "<a>é</a>" * 50)
            z.writestr("empty.xml", "")
        return out.getvalue()

    class Unread(zipfile.ZipFile):
        def read(self, *_):
            raise AssertionError("read by the archive")

    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2):
        data = b"before" + packed(method)
        kind = zipfile.ZipFile if method == zipfile.ZIP_BZIP2 else Unread
        archive = kind(io.BytesIO(data))
        assert [files._member(data, archive, i) for i in archive.infolist()] == [("<a>é</a>" * 50).encode(), b""]
    for spoil in (lambda d: d.replace(b"<a>", b"<b>", 1), lambda d: d.replace("é.xml".encode(), "è.xml".encode(), 1)):
        data = spoil(packed(zipfile.ZIP_STORED))
        archive = zipfile.ZipFile(io.BytesIO(data))
        with pytest.raises(zipfile.BadZipFile):
            files._member(data, archive, archive.infolist()[0])
    made = queries_sources._package({"é/a.xml": "<a/>", "b.xml": "", "big.xml": "x" * 100_000})
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.testzip() is None and {i.filename: z.read(i).decode() for i in z.infolist()} == {"é/a.xml": "<a/>", "b.xml": "", "big.xml": "x" * 100_000}


def test_packages_are_read_as_zipfile_lists_them(monkeypatch):
    """Plain ones without it; those with a comment, bytes before them, extra fields, zip64, odd names or a broken directory as it has always been."""
    made = queries_sources._package({**queries_sources._workbook(7, "Ann", "B"), "../x.xml": "<x/>", "xl/é.xml": "<a:b xmlns:a='n'><a:c/></a:b>", "no.xml": "<a", "big.xml": f"<a>{'x' * 10_000}</a>"})
    long, comment = io.BytesIO(), io.BytesIO(made)
    with zipfile.ZipFile(long, "w", zipfile.ZIP_DEFLATED) as z, zipfile.ZipFile(io.BytesIO(made)) as old:
        for name in [*old.namelist(), "xl/workbook.xml"]:
            with z.open(name, "w", force_zip64=True) as f:
                f.write(old.read(name))
    with zipfile.ZipFile(comment, "a") as z:
        z.comment = b"said"
    wrong = bytearray(made)
    wrong[made.index(b"PK\x01\x02") + 16] ^= 1
    odd = [long.getvalue(), comment.getvalue(), b"before" + made, made.replace("é".encode(), b"\0\0"), made[:-1], made[60:], made.replace(b"PK\x01\x02", b"PK\x01\x03", 1), b"", b"PK"]

    def seen(data):
        try:
            parts, gaps = files._parts(data)
        except Exception as error:
            return repr(error)
        return {k: files.ElementTree.tostring(v) for k, v in parts.items()}, gaps

    packages = [made, bytes(wrong), *odd]
    got = [seen(p) for p in packages]
    assert files._members(made) and [files._members(p) for p in odd[4:]] == [None] * 5
    assert got[0][1] == ["part ../x.xml is unsafe or repeated", "part no.xml is not readable"] and len(got[0][0]) == 6
    monkeypatch.setattr(files, "_members", lambda data: None)
    monkeypatch.setattr(files, "_packed", lambda data, member: None)
    assert [seen(p) for p in packages] == got


def test_parts_that_packages_share_are_made_and_read_once(monkeypatch):
    """The workbook and its relations of every package, while names and cells are read anew (parts read of 50 packages: 102, 200 before)."""
    packed = [queries_sources._package(queries_sources._workbook(k, f"N{k}", "S")) for k in range(50)]
    read, known = [], files.ElementTree.XMLParser
    monkeypatch.setattr(files.ElementTree, "XMLParser", lambda *a, **k: read.append(1) or known(*a, **k))
    if hasattr(files, "_small_part"):
        files._small_part.cache_clear()
    found = [files.sheet_lines(p)[0] for p in packed]
    assert [[text for _, _, text in cells] for cells in found] == [[f"N{k}", str(k), str(2 * k), "TRUE", "S"] for k in range(50)]
    assert len(read) == 102


def test_packages_cost_little_each():
    """Names are cut once a part, not at every look for one, and members are not opened one by one (calls of Python functions: 84, 265 before)."""
    data = queries_sources._package(queries_sources._document(7, "Ann", "B"))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    files.document_lines(data)
    sys.setprofile(count)
    try:
        lines, gaps = files.document_lines(data)
    finally:
        sys.setprofile(None)
    assert (len(lines), gaps) == (6, []) and calls < 150, calls
