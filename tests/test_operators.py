"""Graph, ranking, maintenance, verification, plans, sources, parsers and the event plane."""

import base64
import hmac
import io
import json
import zipfile
from datetime import datetime, timedelta
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from graphmill.functions import hashing
from graphmill.operators import graph, maintain, plan_doc, rank, vector, verify
from graphmill.parse.symbols import parse_symbols
from graphmill.sources import manifest, snapshots
from graphmill.streaming import events as stream


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_top_k_and_crowding_out(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.1]), (3, "b", [0.0, 1.0]), (4, "a", [2.0, 0.0]), (5, "a", None), (6, "a", [0.0, 0.0]), (7, "a", [1.0]), (8, "a", [float("nan"), 1.0])], "id int, service string, v array<double>")
    assert [r.id for r in vector.top_k(v, "id", "v", [1.0, 0.0], 3).collect()] == [1, 4, 2]
    assert [r.id for r in vector.top_k(v, "id", "v", [1.0, 0.0], 2, F.col("service") == "b").collect()] == []
    assert [r.id for r in vector.top_k(v, "id", "v", [1.0, 0.0], 2, F.col("service") == "b", prefilter=True).collect()] == [2, 3]


def test_expansion_and_merge(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a"), ("a", "a")], "source string, target string")
    near = graph.expand_neighbors(calls, spark.createDataFrame([("a",)], "name string"), 2)
    assert rows(near, "name", "hop_distance") == [("b", 1), ("c", 2), ("x", 1)]
    hits = spark.createDataFrame([("c", 0.9), ("a", 0.95)], "name string, score double")
    assert [r.name for r in graph.merge_candidates(hits, near).orderBy("position").collect()] == ["a", "c", "b", "x"]
    assert rows(graph.edges_among(calls, hits.select("name").union(near.select("name"))), "source", "target") == [("a", "a"), ("a", "b"), ("b", "c"), ("x", "a")]


def test_folder_exists_is_no_plain_prefix(spark):
    f = spark.createDataFrame([("s", "src/app/a.py"), ("s", "top.py")], "service string, file_path string")
    want = spark.createDataFrame([("s", "src/"), ("s", "src/ap"), ("s", "src/app"), ("t", "src")], "service string, folder string")
    assert rows(graph.folder_exists(f, want), "folder") == [("src",), ("src/app",)]


def test_ranking_breaks_ties_by_order(spark):
    s = spark.createDataFrame([(i, "s1" if i % 2 else "s2", "EmailLog" if i < 8 else "Nothing", None, None) for i in range(12)], "ord int, service string, name string, docstring string, signature string")
    got = rank.rank_symbols(s, F.lit("logged emails"), "ord", per_service=2, total=3).collect()
    assert [(r.ord, r.overlap) for r in got] == [(0, 2), (2, 2), (1, 2)]
    hits = spark.createDataFrame([(1, "s", "f", 0.5), (2, "s", "f", 0.7), (3, "s", "f", 0.7)], "ord int, service string, function_qualified_name string, score double")
    assert [r.ord for r in rank.best_chunk(hits, "ord").collect()] == [2]


def test_upsert_keeps_absent_values(spark):
    old = spark.createDataFrame([("k1", "a", "x"), ("k2", "b", "y")], "id string, p string, q string")
    new = spark.createDataFrame([("k1", "A"), ("k3", "c")], "id string, p string")
    assert rows(maintain.upsert(old, new, ["id"]), "id", "p", "q") == [("k1", "A", "x"), ("k2", "b", "y"), ("k3", "c", None)]


def test_diff_and_classify(spark):
    ddl = "service string, file_path string, blob_sha string"
    base = spark.createDataFrame([("s", "same.py", "1"), ("s", "edit.py", "2"), ("s", "old.py", "3"), ("s", "gone.py", "4")], ddl)
    head = spark.createDataFrame([("s", "same.py", "1"), ("s", "edit.py", "9"), ("s", "new.py", "3"), ("s", "note.css", "7")], ddl)
    feed = maintain.diff_snapshots(base, head)
    assert rows(feed, "file_path", "status", "previous_path") == [("edit.py", "modified", None), ("gone.py", "removed", None), ("new.py", "renamed", "old.py"), ("note.css", "added", None)]
    c = feed.join(head.withColumnRenamed("blob_sha", "sha"), ["service", "file_path"], "left")
    lang = F.when(F.col("file_path").endswith(".py"), "python")
    assert rows(maintain.classify_changes(c, base, lang), "file_path", "action") == [("edit.py", "reparse"), ("gone.py", "delete"), ("new.py", "relabel"), ("note.css", "record")]


def test_rename_keeps_qualified_names_and_prune_scopes(spark):
    r = spark.createDataFrame([("s", "a.py::f", "a.py"), ("t", "a.py::f", "a.py")], "service string, qualified_name string, file_path string")
    ren = spark.createDataFrame([("s", "a.py", "b.py")], "service string, old_path string, new_path string")
    assert rows(maintain.rename(r, ren), "service", "qualified_name", "file_path") == [("s", "a.py::f", "b.py"), ("t", "a.py::f", "a.py")]
    cur = spark.createDataFrame([("s", "c.py")], "service string, file_path string")
    assert rows(maintain.prune(r, cur, ["service", "file_path"]), "service") == [("t",)]


def test_verification_ladder(spark):
    files = spark.createDataFrame([("s", "src/a.py"), ("s", "src/sub/b.py"), ("s", "lib/b.py")], "service string, file_path string")
    sym = spark.createDataFrame([("s", "run", "src/a.py::run", "src/a.py"), ("s", "Box", "src/sub/b.py::Box", "src/sub/b.py"), ("s", "Box", "lib/b.py::Box", "lib/b.py"), ("s", "open", "lib/b.py::Box.open", "lib/b.py")], "service string, name string, qualified_name string, file_path string")
    cases = [
        (1, "src/a.py", "run()", "modify", "verified", "src/a.py"), (2, "wrong.py", "run", "modify", "corrected", "src/a.py"), (3, None, "run", "delete", "corrected", "src/a.py"), (4, None, "Box", "modify", "unverified", None), (5, "src/sub", "Box", "modify", "corrected", "src/sub/b.py"),
        (6, "src/new.py", "x", "create", "new", "src/new.py"), (7, "src", None, "create", "unverified", "src"), (8, None, None, "create", "unverified", None), (9, "far/away.py", None, "create", "unverified", "far/away.py"), (10, "src/a.py", "run.missing", "modify", "corrected", "src/a.py"), (11, "no.py", "nope", "modify", "unverified", "no.py"),
    ]
    ch = spark.createDataFrame([(c[0], "s", *c[1:4]) for c in cases], "change_id int, service string, file_path string, symbol string, change_type string")
    got = {r.change_id: (r.status, r.file_path) for r in verify.verify_changes(ch, files, sym).collect()}
    assert got == {c[0]: (c[4], c[5]) for c in cases}


def test_plans(spark):
    raw = [(1, '```json\n{"title":"t","services":[{"service":"s","changes":[{"file_path":"a|b","change_type":"modify"}]}],"open_questions":["q"]}\n```'), (2, "no json"), (3, None), (4, "[1]")]
    p = plan_doc.parse_plans(spark.createDataFrame(raw, "issue_id int, raw string"))
    got = {r.issue_id: r for r in p.collect()}
    assert [got[i].ok for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert got[1].plan.open_questions == ["summary was missing from the reply", "q"]
    text = plan_doc.render_markdown(p.where("ok")).first().text
    assert "| a\\|b |  | modify |  |" in text and "2. q" in text
    s = spark.createDataFrame([('[{"service":"a","summary":"x"},{"service":"","summary":"y"},{"summary":"z"}]',)], "r string").select(plan_doc.parse_summaries(F.col("r"))).first()[0]
    assert [x.service for x in s] == ["a"]
    c = spark.createDataFrame([("a]]>b",)], "t string").select(plan_doc.cdata(F.col("t")), plan_doc.xml_escaped(F.col("t"))).first()
    assert list(c) == ["<![CDATA[a]]]]><![CDATA[>b]]>", "a]]&gt;b"]


def test_manifests(spark):
    text = "# c\n\nbilling: acme/billing@main\nusers = acme/users\nbroken\nbilling: again/x\r\n"
    got = rows(manifest.parse_lines(spark.createDataFrame([(1, text)], "manifest_id int, text string")), "line_no", "name", "repo", "branch", "problem")
    assert got == [(3, "billing", "acme/billing", "main", None), (4, "users", "acme/users", None, None), (5, None, None, None, "malformed"), (6, "billing", "again/x", None, "duplicate")]
    y = manifest.load_yaml(spark, "services:\n- {name: a, repo: r}\n- {name: b, repo: q, branch: m}\n")
    assert rows(y, "name", "repo", "branch") == [("a", "r", None), ("b", "q", "m")]
    for bad in ("services: 3", "x: 1", "services: [1]", "services: [{name: a}]", "services: [{name: a, repo: r}, {name: a, repo: r}]", "a: [", ""):
        with pytest.raises(manifest.ManifestError):
            manifest.load_yaml(spark, bad)


def test_snapshots(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for p, c in (("src/a.py", b"x = 1"), ("node_modules/b.js", b"y"), ("readme.md", b"#"), ("big.py", b"x" * 60), ("s.css", b"z")):
        (tmp_path / p).write_bytes(c)
    out = snapshots.outcomes(snapshots.scan_folder(spark, str(tmp_path), "svc"), max_bytes=50)
    assert rows(out, "file_path", "outcome") == [("big.py", "oversized"), ("node_modules/b.js", "denied"), ("readme.md", "unsupported"), ("s.css", "tracked"), ("src/a.py", "parsed")]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("repo-1/a.py", "x")
        z.writestr("repo-1/d/b.py", "y")
    got = snapshots.unpack_zip(spark.createDataFrame([("s", bytearray(buf.getvalue()))], "service string, content binary"))
    assert rows(got, "file_path", "size_bytes") == [("a.py", 1), ("d/b.py", 1)]


def test_parsers(spark):
    avdl = b"protocol P { /* c; */ record R { string a; union {null, int} b = null; } enum E { X, Y } string hello(string who); }"
    bpmn = b'<definitions><process id="p1" name="Pay"><startEvent id="s"/><userTask id="t" name="Check"/></process></definitions>'
    gql = b"type Q {\n  user(id: ID!): User\n  all: [User]\n}"
    py = b"class A:\n    def m(self):\n        '''Doc.'''\n        def inner(): pass\n"
    f = [(1, "p.avdl", "avdl", avdl), (2, "p.bpmn", "bpmn", bpmn), (3, "q.graphqls", "graphql", gql), (4, "a.py", "python", py), (5, "bad.py", "python", b"def ("), (6, "x.py", "python", None), (7, "n.bpmn", "bpmn", b"<a>")]
    got = parse_symbols(spark.createDataFrame([(a, b, c, bytearray(d) if d is not None else None) for a, b, c, d in f], "file_id bigint, file_path string, language string, content binary"))
    names = {i: {r.qualified_name.split("::")[1] for r in got.where(f"file_id = {i}").collect()} for i in range(1, 8)}
    assert names[1] == {"P", "R", "R.a", "R.b", "E", "P.hello"}
    assert names[2] == {"Pay", "Pay.s", "Pay.Check"} and names[3] == {"Q", "Q.user", "Q.all"} and names[4] == {"A", "A.m", "inner"}
    assert not names[5] and not names[6] and not names[7]


def sighted(times, ttl):
    last, out = None, []
    for t in sorted(times):
        if last is None or (t - last).total_seconds() > ttl:
            last = t
            out.append(t)
    return out


def test_ttl_dedup_batch_and_stream(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    data = [("a", t0 + timedelta(seconds=s)) for s in (0, 100, 299, 300, 301, 500, 602, 5000)] + [("b", t0), ("b", t0), (None, t0)]
    df = spark.createDataFrame(data, "message_id string, at timestamp")
    want = sorted(("a", t) for t in sighted([t for k, t in data if k == "a"], 300)) + [("b", t0)]
    assert sorted(map(tuple, stream.ttl_dedup(df, "message_id", "at").collect())) == want
    df.where("message_id is not null").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = stream.ttl_dedup_stream(s, "message_id", "at").writeStream.format("memory").queryName("ttl").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("ttl").collect())) == want


def test_normalize_status_matrix(spark, tmp_path):
    now = datetime(2025, 1, 1)
    ts = str(int((now - datetime(1970, 1, 1)).total_seconds()))
    one = lambda c: spark.range(1).select(c).first()[0]
    chat = lambda body, at=ts: {"x-slack-request-timestamp": at, "x-slack-signature": one(hashing.chat_signature("k", F.lit(at), F.lit(body)))}
    msg, ping, click = json.dumps({"team_id": "T", "event": {"type": "message"}}), json.dumps({"type": "url_verification"}), json.dumps({"team": {"id": "T"}, "type": "block_actions"})
    lost, form = json.dumps({"team_id": "?", "event": {"type": "message"}}), "payload=" + quote(click)
    sms, url = "To=%2B1&From=whatsapp%3A%2B2&Body=&NumMedia=0", "https://x.test/sms"
    signed = base64.b64encode(hmac.new(b"t", (url + "BodyFromwhatsapp:+2NumMedia0To+1").encode(), "sha1").digest()).decode()
    late, j = str(int(ts) - 301), {"x-jira-webhook-secret": "j"}
    push = '{"ref":"x"}'
    host = {"x-hub-signature-256": "sha256=" + hmac.new(b"g", push.encode(), "sha256").hexdigest(), "x-github-event": "push"}
    reqs = [
        (1, "slack", chat(msg), msg, None), (2, "slack", chat("x"), msg, None), (3, "slack", chat(ping), ping, None), (4, "slack", chat(form), form, None), (5, "slack", chat(lost), lost, None), (6, "slack", chat("{"), "{", None), (7, "fax", {}, msg, None), (8, "twilio", {"x-twilio-signature": signed}, sms, None),
        (9, "jira", j, '{"webhookEvent":"comment_created"}', {"tenant_id": " t3 "}), (10, "jira", {"x-jira-webhook-secret": "no"}, "{}", None), (11, "github", {}, "{}", None), (12, None, None, None, None), (13, "slack", chat(msg, late), msg, None), (14, "twilio", {"x-twilio-signature": signed}, sms + "1", None),
        (15, "jira", j, "{}", {}), (16, "github", host | {"x-tenant-id": "t4"}, push, None), (17, "github", host, push, None), (18, "twilio", {"x-signature-valid": "true"}, sms, None), (19, "slack", chat("payload=%7B"), "payload=%7B", None),
    ]
    kinds = "request_id int, provider_slug string, headers map<string,string>, body string, query map<string,string>, is_base64 boolean, received_at timestamp"
    rows_of = [(a, b, c, base64.b64encode(x.encode()).decode() if x and a % 2 else x, q, bool(x and a % 2), now) for a, b, c, x, q in reqs]
    df = spark.createDataFrame(rows_of, kinds)
    routes = spark.createDataFrame([("slack", "T", "t1"), ("twilio", "+1", "t2"), ("jira", "AB", "no")], "event_source string, workspace_key string, tenant_id string")
    bad = lambda n: (n, "reject", None)
    want = {1: (200, "publish", "message.created"), 2: bad(401), 3: (200, "challenge", None), 4: (200, "forward", None), 5: (200, "drop", None), 6: bad(400), 7: bad(404), 8: (204, "publish", "whatsapp.received"), 9: (200, "publish", "issue.commented"), 10: bad(401), 11: bad(401), 12: bad(404)}
    want |= {13: bad(401), 14: bad(401), 15: bad(400), 16: (200, "publish", "push.received"), 17: bad(400), 18: bad(401), 19: (200, "drop", None)}
    secrets = {"slack": "k", "github": "g", "jira": "j", "twilio": "t"}
    assert {r.request_id: (r.status, r.route, r.event_type) for r in stream.normalize(df, routes, secrets, url).collect()} == want
    assert stream.normalize(df.where("request_id = 8"), routes, secrets).first().status == 401  # no address to verify
    df.write.parquet(f"{tmp_path}/req")
    s = stream.normalize(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/req"), routes, secrets, url)
    stream.publish_by_tenant(s.where("route = 'publish'"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "request_id", "tenant_id") == [(1, "t1"), (16, "t4"), (8, "t2"), (9, "t3")]


def test_sender_filter_and_ack(spark):
    m = spark.createDataFrame([(1, "A@ok.com "), (2, "bad@ok.com"), (3, "x@spam.com"), (4, ""), (5, None), (6, "y@else.com")], "id int, sender string")
    ids = lambda **k: [r.id for r in stream.sender_filter(m, "sender", ["bad@ok.com"], ["spam.com"], k.get("a", []), k.get("d", []), k.get("only", False)).orderBy("id").collect()]
    assert ids() == [1, 6] and ids(only=True, d=["ok.com"]) == [1] and ids(only=True) == [] and ids(only=True, a=["y@else.com"]) == [6]
    a = lambda b, i, e, k: spark.range(1).select(stream.ack_outcome(F.lit(b), F.lit(i), F.lit(e).cast("string"), k)).first()[0]
    assert [a(True, True, None, False), a(False, True, None, False), a(True, False, None, False), a(True, True, "auth", False), a(True, True, "net", False), a(False, True, None, True), a(True, True, "auth", True)] == ["acked", "dead_letter", "dead_letter", "dead_letter", "retry", "retry", "retry"]
