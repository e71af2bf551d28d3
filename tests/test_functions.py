"""Column functions on hand-made values."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from graphmill.functions import hashing, paths, payload, tokens
from graphmill.functions.proximity import refers, service_references


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("word,norm", [("policies", "policy"), ("logged", "log"), ("getting", "get"), ("emails", "email"), ("boxes", "box"), ("class", "class"), ("ing", "ing"), ("seeing", "see"), ("red", "red")])
def test_normalize(spark, word, norm):
    assert one(spark, word, tokens.normalize) == norm


def test_tokenize(spark):
    assert set(one(spark, "EmailLogRow sends HTTPMonitor2", tokens.tokenize)) == {"emaillogrow", "email", "log", "row", "sends", "send", "httpmonitor2", "http", "monitor", "2"}
    assert one(spark, None, tokens.tokenize) == []
    assert one(spark, "plain", tokens.tokenize) == ["plain"]


def test_overlap_of_glued_name_and_inflected_issue(spark):
    df = spark.createDataFrame([("EmailLogRow", "the emails were logged")], "a string, b string")
    assert df.select(tokens.overlap(tokens.tokenize(F.col("a")), tokens.tokenize(F.col("b")))).first()[0] == 2


@pytest.mark.parametrize(
    "f,value,want",
    [
        (paths.slug, "  Fix: Login fails!! ", "fix-login-fails"), (paths.slug, "###", "issue"), (paths.slug, "a" * 39 + "-b", "a" * 39), (paths.language_of, "a/B.PY", None), (paths.language_of, "x/page.HTML", "html"), (paths.language_of, "src/.py", None),
        (paths.dirname, "a/b/c.py", "a/b"), (paths.dirname, "c.py", ""), (paths.normal_symbol, " `a.py::Cls.run(x, y)` ", "Cls.run"), (paths.normal_path, "`./src/a.py`", "src/a.py"), (paths.normal_path, "``", None),
        (paths.without_line_range, "a.py:3-9", "a.py"), (paths.email_domain, "A@B.C ", "b.c"), (paths.email_domain, "none", None), (paths.address_of, "Ann <a@b.c>", "a@b.c"), (paths.queue_email, "A.b+c@d e", "a-b-c-d-e"), (paths.without_mentions, "<@U1> hi", "hi"),
        (payload.channel_of, "whatsapp:+1", "whatsapp"), (payload.channel_of, "+1", "sms"), (payload.bare_address, "rcs:+1", "+1"), (payload.rich_text, '{"content":[{"text":"a"},{"content":[{"text":"b"}]}]}', "ab"), (payload.fence_stripped, "```json\n{}\n```", "{}"),
        (payload.chat_event_type, "message", "message.created"), (payload.chat_event_type, "new_thing", "new_thing.received"), (payload.chat_event_type, None, "unknown.received"),
    ],
)
def test_values(spark, f, value, want):
    assert one(spark, value, f) == want


def test_event_types(spark):
    h = lambda e, a, m: spark.range(1).select(payload.host_event_type(F.lit(e), F.lit(a), F.lit(m))).first()[0]
    assert [h("pull_request", "closed", True), h("pull_request", "closed", False), h("push", None, None), h("issues", "opened", None), h("star", None, None)] == ["pull_request.merged", "pull_request.closed", "push.received", "issue.opened", "star.received"]
    t = lambda *a: spark.range(1).select(payload.tracker_event_type(*[F.lit(x) for x in a])).first()[0]
    assert [t("own", "x", None), t(None, "jira:issue_updated", "issue_workflow"), t(None, "jira:issue_updated", None), t(None, "comment_created", None), t(None, "", None)] == ["own", "issue.transitioned", "issue.updated", "issue.commented", "unknown.received"]


def test_forms_and_media(spark):
    m = one(spark, "Body=&From=%2B1&NumMedia=2&MediaUrl0=u%3D0&MediaUrl1=&Body=a+b", payload.form_fields)
    assert m == {"From": "+1", "NumMedia": "2", "MediaUrl0": "u=0", "MediaUrl1": "", "Body": "a b"}
    assert one(spark, m, payload.media_urls, "map<string,string>") == ["u=0"]
    assert one(spark, {"NumMedia": "0"}, payload.media_urls, "map<string,string>") == []


def test_payload_opened(spark):
    text = lambda v: payload.text_at(payload.opened(v), "$.a")
    assert [one(spark, x, text) for x in ('{"a":"b"}', json.dumps('{"a":"b"}'), "{", None)] == ["b", "b", None, None]


def test_hashes(spark):
    body = b"caf\xc3\xa9"
    assert one(spark, bytearray(body), hashing.blob_sha, "binary") == hashlib.sha1(b"blob 5\0" + body).hexdigest()
    for key in ("k", "long" * 40):
        assert one(spark, "text", lambda c: hashing.host_signature(key, c)) == "sha256=" + hmac.new(key.encode(), b"text", hashlib.sha256).hexdigest()
    assert one(spark, "A@b", hashing.email_hash) == hashlib.sha256(b"a@b").hexdigest()[:16]


def test_fit_bytes(spark):
    assert one(spark, "é" * 5, lambda c: paths.fit_bytes(c, 5)) == "éé"
    assert one(spark, "abc", lambda c: paths.fit_bytes(c, 5)) == "abc"


@pytest.mark.parametrize(
    "text,hit",
    [("url: billing", True), ("the billing service", False), ("security billing", False), ("https://billing:80/x", True), ("https://host/billing", False), ("billingx url", False), ("x-billing url", True), ("billing" + " " * 70 + "url", False)],
)
def test_references(spark, text, hit):
    df = spark.createDataFrame([(text, "billing")], "t string, n string")
    assert df.select(refers(F.col("t"), F.col("n"))).first()[0] is hit


def test_service_references(spark):
    t = spark.createDataFrame([("a", "f", "URL=http://my-svc/x and gateway other"), ("my-svc", "g", "url my-svc"), (None, "h", None)], "service string, file_path string, text string")
    s = spark.createDataFrame([("my-svc",), ("Other",), (None,)], "name string")
    assert sorted(map(tuple, service_references(t, s).collect())) == [("a", "f", "my-svc"), ("a", "f", "other")]
