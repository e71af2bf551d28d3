"""Queries of the request, mail, action and maintenance operators over the project's tables, with their SQL.

The tables hold parsed events; where an operator takes a raw request, form, notification or mail, the
query first writes one from an event's columns, hard rows (blank, broken, repeated, wrong) included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions import mail, payload, requests
from graphmill.operators import actions, maintain
from graphmill.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "canonical_events")


_IPAD, _OPAD = ("".join(f"\\x{b ^ p:02X}" for b in b"vendor-secret".ljust(64, b"\0")) for p in (0x36, 0x5C))
_URL = "'https://hooks.example.test/' || tenant_id || '?n=' || delivery_id"


@query(
    "ref_f19_vendor_signature",
    f"SELECT delivery_id, to_base64(unhex(sha1('{_OPAD}'::BLOB || unhex(sha1('{_IPAD}'::BLOB || encode({_URL} || 'Body' || coalesce(raw_payload, '') || 'From' || coalesce(actor.id, '') || 'To' || source_workspace_id)))))) AS signature FROM canonical_events WHERE event_source = 'twilio' AND tenant_id IS NOT NULL AND source_workspace_id IS NOT NULL",
)
def f19(s, d):
    e = events(s, d).where("event_source = 'twilio' and tenant_id is not null and source_workspace_id is not null")
    fields = F.create_map(F.lit("To"), F.col("source_workspace_id"), F.lit("From"), F.coalesce("actor.id", F.lit("")), F.lit("Body"), F.coalesce("raw_payload", F.lit("")))
    url = F.concat(F.lit("https://hooks.example.test/"), "tenant_id", F.lit("?n="), F.col("delivery_id").cast("string"))
    return e.select("delivery_id", requests.vendor_signature("vendor-secret", url, fields).alias("signature"))


@query("ref_f21_form", "SELECT delivery_id, coalesce(actor.display_name, '') AS first_name, 'a b&c' AS last_name, '' AS blank, 2 AS n_keys FROM canonical_events")
def f21(s, d):
    """A form with a repeated key: first and last value, and a blank one."""
    body = F.concat(F.lit("Name="), F.url_encode(F.coalesce("actor.display_name", F.lit(""))), F.lit("&Empty=&Name=a+b%26c&&"))
    e = events(s, d).select("delivery_id", payload.form_fields(body, first=True).alias("a"), payload.form_fields(body).alias("b"))
    return e.select("delivery_id", e.a["Name"].alias("first_name"), e.b["Name"].alias("last_name"), e.b["Empty"].alias("blank"), F.size("b").alias("n_keys"))


_JSON = "CASE WHEN json_valid(raw_payload) AND json_type(raw_payload) <> 'VARCHAR' THEN raw_payload END"


@query("ref_f22_form_json", f"SELECT delivery_id, json_extract_string(p, '$.type') AS kind, p IS NOT NULL AND p::VARCHAR <> '{{}}' AS filled FROM (SELECT delivery_id, {_JSON} AS p FROM canonical_events WHERE event_source = 'slack')")
def f22(s, d):
    """Interactions come as a form whose ``payload`` field holds JSON; broken ones count as empty."""
    e = events(s, d).where("event_source = 'slack'")
    inner = F.when(F.coalesce(F.schema_of_variant(F.try_parse_json("raw_payload")) != "STRING", F.lit(False)), F.col("raw_payload"))
    body = F.concat(F.lit("v=1&payload="), F.url_encode(F.coalesce(inner, F.lit("{broken"))))
    v = requests.form_json(body)
    return e.select("delivery_id", payload.text_at(v, "$.type").alias("kind"), (F.to_json(v) != "{}").alias("filled"))


@query("ref_f24_raw_body", "SELECT delivery_id, CASE WHEN delivery_id % 3 = 0 AND raw_payload IS NOT NULL AND delivery_id % 2 = 0 THEN NULL ELSE raw_payload END AS body FROM canonical_events")
def f24(s, d):
    """Every third body comes in base64, every sixth of a kind that can't be decoded."""
    third = F.col("delivery_id") % 3 == 0
    sent = F.when(third & (F.col("delivery_id") % 2 == 0) & F.col("raw_payload").isNotNull(), F.lit("%%%")).when(third, F.regexp_replace(F.base64(F.encode("raw_payload", "UTF-8")), r"\s", "")).otherwise(F.col("raw_payload"))
    return events(s, d).select("delivery_id", requests.raw_body(sent, third).alias("body"))


@query("ref_f31_issue_number", "SELECT delivery_id, coalesce(nullif(json_extract_string(p, '$.pull_request.number'), ''), nullif(json_extract_string(p, '$.issue.number'), '')) AS number FROM (SELECT delivery_id, CASE WHEN json_valid(p0) THEN p0 END AS p FROM (SELECT delivery_id, CASE WHEN json_valid(raw_payload) THEN CASE WHEN json_type(raw_payload) = 'VARCHAR' THEN json_extract_string(raw_payload, '$') ELSE raw_payload END END AS p0 FROM canonical_events WHERE event_source = 'github'))")
def f31(s, d):
    v = payload.opened(F.col("raw_payload"))
    return events(s, d).where("event_source = 'github'").select("delivery_id", requests.issue_number(v).alias("number"))


@query("ref_f32_merged", "SELECT tenant_id, event_source, max(tenant_name) AS name, 'tenant' AS mode, 'common' AS region, 3 AS n_keys FROM tenant_routes WHERE tenant_name IS NOT NULL GROUP BY 1, 2")
def f32(s, d):
    """Common settings overlaid by a tenant's own, without its token (J14, F32, P13)."""
    common = F.create_map(F.lit("mode"), F.lit("common"), F.lit("region"), F.lit("common"))
    r = table(s, d, "tenant_routes").where("tenant_name is not null").groupBy("tenant_id", "event_source").agg(F.max("tenant_name").alias("n"))
    own = F.create_map(F.lit("mode"), F.lit("tenant"), F.lit("name"), F.col("n"), F.lit("token"), F.lit("x"))
    m = r.select("tenant_id", "event_source", requests.without_keys(payload.merged_fields(common, own), "token").alias("m"))
    return m.select("tenant_id", "event_source", m.m["name"].alias("name"), m.m["mode"].alias("mode"), m.m["region"].alias("region"), F.size("m").alias("n_keys"))


@query("ref_f33_rich_text", "SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE text || chr(10) || '\"é\"' END AS plain FROM documents")
def f33(s, d):
    """Texts as leaves of a rich-text tree, read back."""
    leaf = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    tree = F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.array(leaf(F.col("text")), leaf(F.lit('\n"é"'))).alias("content"))).alias("content"))
    return table(s, d, "documents").select("doc_id", payload.rich_text(F.when(F.col("text").isNotNull(), F.to_json(tree))).alias("plain"))


@query("ref_f35_run_id", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '00000000-0000-4000-8000-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') END AS run_id FROM documents")
def f35(s, d):
    """Run ids written into a description; another key with the same ending is none."""
    number = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    key = F.when(F.col("doc_id") % 4 == 0, "agent_run_id").when(F.col("doc_id") % 4 == 1, "other_agent_run_id").otherwise("run")
    text = F.concat(F.lit("see "), key, F.lit("=00000000-0000-4000-8000-"), number, F.lit(" for more"))
    return table(s, d, "documents").select("doc_id", payload.run_id(text, "agent_run_id").alias("run_id"))


@query("ref_f36_broken_status", "SELECT delivery_id, coalesce(nullif(regexp_extract(b, '\"to_status\"\\s*:\\s*\"([^\"]+)\"', 1), ''), nullif(regexp_extract(b, '\"status\"\\s*:\\s*\\{\\s*\"name\"\\s*:\\s*\"([^\"]+)\"', 1), ''), '') AS status FROM (SELECT delivery_id, left(raw_payload, length(raw_payload) - 1) AS b FROM canonical_events WHERE event_source = 'jira' AND raw_payload IS NOT NULL)")
def f36(s, d):
    """Tracker bodies cut short by one character."""
    e = events(s, d).where("event_source = 'jira' and raw_payload is not null")
    return e.select("delivery_id", requests.status_from_broken(F.expr("left(raw_payload, length(raw_payload) - 1)")).alias("status"))


@query("ref_f39_mail_parts", "SELECT doc_id, text AS plain, CASE WHEN doc_id % 2 = 0 THEN '<p>' || doc_id || '</p>' END AS html, doc_id % 3 AS attachments FROM documents WHERE text <> ''")
def f39(s, d):
    """Documents as mails: text and HTML in a nested part, up to two attachments."""
    code = lambda c: F.translate(F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\s=]", ""), "+/", "-_")
    part = lambda kind, c: F.to_json(F.struct(F.lit(kind).alias("mimeType"), F.struct(code(c).alias("data")).alias("body")))
    files = F.array_join(F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda i: i <= F.col("doc_id") % 3), lambda i: F.concat(F.lit(',{"filename":"f'), i.cast("string"), F.lit('","body":{"attachmentId":"a"}}'))), "")
    html = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(","), part("text/html", F.concat(F.lit("<p>"), F.col("doc_id").cast("string"), F.lit("</p>"))))).otherwise("")
    tree = F.concat(F.lit('{"mimeType":"multipart/mixed","parts":[{"parts":['), part("text/plain", F.col("text")), html, F.lit("]}"), files, F.lit("]}"))
    p = table(s, d, "documents").where("text <> ''").select("doc_id", mail.mail_parts(tree).alias("p"))
    return p.select("doc_id", "p.plain", "p.html", F.size("p.attachments").cast("bigint").alias("attachments"))


@query("ref_f58_request_url", "SELECT tenant_id, workspace_key, CASE WHEN length(workspace_key) % 2 = 0 THEN 'http' ELSE 'https' END || '://hooks.example.test/' || event_source || CASE WHEN tenant_name IS NULL THEN '' ELSE '?name=' || replace(tenant_name, ' ', '%20') END AS url FROM tenant_routes")
def f58(s, d):
    scheme = F.when(F.length("workspace_key") % 2 == 0, "http")
    url = requests.request_url(scheme, F.lit("hooks.example.test"), F.concat(F.lit("/"), "event_source"), F.concat(F.lit("name="), "tenant_name"))
    return table(s, d, "tenant_routes").select("tenant_id", "workspace_key", url.alias("url"))


@query("ref_t13_query_orders", "WITH p AS (SELECT name, unnest(['n=' || name, 't=' || team, 'r=' || repo]) AS p FROM services) SELECT a.name, a.p || '&' || b.p || '&' || c.p AS query FROM p a JOIN p b ON a.name = b.name AND a.p <> b.p JOIN p c ON a.name = c.name AND c.p <> a.p AND c.p <> b.p")
def t13(s, d):
    pairs = F.array(*[F.concat(F.lit(f"{k}="), F.col(c)) for k, c in (("n", "name"), ("t", "team"), ("r", "repo"))])
    return table(s, d, "services").select("name", F.explode(requests.query_orders(pairs)).alias("query"))


@query("ref_f57_stream_reply", "SELECT name, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<Response>' || chr(10) || '    <Connect>' || chr(10) || '        <Stream url=\"wss://' || repo || '\">' || chr(10) || '            <Parameter name=\"auth_token\" value=\"' || name || '\"/>' || chr(10) || '        </Stream>' || chr(10) || '    </Connect>' || chr(10) || '</Response>' AS reply FROM services")
def f57(s, d):
    return table(s, d, "services").select("name", requests.stream_reply(F.concat(F.lit("wss://"), "repo"), F.col("name")).alias("reply"))


@query("ref_f60_notification", "SELECT delivery_id, CASE WHEN raw_payload IS NULL THEN 'none' WHEN json_valid(raw_payload) THEN 'json' ELSE 'raw' END AS kind, CASE WHEN json_valid(raw_payload) THEN raw_payload ELSE raw_payload END AS text FROM canonical_events")
def f60(s, d):
    """Notifications in base64: JSON as it stands, other text wrapped, none for none."""
    n = requests.notification(F.regexp_replace(F.base64(F.encode("raw_payload", "UTF-8")), r"\s", ""))
    wrapped = ~F.try_parse_json("raw_payload").isNotNull()
    kind = F.when(n.isNull(), "none").when(wrapped, "raw").otherwise("json")
    return events(s, d).select("delivery_id", kind.alias("kind"), F.when(wrapped, F.get_json_object(n, "$.raw")).otherwise(n).alias("text"))


@query("ref_f59_setting_map", "SELECT name, CASE WHEN length(name) % 3 = 0 THEN repo END AS repo, CASE WHEN length(name) % 3 = 0 THEN 1 ELSE 0 END AS entries FROM services")
def f59(s, d):
    """Settings that are objects, arrays and no JSON."""
    n = F.length("name") % 3
    value = F.when(n == 0, F.to_json(F.struct(F.col("repo").alias("repo")))).when(n == 1, '["x"]').otherwise("{repo")
    m = table(s, d, "services").select("name", requests.setting_map(value).alias("m"))
    return m.select("name", F.try_element_at("m", F.lit("repo")).alias("repo"), F.size("m").alias("entries"))


@query("ref_p11_may_retry", "SELECT s AS status, NOT (s >= 400 AND s < 500 AND s <> 429) AS retry FROM (SELECT CAST(unnest(generate_series(100, 599)) AS BIGINT) AS s)")
def p11(s, d):
    return s.range(100, 600).select(F.col("id").alias("status"), requests.may_retry(F.col("id")).alias("retry"))


@query("ref_s15_new_message", "SELECT delivery_id, CASE delivery_id % 4 WHEN 0 THEN 'b' || delivery_id WHEN 1 THEN 'latest' WHEN 2 THEN 'c' ELSE 'latest' END AS message_id FROM canonical_events")
def s15(s, d):
    """Histories whose first record added nothing, two messages, or that hold none or are broken."""
    kind = F.col("delivery_id") % 4
    add = lambda *ids: F.concat(F.lit('{"messagesAdded":['), F.concat_ws(",", *[F.concat(F.lit('{"message":{"id":"'), i, F.lit('"}}')) for i in ids]), F.lit("]}"))
    body = F.when(kind == 0, F.concat(F.lit('[{"id":"1"},'), add(F.lit("a"), F.concat(F.lit("b"), F.col("delivery_id").cast("string"))), F.lit(","), add(F.lit("z")), F.lit("]"))).when(kind == 1, "[]").when(kind == 2, F.concat(F.lit("["), add(F.lit("c")), F.lit("]"))).otherwise("[{")
    return events(s, d).select("delivery_id", mail.new_message_id(body, F.lit("latest")).alias("message_id"))


@query("ref_k16_tenant_messages", "SELECT delivery_id, 'prod-' || tenant_id || '-events' AS queue, event_source AS provider FROM canonical_events WHERE tenant_id IS NOT NULL")
def k16(s, d):
    e = events(s, d).select("delivery_id", "tenant_id", F.col("event_source").alias("provider_slug"))
    m = actions.tenant_messages(e, "{env}-{tenant}-events", "prod")
    return m.select("delivery_id", "queue", m.attributes["provider_slug"].alias("provider"))


@query("ref_k17_mail_attributes", "SELECT delivery_id, actor.email AS email, 'gmail' AS source, CAST(CAST(floor(epoch(arrived_at)) AS BIGINT) AS VARCHAR) AS seconds, tenant_id AS tenant, 4 AS n FROM canonical_events")
def k17(s, d):
    m = events(s, d).select("delivery_id", actions.mail_attributes(F.col("actor.email"), F.col("tenant_id"), F.col("arrived_at").cast("timestamp")).alias("m"))
    return m.select("delivery_id", m.m["Email"].alias("email"), m.m["Source"].alias("source"), m.m["Timestamp"].alias("seconds"), m.m["Tenant"].alias("tenant"), F.size("m").alias("n"))


@query("ref_k12_document_key", "SELECT name, 'technical_designs/20250102T030405Z_' || name || '.pdf' AS document_key, 'attachments/' || repo AS attachment_key FROM services")
def k12(s, d):
    at = F.lit("2025-01-02 03:04:05").cast("timestamp")
    return table(s, d, "services").select("name", actions.document_key(at, F.initcap(F.replace("name", F.lit("-"), F.lit(" -! ")))).alias("document_key"), actions.attachment_key(F.col("repo")).alias("attachment_key"))


@query("ref_j15_agent_runs", "SELECT delivery_id, event_type AS event_name, 'agent-' || length(event_type) AS agent_name FROM canonical_events WHERE event_type IN (SELECT event_type FROM canonical_events GROUP BY 1 HAVING count(*) > 5)")
def j15(s, d):
    e = events(s, d).select("delivery_id", F.col("event_type").alias("event_name"))
    frequent = e.groupBy("event_name").count().where("count > 5").select("event_name", F.concat(F.lit("agent-"), F.length("event_name").cast("string")).alias("agent_name"))
    return actions.agent_runs(e, frequent.unionByName(frequent)).select("delivery_id", "event_name", "agent_name")


@query("ref_k20_mailbox", "SELECT delivery_id AS message_id, 'Processed' AS added, 'UNREAD,INBOX' AS removed FROM canonical_events")
def k20(s, d):
    m = actions.mailbox_actions(events(s, d).select(F.col("delivery_id").alias("message_id")), "Processed", archive=True)
    return m.select("message_id", F.array_join("add_labels", ",").alias("added"), F.array_join("remove_labels", ",").alias("removed"))


_PROVIDER = "CASE WHEN provider_event_id IS NULL OR trim(provider_event_id) = '' THEN NULL ELSE provider_event_id END"


@query("ref_x9_skip_reasons", f"SELECT delivery_id AS notification_id, CASE WHEN NOT json_valid(raw_payload) OR raw_payload IS NULL THEN 'bad_state' WHEN delivery_id % 7 = 0 THEN 'secret' WHEN actor.email IS NULL OR actor.email = '' THEN 'no_message' WHEN delivery_id % 5 = 0 THEN 'fetch_failed' WHEN delivery_id % 11 = 0 THEN 'self_sent' WHEN delivery_id % 13 = 0 THEN 'other_sender' END AS skip_reason FROM canonical_events")
def x9(s, d):
    """Notifications with each fault; every message has an id of its own, repeats are in a test."""
    i = F.col("delivery_id")
    secret = "a-secret-longer-than-twenty-characters"
    e = events(s, d).select(
        i.alias("notification_id"), F.try_parse_json("raw_payload").isNotNull().alias("state_ok"), F.when(i % 7 == 0, "wrong").otherwise(secret[:20]).alias("secret"), F.lit(secret).alias("expected_secret"),
        F.when(F.coalesce("actor.email", F.lit("")) != "", i.cast("string")).alias("message_id"), F.col("arrived_at").alias("at"), (i % 5 != 0).alias("fetched"), F.when(i % 11 == 0, "Own@x.test").otherwise("a@b.test").alias("sender"),
        F.lit("own@X.test").alias("own_address"), F.when(i % 13 == 0, "feedfeedfeedfeed").alias("sender_hash"),
    )
    return actions.skip_reasons(e)


@query("ref_x10_cached_reads", "WITH RECURSIVE r AS (SELECT tenant_id AS tk, arrived_at AS ta, delivery_id AS read_id, row_number() OVER (PARTITION BY tenant_id ORDER BY arrived_at, delivery_id) AS n FROM canonical_events WHERE tenant_id IS NOT NULL), f AS (SELECT tk, n, read_id, ta AS loaded, read_id AS by_read, 'store' AS source FROM r WHERE n = 1 UNION ALL SELECT r.tk, r.n, r.read_id, CASE WHEN r.ta - f.loaded <= INTERVAL 300 SECOND THEN f.loaded ELSE r.ta END, CASE WHEN r.ta - f.loaded <= INTERVAL 300 SECOND THEN f.by_read ELSE r.read_id END, CASE WHEN r.ta - f.loaded <= INTERVAL 300 SECOND THEN 'cache' ELSE 'store' END FROM f JOIN r ON r.tk = f.tk AND r.n = f.n + 1) SELECT read_id, 'v' || by_read AS answer, source FROM f")
def x10(s, d):
    """A tenant's settings read at each delivery, five minutes at most from the cache."""
    e = events(s, d).where("tenant_id is not null")
    return actions.cached_reads(e.select(F.col("tenant_id").alias("key"), F.col("arrived_at").alias("at"), F.col("delivery_id").alias("read_id"), F.concat(F.lit("v"), F.col("delivery_id").cast("string")).alias("value"), F.lit(False).alias("failed")))


@query("ref_x11_token_expiry", "SELECT delivery_id, date_trunc('second', arrived_at) + to_seconds(greatest(0, (delivery_id % 50) * 60 - 5)) AS expires FROM canonical_events WHERE arrived_at IS NOT NULL")
def x11(s, d):
    e = events(s, d).where("arrived_at is not null")
    return e.select("delivery_id", actions.token_expiry(F.col("arrived_at").cast("timestamp"), F.col("delivery_id") % 50 * 60).cast("timestamp_ntz").alias("expires"))


@query("ref_k6_commit_state", "SELECT service, arg_max(commit_sha, (ingested_at, commit_sha)) AS commit_sha, CAST(NULL AS VARCHAR) AS fingerprint FROM repo_graphs WHERE ingested_at IS NOT NULL GROUP BY 1")
def k6(s, d):
    """The state table after each run wrote its commit over an older state with a fingerprint."""
    runs = table(s, d, "repo_graphs").where("ingested_at is not null")
    last = runs.groupBy("service").agg(F.max(F.struct("ingested_at", "commit_sha")).alias("r")).select("service", "r.commit_sha", F.col("r.ingested_at").alias("at"))
    old = table(s, d, "repo_graphs").select("service").distinct().select("service", F.lit("old").alias("commit_sha"), F.lit(None).cast("string").alias("committed_at"), F.lit("f").alias("fingerprint"))
    return maintain.commit_state(old, last).select("service", "commit_sha", "fingerprint")


@query("ref_p9_in_scope", "SELECT name FROM services WHERE lower(name) IN ('harbor-ledger', 'opal-search')")
def p9(s, d):
    return maintain.in_scope(table(s, d, "services"), ["Harbor-Ledger", "OPAL-SEARCH", "unknown"]).select("name")


@query("ref_p2_symbols", "SELECT kind, service, qualified_name FROM parsed_symbols WHERE service IN ('harbor-ledger', 'opal-search') AND kind IN ('class', 'function')")
def p2(s, d):
    t = table(s, d, "parsed_symbols")
    out = maintain.symbols_of(t.where("kind = 'class'").drop("kind"), t.where("kind = 'function'").drop("kind", "parent_class"), ["harbor-ledger", "opal-search"])
    assert "source_snippet" not in out.columns
    return out.select("kind", "service", "qualified_name")


@query("ref_a3_references", "SELECT service, string_agg(DISTINCT language, ',' ORDER BY language) AS refs FROM source_files WHERE language IS NOT NULL GROUP BY 1")
def a3(s, d):
    f = table(s, d, "source_files").groupBy("service", "commit_sha").agg(F.collect_set("language").alias("references"))
    return maintain.service_references(f).select("service", F.array_join("references", ",").alias("refs"))


@query("ref_a15_missing", "SELECT name FROM services WHERE summary IS NULL")
def a15(s, d):
    t = table(s, d, "services")
    return maintain.missing_keys(t.select("name"), t.where("summary is not null").select("name"), "name")


@query("ref_k5_retired_columns", "SELECT name, repo, team FROM services")
def k5(s, d):
    t = table(s, d, "services")
    return maintain.retire(maintain.upsert(t, t.select("name", "repo"), ["name"]), ["branch", "summary", "never_there"])


@query("ref_d7_file_rows", "WITH t AS (SELECT service, commit_sha, unnest(map_entries(tracked_files)) AS e FROM repo_graphs), l AS (SELECT service, commit_sha, file_path, min(language) AS language FROM parsed_symbols GROUP BY ALL), a AS (SELECT service, commit_sha, file_path, language FROM l UNION ALL SELECT service, commit_sha, e.key, e.value FROM t WHERE (service, commit_sha, e.key) NOT IN (SELECT service, commit_sha, file_path FROM l)) SELECT a.service, a.commit_sha, a.file_path, a.language, f.blob_sha FROM (SELECT DISTINCT * FROM a) a LEFT JOIN source_files f USING (service, commit_sha, file_path)")
def d7(s, d):
    symbols, runs, files = (table(s, d, n) for n in ("parsed_symbols", "repo_graphs", "source_files"))
    key = ["service", "commit_sha"]
    tracked = runs.select(*key, F.explode("tracked_files").alias("file_path", "language"))
    return maintain.file_rows(symbols, tracked, files.select(*key, "file_path", "blob_sha"), key)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
