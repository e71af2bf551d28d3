"""Queries of the retrieval and event operators over the project's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.functions import hashing, paths, payload, requests, tokens
from graphmill.functions.proximity import service_references
from graphmill.operators import digest, graph, ingest, maintain, plan_doc, rank, vector, verify
from graphmill.operators.redelivery import instant, provider_id
from graphmill.parse.symbols import parse_symbols
from graphmill.session import table
from graphmill.sources import manifest, snapshots
from graphmill.streaming import events as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- shared inputs


def services(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "services")


def calls(s: SparkSession, d: str) -> DataFrame:
    """Service calls as the summaries tell them, unknown targets left out."""
    t = services(s, d).select(F.col("name").alias("source"), F.regexp_extract("summary", "hands it to ([a-z0-9-]+)", 1).alias("target"))
    return t.join(services(s, d).select(F.col("name").alias("target")), "target", "left_semi").select("source", "target").distinct()


CALLS = "calls AS (SELECT DISTINCT name AS source, regexp_extract(summary, 'hands it to ([a-z0-9-]+)', 1) AS target FROM services WHERE regexp_extract(summary, 'hands it to ([a-z0-9-]+)', 1) IN (SELECT name FROM services))"


def latest_symbols(s: SparkSession, d: str) -> DataFrame:
    """The last ingested row of each symbol (the last of a key wins)."""
    w = Window.partitionBy("service", "qualified_name").orderBy(F.desc("symbol_id"))
    return table(s, d, "parsed_symbols").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service, qualified_name ORDER BY symbol_id DESC) AS rn FROM parsed_symbols) WHERE rn = 1)"


def usable_chunks(s: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    squares = F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)
    return table(s, d, "chunks").where((F.size(e) == 64) & (squares > 0) & ~F.isnan(squares))


USABLE = "usable AS MATERIALIZED (SELECT * FROM chunks WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0 AND NOT isnan(list_sum(list_transform(embedding, lambda x: x * x))))"
PROBE = "probe AS (SELECT embedding AS q FROM usable ORDER BY chunk_id LIMIT 1)"


def probe(s: SparkSession, d: str) -> list[float]:
    """The query vector: that of the smallest usable chunk (one row)."""
    return usable_chunks(s, d).orderBy("chunk_id").select("embedding").first()[0]


def issue(s: SparkSession, d: str) -> str:
    """The issue text: the first issue among the documents (one row)."""
    return table(s, d, "documents").where((F.lower(F.trim("source")) == "issue") & (F.length("text") > 0)).orderBy("doc_id").select("text").first()[0]


ISSUE = "issue AS (SELECT text AS issue FROM documents WHERE lower(trim(source)) = 'issue' AND length(text) > 0 ORDER BY doc_id LIMIT 1)"


def sql_norm(w: str) -> str:
    def stem(x: str) -> str:
        return f"CASE WHEN length({x}) > 2 AND right({x}, 1) = left(right({x}, 2), 1) AND contains('bcdfghjklmnpqrstvwxyz', right({x}, 1)) THEN left({x}, length({x}) - 1) ELSE {x} END"

    cut = lambda k: f"left({w}, length({w}) - {k})"
    return (
        f"CASE WHEN length({w}) > 4 AND ends_with({w}, 'ies') THEN {cut(3)} || 'y' WHEN length({w}) > 4 AND ends_with({w}, 'ing') THEN {stem(cut(3))} "
        f"WHEN length({w}) > 4 AND ends_with({w}, 'ed') THEN {stem(cut(2))} WHEN length({w}) > 3 AND ends_with({w}, 'es') THEN {cut(2)} "
        f"WHEN length({w}) > 3 AND ends_with({w}, 's') AND NOT ends_with({w}, 'ss') THEN {cut(1)} ELSE {w} END"
    )


def sql_tokens(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in ``name(key, token)``."""
    split = f"string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(run, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), ' ')"
    return (
        f"{name}_r AS (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z0-9]+')) AS run FROM {source}), "
        f"{name}_p AS (SELECT {key}, {split} AS parts FROM {name}_r), "
        f"{name}_w AS (SELECT {key}, lower(run) AS w FROM {name}_r UNION SELECT {key}, lower(unnest(parts)) FROM {name}_p WHERE len(parts) > 1), "
        f"{name} AS (SELECT {key}, w AS token FROM {name}_w UNION SELECT {key}, {sql_norm('w')} FROM {name}_w)"
    )


# ---------------------------------------------------------------- text functions


@query("ref_f1_normalize", f"WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(docstring, '[A-Za-z0-9]+'))) AS word FROM parsed_symbols) SELECT word, {sql_norm('word')} AS norm FROM w")
def f1(s, d):
    w = table(s, d, "parsed_symbols").select(F.explode(F.regexp_extract_all("docstring", F.lit("([A-Za-z0-9]+)"), 1)).alias("word")).select(F.lower("word").alias("word")).distinct()
    return w.select("word", tokens.normalize(F.col("word")).alias("norm"))


@query("ref_f2_tokenize", f"WITH n AS (SELECT DISTINCT name FROM parsed_symbols), {sql_tokens('t', 'n', 'name', 'name')} SELECT name, token FROM t")
def f2(s, d):
    return table(s, d, "parsed_symbols").select("name").distinct().select("name", F.explode(tokens.tokenize(F.col("name"))).alias("token"))


@query(
    "ref_w1_rank_symbols",
    f"WITH {LATEST}, {ISSUE}, x AS (SELECT symbol_id, service, concat(coalesce(name, ''), ' ', coalesce(docstring, ''), ' ', coalesce(signature, '')) AS txt FROM latest), {sql_tokens('st', 'x', 'symbol_id', 'txt')}, {sql_tokens('it', 'issue', '1 AS one', 'issue').replace('SELECT 1 AS one, ', 'SELECT 1 AS one, ')}, "
    "o AS (SELECT st.symbol_id, count(*) AS overlap FROM st JOIN it ON st.token = it.token GROUP BY 1), r AS (SELECT l.service, l.symbol_id, o.overlap, row_number() OVER (PARTITION BY l.service ORDER BY o.overlap DESC, l.symbol_id) AS rank FROM latest l JOIN o USING (symbol_id)), "
    "f AS (SELECT service, min(symbol_id) AS sf FROM r GROUP BY 1) SELECT r.service, symbol_id, overlap, rank FROM r JOIN f USING (service) WHERE rank <= 5 ORDER BY overlap DESC, sf, symbol_id LIMIT 40",
)
def w1(s, d):
    return rank.rank_symbols(latest_symbols(s, d), F.lit(issue(s, d)), "symbol_id").select("service", "symbol_id", "overlap", "rank")


@query("ref_f7_qualified_name", "SELECT symbol_id, CASE WHEN parent_class IS NULL THEN file_path || '::' || name ELSE file_path || '::' || split_part(parent_class, '::', 2) || '.' || name END AS built FROM parsed_symbols")
def f7(s, d):
    return table(s, d, "parsed_symbols").select("symbol_id", paths.qualified_name(F.col("file_path"), F.col("name"), F.col("parent_class")).alias("built"))


@query("ref_f8_chunk_key", "SELECT chunk_id, function_qualified_name || '::chunk' || chunk_index AS built FROM chunks")
def f8(s, d):
    return table(s, d, "chunks").select("chunk_id", paths.chunk_name(F.col("function_qualified_name"), F.col("chunk_index")).alias("built"))


_LANG = "CASE " + " ".join(f"WHEN regexp_extract(file_path, '(?:^|/)[^/]+(\\.[^./]+)$', 1) = '{k}' THEN '{v}'" for k, v in paths.PARSED.items()) + " " + " ".join(f"WHEN lower(regexp_extract(file_path, '(?:^|/)[^/]+(\\.[^./]+)$', 1)) = '{k}' THEN '{v}'" for k, v in paths.TRACKED.items()) + " END"
_DENIED = "len(list_intersect(list_slice(string_split(file_path, '/'), 1, -2), [" + ", ".join(f"'{x}'" for x in paths.DENIED) + "])) > 0"


@query("ref_f10_language", f"SELECT file_id, {_LANG} AS by_suffix FROM source_files")
def f10(s, d):
    return table(s, d, "source_files").select("file_id", paths.language_of(F.col("file_path")).alias("by_suffix"))


@query(
    "ref_s3_outcomes",
    f"WITH o AS (SELECT service, CASE WHEN {_DENIED} THEN 'denied' WHEN {_LANG} IN ('html', 'css', 'csv') THEN 'tracked' WHEN {_LANG} IS NULL THEN 'unsupported' WHEN size_bytes > 2000000 THEN 'oversized' WHEN content IS NULL THEN 'failed' ELSE 'parsed' END AS outcome FROM source_files) SELECT service, outcome, count(*) AS files FROM o GROUP BY 1, 2",
)
def s3(s, d):
    return snapshots.outcomes(table(s, d, "source_files")).groupBy("service", "outcome").agg(F.count("*").alias("files"))


@query("ref_f13_slug", "SELECT doc_id, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), '-+$', ''), ''), 'issue') AS slug FROM documents")
def f13(s, d):
    return table(s, d, "documents").select("doc_id", paths.slug(F.col("text")).alias("slug"))


@query("ref_f14_blob_sha", "SELECT file_id, sha1(encode('blob ' || octet_length(content)) || '\\x00'::BLOB || content) AS sha FROM source_files WHERE content IS NOT NULL")
def f14(s, d):
    return table(s, d, "source_files").where("content is not null").select("file_id", hashing.blob_sha(F.col("content")).alias("sha"))


_KEY = b"graphmill-test-key"
_PADS = ["".join(f"\\x{b ^ p:02X}" for b in _KEY.ljust(64, b"\0")) for p in (0x36, 0x5C)]


@query("ref_f15_hmac", f"SELECT delivery_id, 'sha256=' || sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(raw_payload)))) AS signature FROM canonical_events WHERE raw_payload IS NOT NULL")
def f15(s, d):
    return table(s, d, "canonical_events").where("raw_payload is not null").select("delivery_id", hashing.host_signature(_KEY.decode(), F.col("raw_payload")).alias("signature"))


@query("ref_f17_email_hash", "SELECT delivery_id, left(sha256(lower(actor.email)), 16) AS email_hash, nullif(trim(lower(split_part(actor.email, '@', 2))), '') AS domain FROM canonical_events WHERE actor.email IS NOT NULL")
def f17(s, d):
    e = F.col("actor.email")
    return table(s, d, "canonical_events").where(e.isNotNull()).select("delivery_id", hashing.email_hash(e).alias("email_hash"), paths.email_domain(e).alias("domain"))


@query("ref_f41_queue_name", "SELECT DISTINCT actor.email AS email, left('prod-mail-' || left(regexp_replace(lower(actor.email), '[^\\p{L}\\p{N}_-]', '-', 'g'), 64), 80) AS queue FROM canonical_events WHERE actor.email IS NOT NULL")
def f41(s, d):
    e = F.col("actor.email")
    return table(s, d, "canonical_events").where(e.isNotNull()).select(e.alias("email"), paths.queue_name("{environment}-mail-{email}", "prod", e).alias("queue")).distinct()


@query("ref_f42_secret_variable", "SELECT tenant_id, workspace_key, 'LAMBDA_WEBHOOK_' || regexp_replace(upper(tenant_name), '[^\\p{L}\\p{N}]', '_', 'g') || '_SECRETS_ARN' AS variable FROM tenant_routes WHERE tenant_name IS NOT NULL")
def f42(s, d):
    return table(s, d, "tenant_routes").where("tenant_name is not null").select("tenant_id", "workspace_key", paths.secret_variable(F.col("tenant_name")).alias("variable"))


@query("ref_f43_mentions", "SELECT doc_id, trim(regexp_replace(text, '<@[^>]+>', '', 'g')) AS said FROM documents WHERE text IS NOT NULL")
def f43(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", paths.without_mentions(F.col("text")).alias("said"))


@query(
    "ref_f45_normal_names",
    "WITH x AS (SELECT DISTINCT file_path, name, line_start, line_end FROM parsed_symbols) SELECT file_path, name, regexp_replace(file_path || ':' || line_start || '-' || line_end, ':[0-9]+-[0-9]+$', '') AS ranged, "
    "list_extract(string_split(regexp_replace('x::' || name || '(a, b)', '\\(.*\\)$', ''), '::'), -1) AS symbol, nullif(regexp_replace(regexp_replace('./' || file_path, '^\\./', ''), '^/+', ''), '') AS path, regexp_replace(file_path, '/?[^/]*$', '') AS folder, count(*) AS n FROM x GROUP BY ALL",
)
def f45(s, d):
    x = table(s, d, "parsed_symbols").select("file_path", "name", "line_start", "line_end").distinct()
    ranged = F.concat("file_path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    x = x.select("file_path", "name", paths.without_line_range(ranged).alias("ranged"), paths.normal_symbol(F.concat(F.lit(" `x::"), "name", F.lit("(a, b)` "))).alias("symbol"), paths.normal_path(F.concat(F.lit(" `./"), "file_path", F.lit("` "))).alias("path"), paths.dirname(F.col("file_path")).alias("folder"))
    return x.groupBy("file_path", "name", "ranged", "symbol", "path", "folder").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- vectors and graph

_SCORED = "scored AS (SELECT *, round(list_cosine_similarity(embedding, (SELECT q FROM probe)), 6) AS score FROM usable)"


@query("ref_t1_vector_topk", "WITH p AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT q::DOUBLE[] FROM p)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def t1(s, d):
    e = table(s, d, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first()[0]
    return vector.top_k(e, "vec_id", "embedding", q, 10).select("vec_id", "score")


def _first_services(s, d):
    """Three services to scope to: the first by name."""
    return [r[0] for r in services(s, d).orderBy("name").limit(3).collect()]


_SCOPE = "(SELECT name FROM services ORDER BY name LIMIT 3)"


@query("ref_t2_chunk_topk_postfilter", f"WITH {USABLE}, {PROBE}, {_SCORED}, k AS (SELECT chunk_id, service, function_qualified_name, score FROM scored ORDER BY score DESC, chunk_id LIMIT 50) SELECT * FROM k WHERE service IN {_SCOPE}")
def t2(s, d):
    return vector.top_k(usable_chunks(s, d), "chunk_id", "embedding", probe(s, d), 50, F.col("service").isin(_first_services(s, d))).select("chunk_id", "service", "function_qualified_name", "score")


@query("ref_t2_chunk_topk_prefilter", f"WITH {USABLE}, {PROBE}, {_SCORED} SELECT chunk_id, service, function_qualified_name, score FROM scored WHERE service IN {_SCOPE} ORDER BY score DESC, chunk_id LIMIT 50")
def t2b(s, d):
    return vector.top_k(usable_chunks(s, d), "chunk_id", "embedding", probe(s, d), 50, F.col("service").isin(_first_services(s, d)), prefilter=True).select("chunk_id", "service", "function_qualified_name", "score")


def _scored(s, d):
    q = F.array(*[F.lit(float(x)) for x in probe(s, d)])
    return usable_chunks(s, d).withColumn("score", F.round(vector.cosine(F.col("embedding"), q), 6))


_BEST = "best AS (SELECT chunk_id, service, function_qualified_name, score FROM (SELECT *, row_number() OVER (PARTITION BY service, function_qualified_name ORDER BY score DESC, chunk_id) AS n FROM scored) WHERE n = 1)"


@query("ref_a2_best_chunk", f"WITH {USABLE}, {PROBE}, {_SCORED}, {_BEST} SELECT * FROM best")
def a2(s, d):
    return rank.best_chunk(_scored(s, d), "chunk_id").select("chunk_id", "service", "function_qualified_name", "score")


@query("ref_w2_rank_functions", f"WITH {USABLE}, {PROBE}, {_SCORED}, {_BEST}, r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY score DESC, chunk_id) AS rank FROM best), f AS (SELECT service, min(chunk_id) AS sf FROM best GROUP BY 1) SELECT chunk_id, r.service, function_qualified_name, score, rank FROM r JOIN f USING (service) WHERE rank <= 5 ORDER BY score DESC, sf, chunk_id LIMIT 40")
def w2(s, d):
    return rank.top_per_service(rank.best_chunk(_scored(s, d), "chunk_id"), "score", "chunk_id").select("chunk_id", "service", "function_qualified_name", "score", "rank")


_VEC = "sv AS (SELECT service AS name, arg_min(embedding, chunk_id) AS v FROM usable GROUP BY 1), hits AS (SELECT name, round(list_cosine_similarity(v, (SELECT q FROM probe)), 6) AS score FROM sv ORDER BY score DESC, name LIMIT 5)"
_HOPS = "both_ways AS (SELECT source, target FROM calls UNION SELECT target, source FROM calls), h1 AS (SELECT DISTINCT b.target AS name FROM both_ways b JOIN seeds s ON b.source = s.name WHERE b.target NOT IN (SELECT name FROM seeds)), h2 AS (SELECT DISTINCT b.target AS name FROM both_ways b JOIN h1 ON b.source = h1.name WHERE b.target NOT IN (SELECT name FROM seeds) AND b.target NOT IN (SELECT name FROM h1)), near AS (SELECT name, 1 AS hop_distance FROM h1 UNION ALL SELECT name, 2 FROM h2)"


def _hits(s, d):
    v = usable_chunks(s, d).groupBy(F.col("service").alias("name")).agg(F.min_by("embedding", "chunk_id").alias("v"))
    return vector.top_k(v, "name", "v", probe(s, d), 5).select("name", "score")


@query("ref_t12_expand_neighbors", f"WITH {USABLE}, {PROBE}, {CALLS}, {_VEC}, seeds AS (SELECT name FROM hits), {_HOPS} SELECT name, hop_distance FROM near")
def t12(s, d):
    return graph.expand_neighbors(calls(s, d), _hits(s, d), 2)


@query("ref_t4_merge_candidates", f"WITH {USABLE}, {PROBE}, {CALLS}, {_VEC}, seeds AS (SELECT name FROM hits), {_HOPS}, u AS (SELECT name, 0 AS src, -score AS k FROM hits UNION ALL SELECT name, 1, hop_distance FROM near), m AS (SELECT name, src, k FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY src, k) AS n FROM u) WHERE n = 1) SELECT name, row_number() OVER (ORDER BY src, k, name) AS position FROM m")
def t4(s, d):
    hits = _hits(s, d)
    return graph.merge_candidates(hits, graph.expand_neighbors(calls(s, d), hits, 2))


@query("ref_p6_edges_among", f"WITH {USABLE}, {PROBE}, {CALLS}, {_VEC}, seeds AS (SELECT name FROM hits), {_HOPS}, c AS (SELECT name FROM hits UNION SELECT name FROM near) SELECT source, target FROM calls WHERE source IN (SELECT name FROM c) AND target IN (SELECT name FROM c)")
def p6(s, d):
    return graph.edges_among(calls(s, d), t4(s, d))


@query("ref_p1_candidate_docs", f"WITH {USABLE}, {PROBE}, {_VEC} SELECT name, summary FROM services WHERE name IN (SELECT name FROM hits)")
def p1(s, d):
    return services(s, d).join(_hits(s, d).select("name"), "name", "left_semi").select("name", "summary")


@query("ref_p5_symbol_files", f"WITH {LATEST}, w AS (SELECT DISTINCT service, name AS symbol FROM latest WHERE kind = 'class'), n AS (SELECT DISTINCT service, file_path, unnest([name, list_extract(string_split(qualified_name, '::'), -1), list_extract(string_split(list_extract(string_split(qualified_name, '::'), -1), '.'), -1)]) AS symbol FROM latest) SELECT service, symbol, string_agg(DISTINCT file_path, '|' ORDER BY file_path) AS files FROM n JOIN w USING (service, symbol) GROUP BY 1, 2")
def p5(s, d):
    sym = latest_symbols(s, d)
    out = graph.symbol_files(sym, sym.where("kind = 'class'").select("service", F.col("name").alias("symbol")))
    return out.select("service", "symbol", F.array_join("file_paths", "|").alias("files"))


@query("ref_p4_folders", "WITH f AS (SELECT DISTINCT service, regexp_replace(file_path, '/?[^/]*$', '') AS folder FROM source_files) SELECT f.service, f.folder FROM f WHERE folder <> '' AND EXISTS (SELECT 1 FROM source_files s WHERE s.service = f.service AND starts_with(s.file_path, f.folder || '/'))")
def p4(s, d):
    f = table(s, d, "source_files").select("service", "file_path")
    return graph.folder_exists(f, f.select("service", F.concat(paths.dirname(F.col("file_path")), F.lit("/")).alias("folder")).where("folder <> '/'"))


@query("ref_p8_blob_shas", "SELECT service, commit_sha, file_path, blob_sha FROM source_files WHERE blob_sha IS NOT NULL")
def p8(s, d):
    return table(s, d, "source_files").where("blob_sha is not null").select("service", "commit_sha", "file_path", "blob_sha")


@query("ref_j4_suppress_methods", f"WITH {LATEST}, c AS (SELECT service, qualified_name FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY symbol_id) AS r FROM latest WHERE kind = 'class') WHERE r <= 5) SELECT service, qualified_name FROM latest f WHERE kind = 'function' AND NOT EXISTS (SELECT 1 FROM c WHERE c.service = f.service AND c.qualified_name = f.parent_class)")
def j4(s, d):
    sym = latest_symbols(s, d)
    w = Window.partitionBy("service").orderBy("symbol_id")
    picked = sym.where("kind = 'class'").withColumn("r", F.row_number().over(w)).where("r <= 5")
    return rank.suppress_members(sym.where("kind = 'function'"), picked).select("service", "qualified_name")


@query("ref_j5_fallback_pool", f"WITH {USABLE}, {PROBE}, {_SCORED}, k AS (SELECT service FROM scored ORDER BY score DESC, chunk_id LIMIT 50) SELECT name FROM services WHERE name NOT IN (SELECT service FROM k)")
def j5(s, d):
    k = vector.top_k(usable_chunks(s, d), "chunk_id", "embedding", probe(s, d), 50)
    return services(s, d).join(k.select(F.col("service").alias("name")), "name", "left_anti").select("name")


@query(
    "ref_f6_service_refs",
    "WITH t AS (SELECT service, 'document ' || doc_id AS file_path, lower(text) AS t FROM documents WHERE text IS NOT NULL), "
    "p AS (SELECT t.*, lower(s.name) AS r FROM t JOIN services s ON contains(t.t, lower(s.name)) AND t.service IS DISTINCT FROM lower(s.name)), "
    "q AS (SELECT service, file_path, r, string_split(t, r) AS x FROM p), "
    "k AS (SELECT *, unnest(generate_series(1, len(x) - 1)) AS k FROM q), "
    "m AS (SELECT service, file_path, r, right(list_reduce(x[1:k], lambda u, v: u || r || v), 60) AS a, left(list_reduce(x[k + 1:], lambda u, v: u || r || v), 60) AS b FROM k) "
    "SELECT DISTINCT service, file_path, r AS reference FROM m WHERE NOT regexp_matches(right(a, 1), '[\\p{L}\\p{N}]') AND NOT regexp_matches(left(b, 1), '[\\p{L}\\p{N}]') AND ("
    "regexp_matches(a || r || b, '(^|[^\\p{L}\\p{N}])(url|uri|endpoint|graphql|gateway)($|[^\\p{L}\\p{N}])') OR regexp_matches(a, 'https?://[^/:''\"\\\\\\s?#]*$'))",
)
def f6(s, d):
    """References to services in the documents' texts."""
    docs = table(s, d, "documents").select("service", F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("file_path"), "text")
    return service_references(docs, services(s, d).select("name"))


@query("ref_s4_scannable", "SELECT file_id, size_bytes FROM source_files WHERE size_bytes <= 500000 AND content IS NOT NULL AND language <> 'csv' AND language <> 'bpmn'")
def s4(s, d):
    """Files a reference scan reads: small, textual, not pruned; endings count in any letter case."""
    t = table(s, d, "source_files").where("content is not null and language <> 'csv' and language <> 'bpmn'").withColumn("file_path", F.concat(F.lit("x/"), F.element_at(F.split("file_path", "/"), -1)))
    up = F.when(F.col("file_id") % 2 == 0, F.regexp_replace("file_path", r"\.[^.]*$", F.upper(F.regexp_extract("file_path", r"(\.[^.]*)$", 1)))).otherwise(F.col("file_path"))
    return snapshots.scannable(t.withColumn("file_path", up)).select("file_id", "size_bytes")


@query("ref_k4_replace_edges", f"WITH {CALLS}, w AS (SELECT DISTINCT source, min(target) OVER () AS target FROM calls WHERE source < 'm') SELECT source, target FROM calls WHERE source NOT IN (SELECT source FROM w) UNION SELECT source, target FROM w WHERE target IN (SELECT name FROM services)")
def k4(s, d):
    c = calls(s, d)
    low = c.where("source < 'm'").agg(F.min("target")).first()[0]
    wanted = c.where("source < 'm'").select("source", F.lit(low).alias("target")).distinct()
    return maintain.replace_edges(c, wanted, services(s, d))


# ---------------------------------------------------------------- snapshots

_RUNS = "runs AS (SELECT service, commit_sha, row_number() OVER (PARTITION BY service ORDER BY ingested_at, commit_sha) AS a, row_number() OVER (PARTITION BY service ORDER BY ingested_at DESC, commit_sha DESC) AS z FROM repo_graphs), base AS (SELECT f.service, f.file_path, f.blob_sha FROM source_files f JOIN runs r USING (service, commit_sha) WHERE r.a = 1), head AS (SELECT f.service, f.file_path, f.blob_sha FROM source_files f JOIN runs r USING (service, commit_sha) WHERE r.z = 1)"


def _runs(s, d):
    g = table(s, d, "repo_graphs").select("service", "commit_sha", "ingested_at")
    up = Window.partitionBy("service").orderBy("ingested_at", "commit_sha")
    down = Window.partitionBy("service").orderBy(F.desc("ingested_at"), F.desc("commit_sha"))
    return g.withColumns({"a": F.row_number().over(up), "z": F.row_number().over(down)})


def _snapshot(s, d, which):
    f = table(s, d, "source_files").select("service", "commit_sha", "file_path", "blob_sha", "language")
    return f.join(_runs(s, d).where(f"{which} = 1").select("service", "commit_sha"), ["service", "commit_sha"], "left_semi")


_DIFF = (
    "j AS (SELECT coalesce(b.service, h.service) AS service, coalesce(b.file_path, h.file_path) AS file_path, b.blob_sha AS o, h.blob_sha AS n, b.service IS NOT NULL AS inb, h.service IS NOT NULL AS inh FROM base b FULL JOIN head h ON b.service = h.service AND b.file_path = h.file_path), "
    "gone AS (SELECT service, o AS sha, min(file_path) AS previous_path FROM j WHERE NOT inh GROUP BY 1, 2), came AS (SELECT j.service, j.file_path, g.previous_path FROM j LEFT JOIN gone g ON g.service = j.service AND g.sha = j.n WHERE NOT inb), "
    "pick AS (SELECT service, previous_path, min(file_path) AS file_path FROM came WHERE previous_path IS NOT NULL GROUP BY 1, 2), "
    "feed AS (SELECT c.service, c.file_path, CASE WHEN p.file_path IS NULL THEN 'added' ELSE 'renamed' END AS status, p.previous_path FROM came c LEFT JOIN pick p ON p.service = c.service AND p.file_path = c.file_path "
    "UNION ALL SELECT service, file_path, 'removed', NULL FROM j WHERE NOT inh AND NOT EXISTS (SELECT 1 FROM pick p WHERE p.service = j.service AND p.previous_path = j.file_path) "
    "UNION ALL SELECT service, file_path, 'modified', NULL FROM j WHERE inb AND inh AND o IS DISTINCT FROM n)"
)


def _feed(s, d):
    return maintain.diff_snapshots(_snapshot(s, d, "a"), _snapshot(s, d, "z"))


@query("ref_s9_change_feed", f"WITH {_RUNS}, {_DIFF} SELECT service, file_path, status, previous_path FROM feed")
def s9(s, d):
    return _feed(s, d)


@query(
    "ref_d6_classify_changes",
    f"WITH {_RUNS}, {_DIFF}, c AS (SELECT f.*, h.blob_sha AS sha FROM feed f LEFT JOIN head h ON h.service = f.service AND h.file_path = f.file_path), x AS (SELECT c.*, s.blob_sha AS have, p.blob_sha AS before FROM c LEFT JOIN base s ON s.service = c.service AND s.file_path = c.file_path AND s.blob_sha IS NOT NULL LEFT JOIN base p ON p.service = c.service AND p.file_path = c.previous_path AND p.blob_sha IS NOT NULL) "
    f"SELECT service, file_path, status, CASE WHEN status = 'removed' THEN 'delete' WHEN status = 'renamed' AND sha = before THEN 'relabel' WHEN sha = have THEN 'skip' WHEN {_LANG} IS NULL OR {_LANG} IN ('html', 'css', 'csv') THEN 'record' ELSE 'reparse' END AS action FROM x",
)
def d6(s, d):
    head = _snapshot(s, d, "z").select("service", "file_path", F.col("blob_sha").alias("sha"))
    c = _feed(s, d).join(head, ["service", "file_path"], "left")
    lang = paths.language_of(F.col("file_path"))
    return maintain.classify_changes(c, _snapshot(s, d, "a"), F.when(~lang.isin("html", "css", "csv"), lang))


@query("ref_d3_next_action", f"WITH {_RUNS}, h AS (SELECT s.name AS service, r.commit_sha AS head_sha FROM services s LEFT JOIN runs r ON r.service = s.name AND r.z = 1), st AS (SELECT service, commit_sha FROM runs WHERE a = 1) SELECT h.service, CASE WHEN st.commit_sha IS NULL THEN 'full' WHEN st.commit_sha = h.head_sha THEN 'up_to_date' ELSE 'incremental' END AS action FROM h LEFT JOIN st USING (service)")
def d3(s, d):
    r = _runs(s, d)
    heads = services(s, d).select(F.col("name").alias("service")).join(r.where("z = 1").select("service", F.col("commit_sha").alias("head_sha")), "service", "left")
    return maintain.next_action(heads, r.where("a = 1").select("service", "commit_sha"))


@query("ref_k8_prune_files", f"WITH {_RUNS}, e AS (SELECT DISTINCT service, file_path FROM source_files) SELECT service, file_path FROM e WHERE (service, file_path) IN (SELECT (service, file_path) FROM head) OR service NOT IN (SELECT service FROM head)")
def k8(s, d):
    e = table(s, d, "source_files").select("service", "file_path").distinct()
    return maintain.prune(e, _snapshot(s, d, "z"), ["service", "file_path"])


@query("ref_k9_cascade_delete", f"WITH {LATEST}, {_RUNS}, {_DIFF}, g AS (SELECT service, file_path FROM feed WHERE status = 'removed') SELECT service, qualified_name, kind FROM latest l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.service = l.service AND g.file_path = l.file_path)")
def k9(s, d):
    return latest_symbols(s, d).join(_feed(s, d).where("status = 'removed'").select("service", "file_path"), ["service", "file_path"], "left_anti").select("service", "qualified_name", "kind")


@query("ref_k10_rename", f"WITH {LATEST}, {_RUNS}, {_DIFF}, r AS (SELECT service, previous_path, min(file_path) AS new_path FROM feed WHERE status = 'renamed' GROUP BY 1, 2) SELECT l.service, qualified_name, coalesce(new_path, l.file_path) AS file_path FROM latest l LEFT JOIN r ON r.service = l.service AND r.previous_path = l.file_path")
def k10(s, d):
    ren = _feed(s, d).where("status = 'renamed'").groupBy("service", "previous_path").agg(F.min("file_path").alias("new_path"))
    return maintain.rename(latest_symbols(s, d).select("service", "qualified_name", "file_path"), ren.withColumnRenamed("previous_path", "old_path"))


_CUT = "2025-04-03 00:00:00"


def _before(s, d, op):
    w = Window.partitionBy("service", "qualified_name").orderBy(F.desc("symbol_id"))
    t = table(s, d, "parsed_symbols").where(f"ingested_at {op} timestamp_ntz '{_CUT}'")
    return t.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("service", "qualified_name", "name", "file_path", "docstring", "line_start")


_SIDE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service, qualified_name ORDER BY symbol_id DESC) AS rn FROM parsed_symbols WHERE ingested_at {} TIMESTAMP '" + _CUT + "') WHERE rn = 1"


@query("ref_k1_upsert_snapshot", f"WITH o AS ({_SIDE.format('<')}), n AS ({_SIDE.format('>=')}) SELECT coalesce(o.service, n.service) AS service, coalesce(o.qualified_name, n.qualified_name) AS qualified_name, coalesce(n.name, o.name) AS name, coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.docstring, o.docstring) AS docstring, coalesce(n.line_start, o.line_start) AS line_start FROM o FULL JOIN n ON o.service = n.service AND o.qualified_name = n.qualified_name")
def k1(s, d):
    return maintain.upsert(_before(s, d, "<"), _before(s, d, ">="), ["service", "qualified_name"])


@query("ref_k3_edges", f"WITH {LATEST} SELECT f.service, f.parent_class AS source, f.qualified_name AS target, 'DECLARES' AS edge FROM latest f JOIN latest c ON c.service = f.service AND c.qualified_name = f.parent_class AND c.kind = 'class' WHERE f.kind = 'function' UNION SELECT service, file_path, qualified_name, 'DEFINES' FROM latest WHERE kind = 'class' OR NOT coalesce(is_method, false)")
def k3(s, d):
    sym = latest_symbols(s, d)
    c = sym.where("kind = 'class'").select("service", F.col("qualified_name").alias("parent_class"))
    declares = sym.where("kind = 'function'").join(c, ["service", "parent_class"], "left_semi").select("service", F.col("parent_class").alias("source"), F.col("qualified_name").alias("target"), F.lit("DECLARES").alias("edge"))
    defines = sym.where("kind = 'class' or not coalesce(is_method, false)").select("service", F.col("file_path").alias("source"), F.col("qualified_name").alias("target"), F.lit("DEFINES").alias("edge"))
    return declares.unionByName(defines).distinct()


@query("ref_j1_chunk_owner", f"WITH {LATEST} SELECT c.chunk_id, l.symbol_id, l.kind FROM chunks c JOIN latest l ON l.service = c.service AND l.qualified_name = c.function_qualified_name")
def j1(s, d):
    l = latest_symbols(s, d).select("service", F.col("qualified_name").alias("function_qualified_name"), "symbol_id", "kind")
    return table(s, d, "chunks").join(l, ["service", "function_qualified_name"]).select("chunk_id", "symbol_id", "kind")


@query("ref_a12_fingerprint", "WITH e AS (SELECT service, sha1(concat_ws(chr(9), file_path, size_bytes, epoch_us(mtime))) AS h FROM source_files), p AS (SELECT service, left(h, 2) AS p, sha1(string_agg(h, '' ORDER BY h)) AS h FROM e GROUP BY 1, 2) SELECT service, sha1(string_agg(h, '' ORDER BY p)) AS fingerprint FROM p GROUP BY 1")
def a12(s, d):
    return snapshots.fingerprint(table(s, d, "source_files").withColumn("mtime", F.unix_micros(F.col("mtime").cast("timestamp"))))


# ---------------------------------------------------------------- digests

_A5 = "g AS (SELECT service, language, count(*) AS n, min((CASE WHEN kind = 'class' THEN 0 ELSE 1 END) * 1000000000000 + symbol_id) AS first FROM latest GROUP BY 1, 2), lang AS (SELECT service, language, n FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY n DESC, first) AS r FROM g) WHERE r = 1)"
_A6 = "m AS (SELECT service, parent_class, count(*) AS methods FROM latest WHERE kind = 'function' AND is_method AND parent_class IS NOT NULL GROUP BY 1, 2), top_c AS (SELECT * FROM (SELECT l.service, l.qualified_name, l.name, l.docstring, coalesce(m.methods, 0) AS methods, row_number() OVER (PARTITION BY l.service ORDER BY coalesce(m.methods, 0) DESC, symbol_id) AS rank FROM latest l LEFT JOIN m ON m.service = l.service AND m.parent_class = l.qualified_name WHERE l.kind = 'class') WHERE rank <= 15)"
_W4 = "top_f AS (SELECT * FROM (SELECT service, name, row_number() OVER (PARTITION BY service ORDER BY symbol_id) AS rank FROM latest WHERE kind = 'function' AND NOT coalesce(is_method, false)) WHERE rank <= 20)"
_ENTRY = "(" + " OR ".join(f"(language = '{k}' AND lower(list_extract(string_split(file_path, '/'), -1)) IN (" + ", ".join(f"'{x}'" for x in v) + "))" for k, v in paths.ENTRY_POINTS.items()) + " OR (language = 'java' AND ends_with(file_path, 'Application.java')))"


@query("ref_a5_dominant_language", f"WITH {LATEST}, {_A5} SELECT service, language, n FROM lang")
def a5(s, d):
    return digest.dominant_language(latest_symbols(s, d), "symbol_id")


@query("ref_a6_top_classes", f"WITH {LATEST}, {_A6} SELECT service, qualified_name, name, docstring, methods, rank FROM top_c")
def a6(s, d):
    return digest.top_classes(latest_symbols(s, d), "symbol_id")


@query("ref_w4_top_functions", f"WITH {LATEST}, {_W4} SELECT service, name, rank FROM top_f")
def w4(s, d):
    return digest.top_functions(latest_symbols(s, d), "symbol_id")


@query(
    "ref_a16_digest",
    f"WITH {LATEST}, {_A5}, {_A6}, {_W4}, e AS (SELECT s.service, string_agg(DISTINCT s.file_path, '|' ORDER BY s.file_path) AS e FROM (SELECT service, file_path FROM latest) s JOIN lang USING (service) WHERE {_ENTRY} GROUP BY 1), c AS (SELECT service, string_agg(name, '|' ORDER BY rank) AS c FROM top_c GROUP BY 1), f AS (SELECT service, string_agg(name, '|' ORDER BY rank) AS f FROM top_f GROUP BY 1) "
    "SELECT service, language, coalesce(e, '') AS entry_points, coalesce(c, '') AS classes, coalesce(f, '') AS top_level_functions FROM lang LEFT JOIN e USING (service) LEFT JOIN c USING (service) LEFT JOIN f USING (service)",
)
def a16(s, d):
    x = digest.digest(latest_symbols(s, d), "symbol_id")
    return x.select("service", "language", *[F.array_join(c, "|").alias(c) for c in ("entry_points", "classes", "top_level_functions")])


@query("ref_a11_chunk_counts", "SELECT service, function_qualified_name, count(*) AS chunks, max(chunk_index) AS last_index FROM (SELECT DISTINCT service, function_qualified_name, chunk_index FROM chunks) GROUP BY 1, 2")
def a11(s, d):
    return table(s, d, "chunks").select("service", "function_qualified_name", "chunk_index").distinct().groupBy("service", "function_qualified_name").agg(F.count("*").alias("chunks"), F.max("chunk_index").alias("last_index"))


@query("ref_a10_counters", "SELECT service, count(*) AS runs, sum(files_parsed) AS parsed, sum(files_failed) AS failed, sum(files_skipped_oversized) AS oversized, sum(files_skipped_unsupported) AS unsupported FROM repo_graphs GROUP BY 1")
def a10(s, d):
    return table(s, d, "repo_graphs").groupBy("service").agg(F.count("*").alias("runs"), F.sum("files_parsed").alias("parsed"), F.sum("files_failed").alias("failed"), F.sum("files_skipped_oversized").alias("oversized"), F.sum("files_skipped_unsupported").alias("unsupported"))


@query("ref_w6_step_edges", "SELECT service, commit_sha AS source, lead(commit_sha) OVER (PARTITION BY service ORDER BY ingested_at, commit_sha) AS target, row_number() OVER (PARTITION BY service ORDER BY ingested_at, commit_sha) AS step FROM repo_graphs")
def w6(s, d):
    w = Window.partitionBy("service").orderBy("ingested_at", "commit_sha")
    return table(s, d, "repo_graphs").select("service", F.col("commit_sha").alias("source"), F.lead("commit_sha").over(w).alias("target"), F.row_number().over(w).alias("step"))


@query(
    "ref_w7_embed_batches",
    "WITH RECURSIVE r AS (SELECT chunk_id, coalesce(length(text), 0) AS chars, chunk_id // 1000 AS part, row_number() OVER (PARTITION BY chunk_id // 1000 ORDER BY chunk_id) AS i FROM chunks), "
    "f AS (SELECT part, i, chunk_id, chars, 0 AS batch, 1 AS n, chars AS size FROM r WHERE i = 1 UNION ALL "
    "SELECT r.part, r.i, r.chunk_id, r.chars, CASE WHEN f.n = 100 OR f.size + r.chars > 200000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n = 100 OR f.size + r.chars > 200000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n = 100 OR f.size + r.chars > 200000 THEN r.chars ELSE f.size + r.chars END FROM f JOIN r ON r.part = f.part AND r.i = f.i + 1) "
    "SELECT chunk_id, CAST(chars AS BIGINT) AS chars, part, CAST(batch AS BIGINT) AS batch FROM f",
)
def w7(s, d):
    """Chunks packed into embedding requests of at most 100 texts or 200,000 characters.

    Packing runs in order of ids within ranges of 1,000 ids, so ``(part, batch)`` names the same request
    however the table is split over tasks.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk_id")
        n = size = batch = 0
        out = []
        for x in t.column("chars").to_pylist():
            if n and (n == 100 or size + x > 200_000):
                batch, n, size = batch + 1, 0, 0
            n, size = n + 1, size + x
            out.append(batch)
        return t.append_column("batch", pa.array(out, pa.int64()))

    rows = table(s, d, "chunks").select("chunk_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"), F.floor(F.col("chunk_id") / 1000).alias("part"))
    return rows.groupBy("part").applyInArrow(run, "chunk_id bigint, chars bigint, part bigint, batch bigint")


@query("ref_w8_chunks")
def w8(s, d):
    """Functions cut into chunks of at most 700 characters, each opened by its signature."""
    return ingest.chunk_functions(latest_symbols(s, d).where("kind = 'function'"))


_RUNS = "runs AS (SELECT service, arg_min(commit_sha, (ingested_at, commit_sha)) AS a, arg_max(commit_sha, (ingested_at, commit_sha)) AS b FROM repo_graphs WHERE ingested_at IS NOT NULL GROUP BY 1)"
_OF_RUN = "SELECT p.service, file_path, qualified_name, arg_max(name, symbol_id) AS name, arg_max(docstring, symbol_id) AS docstring FROM parsed_symbols p JOIN runs ON runs.service = p.service AND p.commit_sha = runs.{} GROUP BY ALL"


@query(
    "ref_d2_incremental",
    f"WITH {_RUNS}, o AS (SELECT p.service, file_path, qualified_name, name, docstring FROM (SELECT *, row_number() OVER (PARTITION BY service, commit_sha, qualified_name ORDER BY symbol_id DESC) AS rn FROM parsed_symbols) p JOIN runs ON runs.service = p.service AND p.commit_sha = runs.a WHERE rn = 1), "
    "n AS (SELECT p.service, file_path, qualified_name, name, docstring FROM (SELECT *, row_number() OVER (PARTITION BY service, commit_sha, qualified_name ORDER BY symbol_id DESC) AS rn FROM parsed_symbols) p JOIN runs ON runs.service = p.service AND p.commit_sha = runs.b WHERE rn = 1), "
    "f AS (SELECT service, file_path, commit_sha, blob_sha FROM source_files JOIN runs USING (service) WHERE commit_sha IN (a, b)), "
    "x AS (SELECT f.service, file_path, blob_sha FROM f JOIN runs ON runs.service = f.service AND commit_sha = a), y AS (SELECT f.service, file_path, blob_sha FROM f JOIN runs ON runs.service = f.service AND commit_sha = b), "
    "gone AS (SELECT service, file_path FROM x WHERE (service, file_path) NOT IN (SELECT service, file_path FROM y)), "
    "again AS (SELECT y.service, y.file_path FROM y LEFT JOIN x USING (service, file_path) WHERE x.file_path IS NULL OR y.blob_sha IS DISTINCT FROM x.blob_sha) "
    "SELECT * FROM o WHERE (service, file_path) NOT IN (SELECT * FROM gone UNION ALL SELECT * FROM again) UNION ALL SELECT * FROM n WHERE (service, file_path) IN (SELECT * FROM again)",
)
def d2(s, d):
    """The symbol table of each service's first run after the change feed to its last one (renames as remove and add)."""
    runs = table(s, d, "repo_graphs").where("ingested_at is not null").groupBy("service").agg(F.min(F.struct("ingested_at", "commit_sha")).alias("a"), F.max(F.struct("ingested_at", "commit_sha")).alias("b")).select("service", F.col("a.commit_sha").alias("a"), F.col("b.commit_sha").alias("b"))
    of = lambda t, side: t.join(runs.select("service", F.col(side).alias("commit_sha")), ["service", "commit_sha"], "left_semi")
    files, symbols = table(s, d, "source_files").select("service", "commit_sha", "file_path", "blob_sha"), table(s, d, "parsed_symbols")
    w = Window.partitionBy("service", "commit_sha", "qualified_name").orderBy(F.desc("symbol_id"))
    symbols = symbols.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("service", "commit_sha", "file_path", "qualified_name", "name", "docstring")
    old, new = (of(symbols, side).drop("commit_sha") for side in "ab")
    before, after = (of(files, side) for side in "ab")
    feed = maintain.diff_snapshots(before, after).select("service", "file_path", "status", "previous_path")
    # The stored table has no rows of a renamed file under its new path that could be kept: take it as removed and added.
    feed = feed.select("service", "file_path", F.when(F.col("status") == "renamed", "added").otherwise(F.col("status")).alias("status")).unionByName(feed.where("status = 'renamed'").select("service", F.col("previous_path").alias("file_path"), F.lit("removed").alias("status")))
    feed = feed.withColumn("previous_path", F.lit(None).cast("string")).join(after.select("service", "file_path", F.col("blob_sha").alias("sha")), ["service", "file_path"], "left")
    actions = maintain.classify_changes(feed, before.where("blob_sha is null").select("service", "file_path", "blob_sha"), F.lit("any")).withColumn("previous_path", F.lit(None).cast("string"))
    return ingest.incremental_ingest(old, new, actions, ["service", "qualified_name"])


@query("ref_p15_symbols")
def p15(s, d):
    return parse_symbols(table(s, d, "source_files"))


@query("ref_s2_manifest", "SELECT name, repo, branch FROM services")
def s2(s, d):
    """Services as manifest lines, one manifest per team, parsed back."""
    line = F.concat("name", F.lit(": "), "repo", F.coalesce(F.concat(F.lit("@"), "branch"), F.lit("")))
    text = services(s, d).groupBy(F.col("team").alias("manifest_id")).agg(F.concat_ws("\n", F.lit("# services"), F.collect_list(line), F.lit("")).alias("text"))
    return manifest.parse_lines(text).where("problem is null").select("name", "repo", "branch")


# ---------------------------------------------------------------- events

_BODY = "body AS (SELECT *, CASE WHEN json_valid(p0) THEN p0 END AS p FROM (SELECT *, CASE WHEN json_valid(raw_payload) THEN CASE WHEN json_type(raw_payload) = 'VARCHAR' THEN json_extract_string(raw_payload, '$') ELSE raw_payload END END AS p0 FROM canonical_events))"


def _case(d: dict, x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in d.items()) + " END"


_HOST = "CASE WHEN json_extract_string(p, '$.pull_request.number') IS NOT NULL THEN 'pull_request' WHEN json_extract_string(p, '$.check_run.id') IS NOT NULL THEN 'check_run' WHEN json_extract_string(p, '$.ref') IS NOT NULL THEN 'push' ELSE 'issues' END"
_ACT = "json_extract_string(p, '$.action')"
_TYPE = (
    "CASE event_source WHEN 'slack' THEN coalesce("
    + _case(payload.CHAT_EVENTS, "json_extract_string(p, '$.event.type')")
    + ", coalesce(json_extract_string(p, '$.event.type'), json_extract_string(p, '$.type')) || '.received', 'unknown.received') "
    + f"WHEN 'github' THEN CASE WHEN {_HOST} = 'pull_request' AND {_ACT} = 'closed' AND json_extract_string(p, '$.pull_request.merged') = 'true' THEN 'pull_request.merged' WHEN {_HOST} = 'push' THEN 'push.received' WHEN {_HOST} = 'issues' AND {_ACT} IN ('opened', 'closed') THEN 'issue.' || {_ACT} ELSE {_HOST} || '.' || coalesce(nullif({_ACT}, ''), 'received') END "
    + "WHEN 'jira' THEN coalesce(nullif(json_extract_string(p, '$.event_type'), ''), CASE WHEN json_extract_string(p, '$.webhookEvent') = 'jira:issue_updated' THEN coalesce("
    + _case(payload.TRACKER_UPDATES, "json_extract_string(p, '$.issue_event_type_name')")
    + ", 'issue.updated') ELSE coalesce("
    + _case(payload.TRACKER_EVENTS, "json_extract_string(p, '$.webhookEvent')")
    + ", nullif(json_extract_string(p, '$.webhookEvent'), '') || '.received', 'unknown.received') END) ELSE 'sms.received' END"
)


def _host_event(v):
    t = payload.text_at
    return F.when(t(v, "$.pull_request.number").isNotNull(), "pull_request").when(t(v, "$.check_run.id").isNotNull(), "check_run").when(t(v, "$.ref").isNotNull(), "push").otherwise("issues")


@query("ref_f25_event_types", f"WITH {_BODY} SELECT delivery_id, {_TYPE} AS canonical FROM body WHERE p IS NOT NULL")
def f25(s, d):
    e = table(s, d, "canonical_events").withColumn("v", payload.opened(F.col("raw_payload"))).where("v is not null")
    return e.select("delivery_id", stream.event_type(F.col("event_source"), F.col("v"), _host_event(F.col("v"))).alias("canonical"))


@query("ref_f30_resource", f"WITH {_BODY} SELECT delivery_id, coalesce(json_extract_string(p, '$.event.channel.id'), CASE WHEN json_type(p, '$.event.channel') = 'VARCHAR' THEN json_extract_string(p, '$.event.channel') END, json_extract_string(p, '$.event.item.channel'), json_extract_string(p, '$.event.channel_id')) AS channel FROM body WHERE event_source = 'slack' AND p IS NOT NULL")
def f30(s, d):
    e = table(s, d, "canonical_events").where("event_source = 'slack'").withColumn("v", payload.opened(F.col("raw_payload"))).where("v is not null")
    ch = F.try_variant_get("v", "$.event.channel", "variant")
    plain = F.when(F.schema_of_variant(ch) == "STRING", payload.text_at(F.col("v"), "$.event.channel"))
    return e.select("delivery_id", F.coalesce(payload.text_at(F.col("v"), "$.event.channel.id"), plain, payload.text_at(F.col("v"), "$.event.item.channel"), payload.text_at(F.col("v"), "$.event.channel_id")).alias("channel"))


@query("ref_f29_media", f"WITH {_BODY} SELECT delivery_id, CASE WHEN starts_with(f, 'whatsapp:') THEN 'whatsapp' WHEN starts_with(f, 'rcs:') THEN 'rcs' ELSE 'sms' END AS channel, regexp_replace(f, '^(whatsapp:|rcs:)', '') AS sender, n AS media FROM (SELECT delivery_id, json_extract_string(p, '$.From') AS f, len(list_filter(list_transform(range(coalesce(try_cast(json_extract_string(p, '$.NumMedia') AS INT), 0)), lambda i: json_extract_string(p, '$.MediaUrl' || i)), lambda u: coalesce(u, '') <> '')) AS n FROM body WHERE event_source = 'twilio' AND p IS NOT NULL)")
def f29(s, d):
    e = table(s, d, "canonical_events").where("event_source = 'twilio'").withColumn("v", payload.opened(F.col("raw_payload"))).where("v is not null")
    e = e.withColumn("m", F.try_variant_get("v", "$", "map<string,string>")).withColumn("f", payload.text_at(F.col("v"), "$.From"))
    return e.select("delivery_id", payload.channel_of(F.col("f")).alias("channel"), payload.bare_address(F.col("f")).alias("sender"), F.size(payload.media_urls(F.col("m"))).cast("bigint").alias("media"))


@query("ref_f34_status", f"WITH {_BODY}, h AS (SELECT *, CASE WHEN delivery_id % 3 = 0 THEN json_merge_patch(p, '{{\"transition\":null,\"changelog\":{{\"items\":[{{\"field\":\"rank\",\"toString\":\"x\"}},{{\"field\":\"status\",\"toString\":\"Moved\"}}]}}}}') ELSE p END AS q FROM body WHERE event_source = 'jira' AND p IS NOT NULL AND json_type(p) = 'OBJECT') SELECT delivery_id, CASE WHEN delivery_id % 3 = 0 THEN 'Moved' ELSE coalesce(nullif(json_extract_string(q, '$.transition.to_status'), ''), json_extract_string(q, '$.issue.fields.status.name'), '') END AS status FROM h")
def f34(s, d):
    """Every third event without a transition, but with a change log."""
    e = table(s, d, "canonical_events").where("event_source = 'jira'").withColumn("v", payload.opened(F.col("raw_payload"))).where("v is not null and startswith(schema_of_variant(v), 'OBJECT')")
    log = F.parse_json(F.lit('{"transition":{"to_status":""},"changelog":{"items":[{"field":"rank","toString":"x"},{"field":"status","toString":"Moved"}]},"issue":{"fields":{"status":{"name":"Other"}}}}'))
    v = F.when(F.col("delivery_id") % 3 == 0, log).otherwise(F.col("v"))
    return e.select("delivery_id", payload.transition_status(v).alias("status"))


@query("ref_j12_route_tenant", "SELECT e.delivery_id, r.tenant_id AS routed, CASE WHEN r.tenant_id IS NULL THEN 'unresolved' WHEN r.tenant_id = e.tenant_id THEN 'same' ELSE 'other' END AS outcome FROM canonical_events e LEFT JOIN (SELECT event_source, workspace_key, min(tenant_id) AS tenant_id FROM tenant_routes GROUP BY 1, 2) r ON r.event_source = e.event_source AND r.workspace_key = e.source_workspace_id")
def j12(s, d):
    r = table(s, d, "tenant_routes").groupBy("event_source", F.col("workspace_key").alias("source_workspace_id")).agg(F.min("tenant_id").alias("routed"))
    e = table(s, d, "canonical_events").select("delivery_id", "event_source", "source_workspace_id", "tenant_id").join(r, ["event_source", "source_workspace_id"], "left")
    return e.select("delivery_id", "routed", F.when(F.col("routed").isNull(), "unresolved").when(F.col("routed") == F.col("tenant_id"), "same").otherwise("other").alias("outcome"))


@query("ref_j13_tenant_name", "WITH n AS (SELECT tenant_id, min(tenant_name) AS name FROM tenant_routes GROUP BY 1) SELECT e.tenant_id, coalesce(n.name, e.tenant_id) AS tenant_name, count(*) AS deliveries FROM canonical_events e LEFT JOIN n USING (tenant_id) GROUP BY 1, 2")
def j13(s, d):
    n = table(s, d, "tenant_routes").groupBy("tenant_id").agg(F.min("tenant_name").alias("name"))
    c = table(s, d, "canonical_events").groupBy("tenant_id").agg(F.count("*").alias("deliveries"))
    return c.join(n, "tenant_id", "left").select("tenant_id", F.coalesce("name", "tenant_id").alias("tenant_name"), "deliveries")


@query("ref_p7_sender_filter", "SELECT delivery_id FROM canonical_events WHERE actor.email <> '' AND trim(lower(split_part(actor.email, '@', 2))) IN ('mail.example.test') AND trim(lower(split_part(actor.email, '@', 2))) NOT IN ('spam.example.test')")
def p7(s, d):
    e = table(s, d, "canonical_events").select("delivery_id", F.col("actor.email").alias("email"))
    return stream.sender_filter(e, "email", [], ["spam.example.test"], [], ["mail.example.test"], True).select("delivery_id")


@query("ref_x4_replay", "SELECT delivery_id, abs(epoch_us(arrived_at) - epoch_us((received_at::TIMESTAMPTZ) AT TIME ZONE 'UTC')) <= 300000000 AS fresh FROM canonical_events WHERE received_at IS NOT NULL")
def x4(s, d):
    e = table(s, d, "canonical_events").where("received_at is not null")
    return e.select("delivery_id", (F.abs(F.unix_micros(F.col("arrived_at").cast("timestamp")) - F.unix_micros(instant(F.col("received_at")))) <= 300_000_000).alias("fresh"))


_CLEAN = "lower(regexp_replace(provider_event_id, '^\\s+|\\s+$', '', 'g'))"
_PID = f"CASE WHEN {_CLEAN} NOT IN ('', 'null', 'undefined') THEN {_CLEAN} END"


@query("ref_x5_ack_matrix", f"WITH {_BODY} SELECT event_source, CASE WHEN p IS NULL OR ({_PID}) IS NULL THEN CASE WHEN event_source = 'slack' THEN 'retry' ELSE 'dead_letter' END ELSE 'acked' END AS outcome, count(*) AS messages FROM body GROUP BY 1, 2")
def x5(s, d):
    e = table(s, d, "canonical_events")
    ok, has = payload.opened(F.col("raw_payload")).isNotNull(), provider_id(F.col("provider_event_id")).isNotNull()
    none = F.lit(None).cast("string")
    out = F.when(F.col("event_source") == "slack", stream.ack_outcome(ok, has, none, True)).otherwise(stream.ack_outcome(ok, has, none))
    return e.select("event_source", out.alias("outcome")).groupBy("event_source", "outcome").agg(F.count("*").alias("messages"))


@query("ref_x2_ttl_dedup", f"WITH RECURSIVE m AS (SELECT {_PID} AS message_id, (received_at::TIMESTAMPTZ) AS t FROM canonical_events WHERE received_at IS NOT NULL), r AS (SELECT message_id, t, row_number() OVER (PARTITION BY message_id ORDER BY t) AS n FROM m WHERE message_id IS NOT NULL), f AS (SELECT message_id, n, t, t AS kept, true AS own FROM r WHERE n = 1 UNION ALL SELECT r.message_id, r.n, r.t, CASE WHEN r.t - f.kept > INTERVAL 300 SECOND THEN r.t ELSE f.kept END, r.t - f.kept > INTERVAL 300 SECOND FROM f JOIN r ON r.message_id = f.message_id AND r.n = f.n + 1) SELECT message_id, epoch_us(t) AS at FROM f WHERE own")
def x2(s, d):
    """Sightings of provider ids kept under a 300 second TTL."""
    e = table(s, d, "canonical_events").select(provider_id(F.col("provider_event_id")).alias("message_id"), instant(F.col("received_at")).alias("at"))
    return stream.ttl_dedup(e, "message_id", "at", 300).select("message_id", F.unix_micros("at").alias("at"))


_X1 = f"""WITH {_BODY}, r AS (SELECT event_source, workspace_key, min(tenant_id) AS t FROM tenant_routes GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN p IS NULL AND event_source = 'slack' AND delivery_id % 13 = 0 THEN '{{}}' ELSE p END AS q FROM body WHERE raw_payload IS NOT NULL),
k AS (SELECT b.*, json_extract_string(q, '$.type') AS kind, CASE WHEN b.event_source IN ('github', 'jira') THEN CASE WHEN delivery_id % 29 <> 0 THEN tenant_id END ELSE r.t END AS t
  FROM b LEFT JOIN r ON r.event_source = b.event_source AND r.workspace_key = CASE b.event_source WHEN 'slack' THEN coalesce(json_extract_string(q, '$.team_id'), json_extract_string(q, '$.team.id')) ELSE source_workspace_id END),
s AS (SELECT *, CASE WHEN delivery_id % 19 = 0 THEN 404 WHEN delivery_id % 17 = 0 OR event_source = 'slack' AND delivery_id % 23 = 0 THEN 401 WHEN event_source <> 'twilio' AND q IS NULL THEN 400 WHEN event_source = 'slack' AND kind = 'url_verification' THEN 200
  WHEN t IS NULL THEN CASE WHEN event_source = 'slack' THEN 200 ELSE 400 END WHEN event_source = 'twilio' THEN 204 ELSE 200 END AS status FROM k),
o AS (SELECT *, CASE WHEN status >= 400 THEN 'reject' WHEN event_source = 'slack' AND kind = 'url_verification' THEN 'challenge' WHEN t IS NULL THEN 'drop'
  WHEN event_source = 'slack' AND kind IN ('block_actions', 'view_submission', 'view_closed', 'shortcut', 'message_action') THEN 'forward' ELSE 'publish' END AS route FROM s)
SELECT delivery_id AS request_id, status, route, CASE WHEN status < 400 THEN t END AS tenant_id, CASE WHEN route = 'publish' THEN CASE WHEN event_source = 'twilio' THEN CASE WHEN delivery_id % 2 = 0 THEN 'whatsapp' ELSE 'sms' END || '.received' ELSE {_TYPE} END END AS event_type FROM o"""


@query("ref_x1_normalize", _X1)
def x1(s, d):
    """All deliveries as requests: signed, with bad and stale signatures, unknown providers, base64 bodies,
    chat in forms and missing tenants among them."""
    e = table(s, d, "canonical_events").where("raw_payload is not null").withColumn("v", payload.opened(F.col("raw_payload")))
    i, src, at = F.col("delivery_id"), F.col("event_source"), F.col("arrived_at").cast("timestamp")
    ts = (F.unix_timestamp(at) - F.when((src == "slack") & (i % 23 == 0), 1000).otherwise(0)).cast("string")
    form = F.concat(F.lit("To="), F.url_encode(F.coalesce("source_workspace_id", F.lit(""))), F.lit("&From="), F.url_encode(F.when(i % 2 == 0, "whatsapp:+1").otherwise("+1")), F.lit("&Body=a+b"))
    e = e.withColumn("sent", F.when(src == "twilio", form).when((src == "slack") & (i % 13 == 0), F.concat(F.lit("payload="), F.url_encode("raw_payload"))).otherwise(F.col("raw_payload")))
    sent, url = F.col("sent"), "https://hooks.example.test/sms"
    seal = lambda c: F.when(i % 17 == 0, "bad").otherwise(c)
    heads = F.map_filter(
        F.create_map(
            F.lit("x-slack-request-timestamp"), ts, F.lit("x-slack-signature"), seal(hashing.chat_signature("chat", ts, sent)), F.lit("x-hub-signature-256"), seal(hashing.host_signature("host", sent)), F.lit("x-jira-webhook-secret"), seal(F.lit("tracker")),
            F.lit("x-twilio-signature"), seal(requests.vendor_signature("sms", F.lit(url), payload.form_fields(sent))), F.lit("x-github-event"), _host_event(F.col("v")), F.lit("x-tenant-id"), F.when(i % 29 != 0, F.col("tenant_id")),
        ),
        lambda _, x: x.isNotNull(),
    )
    asked = F.when(i % 29 != 0, F.create_map(F.lit("tenant_id"), F.col("tenant_id")))
    body = F.when(i % 5 == 0, F.regexp_replace(F.base64(F.encode(sent, "UTF-8")), r"\s", "")).otherwise(sent)
    r = e.select(i.alias("request_id"), F.when(i % 19 == 0, "fax").otherwise(src).alias("provider_slug"), heads.alias("headers"), asked.alias("query"), body.alias("body"), (i % 5 == 0).alias("is_base64"), at.alias("received_at"))
    routes = table(s, d, "tenant_routes").groupBy("event_source", "workspace_key").agg(F.min("tenant_id").alias("tenant_id"))
    return stream.normalize(r, routes, {"slack": "chat", "github": "host", "jira": "tracker", "twilio": "sms"}, url).select("request_id", "status", "route", "tenant_id", "event_type")


# ---------------------------------------------------------------- plans


def _changes(s, d):
    """A proposed change for each symbol: right path, no path or a folder, by language; classes are created."""
    sym = latest_symbols(s, d)
    path = F.when(F.col("language") == "java", F.lit(None)).when(F.col("language") == "kotlin", paths.dirname(F.col("file_path"))).otherwise(F.col("file_path"))
    return sym.select(F.col("symbol_id").alias("change_id"), "service", path.alias("file_path"), F.concat("name", F.lit("()")).alias("symbol"), F.when(F.col("kind") == "class", "create").otherwise("modify").alias("change_type"))


@query("ref_v1_verify_changes")
def v1(s, d):
    return verify.verify_changes(_changes(s, d), table(s, d, "source_files").select("service", "file_path"), latest_symbols(s, d))


@query("ref_a13_file_lists", f"WITH {LATEST}, c AS (SELECT service, file_path, CASE WHEN kind = 'class' THEN 'create' WHEN is_method THEN 'modify' ELSE 'delete' END AS t FROM latest) SELECT service, coalesce(string_agg(DISTINCT CASE WHEN t = 'create' THEN file_path END, '|' ORDER BY CASE WHEN t = 'create' THEN file_path END), '') AS created, coalesce(string_agg(DISTINCT CASE WHEN t = 'modify' THEN file_path END, '|' ORDER BY CASE WHEN t = 'modify' THEN file_path END), '') AS modified, coalesce(string_agg(DISTINCT CASE WHEN t = 'delete' THEN file_path END, '|' ORDER BY CASE WHEN t = 'delete' THEN file_path END), '') AS deleted FROM c GROUP BY 1")
def a13(s, d):
    c = latest_symbols(s, d).select("service", "file_path", F.when(F.col("kind") == "class", "create").when(F.col("is_method"), "modify").otherwise("delete").alias("change_type"))
    x = plan_doc.files_by_type(c)
    return x.select("service", F.array_join("create_files", "|").alias("created"), F.array_join("modify_files", "|").alias("modified"), F.array_join("delete_files", "|").alias("deleted"))


@query("ref_f48_parse_plans", "SELECT name AS issue_id, true AS ok, name AS title, coalesce(summary, '(not provided)') AS summary, CASE WHEN summary IS NULL THEN 1 ELSE 0 END AS notes FROM services")
def f48(s, d):
    body = F.to_json(F.struct(F.col("name").alias("title"), "summary", F.array(F.struct(F.col("name").alias("service"))).alias("services")))
    raw = services(s, d).select(F.col("name").alias("issue_id"), F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("raw"))
    return plan_doc.parse_plans(raw).select("issue_id", "ok", "plan.title", "plan.summary", F.size("plan.open_questions").alias("notes"))


@query("ref_f52_render", "SELECT name AS issue_id, '# ' || name || chr(10) || chr(10) || coalesce(summary, '(not provided)') || chr(10) || chr(10) || '## ' || name || chr(10) || chr(10) || chr(10) || chr(10) || '| File | Symbol | Change | Description |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || CASE WHEN summary IS NULL THEN chr(10) || chr(10) || '## Open questions' || chr(10) || chr(10) || '1. summary was missing from the reply' ELSE '' END AS text FROM services")
def f52(s, d):
    body = F.to_json(F.struct(F.col("name").alias("title"), "summary", F.array(F.struct(F.col("name").alias("service"))).alias("services")))
    return plan_doc.render_markdown(plan_doc.parse_plans(services(s, d).select(F.col("name").alias("issue_id"), body.alias("raw"))).where("ok"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
