"""Queries of the general data-preparation problems (3 and 7) with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators.nested import flat_table, nested_nodes
from graphmill.operators.redelivery import repeated_deliveries
from graphmill.session import scratch, table

PAYLOADS = ["raw_payload", "structured_payload"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nested record with its event and parent; its field values are laid out too, as for the flat tables."""
    events = table(spark, sf_dir, "canonical_events")
    return nested_nodes(events, "delivery_id", PAYLOADS, with_fields=True).select("delivery_id", "payload_field", "node_path", "parent_path")


def p3_commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of changed files, each with its commit (parent) and event (key)."""
    nodes = nested_nodes(table(spark, sf_dir, "canonical_events"), "delivery_id", PAYLOADS, with_fields=True)
    return flat_table(nodes, "$.commits[].files[]", ["path", "status"])


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flat table with its rows and the deliveries they come from."""
    nodes = nested_nodes(table(spark, sf_dir, "canonical_events"), "delivery_id", PAYLOADS)
    return nodes.groupBy("payload_field", "entity").agg(F.count("*").alias("nodes"), F.countDistinct("delivery_id").alias("deliveries"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_deliveries(table(spark, sf_dir, "canonical_events"), scratch(spark, "p7-store"))


def queries() -> dict:
    return {"p3_found": p3_found, "p3_commit_files": p3_commit_files, "p3_entities": p3_entities, "p7_found": p7_found}


_NODES = (
    "f AS (SELECT delivery_id, 'raw_payload' AS payload_field, raw_payload AS t FROM canonical_events UNION ALL SELECT delivery_id, 'structured_payload', structured_payload FROM canonical_events), "
    "o AS (SELECT delivery_id, payload_field, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') ELSE t END END AS t FROM f), "
    "v AS MATERIALIZED (SELECT * FROM o WHERE json_valid(t)), "
    "n AS (SELECT v.delivery_id, payload_field, replace(j.fullkey, chr(34), '') AS node_path, j.value AS value FROM v, json_tree(v.t) j WHERE j.type = 'OBJECT' AND ends_with(j.fullkey, ']')), "
    # The nearest enclosing element: up to the last index before the node's own ones.
    "nodes AS (SELECT *, coalesce(nullif(regexp_extract(regexp_replace(node_path, '(\\[[0-9]+\\])+$', ''), '^(.*\\])', 1), ''), '$') AS parent_path FROM n)"
)

SQL = {
    "p3_found": f"WITH {_NODES} SELECT delivery_id, payload_field, node_path, parent_path FROM nodes",
    "p3_entities": f"WITH {_NODES} SELECT payload_field, regexp_replace(node_path, '\\[[0-9]+\\]', '[]', 'g') AS entity, count(*) AS nodes, count(DISTINCT delivery_id) AS deliveries FROM nodes GROUP BY 1, 2",
    "p3_commit_files": f"WITH {_NODES} SELECT delivery_id, payload_field, node_path, parent_path, json_extract_string(value, '$.path') AS path, json_extract_string(value, '$.status') AS status FROM nodes WHERE regexp_full_match(node_path, '[$][.]commits\\[[0-9]+\\][.]files\\[[0-9]+\\]')",
    "p7_found": (
        "WITH RECURSIVE ids AS (SELECT delivery_id AS d, 'e' || event_id AS k FROM canonical_events WHERE event_id IS NOT NULL "
        "UNION SELECT delivery_id, 'p' || event_source || chr(31) || tenant_id || chr(31) || lower(regexp_replace(provider_event_id, '^\\s+|\\s+$', '', 'g')) FROM canonical_events WHERE lower(regexp_replace(provider_event_id, '^\\s+|\\s+$', '', 'g')) NOT IN ('', 'null', 'undefined')), "
        "links AS (SELECT DISTINCT x.d AS a, y.d AS b FROM ids x JOIN ids y ON x.k = y.k WHERE x.d <> y.d), "
        "reach AS (SELECT DISTINCT delivery_id AS d, delivery_id AS r FROM canonical_events UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r), "
        "ranked AS (SELECT reach.d, e.delivery_id AS w, row_number() OVER (PARTITION BY reach.d ORDER BY e.received_at::TIMESTAMPTZ NULLS LAST, e.delivery_id) AS n FROM reach JOIN canonical_events e ON e.delivery_id = reach.r) "
        "SELECT d AS delivery_id FROM ranked WHERE n = 1 AND w <> d"
    ),
}


def oracle_sql() -> dict[str, str]:
    return SQL
