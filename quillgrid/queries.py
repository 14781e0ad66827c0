"""The engine's queries over the test tables, each with the SQL of its answer.

The tables hold no Markdown, so every query renders documents from rows, judges
them by a schema, and the SQL computes the expected captures from the raw columns.
Rows are spoilt by key, so that errors too have an answer.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import api
from quillgrid.sources import files
from quillgrid.streaming import chunks
from quillgrid.streaming.session import Session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
Q3 = "```"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _answer(docs: DataFrame, schema: str, captures: dict[str, str] | None = None, more: list[str] | None = None, **options) -> DataFrame:
    """id, is_valid, n_errors and captures, arrays as one text."""
    found = api.validate(docs, schema, **options)
    captures = captures if captures is not None else api.capture_types(schema)
    if captures:
        found = found.withColumn("_v", F.from_json("value", ", ".join(f"`{k}` {t}" for k, t in captures.items())))
    shown = [(F.array_join(f"_v.{k}", ";") if t.startswith("array") else F.col(f"_v.{k}")).alias(k) for k, t in captures.items()]
    return found.select("id", "is_valid", F.size("errors").cast("long").alias("n_errors"), *shown, *(F.expr(x) for x in more or []))


def query(name: str, table: str, text: str, schema: str, sql: str, key: str | None = None, **options) -> None:
    """Register a query over one table: ``text`` renders a row's document."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, table).selectExpr(f"cast({key} as bigint) as id", f"{text} as text")
        return _answer(docs, schema, **options)

    QUERIES[name], ORACLE[name] = run, sql


FIRST = ["get(errors, 0).code as code", "get(errors, 0).kind as kind", "get(errors, 0).expected as expected", "get(errors, 0).actual as actual"]
MONEY = "cast(cast(o_totalprice as decimal(15,2)) as string)"
CARD = f"concat('# Order ', o_orderkey, '\\n\\nTotal: ', {MONEY})"
CARD_SCHEMA = "# Order `order:/[0-9]+/`\n\nTotal: `total:/[0-9.]+/`"
CARD_SQL = """SELECT CAST(o_orderkey AS BIGINT) AS id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, CAST(o_orderkey AS VARCHAR) AS "order",
  CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS total FROM orders"""

query("extract_heading_matcher", "orders", CARD, CARD_SCHEMA, CARD_SQL, "o_orderkey")
query("extract_by_trees", "orders", CARD, CARD_SCHEMA, CARD_SQL, "o_orderkey", path="trees")
query(
    "extract_prefix_suffix", "customer", "concat('Segment ', c_mktsegment, ' (', c_nationkey, ')')", "Segment `segment:/[A-Z]+/` (7)",
    """SELECT CAST(c_custkey AS BIGINT) AS id, c_nationkey = 7 AS is_valid, CAST(CASE WHEN c_nationkey = 7 THEN 0 ELSE 1 END AS BIGINT) AS n_errors, c_mktsegment AS segment,
    CASE WHEN c_nationkey <> 7 THEN 'NodeContentMismatch' END AS code, CASE WHEN c_nationkey <> 7 THEN 'Suffix' END AS kind,
    CASE WHEN c_nationkey <> 7 THEN ' (7)' END AS expected, CASE WHEN c_nationkey <> 7 THEN ' (' || c_nationkey || ')' END AS actual FROM customer""",
    "c_custkey", more=FIRST,
)
query("extract_all_matcher", "part", "concat('Name: ', p_name)", "Name: `name`", "SELECT CAST(p_partkey AS BIGINT) AS id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, p_name AS name FROM part", "p_partkey")
query(
    "regex_mismatch_errors", "orders", "concat('# Order ', if(o_orderkey % 7 = 0, 'x', ''), o_orderkey)", "# Order `order:/[0-9]+/`",
    """SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 7 <> 0 AS is_valid, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_errors,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS "order", CASE WHEN o_orderkey % 7 = 0 THEN 'NodeContentMismatch' END AS code,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Matcher' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN '^[0-9]+' END AS expected,
    CASE WHEN o_orderkey % 7 = 0 THEN 'x' || o_orderkey END AS actual FROM orders""",
    "o_orderkey", more=FIRST,
)
query(
    "prefix_mismatch_errors", "orders", "concat(if(o_orderkey % 5 = 0, 'Bestellung ', 'Order '), o_orderkey)", "Order `order:/[0-9]+/`",
    """SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 5 <> 0 AS is_valid, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_errors,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS "order", CASE WHEN o_orderkey % 5 = 0 THEN 'NodeContentMismatch' END AS code,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Prefix' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'Order ' END AS expected,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Bestel' END AS actual FROM orders""",
    "o_orderkey", more=FIRST,
)
query("literal_text_match", "nation", "concat('# Nation\\n\\nfixed text ', n_nationkey - n_nationkey)", "# Nation\n\nfixed text 0", "SELECT CAST(n_nationkey AS BIGINT) AS id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors FROM nation", "n_nationkey")
query(
    "literal_text_mismatch", "orders", "concat('status ', o_orderstatus)", "status F",
    """SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus = 'F' AS is_valid, CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS BIGINT) AS n_errors,
    CASE WHEN o_orderstatus <> 'F' THEN 'Literal' END AS kind, CASE WHEN o_orderstatus <> 'F' THEN 'status ' || o_orderstatus END AS actual FROM orders""",
    "o_orderkey", more=["get(errors, 0).kind as kind", "get(errors, 0).actual as actual"],
)
query(
    "literal_code", "part", "concat('Brand `', p_brand, '` sold')", "Brand `Brand#17`! sold",
    "SELECT CAST(p_partkey AS BIGINT) AS id, p_brand = 'Brand#17' AS is_valid, CAST(CASE WHEN p_brand = 'Brand#17' THEN 0 ELSE 1 END AS BIGINT) AS n_errors FROM part",
    "p_partkey",
)
query(
    "literal_code_matcher", "part", "concat('`', p_brand, '`')", "`{brand:/Brand#[0-9]+/}`!",
    "SELECT CAST(p_partkey AS BIGINT) AS id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, p_brand AS brand FROM part",
    "p_partkey", captures={"brand": "string"},
)
query(
    "strong_emphasis_literal", "part", "concat('type **', p_type, '**')", "type **ECONOMY**",
    """SELECT CAST(p_partkey AS BIGINT) AS id, p_type = 'ECONOMY' AS is_valid, CAST(CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END AS BIGINT) AS n_errors,
    CASE WHEN p_type <> 'ECONOMY' THEN 3 END AS input_index, CASE WHEN p_type <> 'ECONOMY' THEN '**' || p_type || '**' END AS actual FROM part""",
    "p_partkey", more=["get(errors, 0).input_index as input_index", "get(errors, 0).actual as actual"],
)
query(
    "list_literal", "orders", "concat('- ', o_orderstatus, '\\n- ', o_orderpriority)", "- O\n- `priority:/[1-5]-[A-Z ]+/`",
    """SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus = 'O' AS is_valid, CAST(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS BIGINT) AS n_errors,
    CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS priority FROM orders""",
    "o_orderkey",
)
query(
    "list_kind_mismatch", "orders", "concat(if(o_orderkey % 3 = 0, '1. ', '- '), 'item ', o_orderkey)", "- `item:/item [0-9]+/`",
    """SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 3 <> 0 AS is_valid, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_errors,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'item ' || o_orderkey END AS item, CASE WHEN o_orderkey % 3 = 0 THEN 'tight_list(-)' END AS expected,
    CASE WHEN o_orderkey % 3 = 0 THEN 'tight_list(1.)' END AS actual FROM orders""",
    "o_orderkey", more=["get(errors, 0).expected as expected", "get(errors, 0).actual as actual"],
)

_LINES = "SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn, l_partkey AS p, CAST(l_quantity AS INT) AS q FROM lineitem"


def per_order(name: str, item: str, lead: str, schema: str, sql: str, between: str = "\n", **options) -> None:
    """A document for each order: ``item`` renders a line, in order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = _table(spark, sf_dir, "lineitem")
        order = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", F.expr(f"{item}").alias("t"))
        packed = lines.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_partkey as p", "cast(l_quantity as int) as q", "l_orderkey as id").groupBy("id").agg(F.sort_array(F.collect_list(order)).alias("a"))
        docs = packed.select("id", F.concat(F.lit(lead), F.array_join(F.col("a.t"), between)).alias("text"))
        return _answer(docs, schema, **options)

    QUERIES[name], ORACLE[name] = run, sql


per_order(
    "list_repeat_bounds", "concat('- part ', p)", "", "- `line:/part [0-9]+/`{2,5}",
    f"""SELECT id, count(*) BETWEEN 2 AND 5 AS is_valid, CAST(CASE WHEN count(*) BETWEEN 2 AND 5 THEN 0 ELSE 1 END AS BIGINT) AS n_errors,
    string_agg('part ' || p, ';' ORDER BY rn) FILTER (rn <= 5) AS line, CASE WHEN count(*) NOT BETWEEN 2 AND 5 THEN 'ChildrenLengthMismatch' END AS code,
    CAST(CASE WHEN count(*) < 2 THEN 1 WHEN count(*) > 5 THEN 6 END AS INTEGER) AS received FROM ({_LINES}) GROUP BY id""",
    more=["get(errors, 0).code as code", "get(errors, 0).received as received"],
)
per_order(
    "list_stacked", "concat('- part ', p)", "", "- `head:/part [0-9]+/`{2,2}\n- `rest:/part [0-9]+/`{1,}",
    f"""SELECT id, count(*) >= 2 AS is_valid, CAST(CASE WHEN count(*) < 2 THEN 1 ELSE 0 END AS BIGINT) AS n_errors,
    string_agg('part ' || p, ';' ORDER BY rn) FILTER (rn <= 2) AS head,
    string_agg('part ' || p, ';' ORDER BY rn) FILTER (rn > 2) AS rest, CASE WHEN count(*) < 2 THEN 'ChildrenLengthMismatch' END AS code FROM ({_LINES}) GROUP BY id""",
    more=["get(errors, 0).code as code"],
)
per_order(
    "list_nested_capture", "concat('    - part ', p)", "- order\n", "- `order:/[a-z]+/`{1,1}\n    - `line:/part [0-9]+/`{1,}",
    f"""SELECT id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, '{{"order":["order",{{"line":[' || string_agg('"part ' || p || '"', ',' ORDER BY rn) || ']}}]}}' AS value FROM ({_LINES}) GROUP BY id""",
    captures={}, more=["value"],
)
per_order(
    "table_repeat_rows", "concat('| ', p, ' | ', q, ' |')", "| Part | Qty |\n|---|---|\n", "| Part | Qty |\n|---|---|\n| `part:/[0-9]+/` | `qty:/[0-9]+/` |{1,}",
    f"""SELECT id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, string_agg(CAST(p AS VARCHAR), ';' ORDER BY rn) AS part, string_agg(CAST(q AS VARCHAR), ';' ORDER BY rn) AS qty FROM ({_LINES}) GROUP BY id""",
)
per_order(
    "table_row_errors", "concat('| ', p, ' | ', if(p % 50 = 0, 'many', string(q)), ' |')", "| Part | Qty |\n|---|---|\n", "| Part | Qty |\n|---|---|\n| `part:/[0-9]+/` | `qty:/[0-9]+/` |{1,}",
    f"""SELECT id, NOT bool_or(p % 50 = 0) AS is_valid, CAST(CASE WHEN bool_or(p % 50 = 0) THEN 1 ELSE 0 END AS BIGINT) AS n_errors,
    CASE WHEN NOT bool_or(p % 50 = 0) THEN string_agg(CAST(p AS VARCHAR), ';' ORDER BY rn) END AS part,
    CASE WHEN NOT bool_or(p % 50 = 0) THEN string_agg(CAST(q AS VARCHAR), ';' ORDER BY rn) END AS qty,
    CAST(min(CASE WHEN p % 50 = 0 THEN 13 + 5 * (rn - 1) END) AS INTEGER) AS input_index FROM ({_LINES}) GROUP BY id""",
    more=["get(errors, 0).input_index as input_index"],
)
per_order(
    "table_footer", "concat('| ', p, ' | ', q, ' |')", "| Part | Qty |\n|---|---|\n| head | 0 |\n", "| Part | Qty |\n|---|---|\n| head | 0 |\n| `part:/[0-9]+/` | `qty:/[0-9]+/` |{,}\n| `last:/[0-9]+/` | `lastqty` |",
    f"""SELECT id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, string_agg(CAST(p AS VARCHAR), ';' ORDER BY rn) FILTER (rn < n) AS part, string_agg(CAST(q AS VARCHAR), ';' ORDER BY rn) FILTER (rn < n) AS qty,
    max(CAST(p AS VARCHAR)) FILTER (rn = n) AS last, max(CAST(q AS VARCHAR)) FILTER (rn = n) AS lastqty FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM ({_LINES})) GROUP BY id""",
    captures={"part": "array<string>", "qty": "array<string>", "last": "string", "lastqty": "string"},
)
query(
    "table_header_match", "nation", "concat('| Key | ', n_name, ' |\\n|:-|-:|\\n| ', n_nationkey, ' | ', n_regionkey, ' |')", "| Key | NATION_`n:/[0-9]+/` |\n|---|---|\n| `key:/[0-9]+/` | `region:/[0-9]+/` |",
    "SELECT CAST(n_nationkey AS BIGINT) AS id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, replace(n_name, 'NATION_', '') AS n, CAST(n_nationkey AS VARCHAR) AS key, CAST(n_regionkey AS VARCHAR) AS region FROM nation",
    "n_nationkey",
)
query(
    "fence_capture", "events", f"concat('{Q3}json\\n', props, '\\n{Q3}')", f"{Q3}{{lang:/[a-z]+/}}\n{{props}}\n{Q3}",
    "SELECT CAST(event_id AS BIGINT) AS id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, 'json' AS lang, props FROM events",
    "event_id",
)
query(
    "fence_mismatch", "events", f"concat('{Q3}', if(event_id % 4 = 0, 'yaml', 'json'), '\\n', event_type, '\\n{Q3}')", f"{Q3}json\nclick\n{Q3}",
    """SELECT CAST(event_id AS BIGINT) AS id, event_id % 4 <> 0 AND event_type = 'click' AS is_valid,
    CAST(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END AS BIGINT) AS n_errors FROM events""",
    "event_id",
)
query(
    "quote_and_ruler", "nation", "concat('> Nation ', n_name, '\\n\\n---')", "> Nation `nation:/.+/`\n\n---",
    "SELECT CAST(n_nationkey AS BIGINT) AS id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, n_name AS nation FROM nation",
    "n_nationkey",
)
query(
    "ruler_match", "region", "if(r_regionkey = 1, '***', if(r_regionkey = 2, 'text', '---'))", "---",
    """SELECT CAST(r_regionkey AS BIGINT) AS id, r_regionkey <> 2 AS is_valid, CAST(CASE WHEN r_regionkey = 2 THEN 1 ELSE 0 END AS BIGINT) AS n_errors,
    CASE WHEN r_regionkey = 2 THEN 'NodeTypeMismatch' END AS code FROM region""",
    "r_regionkey", more=["get(errors, 0).code as code"],
)
query(
    "link_url_matcher", "pages", "concat('[page](', url, ')')", "[page]({url:/https?:.+/})",
    "SELECT CAST(page_id AS BIGINT) AS id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, url FROM pages",
    "page_id",
)
query(
    "image_alt_matcher", "pages", "concat('![page ', page_id, '](image.png)')", "![{alt:/page [0-9]+/}](image.png)",
    "SELECT CAST(page_id AS BIGINT) AS id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, 'page ' || page_id AS alt FROM pages",
    "page_id", captures={"alt": "string"},
)
query(
    "heading_level_mismatch", "region", "concat(repeat('#', r_regionkey + 1), ' ', r_name)", "## `name:/[A-Z ]+/`",
    """SELECT CAST(r_regionkey AS BIGINT) AS id, r_regionkey = 1 AS is_valid, CAST(CASE WHEN r_regionkey = 1 THEN 0 ELSE 1 END AS BIGINT) AS n_errors, CASE WHEN r_regionkey = 1 THEN r_name END AS name,
    CASE WHEN r_regionkey <> 1 THEN 'atx_heading(atx_h2_marker)' END AS expected, CASE WHEN r_regionkey <> 1 THEN 'atx_heading(atx_h' || (r_regionkey + 1) || '_marker)' END AS actual FROM region""",
    "r_regionkey", more=["get(errors, 0).expected as expected", "get(errors, 0).actual as actual"],
)
query(
    "block_count_mismatch", "region", "concat('# ', r_name, repeat('\\n\\nmore', r_regionkey))", "# `name:/.+/`\n\nmore",
    """SELECT CAST(r_regionkey AS BIGINT) AS id, r_regionkey = 1 AS is_valid, CAST(abs(r_regionkey - 1) AS BIGINT) AS n_errors, r_name AS name,
    CASE WHEN r_regionkey = 0 THEN 'SchemaHasChildInputDoesnt' WHEN r_regionkey > 1 THEN 'InputHasChildSchemaDoesnt' END AS kind FROM region""",
    "r_regionkey", more=["get(errors, 0).kind as kind"],
)
query(
    "capture_merge_last_wins", "supplier", "concat('# ', s_name, '\\n\\n', s_nationkey)", "# `x:/.+/`\n\n`x:/[0-9]+/`",
    "SELECT CAST(s_suppkey AS BIGINT) AS id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, CAST(s_nationkey AS VARCHAR) AS x FROM supplier",
    "s_suppkey",
)
query(
    "schema_errors", "region", "r_name", "`a:/x/` and `b:/y/`",
    "SELECT CAST(r_regionkey AS BIGINT) AS id, false AS is_valid, 'MultipleMatchersInNodeChildren' AS code, 2 AS received, 'SchemaError' AS category FROM region",
    "r_regionkey", captures={}, more=["get(errors, 0).code as code", "get(errors, 0).received as received", "get(errors, 0).category as category"],
)
_drop = QUERIES["schema_errors"]
QUERIES["schema_errors"] = lambda spark, sf_dir: _drop(spark, sf_dir).drop("n_errors")


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z ]", ""))), lambda x: x != "")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.coalesce(lines, F.array()), "\n\n").alias("text"))
    return _answer(docs, "`para`{1,}", {"para": "array<string>"})


QUERIES["paragraph_repeat"] = _paragraphs
ORACLE["paragraph_repeat"] = """WITH l AS (SELECT doc_id AS id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[^A-Za-z ]', '', 'g'))), lambda x: x <> '') AS a FROM documents)
SELECT id, coalesce(len(a), 0) > 0 AS is_valid, CAST(CASE WHEN coalesce(len(a), 0) > 0 THEN 0 ELSE 1 END AS BIGINT) AS n_errors, CASE WHEN len(a) > 0 THEN array_to_string(a, ';') END AS para FROM l"""


def _by_row_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as bigint) as id", f"{CARD} as text", "if(o_orderkey % 2 = 0, '# Order `order:/[0-9]+/`\\n\\nTotal: `total:/[0-9.]+/`', '# Order `order`\\n\\nSum: `total`') as schema")
    return _answer(docs, "", {"order": "string", "total": "string"}, schema_column="schema")


QUERIES["schema_per_row"] = _by_row_schema
ORACLE["schema_per_row"] = """SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 2 = 0 AS is_valid, CAST(o_orderkey % 2 AS BIGINT) AS n_errors, CAST(o_orderkey AS VARCHAR) AS "order",
CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) END AS total FROM orders"""


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"concat(if(o_orderkey % 7 = 0, '', concat('# Order ', o_orderkey, '\\n\\n')), 'Total: ', if(o_orderkey % 5 = 0, 'none', {MONEY}))"
    return _table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as bigint) as id", f"{text} as text")


QUERIES["document_validity_rate"] = lambda spark, sf_dir: api.validate(_spoilt(spark, sf_dir), CARD_SCHEMA).agg(F.count("*").alias("n"), F.count_if("is_valid").alias("n_valid"))
ORACLE["document_validity_rate"] = "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0) AS n_valid FROM orders"
QUERIES["error_code_histogram"] = lambda spark, sf_dir: api.errors(api.validate(_spoilt(spark, sf_dir), CARD_SCHEMA), "id").groupBy("code", "kind").agg(F.count("*").alias("n"))
ORACLE["error_code_histogram"] = """SELECT code, kind, count(*) AS n FROM (
SELECT 'NodeTypeMismatch' AS code, NULL AS kind FROM orders WHERE o_orderkey % 7 = 0 UNION ALL
SELECT 'MalformedNodeStructure', 'SchemaHasChildInputDoesnt' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL
SELECT 'NodeContentMismatch', 'Matcher' FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0) GROUP BY ALL"""
QUERIES["node_kind_counts"] = lambda spark, sf_dir: api.nodes(_table(spark, sf_dir, "orders").selectExpr(f"{CARD} as text"), fields=("kind", "idx")).groupBy("kind").agg(F.count("*").alias("n"), F.max("idx").cast("int").alias("last"))
ORACLE["node_kind_counts"] = """SELECT kind, count(*) * k AS n, CAST(last AS INTEGER) AS last FROM orders, (VALUES ('document', 1, 0), ('atx_heading', 1, 1), ('atx_h1_marker', 1, 2), ('heading_content', 1, 3), ('text', 2, 6), ('paragraph', 1, 5)) AS t(kind, k, last) GROUP BY kind, k, last"""


def _folder(spark: SparkSession) -> str:
    """A folder of this run below the shared one, which Spark's JVM deletes at its end.

    Only a local session has a folder of its own where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillgrid-")
    path = f"{base.rstrip('/')}/quillgrid-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(at)  # only what is there can be marked
    system.deleteOnExit(at)
    return f"{path}/data"


def _streamed(spark: SparkSession, docs: DataFrame, schema: str, **options) -> DataFrame:
    folder = _folder(spark)
    cut = files.cut_chunks(docs.withColumnRenamed("id", "doc_id"), 9)
    wide = max(1, spark.sparkContext.defaultParallelism // 4)  # two batches, on any number of cores
    cut.repartition(4 * wide, "seq", F.pmod(F.xxhash64("doc_id"), F.lit(wide))).write.parquet(f"{folder}/chunks")
    return chunks.run_to_end(files.read_chunks(spark, f"{folder}/chunks", 2 * wide), schema, f"{folder}/run", **options)


def _stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as bigint) as id", f"{CARD} as text")
    found = _streamed(spark, docs, CARD_SCHEMA).where("status = 'complete'")
    return found.select(F.col("doc_id").cast("long").alias("id"), "is_valid", F.get_json_object("value", "$.order").alias("order"), F.get_json_object("value", "$.total").alias("total"))


QUERIES["stream_chunks_equals_batch"] = _stream_equals_batch
ORACLE["stream_chunks_equals_batch"] = """SELECT CAST(o_orderkey AS BIGINT) AS id, true AS is_valid, CAST(o_orderkey AS VARCHAR) AS "order", CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS total FROM orders"""


def _stream_fast_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as id", "concat('# ', if(n_nationkey % 3 = 0, 'Land ', 'Nation '), n_name, '\\n\\n', repeat('word ', 40)) as text")
    found = _streamed(spark, docs, "# Nation `name:/[A-Z_0-9]+/`\n\n`body`", fast_fail=True).where("status <> 'late'")
    return found.select(F.col("doc_id").cast("long").alias("id"), "is_valid").distinct()


QUERIES["stream_fast_fail"] = _stream_fast_fail
ORACLE["stream_fast_fail"] = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 3 <> 0 AS is_valid FROM nation"


def _stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that come after a document's end are reported, and change nothing."""
    folder = _folder(spark)
    nations = _table(spark, sf_dir, "nation")
    whole = nations.selectExpr("cast(n_nationkey as bigint) as doc_id", "0 as seq", "concat('# Nation ', n_name) as chunk", "true as eof")
    after = nations.selectExpr("cast(n_nationkey as bigint) as doc_id", "explode(sequence(1, n_nationkey % 3)) as seq", "'more' as chunk", "false as eof").where("doc_id % 3 > 0")
    for part in (whole, after):  # one file each, in this order
        part.coalesce(1).write.mode("append").parquet(f"{folder}/chunks")
    found = chunks.run_to_end(files.read_chunks(spark, f"{folder}/chunks", 1), "# Nation `name:/[A-Z_0-9]+/`", f"{folder}/run")
    return found.select(F.col("doc_id").cast("long").alias("id"), "status", "is_valid", F.col("n_errors").cast("long").alias("n"), F.get_json_object("value", "$.name").alias("name"))


QUERIES["stream_late_chunks"] = _stream_late
ORACLE["stream_late_chunks"] = """SELECT CAST(n_nationkey AS BIGINT) AS id, 'complete' AS status, true AS is_valid, CAST(0 AS BIGINT) AS n, n_name AS name FROM nation
UNION ALL SELECT n_nationkey, 'late', NULL, n_nationkey % 3, NULL FROM nation WHERE n_nationkey % 3 > 0"""


def _stream_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of many blocks in small chunks: each batch goes on where the last ended."""
    lines = _table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as id", "concat('# ', n_name, '\n\n', array_join(transform(sequence(1, 20), i -> concat('line ', i * n_nationkey)), '\n\n'), '\n\n## ', if(n_nationkey % 4 = 0, 'No', 'End')) as text")
    found = _streamed(spark, lines, "# `name:/.+/`\n\n`line`{20,20}\n\n## End").where("status = 'complete'")
    return found.select(F.col("doc_id").cast("long").alias("id"), "is_valid", F.col("n_errors").cast("long").alias("n"), F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.line[19]").alias("line"))


QUERIES["stream_growing_blocks"] = _stream_growing
ORACLE["stream_growing_blocks"] = """SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 4 <> 0 AS is_valid, CAST(CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n, n_name AS name, 'line ' || (20 * n_nationkey) AS line FROM nation"""

# -- sources, sinks and one document at hand -------------------------------------


def _file_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, a file each, read whole."""
    folder = _folder(spark)
    docs = _table(spark, sf_dir, "nation").selectExpr("n_nationkey", "concat('# Nation ', n_name, if(n_nationkey % 5 = 0, '\n\nmore', '')) as value")
    docs.write.partitionBy("n_nationkey").text(folder)
    found = api.validate(files.read_documents(spark, folder, "*.txt"), "# Nation `name:/.+/`")
    return found.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("long").alias("id"), "is_valid", F.get_json_object("value", "$.name").alias("name"))


QUERIES["file_source"] = _file_source
ORACLE["file_source"] = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 5 <> 0 AS is_valid, n_name AS name FROM nation"


def _sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sinks hold: captures of valid documents, errors of the others, and, when
    quiet, nothing."""
    folder = _folder(spark)
    api.validate(_spoilt(spark, sf_dir), CARD_SCHEMA).select("id", "is_valid", "value", "errors").write.parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")  # judged once for all sinks
    files.write_matches(found, f"{folder}/matches")
    files.write_matches(found, f"{folder}/quiet", quiet=True)
    files.write_errors(found, f"{folder}/errors", "id")
    matches = spark.read.text(f"{folder}/matches").select(F.get_json_object("value", "$.order").cast("long").alias("id"), F.lit("match").alias("sink"), F.get_json_object("value", "$.total").alias("shown"))
    wrong = spark.read.schema("id long, code string, kind string").json(f"{folder}/errors").select("id", F.lit("error").alias("sink"), F.concat_ws(" ", "code", "kind").alias("shown"))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/quiet")
    silent = not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return matches.union(wrong).where(F.lit(silent))


QUERIES["sinks"] = _sinks
ORACLE["sinks"] = """SELECT CAST(o_orderkey AS BIGINT) AS id, 'match' AS sink, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS shown FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 'error', 'NodeTypeMismatch' FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 'error', 'MalformedNodeStructure SchemaHasChildInputDoesnt' FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 'error', 'NodeContentMismatch Matcher' FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in words, with line and column."""
    docs = _table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as id", "concat('# ', n_name, '\n\ncode ', if(n_nationkey % 2 = 0, 'x', string(n_nationkey))) as text")
    return api.reports(api.validate(docs, "# `name:/.+/`\n\ncode `code:/[0-9]+/`")).select("id", "report")


QUERIES["reports_in_words"] = _reports
ORACLE["reports_in_words"] = """SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 2 = 0 THEN '3:1: Text should match ^[0-9]+, but has ' || chr(39) || 'x' || chr(39) END AS report FROM nation"""


def _raw_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as they are, every field, as JSON."""
    return api.errors(api.validate(_spoilt(spark, sf_dir), CARD_SCHEMA), "id").where("code = 'NodeContentMismatch'").select("id", F.to_json(F.struct("category", "code", "schema_index", "input_index", "expected", "actual", "kind")).alias("raw"))


QUERIES["raw_errors"] = _raw_errors
ORACLE["raw_errors"] = """SELECT CAST(o_orderkey AS BIGINT) AS id, '{"category":"SchemaViolation","code":"NodeContentMismatch","schema_index":8,"input_index":6,"expected":"^[0-9.]+","actual":"none","kind":"Matcher"}' AS raw
FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0"""


def _one_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The helper for one document, a session and the operator, on each nation's text."""
    schema = "# `name:/[A-Z_0-9]+/`"
    rows = [(r.n_nationkey, f"# {r.n_name}" if r.n_nationkey % 2 else "text") for r in _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]
    out = []
    for key, text in rows:
        valid, value, errors = api.judged(schema, text)
        one = Session.of(schema, text)
        out.append((key, valid and one.is_valid, value if value == one.json else "differs", len(errors) + len(one.errors)))
    return spark.createDataFrame(out, "id long, is_valid boolean, value string, n long")


QUERIES["one_document_at_hand"] = _one_document
ORACLE["one_document_at_hand"] = """SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 2 = 1 AS is_valid, CASE WHEN n_nationkey % 2 = 1 THEN '{"name":"' || n_name || '"}' ELSE '{}' END AS value, CAST(CASE WHEN n_nationkey % 2 = 1 THEN 0 ELSE 2 END AS BIGINT) AS n FROM nation"""


def _farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.farthest(_spoilt(spark, sf_dir), CARD_SCHEMA).select("id", "schema_reach", "input_reach")


QUERIES["farthest_position"] = _farthest
ORACLE["farthest_position"] = """SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 9 END AS schema_reach, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 6 END AS input_reach FROM orders"""


def _node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function, from SQL."""
    api.register(spark)
    name = f"nations_{uuid.uuid4().hex}"
    _table(spark, sf_dir, "nation").selectExpr("n_nationkey", "concat('# ', n_name) as text").createOrReplaceTempView(name)
    return spark.sql(f"SELECT CAST(n_nationkey AS BIGINT) AS id, n.idx, n.parent, n.kind, n.text FROM {name}, LATERAL md_nodes(text) n WHERE n.kind IN ('heading_content', 'text')")


QUERIES["nodes_from_sql"] = _node_table
ORACLE["nodes_from_sql"] = """SELECT CAST(n_nationkey AS BIGINT) AS id, 3 AS idx, 1 AS parent, 'heading_content' AS kind, ' ' || n_name AS text FROM nation
UNION ALL SELECT n_nationkey, 4, 3, 'text', n_name FROM nation"""

# -- the rest of the schema language ----------------------------------------------

_VALID = lambda ok: f"{ok} AS is_valid, CAST(CASE WHEN {ok} THEN 0 ELSE 1 END AS BIGINT) AS n_errors"
_CODE = ["get(errors, 0).code as code"]
_KIND = ["get(errors, 0).code as code", "get(errors, 0).kind as kind"]
query("alternation_anchor", "part", "concat('x', p_size, 'a')", "`hit:/x1|2a/`", "SELECT CAST(p_partkey AS BIGINT) AS id, " + _VALID("(CAST(p_size AS VARCHAR) LIKE '1%' OR p_size % 10 = 2)") + ", CASE WHEN CAST(p_size AS VARCHAR) LIKE '1%' THEN 'x1' WHEN p_size % 10 = 2 THEN '2a' END AS hit FROM part", "p_partkey")
query("anonymous_regex", "orders", "concat('# ', if(o_orderkey % 6 = 0, 'x', ''), o_orderkey)", "# `/[0-9]+/`", "SELECT CAST(o_orderkey AS BIGINT) AS id, " + _VALID("o_orderkey % 6 <> 0") + ", CASE WHEN o_orderkey % 6 <> 0 THEN '{}' END AS shown FROM orders", "o_orderkey", captures={}, more=["if(is_valid, value, null) as shown"])
query("underscore_captured", "nation", "concat('# ', n_name)", "# `_:/.+/`", "SELECT CAST(n_nationkey AS BIGINT) AS id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, '{\"_\":\"' || n_name || '\"}' AS value FROM nation", "n_nationkey", captures={}, more=["value"])
query("underscore_dropped", "nation", "concat('# ', n_name, '\n\n', n_regionkey)", "# `_:/.+/`\n\n`region:/[0-9]+/`", "SELECT CAST(n_nationkey AS BIGINT) AS id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors, '{\"region\":\"' || n_regionkey || '\"}' AS value FROM nation", "n_nationkey", captures={}, more=["value"], drop_underscore=True)
query("mixed_literal_mark", "region", "concat('`', r_name, '`')", "`AFRICA`!!", "SELECT CAST(r_regionkey AS BIGINT) AS id, false AS is_valid, 'MatcherError' AS code, 'MixedLiteralAndOthers' AS kind FROM region", "r_regionkey", captures={}, more=_KIND)
query("plus_and_question_mark", "nation", "concat('n ', n_nationkey, if(n_regionkey = 1, '?', ''))", "n `key:/[0-9]+/`+?", "SELECT CAST(n_nationkey AS BIGINT) AS id, " + _VALID("n_regionkey = 1") + ", CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_regionkey <> 1 THEN 'Suffix' END AS kind FROM nation", "n_nationkey", more=["get(errors, 0).kind as kind"])
query("matcher_shown_in_errors", "region", "r_name", "x `id:/a+b/`", "SELECT CAST(r_regionkey AS BIGINT) AS id, false AS is_valid, CAST(1 AS BIGINT) AS n_errors, 'x ' AS expected, 'Prefix' AS kind FROM region", "r_regionkey", captures={}, more=["get(errors, 0).expected as expected", "get(errors, 0).kind as kind"])
query("repeat_in_container", "region", "concat('# ', r_name)", "# `a:/[A-Z]+/`{1,2}", "SELECT CAST(r_regionkey AS BIGINT) AS id, false AS is_valid, CAST(1 AS BIGINT) AS n_errors, 'RepeatingMatcherInTextContainer' AS code FROM region", "r_regionkey", captures={}, more=_CODE)
query("list_bad_regex", "region", "concat('- ', r_name)", "- `a:/(/`{1,2}", "SELECT CAST(r_regionkey AS BIGINT) AS id, false AS is_valid, CAST(1 AS BIGINT) AS n_errors, 'MatcherError' AS code, 'InteriorRegexInvalid' AS kind FROM region", "r_regionkey", captures={}, more=_KIND)
query("list_unbounded_guard", "region", "concat('- ', r_name, '\n- end')", "- `a:/[A-Z ]+/`{1,}\n- end", "SELECT CAST(r_regionkey AS BIGINT) AS id, false AS is_valid, CAST(1 AS BIGINT) AS n_errors, 'RepeatingMatcherUnbounded' AS code FROM region", "r_regionkey", captures={}, more=_CODE)
query("list_literal_nested", "nation", "concat('- top\n    - key ', if(n_regionkey = 0, 'x', string(n_nationkey)), '\n- end')", "- top\n    - key `key:/[0-9]+/`\n- end", "SELECT CAST(n_nationkey AS BIGINT) AS id, " + _VALID("n_regionkey <> 0") + ", CASE WHEN n_regionkey <> 0 THEN CAST(n_nationkey AS VARCHAR) END AS key FROM nation", "n_nationkey")
query("list_marker_only", "nation", "concat('- a\n-', if(n_regionkey = 0, ' b', ''))", "- a\n-", "SELECT CAST(n_nationkey AS BIGINT) AS id, " + _VALID("n_regionkey <> 0") + ", CASE WHEN n_regionkey = 0 THEN 'MalformedNodeStructure' END AS code, CASE WHEN n_regionkey = 0 THEN 'HadExtraListItem' END AS kind FROM nation", "n_nationkey", more=_KIND)
query("list_missing_content", "nation", "concat('- a\n-', if(n_regionkey = 0, '', ' b'))", "- a\n- b", "SELECT CAST(n_nationkey AS BIGINT) AS id, " + _VALID("n_regionkey <> 0") + ", CASE WHEN n_regionkey = 0 THEN 'MissingListItemContent' END AS kind FROM nation", "n_nationkey", more=["get(errors, 0).kind as kind"])
query("list_long_literal", "nation", "concat(array_join(transform(sequence(1, 2000), i -> concat('- item ', if(n_regionkey = 0 and i = 1500, 0, i))), '\n'))", "\n".join(f"- item {i}" for i in range(1, 2001)), "SELECT CAST(n_nationkey AS BIGINT) AS id, " + _VALID("n_regionkey <> 0") + ", CASE WHEN n_regionkey = 0 THEN 'item 1500' END AS expected FROM nation", "n_nationkey", more=["get(errors, 0).expected as expected"])
query("list_long_literal_by_trees", "nation", "concat(array_join(transform(sequence(1, 2000), i -> concat('- item ', i)), '\n'))", "\n".join(f"- item {i}" for i in range(1, 2001)), "SELECT CAST(n_nationkey AS BIGINT) AS id, true AS is_valid, CAST(0 AS BIGINT) AS n_errors FROM nation", "n_nationkey", path="trees")
query(
    "table_column_count", "nation", "concat('| a | b |\n|---|---|\n| ', n_nationkey, ' | ', n_regionkey, if(n_regionkey = 0, ' | x | y |', if(n_regionkey = 1, '', ' |')))", "| a | b |\n|---|---|\n| `k:/[0-9]+/` | `r:/[0-9]+/` |",
    """SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey <> 0 AS is_valid, CAST(CASE WHEN n_regionkey = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_errors, CAST(n_nationkey AS VARCHAR) AS k, CAST(n_regionkey AS VARCHAR) AS r,
    CASE WHEN n_regionkey = 0 THEN 'InputHasChildSchemaDoesnt' END AS kind FROM nation""",
    "n_nationkey", more=["get(errors, 0).kind as kind"],
)
query(
    "table_missing_column", "nation", "concat('| a | b |\n|---|---|\n| ', n_nationkey, if(n_regionkey = 0, ' |', ' | x |'))", "| a | b |\n|---|---|\n| `k:/[0-9]+/` | x |",
    "SELECT CAST(n_nationkey AS BIGINT) AS id, " + _VALID("n_regionkey <> 0") + ", CAST(n_nationkey AS VARCHAR) AS k, CASE WHEN n_regionkey = 0 THEN 'SchemaHasChildInputDoesnt' END AS kind FROM nation",
    "n_nationkey", more=["get(errors, 0).kind as kind"],
)
query(
    "table_row_count", "nation", "concat('| a |\n|---|', repeat('\n| x |', n_regionkey))", "| a |\n|---|\n| x |\n| x |",
    """SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey = 2 AS is_valid, CAST(CASE WHEN n_regionkey < 2 THEN 1 ELSE n_regionkey - 2 END AS BIGINT) AS n_errors,
    CASE WHEN n_regionkey < 2 THEN 'SchemaHasChildInputDoesnt' WHEN n_regionkey > 2 THEN 'InputHasChildSchemaDoesnt' END AS kind FROM nation""",
    "n_nationkey", more=["get(errors, 0).kind as kind"],
)
_ROWS = "concat('| a |\n|---|', repeat('\n| 7 |', n_regionkey))"
query("table_min_rows", "nation", _ROWS, "| a |\n|---|\n| `n:/[0-9]+/` |{2,3}", """SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey BETWEEN 2 AND 3 AS is_valid, CAST(CASE WHEN n_regionkey BETWEEN 2 AND 3 THEN 0 ELSE 1 END AS BIGINT) AS n_errors,
    CASE WHEN n_regionkey < 2 THEN 'ChildrenLengthMismatch' WHEN n_regionkey > 3 THEN 'MalformedNodeStructure' END AS code FROM nation""", "n_nationkey", captures={}, more=_CODE)
query("table_min_not_strict", "nation", _ROWS, "| a |\n|---|\n| `n:/[0-9]+/` |{2,3}", "SELECT CAST(n_nationkey AS BIGINT) AS id, " + _VALID("n_regionkey <= 3") + ", CASE WHEN n_regionkey > 3 THEN 'MalformedNodeStructure' END AS code FROM nation", "n_nationkey", captures={}, more=_CODE, strict_table_bounds=False)
for _name in ("mixed_literal_mark",):
    _kept = QUERIES[_name]
    QUERIES[_name] = lambda spark, sf_dir, run=_kept: run(spark, sf_dir).drop("n_errors")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["extract_heading_matcher"](spark, sf_dir)
