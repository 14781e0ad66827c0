"""Validate and extract over DataFrames of documents.

:func:`validate` adds ``is_valid``, ``value`` (JSON with sorted keys) and ``errors``
to every row.  With one schema the input is read once: blocks are cut into a column,
a predicate and the captures are expressions over it, and only the texts that the
predicate does not accept go to Python, in Arrow batches, to be compared as trees; of
the others a null does.  With a schema column every row has its own schema and is
compared as a tree.  No shuffle is used by either, but that a scan of fewer tasks than
half of the cores is dealt out first.  Captures and errors of invalid
documents are both kept.

A document that our own code fails on (too deep a nesting, say) has an ``InternalError``
and no validity: it is neither valid nor invalid.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions import markdown
from quillgrid.functions.report import report as in_words
from quillgrid.operators.compare import ERROR_FIELDS, compare
from quillgrid.operators.compare import farthest as reached
from quillgrid.plans import compiled as plans

_INTS = ("schema_index", "input_index", "min", "max", "received")
ERROR = T.StructType([T.StructField(k, T.IntegerType() if k in _INTS else T.StringType()) for k in ERROR_FIELDS])
ERRORS = T.ArrayType(ERROR)
_ARROW_ERRORS = pa.list_(pa.struct([(k, pa.int32() if k in _INTS else pa.string()) for k in ERROR_FIELDS]))


def json_of(value: dict) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def judged(schema: str | None, text: str | None, complete: bool = True, drop_underscore: bool = False, strict_table_bounds: bool = True) -> tuple[bool | None, str, list[dict]]:
    """One document: valid, captures as JSON, errors.  A null text is an empty one,
    a null schema is an error; a failure of ours is an error row without validity,
    never a failed task."""
    if schema is None:
        return False, "{}", [dict.fromkeys(ERROR_FIELDS) | {"category": "ValidatorCreationFailed", "code": "ValidatorCreationFailed"}]
    try:
        found = compare(schema, text or "", complete, strict_table_bounds)
        if drop_underscore:
            found.value.pop("_", None)
        return not found.errors, json_of(found.value), found.errors
    except Exception as wrong:  # one odd document must not end the job
        return failure(wrong)


def failure(cause: Exception) -> tuple[None, str, list[dict]]:
    """The outcome where our own code failed."""
    wrong = "nested too deep" if isinstance(cause, RecursionError) else f"{type(cause).__name__}: {cause}"
    return None, "{}", [dict.fromkeys(ERROR_FIELDS) | {"category": "ParserError", "code": "InternalError", "actual": wrong[:500]}]


_FOUND = T.StructType([T.StructField("is_valid", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("errors", ERRORS)])


def _by_trees(schema: str | None, **options):
    """A column of (is_valid, value, errors) from texts, and schemas where ``schema`` is
    None; null for a null text.  Not deterministic, so that a filter on the outcome does
    not run it again."""

    def run(texts: pa.Array, *schemas: pa.Array) -> pa.Array:
        own = schemas[0].to_pylist() if schemas else [schema] * len(texts)
        places: dict[tuple, int] = {}  # what a batch holds more than once is judged once
        at = [None if t is None else places.setdefault((s, t), len(places)) for t, s in zip(texts.to_pylist(), own, strict=True)]
        found = [judged(s, t, **options) for s, t in places]
        cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.bool_(), pa.string(), _ARROW_ERRORS))]
        return pa.StructArray.from_arrays(cols, names=["is_valid", "value", "errors"]).take(pa.array(at, pa.int64()))

    def one(texts: pa.Array) -> pa.Array:
        return run(texts)

    def two(texts: pa.Array, schemas: pa.Array) -> pa.Array:
        return run(texts, schemas)

    return F.arrow_udf(two if schema is None else one, _FOUND).asNondeterministic()


#: Estimated bytes of input that are worth a task of their own.
WORTH = 128 * 1024


def _dealt(docs: DataFrame) -> DataFrame:
    """``docs``, dealt out where a scan has tasks for half of the cores at most: short
    documents can come from one small split by the million.  Only plans without an
    exchange are looked at, since others are dealt out, and looking runs them."""
    if docs.isStreaming or not hasattr(docs, "_jdf"):
        return docs
    run, cores = docs._jdf.queryExecution(), docs.sparkSession.sparkContext.defaultParallelism
    tasks = min(2 * cores, int(str(run.optimizedPlan().stats().sizeInBytes())) // WORTH)
    plan = run.executedPlan().toString()
    if tasks < 2 or any(x in plan for x in ("Exchange", "InMemoryTableScan", "Subquery", "AdaptiveSparkPlan")):
        return docs
    given = run.toRdd().getNumPartitions()
    return docs.repartition(tasks) if given < tasks and 2 * given <= cores else docs


def _free(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name = "_" + name
    return name


def compared(docs: DataFrame, schema: str | None = None, text: str = "text", schema_column: str | None = None, **options) -> DataFrame:
    """Every row by the tree comparison."""
    name = _free("_judged", docs)
    given = F.coalesce(F.col(text), F.lit(""))
    found = _by_trees(None, **options)(given, F.col(schema_column)) if schema_column else _by_trees(schema or "", **options)(given)
    return docs.withColumn(name, found).select(*docs.columns, *(F.col(f"{name}.{k}").alias(k) for k in _FOUND.names))


def _value(plan: plans.Compiled) -> Column:
    if not plan.captures:
        return F.lit("{}")
    if not plan.json:
        return F.to_json(F.struct(*(plan.captures[k].alias(k) for k in sorted(plan.captures))))
    shown = []
    for k in sorted(plan.captures):
        own = F.to_json(F.struct(plan.captures[k].alias(k)))  # an id of a null is left out
        shown.append(F.concat(F.lit(json.dumps(k) + ":"), plan.captures[k]) if k in plan.json else F.nullif(F.substr(own, F.lit(2), F.length(own) - 2), F.lit("")))
    return F.concat(F.lit("{"), F.concat_ws(",", *shown), F.lit("}"))


def validate(docs: DataFrame, schema: str | None = None, text: str = "text", schema_column: str | None = None, path: str = "auto", drop_underscore: bool = False, strict_table_bounds: bool = True) -> DataFrame:
    """``docs`` with is_valid, value and errors.  path: auto, or trees for all rows.
    ``drop_underscore`` leaves captures of the id ``_`` out; without
    ``strict_table_bounds`` the lower bound of repeated table rows is not judged."""
    docs = _dealt(docs.drop("is_valid", "value", "errors"))
    options = {"drop_underscore": drop_underscore, "strict_table_bounds": strict_table_bounds}
    if schema_column or path == "trees" or not strict_table_bounds:
        return compared(docs, schema, text, schema_column, **options)
    blocks, ok, found = (_free(k, docs) for k in ("_blocks", "_ok", "_judged"))
    part = "_part"
    while any(k.lower().startswith(part) for k in docs.columns):
        part = "_" + part
    try:
        plan = plans.compiled(schema, F.col(text), F.col(blocks), part)
    except plans.Unsupported:
        return compared(docs, schema, text, **options)
    if drop_underscore:
        plan.captures.pop("_", None)
    cut = docs.withColumn(blocks, plans.blocks_of(F.col(text)))
    for name, value in plan.parts:
        cut = cut.withColumn(name, value)
    cut = cut.withColumn(ok, plan.accepts)
    cut = cut.select(*docs.columns, ok, F.when(F.col(ok), _value(plan)).alias(blocks))
    cut = cut.withColumn(found, _by_trees(schema, **options)(F.when(~F.col(ok), F.coalesce(F.col(text), F.lit("")))))
    return cut.select(
        *docs.columns,
        F.when(F.col(ok), F.lit(True)).otherwise(F.col(f"{found}.is_valid")).alias("is_valid"),
        F.coalesce(F.col(blocks), F.col(f"{found}.value")).alias("value"),
        F.when(F.col(ok), F.array().cast(ERRORS)).otherwise(F.col(f"{found}.errors")).alias("errors"),
    )


def farthest(docs: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """``docs`` with ``schema_reach`` and ``input_reach``: the numbers of the farthest
    nodes that were compared on either side."""
    name = _free("_reach", docs)

    @F.arrow_udf("struct<s int, g int>")
    def reach(texts: pa.Array) -> pa.Array:
        found = [reached(schema, t or "") for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)], names=["s", "g"])

    return docs.withColumn(name, reach(F.col(text))).select(*docs.columns, F.col(f"{name}.s").alias("schema_reach"), F.col(f"{name}.g").alias("input_reach"))


def extract(docs: DataFrame, schema: str, fields: dict[str, str] | None = None, text: str = "text", **more) -> DataFrame:
    """Valid documents with a typed column for each capture; ``fields`` maps ids to
    types (default: by the schema, text or array of text)."""
    fields = fields or capture_types(schema)
    shape = ", ".join(f"`{k}` {t}" for k, t in fields.items())
    found = validate(docs, schema, text, **more).where("is_valid").withColumn("_v", F.from_json("value", shape))
    return found.select(*docs.columns, *(F.col(f"_v.`{k}`").alias(k) for k in fields))


def capture_types(schema: str) -> dict[str, str]:
    """The id of every matcher and the type of its capture."""
    from quillgrid.functions import grammar
    from quillgrid.operators.compare import matcher_at, row_bounds, schema_tree

    out: dict[str, str] = {}
    for node in schema_tree(schema).walk():
        many = node.parent is not None and any(row_bounds(p) is not None for p in _above(node))
        for k, child in enumerate(node.children):
            try:
                own = matcher_at(node.children, k) if child.kind == "code_span" else grammar.curly(child.text) if child.kind == "text" and node.kind in ("info_string", "link_text", "link_destination", "image_description", "code_span") else None
            except grammar.MatcherError:
                continue
            if own and own.id:
                out[own.id] = "array<string>" if own.repeated or many else "string"
            elif node.kind == "code_fence_content" and (name := grammar.curly_id(child.text)):
                out[name] = "string"
    return out


def _above(node):
    while node is not None:
        yield node
        node = node.parent


def errors(found: DataFrame, *keys: str) -> DataFrame:
    """A row for each error, in document order."""
    return found.select(*keys, F.posexplode("errors").alias("at", "e")).select(*keys, "at", "e.*")


def reports(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` with ``report``, the errors in words, a line each; null where valid.

    Only rows with errors go to Python."""
    keep = [k for k in found.columns if k != "report"]
    out = T.StructType([*found.select(*keep).schema.fields, T.StructField("report", T.StringType())])

    def run(batches):
        for batch in batches:
            texts, wrong = (batch.column(keep.index(k)).to_pylist() for k in (text, "errors"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([in_words(t or "", e) for t, e in zip(texts, wrong, strict=True)], pa.string())], names=[*keep, "report"])

    given = found.select(*keep)
    return given.where("is_valid").withColumn("report", F.lit(None).cast("string")).unionByName(given.where("is_valid is not true").mapInArrow(run, out))


_NODE = {"idx": pa.int32(), "parent": pa.int32(), "depth": pa.int32(), "kind": pa.string(), "start": pa.int32(), "end": pa.int32(), "text": pa.string()}


def nodes(docs: DataFrame, *keys: str, text: str = "text", fields: tuple[str, ...] = tuple(_NODE)) -> DataFrame:
    """A row for each node of every document's tree; ``fields`` are what is made of it."""
    own = [list(_NODE).index(f) for f in fields]
    kinds = {"string": T.StringType(), "int32": T.IntegerType()}
    out = T.StructType([*docs.select(*keys).schema.fields, *(T.StructField(f, kinds[str(_NODE[f])]) for f in fields)])

    def run(batches):
        for batch in batches:
            rows, at = [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                found = markdown.node_rows(t or "")
                rows += found
                at += [i] * len(found)
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_NODE)
            held = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(cols[k], _NODE[f]) for k, f in zip(own, fields, strict=True))], names=[*keys, *fields])

    return docs.select(*keys, text).mapInArrow(run, out)


def register(spark) -> None:
    """``md_nodes(text)`` for SQL: a table function of a document's nodes."""

    class Nodes:
        def eval(self, text: str):
            yield from markdown.node_rows(text or "")

    shape = ", ".join(f"{k} {'string' if t == pa.string() else 'int'}" for k, t in _NODE.items())
    spark.udtf.register("md_nodes", F.udtf(Nodes, returnType=shape.replace("end int", "`end` int").replace("start int", "`start` int")))
