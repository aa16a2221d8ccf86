"""Intent envelopes, candidate lists, agent events and requests: decoding with explicit rejection."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.adapters import table

#: The intents of version 0, and the fields that each may carry besides its tag, with their types. A type
#: in brackets is a list of it; one that ends in ? may be null or missing, one that ends in ! may be missing alone.
INTENTS = {
    "Open": "path text",
    "PageCount": "",
    "Render": "page u32",
    "ApplyContent": "json text",
    "Export": "path text",
    "Undo": "",
    "Redo": "",
    "ExtractText": "",
    "Propose": "json text",
    "Commit": "",
    "DiscardProposal": "",
    "Find": "query text, case_sensitive bool, whole_word bool",
    "Replace": "query text, replacement text, case_sensitive bool, whole_word bool, all bool",
    "HitTest": "page u32, x float, y float",
    "CaretRect": "page u32, node size, offset size",
    "InsertText": "node size, offset size, text text",
    "DeleteBack": "node size, offset size",
    "SetImageSize": "section size, index size, width i32, height i32",
    "MoveImage": "section size, from size, to size, width i32, height i32",
    "MoveBlock": "section size, from size, to size",
    "TableInsertRows": "section size, index size, at size, count size, cols size",
    "SetTableCell": "section size, index size, row size, col size, text text",
    "TableAppendRow": "section size, index size",
    "SetParagraphText": "section size, block size, text text",
    "SetTableColWidths": "section size, index size, widths [i32]",
    "SetTableRowHeights": "section size, index size, heights [i32]",
    "SetPageMargins": "section size, left_mm float, right_mm float, top_mm float, bottom_mm float",
    "SetCharFmt": "section size, block size, cell pair?, bold bool?, italic bool?, size_pt float?, font text?",
    "SetRunCharFmt": "section size, block size, cell pair?, start size, end size, bold bool?, italic bool?",
    "SetTableCellRuns": "section size, index size, row size, col size, runs [Run], path [Step]?",
    "SetParagraphRuns": "section size, block size, runs [Run]",
    "SetTableCellShade": "section size, index size, sel text, row size, col size, shade text?",
    "SetCellRangeShade": "section size, index size, r0 size, c0 size, r1 size, c1 size, shade text?",
    "SetCellRangeFmt": "section size, index size, r0 size, c0 size, r1 size, c1 size, bold bool?, italic bool?, size_pt float?, font text?, color text?, align text?",
    "DeleteBlock": "section size, index size",
    "InsertImage": "section size, block size?, data_b64 text, width i32, height i32",
    "InsertTableAt": "section size, index size?, rows [[Cell]]",
    "InsertParagraphAt": "section size, index size?, runs [Run], para Para!",
    "InsertChartAt": "section size, index size?, chart Chart",
    "HitTestCell": "page u32, x float, y float",
    "CaretRectCell": "section size, block size, row size, col size, para size, offset size",
}
#: The objects that fields may hold.
OBJECTS = {
    "Run": "text text!, bold bool!, italic bool!, underline bool!, strike bool!, size_pt float?, color text?, highlight text?, font text?",
    "Cell": "text text!, col_span size!, row_span size!, bold bool!, shade text?",
    "Para": "style text?, align text?, line_spacing_pct u32?, indent_pt float?, margin_left_pt float?, margin_right_pt float?, space_before_pt float?, space_after_pt float?",
    "Step": "block size, row size, col size",
    "Series": "name text, values [float]",
    "Chart": "type text, title text?, categories [text], series [Series], width float?, height float?",
}
INTENT_VERSION = 0

#: Intents that a model's answer may hold.
ALLOWED = (
    "SetTableCell",
    "SetTableCellRuns",
    "SetParagraphText",
    "SetCellRangeShade",
    "SetCellRangeFmt",
    "ApplyContent",
    "InsertTableAt",
    "InsertParagraphAt",
    "InsertImage",
    "InsertChartAt",
    "TableInsertRows",
    "TableAppendRow",
    "DeleteBlock",
    "MoveBlock",
    "MoveImage",
    "Replace",
    "SetCharFmt",
    "SetTableColWidths",
    "SetPageMargins",
)
EVENT_TYPES = ("status", "thinking_delta", "tool_call", "tool_result", "intents", "error")
REQUEST_LIMITS = {"instruction": 4000, "doc_context": 20000, "anchors": 32, "attachments": 8}


def _fields(spec: str) -> list[dict]:
    """Of a line of fields: name, type, whether it must be there, whether it may be null."""
    out = []
    for name, kind in (f.split(" ") for f in spec.split(", ") if f):
        out.append({"name": name, "kind": kind.rstrip("?!"), "must": kind[-1] not in "?!", "null": kind[-1] == "?"})
    return out


def _literal(fields: object, kind: str) -> Column:
    """A constant of a nested type; folded once, when the query is planned."""
    return F.from_json(F.lit(json.dumps(fields)), kind)


_FIELD = "struct<name:string,kind:string,must:boolean,null:boolean>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is(value: Column, kind: str) -> Column:
    """Whether a variant, not null, is of a kind."""
    t, whole = F.schema_of_variant(value), F.try_variant_get(value, "$", "bigint")
    number = F.startswith(t, F.lit("BIGINT"))
    if kind.startswith("[") or kind == "pair":
        items = F.try_variant_get(value, "$", "array<variant>")
        inner = kind[1:-1] if kind != "pair" else "size"
        each = F.startswith(t, F.lit("ARRAY")) & F.forall(items, lambda v: ~F.is_variant_null(v) & _is(v, inner))
        return each & (F.size(items) == 2) if kind == "pair" else each
    if kind in OBJECTS:
        return F.startswith(t, F.lit("OBJECT")) & _let(F.try_variant_get(value, "$", "map<string,variant>"), lambda m: _holds(m, _fields(OBJECTS[kind])))
    return {
        "text": t == "STRING",
        "bool": t == "BOOLEAN",
        "size": number & (whole >= 0),
        "u32": number & whole.between(0, (1 << 32) - 1),
        "i32": number & whole.between(-(1 << 31), (1 << 31) - 1),
        "float": number | F.startswith(t, F.lit("DECIMAL")) | (t == "DOUBLE") | (t == "FLOAT"),
    }[kind]


def _holds(values: Column, fields: list[dict]) -> Column:
    """Whether an object, a map of variants, has the given fields and no others."""
    out = F.size(F.array_except(F.map_keys(values), F.array(*[F.lit(f["name"]) for f in fields]))) == 0
    for f in fields:
        out = out & _let(F.try_element_at(values, F.lit(f["name"])), _fits(f))
    return out


def _fits(f: dict) -> Callable[[Column], Column]:
    return lambda v: F.when(v.isNull(), not f["must"]).when(F.is_variant_null(v), f["null"]).otherwise(_is(v, f["kind"]))


def _fault(values: Column, fields: Column) -> Column:
    """What is wrong with an intent's object against its fields, which differ from row to row."""
    names = F.concat(F.transform(fields, lambda f: f["name"]), F.array(F.lit("intent"), F.lit("intent_version")))
    kinds = sorted({f["kind"] for spec in INTENTS.values() for f in _fields(spec)})

    def good(f: Column, v: Column) -> Column:
        out = F.when(v.isNull(), True).when(F.is_variant_null(v), f["null"])
        for kind in kinds:
            out = out.when(f["kind"] == kind, _is(v, kind))
        return F.coalesce(out, F.lit(False))

    return (
        F.when(F.size(F.array_except(F.map_keys(values), names)) > 0, "unknown_field")
        .when(F.exists(fields, lambda f: f["must"] & ~F.map_contains_key(values, f["name"])), "missing_field")
        .when(F.forall(fields, lambda f: _let(F.try_element_at(values, f["name"]), lambda v: good(f, v))), "ok")
        .otherwise("bad_type")
    )


def decode_intents(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with intent and status: ok, not_object, bad_version, newer_version, no_intent, unknown_intent, unknown_field, missing_field or bad_type.

    The text is parsed once; its fields and those of the objects in them are held against a constant table.
    """
    fields = F.try_element_at(_literal({k: _fields(v) for k, v in INTENTS.items()}, f"map<string,array<{_FIELD}>>"), F.col("intent"))
    values, version = F.col("_values"), F.try_element_at(F.col("_values"), F.lit("intent_version"))
    number = F.try_variant_get(version, "$", "bigint")
    whole = F.startswith(F.schema_of_variant(version), F.lit("BIGINT"))
    status = (
        F.when(values.isNull(), "not_object")
        .when(version.isNotNull() & ~F.coalesce(whole & (number >= 0), F.lit(False)), "bad_version")
        .when(number > INTENT_VERSION, "newer_version")
        .when(F.col("intent").isNull(), "no_intent")
        .when(F.col("_fields").isNull(), "unknown_intent")
        .otherwise(_fault(values, F.col("_fields")))
    )
    body = F.try_parse_json(column)
    parsed = rows.withColumn("_values", F.when(F.startswith(F.schema_of_variant(body), F.lit("OBJECT")), F.try_variant_get(body, "$", "map<string,variant>")))
    tag = F.try_element_at("_values", F.lit("intent"))
    parsed = parsed.withColumn("intent", F.when(F.schema_of_variant(tag) == "STRING", F.try_variant_get(tag, "$", "string"))).withColumn("_fields", fields)
    return parsed.withColumn("status", status).drop("_values", "_fields")


def json_array(text: Column) -> Column:
    """The text itself if it is JSON, else what runs from its first [ to its last ], if that is; else null."""
    t = F.btrim(text, F.lit(" \t\r\n"))
    found = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    return F.when(F.try_parse_json(t).isNotNull(), t).when((found != "") & F.try_parse_json(found).isNotNull(), found)


def allowed_candidates(rows: DataFrame, column: str = "json", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """rows exploded to candidates of a JSON array: kept, or dropped with a reason."""
    items = rows.withColumn("item", F.explode_outer(F.from_json(F.col(column), "array<string>")))
    tag = F.get_json_object("item", "$.intent")
    return items.withColumn("intent", tag).withColumn("verdict", F.when(tag.isNull(), "malformed").when(tag.isin(*allowed), "kept").otherwise("not_allowed"))


def agent_events(lines: DataFrame, column: str = "line") -> DataFrame:
    """lines with type: null for blank, broken and unknown ones."""
    kind = F.get_json_object(F.btrim(column), "$.type")
    return lines.withColumn("type", F.when(kind.isin(*EVENT_TYPES), kind))


def request_error(instruction: Column, anchors: Column, context: Column, attachments: Column) -> Column:
    """The first limit that a request exceeds, or null. Sizes of texts, counts of lists."""
    return (
        F.when(instruction.isNull(), "instruction_missing")
        .when(F.length(instruction) > REQUEST_LIMITS["instruction"], "instruction_too_long")
        .when(anchors.isNull(), "anchors_missing")
        .when(anchors > REQUEST_LIMITS["anchors"], "too_many_anchors")
        .when(F.length(F.coalesce(context, F.lit(""))) > REQUEST_LIMITS["doc_context"], "context_too_long")
        .when(F.coalesce(attachments, F.lit(0)) > REQUEST_LIMITS["attachments"], "too_many_attachments")
    )


def citations(rows: DataFrame, column: str = "json") -> DataFrame:
    """(…, title, url) of web citations, nested or flat; without a title the url stands for it."""
    items = rows.withColumn("item", F.explode(F.from_json(F.col(column), "array<string>")))
    nested = F.get_json_object("item", "$.type") == "url_citation"
    at = lambda f: F.coalesce(F.when(nested, F.get_json_object("item", f"$.url_citation.{f}")), F.get_json_object("item", f"$.{f}"))
    url, title = at("url"), at("title")
    return items.select(*rows.columns, F.when(F.btrim(title) != "", title).otherwise(url).alias("title"), url.alias("url")).where(F.col("url").isNotNull())


_JSON = """CASE event_id % 11 WHEN 0 THEN '{"intent":"Undo"}' WHEN 1 THEN '{"intent":"DeleteBlock","section":0,"index":' || user_id || '}' WHEN 2 THEN '{"intent":"DeleteBlock","where":1}' WHEN 3 THEN '{"intent":"Nope"}'
WHEN 4 THEN '{"intent_version":' || (event_id % 4 - 1) || ',"intent":"Redo"}' WHEN 5 THEN '{"intent":"SetImageSize","section":0,"index":' || user_id || '}' WHEN 6 THEN '{"intent":"Render","page":' || CASE WHEN user_id % 2 = 0 THEN '"x"' ELSE '' || user_id END || '}'
WHEN 7 THEN '{"intent":"SetParagraphRuns","section":0,"block":1,"runs":[{"text":"a"' || CASE WHEN user_id % 3 = 0 THEN ',"bolt":1' ELSE '' END || '}]}' WHEN 8 THEN '{"section":' || user_id || '}' WHEN 9 THEN '{"intent":"DeleteBlock","section":' || (user_id % 5 - 2) || ',"index":1}' ELSE '[1]' END"""

#: The rule, by a table of the fields of these intents.
_DECODED = f"""e AS (SELECT event_id, ({_JSON})::JSON AS json FROM events), o AS (SELECT *, json ->> '$.intent' AS intent, json -> '$.intent_version' AS v, json_type(json) = 'OBJECT' AS obj FROM e),
spec AS (SELECT * FROM (VALUES ('Undo', NULL, NULL), ('Redo', NULL, NULL), ('DeleteBlock', 'section', 'size'), ('DeleteBlock', 'index', 'size'), ('Render', 'page', 'size'), ('SetImageSize', 'section', 'size'), ('SetImageSize', 'index', 'size'), ('SetImageSize', 'width', 'i32'), ('SetImageSize', 'height', 'i32'),
  ('SetParagraphRuns', 'section', 'size'), ('SetParagraphRuns', 'block', 'size'), ('SetParagraphRuns', 'runs', 'runs')) t(intent, field, kind)),
k AS (SELECT event_id, intent, json, unnest(json_keys(json)) AS field FROM o WHERE obj),
odd AS (SELECT DISTINCT event_id FROM k WHERE field NOT IN ('intent', 'intent_version') AND NOT EXISTS (SELECT 1 FROM spec WHERE spec.intent = k.intent AND spec.field = k.field)),
gap AS (SELECT DISTINCT event_id FROM o JOIN spec USING (intent) WHERE obj AND field IS NOT NULL AND NOT list_contains(json_keys(json), field)),
ill AS (SELECT DISTINCT event_id FROM k JOIN spec USING (intent, field) WHERE CASE kind WHEN 'runs' THEN len(list_filter(json_extract(json, '$.runs[*]'), lambda r: len(list_filter(json_keys(r), lambda f: f NOT IN ('text', 'bold', 'italic', 'underline', 'strike', 'size_pt', 'color', 'highlight', 'font'))) > 0)) > 0
  ELSE json_type(json_extract(json, '$.' || field)) <> 'UBIGINT' END),
decoded AS (SELECT event_id, CASE WHEN obj THEN intent END AS intent, CASE WHEN NOT obj THEN 'not_object' WHEN v IS NOT NULL AND json_type(v) <> 'UBIGINT' THEN 'bad_version' WHEN v IS NOT NULL AND v::BIGINT > 0 THEN 'newer_version' WHEN intent IS NULL THEN 'no_intent'
  WHEN intent NOT IN (SELECT intent FROM spec) THEN 'unknown_intent' WHEN event_id IN (SELECT event_id FROM odd) THEN 'unknown_field' WHEN event_id IN (SELECT event_id FROM gap) THEN 'missing_field' WHEN event_id IN (SELECT event_id FROM ill) THEN 'bad_type' ELSE 'ok' END AS status FROM o)"""


@query(f"WITH {_DECODED} SELECT event_id, intent, status FROM decoded")
def intent_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_intents(table(spark, sf_dir, "events").select("event_id", F.expr(_JSON).alias("json"))).select("event_id", "intent", "status")


@query(f"WITH {_DECODED} SELECT event_id FROM decoded WHERE status = 'unknown_field'")
def unknown_field_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_intents(table(spark, sf_dir, "events").select("event_id", F.expr(_JSON).alias("json"))).where("status = 'unknown_field'").select("event_id")


_LIST = """'[{"intent":"' || CASE event_type WHEN 'view' THEN 'Replace' WHEN 'click' THEN 'MoveBlock' WHEN 'error' THEN 'Export' ELSE 'SetCharFmt' END || '","n":' || event_id || '},{"x":1}]'"""


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'Replace' WHEN 'click' THEN 'MoveBlock' WHEN 'error' THEN 'Export' ELSE 'SetCharFmt' END AS intent, CASE WHEN event_type = 'error' THEN 'not_allowed' ELSE 'kept' END AS verdict FROM events UNION ALL SELECT event_id, NULL, 'malformed' FROM events")
def intent_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allowed_candidates(table(spark, sf_dir, "events").select("event_id", F.expr(_LIST).alias("json"))).select("event_id", "intent", "verdict")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[1,' || event_id || ']' WHEN event_id % 3 = 1 THEN '{\"a\":1}' END AS found FROM events")
def json_array_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is: [1,"), F.col("event_id").cast("string"), F.lit("] done"))).when(F.col("event_id") % 3 == 1, F.lit(' {"a":1}\n')).otherwise(F.lit("no [list here"))
    return table(spark, sf_dir, "events").select("event_id", json_array(text).alias("found"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'status' WHEN 1 THEN 'tool_call' END AS type FROM events")
def agent_event_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    line = F.when(k == 0, F.lit('{"type":"status","text":"go"}\n')).when(k == 1, F.lit(' {"type":"tool_call"}')).when(k == 2, F.lit('{"type":"other"}')).otherwise(F.lit('{"type":"sta'))
    return agent_events(table(spark, sf_dir, "events").select("event_id", line.alias("line"))).select("event_id", "type")


@query("SELECT doc_id, CASE WHEN length(text) > 4000 THEN 'instruction_too_long' WHEN doc_id % 40 > 32 THEN 'too_many_anchors' WHEN length(text) * 6 > 20000 THEN 'context_too_long' WHEN doc_id % 10 > 8 THEN 'too_many_attachments' END AS error FROM documents")
def request_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", request_error(F.col("text"), F.col("doc_id") % 40, F.repeat("text", F.lit(6)), F.col("doc_id") % 10).alias("error"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'Title' END AS title, url FROM pages")
def web_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    j = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('[{"type":"url_citation","url_citation":{"url":"'), url, F.lit('","title":" "}},{"x":1}]'))).otherwise(F.concat(F.lit('[{"url":"'), url, F.lit('","title":"Title"}]')))
    return citations(table(spark, sf_dir, "pages").select("page_id", j.alias("json"))).select("page_id", "title", "url")


def anchor_lines(anchors: DataFrame) -> DataFrame:
    """A line of text for each anchor (section, block, r0, r1, c0, c1, label, kind): which place an instruction means."""

    def part(name: str, low: str, high: str) -> Column:
        one, many = F.format_string(f", {name}=%d", F.col(low)), F.format_string(f", {name} %d..=%d", F.col(low), F.col(high))
        return F.when(F.col(low).isNull(), "").when(F.col(low) == F.col(high), one).otherwise(many)

    at = F.concat(F.format_string("section=%d, block=%d", F.col("section"), F.col("block")), part("row", "r0", "r1"), part("col", "c0", "c1"))
    label = F.when(F.coalesce("label", F.lit("")) == "", F.col("kind")).otherwise(F.col("label"))
    return anchors.withColumn("line", F.concat(F.format_string("- [s%d/b%d] ", F.col("section"), F.col("block")), label, F.lit(" ("), at, F.lit(")")))


def coerced_cells(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with text and shade of a model's cell: scalars are their text, null and lists are empty, objects give theirs."""
    body = F.try_parse_json(column)
    kind = F.schema_of_variant(body)
    text = F.when(kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(body, "$.text", "string"), F.lit(""))).when(kind.startswith("ARRAY") | (kind == "VOID"), "").otherwise(F.try_variant_get(body, "$", "string"))
    return rows.withColumn("text", text).withColumn("shade", F.when(kind.startswith("OBJECT"), F.try_variant_get(body, "$.shade", "string")))


@query("""SELECT event_id, '- [s0/b' || event_id % 50 || '] ' || CASE WHEN event_id % 3 = 0 THEN 'cell' ELSE event_type END || ' (section=0, block=' || event_id % 50 || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ', row=' || user_id ELSE ', row ' || user_id || '..=' || user_id + 2 END || CASE WHEN event_id % 2 = 0 THEN '' ELSE ', col=1' END || ')' AS line FROM events""")
def anchor_directive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(
        "event_id",
        F.lit(0).alias("section"),
        (F.col("event_id") % 50).alias("block"),
        F.when(F.col("event_id") % 4 > 0, F.col("user_id")).alias("r0"),
        F.when(F.col("event_id") % 4 > 0, F.col("user_id") + F.when(F.col("event_id") % 4 > 1, 2).otherwise(0)).alias("r1"),
        F.when(F.col("event_id") % 2 > 0, F.lit(1)).alias("c0"),
        F.when(F.col("event_id") % 2 > 0, F.lit(1)).alias("c1"),
        F.when(F.col("event_id") % 3 > 0, F.col("event_type")).otherwise("").alias("label"),
        F.lit("cell").alias("kind"),
    )
    return anchor_lines(rows).select("event_id", "line")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN 'true' WHEN 5 THEN event_type ELSE '' END AS text, CASE WHEN event_id % 6 = 5 THEN '#AABBCC' END AS shade FROM events""")
def ai_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 6
    json = F.when(n == 0, F.format_string('"%s"', "event_type")).when(n == 1, F.col("user_id").cast("string")).when(n == 2, "true").when(n == 3, "null").when(n == 4, '["x"]').otherwise(F.format_string('{"text":"%s","shade":"#AABBCC"}', "event_type"))
    return coerced_cells(table(spark, sf_dir, "events").select("event_id", json.alias("json"))).select("event_id", "text", "shade")
