"""Bulk form filling: labels, rosters, fill actions, verification and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.plans.registry import query
from quire.sources.adapters import table

#: Labels that a form's value cells are found by, in order; the first that a label starts with counts.
LEXICON = ("성명", "이름", "생년월일", "연락처", "전화번호", "휴대전화", "주소", "이메일", "기업명", "업체명", "회사명", "대표자", "사업자등록번호", "법인등록번호", "서명", "날짜", "작성일", "기간", "계약기간", "소속", "직위", "부서")
LABEL_CHARS = 20

#: Formats that a field may demand.
SPEC_TYPES = {
    "date": r"^\d{4}\s*[.\-/년]\s*\d{1,2}\s*[.\-/월]\s*\d{1,2}\s*[.일]?\s*$",
    "phone": r"^0\d{1,2}-?\d{3,4}-?\d{4}$",
    "bizno": r"^\d{3}-?\d{2}-?\d{5}$",
    "number": r"^[\d,]+원?$",
}


def lexicon_label(text: Column, lexicon: tuple[str, ...] = LEXICON) -> Column:
    """The first entry that the normalised text starts with; null for long texts."""
    label, out = X.norm_label(text), F.lit(None).cast("string")
    for entry in reversed(lexicon):
        out = F.when(F.startswith(label, F.lit(entry)), F.lit(entry)).otherwise(out)
    return F.when(F.length(label) <= LABEL_CHARS, out)


def format_ok(value: Column, spec: Column) -> Column:
    """Whether a value has the format that the field demands; any value where it demands none."""
    out = F.lit(True)
    for name, pattern in SPEC_TYPES.items():
        out = F.when(spec == name, F.rlike(value, F.lit(pattern))).otherwise(out)
    return out


def fill_actions(roster: DataFrame, fields: list[dict]) -> DataFrame:
    """(row_no, key, value, reason) for each person and field of a form.

    A form has a few fields, given as dicts of key, required, pinned and spec; they go into the plan as one array that
    each person's row is exploded by. reason is null for a value that can be filled in.
    """
    form = F.array(*[F.struct(F.lit(f["key"]).alias("key"), F.lit(f["required"]).alias("required"), F.lit(f["pinned"]).alias("pinned"), F.lit(f.get("spec")).cast("string").alias("spec")) for f in fields])
    rows = roster.select("row_no", "values", F.explode(form).alias("f"))
    value = F.coalesce(F.element_at("values", F.col("f.key")), F.lit(""))
    reason = (
        F.when(~F.col("f.pinned"), "unpinned")
        .when((value == "") & F.col("f.required"), "missing_required")
        .when((value != "") & ~format_ok(value, F.coalesce("f.spec", F.lit("text"))), "format_mismatch")
    )
    return rows.select("row_no", F.col("f.key").alias("key"), value.alias("value"), reason.alias("reason"))


def fill_report(actions: DataFrame, *, strict: bool = False) -> DataFrame:
    """(row_no, created, needs_review, reasons): with strict, a person with a reason gets no file."""
    reasons = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws(":", "reason", "key"))))
    out = actions.groupBy("row_no").agg(reasons.alias("reasons"))
    bad = F.size("reasons") > 0
    return out.select("row_no", (~bad if strict else F.lit(True)).alias("created"), bad.alias("needs_review"), "reasons")


def values_in_text(actions: DataFrame, texts: DataFrame) -> DataFrame:
    """Filled values that the whole text holds, as the command-line check asks."""
    return actions.join(texts, "row_no").where(F.contains("text", F.col("value")))


def values_in_cells(actions: DataFrame, grid: DataFrame) -> DataFrame:
    """Filled values that some cell equals, as the bulk page asks."""
    return actions.join(grid.select("row_no", F.col("text").alias("value")), ["row_no", "value"], "left_semi")


def roster_rows(blocks: Column) -> Column:
    """`key: value` lines as a map; the last of equal keys counts; lines without a colon are left out."""
    lines = F.filter(F.split(blocks, "\\r?\\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1)).alias("k"), F.btrim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda a, p: F.array_append(F.filter(a, lambda q: q["k"] != p["k"]), p))
    return F.map_from_entries(last)


def file_name(pattern: str, index: Column, values: Column | None = None, keys: tuple[str, ...] = ()) -> Column:
    """A name from {index:03d}, {index} and {key}; characters that paths cannot hold become _."""
    number = index.cast("string")
    out = F.replace(F.replace(F.lit(pattern), F.lit("{index:03d}"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))), F.lit("{index}"), number)
    for k in keys:
        out = F.replace(out, F.lit(f"{{{k}}}"), F.coalesce(F.element_at(values, k), F.lit("")))
    return F.translate(out, '/\\:*?"<>|\n', "_" * 10)


_FIELDS = [
    {"key": "name", "required": True, "pinned": True},
    {"key": "phone", "required": True, "pinned": True, "spec": "phone"},
    {"key": "amount", "required": False, "pinned": True, "spec": "number"},
    {"key": "note", "required": False, "pinned": False},
]


def _roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    phone = F.when(k % 7 == 0, "").when(k % 5 == 0, "call me").otherwise(F.concat(F.lit("010-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("-5678")))
    amount = F.when(k % 3 == 0, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise(F.lit("n/a"))
    return table(spark, sf_dir, "customer").select(k.alias("row_no"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("phone"), phone, F.lit("amount"), amount).alias("values"))


_ACTIONS = """WITH r AS (SELECT c_custkey AS row_no, c_name, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN 'call me' ELSE '010-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '-5678' END AS phone, CASE WHEN c_custkey % 3 = 0 THEN '1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') ELSE 'n/a' END AS amount FROM customer),
action AS (SELECT row_no, 'name' AS key, c_name AS value, NULL AS reason FROM r UNION ALL SELECT row_no, 'phone', phone, CASE WHEN phone = '' THEN 'missing_required' WHEN NOT regexp_matches(phone, '^0\\d{1,2}-?\\d{3,4}-?\\d{4}$') THEN 'format_mismatch' END FROM r
UNION ALL SELECT row_no, 'amount', amount, CASE WHEN NOT regexp_matches(amount, '^[\\d,]+$') THEN 'format_mismatch' END FROM r UNION ALL SELECT row_no, 'note', '', 'unpinned' FROM r)"""


@query(_ACTIONS + " SELECT row_no, key, value, reason FROM action", name="fill_actions")
def fill_actions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_actions(_roster(spark, sf_dir), _FIELDS)


@query(_ACTIONS + " SELECT row_no, count(reason) = 0 AS created, count(reason) > 0 AS needs_review, array_to_string(list_sort(list(reason || ':' || key) FILTER (reason IS NOT NULL)), ',') AS reasons FROM action GROUP BY row_no", name="fill_report")
def fill_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(fill_actions(_roster(spark, sf_dir), _FIELDS), strict=True).withColumn("reasons", F.array_join("reasons", ","))


@query(_ACTIONS + ", c AS (SELECT c_custkey AS row_no, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE lower(c_name) END AS text FROM customer) SELECT row_no, key, value FROM action a WHERE EXISTS (SELECT 1 FROM c WHERE c.row_no = a.row_no AND c.text = a.value)")
def fill_value_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = table(spark, sf_dir, "customer").selectExpr("c_custkey as row_no", "case when c_custkey % 2 = 0 then c_name else lower(c_name) end as text")
    return values_in_cells(fill_actions(_roster(spark, sf_dir), _FIELDS), grid).select("row_no", "key", "value")


@query(_ACTIONS + ", c AS (SELECT c_custkey AS row_no, c_name || ' 010-' || c_mktsegment AS text FROM customer) SELECT row_no, key FROM action JOIN c USING (row_no) WHERE contains(text, value)")
def fill_value_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_no"), F.concat("c_name", F.lit(" 010-"), "c_mktsegment").alias("text"))
    return values_in_text(fill_actions(_roster(spark, sf_dir), _FIELDS), texts).select("row_no", "key")


@query("SELECT c_custkey, c_name AS name, n_name AS nation, c_mktsegment AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey")
def roster_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    block = F.concat(F.lit("name : old\nname: "), "c_name", F.lit("\r\n nation:"), "n_name", F.lit("\n\nno colon\nsegment: "), "c_mktsegment")
    values = roster_rows(block)
    return people.select("c_custkey", *[F.element_at(values, k).alias(k) for k in ("name", "nation", "segment")])


@query("SELECT o_orderkey, regexp_matches(strftime(o_orderdate, '%Y.%m.%d'), '^[0-9]{4}') AS dated, o_orderkey % 2 = 0 AS numeric, false AS phoned FROM orders")
def field_format_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    date, number = F.date_format("o_orderdate", "yyyy.MM.dd"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("1,000원")).otherwise(F.lit("1.000"))
    return o.select("o_orderkey", format_ok(date, F.lit("date")).alias("dated"), format_ok(number, F.lit("number")).alias("numeric"), format_ok(date, F.lit("phone")).alias("phoned"))


@query("SELECT c_custkey, lpad(c_custkey::VARCHAR, 3, '0')[-3:] AS tail, 'form_' || CASE WHEN c_custkey < 1000 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END || '_' || c_mktsegment || '_.hwpx' AS file FROM customer")
def fill_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    values = F.create_map(F.lit("seg"), F.concat("c_mktsegment", F.lit("/")))
    return c.select("c_custkey", F.right(F.lpad(F.col("c_custkey").cast("string"), 3, "0"), F.lit(3)).alias("tail"), file_name("form_{index:03d}_{seg}.hwpx", F.col("c_custkey"), values, ("seg",)).alias("file"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '성명' WHEN 1 THEN '생년월일' WHEN 2 THEN NULL ELSE '기간' END AS label FROM events")
def lexicon_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.lit(" 성 명 (한글) :")).when(k == 1, F.lit("생년월일※")).when(k == 2, F.lit("계약 상대자의 이름과 주소를 모두 적어 주십시오")).otherwise(F.lit("기간"))
    return table(spark, sf_dir, "events").select("event_id", lexicon_label(text).alias("label"))
