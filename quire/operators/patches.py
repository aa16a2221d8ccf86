"""Saving edits: changed elements of a section's XML are written anew in their place, and no other byte is touched.

A scan finds the byte span of every paragraph and table, nested ones too. Edits are joined with spans: a simple
paragraph gets new runs, of any other the opening tag alone is patched, a table is replaced as a whole. Of spans that
lie in one another the outermost counts. What is left does not overlap, and one ordered pass over each section puts it
in. Packages keep their other parts, in their order.

sections: doc_id, section, xml (binary). edits: doc_id, section, kind (p or tbl), ord, runs (null: as they are),
para_ref, page_break (null: as they are), xml (of a table).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import escape_xml, sanitize
from quire.plans.registry import query
from quire.sources.adapters import PARAGRAPH, paragraphs

KEY = ["doc_id", "section"]
RUNS = "array<struct<char_ref:string,text:string>>"
EDIT = f"doc_id bigint, section bigint, kind string, ord bigint, runs {RUNS}, para_ref string, page_break boolean, xml string"
_TAG = re.compile(rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(/)?([A-Za-z_][\w.:-]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(/)?>", re.S)
#: What a paragraph may hold if its runs are to be written anew. Line segments are dropped, for layout follows the text.
_PLAIN = {b"run", b"t", b"linesegarray", b"lineseg"}


def find_spans(xml: bytes) -> list[tuple]:
    """(kind, ord, block, depth, start, open_end, end, simple, name) of each paragraph and table, and the place where the root ends (kind end).

    ord counts the elements of a kind in the order of their openings; block is the top-level paragraph they are in.
    """
    out, stack, count, block = [], [], {b"p": 0, b"tbl": 0}, -1
    depth, root_end = 0, len(xml)
    for m in _TAG.finditer(xml):
        closing, name, alone = m[1], m[2], m[3]
        if name is None:
            continue
        local = name.rpartition(b":")[2]
        if closing:
            depth -= 1
            if depth == 0:
                root_end = m.start()
            if local in count and stack and stack[-1][0] == local:
                kind, k, b, level, a, open_end, simple, full = stack.pop()
                out.append((kind.decode(), k, b, level, a, open_end, m.end(), simple, full))
            continue
        if local in count:
            level = sum(s[0] == local for s in stack)
            block += local == b"p" and not stack
            for s in stack:
                s[6] = False
            own = [local, count[local], block, level, m.start(), m.end(), local == b"p" and not alone, name.decode()]
            count[local] += 1
            if alone:
                out.append((local.decode(), *own[1:6], m.end(), False, own[7]))
            else:
                stack.append(own)
        elif stack and local not in _PLAIN:
            stack[-1][6] = False
        depth += not alone
    out.append(("end", 0, block + 1, 0, root_end, root_end, root_end, False, ""))
    return out


def spans(sections: DataFrame) -> DataFrame:
    """find_spans of each section, with the opening tag's text."""
    kinds = {c: sections.schema[c].dataType.simpleString() for c in KEY}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                xml = b.column(2)[i].as_py() or b""
                rows = find_spans(xml)
                cols = list(zip(*rows, strict=True))
                opens = [xml[a:z].decode("utf-8", "replace") for a, z in zip(cols[4], cols[5], strict=True)]
                who = pa.array([i] * len(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(1).take(who), pa.array(cols[0]), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.bool_()), pa.array(cols[8], pa.string()), pa.array(opens, pa.string())], names=["doc_id", "section", "kind", "ord", "block", "depth", "start", "open_end", "end", "simple", "name", "open"])

    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", kind string, ord long, block long, depth long, start long, open_end long, end long, simple boolean, name string, open string"
    return sections.select(*KEY, "xml").mapInArrow(scan, schema)


def _with_attribute(tag: Column, name: str, value: Column) -> Column:
    """An opening tag with an attribute set, in place where it is there, else last."""
    own = F.concat(F.lit(f' {name}="'), escape_xml(value), F.lit('"'))
    quoted = F.regexp_replace(own, r"([\\$])", r"\\$1")
    there = F.regexp_like(tag, F.lit(rf'\s{name}="'))
    changed = F.when(there, F.regexp_replace(tag, F.lit(rf'\s{name}="[^"]*"'), quoted)).otherwise(F.regexp_replace(tag, F.lit(r"\s*(/?)>$"), F.concat(quoted, F.lit("$1>"))))
    return F.when(value.isNull(), tag).otherwise(changed)


def _runs_xml(prefix: Column, runs: Column) -> Column:
    one = lambda r: F.concat(F.lit("<"), prefix, F.lit('run charPrIDRef="'), F.coalesce(escape_xml(r["char_ref"]), F.lit("0")), F.lit('"><'), prefix, F.lit("t>"), escape_xml(sanitize(F.coalesce(r["text"], F.lit("")))), F.lit("</"), prefix, F.lit("t></"), prefix, F.lit("run>"))
    none = F.array(F.struct(F.lit("0").alias("char_ref"), F.lit("").alias("text")))
    return F.array_join(F.transform(F.when(F.size(runs) == 0, none).otherwise(runs), one), "")


def resolved(found: DataFrame, edits: DataFrame) -> DataFrame:
    """edits with status and, where it is ok, start, end and xml of what takes the place of the span. found: spans().

    status: no_element, structural (new runs for what holds more than text), covered (a table around it is replaced).
    """
    at = [*KEY, "kind", "ord"]
    e = edits.withColumnRenamed("xml", "table_xml").join(found.where("kind <> 'end'"), at, "left")
    open_ = _with_attribute(_with_attribute(F.col("open"), "paraPrIDRef", F.col("para_ref")), "pageBreak", F.when(F.col("page_break"), "1").when(~F.col("page_break"), "0"))
    prefix = F.regexp_extract("name", "^(.*:)?", 0)
    body = F.col("runs").isNotNull() & (F.col("kind") == "p")
    status = F.when(F.col("start").isNull(), "no_element").when(body & ~F.col("simple"), "structural").otherwise("ok")
    whole = F.concat(open_, _runs_xml(prefix, F.col("runs")), F.lit("</"), F.col("name"), F.lit(">"))
    xml = F.when(F.col("kind") == "tbl", F.col("table_xml")).when(body, whole).otherwise(open_)
    end = F.when((F.col("kind") == "tbl") | body, F.col("end")).otherwise(F.col("open_end"))
    e = e.select(*edits.columns[:-1], "table_xml", status.alias("status"), "start", end.alias("stop"), xml.alias("new_xml"))
    good = F.when(F.col("status") == "ok", F.col("stop"))
    before = F.max(good).over(W.partitionBy(*KEY).orderBy("start", F.desc("stop")).rowsBetween(W.unboundedPreceding, -1))
    e = e.withColumn("status", F.when((F.col("status") == "ok") & (F.col("start") < before), "covered").otherwise(F.col("status")))
    place = lambda c: F.when(F.col("status") == "ok", F.col(c))
    return e.select(*edits.columns[:-1], F.col("table_xml").alias("xml"), "status", place("start").alias("start"), place("stop").alias("stop"), place("new_xml").alias("new_xml"))


def appended(found: DataFrame, new: DataFrame) -> DataFrame:
    """Paragraphs behind a section's last, as places to put in. new: doc_id, section, seq, runs, para_ref.

    Without a reference they take the last top-level paragraph's. Their ids follow on the greatest in the section.
    """
    number = F.regexp_extract("open", r'\sid="(\d+)"', 1).try_cast("bigint")
    own = found.where("kind = 'p'").groupBy(*KEY).agg(F.coalesce(F.max(number), F.lit(-1)).alias("last_id"), F.max_by("open", F.when(F.col("depth") == 0, F.col("start"))).alias("last_open"), F.max_by("name", F.when(F.col("depth") == 0, F.col("start"))).alias("name"))
    ends = found.where("kind = 'end'").select(*KEY, "start").join(own, KEY, "left")
    ref = F.coalesce("para_ref", F.regexp_extract("last_open", r'\sparaPrIDRef="([^"]*)"', 1), F.lit("0"))
    name = F.coalesce("name", F.lit("hp:p"))
    prefix = F.regexp_extract(name, "^(.*:)?", 0)
    nth = F.row_number().over(W.partitionBy(*KEY).orderBy("seq"))
    xml = F.concat(F.lit("<"), name, F.lit(' id="'), (F.coalesce("last_id", F.lit(-1)) + nth).cast("string"), F.lit('" paraPrIDRef="'), escape_xml(ref), F.lit('" styleIDRef="0" pageBreak="0" columnBreak="0" merged="0">'), _runs_xml(prefix, F.col("runs")), F.lit("</"), name, F.lit(">"))
    rows = new.join(ends, KEY).select(*KEY, "start", nth.alias("nth"), xml.alias("new_xml"))
    return rows.groupBy(*KEY, "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "new_xml"))), lambda x: x["new_xml"]), "").alias("new_xml")).select(*KEY, "start", F.col("start").alias("stop"), "new_xml")


def splice(sections: DataFrame, places: DataFrame) -> DataFrame:
    """sections with places (start, stop, new_xml) put in; sections without any are as they were, byte for byte."""
    kinds = {c: sections.schema[c].dataType.simpleString() for c in KEY}
    by = places.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "new_xml"))).alias("places"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for xml, own in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if own:
                    parts, at = [], 0
                    for p in own:
                        parts += [xml[at : p["start"]], p["new_xml"].encode()]
                        at = p["stop"]
                    xml = b"".join([*parts, xml[at:]])
                out.append(xml)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "section", "xml"])

    return sections.select(*KEY, "xml").join(by, KEY, "left").mapInArrow(put, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", xml binary")


def save(sections: DataFrame, edits: DataFrame, new: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections after the edits and the new paragraphs, edits with their status)."""
    found = spans(sections)
    done = resolved(found, edits)
    places = done.where("status = 'ok'").select(*KEY, "start", "stop", "new_xml")
    return splice(sections, places if new is None else places.union(appended(found, new))), done


def read_sections(packages: DataFrame) -> DataFrame:
    """(doc_id, section, xml) of packages (doc_id, content); sections in the order of their part names as text."""
    kind = packages.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.sources.packages import Package

        for b in batches:
            for i, content in enumerate(b.column(1).to_pylist()):
                package = Package(content)
                for k, name in enumerate(package.sections()):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i])), pa.array([k], pa.int64()), pa.array([package.read(name)], pa.binary())], names=["doc_id", "section", "xml"])

    return packages.select("doc_id", "content").mapInArrow(scan, f"doc_id {kind}, section long, xml binary")


def rewrite(content: bytes, sections: dict[int, bytes]) -> bytes:
    """A package with other bytes for some sections; all other entries keep their bytes, order, times and methods."""
    from quire.sources.packages import Package

    package, out = Package(content), io.BytesIO()
    new = {name: sections[k] for k, name in enumerate(package.sections()) if k in sections}
    with zipfile.ZipFile(out, "w") as z:
        for info in package.zip.infolist():
            z.writestr(info, new[info.filename] if info.filename in new else package.read(info.filename), info.compress_type)
    return out.getvalue()


def write_back(packages: DataFrame, changed: DataFrame) -> DataFrame:
    """packages (doc_id, content) with changed sections (doc_id, section, xml); a package without any is returned as it is."""
    kind = packages.schema["doc_id"].dataType.simpleString()
    by = changed.groupBy("doc_id").agg(F.collect_list(F.struct("section", "xml")).alias("sections"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [rewrite(c, {s["section"]: s["xml"] for s in own}) if own else c for c, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return packages.select("doc_id", "content").join(by, "doc_id", "left").mapInArrow(put, f"doc_id {kind}, content binary")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections' XML: a paragraph for each line; one with a "|" holds a table, a cell for each piece."""
    p = paragraphs(spark, sf_dir)
    clean = lambda t: escape_xml(sanitize(t))
    run = lambda t: F.concat(F.lit('<hp:run charPrIDRef="0"><hp:t>'), clean(t), F.lit("</hp:t></hp:run>"))
    cell = lambda t: F.concat(F.lit('<hp:tc><hp:subList><hp:p id="9" paraPrIDRef="3">'), run(t), F.lit("</hp:p></hp:subList></hp:tc>"))
    table_ = F.concat(F.lit('<hp:run charPrIDRef="0"><hp:tbl rowCnt="1"><hp:tr>'), F.array_join(F.transform(F.split("text", r"\|"), cell), ""), F.lit("</hp:tr></hp:tbl></hp:run>"))
    xml = F.concat(F.format_string('<hp:p id="%d" paraPrIDRef="0">', F.col("block")), F.when(F.col("simple"), run(F.col("text"))).otherwise(table_), F.lit("</hp:p>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", xml.alias("xml")))), lambda x: x["xml"]), "")
    return p.groupBy(*KEY).agg(F.concat(F.lit('<?xml version="1.0"?><hs:sec><!-- <hp:p> -->'), body, F.lit("</hs:sec>")).cast("binary").alias("xml"))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New text for every fifth paragraph element, another shape for every seventh, every third table replaced."""
    n = F.size(F.split("text", r"\|"))
    p = paragraphs(spark, sf_dir).withColumn("own", F.when(F.col("simple"), 1).otherwise(1 + n))
    order = W.partitionBy("doc_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumn("ord", F.coalesce(F.sum("own").over(order), F.lit(0))).withColumn("tables", F.coalesce(F.sum(F.when(F.col("simple"), 0).otherwise(1)).over(order), F.lit(0)))
    each = p.select(*KEY, F.explode(F.sequence(F.col("ord"), F.col("ord") + F.col("own") - 1)).alias("ord"))
    text = F.array(F.struct(F.lit("4").alias("char_ref"), F.format_string("a < %d & ", F.col("ord")).alias("text")), F.struct(F.lit(None).cast("string").alias("char_ref"), F.lit('"z"').alias("text")))
    none = lambda kind: F.lit(None).cast(kind)
    edits = each.where("ord % 5 = 0 or ord % 7 = 0").select(*KEY, F.lit("p").alias("kind"), "ord", F.when(F.col("ord") % 5 == 0, text).alias("runs"), F.when(F.col("ord") % 7 == 0, "7").alias("para_ref"), none("boolean").alias("page_break"), none("string").alias("xml"))
    tables = p.where("not simple and tables % 3 = 0").select(*KEY, F.lit("tbl").alias("kind"), F.col("tables").alias("ord"), none(RUNS).alias("runs"), none("string").alias("para_ref"), none("boolean").alias("page_break"), F.lit('<hp:tbl rowCnt="0"/>').alias("xml"))
    return edits.unionByName(tables)


#: Paragraph elements in their order, with what becomes of each by the rules of the module.
_ESC = "replace(replace(replace(replace(regexp_replace({0}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_SAVED = f"""{PARAGRAPH}, b AS (SELECT *, string_split(text, '|') AS cells, CASE WHEN simple THEN 1 ELSE 1 + len(string_split(text, '|')) END AS own FROM paragraph),
o AS (SELECT *, coalesce(sum(own) OVER w, 0)::BIGINT AS ord, coalesce(sum(CASE WHEN simple THEN 0 ELSE 1 END) OVER w, 0) % 3 = 0 AND NOT simple AS gone FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
el AS (SELECT doc_id, block, simple, gone, own, ord + j AS ord, j, CASE WHEN j = 0 THEN text ELSE cells[j] END AS text FROM (SELECT *, unnest(range(own)) AS j FROM o)),
st AS (SELECT *, CASE WHEN ord % 5 <> 0 AND ord % 7 <> 0 THEN NULL WHEN ord % 5 = 0 AND j = 0 AND NOT simple THEN 'structural' WHEN j > 0 AND gone THEN 'covered' ELSE 'ok' END AS status FROM el),
x AS (SELECT *, '<hp:p id="' || CASE WHEN j = 0 THEN block ELSE 9 END || '" paraPrIDRef="' || CASE WHEN status = 'ok' AND ord % 7 = 0 THEN 7 WHEN j = 0 THEN 0 ELSE 3 END || '">' AS tag,
  CASE WHEN status = 'ok' AND ord % 5 = 0 THEN '<hp:run charPrIDRef="4"><hp:t>a &lt; ' || ord || ' &amp; </hp:t></hp:run><hp:run charPrIDRef="0"><hp:t>&quot;z&quot;</hp:t></hp:run>' ELSE '<hp:run charPrIDRef="0"><hp:t>' || {_ESC.format("text")} || '</hp:t></hp:run>' END AS runs FROM st),
c AS (SELECT doc_id, block, string_agg('<hp:tc><hp:subList>' || tag || runs || '</hp:p></hp:subList></hp:tc>', '' ORDER BY j) AS cells FROM x WHERE j > 0 GROUP BY ALL),
p AS (SELECT x.doc_id, x.block, tag || CASE WHEN simple THEN runs WHEN gone THEN '<hp:run charPrIDRef="0"><hp:tbl rowCnt="0"/></hp:run>' ELSE '<hp:run charPrIDRef="0"><hp:tbl rowCnt="1"><hp:tr>' || cells || '</hp:tr></hp:tbl></hp:run>' END || '</hp:p>' AS xml FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.block = x.block WHERE j = 0)"""


@query(f"WITH {_SAVED}, s AS (SELECT doc_id, '<?xml version=\"1.0\"?><hs:sec><!-- <hp:p> -->' || string_agg(xml, '' ORDER BY block) || '</hs:sec>' AS xml FROM p GROUP BY doc_id) SELECT doc_id, strlen(xml)::BIGINT AS bytes, sha256(xml) AS digest FROM s")
def saved_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = save(_sections(spark, sf_dir), _edits(spark, sf_dir))
    return after.select("doc_id", F.octet_length("xml").cast("long").alias("bytes"), F.sha2("xml", 256).alias("digest"))


@query(f"WITH {_SAVED} SELECT doc_id, 'p' AS kind, ord, status FROM st WHERE status IS NOT NULL UNION ALL SELECT doc_id, 'tbl', row_number() OVER (PARTITION BY doc_id ORDER BY block) * 3 - 3, 'ok' FROM o WHERE gone")
def edit_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, done = save(_sections(spark, sf_dir), _edits(spark, sf_dir))
    return done.select("doc_id", "kind", "ord", "status")
