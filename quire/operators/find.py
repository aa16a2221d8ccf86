"""Search, replacement and plain text over paragraphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.plans.registry import query
from quire.sources.adapters import PARAGRAPH, paragraphs


def searchable(paras: DataFrame) -> DataFrame:
    """Paragraphs with a node id that are simple, or whose source is not known to be otherwise."""
    return paras.where(F.col("node_id").isNotNull() & F.coalesce("simple", F.lit(True)))


def match_starts(text: Column, pattern: str, length: int) -> Column:
    """Where the matches of a pattern of fixed length start: the text between them, summed up."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda acc, gap: F.struct((acc["at"] + gap + length).alias("at"), F.array_append(acc["found"], acc["at"] + gap).alias("found"))
    return F.aggregate(gaps, start, step, lambda acc: F.slice(acc["found"], F.lit(1), F.size(acc["found"]) - 1))


def find_matches(paras: DataFrame, needle: str, *, case_sensitive: bool = False, whole_word: bool = False) -> DataFrame:
    """(doc_id, section, block, node_id, start, len): matches that do not overlap; none for an empty needle."""
    key = ["doc_id", "section", "block", "node_id"]
    rows = searchable(paras)
    if not needle:
        return rows.limit(0).select(*key, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("len"))
    pattern = X.literal_pattern(needle, case_sensitive=case_sensitive, whole_word=whole_word)
    hit = rows.where(F.rlike("text", F.lit(pattern)))
    return hit.select(*key, F.explode(match_starts(F.col("text"), pattern, len(needle))).alias("start")).select(*key, F.col("start").cast("long"), F.lit(len(needle)).cast("long").alias("len"))


def find_matches_folded(paras: DataFrame, needle: str) -> DataFrame:
    """Matches under exact case folding, each character for itself, as no regular expression folds: for all of Unicode."""
    fold = tuple(c.lower() for c in needle)

    @F.pandas_udf("array<bigint>")
    def starts(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[int]:
            if t is None or not fold:
                return []
            low, out, i = [c.lower() for c in t], [], 0
            while i + len(fold) <= len(low):
                if tuple(low[i : i + len(fold)]) == fold:
                    out.append(i)
                    i += len(fold)
                else:
                    i += 1
            return out

        return texts.map(one)

    key = ["doc_id", "section", "block", "node_id"]
    return searchable(paras).select(*key, F.explode(starts("text")).alias("start")).withColumn("len", F.lit(len(needle)).cast("long"))


def replace_all(paras: DataFrame, needle: str, new: str, **options) -> DataFrame:
    """Searchable paragraphs with `replaced`, the text with all matches replaced, and `n`, their number."""
    pattern = X.literal_pattern(needle, **options)
    safe = new.replace("\\", "\\\\").replace("$", "\\$")
    return searchable(paras).withColumn("n", F.regexp_count("text", F.lit(pattern)).cast("long")).withColumn("replaced", F.regexp_replace("text", pattern, safe))


def first_match(matches: DataFrame) -> DataFrame:
    """Of each document the first match in reading order."""
    best = F.min(F.struct("section", "block", "start", "node_id", "len")).alias("m")
    return matches.groupBy("doc_id").agg(best).select("doc_id", "m.section", "m.block", "m.node_id", "m.start", "m.len")


def plain_text(paras: DataFrame) -> DataFrame:
    """(doc_id, text): a line break after each paragraph, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("section", "block", "text"))), lambda x: x["text"])
    return paras.groupBy("doc_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("plain"))


def markdown_lines(paras: DataFrame) -> DataFrame:
    """(doc_id, section, block, line): paragraphs that are not blank, each after its anchor."""
    shown = paras.where(X.trim(F.col("text")) != "")
    return shown.select("doc_id", "section", "block", F.concat(F.lit("[s"), F.col("section").cast("string"), F.lit("/b"), F.col("block").cast("string"), F.lit("] "), "text").alias("line"))


def _oracle_matches(needle: str, condition: str = "", flag: str = "(?i)") -> str:
    pieces = f"string_split_regex(text, '{flag}{needle}')"
    n = len(needle)
    return f"""WITH {PARAGRAPH},
piece AS (SELECT *, list_transform({pieces}, lambda x: length(x)) AS l FROM paragraph WHERE simple AND len({pieces}) > 1),
hit AS (SELECT doc_id, section, block, node_id, text, unnest(list_transform(range(1, len(l)), lambda j: list_sum(l[1:j]) + (j - 1) * {n}))::BIGINT AS start FROM piece)
SELECT doc_id, section, block, node_id, start, {n}::BIGINT AS len FROM hit {condition}"""


_ALONE = "WHERE NOT regexp_matches(substr(text, start, CASE WHEN start > 0 THEN 1 ELSE 0 END), '[\\p{L}\\p{N}_]') AND NOT regexp_matches(substr(text, start + 4, 1), '[\\p{L}\\p{N}_]')"


@query(_oracle_matches("tion"))
def find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(paragraphs(spark, sf_dir), "tion")


@query(_oracle_matches("the", _ALONE))
def find_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(paragraphs(spark, sf_dir), "the", whole_word=True)


@query(_oracle_matches("The", flag=""))
def find_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(paragraphs(spark, sf_dir), "The", case_sensitive=True)


@query()
def find_text_unicode_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches_folded(paragraphs(spark, sf_dir), "É")


@query(f"WITH {PARAGRAPH} SELECT doc_id, sum(len(string_split_regex(text, '(?i)and')) - 1)::BIGINT AS n FROM paragraph WHERE simple GROUP BY doc_id")
def find_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_all(paragraphs(spark, sf_dir), "and", "").groupBy("doc_id").agg(F.sum("n").alias("n"))


@query(f"WITH {PARAGRAPH} SELECT doc_id, block, (len(string_split_regex(text, '(?i)the')) - 1)::BIGINT AS n, regexp_replace(text, '(?i)the', '<$1\\>', 'g') AS replaced FROM paragraph WHERE simple AND regexp_matches(text, '(?i)the')".replace("'<$1\\>'", "'<$1>'"))
def replace_all_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_all(paragraphs(spark, sf_dir), "the", "<$1>").where("n > 0").select("doc_id", "block", "n", "replaced")


@query(f"""WITH m AS ({_oracle_matches('tion')}), f AS (SELECT doc_id, min(block * 1000000 + start) AS k FROM m GROUP BY doc_id), {PARAGRAPH}
SELECT f.doc_id, p.block, substr(p.text, 1, (k % 1000000)::INT) || 'TION' || substr(p.text, (k % 1000000)::INT + 5) AS replaced FROM f JOIN paragraph p ON p.doc_id = f.doc_id AND p.block = k // 1000000""")
def replace_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = paragraphs(spark, sf_dir)
    first = first_match(find_matches(paras, "tion")).select("doc_id", "block", "start")
    return paras.join(first, ["doc_id", "block"]).select("doc_id", "block", F.overlay("text", F.lit("TION"), F.col("start") + 1, F.lit(4)).alias("replaced"))


@query(f"WITH {PARAGRAPH} SELECT doc_id, string_agg(text, chr(10) ORDER BY block) || chr(10) AS plain FROM paragraph GROUP BY doc_id", name="plain_text")
def plain_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_text(paragraphs(spark, sf_dir))


@query(f"WITH {PARAGRAPH} SELECT doc_id, section, block, '[s' || section || '/b' || block || '] ' || text AS line FROM paragraph WHERE regexp_replace(text, '[\\s\\x{{00A0}}\\x{{3000}}]', '', 'g') <> ''", name="markdown_lines")
def markdown_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_lines(paragraphs(spark, sf_dir))


@query(f"WITH {PARAGRAPH} SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY section, block) AS node_id FROM paragraph WHERE simple")
def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.layout import assign_node_ids

    return assign_node_ids(paragraphs(spark, sf_dir).where("simple")).select("doc_id", "block", F.col("node_id").cast("long"))


@query(f"WITH {PARAGRAPH} SELECT doc_id, section, block, node_id, length(text)::BIGINT AS chars FROM paragraph WHERE simple")
def searchable_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searchable(paragraphs(spark, sf_dir)).select("doc_id", "section", "block", "node_id", F.length("text").cast("long").alias("chars"))


@query(f"""WITH {PARAGRAPH} SELECT doc_id, block, CASE WHEN length(text) > 24 THEN substr(text, 1, 24) || '…' ELSE text END AS cut, CASE WHEN length(text) > 24 THEN substr(text, 1, 23) || '…' ELSE text END AS elided,
replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS clean FROM paragraph""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return paragraphs(spark, sf_dir).select("doc_id", "block", X.truncate(t, 24).alias("cut"), X.elide(t, 24).alias("elided"), X.escape_xml(t).alias("escaped"), X.sanitize(t).alias("clean"))
