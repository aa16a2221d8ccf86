"""The queries of the text operators, and SQL for those that SQL can express.

The recurrent network, XXH64 fingerprints, license rules with lookahead, BPE merges, learned rules and byte windows of
texts are beyond the SQL engine at hand; their queries are tested against brute force in tests/llm.
"""

from __future__ import annotations

import importlib
import pkgutil
import re

import quire.llm

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
least_ AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN least_ USING (s) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(range(len(w))) AS k, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html FROM pages),
top AS (SELECT html, max(page_id) AS m FROM p GROUP BY html)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + (5 * j) // 4, 2))::INT >> (3 - (5 * j) % 4)::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM p JOIN top USING (html)"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i + 1 : i + 10], ' ') AS s FROM (SELECT *, unnest(range(greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT size FROM item),
win AS (SELECT doc_id, i, size, array_to_string(w[i + 1 : i + size], ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, size WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, size, item_id FROM win JOIN item USING (s, size)),
place AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(place.n, 0)::BIGINT AS n_hit, coalesce(own.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, place.n IS NOT NULL AS contaminated
FROM d LEFT JOIN place ON place.doc_id = d.doc_id LEFT JOIN own ON own.doc_id = d.doc_id"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>')) + 24 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

DIVERGENCE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM t GROUP BY ALL HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT g.lang, g.source, kept.term, coalesce(t.n, 0) AS n, kept.n AS all_n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = kept.term),
tot AS (SELECT lang, source, sum(n)::BIGINT AS own_n, sum(all_n)::BIGINT AS lang_n, count(*) AS v FROM own GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (own_n + 2 * v) AS p, 1 + 1000000000 * (all_n + 2) // (lang_n + 2 * v) AS q FROM own JOIN tot USING (lang, source)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
own_terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM own_terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""

#: CRC-32, which the engine has no function for: a table that follows from the polynomial, and a fold over the bytes.
_CRC_TABLE = "crc_table AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, u: xor(v >> 1, (v & 1) * 3988292384)) ORDER BY b) AS tb FROM (SELECT unnest(range(256)) AS b))"


def _crc(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda v: ('0x' || v)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1])))"


SHARDING = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT + 8 AS size, {_crc("coalesce(text, '')")} AS crc FROM documents, crc_table),
h AS (SELECT *, ('0x' || substr(md5('=20|' || coalesce('=' || doc_id, '-') || '|=' || crc), 1, 15))::BIGINT AS h,
  (('0x' || substr(md5('=20|' || coalesce('=' || source, '-')), 1, 15))::BIGINT >> 40) / 1048576.0::DOUBLE AS shift FROM d),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, crc) - 1 + shift) / count(*) OVER (PARTITION BY source) AS place FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY place, source NULLS FIRST, h, doc_id, crc) - 1 AS pos, count(*) OVER () AS n FROM r),
s AS (SELECT *, pos * 24 // n AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard::INT AS shard, pos - (shard * n + 23) // 24 AS slot, NULL::INT AS grown_shard FROM s"""

_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ["doc_id", "source", "lang", "n_chars", "text"])
_CHANGED = _FIELDS.replace("text::VARCHAR", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, source, sha256({_FIELDS}) AS leaf, CASE WHEN {_crc("coalesce(doc_id::VARCHAR, '')")} % 5 = 0 AND doc_id IS NOT NULL THEN sha256({_CHANGED}) END AS changed FROM documents, crc_table),
lf AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (SELECT tree, 0 AS level, k, n, leaf AS h FROM lf UNION ALL SELECT tree, level + 1, k // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY k)) FROM up WHERE n > 1 GROUP BY tree, level, k // 16),
sub AS (SELECT tree, h AS subroot FROM up WHERE n = 1),
top AS (SELECT 0 AS level, tree AS k, (SELECT count(*) FROM sub) AS n, subroot AS h FROM sub UNION ALL SELECT level + 1, k // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY k)) FROM top WHERE n > 1 GROUP BY level, k // 16),
node AS (SELECT tree AS t, level, k, h FROM up UNION ALL SELECT -1, level, k, h FROM top),
path AS (SELECT tree, lf.k AS leaf_k, level AS step, tree AS t, level, lf.k >> (4 * level) AS own FROM lf JOIN (SELECT DISTINCT tree, level FROM up WHERE n > 1) USING (tree)
  UNION ALL SELECT tree, lf.k, 1000 + level, -1, level, tree >> (4 * level) FROM lf, (SELECT DISTINCT level FROM top WHERE n > 1)),
side AS (SELECT tree, leaf_k, step, coalesce(string_agg(h, '' ORDER BY node.k) FILTER (node.k < own), '') AS b, coalesce(string_agg(h, '' ORDER BY node.k) FILTER (node.k > own), '') AS a
  FROM path JOIN node ON node.t = path.t AND node.level = path.level AND node.k >> 4 = own >> 4 GROUP BY ALL),
proof AS (SELECT tree, leaf_k, string_agg(b || a, '' ORDER BY step) AS proof, list(b || '*' || a ORDER BY step) AS sides FROM side GROUP BY ALL),
fold AS (SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(changed, leaf), coalesce(sides, [])), lambda c, s: sha256(split_part(s, '*', 1) || c || split_part(s, '*', 2))) AS folded_root
  FROM lf JOIN sub USING (tree) LEFT JOIN proof ON proof.tree = lf.tree AND leaf_k = lf.k)
SELECT *, folded_root = root AS verified FROM fold"""


def queries() -> dict:
    """opN_<name> of each module of that name, by N."""
    names = sorted((m.name for m in pkgutil.iter_modules(quire.llm.__path__) if re.match(r"op\d+_", m.name)), key=lambda x: int(re.match(r"op(\d+)", x)[1]))
    return {name: getattr(importlib.import_module(f"quire.llm.{name}"), name) for name in names}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring": SUBSTRING, "op5_warc": WARC, "op6_decontamination": DECONTAMINATION, "op8_chat": CHAT, "op11_divergence": DIVERGENCE, "op12_sharding": SHARDING, "op13_merkle": MERKLE}
