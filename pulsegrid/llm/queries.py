"""The registered queries of this subpackage, each over its whole table, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import bpe, conversations, decontaminate, html_text, langid, licenses, neardup, pii, quality, token_files, toxicity, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.search(docs, pii.train(docs))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality, op2_pii, op3_bpe, op4_toxicity, op5_token_files, op6_warc, op7_decontaminate, op8_language, op9_html_text, op10_near_copies, op11_licenses, op12_whitening, op13_conversations)}

_BLANK = r"[ \t\n\x0b\f\r]+"
_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in quality.STOP_WORDS.values() for w in ws.split()}))
_RULES = " AND ".join(f"{r.metric} {op} {v}" for r in quality.RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None)
_OP1 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '{_BLANK}'), lambda s: s <> '') AS ws,
  list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^ \t\n\x0b\f\r]')) AS ls,
  list_filter(regexp_split_to_array(lower(x), '[ \t\n\x0b\f\r.,;:!?"()#*$%&|<>]+'), lambda s: s <> '') AS lw FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i AS p FROM r UNION ALL SELECT doc_id, i + 1 FROM r UNION ALL SELECT doc_id, i + 2 FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(x, '{_BLANK}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(x, '[^!]+', '', 'g')) AS bangs, length(regexp_replace(x, '[^\p{{Lu}}]+', '', 'g')) AS uppers,
  len(list_distinct(lw)) AS own, len(list_filter(lw, lambda s: s IN ({_STOP}))) AS stops, len(ls) AS lines FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_chars, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_ratio, bangs / greatest(n_words, 1)::DOUBLE AS exclamation_ratio,
  uppers / greatest(word_chars, 1)::DOUBLE AS upper_ratio, stops / greatest(n_words, 1)::DOUBLE AS stop_word_ratio, own / least(greatest(n_words, 1)::DOUBLE, 100 * sqrt(greatest(n_words, 1)::DOUBLE)) AS distinct_word_ratio, n_dup_lines / greatest(lines, 1)::DOUBLE AS dup_line_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({_RULES}) AS kept FROM q
"""

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS top FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('{_DIGITS}', (('0x' || substr(s, 5 * (k // 4) + 1, 5))::BIGINT // (1 << (15 - 5 * (k % 4)))) % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIND = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP7 = f"""
WITH dw AS (SELECT doc_id, {_FIND.format(_LOWER.format("text"))} AS ws FROM documents),
bw AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM (SELECT item_id, {_FIND.format(_LOWER.format("text"))} AS ws FROM benchmark) WHERE len(ws) > 0),
bi AS (SELECT DISTINCT item_id, m, array_to_string(ws[i : i + m - 1], ' ') AS p FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM bw)),
di AS (SELECT doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS p FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM bi) WHERE len(ws) >= m)),
h AS (SELECT di.doc_id, di.i, di.m, bi.item_id FROM di JOIN bi ON di.m = bi.m AND di.p = bi.p),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN n ON dw.doc_id = n.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""

_PHRASES = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licenses.PHRASES.items())
_NOTICES = ", ".join(f"('{label}', '{' '.join(w.decode() for w in licenses.words_of(text))}')" for label, text in licenses.NOTICES.items())
_HALF = licenses.BLOCK // 2
_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_FIND.format(_LOWER.format("text"))} AS ws FROM documents),
p AS (SELECT row, i - 1 AS pos, label FROM (SELECT row, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), (VALUES {_PHRASES}) f(phrase, label, k) WHERE array_to_string(ws[i : i + k - 1], ' ') = phrase),
b AS (SELECT row, count(*) AS n, min(pos) AS low, max(pos) AS high, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM p GROUP BY row),
t AS (SELECT label, w, count(*) AS c, any_value(len(ws)) AS size FROM (SELECT label, ws, unnest(ws) AS w FROM (SELECT label, string_split(x, ' ') AS ws FROM (VALUES {_NOTICES}) f(label, x))) GROUP BY label, w),
o AS (SELECT row, pos, w, count(*) AS c FROM (SELECT row, pos, unnest(ws[pos + 1 : pos + {licenses.BLOCK}]) AS w FROM (SELECT row, ws, unnest(range(0, greatest(1, len(ws) - {_HALF}), {_HALF})) AS pos FROM d)) GROUP BY row, pos, w),
m AS (SELECT row, label, max(share) AS share FROM (SELECT row, pos, label, sum(least(o.c, t.c)) AS n, any_value(size) AS size, sum(least(o.c, t.c)) / any_value(size)::DOUBLE AS share FROM o JOIN t ON o.w = t.w GROUP BY row, pos, label) WHERE n >= ceil({licenses.CONTAINED} * size - 1e-9) GROUP BY row, label),
l AS (SELECT row, array_to_string(list_sort(list(label)), ',') AS labels FROM (SELECT row, label FROM p UNION SELECT row, label FROM m) GROUP BY row),
s AS (SELECT row, max(share) AS share FROM m GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, low::BIGINT AS first_word, high::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b ON d.row = b.row LEFT JOIN l ON d.row = l.row LEFT JOIN s ON d.row = s.row
"""

_CRC = """list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"""


def _edit(state: str, cost: str, initial: str, line: str = "''", when: str | None = None) -> str:
    """The path to ``state`` with one more edit; one that never pays where ``when`` doesn't hold."""
    made = f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 't': {state}.t || {line}}}"
    return f"CASE WHEN {when} THEN {made} ELSE {{'c': 1000000000, 'a': '', 't': ''}} END" if when else made


_STAYS, _COST = "f NOT IN (1, 2)", "(CASE WHEN f = 3 THEN 1 ELSE 0 END)"
_keep = lambda state, initial: _edit(state, _COST, "K", "chr(10) || r || ':' || x", f"{_STAYS} AND left(r, 1) = '{initial}'")
_role = lambda state, role: _edit(state, f"2 + {_COST}", "R", f"chr(10) || '{role}:' || x", _STAYS)
_add = lambda state, role: _edit(state, "2", "I", f"chr(10) || '{role}:'")
# paths that end with nothing (0), a system turn (1), a user's (2), an assistant's (3): the least by cost, then by edits
_OP13 = f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda z: ascii(z)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS k
  FROM conversations, (SELECT {_CRC} AS tab)),
v AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r END AS r, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS x, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS again FROM d WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS i, right(rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS e FROM v),
w AS (SELECT *, CASE WHEN e = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, r, x ORDER BY i) > 1 THEN 2 WHEN e NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f, coalesce(left(lag(r) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(r, 1) NOT IN ('su', 'ua', 'au'), false) AS bad FROM o),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (bad) AS illegal FROM w GROUP BY conv_id),
p AS (SELECT conv_id, 0 AS i, s0, s1, s2, {_add("s2", "assistant")} AS s3 FROM (SELECT *, {_add("s0", "user")} AS s2 FROM (SELECT DISTINCT conv_id, {{'c': 0, 'a': '', 't': ''}} AS s0, {{'c': 1000000000, 'a': '', 't': ''}} AS s1 FROM conversations))
UNION ALL SELECT conv_id, i, s0, s1, s2, least(s3, {_add("s2", "assistant")}) AS s3 FROM (
  SELECT conv_id, i, s0, s1, s3, least(s2, {_add("s0", "user")}, {_add("s1", "user")}, {_add("s3", "user")}) AS s2 FROM (
    SELECT p.conv_id, w.i::INT AS i, {_edit("s0", "3", "D")} AS s0, least({_edit("s1", "3", "D")}, {_keep("s0", "s")}) AS s1,
      least({_edit("s2", "3", "D")}, {", ".join(f"{_keep(q, 'u')}, {_role(q, 'user')}" for q in ("s0", "s1", "s3"))}) AS s2,
      least({_edit("s3", "3", "D")}, {_keep("s2", "a")}, {_role("s2", "assistant")}) AS s3
    FROM p JOIN w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.i = p.i + 1)))
SELECT p.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  least(s0, s3).c::BIGINT AS cost, least(s0, s3).a AS audit, sha256(substr(least(s0, s3).t, 2)) AS repaired_sha256
FROM p LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(n, 0)
"""

ORACLE_SQL: dict[str, str] = {"op1_quality": _OP1, "op6_warc": _OP6, "op7_decontaminate": _OP7, "op11_licenses": _OP11, "op13_conversations": _OP13}
