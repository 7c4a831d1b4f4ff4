"""The queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, divergence, exactdup, extract, fim, langid, licenses, minhash, outliers, packing, pii, warc
from tessera.llm.shared import saved


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_decontamination(spark, sf_dir):
    return decontaminate.report(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op3_warc(spark, sf_dir):
    found = saved(warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")), payloads=False), "records")
    warc.quarantine(found)  # the log; sound() then fails if it has a row
    return warc.report(warc.sound(found))


def op4_quality(spark, sf_dir):
    return outliers.report(outliers.rules(_table(spark, sf_dir, "documents")))


def op5_licenses(spark, sf_dir):
    return licenses.report(licenses.scan(_table(spark, sf_dir, "documents")))


def op6_extraction(spark, sf_dir):
    return extract.report(extract.main_text(_table(spark, sf_dir, "pages")))


def op7_chat(spark, sf_dir):
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.report(chat.format_chats(said.union(more)))


def op8_language(spark, sf_dir):
    found = langid.identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_pii(spark, sf_dir):
    return pii.replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op10_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_fim(spark, sf_dir):
    return fim.report(fim.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_exact(spark, sf_dir):
    return exactdup.exact_copies(_table(spark, sf_dir, "documents"))


def op13_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_minhash, op2_decontamination, op3_warc, op4_quality, op5_licenses, op6_extraction, op7_chat, op8_language, op9_pii, op10_packing, op11_fim, op12_exact, op13_divergence, pipeline)}


#: op7: DuckDB reads the source alone; its lengths of rendered chats follow the grammar of tessera.llm.chat.
_OP7 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), each AS (
  SELECT *, replace(replace(text, '\', '\\'), '</turn', '<\/turn') AS safe, text LIKE '%</turn>' || chr(10) || '%' OR role LIKE '%' || chr(10) || '%' OR text LIKE '% </turn>' || chr(10) || '%' AS odd FROM said
), chats AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    9 + sum(length(role) + length(text) + 15) AS plain, 9 + sum(length(role) + length(safe) + 15) AS escaped, bool_or(odd) AS odd
  FROM each GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(CASE WHEN odd THEN escaped ELSE plain END AS BIGINT) AS formatted_chars
FROM chats
"""


#: Words by the two rules, of a column of texts; A-Z are lowered, nothing else.
_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = "regexp_extract_all(" + _LOW + r", '[^\x20\x09-\x0D]+')"
_ALNUM = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: op1: all pairs that share a shingle, counted; components by the smallest id that repeated steps along links reach.
_OP1 = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_PLAIN.format('text')} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS MATERIALIZED (SELECT min(doc_id) AS rep, list(doc_id) AS ids, any_value(n) AS n, sig FROM (SELECT doc_id, n, sig FROM n JOIN (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS sig FROM s GROUP BY 1) USING (doc_id)) GROUP BY sig),
c AS MATERIALIZED (SELECT g, doc_id FROM s JOIN k ON rep = doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM c x JOIN c y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
r AS (SELECT rep AS a, rep AS b FROM k UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT unnest(ids) AS doc_id, root FROM k JOIN (SELECT a, min(b) AS root FROM r GROUP BY 1) ON a = rep)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: op2: windows of items joined with windows of as many words of documents.
_OP2 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM.format('text')} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda x: array_to_string(w[x:x + 9], ' '))) AS g FROM i WHERE len(w) > 0),
d AS MATERIALIZED (SELECT doc_id, {_ALNUM.format('text')} AS w FROM documents),
o AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS place, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) AS g FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT doc_id, item, k, place AS first FROM o JOIN p USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(first, first + k)) AS place FROM f) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: op3: five hex digits of a digest are four of base 32.
_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, strlen(h) AS n, upper(sha1(h)) AS x, max(page_id) OVER (PARTITION BY h) AS first FROM p),
v AS (SELECT *, list_transform(range(0, 32), lambda i: (CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31) AS five FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(five, lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM v
"""


def _op5():
    """op5: grams as texts; a vote is a template's place on a diagonal, each counted once; runs of near diagonals are spans."""
    rows = [(tid, label, base, 3 if three else 2, place, grams, " ".join(x for x in (one, two, three) if x)) for tid, label, base, place, grams, one, two, three in licenses.places()]
    listed = ", ".join(f"({tid}, '{label}', {base}, {k}, {place}, {grams}, '{gram}')" for tid, label, base, k, place, grams, gram in rows)
    return f"""
WITH t(tid, label, base, k, place, grams, gram) AS (VALUES {listed}),
d AS MATERIALIZED (SELECT doc_id, {_ALNUM.format('text')} AS w FROM documents),
g AS (SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS spot, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram FROM d, (VALUES (2), (3)) AS x(k) WHERE len(w) >= k),
v AS (SELECT doc_id, tid, label, base, grams, spot - place AS diagonal, place FROM g JOIN t USING (k, gram)),
f AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal, place) > CASE WHEN base THEN 0 ELSE {licenses.SHIFT} END, true) AS fresh FROM v),
n AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, tid ORDER BY diagonal, place ROWS UNBOUNDED PRECEDING) AS run FROM f),
r AS (SELECT doc_id, tid, run, label, base, grams, CAST(count(DISTINCT place) AS DOUBLE) / grams AS share, min(diagonal) AS first, max(diagonal) AS last FROM n GROUP BY doc_id, tid, run, label, base, grams),
s AS (SELECT * FROM r WHERE CASE WHEN base THEN share = 1 ELSE share >= CAST({licenses.LEAST} AS DOUBLE) AND last - first <= grams END),
b AS (SELECT doc_id, count_if(base) AS n_base, min(CASE WHEN base THEN first END) AS first_word, max(CASE WHEN base THEN first END) AS last_word, string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM s GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score FROM d LEFT JOIN b USING (doc_id)
"""


#: op11: lines as a list; a text without marks and its form fix both the output and what is restored.
_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || doc_id) AS h FROM documents),
e AS (SELECT *, len(l) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, CAST(i AS BIGINT), 8) AS BIGINT)) AS x FROM d),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 100 THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e),
p AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

#: op12: windows over lowered texts.
_OP12 = f"""
WITH d AS (SELECT doc_id, sha256({_LOW.format('text')}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d
"""

#: op13: every kept term with every source, absent ones too, and all ordered pairs of sources term by term.
_OP13 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW.format('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1) // CAST(total + v AS HUGEINT) AS p FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 1) // CAST(any_value(total) + any_value(v) AS HUGEINT) AS q FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM s GROUP BY 1) USING (lang) GROUP BY lang, term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM z WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql():
    return {"op11_fim": _OP11, "op12_exact": _OP12, "op13_divergence": _OP13, "op1_minhash": _OP1, "op2_decontamination": _OP2, "op3_warc": _OP3, "op5_licenses": _op5(), "op7_chat": _OP7}
