"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import chat_format, decontaminate, exact_dedup, fim, fm_dedup, html_extract, language_id, license_scan, mixing, ngram_lm, simhash, spelling, warc
from quillgraph.llm.common import remainder, table

QUERIES = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run
    return add


@register(r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (SELECT *, lag(role) OVER w AS before,
    length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) AS n_text,
    length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) AS n_role
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(n_text + CASE WHEN before IS NOT DISTINCT FROM role THEN length('<|cont|>') ELSE length('<|start|><|sep|><|end|>') + n_role END) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id""")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chat_format.format_chats(rows)
    read = chats.select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"), chat_format.read_back(F.col("formatted")).alias("turns"),
                        chat_format.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


@register(r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS place FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS w, source_size * 3 AS cap FROM sums),
leveled AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
fixed AS (SELECT arg_min(level, (cap / w, source)) AS level FROM leveled WHERE level * w <= cap),
goals AS (SELECT source, source_size, w, CASE WHEN (SELECT level FROM fixed) IS NULL THEN CAST(cap AS DOUBLE)
    ELSE least(CAST(cap AS DOUBLE), (SELECT level FROM fixed) * w) END AS target FROM weighed),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals),
ties AS (SELECT r.source, r.place, sum(r.size) AS n FROM rows r GROUP BY r.source, r.place),
run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ties),
took AS (SELECT t.source, t.place, p.source_size, p.target, p.whole, (t.below + t.n <= p.target - p.whole * p.source_size AND t.n > 0)
      OR ((p.target - p.whole * p.source_size) - t.below) * 2 > t.n AS once
  FROM run t JOIN parts p ON t.source IS NOT DISTINCT FROM p.source)
SELECT r.doc_id, r.size, k.source_size, k.target, CAST(r.size * least(3, k.whole + CAST(k.once AS BIGINT)) AS BIGINT) AS taken
FROM rows r JOIN took k ON r.source IS NOT DISTINCT FROM k.source AND r.place = k.place""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@register(r"""
WITH keys AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
best AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST) AS keep_id
  FROM keys)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM best""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = language_id.fit(docs.filter(~held_out))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@register(r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, CAST(1 + (5 * i) // 4 AS INT), 2) AS INT) >> CAST(3 - (5 * i) % 4 AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM first""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.through_archives(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register()
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@register(r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(list_slice(words, i, i + least(10, len(words)) - 1), ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
hits AS (SELECT p.rid, p.i, s.n, w.item_id FROM places p CROSS JOIN sizes s
  JOIN windows w ON w.n = s.n AND p.i + s.n - 1 <= len(p.words) AND w.w = array_to_string(list_slice(p.words, p.i, p.i + s.n - 1), ' ')),
covered AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (rid) LEFT JOIN named n USING (rid)""")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


@register()
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register()
def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


@register(r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
    CAST('0x' || h[25:32] AS BIGINT) AS h4, len(units) AS n FROM docs),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts""")
def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def _license_sql() -> str:
    """The rules as a table of values, words and windows as lists, and overlaps by the furthest end before each detection."""
    values = ", ".join(f"({k}, {level}, '{key}', '{regex}', '{label}', CAST({weight} AS DOUBLE))" for k, level, key, regex, label, weight in license_scan.rule_rows())
    reach = " ".join(f"WHEN {k} THEN max(CASE WHEN level BETWEEN 1 AND {k} THEN stop END) OVER w" for k in license_scan.LEVELS)
    return rf"""
WITH rules(rule, level, key, regex, label, weight) AS (VALUES {values}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'),
    '{license_scan.WORD}') AS words FROM documents),
places AS (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
windows AS MATERIALIZED (SELECT rid, i - 1 AS start, words[i] AS key, array_to_string(words[i:i + {license_scan.MAX_WORDS - 1}], ' ') || ' ' AS next
  FROM places WHERE words[i] IN (SELECT key FROM rules)),
hits AS (SELECT rid, start, start + length(m) - length(replace(m, ' ', '')) AS stop, rule, level, label, weight
  FROM (SELECT w.*, r.rule, r.level, r.label, r.weight, regexp_extract(w.next, r.regex) AS m FROM windows w JOIN rules r ON w.key = r.key) WHERE m <> ''),
judged AS (SELECT *, CASE level {reach} END AS furthest FROM hits
  WINDOW w AS (PARTITION BY rid ORDER BY start, stop DESC, level, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (SELECT *, level = 0 AS base, level = 0 OR coalesce(furthest < stop, true) AS kept FROM judged),
found AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (kept)), ',') AS labels,
    max(weight) FILTER (kept) AS score FROM kept GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN found USING (rid)"""


@register(_license_sql())
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents")))


@register(r"""
WITH RECURSIVE polynomial AS (SELECT i AS b, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM polynomial WHERE k < 8),
crc_table AS (SELECT b, c FROM polynomial WHERE k = 8),
runs AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{5,}')) AS w FROM documents) GROUP BY ALL),
hexed AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs),
crc AS (SELECT doc_id, w, n, x, 1 AS i, 4294967295 AS c FROM hexed
  UNION ALL SELECT doc_id, w, n, x, i + 2, xor(r.c // 256, t.c) FROM crc r JOIN crc_table t ON t.b = xor(r.c % 256, CAST('0x' || substr(x, i, 2) AS BIGINT)) WHERE i < length(x)),
drawn AS (SELECT w, n, xor(c, 4294967295) AS h FROM crc WHERE i > length(x)),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM drawn)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.rest UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, 0 AS steps FROM formed UNION ALL SELECT up.word, f.form, steps + 1 FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.*, u.root FROM formed f JOIN (SELECT word, arg_max(root, steps) AS root FROM up GROUP BY word) u USING (word)""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
