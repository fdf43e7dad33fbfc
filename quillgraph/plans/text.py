"""Text queries: tokens, terms, co-occurrence, brand score, keywords, topics, language."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import online_topics as ot
from quillgraph.operators import terms as te
from quillgraph.operators import topic_rounds as tr
from quillgraph.operators import topics as to
from quillgraph.operators import word_vectors as wv
from quillgraph.operators.explore import threshold_profile
from quillgraph.plans.explore import r6
from quillgraph.plans.registry import query
from quillgraph.session import cut, spread
from quillgraph.sources import tables as t


def english_tokens(spark, d, stop_words=True):
    docs = spread(t.docs(spark, d).filter(F.col("language") == "en").select("id", "year", "text"), "id")
    tokens = tx.words(F.col("text"))
    return docs.select("id", "year", (tx.remove_stop_words(tokens) if stop_words else tokens).alias("tokens"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOP_WORDS)
_SPLIT = r"regexp_split_to_array(lower(regexp_replace(text, '[^\p{L}\s]+', '', 'g')), '\s+')"
_TOK = f"""tok AS MATERIALIZED (SELECT id, year, row_number() OVER (PARTITION BY id ORDER BY p) AS pos, w FROM
 (SELECT id, year, unnest(range(len(ws))) AS p, unnest(ws) AS w FROM (SELECT id, year, {_SPLIT} AS ws FROM docs WHERE language = 'en'))
 WHERE w <> '' AND w NOT IN ({_STOP}))"""
_COOC = _TOK + """,
co AS MATERIALIZED (SELECT a.year, greatest(a.w, b.w) AS first, least(a.w, b.w) AS second, count(*) AS weight
 FROM (SELECT *, unnest([1, 2, 3, 4, 5, 6]) AS k FROM tok) a JOIN tok b ON a.id = b.id AND b.pos = a.pos + a.k
 WHERE a.w <> b.w GROUP BY ALL HAVING count(*) > 16)"""


@query("tokenized_sentences", "TX1 F13", r"""
WITH s AS (SELECT id, unnest(range(len(x))) AS sentence, unnest(x) AS s FROM (SELECT id, regexp_extract_all(text, '[^.!?\n]+[.!?]*') AS x FROM docs)),
k AS (SELECT id, sentence, unnest(range(len(x)))::INT AS pos, unnest(x) AS token FROM (SELECT id, sentence,
  regexp_extract_all(s, '[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]') AS x FROM s))
SELECT id, max(sentence + 1)::INT AS sentences, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens, sum(pos)::BIGINT AS positions FROM k GROUP BY id""")
def _(spark, d):
    return tx.token_rows(spread(t.docs(spark, d).select("id", "text"), "id")).groupBy("id").agg(
        (F.max("sentence") + 1).alias("sentences"), F.count("*").alias("tokens"), F.countDistinct("token").alias("distinct_tokens"),
        F.sum("pos").alias("positions"))


@query("normalized_tokens", "TX2 F11", r"""
SELECT id, len(x) AS tokens, array_to_string(x, ' ') AS words FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(text, '\s+'),
  lambda w: lower(regexp_replace(regexp_replace(regexp_replace(w, '[^a-zA-Z.-]+', '', 'g'), '^[^a-zA-Z]+', '', 'g'), '[^a-zA-Z]+$', '', 'g'))), lambda w: w <> '') AS x
  FROM docs WHERE language = 'en')""")
def _(spark, d):
    english = t.docs(spark, d).filter(F.col("language") == "en")
    x = english.select("id", tx.normalize(F.split("text", r"\s+")).alias("x"))
    return x.select("id", F.size("x").cast("long").alias("tokens"), F.array_join("x", " ").alias("words"))


@query("words_without_stop_words", "TX3", f"WITH {_TOK} SELECT id, count(*) AS tokens, string_agg(w, ' ' ORDER BY pos) AS words FROM tok GROUP BY id")
def _(spark, d):
    kept = english_tokens(spark, d).filter(F.size("tokens") > 0)
    return kept.select("id", F.size("tokens").cast("long").alias("tokens"), F.array_join("tokens", " ").alias("words"))


@query("lemmatized_counts", "TX4 J8", f"""
WITH {_TOK}, v AS (SELECT DISTINCT w FROM tok), l AS (SELECT a.w AS form, b.w AS lemma FROM v a JOIN v b ON a.w = b.w || 's')
SELECT id, coalesce(l.lemma, tok.w) AS word, count(*) AS weight FROM tok LEFT JOIN l ON tok.w = l.form GROUP BY ALL""")
def _(spark, d):
    counts = te.term_counts(english_tokens(spark, d))
    vocabulary = counts.select("word").distinct()
    lemmas = vocabulary.select(F.concat("word", F.lit("s")).alias("form"), F.col("word").alias("lemma")).join(
        vocabulary.select(F.col("word").alias("form")), "form", "left_semi")
    return te.lemmatize(counts, lemmas).groupBy("id", "word").agg(F.sum("weight").alias("weight"))


@query("term_counts", "TX10 A2 PF12", f"WITH {_TOK} SELECT id, w AS word, count(*) AS weight FROM tok GROUP BY ALL")
def _(spark, d):
    return te.term_counts(english_tokens(spark, d))


@query("vocabulary_totals", "TX10 F9 A13", f"WITH {_TOK} SELECT count(*) AS tokens, count(DISTINCT w) AS vocabulary, count(DISTINCT id) AS documents FROM tok")
def _(spark, d):
    return te.term_counts(english_tokens(spark, d)).agg(
        F.sum("weight").alias("tokens"), F.countDistinct("word").alias("vocabulary"), F.countDistinct("id").alias("documents"))


@query("count_vectors", "TX5", f"""
WITH {_TOK}, v AS (SELECT w FROM tok GROUP BY w HAVING count(DISTINCT id) >= 10)
SELECT id, w AS word, count(*)::DOUBLE AS value FROM tok SEMI JOIN v USING (w) GROUP BY ALL""")
def _(spark, d):
    return to.count_terms(te.term_counts(english_tokens(spark, d)), 10)


@query("inverse_document_frequency", "TX6 F5", f"""
WITH {_TOK}, v AS (SELECT w, count(DISTINCT id) AS df FROM tok GROUP BY w HAVING count(DISTINCT id) >= 10),
n AS (SELECT count(*) AS n FROM docs WHERE language = 'en')
SELECT id, w AS word, round(count(*) * ln((n + 1) / (df + 1)), 6) AS value FROM tok JOIN v USING (w), n
GROUP BY id, w, n, df HAVING round(count(*) * ln((n + 1) / (df + 1)), 6) > 0""")
def _(spark, d):
    tokens = english_tokens(spark, d)
    return to.idf_terms(te.term_counts(tokens), tokens, 10).withColumn("value", r6("value")).filter("value > 0")


def _topic_model(spark, d, k):
    return ot.fit(english_tokens(spark, d), k, 10, 10, seed=1)


TOPICS = 500
WIDTH = 100


@query("topic_keywords", "TX7 TX8")
def _(spark, d):
    words = ot.topic_words(_topic_model(spark, d, TOPICS)[0])
    packed = words.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("p"))
    return packed.select("topic", F.array_join("p.word", " ").alias("keywords"))


@query("document_topics", "TX7 TX9 F12 F14 W2 S4")
def _(spark, d):
    topics = ot.shares(*_topic_model(spark, d, TOPICS))
    return to.top_topics(topics).select("id", F.explode("topics").alias("t")).select("id", "t.topic", "t.weight")


@query("document_topic_shares", "TX7 TX9", f"""
WITH {_TOK}, v AS (SELECT w FROM tok GROUP BY w HAVING count(DISTINCT id) >= 10), fed AS (SELECT DISTINCT id FROM tok SEMI JOIN v USING (w))
SELECT docs.id, {TOPICS} AS topics, CASE WHEN fed.id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS total, 3 AS kept
FROM docs LEFT JOIN fed ON fed.id = docs.id WHERE language = 'en'""")
def _(spark, d):
    topics = cut(ot.shares(*_topic_model(spark, d, TOPICS)))
    whole = topics.select("id", F.size("shares").alias("topics"), F.round(F.aggregate("shares", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
    return whole.join(to.top_topics(topics).select("id", F.size("topics").alias("kept")), "id")


_K, _ROUNDS, _ALPHA, _BETA = 8, 2, 0.1, 0.01


def _topic_sql() -> str:
    """Rounds of the topic model over long tables w (word, k, v) and d (id, k, v), unrolled."""
    steps = [f"""{_TOK}, v AS (SELECT w, count(DISTINCT id) AS df FROM tok GROUP BY w HAVING count(DISTINCT id) >= 10),
e AS MATERIALIZED (SELECT id, w AS word, count(*) * ln(((SELECT count(*) FROM docs WHERE language = 'en') + 1) / (df + 1)) AS value FROM tok JOIN v USING (w) GROUP BY id, w, df HAVING value > 0),
size AS (SELECT count(DISTINCT word) AS n FROM e), k AS (SELECT unnest(range({_K})) AS k),
u AS (SELECT word, n, k, 1 + ('0x' || substr(md5(concat(word, '-', k, '-', 0)), 1, 4))::INT / 65536.0::DOUBLE AS u FROM (SELECT word, sum(value) AS n FROM e GROUP BY word) CROSS JOIN k),
w0 AS MATERIALIZED (SELECT word, k, n * u / sum(u) OVER (PARTITION BY word) AS v FROM u),
d0 AS MATERIALIZED (SELECT id, k, n / {_K} AS v FROM (SELECT id, sum(value) AS n FROM e GROUP BY id) CROSS JOIN k)"""]
    for i in range(_ROUNDS):
        steps.append(f"""t{i} AS (SELECT k, sum(v) + {_BETA} * any_value(n) AS v FROM w{i} CROSS JOIN size GROUP BY k),
x{i} AS MATERIALIZED (SELECT e.id, e.word, e.value, w.k, (w.v + {_BETA}) * (d.v + {_ALPHA}) / t.v AS x FROM e JOIN w{i} w ON w.word = e.word JOIN d{i} d ON d.id = e.id AND d.k = w.k JOIN t{i} t ON t.k = w.k),
g{i} AS MATERIALIZED (SELECT id, word, k, value * x / sum(x) OVER (PARTITION BY id, word) AS v FROM x{i}),
w{i + 1} AS MATERIALIZED (SELECT word, k, sum(v) AS v FROM g{i} GROUP BY word, k), d{i + 1} AS MATERIALIZED (SELECT id, k, sum(v) AS v FROM g{i} GROUP BY id, k)""")
    return "WITH " + ",\n".join(steps)


def _topic_rounds(spark, d):
    tokens = english_tokens(spark, d)
    return tr.fit(to.idf_terms(te.term_counts(tokens), tokens, 10), _K, _ROUNDS, _ALPHA, _BETA)


@query("document_topics_by_rounds", "TX7 TX9", _topic_sql() + f"""
SELECT id, k::INT AS topic, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, k) AS rk FROM
 (SELECT id, k, (v + {_ALPHA}) / sum(v + {_ALPHA}) OVER (PARTITION BY id) AS weight FROM d{_ROUNDS})) WHERE rk <= 3""")
def _(spark, d):
    return tr.topic_shares(_topic_rounds(spark, d)[1], _ALPHA).select("id", "topic", r6("weight").alias("weight"))


@query("topic_keywords_by_rounds", "TX7 TX8", _topic_sql() + f"""
SELECT k::INT AS topic, word, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(weight, 12) DESC, word) AS rk FROM
 (SELECT word, k, (v + {_BETA}) / sum(v + {_BETA}) OVER (PARTITION BY k) AS weight FROM w{_ROUNDS})) WHERE rk <= 5""")
def _(spark, d):
    return tr.topic_words(_topic_rounds(spark, d)[0], _BETA).select("topic", "word", r6("weight").alias("weight"))


@query("document_vectors", "TX17")
def _(spark, d):
    return to.document_vectors(english_tokens(spark, d), WIDTH).select("id", F.posexplode("embedding").alias("dim", "value"))


@query("document_vector_widths", "TX17", f"SELECT id, {WIDTH} AS width FROM docs WHERE language = 'en'")
def _(spark, d):
    return to.document_vectors(english_tokens(spark, d), WIDTH).select("id", F.size("embedding").alias("width"))


_DIM, _NEGATIVES, _RATE = 8, 2, 2.0


def _word_vector_sql() -> str:
    """Examples ex (word, other, met, drawn), then rounds over long tables u and v (word, k, x), unrolled."""
    number = "('0x' || substr(md5(concat({key}, '-', 0)), 1, {digits}))::BIGINT"
    draw = number.format(key="word, '-', other, '-', j", digits=12)
    steps = [f"""{_TOK}, voc AS MATERIALIZED (SELECT w AS word, count(*) AS n FROM tok GROUP BY w HAVING count(*) >= 5),
near AS (SELECT a.w AS word, b.w AS other, count(*) AS n FROM (SELECT *, unnest([1, 2, 3, 4]) AS d FROM tok) a JOIN tok b ON a.id = b.id AND b.pos = a.pos + a.d
 WHERE a.w <> b.w AND a.w IN (SELECT word FROM voc) AND b.w IN (SELECT word FROM voc) GROUP BY ALL),
pr AS MATERIALIZED (SELECT word, other, sum(n)::DOUBLE AS met FROM (SELECT * FROM near UNION ALL SELECT other, word, n FROM near) GROUP BY ALL),
sh AS (SELECT word, greatest(1, ceil(round(4 * count(*) OVER () * pow(n, 0.75) / sum(pow(n, 0.75)) OVER (), 6)))::BIGINT AS s FROM voc),
sl AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY key) - 1 AS slot FROM
 (SELECT word, {number.format(key="word, '-', j", digits=15)} AS key FROM (SELECT word, unnest(range(s)) AS j FROM sh))),
dr AS (SELECT d.word, sl.word AS other, d.met AS drawn FROM
 (SELECT word, met, {draw} % (SELECT count(*) FROM sl) AS slot FROM pr CROSS JOIN (SELECT unnest(range(1, {_NEGATIVES + 1})) AS j)) d JOIN sl ON sl.slot = d.slot),
ex AS MATERIALIZED (SELECT word, other, sum(met) AS met, sum(drawn) AS drawn FROM
 (SELECT word, other, met, 0.0::DOUBLE AS drawn FROM pr UNION ALL SELECT word, other, 0.0, drawn FROM dr) GROUP BY ALL),
k AS (SELECT unnest(range({_DIM})) AS k)"""]
    for name, column, side in (("u", "word", 0), ("v", "other", 1)):
        steps.append(f"t{name} AS MATERIALIZED (SELECT {column} AS word, sum(met + drawn) AS t FROM ex GROUP BY ALL)")
        first = "(" + f"('0x' || substr(md5(concat(word, '-', {side}, '-', k, '-', 0)), 1, 4))::INT" + f" / 65536.0::DOUBLE - 0.5) * 2 / sqrt({_DIM}::DOUBLE)"
        steps.append(f"{name}0 AS MATERIALIZED (SELECT word, k, t, {first} AS x FROM t{name} CROSS JOIN k)")
    for i in range(_ROUNDS):
        steps.append(f"""z{i} AS (SELECT ex.word, ex.other, any_value(met) AS met, any_value(drawn) AS drawn, 1 / (1 + exp(-sum(u.x * v.x))) AS s
 FROM ex JOIN u{i} u ON u.word = ex.word JOIN v{i} v ON v.word = ex.other AND v.k = u.k GROUP BY ex.word, ex.other),
g{i} AS MATERIALIZED (SELECT word, other, {_RATE} * (met * (1 - s) - drawn * s) AS g FROM z{i}),
u{i + 1} AS MATERIALIZED (SELECT u.word, u.k, u.t, u.x + m.x / u.t AS x FROM u{i} u JOIN (SELECT g.word, v.k, sum(g.g * v.x) AS x FROM g{i} g JOIN v{i} v ON v.word = g.other GROUP BY ALL) m
 ON m.word = u.word AND m.k = u.k),
v{i + 1} AS MATERIALIZED (SELECT v.word, v.k, v.t, v.x + m.x / v.t AS x FROM v{i} v JOIN (SELECT g.other, u.k, sum(g.g * u.x) AS x FROM g{i} g JOIN u{i} u ON u.word = g.word GROUP BY ALL) m
 ON m.other = v.word AND m.k = v.k)""")
    return "WITH " + ",\n".join(steps)


@query("word_vector_examples", "TX17 TX11", _word_vector_sql() + "\nSELECT word, other, met, drawn FROM ex")
def _(spark, d):
    return wv.examples(english_tokens(spark, d), negatives=_NEGATIVES)


@query("document_vectors_by_rounds", "TX17 TX18 F15", _word_vector_sql() + f"""
SELECT docs.id, k.k::INT AS dim, round(coalesce(m.value, 0), 6) AS value FROM docs CROSS JOIN k LEFT JOIN
 (SELECT tok.id, u.k, avg(u.x) AS value FROM tok JOIN u{_ROUNDS} u ON u.word = tok.w GROUP BY ALL) m ON m.id = docs.id AND m.k = k.k WHERE language = 'en'""")
def _(spark, d):
    vectors = wv.document_vectors(english_tokens(spark, d), _DIM, _ROUNDS, negatives=_NEGATIVES, rate=_RATE)
    return vectors.select("id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", r6("value"))


# ---------------------------------------------------------------- word graphs

@query("cooccurrence_by_year", "TX11 W4 F18", f"WITH {_COOC} SELECT year, first, second, weight, round(1.0 / weight, 6) AS inverse_weight FROM co")
def _(spark, d):
    return te.cooccurrence(english_tokens(spark, d), by=("year",)).withColumn("inverse_weight", r6("inverse_weight"))


_COOC_ALL = _TOK + """,
co AS MATERIALIZED (SELECT greatest(a.w, b.w) AS first, least(a.w, b.w) AS second, count(*) AS weight
 FROM (SELECT *, unnest([1, 2, 3, 4, 5, 6]) AS k FROM tok) a JOIN tok b ON a.id = b.id AND b.pos = a.pos + a.k GROUP BY ALL)"""


@query("cooccurrence_with_self_pairs", "TX11 W4", f"WITH {_COOC_ALL} SELECT first, second, weight FROM co WHERE weight > 4")
def _(spark, d):
    return te.cooccurrence(english_tokens(spark, d), min_weight=4, drop_self=False).drop("inverse_weight")


@query("cooccurrence_thresholds", "A20 TX11", f"""WITH {_COOC_ALL}
SELECT x.threshold, (SELECT count(*) FROM co WHERE weight > x.threshold) AS rows_above FROM (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS threshold) x""")
def _(spark, d):
    pairs = te.cooccurrence(english_tokens(spark, d), min_weight=0, drop_self=False)
    return threshold_profile(pairs, "weight", [1, 2, 4, 8, 16, 32, 64]).select("threshold", "rows_above")


_ENDS = """ends AS MATERIALIZED (SELECT year, first AS word, second AS other, weight FROM co UNION ALL SELECT year, second, first, weight FROM co),
deg AS MATERIALIZED (SELECT year, word, count(*) AS degree, sum(weight)::BIGINT AS strength FROM ends GROUP BY ALL),
n AS (SELECT year, count(*) AS n FROM deg GROUP BY year HAVING count(*) > 3)"""
_DIST = """dist AS MATERIALIZED (SELECT e.year, e.word, sum(log10((n.n - {less}) / d.degree)) AS value FROM ends e
 JOIN deg d ON e.year = d.year AND e.other = d.word JOIN n ON n.year = e.year GROUP BY ALL)"""


def yearly_cooccurrence(spark, d):
    return cut(te.cooccurrence(english_tokens(spark, d), by=("year",)))


@query("word_link_weight", "TX25 A6 A10", f"WITH {_COOC}, {_ENDS} SELECT year, word, degree, strength FROM deg")
def _(spark, d):
    return te.word_degrees(yearly_cooccurrence(spark, d))


@query("link_weight_distribution", "A19 TX25", f"WITH {_COOC}, {_ENDS} SELECT strength, sum(strength)::BIGINT AS total FROM deg GROUP BY strength")
def _(spark, d):
    return te.word_degrees(yearly_cooccurrence(spark, d)).groupBy("strength").agg(F.sum("strength").alias("total"))


@query("word_neighbour_degree", "TX24 A10", f"""WITH {_COOC}, {_ENDS}
SELECT e.year, e.word, sum(d.degree)::BIGINT AS neighbour_degree FROM ends e JOIN deg d ON e.year = d.year AND e.other = d.word GROUP BY ALL""")
def _(spark, d):
    return te.neighbour_degree(yearly_cooccurrence(spark, d))


@query("distinctiveness", "TX22 F5", f"WITH {_COOC}, {_ENDS}, {_DIST.format(less=1)} SELECT year, word, round(value, 6) AS value FROM dist")
def _(spark, d):
    return te.distinctiveness(yearly_cooccurrence(spark, d)).withColumn("value", r6("value"))


@query("distinctiveness_stem_variant", "TX22 F5", f"WITH {_COOC}, {_ENDS}, {_DIST.format(less=0)} SELECT year, word, round(value, 6) AS value FROM dist")
def _(spark, d):
    return te.distinctiveness(yearly_cooccurrence(spark, d), variant="stem").withColumn("value", r6("value"))


_PREV = "prev AS MATERIALIZED (SELECT year, w AS word, count(*)::DOUBLE AS value FROM tok GROUP BY ALL)"


@query("prevalence", "TX20 IO9", f"WITH {_TOK}, {_PREV} SELECT year, word, value FROM prev")
def _(spark, d):
    return te.prevalence(te.term_counts(english_tokens(spark, d), ("id", "year")))


@query("prevalence_yearly_stats", "TX21 A7", f"WITH {_TOK}, {_PREV} SELECT year, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread FROM prev GROUP BY year")
def _(spark, d):
    stats = te.yearly_stats(te.prevalence(te.term_counts(english_tokens(spark, d), ("id", "year"))))
    return stats.select("year", r6("mean").alias("mean"), r6("spread").alias("spread"))


def _weighted_betweenness_ctes(weight: str, rounds: int = 24) -> str:
    steps = [f"""g AS MATERIALIZED (SELECT year, word AS u, other AS v, {weight} AS w FROM ends)""",
             "d0 AS MATERIALIZED (SELECT year, word AS s, word AS v, 0.0::DOUBLE AS d FROM deg)"]
    for i in range(1, rounds + 1):
        steps.append(f"""d{i} AS MATERIALIZED (SELECT year, s, v, min(d) AS d FROM (SELECT * FROM d{i - 1} UNION ALL
 SELECT x.year, x.s, g.v, x.d + g.w FROM d{i - 1} x JOIN g ON g.year = x.year AND g.u = x.v) GROUP BY ALL)""")
    steps.append(f"""t AS MATERIALIZED (SELECT a.year, a.s, g.u, g.v FROM d{rounds} a JOIN g ON a.year = g.year AND a.v = g.u
 JOIN d{rounds} b ON b.year = a.year AND b.s = a.s AND b.v = g.v WHERE abs(a.d + g.w - b.d) <= 1e-9 * b.d)""")
    steps.append("a0 AS MATERIALIZED (SELECT year, word AS s, word AS v, 1.0::DOUBLE AS x FROM deg)")
    for i in range(1, rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT t.year, t.s, t.v, sum(x.x) AS x FROM a{i - 1} x JOIN t ON t.year = x.year AND t.s = x.s AND t.u = x.v GROUP BY ALL)")
    steps.append("sig AS MATERIALIZED (SELECT year, s, v, sum(x) AS c FROM (" + " UNION ALL ".join(f"SELECT * FROM a{i}" for i in range(rounds + 1)) + ") GROUP BY ALL)")
    steps.append("""r AS MATERIALIZED (SELECT t.year, t.s, t.u, t.v, p.c / q.c AS r FROM t JOIN sig p ON p.year = t.year AND p.s = t.s AND p.v = t.u
 JOIN sig q ON q.year = t.year AND q.s = t.s AND q.v = t.v)""")
    steps.append("x0 AS MATERIALIZED (SELECT year, s, v, 1.0::DOUBLE AS x FROM sig)")
    for i in range(1, rounds + 1):
        steps.append(f"x{i} AS MATERIALIZED (SELECT r.year, r.s, r.u AS v, sum(x.x * r.r) AS x FROM x{i - 1} x JOIN r ON r.year = x.year AND r.s = x.s AND r.v = x.v GROUP BY ALL)")
    steps.append("btw AS MATERIALIZED (SELECT d.year, d.word, coalesce(sum(z.x), 0) / 2 AS value FROM deg d LEFT JOIN ("
                 + " UNION ALL ".join(f"SELECT * FROM x{i} WHERE s <> v" for i in range(1, rounds + 1))
                 + ") z ON z.year = d.year AND z.v = d.word GROUP BY ALL)")
    return ",\n".join(steps)


@query("word_betweenness", "G14 TX23", f"WITH {_COOC}, {_ENDS}, {_weighted_betweenness_ctes('1.0::DOUBLE / weight')} SELECT year, word, round(value, 5) AS value FROM btw")
def _(spark, d):
    return te.word_betweenness(yearly_cooccurrence(spark, d)).withColumn("value", F.round("value", 5))


@query("word_betweenness_unweighted", "G14 G13", f"WITH {_COOC}, {_ENDS}, {_weighted_betweenness_ctes('1.0::DOUBLE')} SELECT year, word, round(value, 5) AS value FROM btw")
def _(spark, d):
    return te.word_betweenness(yearly_cooccurrence(spark, d), weighted=False).withColumn("value", F.round("value", 5))


def brand(spark, d):
    tokens = cut(english_tokens(spark, d))
    cooc = cut(te.cooccurrence(tokens, by=("year",)))
    return te.brand_score(te.prevalence(te.term_counts(tokens, ("id", "year"))), te.distinctiveness(cooc), te.word_betweenness(cooc))


_BRAND = f"""WITH {_COOC}, {_ENDS}, {_DIST.format(less=1)}, {_PREV}, {_weighted_betweenness_ctes('1.0::DOUBLE / weight')},
m AS (SELECT 1 AS k, * FROM prev UNION ALL SELECT 2, * FROM dist UNION ALL SELECT 3, * FROM btw),
st AS (SELECT k, year, avg(value) AS mean, stddev_pop(value) AS sd FROM m GROUP BY ALL),
z AS MATERIALIZED (SELECT m.k, m.year, m.word, m.value / nullif(st.mean, 0) / nullif(st.sd, 0) AS z FROM m JOIN st ON m.k = st.k AND m.year = st.year),
brand AS MATERIALIZED (SELECT a.year, a.word, a.z + b.z + c.z AS score FROM z a JOIN z b ON a.year = b.year AND a.word = b.word AND a.k = 1 AND b.k = 2
 JOIN z c ON a.year = c.year AND a.word = c.word AND c.k = 3)"""


@query("brand_score", "TX23 J17", _BRAND + " SELECT year, word, round(score, 5) AS score FROM brand")
def _(spark, d):
    return brand(spark, d).withColumn("score", F.round("score", 5))


@query("brand_score_top_ten_of_year", "TX23 S2 PF3", _BRAND
       + " SELECT year, word, round(score, 5) AS score FROM brand WHERE year = 2019 ORDER BY round(brand.score, 5) DESC NULLS LAST, word LIMIT 10")
def _(spark, d):
    scored = brand(spark, d).filter("year = 2019").withColumn("score", F.round("score", 5))
    return scored.orderBy(F.desc_nulls_last("score"), "word").limit(10)


# ---------------------------------------------------------------- tf-idf and keywords

@query("term_tfidf", "TX12 F5 A12", f"""
WITH {_TOK}, c AS MATERIALIZED (SELECT id, w AS word, count(*) AS weight FROM tok GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM c GROUP BY word), n AS (SELECT count(*) AS n FROM docs)
SELECT c.id, c.word, round(c.weight / sum(c.weight) OVER (PARTITION BY c.id), 6) AS tf, round(1 + ln(n.n / (1 + df.df)), 6) AS idf,
  round(c.weight / sum(c.weight) OVER (PARTITION BY c.id) * (1 + ln(n.n / (1 + df.df))), 6) AS tfidf FROM c JOIN df USING (word), n""")
def _(spark, d):
    n = t.docs(spark, d).agg(F.count("*")).scalar()
    out = te.term_tfidf(te.term_counts(english_tokens(spark, d)), n)
    return out.select("id", "word", *[r6(c).alias(c) for c in ("tf", "idf", "tfidf")])


@query("keyword_tfidf", "TX13", """
WITH c AS (SELECT id, topic AS word, weight AS score FROM has_topic), df AS (SELECT word, count(*) AS df FROM c GROUP BY word),
n AS (SELECT count(*) AS n FROM articles), x AS (SELECT c.id, c.word, c.score, 1.0::DOUBLE / count(*) OVER (PARTITION BY c.id) AS tf,
  1 + ln(n.n / (1 + df.df)) AS idf FROM c JOIN df USING (word), n)
SELECT id, word, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf * idf, 6) AS tfidf, round(score * (tf * idf), 4) AS wtfidf FROM x""")
def _(spark, d):
    links = t.has_topic(spark, d).select("id", F.col("topic").alias("word"), F.col("weight").alias("score"))
    out = te.keyword_tfidf(links, t.articles(spark, d).agg(F.count("*")).scalar())
    return out.select("id", "word", r6("tf").alias("tf"), r6("idf").alias("idf"), r6("tfidf").alias("tfidf"), F.round("wtfidf", 4).alias("wtfidf"))


@query("keyword_popularity", "TX14 S1", "SELECT topic AS word, count(*) AS articles FROM has_topic GROUP BY topic ORDER BY articles DESC, word")
def _(spark, d):
    return t.has_topic(spark, d).groupBy(F.col("topic").alias("word")).agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "word")


@query("keyword_popularity_by_category", "TX14 S4", """
SELECT category, word, articles, "rank" FROM (SELECT a.category, h.topic AS word, count(*) AS articles,
  row_number() OVER (PARTITION BY a.category ORDER BY count(*) DESC, h.topic)::INT AS "rank"
  FROM has_topic h JOIN articles a ON a.id = h.id GROUP BY a.category, h.topic) WHERE "rank" <= 10""")
def _(spark, d):
    from quillgraph.operators.ranking import top_per_group

    counts = t.has_topic(spark, d).join(t.articles(spark, d).select("id", "category"), "id").groupBy(
        "category", F.col("topic").alias("word")).agg(F.count("*").alias("articles"))
    return top_per_group(counts, ["category"], [F.desc("articles"), F.col("word")], 10)


_KEYWORDS = rf"""
WITH s AS (SELECT id, unnest(range(len(x))) AS sentence, unnest(x) AS s FROM (SELECT id, regexp_extract_all(text, '[^.!?\n]+[.!?]*') AS x FROM docs WHERE language = 'en')),
k AS (SELECT id, sentence, unnest(range(len(x))) AS pos, unnest(x) AS token FROM (SELECT id, sentence,
  regexp_extract_all(s, '[\p{{L}}\p{{N}}]+(?:[-''][\p{{L}}\p{{N}}]+)*|[^\s\p{{L}}\p{{N}}]') AS x FROM s)),
r AS MATERIALIZED (SELECT id, sentence, pos, term, term IS NULL OR term IN ({_STOP}) AS stop FROM
  (SELECT id, sentence, pos, CASE WHEN regexp_matches(token, '^[\p{{L}}\p{{N}}]') THEN lower(token) END AS term FROM k)),
w AS (SELECT *, lag(term) OVER l AS lt, lead(term) OVER l AS rt FROM r WINDOW l AS (PARTITION BY id, sentence ORDER BY pos)),
f AS MATERIALIZED (SELECT id, term, stop, count(*) AS tf, min(sentence) AS first, count(DISTINCT sentence) AS spread,
  coalesce(count(DISTINCT lt) / nullif(count(lt), 0), 0) + coalesce(count(DISTINCT rt) / nullif(count(rt), 0), 0) AS variety
  FROM w WHERE term IS NOT NULL GROUP BY ALL),
st AS (SELECT id, max(tf) AS top, avg(tf) FILTER (NOT stop) AS mean, stddev_pop(tf) FILTER (NOT stop) AS sd FROM f GROUP BY id),
ln AS (SELECT id, max(sentence) + 1 AS lines FROM r GROUP BY id),
sc AS (SELECT f.id, f.term, 1 + variety * tf / top AS rel, tf, first, spread, mean, sd, lines FROM f JOIN st USING (id) JOIN ln USING (id) WHERE NOT stop),
z AS MATERIALIZED (SELECT id, term, rel * ln(ln(first + 3)) / (tf / (mean + sd) / rel + spread / lines / rel) AS s FROM sc),
m AS MATERIALIZED (SELECT r.*, z.s, {", ".join(f"lead({c}, {k}) OVER l AS {c}{k}" for k in range(1, 5) for c in ("r.term", "r.stop", "z.s")).replace("AS r.", "AS ").replace("AS z.", "AS ")}
  FROM r LEFT JOIN z ON r.id = z.id AND r.term = z.term WINDOW l AS (PARTITION BY r.id, r.sentence ORDER BY r.pos)),
p AS ({" UNION ALL ".join(
    f"SELECT id, term || ' ' || {' || chr(32) || '.join(f'term{k}' for k in range(1, n))} AS keyword, s * {' * '.join(f'coalesce(s{k}, 1)' for k in range(1, n))} AS p, "
    f"s + {' + '.join(f'coalesce(s{k}, 0)' for k in range(1, n))} AS t FROM m WHERE NOT stop AND NOT stop{n - 1}"
    + "".join(f" AND term{k} IS NOT NULL" for k in range(1, n - 1)) for n in range(2, 6))}),
q AS (SELECT id, keyword, min(p) / (count(*) * (1 + min(t))) AS score FROM p GROUP BY ALL)
SELECT id, keyword, round(score, 9) AS score, "rank" FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 12), keyword)::INT AS "rank" FROM q) WHERE "rank" <= 10"""


@query("extract_keywords", "TX15 TX1 S4", _KEYWORDS)
def _(spark, d):
    docs = spread(t.docs(spark, d).filter(F.col("language") == "en").select("id", "text"), "id")
    return te.extract_keywords(docs).select("id", "keyword", F.round("score", 9).alias("score"), "rank")


_LANGUAGE = """WITH g AS MATERIALIZED (SELECT id, language, gram, count(*) AS c FROM (SELECT id, language, i, x || lead(x, 1) OVER l || lead(x, 2) OVER l AS gram FROM
  (SELECT id, language, unnest(range(len(cs))) AS i, unnest(cs) AS x FROM (SELECT id, language, string_split(lower(text), '') AS cs FROM docs))
  WINDOW l AS (PARTITION BY id ORDER BY i)) WHERE gram IS NOT NULL GROUP BY ALL),
b AS MATERIALIZED (SELECT language, gram, sum(c) AS c FROM g WHERE language IS NOT NULL AND id % 4 <> 2 GROUP BY language, gram),
t AS (SELECT language, sum(c) + count(*) AS t FROM b GROUP BY language),
h AS (SELECT g.id, b.language, sum(g.c * ln((b.c + 1)::DOUBLE)) AS s FROM g JOIN b ON g.gram = b.gram GROUP BY ALL),
sc AS (SELECT n.id, t.language, coalesce(h.s, 0) - n.n * ln(t.t::DOUBLE) AS score FROM (SELECT id, sum(c) AS n FROM g GROUP BY id) n CROSS JOIN t
  LEFT JOIN h ON h.id = n.id AND h.language = t.language),
det AS (SELECT id, language AS detected FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, language) AS rk FROM sc) WHERE rk = 1)
"""


def _detected(spark, d):
    docs = spread(t.docs(spark, d).select("id", "language", "text"), "id")
    grams = te.trigrams(docs)
    return te.detect_language(docs, grams, te.language_profiles(grams))


@query("detect_language", "TX16", _LANGUAGE + "SELECT d.id, detected FROM docs d LEFT JOIN det ON det.id = d.id")
def _(spark, d):
    return _detected(spark, d)


@query("documents_per_detected_language", "TX16 A2 S2", _LANGUAGE + "SELECT detected, count(*) AS documents FROM docs d LEFT JOIN det ON det.id = d.id GROUP BY detected ORDER BY documents DESC, detected")
def _(spark, d):
    return _detected(spark, d).groupBy("detected").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "detected")
