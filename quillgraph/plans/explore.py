"""Counting, joining and filtering the citation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import explore as ex
from quillgraph.operators import graph as gr
from quillgraph.operators import ranking as rk
from quillgraph.plans.registry import query
from quillgraph.session import cut
from quillgraph.sources import tables as t


def citation_graph(spark, d, weight=None) -> gr.Graph:
    return gr.Graph.of(t.articles(spark, d).select("id"), t.cites(spark, d), weight)


def r6(c):
    return F.round(c, 6)


@query("graph_counts", "A1 J1 PF1", """
SELECT (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM cites) AS citations,
       (SELECT count(DISTINCT category) FROM articles) AS categories""")
def _(spark, d):
    a, c = t.articles(spark, d), t.cites(spark, d)
    return a.agg(F.count("*").alias("articles"), F.countDistinct("category").alias("categories")).withColumn(
        "citations", c.agg(F.count("*")).scalar())


@query("articles_per_category", "A2 S1", "SELECT category, count(*) AS articles FROM articles GROUP BY category ORDER BY category")
def _(spark, d):
    return t.articles(spark, d).groupBy("category").agg(F.count("*").alias("articles")).orderBy("category")


@query("articles_per_category_year", "A2 S1",
       "SELECT category, year, count(*) AS articles FROM articles GROUP BY category, year ORDER BY category, year")
def _(spark, d):
    return t.articles(spark, d).groupBy("category", "year").agg(F.count("*").alias("articles")).orderBy("category", "year")


@query("cited_per_category", "A3 J1 J3", """
SELECT a.category, count(*) AS citations FROM cites c JOIN articles a ON c.dst = a.id GROUP BY a.category""")
def _(spark, d):
    ends = ex.with_end(t.cites(spark, d), t.articles(spark, d), "dst", ["category"])
    return ends.groupBy(F.col("dst_category").alias("category")).agg(F.count("*").alias("citations"))


@query("citing_per_category", "A3 J1 J3", """
SELECT a.category, count(*) AS citations FROM cites c JOIN articles a ON c.src = a.id GROUP BY a.category""")
def _(spark, d):
    ends = ex.with_end(t.cites(spark, d), t.articles(spark, d), "src", ["category"])
    return ends.groupBy(F.col("src_category").alias("category")).agg(F.count("*").alias("citations"))


@query("cited_not_later_per_category_year", "A3 PF3", """
SELECT b.category, b.year, count(*) AS citations FROM cites c JOIN articles a ON c.src = a.id JOIN articles b ON c.dst = b.id
WHERE b.year >= a.year GROUP BY b.category, b.year""")
def _(spark, d):
    ends = ex.with_ends(t.cites(spark, d), t.articles(spark, d), ["category", "year"]).filter("dst_year >= src_year")
    return ends.groupBy(F.col("dst_category").alias("category"), F.col("dst_year").alias("year")).agg(
        F.count("*").alias("citations"))


@query("cited_per_category_by_both_years", "A3", """
SELECT b.category, b.year AS cited_year, a.year AS citing_year, count(*) AS citations
FROM cites c JOIN articles a ON c.src = a.id JOIN articles b ON c.dst = b.id GROUP BY ALL""")
def _(spark, d):
    ends = ex.with_ends(t.cites(spark, d), t.articles(spark, d), ["category", "year"])
    return ends.groupBy(
        F.col("dst_category").alias("category"), F.col("dst_year").alias("cited_year"), F.col("src_year").alias("citing_year")
    ).agg(F.count("*").alias("citations"))


@query("category_citation_matrix", "A4 J3 PF3", """
SELECT b.category AS cited_category, a.category AS citing_category, count(*) AS citations
FROM cites c JOIN articles a ON c.src = a.id JOIN articles b ON c.dst = b.id
WHERE a.category <> b.category GROUP BY ALL""")
def _(spark, d):
    return ex.cross_category_counts(t.cites(spark, d), t.articles(spark, d))


@query("category_citation_matrix_by_cited_year", "A4 J3", """
SELECT b.category AS cited_category, a.category AS citing_category, b.year AS dst_year, count(*) AS citations
FROM cites c JOIN articles a ON c.src = a.id JOIN articles b ON c.dst = b.id
WHERE a.category <> b.category GROUP BY ALL""")
def _(spark, d):
    return ex.cross_category_counts(t.cites(spark, d), t.articles(spark, d), ["dst_year"])


@query("category_citation_matrix_between_years", "A4 J2 J3", """
WITH und AS (SELECT src, dst FROM cites UNION ALL SELECT dst, src FROM cites)
SELECT b.category AS cited_category, a.category AS citing_category, b.year AS dst_year, a.year AS src_year,
       count(*) AS citations
FROM und c JOIN articles a ON c.src = a.id JOIN articles b ON c.dst = b.id
WHERE a.category <> b.category GROUP BY ALL""")
def _(spark, d):
    return ex.cross_category_counts(ex.both_ways(t.cites(spark, d)), t.articles(spark, d), ["dst_year", "src_year"])


_NEIGHBOURS = """
SELECT {me}.id, {me}.title, count(DISTINCT {other}.category) AS connected_categories
FROM cites c JOIN articles a ON c.src = a.id JOIN articles b ON c.dst = b.id
WHERE a.category <> b.category GROUP BY {me}.id, {me}.title ORDER BY connected_categories DESC, {me}.id"""


@query("categories_citing_an_article", "A5 S1 J3", _NEIGHBOURS.format(me="b", other="a"))
def _(spark, d):
    a = t.articles(spark, d)
    found = ex.neighbouring_categories(t.cites(spark, d), a, "dst")
    return found.join(a.select("id", "title"), "id").orderBy(F.desc("connected_categories"), "id")


@query("categories_cited_by_an_article", "A5 S1 J3", _NEIGHBOURS.format(me="a", other="b"))
def _(spark, d):
    a = t.articles(spark, d)
    found = ex.neighbouring_categories(t.cites(spark, d), a, "src")
    return found.join(a.select("id", "title"), "id").orderBy(F.desc("connected_categories"), "id")


@query("graph_density", "A23 G3 A12", """
WITH deg AS (SELECT a.id, count(c.src) AS k FROM articles a LEFT JOIN cites c ON c.src = a.id GROUP BY a.id),
n AS (SELECT (SELECT count(*) FROM articles) AS nodes, (SELECT count(*) FROM cites) AS edges)
SELECT nodes, edges, round(edges / (nodes * (nodes - 1)), 9) AS density, round(avg(k), 6) AS mean_degree,
       min(k) AS min_degree, max(k) AS max_degree FROM deg, n GROUP BY nodes, edges""")
def _(spark, d):
    out = gr.graph_stats(citation_graph(spark, d))
    return out.withColumn("density", F.round("density", 9)).withColumn("mean_degree", r6("mean_degree"))


@query("degree_all_orientations", "G4 A2", """
WITH o AS (SELECT src AS id, count(*) AS n FROM cites GROUP BY src), i AS (SELECT dst AS id, count(*) AS n FROM cites GROUP BY dst)
SELECT a.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree
FROM articles a LEFT JOIN o ON a.id = o.id LEFT JOIN i ON a.id = i.id""")
def _(spark, d):
    return gr.all_degrees(citation_graph(spark, d))


@query("degree_reverse_weighted", "G4 C10", """
SELECT a.id, CAST(coalesce(sum(c.weight), 0) AS DOUBLE) AS degree FROM articles a LEFT JOIN cites c ON c.dst = a.id GROUP BY a.id""")
def _(spark, d):
    return gr.degrees(citation_graph(spark, d, "weight"), gr.REVERSE, weighted=True)


@query("out_degree_distribution", "A15 G4", """
WITH deg AS (SELECT a.id, count(c.src) AS degree FROM articles a LEFT JOIN cites c ON c.src = a.id GROUP BY a.id)
SELECT degree, count(*) AS nodes FROM deg GROUP BY degree""")
def _(spark, d):
    return gr.degree_distribution(citation_graph(spark, d))


@query("in_degree_distribution", "A15 G4", """
WITH deg AS (SELECT a.id, count(c.dst) AS degree FROM articles a LEFT JOIN cites c ON c.dst = a.id GROUP BY a.id)
SELECT degree, count(*) AS nodes FROM deg GROUP BY degree""")
def _(spark, d):
    return gr.degree_distribution(citation_graph(spark, d), gr.REVERSE)


@query("in_degree_quantiles", "A21 G3", """
WITH deg AS (SELECT a.id, count(c.dst) AS degree FROM articles a LEFT JOIN cites c ON c.dst = a.id GROUP BY a.id)
SELECT 0.5::DOUBLE AS share, round(quantile_cont(degree, 0.5), 6) AS degree FROM deg UNION ALL
SELECT 0.9::DOUBLE, round(quantile_cont(degree, 0.9), 6) FROM deg UNION ALL
SELECT 0.99::DOUBLE, round(quantile_cont(degree, 0.99), 6) FROM deg""")
def _(spark, d):
    deg = cut(gr.degrees(citation_graph(spark, d), gr.REVERSE))
    out = None
    for share in (0.5, 0.9, 0.99):
        row = rk.exact_quantile_rows(deg, "degree", share).select(F.lit(share).alias("share"), r6("degree").alias("degree"))
        out = row if out is None else out.unionByName(row)
    return out


@query("duplicate_citations", "A14 G22 PF3", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(spark, d):
    lines = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return gr.duplicate_edges(lines.toDF("src", "dst")).toDF("l_orderkey", "l_linenumber", "copies")


@query("reciprocal_citations", "J4 G22", """
SELECT a.src, a.dst, a.weight FROM cites a JOIN cites b ON a.src = b.dst AND a.dst = b.src""")
def _(spark, d):
    return gr.reciprocal_edges(t.cites(spark, d))


@query("self_citations", "J5 G22", """
SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS weight FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey = b.l_partkey GROUP BY ALL""")
def _(spark, d):
    lines = t.table(spark, d, "lineitem")
    here = lines.select("l_orderkey", F.col("l_partkey").alias("src"), (F.col("l_linenumber") + 1).alias("line"))
    after = lines.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("line"))
    loops = gr.self_loops(here.join(after, ["l_orderkey", "line"]))
    return loops.groupBy("src", "dst").agg(F.count("*").alias("weight"))


@query("isolated_articles", "J6 G22", """
WITH ends AS (SELECT src AS id FROM cites UNION SELECT dst FROM cites) SELECT a.id FROM articles a ANTI JOIN ends ON a.id = ends.id""")
def _(spark, d):
    return gr.isolated_nodes(t.articles(spark, d), t.cites(spark, d)).select("id")


@query("never_citing_articles", "J6", "SELECT a.id FROM articles a ANTI JOIN cites c ON a.id = c.src")
def _(spark, d):
    return gr.without_out_edges(t.articles(spark, d), t.cites(spark, d)).select("id")


@query("never_cited_articles", "J6", "SELECT a.id FROM articles a ANTI JOIN cites c ON a.id = c.dst")
def _(spark, d):
    return gr.without_in_edges(t.articles(spark, d), t.cites(spark, d)).select("id")


_EARLY = """
early AS (SELECT id, category FROM articles WHERE year <= 1995),
early_cites AS (SELECT c.src, c.dst, c.weight FROM cites c JOIN early a ON c.src = a.id JOIN early b ON c.dst = b.id)"""


def early_graph(spark, d) -> gr.Graph:
    whole = gr.Graph.of(t.articles(spark, d), t.cites(spark, d))
    return whole.subgraph(F.col("year") <= 1995)


@query("isolated_in_first_year_graph", "J6 G22 G2", f"""
WITH {_EARLY},
ends AS (SELECT src AS id FROM early_cites UNION SELECT dst FROM early_cites)
SELECT e.id FROM early e ANTI JOIN ends ON e.id = ends.id""")
def _(spark, d):
    g = early_graph(spark, d)
    return gr.isolated_nodes(g.nodes, g.edges).select("id")


@query("never_citing_in_first_year_graph", "J6 G2", f"""
WITH {_EARLY} SELECT e.id FROM early e ANTI JOIN early_cites c ON e.id = c.src""")
def _(spark, d):
    g = early_graph(spark, d)
    return gr.without_out_edges(g.nodes, g.edges).select("id")


@query("never_cited_in_first_year_graph", "J6 G2", f"""
WITH {_EARLY} SELECT e.id FROM early e ANTI JOIN early_cites c ON e.id = c.dst""")
def _(spark, d):
    g = early_graph(spark, d)
    return gr.without_in_edges(g.nodes, g.edges).select("id")


@query("graph_quality_report", "G22 U1 A14 J4 J5 J6", f"""
SELECT 'duplicate_edges' AS "check", (SELECT count(*) FROM (SELECT src, dst FROM cites GROUP BY ALL HAVING count(*) > 1)) AS found
UNION ALL SELECT 'self_loops', (SELECT count(*) FROM cites WHERE src = dst)
UNION ALL SELECT 'reciprocal_edges', (SELECT count(*) FROM cites a JOIN cites b ON a.src = b.dst AND a.dst = b.src)
UNION ALL SELECT 'no_out_edges', (SELECT count(*) FROM articles a ANTI JOIN cites c ON a.id = c.src)
UNION ALL SELECT 'no_in_edges', (SELECT count(*) FROM articles a ANTI JOIN cites c ON a.id = c.dst)
UNION ALL SELECT 'isolated', (SELECT count(*) FROM articles a ANTI JOIN (SELECT src AS id FROM cites UNION SELECT dst FROM cites) e ON a.id = e.id)
UNION ALL SELECT 'repeated_ids', (SELECT count(*) FROM (SELECT id FROM articles GROUP BY id HAVING count(*) > 1))""")
def _(spark, d):
    return gr.quality_report(citation_graph(spark, d))


@query("cumulative_year_graphs", "G2 U1 PF5 PF3", """
SELECT y.year, (SELECT count(*) FROM articles a WHERE a.year <= y.year) AS nodes,
  (SELECT count(*) FROM cites c JOIN articles a ON c.src = a.id JOIN articles b ON c.dst = b.id
   WHERE a.year <= y.year AND b.year <= y.year) AS edges
FROM (SELECT DISTINCT year FROM articles) y""")
def _(spark, d):
    return ex.cumulative_year_sizes(t.cites(spark, d), t.articles(spark, d))


@query("projection_sizes", "G1 U1", """
SELECT 'natural' AS orientation, count(*) AS edges FROM cites UNION ALL SELECT 'reverse', count(*) FROM cites
UNION ALL SELECT 'undirected', 2 * count(*) FROM cites""")
def _(spark, d):
    g = citation_graph(spark, d)
    out = None
    for o in (gr.NATURAL, gr.REVERSE, gr.UNDIRECTED):
        row = g.oriented(o).agg(F.count("*").alias("edges")).select(F.lit(o).alias("orientation"), "edges")
        out = row if out is None else out.unionByName(row)
    return out


@query("known_categories", "PF10 PF7", "SELECT id, year, category, known_category FROM articles")
def _(spark, d):
    return t.articles(spark, d).select("id", "year", "category", "known_category")


@query("unlabelled_articles", "PF5 PF11", "SELECT id, year FROM articles WHERE known_category IS NULL AND year = 2000")
def _(spark, d):
    return t.articles(spark, d).filter(F.col("known_category").isNull() & (F.col("year") == t.EVALUATION_YEAR)).select("id", "year")


# Readable names of the category codes 1 to 40.
_NAMES = (
    "Artificial Intelligence",
    "Computation and Language",
    "Computational Complexity",
    "Computational Engineering, Finance, and Science",
    "Computational Geometry",
    "Computer Science and Game Theory",
    "Computer Vision and Pattern Recognition",
    "Computers and Society",
    "Cryptography and Security",
    "Data Structures and Algorithms",
    "Databases",
    "Digital Libraries",
    "Discrete Mathematics",
    "Distributed, Parallel, and Cluster Computing",
    "Emerging Technologies",
    "Formal Languages and Automata Theory",
    "General Literature",
    "Graphics",
    "Hardware Architecture",
    "Human-Computer Interaction",
    "Information Retrieval",
    "Information Theory",
    "Logic in Computer Science",
    "Machine Learning",
    "Mathematical Software",
    "Multiagent Systems",
    "Multimedia",
    "Networking and Internet Architecture",
    "Neural and Evolutionary Computing",
    "Numerical Analysis",
    "Operating Systems",
    "Other Computer Science",
    "Performance",
    "Programming Languages",
    "Robotics",
    "Social and Information Networks",
    "Software Engineering",
    "Sound",
    "Symbolic Computation",
    "Systems and Control",
)
CATEGORY_NAMES = dict(enumerate(_NAMES, 1))
_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in CATEGORY_NAMES.items())


@query("category_names", "PF7 J11", f"""
SELECT category, CASE category {_CASES} ELSE 'UNDEFINED' END AS name, count(*) AS articles FROM articles GROUP BY ALL""")
def _(spark, d):
    named = ex.lookup(t.articles(spark, d), CATEGORY_NAMES, "category", "name", "UNDEFINED")
    return named.groupBy("category", "name").agg(F.count("*").alias("articles"))


@query("article_category_links", "J11", """
SELECT a.id, c.category, c.members FROM articles a JOIN (SELECT category, count(*) AS members FROM articles GROUP BY category) c
ON a.category = c.category""")
def _(spark, d):
    a = t.articles(spark, d)
    return a.join(a.groupBy("category").agg(F.count("*").alias("members")), "category").select("id", "category", "members")


@query("default_label", "PF9", "SELECT id, run, coalesce(cluster, -1) AS label FROM clusters")
def _(spark, d):
    return t.clusters(spark, d).select("id", "run", F.coalesce("cluster", F.lit(-1)).alias("label"))


@query("english_documents", "PF4", "SELECT id, year FROM docs WHERE language = 'en'")
def _(spark, d):
    return t.docs(spark, d).filter(F.col("language") == "en").select("id", "year")


@query("articles_with_labelled_ends", "J7 PF6", """
SELECT c.src, c.dst FROM cites c SEMI JOIN (SELECT id FROM articles WHERE known_category IS NOT NULL) k ON c.src = k.id
SEMI JOIN (SELECT id FROM articles WHERE known_category IS NOT NULL) k2 ON c.dst = k2.id""")
def _(spark, d):
    known = t.articles(spark, d).filter("known_category IS NOT NULL")
    return gr.restrict_edges(t.cites(spark, d), known).select("src", "dst")


@query("sampled_articles_per_category", "S6 PF6", """
SELECT id, category FROM (SELECT id, category, row_number() OVER (PARTITION BY category
  ORDER BY ((id % 2147483647) * 1103515245 + 43 * 12345) % 2147483647, id) AS rk FROM articles) WHERE rk <= 10""")
def _(spark, d):
    return rk.sample_per_group(t.articles(spark, d).select("id", "category"), ["category"], "id", 10, seed=42)


@query("number_articles_in_category", "W1", """
SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id) AS rn FROM articles""")
def _(spark, d):
    return rk.number_rows(t.articles(spark, d).select("id", "category"), "id", ["category"])


@query("most_cited_article", "G20 S2 S3", """
SELECT a.id, a.title, count(*) AS citations FROM cites c JOIN articles a ON c.dst = a.id GROUP BY a.id, a.title
ORDER BY citations DESC, a.id LIMIT 1""")
def _(spark, d):
    counted = t.cites(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("citations"))
    best = counted.orderBy(F.desc("citations"), "id").limit(1)
    return best.join(t.articles(spark, d).select("id", "title"), "id")


_BEST = "(SELECT dst FROM cites GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def most_cited_id(cites):
    return cites.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select("dst").scalar()


@query("citation_profile_by_year", "G19", f"""
SELECT c.dst AS id, a.year, count(*) AS citations FROM cites c JOIN articles a ON c.src = a.id WHERE c.dst = {_BEST} GROUP BY ALL""")
def _(spark, d):
    c = t.cites(spark, d)
    mine = c.filter(F.col("dst") == most_cited_id(c))
    return ex.with_end(mine, t.articles(spark, d), "src", ["year"]).groupBy(
        F.col("dst").alias("id"), F.col("src_year").alias("year")).agg(F.count("*").alias("citations"))


@query("citation_profile_by_category", "G19 A2", f"""
SELECT c.dst AS id, a.category, count(*) AS weight FROM cites c JOIN articles a ON c.src = a.id WHERE c.dst = {_BEST} GROUP BY ALL""")
def _(spark, d):
    c = t.cites(spark, d)
    mine = c.filter(F.col("dst") == most_cited_id(c))
    return ex.with_end(mine, t.articles(spark, d), "src", ["category"]).groupBy(
        F.col("dst").alias("id"), F.col("src_category").alias("category")).agg(F.count("*").alias("weight"))


@query("yearly_category_spread", "A6 A7 A8", """
SELECT year, sum(n) ::BIGINT AS total, round(avg(n), 6) AS mean, max(n) AS top, round(stddev_pop(n), 6) AS spread_pop,
       round(stddev_samp(n), 6) AS spread_samp
FROM (SELECT year, category, count(*) AS n FROM articles GROUP BY ALL) GROUP BY year""")
def _(spark, d):
    n = t.articles(spark, d).groupBy("year", "category").agg(F.count("*").alias("n"))
    return n.groupBy("year").agg(
        F.sum("n").alias("total"), r6(F.avg("n")).alias("mean"), F.max("n").alias("top"),
        r6(F.stddev_pop("n")).alias("spread_pop"), r6(F.stddev_samp("n")).alias("spread_samp"))


@query("strongest_topics_of_article", "A9 S4 W2 F12 PF12", """
SELECT id, string_agg(topic, ' ' ORDER BY rk) AS topics, string_agg(weight::BIGINT, ' ' ORDER BY rk) AS weights FROM
 (SELECT id, topic, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, topic) AS rk FROM has_topic)
WHERE rk <= 3 GROUP BY id""")
def _(spark, d):
    best = rk.top_per_group(t.has_topic(spark, d), ["id"], [F.desc("weight"), F.col("topic")], 3)
    packed = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "topic", "weight"))).alias("p"))
    return packed.select("id", F.array_join(F.col("p.topic").cast("array<string>"), " ").alias("topics"),
                         F.array_join(F.transform("p.weight", lambda w: w.cast("bigint").cast("string")), " ").alias("weights"))


@query("topic_distinct_members", "A13 A5", "SELECT topic, count(DISTINCT id) AS articles FROM has_topic GROUP BY topic")
def _(spark, d):
    return t.has_topic(spark, d).select("topic", "id").distinct().groupBy("topic").agg(F.count("*").alias("articles"))


@query("topic_weight_distribution", "A19", """
SELECT weight, sum(weight) AS weight_share FROM has_topic GROUP BY weight""")
def _(spark, d):
    return t.has_topic(spark, d).groupBy("weight").agg(F.sum("weight").alias("weight_share"))


@query("topic_weight_thresholds", "A20", """
SELECT x.threshold, (SELECT count(*) FROM has_topic WHERE weight > x.threshold) AS rows_above,
  round((SELECT count(*) FROM has_topic WHERE weight > x.threshold) / (SELECT count(*) FROM has_topic), 6) AS share
FROM (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS threshold) x""")
def _(spark, d):
    return ex.threshold_profile(t.has_topic(spark, d), "weight", [1, 2, 4, 8, 16, 32, 64]).withColumn("share", r6("share"))


@query("topic_weight_histogram", "A22", """
SELECT CASE WHEN weight < 0 THEN 0 WHEN weight >= 200 THEN 51 ELSE CAST(floor(weight / 4) AS INT) + 1 END AS bin, count(*) AS "rows"
FROM has_topic GROUP BY ALL""")
def _(spark, d):
    return ex.histogram(t.has_topic(spark, d), "weight", 0, 200, 50)


@query("in_degree_vs_weighted_rmse", "A24 F17 J16", """
WITH l AS (SELECT dst AS id, CAST(count(*) AS DOUBLE) AS v FROM cites GROUP BY dst),
r AS (SELECT dst AS id, CAST(sum(weight) AS DOUBLE) AS v FROM cites WHERE weight > 1 GROUP BY dst)
SELECT round(sqrt(avg((l.v - coalesce(r.v, 0)) ** 2)), 6) AS rmse FROM l LEFT JOIN r ON l.id = r.id""")
def _(spark, d):
    c = t.cites(spark, d)
    left = c.groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("double").alias("v"))
    right = c.filter("weight > 1").groupBy(F.col("dst").alias("id")).agg(F.sum("weight").cast("double").alias("v"))
    return ex.rmse(left, right, ["id"], "v").select(r6("rmse").alias("rmse"))


@query("reciprocal_weight", "F18 F6 F7 F5", """
SELECT src, dst, round(1.0 / weight, 6) AS inverse_weight, round(ln(weight + 1), 6) AS log_weight,
       round(log10(weight + 1), 6) AS log10_weight FROM cites""")
def _(spark, d):
    w = F.col("weight")
    return t.cites(spark, d).select(
        "src", "dst", r6(F.try_divide(F.lit(1.0), w)).alias("inverse_weight"),
        r6(F.ln(w + 1)).alias("log_weight"), r6(F.log10(w + 1)).alias("log10_weight"))


@query("article_text", "F1 F2 F9 F10", """
SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_name || '. ' || p_type END AS text,
  substr(CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_name || '. ' || p_type END, 1, 8) AS short_text,
  len(string_split(p_name, ' ')) AS words, string_split(p_name, ' ')[1] AS first_word FROM part""")
def _(spark, d):
    part = t.table(spark, d, "part")
    abstract = F.when(F.col("p_size") % 10 != 0, F.col("p_type"))
    text = F.concat("p_name", F.lit(". "), abstract)
    words = F.split("p_name", " ")
    return part.select(F.col("p_partkey").alias("id"), text.alias("text"), F.substring(text, 0, 8).alias("short_text"),
                       F.size(words).cast("long").alias("words"), words[0].alias("first_word"))


@query("brand_numbers", "F3 F4 F8", """
SELECT p_partkey AS id, TRY_CAST(substr(p_brand, 7) AS BIGINT) AS brand, TRY_CAST(p_brand AS BIGINT) AS bad,
  CAST(p_retailprice AS DOUBLE) AS price, CAST(trunc(p_size / 10.0) AS INT) AS bucket, CAST(p_partkey AS INT) AS small_id FROM part""")
def _(spark, d):
    part = t.table(spark, d, "part")
    return part.select(
        F.col("p_partkey").alias("id"), F.substring("p_brand", 7, 10).try_cast("bigint").alias("brand"),
        F.col("p_brand").try_cast("bigint").alias("bad"), F.col("p_retailprice").cast("double").alias("price"),
        (F.col("p_size") / 10).cast("int").alias("bucket"), F.col("p_partkey").cast("int").alias("small_id"))


@query("year_span", "PF13 PF2", """
SELECT y AS year, (SELECT count(*) FROM articles WHERE year = y) AS articles
FROM (SELECT unnest(range((SELECT min(year) FROM articles), (SELECT max(year) FROM articles) + 1))::INT AS y)""")
def _(spark, d):
    a = t.articles(spark, d)
    span = a.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("year"))
    return span.join(a.groupBy("year").agg(F.count("*").alias("n")), "year", "left").select(
        "year", F.coalesce("n", F.lit(0)).alias("articles"))


@query("common_topics_of_cited_pair", "U3 F19 F9", """
WITH top AS (SELECT id, topic FROM (SELECT id, topic, row_number() OVER (PARTITION BY id ORDER BY weight DESC, topic) AS rk
  FROM has_topic) WHERE rk <= 5)
SELECT c.src, c.dst, c.src || '-' || c.dst AS edge_id,
  (SELECT count(*) FROM top a JOIN top b ON a.topic = b.topic WHERE a.id = c.src AND b.id = c.dst) AS common FROM cites c""")
def _(spark, d):
    best = rk.top_per_group(t.has_topic(spark, d), ["id"], [F.desc("weight"), F.col("topic")], 5)
    sets = best.groupBy("id").agg(F.collect_set("topic").alias("topics"))  # at most five topics each
    both = ex.with_ends(t.cites(spark, d), sets, ["topics"])
    return both.select("src", "dst", F.concat_ws("-", "src", "dst").alias("edge_id"),
                       F.size(F.array_intersect("src_topics", "dst_topics")).cast("long").alias("common"))
