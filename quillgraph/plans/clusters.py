"""Community detection, embeddings and clustering-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import classify as cl
from quillgraph.operators import community as cm
from quillgraph.operators import embedding as em
from quillgraph.operators import quality as qu
from quillgraph.operators.components import weak_components
from quillgraph.operators.explore import histogram
from quillgraph.operators.graph import Graph
from quillgraph.operators.ranking import sample_per_group
from quillgraph.plans.explore import citation_graph, r6
from quillgraph.plans.registry import query
from quillgraph.session import cut
from quillgraph.sources import tables as t

ROUNDS = 100


def flow(spark, d):
    return qu.cluster_flow(t.cites(spark, d), t.clusters(spark, d).select("run", "id", "cluster"))


_FLOW = """f AS MATERIALIZED (SELECT a.run, a.cluster AS a, b.cluster AS b, count(*) AS n FROM cites c
  JOIN clusters a ON c.src = a.id JOIN clusters b ON c.dst = b.id AND a.run = b.run GROUP BY ALL),
tot AS (SELECT run, sum(n) AS m FROM f GROUP BY run),
pc AS MATERIALIZED (SELECT run, cluster, sum(inside) AS inside, sum(o) AS o, sum(i) AS i FROM
  (SELECT run, a AS cluster, CASE WHEN a = b THEN n ELSE 0 END AS inside, n AS o, 0 AS i FROM f
   UNION ALL SELECT run, b, 0, 0, n FROM f) WHERE cluster IS NOT NULL GROUP BY ALL),
sizes AS (SELECT run, cluster, count(*) AS size FROM clusters GROUP BY ALL)"""
_MOD = "SELECT run, cluster, inside / m - o * i / (m * m)::DOUBLE AS modularity FROM pc JOIN tot USING (run)"
_CON = "SELECT run, cluster, coalesce((o - inside) / nullif(o, 0), 0) AS conductance FROM pc"
_COV = "SELECT run, a AS cluster, n / m AS coverage FROM f JOIN tot USING (run) WHERE a = b"


# ---------------------------------------------------------------- labels and sizes

@query("majority_label", "C8 W3 PF9 J11", """
WITH c AS (SELECT c.run, c.cluster, a.known_category AS k, count(*) AS n FROM clusters c JOIN articles a ON a.id = c.id
  WHERE c.cluster IS NOT NULL AND a.known_category IS NOT NULL GROUP BY ALL),
b AS (SELECT run, cluster, k FROM (SELECT *, row_number() OVER (PARTITION BY run, cluster ORDER BY n DESC, k) AS rk FROM c) WHERE rk = 1)
SELECT x.run, x.id, x.cluster, CASE WHEN x.cluster IS NOT NULL THEN coalesce(b.k, -1) END AS consensus
FROM clusters x LEFT JOIN b ON x.run = b.run AND x.cluster = b.cluster""")
def _(spark, d):
    known = t.articles(spark, d).select("id", "known_category")
    assigned = t.clusters(spark, d).select("run", "id", "cluster").join(known, "id")
    return cm.majority_label(assigned, ("run",)).select("run", "id", "cluster", "consensus")


@query("cluster_sizes", "CM1 A2", "SELECT run, cluster, count(*) AS size FROM clusters GROUP BY ALL")
def _(spark, d):
    return qu.cluster_sizes(t.clusters(spark, d))


@query("community_size_distribution", "CM15 A15 S2", """
WITH s AS (SELECT run, cluster, count(*) AS size FROM clusters GROUP BY ALL),
h AS (SELECT run, size, count(cluster) AS clusters FROM s GROUP BY ALL)
SELECT run, size, clusters FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY size) AS rk FROM h) WHERE rk <= 100""")
def _(spark, d):
    return qu.community_size_distribution(t.clusters(spark, d))


# ---------------------------------------------------------------- edge-based quality

@query("coverage_by_category", "CM4 A12 J1", """
SELECT a.category, round(count(*) / (SELECT count(*) FROM cites), 6) AS coverage
FROM cites c JOIN articles a ON c.src = a.id JOIN articles b ON c.dst = b.id WHERE a.category = b.category GROUP BY a.category""")
def _(spark, d):
    own = t.articles(spark, d).select("id", F.lit(0).alias("run"), F.col("category").alias("cluster"))
    return qu.coverage(qu.cluster_flow(t.cites(spark, d), own)).select(F.col("cluster").alias("category"), r6("coverage").alias("coverage"))


@query("coverage", "CM4 A12", f"WITH {_FLOW} SELECT run, cluster, round(coverage, 6) AS coverage FROM ({_COV})")
def _(spark, d):
    return qu.coverage(flow(spark, d)).withColumn("coverage", r6("coverage"))


@query("modularity_directed", "CM2", f"WITH {_FLOW} SELECT run, cluster, round(modularity, 8) AS modularity FROM ({_MOD})")
def _(spark, d):
    return qu.modularity(flow(spark, d)).withColumn("modularity", F.round("modularity", 8))


@query("modularity_undirected", "CM2", f"""WITH {_FLOW}
SELECT run, cluster, round(inside / m - ((o + i) / (2 * m)) * ((o + i) / (2 * m)), 8) AS modularity FROM pc JOIN tot USING (run)""")
def _(spark, d):
    return qu.modularity(flow(spark, d), directed=False).withColumn("modularity", F.round("modularity", 8))


@query("conductance", "CM3", f"WITH {_FLOW} SELECT run, cluster, round(conductance, 6) AS conductance FROM ({_CON})")
def _(spark, d):
    return qu.conductance(flow(spark, d)).withColumn("conductance", r6("conductance"))


@query("conductance_least_side", "CM3", f"""WITH {_FLOW},
k AS (SELECT run, a AS cluster, sum(CASE WHEN a = b THEN n ELSE 0 END) AS i, sum(CASE WHEN a <> b THEN n ELSE 0 END) AS e
  FROM f WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)
SELECT run, cluster, round(e / least(i, e), 6) AS conductance FROM k WHERE i > 0 AND e > 0""")
def _(spark, d):
    return qu.conductance(flow(spark, d), "least").withColumn("conductance", r6("conductance"))


@query("citation_density", "CM5 A12", f"""WITH {_FLOW}
SELECT run, round(sum(CASE WHEN a = b THEN n ELSE 0 END) / sum(n), 6) AS density FROM f GROUP BY run""")
def _(spark, d):
    return qu.citation_density(flow(spark, d)).withColumn("density", r6("density"))


@query("cluster_density", "CM5 F6", f"""WITH {_FLOW}
SELECT s.run, s.cluster, round(coalesce(f.n, 0) / nullif(s.size * (s.size - 1), 0), 6) AS density
FROM sizes s LEFT JOIN f ON f.run = s.run AND f.a = s.cluster AND f.b = s.cluster WHERE s.cluster IS NOT NULL""")
def _(spark, d):
    return qu.cluster_density(flow(spark, d), t.clusters(spark, d)).withColumn("density", r6("density"))


@query("inter_cluster_ratio", "CM14", f"WITH {_FLOW} SELECT run, cluster, round((o - inside) / nullif(inside, 0), 6) AS ratio FROM pc")
def _(spark, d):
    return qu.inter_cluster_ratio(flow(spark, d)).withColumn("ratio", r6("ratio"))


@query("three_metrics_per_cluster", "J13 U2", f"""WITH {_FLOW}
SELECT c.run, c.cluster, round(c.conductance, 6) AS conductance, round(v.coverage, 6) AS coverage, round(m.modularity, 8) AS modularity
FROM ({_CON}) c JOIN ({_COV}) v USING (run, cluster) JOIN ({_MOD}) m USING (run, cluster)""")
def _(spark, d):
    f = cut(flow(spark, d))
    return qu.conductance(f).join(qu.coverage(f), ["run", "cluster"]).join(qu.modularity(f), ["run", "cluster"]).select(
        "run", "cluster", r6("conductance").alias("conductance"), r6("coverage").alias("coverage"), F.round("modularity", 8).alias("modularity"))


@query("conductance_histogram", "A22", f"""WITH {_FLOW}
SELECT CASE WHEN conductance >= 1 THEN 51 ELSE floor(conductance * 50)::INT + 1 END AS bin, count(*) AS "rows" FROM ({_CON}) GROUP BY ALL""")
def _(spark, d):
    return histogram(qu.conductance(flow(spark, d)), "conductance", 0, 1, 50)


def _summary_sql(metric: str, body: str) -> str:
    return f"""WITH {_FLOW}, m AS ({body}),
r AS (SELECT s.run, coalesce(sum(s.size * m.{metric}), 0) / sum(s.size) AS v FROM sizes s LEFT JOIN m
  ON s.run = m.run AND s.cluster IS NOT DISTINCT FROM m.cluster GROUP BY s.run)
SELECT round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS spread FROM r"""


for _name, _body, _fn in (("modularity", _MOD, qu.modularity), ("conductance", _CON, qu.conductance), ("coverage", _COV, qu.coverage)):
    @query(f"summarise_{_name}", "CM16 A16 J12 F7 A8", _summary_sql(_name, _body))
    def _(spark, d, name=_name, fn=_fn):
        return qu.summarise_runs(qu.cluster_sizes(t.clusters(spark, d)), fn(flow(spark, d)), name)


# ---------------------------------------------------------------- agreement with categories

_ACC = """SELECT run, category, count(*) AS total, sum(CASE WHEN category = consensus THEN 1 ELSE 0 END)::BIGINT AS correct
  FROM clusters WHERE year = 2000 GROUP BY ALL"""


@query("accuracy_per_category", "CM6 A11 PF7 PF11", f"SELECT run, category, total, correct, round(correct / total, 6) AS accuracy FROM ({_ACC})")
def _(spark, d):
    return qu.accuracy(t.clusters(spark, d), t.EVALUATION_YEAR).withColumn("accuracy", r6("accuracy"))


@query("overall_accuracy", "CM6 A17 IO14", f"SELECT run, round(sum(correct) / sum(total), 6) AS accuracy FROM ({_ACC}) GROUP BY run")
def _(spark, d):
    per = qu.accuracy(t.clusters(spark, d), t.EVALUATION_YEAR)
    return qu.overall_accuracy(per).withColumn("accuracy", r6("accuracy"))


@query("summarise_accuracy", "CM16 A17", f"""
SELECT round(avg(a), 4) AS mean, round(stddev_samp(a), 4) AS spread FROM
 (SELECT run, sum(correct) / sum(total) AS a FROM ({_ACC}) GROUP BY run)""")
def _(spark, d):
    per = qu.overall_accuracy(qu.accuracy(t.clusters(spark, d), t.EVALUATION_YEAR))
    return per.agg(F.round(F.avg("accuracy"), 4).alias("mean"), F.round(F.stddev_samp("accuracy"), 4).alias("spread"))


_CONF = "SELECT run, category AS truth, consensus AS predicted, count(*) AS count FROM clusters WHERE year = 2000 GROUP BY ALL"


@query("confusion_counts", "CM7 A2 S1", _CONF)
def _(spark, d):
    return qu.confusion_counts(t.clusters(spark, d), t.EVALUATION_YEAR)


_MATRIX = f"""b AS (SELECT CASE WHEN truth BETWEEN 0 AND 39 THEN truth ELSE 40 END AS truth,
  CASE WHEN predicted BETWEEN 0 AND 39 THEN predicted ELSE 40 END AS predicted, sum(count) AS n FROM ({_CONF}) GROUP BY ALL),
x AS (SELECT truth, predicted, round_even(n / sum(n) OVER (PARTITION BY truth), 2) AS share FROM b)"""


@query("confusion_matrix", "CM8 F7", f"""WITH {_MATRIX}
SELECT truth, predicted, share, CASE WHEN truth = predicted AND truth < 40 THEN 0.5::DOUBLE + 0.5::DOUBLE * share
  ELSE 0.5::DOUBLE - 0.5::DOUBLE * share END AS colour FROM x""")
def _(spark, d):
    return qu.confusion_matrix(qu.confusion_counts(t.clusters(spark, d), t.EVALUATION_YEAR))


@query("confusion_matrix_wide", "CM8 A4", f"WITH {_MATRIX} SELECT truth, " + ", ".join(
    f"sum(CASE WHEN predicted = {i} THEN share ELSE 0 END) AS p{i}" for i in range(41)) + " FROM x GROUP BY truth")
def _(spark, d):
    return qu.confusion_matrix_wide(qu.confusion_matrix(qu.confusion_counts(t.clusters(spark, d), t.EVALUATION_YEAR)))


@query("category_homogeneity_mean", "CM12", """
WITH c AS (SELECT run, cluster, category, count(*) AS n FROM clusters GROUP BY ALL),
m AS (SELECT run, cluster, max(n) AS most FROM c WHERE cluster IS NOT NULL GROUP BY ALL)
SELECT run, round(avg(n / most), 6) AS homogeneity FROM c JOIN m USING (run, cluster) GROUP BY run""")
def _(spark, d):
    return qu.category_homogeneity_mean(t.clusters(spark, d)).withColumn("homogeneity", r6("homogeneity"))


@query("category_homogeneity", "CM12", """
WITH c AS (SELECT run, cluster, category, count(*) AS n FROM clusters WHERE cluster IS NOT NULL GROUP BY ALL)
SELECT run, cluster, round(max(n) / sum(n), 6) AS homogeneity FROM c GROUP BY ALL""")
def _(spark, d):
    return qu.category_homogeneity(t.clusters(spark, d)).withColumn("homogeneity", r6("homogeneity"))


@query("temporal_cohesion", "CM13 A8", """
SELECT run, round(avg(s), 6) AS cohesion FROM (SELECT run, cluster, stddev_samp(year) AS s FROM clusters GROUP BY ALL) GROUP BY run""")
def _(spark, d):
    return qu.temporal_cohesion(t.clusters(spark, d)).withColumn("cohesion", r6("cohesion"))


# ---------------------------------------------------------------- shared ancestors

_CITING = "citing AS MATERIALIZED (SELECT DISTINCT k.run, c.src AS id, k.cluster FROM cites c JOIN clusters k ON c.src = k.id)"
_SHARED = """den AS (SELECT x.run, x.cluster AS a, y.cluster AS b, count(*) AS n FROM citing x JOIN citing y ON x.run = y.run AND x.id < y.id GROUP BY ALL),
num AS (SELECT x.run, x.cluster AS a, y.cluster AS b, count(*) AS n FROM cited x JOIN cited y
  ON x.run = y.run AND x.parent = y.parent AND x.id < y.id GROUP BY ALL),
shared AS MATERIALIZED (SELECT den.run, den.a, den.b, coalesce(num.n, 0) / den.n AS shared FROM den LEFT JOIN num
  ON den.run = num.run AND den.a IS NOT DISTINCT FROM num.a AND den.b IS NOT DISTINCT FROM num.b)"""
_PLAIN = f"""WITH {_CITING}, cited AS MATERIALIZED (SELECT DISTINCT k.run, c.dst AS parent, c.src AS id, k.cluster
  FROM cites c JOIN clusters k ON c.src = k.id), {_SHARED}"""
_SUPER = f"""WITH {_CITING},
sup AS MATERIALIZED (SELECT run, cluster, id, (row_number() OVER (PARTITION BY run, cluster ORDER BY id) // 10)::INT AS bucket FROM citing),
cited AS MATERIALIZED (SELECT DISTINCT k.run, (coalesce(s.cluster, -1) * 1000000 + s.bucket) AS parent, c.src AS id, k.cluster
  FROM cites c JOIN clusters k ON c.src = k.id JOIN sup s ON s.run = k.run AND s.id = c.dst), {_SHARED}"""


@query("shared_ancestors", "CM9 J9 J10 A6 U3", _PLAIN + " SELECT run, a, b, round(shared, 6) AS shared FROM shared")
def _(spark, d):
    return qu.shared_ancestors(t.cites(spark, d), t.clusters(spark, d)).withColumn("shared", r6("shared"))


@query("shared_ancestors_supernodes", "CM9 CM21", _SUPER + " SELECT run, a, b, round(shared, 6) AS shared FROM shared")
def _(spark, d):
    return qu.shared_ancestors(t.cites(spark, d), t.clusters(spark, d), supernodes=10).withColumn("shared", r6("shared"))


@query("nss", "CM10 J15 F6", _PLAIN + """
SELECT o.run, o.a AS cluster, round(o.shared / (x.most + 1), 6) AS nss FROM shared o JOIN
 (SELECT run, a, max(shared) AS most FROM shared WHERE a <> b GROUP BY ALL) x ON o.run = x.run AND o.a = x.a WHERE o.a = o.b""")
def _(spark, d):
    return qu.nss(qu.shared_ancestors(t.cites(spark, d), t.clusters(spark, d))).withColumn("nss", r6("nss"))


@query("supernode_map", "CM21 W1 F8 J8", f"""WITH {_CITING}
SELECT run, cluster, id, (row_number() OVER (PARTITION BY run, cluster ORDER BY id) // 10)::INT AS bucket FROM citing""")
def _(spark, d):
    return qu.supernode_map(t.cites(spark, d), t.clusters(spark, d))


@query("two_hop_ancestors", "CM11 J9 A13", """
SELECT a.src AS child, count(DISTINCT b.dst) AS ancestors FROM cites a JOIN cites b ON a.dst = b.src GROUP BY a.src""")
def _(spark, d):
    return qu.k_hop_ancestors(t.cites(spark, d), 2).groupBy("child").agg(F.count("*").alias("ancestors"))


# ---------------------------------------------------------------- summaries

def timings(spark, d):
    return t.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("no")).agg(
        F.avg("l_discount").alias("time_s"), F.avg("l_quantity").alias("writeMillis"),
        F.avg("l_extendedprice").alias("computeMillis"), F.lit(0.0).alias("postProcessingMillis"))


@query("summarise_timings", "CM17 A18", """
WITH w AS (SELECT l_linenumber AS no, avg(l_discount) * 1000 AS majority_ms, avg(l_quantity) AS writeMillis,
  avg(l_extendedprice) AS computeMillis FROM lineitem GROUP BY l_linenumber),
u AS (SELECT 'majority_ms' AS measure, majority_ms AS v FROM w UNION ALL SELECT 'writeMillis', writeMillis FROM w
  UNION ALL SELECT 'computeMillis', computeMillis FROM w UNION ALL SELECT 'total_ms', writeMillis + computeMillis + majority_ms FROM w
  UNION ALL SELECT 'communityCount', 40 FROM w)
SELECT measure, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS spread FROM u GROUP BY measure""")
def _(spark, d):
    return qu.summarise_timings(timings(spark, d), ["writeMillis", "computeMillis", "postProcessingMillis"])


@query("timings_of_both_halves", "J14 A18", """
SELECT l_linenumber AS no, round(avg(l_quantity) + avg(l_extendedprice) + avg(l_tax) * 1000, 4) AS total_ms FROM lineitem GROUP BY l_linenumber""")
def _(spark, d):
    first = timings(spark, d)
    second = t.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("no")).agg(F.avg("l_tax").alias("embedding_s"))
    return first.join(second, "no").select("no", F.round(
        F.col("writeMillis") + F.col("computeMillis") + F.col("embedding_s") * 1000, 4).alias("total_ms"))


@query("modularity_needs_log_scale", "CM18 A21", f"""WITH {_FLOW}
SELECT round(median(modularity), 8) AS median, round(max(modularity), 8) AS top, max(modularity) > 100 * median(modularity) AS log_scale FROM ({_MOD})""")
def _(spark, d):
    out = qu.needs_log_scale(qu.modularity(flow(spark, d)), "modularity")
    return out.select(F.round("median", 8).alias("median"), F.round("top", 8).alias("top"), "log_scale")


@query("samples_of_three_runs", "C9 U2 S6", " UNION ALL ".join(f"""
SELECT id, category, {r} AS run FROM (SELECT id, category, row_number() OVER (PARTITION BY category
  ORDER BY ((id % 2147483647) * 1103515245 + {r + 1} * 12345) % 2147483647, id) AS rk FROM articles) WHERE rk <= 5""" for r in range(3)))
def _(spark, d):
    rows = t.articles(spark, d).select("id", "category")
    return cm.run_repeats(lambda r: sample_per_group(rows, ["category"], "id", 5, r), 3)


# ---------------------------------------------------------------- community detection

def _lpa_sql(edges: str, nodes: str, seeds: str | None, rounds: int = ROUNDS) -> str:
    start = (f"SELECT n.id, coalesce(s.label, n.id + (SELECT max(label) FROM s) + 1)::BIGINT AS label FROM n LEFT JOIN s ON n.id = s.id"
             if seeds else "SELECT id, id AS label FROM n")
    steps = [f"n AS MATERIALIZED ({nodes})", f"e AS MATERIALIZED ({edges})"]
    if seeds:
        steps.append(f"s AS MATERIALIZED ({seeds})")
    steps.append(f"l0 AS MATERIALIZED ({start})")
    for i in range(1, rounds + 1):
        steps.append(f"""l{i} AS MATERIALIZED (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY sum(w) DESC, label) AS rk
 FROM (SELECT e.src AS id, l.label, e.w FROM e JOIN l{i - 1} l ON e.dst = l.id UNION ALL SELECT id, label, 0 FROM l{i - 1}) GROUP BY id, label) WHERE rk = 1)""")
    return "WITH " + ",\n".join(steps) + f"\nSELECT id, label FROM l{rounds}"


_SEEDS = "SELECT id, known_category::BIGINT AS label FROM articles WHERE known_category IS NOT NULL"


def article_seeds(spark, d):
    return t.articles(spark, d).select("id", F.col("known_category").alias("label"))


@query("label_propagation", "C1 C10", _lpa_sql("SELECT src, dst, 1 AS w FROM cites", "SELECT id FROM articles", _SEEDS))
def _(spark, d):
    return cm.label_propagation(citation_graph(spark, d), article_seeds(spark, d), ROUNDS)


@query("label_propagation_weighted", "C1 C10", _lpa_sql("SELECT src, dst, weight AS w FROM cites", "SELECT id FROM articles", _SEEDS))
def _(spark, d):
    return cm.label_propagation(citation_graph(spark, d, "weight"), article_seeds(spark, d), ROUNDS)


@query("label_propagation_unseeded", "C1", _lpa_sql("SELECT src, dst, 1 AS w FROM cites", "SELECT id FROM articles", None))
def _(spark, d):
    return cm.label_propagation(citation_graph(spark, d), None, ROUNDS)


_TOPIC_NODES = "SELECT id * 2 AS id FROM articles UNION ALL SELECT DISTINCT topic * 2 + 1 FROM has_topic"
_TOPIC_EDGES = "SELECT src * 2 AS src, dst * 2 AS dst, {w} AS w FROM cites UNION ALL SELECT id * 2, topic * 2 + 1, {w} FROM has_topic"
_TOPIC_SEEDS = "SELECT id * 2 AS id, known_category::BIGINT AS label FROM articles WHERE known_category IS NOT NULL"


def _with_topics(spark, d, weighted):
    g = cm.topic_graph(t.articles(spark, d), t.cites(spark, d), t.has_topic(spark, d), weighted)
    seeds = t.articles(spark, d).select((F.col("id") * 2).alias("id"), F.col("known_category").alias("label"))
    return g, seeds


@query("label_propagation_topics", "C1 C10 G1", _lpa_sql(_TOPIC_EDGES.format(w="1"), _TOPIC_NODES, _TOPIC_SEEDS))
def _(spark, d):
    return cm.label_propagation(*_with_topics(spark, d, False), ROUNDS)


@query("label_propagation_topics_weighted", "C1 C10 G1", _lpa_sql(_TOPIC_EDGES.format(w="weight"), _TOPIC_NODES, _TOPIC_SEEDS))
def _(spark, d):
    return cm.label_propagation(*_with_topics(spark, d, True), ROUNDS)


def _slpa_sql(rounds: int) -> str:
    steps = ["m0 AS MATERIALIZED (SELECT id, id AS label, 1::BIGINT AS c FROM articles)", "e AS MATERIALIZED (SELECT src, dst FROM cites)"]
    for i in range(1, rounds + 1):
        steps.append(f"""k{i} AS (SELECT id, label, c, sum(c) OVER (PARTITION BY id ORDER BY label) AS upto,
  ((((id % 2147483647) * 1103515245 + {i} * 12345) % 2147483647) // 16) % (sum(c) OVER (PARTITION BY id)) AS spot FROM m{i - 1}),
s{i} AS MATERIALIZED (SELECT id, label FROM k{i} WHERE spot < upto AND spot >= upto - c),
h{i} AS (SELECT id, label FROM (SELECT e.src AS id, s.label, row_number() OVER (PARTITION BY e.src ORDER BY count(*) DESC, s.label) AS rk
  FROM e JOIN s{i} s ON e.dst = s.id GROUP BY e.src, s.label) WHERE rk = 1),
m{i} AS MATERIALIZED (SELECT id, label, sum(c)::BIGINT AS c FROM (SELECT * FROM m{i - 1} UNION ALL SELECT id, label, 1 FROM h{i}) GROUP BY id, label)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT id, label, round(share, 6) AS share FROM (SELECT id, label, c / sum(c) OVER (PARTITION BY id) AS share FROM m{rounds}) WHERE share >= 0.2"""


@query("speaker_listener", "C5", _slpa_sql(ROUNDS))
def _(spark, d):
    return cm.speaker_listener(citation_graph(spark, d), iterations=ROUNDS).withColumn("share", r6("share"))


@query("louvain", "C2")
def _(spark, d):
    return cm.louvain(citation_graph(spark, d))[0]


@query("louvain_weighted", "C2 C10")
def _(spark, d):
    return cm.louvain(citation_graph(spark, d, "weight"))[0]


@query("louvain_topics", "C2 C10 G1")
def _(spark, d):
    return cm.louvain(_with_topics(spark, d, False)[0])[0]


@query("modularity_optimization", "C3")
def _(spark, d):
    return cm.modularity_optimization(citation_graph(spark, d))[0]


_MOVES = 3


def _moves_sql(rounds: int) -> str:
    """Rounds of local moves from single nodes, unrolled; movers alternate by parity, gains are whole numbers."""
    steps = ["""e AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*)::DOUBLE AS w FROM cites GROUP BY ALL),
l AS MATERIALIZED (SELECT a AS src, b AS dst, w FROM e WHERE a <> b UNION ALL SELECT b, a, w FROM e WHERE a <> b),
k AS MATERIALIZED (SELECT a.id, coalesce(sum(l.w), 0) AS k FROM articles a LEFT JOIN l ON l.src = a.id GROUP BY a.id), m AS (SELECT sum(k) AS m FROM k),
s0 AS MATERIALIZED (SELECT id, id AS comm, k FROM k)"""]
    for i in range(rounds):
        steps.append(f"""p{i} AS (SELECT id, comm, sum(w) AS w FROM (SELECT l.src AS id, s.comm, l.w FROM l JOIN s{i} s ON s.id = l.dst UNION ALL SELECT id, comm, 0 FROM s{i}) GROUP BY id, comm),
z{i} AS (SELECT comm, sum(k) AS mass FROM s{i} GROUP BY comm),
o{i} AS MATERIALIZED (SELECT p.id, p.comm, s.comm AS own, s.k, p.w * (SELECT m FROM m) - s.k * (z.mass - CASE WHEN p.comm = s.comm THEN s.k ELSE 0 END) AS gain
  FROM p{i} p JOIN z{i} z ON z.comm = p.comm JOIN s{i} s ON s.id = p.id),
b{i} AS (SELECT id, any_value(own) AS own, any_value(k) AS k, arg_min(comm, (-gain, comm)) AS best, max(gain) AS top, max(CASE WHEN comm = own THEN gain END) AS stay FROM o{i} GROUP BY id),
s{i + 1} AS MATERIALIZED (SELECT id, CASE WHEN id % 2 = {i % 2} AND top > stay THEN best ELSE own END AS comm, k FROM b{i})""")
    return "WITH " + ",\n".join(steps)


@query("modularity_optimization_first_rounds", "C3", _moves_sql(_MOVES) + f"\nSELECT id, min(id) OVER (PARTITION BY comm) AS community FROM s{_MOVES}")
def _(spark, d):
    """Each of these rounds raises modularity, so none is undone."""
    return cm.modularity_optimization(citation_graph(spark, d), iterations=_MOVES)[0]


@query("leiden", "C4")
def _(spark, d):
    return cm.leiden(citation_graph(spark, d))[0]


@query("leiden_communities_connected", "C4", "SELECT count(*) AS nodes, true AS connected FROM articles")
def _(spark, d):
    """Whether every community is one component of the edges inside communities."""
    g = citation_graph(spark, d).stored()
    found = cut(cm.leiden(g)[0])
    side = lambda end, name: found.select(F.col("id").alias(end), F.col("community").alias(name))
    inside = g.edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst").filter("a = b").select("src", "dst", "weight")
    parts = weak_components(Graph(g.nodes.select("id"), inside))
    both = found.join(parts, "id")
    return both.agg(F.count("*").alias("nodes"), (F.countDistinct("community", "component") == F.countDistinct("community")).alias("connected"))


# ---------------------------------------------------------------- embeddings

_DIM = 256
_DRAW = """CASE WHEN ('0x' || substr(md5(concat({key}, '-', j // 8, '-', {seed})), 1 + 4 * (j % 8), 4))::INT < 10923 THEN sqrt(3)
  WHEN ('0x' || substr(md5(concat({key}, '-', j // 8, '-', {seed})), 1 + 4 * (j % 8), 4))::INT < 21845 THEN -sqrt(3) ELSE 0 END"""


def _rp_steps(nodes: str, edges: str) -> str:
    return f"""n AS MATERIALIZED ({nodes}), e AS MATERIALIZED ({edges}),
r AS MATERIALIZED (SELECT id, j, {_DRAW.format(key='id', seed=0)} AS v FROM n, (SELECT unnest(range({_DIM})) AS j)),
a1 AS MATERIALIZED (SELECT e.src AS id, r.j, sum(r.v * w) / sum(w) AS v FROM e JOIN r ON e.dst = r.id GROUP BY ALL),
p1 AS MATERIALIZED (SELECT id, j, coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY id)), 0), 0) AS v FROM a1),
a2 AS MATERIALIZED (SELECT e.src AS id, r.j, sum(r.v * w) / sum(w) AS v FROM e JOIN p1 r ON e.dst = r.id GROUP BY ALL),
p2 AS MATERIALIZED (SELECT id, j, coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY id)), 0), 0) AS v FROM a2),
z AS MATERIALIZED (SELECT n.id, d.j AS dim, coalesce(p1.v, 0) + coalesce(p2.v, 0) AS value FROM n CROSS JOIN (SELECT unnest(range({_DIM}))::INT AS j) d
  LEFT JOIN p1 ON p1.id = n.id AND p1.j = d.j LEFT JOIN p2 ON p2.id = n.id AND p2.j = d.j)"""


def _rp_sql(weight: str) -> str:
    steps = _rp_steps("SELECT id FROM articles", f"SELECT src, dst, {weight} AS w FROM cites")
    return f"WITH {steps} SELECT id, dim, round(value, 5) AS value FROM z"


def _cells(df):
    return df.select("id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 5))


@query("fast_rp", "C7 F14", _rp_sql("1"))
def _(spark, d):
    return _cells(em.fast_rp(citation_graph(spark, d), _DIM))


@query("fast_rp_weighted", "C7 C10", _rp_sql("weight"))
def _(spark, d):
    return _cells(em.fast_rp(citation_graph(spark, d, "weight"), _DIM, weighted=True))


_FEATURES = 64
_RP_FEATURES = _rp_steps("SELECT id FROM vectors", "SELECT src, dst, 1 AS w FROM vector_edges") + f""",
u AS MATERIALIZED (SELECT id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM vectors),
rf AS MATERIALIZED (SELECT pos, j, {_DRAW.format(key='pos', seed=1)} AS v FROM (SELECT unnest(range(64)) AS pos), (SELECT unnest(range({_FEATURES})) AS j)),
zf AS MATERIALIZED (SELECT id, dim, value FROM z UNION ALL SELECT u.id, {_DIM} + rf.j::INT, sum(u.x * rf.v) FROM u JOIN rf ON u.pos = rf.pos GROUP BY u.id, rf.j)"""


def _vector_graph(spark, d):
    return Graph.of(t.vectors(spark, d).select("id"), t.vector_edges(spark, d).withColumn("weight", F.lit(1.0)))


@query("fast_rp_with_features", "C7", f"WITH {_RP_FEATURES} SELECT id, dim, round(value, 5) AS value FROM zf")
def _(spark, d):
    return _cells(em.fast_rp(_vector_graph(spark, d), _DIM, features=t.vectors(spark, d), feature_dim=_FEATURES))


K, LLOYD, RUNS = 120, 20, 10


def _kmeans_steps(rows: str, seed: int, name: str = "") -> str:
    """Lloyd rounds over `rows` (id, x DOUBLE[]), unrolled; the last step is `a{name}` (id, cluster)."""
    draw = f"((id % 2147483647) * 1103515245 + {seed + 1} * 12345) % 2147483647"
    steps = [f"x{name} AS MATERIALIZED ({rows})",
             f"c{name}_0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY {draw}, id) - 1)::INT AS cluster, x AS v FROM x{name} ORDER BY 1 LIMIT {K})"]
    near = """SELECT id, cluster FROM (SELECT x.id, c.cluster, row_number() OVER (PARTITION BY x.id
  ORDER BY round(list_dot_product(c.v, c.v) - 2 * list_dot_product(x.x, c.v), 9), c.cluster) AS rk FROM {x} x CROSS JOIN {c} c) WHERE rk = 1"""
    for i in range(LLOYD):
        c = f"c{name}_{i}"
        steps.append(f"a{name}_{i} AS MATERIALIZED ({near.format(x=f'x{name}', c=c)})")
        steps.append(f"""c{name}_{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM {c} c LEFT JOIN (SELECT cluster, list(s ORDER BY pos) AS v
  FROM (SELECT a.cluster, u.pos, avg(u.s) AS s FROM a{name}_{i} a JOIN (SELECT id, unnest(range(len(x))) AS pos, unnest(x) AS s FROM x{name}) u ON a.id = u.id
  GROUP BY a.cluster, u.pos) GROUP BY cluster) m ON m.cluster = c.cluster)""")
    steps.append(f"a{name} AS MATERIALIZED ({near.format(x=f'x{name}', c=f'c{name}_{LLOYD}')})")
    return ",\n".join(steps)


_VECTORS = "SELECT id, embedding::DOUBLE[] AS x FROM vectors"


@query("kmeans_text_vectors", "C6", f"WITH {_kmeans_steps(_VECTORS, 1)} SELECT id, cluster FROM a")
def _(spark, d):
    return em.kmeans(t.vectors(spark, d), K, 1, LLOYD)


@query("kmeans_runs", "C6 C9 U2", "WITH " + ",\n".join(_kmeans_steps(_VECTORS, r, f"r{r}") for r in range(RUNS)) + "\n"
       + " UNION ALL ".join(f"SELECT id, cluster, {r} AS run FROM ar{r}" for r in range(RUNS)))
def _(spark, d):
    rows = t.vectors(spark, d)
    return cm.run_repeats(lambda r: em.kmeans(rows, K, r, LLOYD), RUNS)


_NODE_VECTORS = "SELECT id, list(value ORDER BY dim) AS x FROM z GROUP BY id"


@query("kmeans_node_embedding", "C6 C7 C8", f"""
WITH {_rp_steps("SELECT id FROM articles", "SELECT src, dst, 1 AS w FROM cites")}, {_kmeans_steps(_NODE_VECTORS, 1)},
k AS (SELECT a.cluster, r.known_category AS k, count(*) AS n FROM a JOIN articles r USING (id) WHERE r.known_category IS NOT NULL GROUP BY ALL),
b AS (SELECT cluster, k FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, k) AS rk FROM k) WHERE rk = 1)
SELECT a.id, a.cluster, coalesce(b.k, -1) AS consensus FROM a LEFT JOIN b ON a.cluster = b.cluster""")
def _(spark, d):
    a = t.articles(spark, d)
    found = em.kmeans(em.fast_rp(citation_graph(spark, d), _DIM), K, 1, LLOYD)
    return cm.majority_label(found.join(a.select("id", "known_category"), "id")).select("id", "cluster", "consensus")


@query("kmeans_text_and_node_embedding", "C6 C7", f"""
WITH {_rp_steps("SELECT id FROM vectors", "SELECT src, dst, 1 AS w FROM vector_edges")},
{_kmeans_steps("SELECT n.id, list_concat(n.x, v.embedding::DOUBLE[]) AS x FROM (" + _NODE_VECTORS + ") n JOIN vectors v ON n.id = v.id", 1)} SELECT id, cluster FROM a""")
def _(spark, d):
    return em.kmeans(em.combine_vectors(em.fast_rp(_vector_graph(spark, d), _DIM), t.vectors(spark, d)), K, 1, LLOYD)


_STEPS, _RATE, _PENALTY, _BATCHES = 4, 2.0, 0.001, 2


def _softmax_sql() -> str:
    """Gradient steps over the node vectors, unrolled; c is the prediction of every article."""
    steps = [_rp_steps("SELECT id FROM articles", "SELECT src, dst, 1 AS w FROM cites"), "x AS MATERIALIZED (SELECT id, list_append(x, 1.0) AS x FROM (" + _NODE_VECTORS + "))",
             "known AS MATERIALIZED (SELECT x.id, x.x, a.known_category::BIGINT AS k FROM x JOIN articles a USING (id) WHERE a.known_category IS NOT NULL)",
             f"w0 AS MATERIALIZED (SELECT DISTINCT k, list_resize([]::DOUBLE[], {_DIM + 1}, 0.0::DOUBLE) AS w FROM known)"]
    for i in range(_STEPS):
        steps.append(f"""l{i} AS MATERIALIZED (SELECT r.id, r.x, r.k AS truth, w.k, list_dot_product(r.x, w.w) AS l FROM known r CROSS JOIN w{i} w WHERE r.id % {_BATCHES} = {i % _BATCHES}),
q{i} AS MATERIALIZED (SELECT *, exp(l - max(l) OVER (PARTITION BY id)) AS e FROM l{i}),
o{i} AS MATERIALIZED (SELECT id, x, k, e / sum(e) OVER (PARTITION BY id) - CASE WHEN k = truth THEN 1 ELSE 0 END AS off FROM q{i}),
g{i} AS MATERIALIZED (SELECT k, pos, sum(off * v) / (SELECT count(DISTINCT id) FROM l{i}) AS g FROM (SELECT k, off, unnest(range({_DIM + 1})) AS pos, unnest(x) AS v FROM o{i}) GROUP BY k, pos),
w{i + 1} AS MATERIALIZED (SELECT k, list(v - {_RATE} * (g + CASE WHEN pos < {_DIM} THEN {_PENALTY} * v ELSE 0 END) ORDER BY pos) AS w FROM
  (SELECT w.k, unnest(range({_DIM + 1})) AS pos, unnest(w.w) AS v FROM w{i} w) JOIN g{i} USING (k, pos) GROUP BY k)""")
    steps.append(f"""ll AS MATERIALIZED (SELECT x.id, w.k, list_dot_product(x.x, w.w) AS l FROM x CROSS JOIN w{_STEPS} w),
c AS MATERIALIZED (SELECT id, k AS predicted, e / sum(e) OVER (PARTITION BY id) AS probability, rk FROM
  (SELECT id, k, exp(l - max(l) OVER (PARTITION BY id)) AS e, row_number() OVER (PARTITION BY id ORDER BY round(l, 9) DESC, k) AS rk FROM ll))""")
    return "WITH " + ",\n".join(steps)


def _classified(spark, d):
    a = t.articles(spark, d)
    rows = cut(em.fast_rp(citation_graph(spark, d), _DIM).join(a.select("id", F.col("known_category").cast("bigint").alias("label")), "id"))
    return cl.predict(rows, cl.fit(rows, _STEPS, _RATE, _PENALTY, _BATCHES))


@query("node_classification", "2.13h C7", _softmax_sql() + "\nSELECT id, predicted, round(probability, 6) AS probability FROM c WHERE rk = 1")
def _(spark, d):
    return _classified(spark, d).select("id", "predicted", r6("probability").alias("probability"))


@query("node_classification_accuracy", "2.13h CM6", _softmax_sql() + """
SELECT 0 AS run, a.category, count(*) AS total, CAST(sum(CASE WHEN c.predicted = a.category THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  round(sum(CASE WHEN c.predicted = a.category THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM articles a JOIN c USING (id) WHERE c.rk = 1 AND a.year = 2000 GROUP BY a.category""")
def _(spark, d):
    found = _classified(spark, d).select("id", F.col("predicted").alias("consensus"), F.lit(0).alias("run"))
    return qu.accuracy(t.articles(spark, d).join(found, "id"), t.EVALUATION_YEAR).withColumn("accuracy", r6("accuracy"))


_COS = "coalesce(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 0), 0)"


@query("edge_similarity", "TX19 J8 F16", f"""
SELECT e.src, e.dst, round({_COS}, 4) AS similarity FROM vector_edges e LEFT JOIN vectors a ON e.src = a.id LEFT JOIN vectors b ON e.dst = b.id""")
def _(spark, d):
    out = em.edge_similarity(t.vector_edges(spark, d), t.vectors(spark, d))
    return out.select("src", "dst", F.round(F.col("similarity").cast("double"), 4).alias("similarity"))


_PAIRS = f"""p AS MATERIALIZED (SELECT a.category AS ca, b.category AS cb, {_COS} AS c FROM {{v}} a JOIN {{v}} b ON a.id < b.id),
s AS MATERIALIZED (SELECT category_a, category_b, avg(c) AS similarity, count(*) AS n FROM (SELECT ca AS category_a, cb AS category_b, c FROM p
  UNION ALL SELECT cb, ca, c FROM p) GROUP BY ALL)"""
_SAMPLE = """v AS MATERIALIZED (SELECT id, category, embedding FROM (SELECT *, row_number() OVER (PARTITION BY category
  ORDER BY ((id % 2147483647) * 1103515245 + 1 * 12345) % 2147483647, id) AS rk FROM vectors) WHERE rk <= 50)"""


@query("category_similarity", "CM19 U4 F16 A6", f"WITH {_PAIRS.format(v='vectors')} SELECT category_a, category_b, round(similarity, 6) AS similarity FROM s")
def _(spark, d):
    return em.category_similarity(t.vectors(spark, d)).select("category_a", "category_b", r6("similarity").alias("similarity"))


@query("category_similarity_sampled", "CM19 S6", f"WITH {_SAMPLE}, {_PAIRS.format(v='v')} SELECT category_a, category_b, round(similarity, 6) AS similarity FROM s")
def _(spark, d):
    return em.category_similarity(t.vectors(spark, d), sample=50).select("category_a", "category_b", r6("similarity").alias("similarity"))


@query("category_difference", "CM20 A12", f"""WITH {_PAIRS.format(v='vectors')},
o AS (SELECT avg(c) AS own FROM p WHERE ca = cb),
u AS (SELECT category_a, category_b, similarity, CASE WHEN category_a = category_b THEN n / 2 ELSE n END AS n FROM s)
SELECT category_a, category_b, round((similarity * n - 2 * own) / nullif(n - 1, 0), 6) AS difference FROM u, o""")
def _(spark, d):
    return em.category_difference(em.category_similarity(t.vectors(spark, d))).withColumn("difference", r6("difference"))


_DIRECTED = f"""p AS MATERIALIZED (SELECT a.category AS category_a, b.category AS category_b, {_COS} AS c FROM vectors a JOIN vectors b ON a.id < b.id),
s AS (SELECT category_a, category_b, avg(c) AS similarity, count(*) AS n FROM p GROUP BY ALL)"""


@query("category_similarity_directed", "CM19 U4", f"WITH {_DIRECTED} SELECT category_a, category_b, round(similarity, 6) AS similarity, n AS pairs FROM s")
def _(spark, d):
    return em.directed_category_similarity(t.vectors(spark, d), 100).withColumn("similarity", r6("similarity"))


@query("category_difference_directed", "CM20", f"""WITH {_DIRECTED}, o AS (SELECT avg(c) AS own FROM p WHERE category_a = category_b)
SELECT category_a, category_b, round((similarity * n - 2 * own) / nullif(n - 1, 0), 6) AS difference FROM s, o""")
def _(spark, d):
    found = em.directed_category_similarity(t.vectors(spark, d))
    return em.directed_category_difference(found).withColumn("difference", r6("difference"))


@query("category_mean_difference", "CM20", f"""WITH {_PAIRS.format(v='vectors')}
SELECT o.category_a AS category, round((x.m - o.similarity) / x.k, 6) AS mean_difference FROM s o JOIN
 (SELECT category_a, avg(similarity) AS m, count(*) AS k FROM s WHERE category_a <> category_b GROUP BY category_a) x USING (category_a)
WHERE o.category_a = o.category_b""")
def _(spark, d):
    return em.category_mean_difference(em.category_similarity(t.vectors(spark, d))).withColumn("mean_difference", r6("mean_difference"))


@query("category_deviation", "CM20", f"""WITH {_PAIRS.format(v='vectors')}
SELECT s.category_a, s.category_b, round(s.similarity - x.m, 6) AS deviation FROM s JOIN (SELECT category_a, avg(similarity) AS m FROM s GROUP BY category_a) x USING (category_a)""")
def _(spark, d):
    return em.category_deviation(em.category_similarity(t.vectors(spark, d))).withColumn("deviation", r6("deviation"))


@query("mean_pooled_vectors", "TX18 F15 F13", """
SELECT category, pos::INT AS pos, round(avg(x), 6) AS value FROM (SELECT category, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM vectors) GROUP BY ALL""")
def _(spark, d):
    pooled = em.mean_pool(t.vectors(spark, d), "category")
    return pooled.select("category", F.posexplode("embedding").alias("pos", "value")).withColumn("value", r6("value"))


@query("mean_of_vector_and_reverse", "F15", """
SELECT id, pos::INT AS pos, round((a + b) / 2, 6) AS value FROM (SELECT id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS a,
  unnest(list_reverse(embedding))::DOUBLE AS b FROM vectors)""")
def _(spark, d):
    from quillgraph.functions.vectors import mean_of_arrays

    both = F.array(F.col("embedding"), F.reverse("embedding"))
    return t.vectors(spark, d).select("id", F.posexplode(mean_of_arrays(both)).alias("pos", "value")).withColumn("value", r6("value"))
