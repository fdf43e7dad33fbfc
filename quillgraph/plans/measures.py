"""Nearest neighbours, geometry of clusterings and their agreement, personalised rank, scaled scores, neighbour sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import agreement as ag
from quillgraph.operators import cohesion as co
from quillgraph.operators import neighbours as ne
from quillgraph.operators import overlap as ov
from quillgraph.operators import personal as pe
from quillgraph.operators.graph import REVERSE, degrees
from quillgraph.plans.explore import citation_graph, r6
from quillgraph.plans.registry import query
from quillgraph.session import cut
from quillgraph.sources import tables as t

DIM = 64


def knn_sql(k: int, rounds: int, bands: int = ne.BANDS, bits: int = ne.BITS, most: int = ne.MOST, seed: int = 0, wide: int = ne.WIDE) -> str:
    """The same bands and blocks, with every pair of a block compared."""
    normals = ne.planes(bands, bits, DIM, seed).tolist()
    values = ", ".join(f"({i // bits}, {i % bits}, {p})" for i, p in enumerate(normals))
    rank = f"""SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS rank FROM (
 SELECT id, neighbour, max(similarity) AS similarity FROM (%s) GROUP BY id, neighbour) QUALIFY rank <= {k * wide}"""
    steps = [f"planes(band, bit, p) AS (VALUES {values})",
             "norms AS (SELECT id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM vectors)",
             "u AS MATERIALIZED (SELECT * FROM norms WHERE norm > 0)",
             f"""codes AS (SELECT id, band, CAST(sum(CASE WHEN round(list_dot_product(x, p::DOUBLE[]) / norm, 9) >= 0 THEN 1 << CAST({bits - 1} - bit AS INT) ELSE 0 END) AS BIGINT) AS code
  FROM u CROSS JOIN planes GROUP BY id, band)""",
             f"first AS (SELECT least({bits}, greatest(0, CAST(ceil(log2(count(*) / {most / 2})) AS INT))) AS b FROM u)",
             f"keyed AS (SELECT id, band, code, code >> ({bits} - b) AS key FROM codes CROSS JOIN first)",
             "counted AS (SELECT *, count(*) OVER (PARTITION BY band, key) AS c1, count(*) OVER (PARTITION BY band, code) AS c2 FROM keyed)",
             f"""blocks AS MATERIALIZED (SELECT id, band, c1 > {most} AS deep, CASE WHEN c1 > {most} THEN code ELSE key END AS key,
  CASE WHEN c1 > {most} AND c2 > {most} THEN id % CAST(ceil(c2 / {most}) AS BIGINT) ELSE 0 END AS chunk FROM counted)""",
             """pairs0 AS (SELECT DISTINCT a.id, b.id AS neighbour FROM blocks a JOIN blocks b ON a.band = b.band AND a.deep = b.deep AND a.key = b.key AND a.chunk = b.chunk
  AND a.id <> b.id)"""]
    similar = "SELECT p.id, p.neighbour, round(list_dot_product(a.x, b.x) / (a.norm * b.norm), 9) AS similarity FROM pairs{i} p JOIN u a ON a.id = p.id JOIN u b ON b.id = p.neighbour"
    steps.append(f"near0 AS MATERIALIZED ({rank % similar.format(i=0)})")
    for i in range(1, rounds + 1):
        steps.append(f"members{i} AS (SELECT id AS block, neighbour AS id FROM near{i - 1} UNION SELECT id, id FROM near{i - 1})")
        steps.append(f"pairs{i} AS (SELECT DISTINCT a.id, b.id AS neighbour FROM members{i} a JOIN members{i} b ON a.block = b.block AND a.id <> b.id)")
        steps.append(f"near{i} AS MATERIALIZED ({rank % (similar.format(i=i) + f' UNION ALL SELECT id, neighbour, similarity FROM near{i - 1}')})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT id, neighbour, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM near{rounds} WHERE rank <= {k}"


@query("knn_graph", "2.13g", knn_sql(10, 2))
def _(spark, d):
    return ne.knn_graph(t.vectors(spark, d), 10).select("id", "neighbour", r6("similarity").alias("similarity"), "rank")


@query("knn_graph_bands_only", "2.13g", knn_sql(5, 0, bands=4, most=32, seed=3))
def _(spark, d):
    return ne.knn_graph(t.vectors(spark, d), 5, bands=4, most=32, rounds=0, seed=3).select("id", "neighbour", r6("similarity").alias("similarity"), "rank")


@query("knn_recall", "2.13g", knn_sql(10, 2).rsplit("\n", 1)[0] + """,
truth AS (SELECT a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.x, b.x) / (a.norm * b.norm), 9) DESC, b.id) AS rank
  FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 10 = 0 QUALIFY rank <= 10)
SELECT count(*) AS links, round(count(n.neighbour) / count(*), 6) AS recall FROM truth t LEFT JOIN near2 n ON t.id = n.id AND t.neighbour = n.neighbour AND n.rank <= 10""")
def _(spark, d):
    vectors = t.vectors(spark, d)
    truth = ne.all_pairs(vectors, vectors.filter("id % 10 = 0"), 10).select("id", "neighbour")
    found = ne.knn_graph(vectors, 10).select("id", "neighbour", F.lit(1).alias("hit"))
    return truth.join(found, ["id", "neighbour"], "left").agg(F.count("*").alias("links"), r6(F.count("hit") / F.count("*")).alias("recall"))


# ---------------------------------------------------------------- geometry

_ROWS = "WITH r AS MATERIALIZED (SELECT id, category AS cluster, embedding::DOUBLE[] AS x FROM vectors WHERE category IS NOT NULL)"
_SILHOUETTE = _ROWS + """,
means AS (SELECT a.id, a.cluster, b.cluster AS other, sum(power(list_distance(a.x, b.x), 2)) AS s, count(*) AS n FROM r a JOIN r b ON a.id <> b.id GROUP BY ALL),
ab AS (SELECT id, cluster, max(CASE WHEN cluster = other THEN s / n END) AS a, min(CASE WHEN cluster <> other THEN s / n END) AS b FROM means GROUP BY id, cluster),
each AS (SELECT id, cluster, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)
"""
_CENTRES = _ROWS + """,
cells AS (SELECT id, cluster, unnest(x) AS v, unnest(range(len(x))) AS pos FROM r),
centre AS (SELECT cluster, list(v ORDER BY pos) AS c FROM (SELECT cluster, pos, avg(v) AS v FROM cells GROUP BY cluster, pos) GROUP BY cluster),
gap AS (SELECT r.id, r.cluster, list_distance(r.x, c.c) AS d FROM r JOIN centre c USING (cluster)),
spread AS (SELECT cluster, count(*) AS n, avg(d) AS mean_distance, sqrt(avg(d * d)) AS rms_distance, max(d) AS max_distance FROM gap GROUP BY cluster)
"""


def labelled(spark, d):
    vectors = t.vectors(spark, d)
    return co.placed(vectors, vectors.select("id", F.col("category").alias("cluster")))


@query("silhouette_per_row", "2.13a", _SILHOUETTE + "SELECT id, cluster, round(silhouette, 6) AS silhouette FROM each")
def _(spark, d):
    return co.silhouette_rows(labelled(spark, d)).select("id", "cluster", r6("silhouette").alias("silhouette"))


@query("silhouette", "2.13a", _SILHOUETTE + "SELECT count(*) AS rows, round(avg(silhouette), 6) AS silhouette FROM each")
def _(spark, d):
    return co.silhouette(labelled(spark, d)).select("rows", r6("silhouette").alias("silhouette"))


def _davies_bouldin_sql(spread: str) -> str:
    return _CENTRES + f"""SELECT count(*) AS clusters, round(avg(worst), 6) AS davies_bouldin FROM (
SELECT a.cluster, max((s.{spread} + z.{spread}) / list_distance(a.c, b.c)) AS worst FROM centre a JOIN centre b ON a.cluster <> b.cluster
JOIN spread s ON s.cluster = a.cluster JOIN spread z ON z.cluster = b.cluster GROUP BY a.cluster)"""


@query("davies_bouldin", "2.13b", _davies_bouldin_sql("mean_distance"))
def _(spark, d):
    return co.davies_bouldin(labelled(spark, d)).select("clusters", r6("davies_bouldin").alias("davies_bouldin"))


@query("davies_bouldin_root_mean_square", "2.13b", _davies_bouldin_sql("rms_distance"))
def _(spark, d):
    return co.davies_bouldin(labelled(spark, d), root_mean_square=True).select("clusters", r6("davies_bouldin").alias("davies_bouldin"))


@query("calinski_harabasz", "2.13c", _CENTRES.rstrip() + """,
middle AS (SELECT list(v ORDER BY pos) AS m FROM (SELECT pos, avg(v) AS v FROM cells GROUP BY pos))
SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS rows, round((sum(n * power(list_distance(c.c, m.m), 2)) / (count(*) - 1)) / (sum(n * rms_distance * rms_distance) / (sum(n) - count(*))), 6)
 AS calinski_harabasz FROM centre c JOIN spread USING (cluster) CROSS JOIN middle m""")
def _(spark, d):
    return co.calinski_harabasz(labelled(spark, d)).select("clusters", "rows", r6("calinski_harabasz").alias("calinski_harabasz"))


@query("mean_centroid_distance", "2.13k", _CENTRES + """SELECT cluster, n, round(mean_distance, 6) AS mean_distance, round(rms_distance, 6) AS rms_distance,
 round(max_distance, 6) AS max_distance FROM spread""")
def _(spark, d):
    return co.mean_centroid_distance(labelled(spark, d)).select("cluster", "n", *[r6(c).alias(c) for c in ("mean_distance", "rms_distance", "max_distance")])


# ---------------------------------------------------------------- agreement

def _agreement_sql(column: str, null_is_cluster: bool) -> str:
    rows = f"SELECT run, id, {column} AS cluster FROM clusters" + ("" if null_is_cluster else f" WHERE {column} IS NOT NULL")
    return f"""
WITH r AS MATERIALIZED ({rows}),
cell AS MATERIALIZED (SELECT a.run AS run_a, b.run AS run_b, a.cluster AS a, b.cluster AS b, count(*) AS n FROM r a JOIN r b ON a.id = b.id AND a.run < b.run GROUP BY ALL),
ma AS (SELECT run_a, run_b, a, sum(n) AS n FROM cell GROUP BY ALL), mb AS (SELECT run_a, run_b, b, sum(n) AS n FROM cell GROUP BY ALL),
sums AS (SELECT run_a, run_b, sum(n) AS rows, sum(n * (n - 1) / 2.0) AS cp, sum(n * ln(n)) AS hab FROM cell GROUP BY ALL),
x AS (SELECT run_a, run_b, sum(n * (n - 1) / 2.0) AS pa, sum(n * ln(n)) AS ha FROM ma GROUP BY ALL),
y AS (SELECT run_a, run_b, sum(n * (n - 1) / 2.0) AS pb, sum(n * ln(n)) AS hb FROM mb GROUP BY ALL),
h AS (SELECT run_a, run_b, rows, cp, pa, pb, rows * (rows - 1) / 2.0 AS p, ln(rows) - ha / rows AS ha, ln(rows) - hb / rows AS hb, ln(rows) - hab / rows AS hab
  FROM sums JOIN x USING (run_a, run_b) JOIN y USING (run_a, run_b))
SELECT run_a, run_b, CAST(rows AS BIGINT) AS rows, round((p + 2 * cp - pa - pb) / p, 6) AS rand, round((cp - pa * pb / p) / ((pa + pb) / 2 - pa * pb / p), 6) AS adjusted_rand,
  round(cp / (pa + pb - cp), 6) AS pair_jaccard, round(ha + hb - hab, 6) AS mutual_information, round((ha + hb - hab) / ((ha + hb) / 2), 6) AS normalised_mutual_information,
  round((ha + hb - hab) / ha, 6) AS homogeneity, round((ha + hb - hab) / hb, 6) AS completeness FROM h"""


def _agreed(table):
    found = ag.agreement(table)
    return found.select("run_a", "run_b", "rows", *[r6(c).alias(c) for c in found.columns[3:]])


@query("agreement_of_runs", "2.13d 2.13e", _agreement_sql("cluster", False))
def _(spark, d):
    return _agreed(ag.contingency(t.clusters(spark, d).select("run", "id", "cluster")))


@query("agreement_of_consensus_with_nulls", "2.13d 2.13e", _agreement_sql("consensus", True))
def _(spark, d):
    return _agreed(ag.contingency(t.clusters(spark, d).select("run", "id", F.col("consensus").alias("cluster")), null_is_cluster=True))


# ---------------------------------------------------------------- personalised rank, scaled scores

def _push_sql(rounds: int, tolerance: float, seeds: str, weight: str) -> str:
    steps = [f"e AS MATERIALIZED (SELECT src, dst, {weight} / sum({weight}) OVER (PARTITION BY src) AS share FROM cites)",
             """s AS MATERIALIZED (SELECT src, dst, share FROM e UNION ALL SELECT id, NULL, 1.0 FROM articles WHERE id NOT IN (SELECT src FROM e))""",
             f"t0 AS MATERIALIZED (SELECT seed, seed AS id, 0.0::DOUBLE AS score, 1.0::DOUBLE AS waiting FROM ({seeds}))"]
    for i in range(1, rounds + 1):
        steps.append(f"""t{i} AS MATERIALIZED (SELECT seed, id, sum(score) AS score, sum(waiting) AS waiting FROM (
  SELECT seed, id, CASE WHEN waiting > {tolerance} THEN score + (1 - 0.85::DOUBLE) * waiting ELSE score END AS score, CASE WHEN waiting > {tolerance} THEN 0 ELSE waiting END AS waiting FROM t{i - 1}
  UNION ALL SELECT t.seed, coalesce(s.dst, t.seed), 0, 0.85::DOUBLE * t.waiting * s.share FROM t{i - 1} t JOIN s ON s.src = t.id WHERE t.waiting > {tolerance}) GROUP BY seed, id)""")
    return "WITH " + ",\n".join(steps)


_TEN_SEEDS = "SELECT id AS seed FROM articles WHERE id % 200 = 1"


def _ten_seeds(spark, d):
    return t.articles(spark, d).filter("id % 200 = 1").select(F.col("id").alias("seed"))


@query("personalised_rank", "2.13i", _push_sql(8, 1e-4, _TEN_SEEDS, "1.0::DOUBLE") + "\nSELECT seed, id, round(score, 6) AS score FROM t8 WHERE score > 0")
def _(spark, d):
    found = pe.personalised_rank(citation_graph(spark, d), _ten_seeds(spark, d), tolerance=1e-4, rounds=8)
    return found.select("seed", "id", r6("score").alias("score"))


@query("personalised_rank_mass", "2.13i", _push_sql(8, 1e-3, _TEN_SEEDS, "weight") + """
SELECT seed, count(*) AS touched, round(sum(score) + sum(waiting), 6) AS mass, round(sum(waiting), 6) AS waiting FROM t8 GROUP BY seed""")
def _(spark, d):
    found = pe.push(citation_graph(spark, d, "weight"), _ten_seeds(spark, d), tolerance=1e-3, rounds=8)
    return found.groupBy("seed").agg(F.count("*").alias("touched"), r6(F.sum("score") + F.sum("waiting")).alias("mass"), r6(F.sum("waiting")).alias("waiting"))


_IN_DEGREE = "WITH s AS (SELECT a.id, a.category, count(c.src)::DOUBLE AS x FROM articles a LEFT JOIN cites c ON c.dst = a.id GROUP BY a.id, a.category)"


def _in_degrees(spark, d):
    found = degrees(citation_graph(spark, d), REVERSE).select("id", F.col("degree").cast("double").alias("score"))
    return found.join(t.articles(spark, d).select("id", "category"), "id")


@query("scaled_scores", "2.13j", _IN_DEGREE + """
SELECT id, round(coalesce((x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0), 0), 6) AS min_max, round(coalesce(x / nullif(max(abs(x)) OVER (), 0), 0), 6) AS "max",
  round(coalesce((x - avg(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0), 0), 6) AS mean, round(ln(x + 1), 6) AS log,
  round(coalesce((x - avg(x) OVER ()) / nullif(stddev_pop(x) OVER (), 0), 0), 6) AS standard, round(coalesce(x / nullif(sum(abs(x)) OVER (), 0), 0), 6) AS l1,
  round(coalesce(x / nullif(sqrt(sum(x * x) OVER ()), 0), 0), 6) AS l2, round(x - avg(x) OVER (), 6) AS center FROM s""")
def _(spark, d):
    scores = cut(_in_degrees(spark, d)).select("id", *[F.col("score").alias(how) for how in pe.SCALERS])
    for how in pe.SCALERS:
        scores = pe.scale(scores, how, how, offset=1.0)
    return scores.select("id", *[r6(how).alias(how) for how in pe.SCALERS])


@query("scores_scaled_per_category", "2.13j", _IN_DEGREE + """
SELECT id, category, round(coalesce(x / nullif(sum(abs(x)) OVER (PARTITION BY category), 0), 0), 6) AS score FROM s""")
def _(spark, d):
    return pe.scale(cut(_in_degrees(spark, d)), "l1", within=("category",)).select("id", "category", r6("score").alias("score"))


# ---------------------------------------------------------------- neighbour sets

_SETS = {
    "ancestors": "SELECT DISTINCT src AS owner, dst AS element FROM cites",
    "children": "SELECT DISTINCT dst AS owner, src AS element FROM cites",
    "ancestors_of_children": "SELECT DISTINCT a.dst AS owner, b.dst AS element FROM cites a JOIN cites b ON a.src = b.src AND a.dst <> b.dst",
    "categories": "SELECT DISTINCT CAST(a.category AS BIGINT) AS owner, c.dst AS element FROM cites c JOIN articles a ON a.id = c.src",
}


def _jaccard_sql(kind: str, threshold: float) -> str:
    return f"""
WITH s AS MATERIALIZED ({_SETS[kind]}),
whole AS (SELECT owner, count(*) AS size, list(element ORDER BY element) AS elements FROM s GROUP BY owner),
reps AS MATERIALIZED (SELECT min(owner) AS owner, any_value(size) AS size FROM whole GROUP BY elements),
m AS MATERIALIZED (SELECT s.owner, s.element, r.size FROM s JOIN reps r USING (owner)),
c AS (SELECT a.owner AS a, b.owner AS b, a.size AS size_a, b.size AS size_b, count(*) AS common FROM m a JOIN m b ON a.element = b.element AND a.owner < b.owner GROUP BY ALL)
SELECT a, b, common, round(common / (size_a + size_b - common), 6) AS jaccard FROM c WHERE common >= {threshold} * (size_a + size_b - common)"""


def _register_jaccard(name: str, kind: str, threshold: float) -> None:
    @query(name, "2.13f", _jaccard_sql(kind, threshold))
    def _(spark, d):
        found = ov.similar_sets(getattr(ov, kind)(t.cites(spark, d)), threshold)
        return found.select("a", "b", "common", r6("jaccard").alias("jaccard"))


_register_jaccard("similar_ancestors", "ancestors", 0.5)
_register_jaccard("similar_ancestors_loosely", "ancestors", 0.15)
_register_jaccard("similar_children_loosely", "children", 0.15)
_register_jaccard("similar_ancestors_of_children", "ancestors_of_children", 0.2)


@query("similar_ancestors_of_categories", "2.13f", _jaccard_sql("categories", 0.3))
def _(spark, d):
    ends = t.cites(spark, d).join(t.articles(spark, d).select(F.col("id").alias("src"), "category"), "src")
    found = ov.similar_sets(ends.select(F.col("category").cast("bigint").alias("owner"), F.col("dst").alias("element")).distinct(), 0.3)
    return found.select("a", "b", "common", r6("jaccard").alias("jaccard"))


@query("equal_ancestors", "2.13f", f"""
WITH s AS ({_SETS["ancestors"]}), whole AS (SELECT owner, count(*) AS size, list(element ORDER BY element) AS elements FROM s GROUP BY owner)
SELECT owner, min(owner) OVER (PARTITION BY elements) AS rep, size, count(*) OVER (PARTITION BY elements) AS copies FROM whole""")
def _(spark, d):
    return ov.classes(ov.ancestors(t.cites(spark, d))).select("owner", "rep", "size", "copies")
