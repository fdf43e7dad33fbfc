"""Reading and writing the file formats, upserts and deletes; the files are written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import upsert as up
from quillgraph.plans.registry import query
from quillgraph.session import scratch_path
from quillgraph.sources import files as fi
from quillgraph.sources import tables as t


@query("edges_from_csv", "IO1 IO13", "SELECT src, dst FROM cites")
def _(spark, d):
    path = scratch_path(spark, "edges")
    t.cites(spark, d).select("src", "dst").write.csv(path)
    return fi.read_edges(spark, path)


@query("nodes_from_count", "IO2 PF13", "SELECT unnest(range((SELECT count(*) FROM articles) + 1)) AS id")
def _(spark, d):
    path = scratch_path(spark, "count")
    fi.write_scalar(t.articles(spark, d).agg(F.count("*")), path)
    return fi.read_nodes(spark, path, inclusive=True)


@query("years_from_positions", "IO3 F3", """
SELECT row_number() OVER (ORDER BY id) - 1 AS id, CASE WHEN id % 10 <> 3 THEN year END AS year FROM articles""")
def _(spark, d):
    path = scratch_path(spark, "years")  # some lines are blank
    line = F.when(F.col("id") % 10 == 3, "").otherwise(F.col("year").cast("string"))
    t.articles(spark, d).select("id", line.alias("value")).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)
    return fi.read_positional(spark, path, "year")


@query("paper_ids_from_header_csv", "IO4", 'SELECT id AS "node idx", id * 10 + year AS "paper id" FROM articles')
def _(spark, d):
    path = scratch_path(spark, "papers")
    t.articles(spark, d).select(F.col("id").alias("node idx"), (F.col("id") * 10 + F.col("year")).alias("paper id")).write.option(
        "header", True).csv(path)
    return fi.read_csv_header(spark, path, "`node idx` bigint, `paper id` bigint")


@query("titles_from_tsv", "IO5", r"""
SELECT id AS paper_id, language || ' "' || category || '"' AS title,
  replace(regexp_replace(text, '[\t\r\n]', ' ', 'g'), '\"', '"') AS abstract FROM docs""")
def _(spark, d):
    path = scratch_path(spark, "titles")
    title = F.concat("language", F.lit(' "'), "category", F.lit('"'))
    fi.write_titles_tsv(t.docs(spark, d).select(F.col("id").alias("paper_id"), title.alias("title"), F.col("text").alias("abstract")), path)
    return fi.read_titles_tsv(spark, path)


@query("table_with_schema", "IO6 IO7 IO15", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    rows = fi.read_table(spark, f"{d}/lineitem.parquet", "l_partkey bigint, l_suppkey bigint", 8, "l_partkey")
    return fi.write_table(rows.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")), scratch_path(spark, "pairs"))


@query("accuracy_to_text_file", "IO14", "SELECT round(avg(CASE WHEN category = consensus THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM clusters WHERE year = 2000")
def _(spark, d):
    path = scratch_path(spark, "accuracy")
    rows = t.clusters(spark, d).filter(F.col("year") == t.EVALUATION_YEAR)
    fi.write_scalar(rows.agg(F.round(F.avg(F.coalesce((F.col("category") == F.col("consensus")).cast("double"), F.lit(0.0))), 6)), path)
    return spark.read.schema("accuracy double").csv(path)


@query("exported_edge_list", "IO13", "SELECT src, dst, weight FROM cites")
def _(spark, d):
    path = scratch_path(spark, "export")
    fi.export_edges(t.cites(spark, d), path)
    return fi.read_csv_header(spark, path, "src bigint, dst bigint, weight bigint")


@query("upserted_topics", "IO8 IO11", """
WITH old AS (SELECT topic AS id, sum(weight) AS weight, count(*) AS members FROM has_topic GROUP BY topic),
new AS (SELECT topic + 1 AS id, max(weight) AS weight FROM has_topic GROUP BY topic)
SELECT id, coalesce(new.weight, old.weight) AS weight, members FROM old FULL JOIN new USING (id)""")
def _(spark, d):
    topics = t.has_topic(spark, d).withColumnRenamed("id", "article").withColumnRenamed("topic", "id")
    old = topics.groupBy("id").agg(F.sum("weight").alias("weight"), F.count("*").alias("members"))
    new = topics.groupBy((F.col("id") + 1).alias("id")).agg(F.max("weight").alias("weight"))
    return up.upsert_nodes(old, new, "id")


@query("upserted_links", "IO9 J7", """
WITH old AS (SELECT src, dst, weight FROM cites),
new AS (SELECT dst AS src, src AS dst, weight * 10 AS weight FROM cites),
ok AS (SELECT n.* FROM new n SEMI JOIN (SELECT id FROM articles WHERE known_category IS NOT NULL) a ON n.src = a.id
  SEMI JOIN (SELECT id FROM articles) b ON n.dst = b.id)
SELECT src, dst, coalesce(ok.weight, old.weight) AS weight FROM old FULL JOIN ok USING (src, dst)""")
def _(spark, d):
    c, a = t.cites(spark, d), t.articles(spark, d)
    new = c.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * 10).alias("weight"))
    return up.upsert_edges(c, new, a.filter("known_category IS NOT NULL"), a)


@query("in_degree_as_property", "IO10", """
SELECT a.id, a.year, a.category, x.n AS in_degree FROM articles a LEFT JOIN (SELECT dst, count(*) AS n FROM cites WHERE weight > 1 GROUP BY dst) x ON x.dst = a.id""")
def _(spark, d):
    counts = t.cites(spark, d).filter("weight > 1").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return up.set_property(t.articles(spark, d).select("id", "year", "category"), counts, ["id"])


@query("merge_rules", "IO11 U1", """
SELECT l_partkey AS id, l_suppkey AS topic, sum(l_quantity) AS total, max(l_extendedprice) AS top,
  max(struct_pack(o := l_orderkey * 10 + l_linenumber, v := l_tax)).v AS latest
FROM lineitem GROUP BY ALL""")
def _(spark, d):
    rows = t.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("topic"), F.col("l_quantity").alias("total"),
        F.col("l_extendedprice").alias("top"), F.col("l_tax").alias("latest"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return up.merge_rows(rows, ["id", "topic"], {"total": "sum", "top": "max", "latest": "overwrite"}, "ord")


@query("citations_after_delete", "IO12 PF5", """
WITH doomed AS (SELECT id FROM articles WHERE known_category IS NULL)
SELECT src, dst FROM cites c ANTI JOIN doomed a ON c.src = a.id ANTI JOIN doomed b ON c.dst = b.id""")
def _(spark, d):
    a = t.articles(spark, d)
    doomed = a.join(up.delete_where(a, "known_category IS NULL").select("id"), "id", "left_anti")
    return up.detach_delete(a, t.cites(spark, d).select("src", "dst"), doomed)[1]
