"""Scores of clusterings: edges inside and between clusters, agreement with categories, shared ancestors.

`assigned` frames hold (run, id, cluster); a null cluster is kept as its own group where the measure
says so. All edge-based measures start from the cluster flow table, which is built once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.ranking import number_rows
from quillgraph.operators.terms import group_rows
from quillgraph.session import cut


def cluster_flow(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """run, a, b, edges: number of edges from cluster a to cluster b (null clusters kept).

    `assigned` has a row per node and run, more than its plan's estimated size tells, so it is merged and never sent to all tasks.
    """
    a = assigned.select(F.col("id").alias("src"), "run", F.col("cluster").alias("a")).hint("merge")
    b = assigned.select(F.col("id").alias("dst"), "run", F.col("cluster").alias("b")).hint("merge")
    return edges.select("src", "dst").join(a, "src").join(b, ["dst", "run"]).groupBy("run", "a", "b").agg(F.count("*").alias("edges"))


def _per_cluster(flow: DataFrame) -> DataFrame:
    """run, cluster, inside, out (edges leaving or inside), into; null cluster dropped."""
    ends = flow.select("run", F.explode(F.array(
        F.struct(F.col("a").alias("cluster"), F.when(F.col("a") == F.col("b"), F.col("edges")).otherwise(0).alias("inside"),
                 F.col("edges").alias("out"), F.lit(0).cast("long").alias("into")),
        F.struct(F.col("b").alias("cluster"), F.lit(0).cast("long").alias("inside"), F.lit(0).cast("long").alias("out"),
                 F.col("edges").alias("into")))).alias("e")).select("run", "e.*").filter("cluster IS NOT NULL")
    return ends.groupBy("run", "cluster").agg(
        F.sum("inside").alias("inside"), F.sum("out").alias("out"), F.sum("into").alias("into"))


def _totals(flow: DataFrame) -> DataFrame:
    return flow.groupBy("run").agg(F.sum("edges").alias("m"))


def modularity(flow: DataFrame, directed: bool = True) -> DataFrame:
    """run, cluster, modularity."""
    rows = _per_cluster(flow).join(_totals(flow), "run")
    m = F.col("m").cast("double")
    if directed:
        value = F.col("inside") / m - F.col("out") * F.col("into") / (m * m)
    else:
        volume = (F.col("out") + F.col("into")) / (2 * m)
        value = F.col("inside") / m - volume * volume
    return rows.select("run", "cluster", value.alias("modularity"))


def conductance(flow: DataFrame, variant: str = "outgoing") -> DataFrame:
    """run, cluster, conductance: share of outgoing edges that leave. The "least" variant divides by the
    smaller of inside and outside and keeps only clusters that have both."""
    rows = _per_cluster(flow).withColumn("leaving", F.col("out") - F.col("inside"))
    if variant == "least":
        # edges to a null cluster do not compare as different, so they do not count here
        known = _per_cluster(flow.filter("b IS NOT NULL")).withColumn("leaving", F.col("out") - F.col("inside"))
        kept = known.filter("inside > 0 AND leaving > 0")
        return kept.select("run", "cluster", (F.col("leaving") / F.least("inside", "leaving")).alias("conductance"))
    return rows.select("run", "cluster", F.coalesce(
        F.try_divide(F.col("leaving").cast("double"), F.col("out")), F.lit(0.0)).alias("conductance"))


def coverage(flow: DataFrame) -> DataFrame:
    """run, cluster, coverage: inner edges / all edges; clusters without inner edges are absent."""
    inner = flow.filter("a = b").select("run", F.col("a").alias("cluster"), "edges")
    return inner.join(_totals(flow), "run").select("run", "cluster", (F.col("edges") / F.col("m")).alias("coverage"))


def citation_density(flow: DataFrame) -> DataFrame:
    """run, density: all inner edges / all edges."""
    return flow.groupBy("run").agg(
        (F.sum(F.when(F.col("a") == F.col("b"), F.col("edges")).otherwise(0)) / F.sum("edges")).alias("density"))


def cluster_density(flow: DataFrame, assigned: DataFrame) -> DataFrame:
    """run, cluster, density: inner edges / possible ordered pairs; null for one-member clusters."""
    sizes = cluster_sizes(assigned).filter("cluster IS NOT NULL")
    inner = flow.filter("a = b").select("run", F.col("a").alias("cluster"), "edges")
    return sizes.join(inner, ["run", "cluster"], "left").select("run", "cluster", F.try_divide(
        F.coalesce("edges", F.lit(0)).cast("double"), F.col("size") * (F.col("size") - 1)).alias("density"))


def inter_cluster_ratio(flow: DataFrame) -> DataFrame:
    """run, cluster, ratio: edges leaving / edges inside; null without inner edges."""
    return _per_cluster(flow).select("run", "cluster", F.try_divide(
        (F.col("out") - F.col("inside")).cast("double"), F.col("inside")).alias("ratio"))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """run, cluster, size; the null cluster is a group."""
    return assigned.groupBy("run", "cluster").agg(F.count("*").alias("size"))


def community_size_distribution(assigned: DataFrame, k: int = 100) -> DataFrame:
    """run, size, clusters for the k least sizes of each run."""
    from quillgraph.operators.ranking import top_per_group

    sizes = cluster_sizes(assigned).groupBy("run", "size").agg(F.count("cluster").alias("clusters"))
    return top_per_group(sizes, ["run"], [F.col("size")], k).drop("rank")


def accuracy(labelled: DataFrame, year: int) -> DataFrame:
    """run, category, total, correct, accuracy over the rows of the evaluation year."""
    right = F.when(F.col("category") == F.col("consensus"), 1).otherwise(0)
    return labelled.filter(F.col("year") == year).groupBy("run", "category").agg(
        F.count("*").alias("total"), F.sum(right).alias("correct")).withColumn("accuracy", F.col("correct") / F.col("total"))


def overall_accuracy(per_category: DataFrame) -> DataFrame:
    """run, accuracy: sum of correct / sum of total."""
    return per_category.groupBy("run").agg((F.sum("correct") / F.sum("total")).alias("accuracy"))


def confusion_counts(labelled: DataFrame, year: int) -> DataFrame:
    """run, truth, predicted (nullable), count."""
    return labelled.filter(F.col("year") == year).groupBy(
        "run", F.col("category").alias("truth"), F.col("consensus").alias("predicted")).agg(F.count("*").alias("count"))


def confusion_matrix(counts: DataFrame, k: int = 40) -> DataFrame:
    """truth, predicted (0..k; k holds out-of-range and null), share of the row to 2 digits, colour."""
    def bucket(c: str):
        return F.when(F.col(c).between(0, k - 1), F.col(c)).otherwise(k)

    cells = counts.groupBy(bucket("truth").alias("truth"), bucket("predicted").alias("predicted")).agg(F.sum("count").alias("n"))
    rows = cells.groupBy("truth").agg(F.sum("n").alias("row"))
    share = F.bround(F.col("n") / F.col("row"), 2)
    hit = (F.col("truth") == F.col("predicted")) & (F.col("truth") < k)
    return cells.join(rows, "truth").select("truth", "predicted", share.alias("share")).withColumn(
        "colour", F.when(hit, 0.5 + 0.5 * F.col("share")).otherwise(0.5 - 0.5 * F.col("share")))


def confusion_matrix_wide(matrix: DataFrame, k: int = 40) -> DataFrame:
    """One row per truth bucket, columns p0..pk; absent cells are 0."""
    wide = matrix.groupBy("truth").pivot("predicted", list(range(k + 1))).agg(F.first("share"))
    return wide.select("truth", *[F.coalesce(F.col(f"`{i}`"), F.lit(0.0)).alias(f"p{i}") for i in range(k + 1)])


# ---------------------------------------------------------------- shared ancestors

#: Members of a part whose pairs are counted one by one; a part that uneven ids fill beyond FULL is counted by bits.
PART, FULL = 64, 256


def ordered_pair_counts(rows: DataFrame, group: Sequence[str], id_col: str = "id", label: str = "cluster", keep: Sequence[str] | None = None) -> DataFrame:
    """keep..., a, b, pairs: number of id pairs x < y of a group with x labelled a and y labelled b, added up over groups that agree in `keep`
    (by default all of `group`).

    A group of at most PART rows is one part. The ids of a larger one are cut into ranges, about PART rows to a part. Pairs inside a part are
    counted inside its row and added up before the shuffle. Two ids of different parts differ first at one bit of the part's number (from the top): there x has 0 and y
    has 1 and all higher bits agree. So for every bit, counts per (group, higher bits, bit, label) are multiplied, and no pair is formed. Rows with
    a null in `group` or a null id are in no pair.
    """
    keep = list(group if keep is None else keep)
    kept = rows.select(*group, F.col(id_col).alias("__id"), F.col(label).alias("__l")).dropna(subset=[*group, "__id"])
    kept = cut(kept)
    sizes = cut(kept.groupBy(*group).agg(F.count("*").alias("__n"), F.min("__id").alias("__least"), F.max("__id").alias("__most")).filter("__n > 1"))
    small = kept.join(sizes.filter(F.col("__n") <= PART).select(*group).hint("merge"), list(group))
    found = _pairs_of_parts(small, group, keep)
    wide = sizes.filter(F.col("__n") > PART)
    if not wide.isEmpty():
        bits = F.ceil(F.log2(F.col("__most") - F.col("__least") + 1.0)).cast("int")
        wide = wide.select(*group, "__least", bits.alias("__bits"), F.least(bits, F.ceil(F.log2(F.col("__n") / PART)).cast("int")).alias("__up"))
        large = cut(kept.join(wide, list(group)).select(
            *group, "__l", F.expr("__id - __least").alias("__id"), "__up", F.expr("__bits - __up").alias("__down"),
            F.expr("shiftright(__id - __least, __bits - __up)").alias("__part")))
        labels = cut(large.groupBy(*group, "__part", "__up", "__l").agg(F.count("*").alias("__n")))
        full = cut(labels.groupBy(*group, "__part").agg(F.sum("__n").alias("__n")).filter(F.col("__n") > FULL).select(*group, "__part"))
        parts = [*group, "__part"]
        across = _pairs_by_bits(labels.withColumnsRenamed({"__part": "__at", "__up": "__width"}), group, keep)
        inside = _pairs_of_parts(large.join(full, parts, "left_anti"), parts, keep)
        rest = large.join(full, parts, "left_semi").select(*parts, F.col("__id").alias("__at"), F.col("__down").alias("__width"), "__l", F.lit(1).alias("__n"))
        found = found.unionByName(across).unionByName(inside).unionByName(_pairs_by_bits(rest, parts, keep))
    return found.groupBy(*keep, "a", "b").agg(F.sum("pairs").alias("pairs"))


def _pairs_of_parts(rows: DataFrame, part: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep..., a, b, pairs inside parts of at most FULL rows."""
    lists = rows.groupBy(*part).agg(F.collect_list(F.struct(F.col("__id").alias("id"), F.col("__l").alias("l"))).alias("__rows"))
    pairs = F.flatten(F.transform("__rows", lambda y: F.transform(
        F.filter("__rows", lambda x: x["id"] < y["id"]), lambda x: F.struct(x["l"].alias("a"), y["l"].alias("b")))))
    each = lists.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.a", "p.b")
    return each.groupBy(*keep, "a", "b").agg(F.count("*").alias("pairs"))


def _pairs_by_bits(rows: DataFrame, part: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep..., a, b, pairs of __n rows each at different places `__at` below 2^`__width`."""
    at = rows.filter("__width > 0").withColumn("__bit", F.explode(F.expr("sequence(0, __width - 1)")))
    counted = cut(at.groupBy(
        *part, "__bit", F.expr("shiftright(__at, __bit + 1)").alias("__high"), F.expr("shiftright(__at, __bit) & 1").alias("__one"), "__l"
    ).agg(F.sum("__n").alias("__n")))
    key = [*part, "__bit", "__high"]
    low = counted.filter("__one = 0").select(*key, F.col("__l").alias("a"), F.col("__n").alias("na"))
    high = counted.filter("__one = 1").select(*key, F.col("__l").alias("b"), F.col("__n").alias("nb"))
    return low.join(high, key).groupBy(*keep, "a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"))


def shared_ancestors(edges: DataFrame, assigned: DataFrame, supernodes: int | None = None) -> DataFrame:
    """run, a, b, shared: mean number of commonly cited articles over citing pairs x < y, x in a and y in b.

    Numerator: ordered pairs per cited article, summed. Denominator: all ordered pairs of citing
    articles, so pairs that share nothing count. With `supernodes` cited articles stand for buckets of
    that many citing articles of one cluster.
    """
    run_edges = edges.select("src", "dst").join(
        assigned.select(F.col("id").alias("src"), "run", "cluster").hint("merge"), "src")
    if supernodes:
        buckets = supernode_map(edges, assigned, supernodes)
        near = buckets.select("run", F.col("id").alias("dst"), F.struct("cluster", "bucket").alias("parent")).hint("merge")
        linked = run_edges.join(near, ["run", "dst"])
    else:
        linked = run_edges.withColumn("parent", F.col("dst"))
    cited = linked.select("run", "parent", F.col("src").alias("id"), "cluster").distinct()
    citing = run_edges.select("run", F.col("src").alias("id"), "cluster").distinct()
    common = ordered_pair_counts(cited, ["run", "parent"], keep=["run"]).withColumnRenamed("pairs", "common")
    pairs = ordered_pair_counts(citing, ["run"])
    key = pairs["run"].eqNullSafe(common["run"]) & pairs["a"].eqNullSafe(common["a"]) & pairs["b"].eqNullSafe(common["b"])
    return pairs.join(common, key, "left").select(
        pairs["run"], pairs["a"], pairs["b"], (F.coalesce("common", F.lit(0)) / F.col("pairs")).alias("shared"))


def nss(shared: DataFrame) -> DataFrame:
    """run, cluster, nss = own mean / (greatest mean with another cluster + 1)."""
    own = shared.filter("a = b").select("run", F.col("a").alias("cluster"), "shared")
    other = shared.filter("a <> b").groupBy("run", F.col("a").alias("cluster")).agg(F.max("shared").alias("most"))
    return own.join(other, ["run", "cluster"]).select("run", "cluster", (F.col("shared") / (F.col("most") + 1)).alias("nss"))


def supernode_map(edges: DataFrame, assigned: DataFrame, size: int = 10) -> DataFrame:
    """run, cluster, id, bucket = row number in the cluster / size, over citing articles."""
    citing = edges.select(F.col("src").alias("id")).distinct()
    members = assigned.select("run", "cluster", "id").join(citing, "id", "left_semi")
    keyed = members.withColumn("__order", F.col("id"))
    return number_rows(keyed, "__order", ["run", "cluster"], "rn").select(
        "run", "cluster", "id", (F.col("rn") / size).cast("int").alias("bucket"))


PAIRS_PER_RUN, PAIRS_PER_PART = 1 << 20, 1 << 22


def _pair_packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batch function over part, child, ancestor: part and its pairs in order, compressed as an Arrow stream, in runs of about PAIRS_PER_RUN rows."""

    def packed(run: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(run).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("part", "ascending"), ("child", "ascending")])).combine_chunks()
        part = rows["part"].to_numpy()
        start = np.flatnonzero(np.diff(part, prepend=-1))
        pairs, streams = rows.select(["child", "ancestor"]), []
        for begin, end in zip(start, [*start[1:], len(part)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pairs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pairs.slice(begin, end - begin))
            streams.append(sink.getvalue().to_pybytes())
        return pa.record_batch([pa.array(part[start], pa.int32()), pa.array(streams, pa.binary())], names=["part", "pairs"])

    run, size = [], 0
    for batch in batches:
        if batch.num_rows:
            run.append(batch)
            size += batch.num_rows
        if size >= PAIRS_PER_RUN:
            yield packed(run)
            run, size = [], 0
    if run:
        yield packed(run)


def _pair_sorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batch function over a whole part: its different pairs."""
    found = [pa.ipc.open_stream(x.as_buffer()).read_all() for b in batches for x in b.column("pairs")]
    if found:
        child, ancestor = pa.concat_tables(found).combine_chunks().itercolumns()
        child, ancestor = child.combine_chunks(), ancestor.combine_chunks()
        first, _ = group_rows([child, ancestor], len(child))
        for a in range(0, len(first), PAIRS_PER_RUN):
            some = pa.array(first[a:a + PAIRS_PER_RUN])
            yield pa.record_batch([child.take(some), ancestor.take(some)], names=["child", "ancestor"])


def k_hop_ancestors(edges: DataFrame, hops: int) -> DataFrame:
    """child, ancestor: distinct articles reached by exactly `hops` citations.

    The pairs of a hop move in compressed runs by a digest of the pair, in as many parts as PAIRS_PER_PART asks for, so a child of any number of ancestors is spread;
    parts drop equal pairs.
    """
    step = cut(edges.select(F.col("src").alias("via"), F.col("dst").alias("next")).distinct())
    found = step.select(F.col("via").alias("child"), F.col("next").alias("ancestor"))
    kind = dict(step.dtypes)
    for _ in range(1, hops):
        ways = step.groupBy("via").agg(F.count("*").alias("n")).join(found.groupBy(F.col("ancestor").alias("via")).agg(F.count("*").alias("c")), "via")
        pairs = ways.agg(F.coalesce(F.sum(F.col("n") * F.col("c")), F.lit(0))).first()[0]
        parts = max(step.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS_PER_PART))
        met = found.join(step, found["ancestor"] == step["via"]).select("child", F.col("next").alias("ancestor"))
        dealt = met.select(F.pmod(F.xxhash64("child", "ancestor"), F.lit(parts)).cast("int").alias("part"), "child", "ancestor")
        found = dealt.mapInArrow(_pair_packer, "part int, pairs binary").repartitionById(parts, "part").mapInArrow(_pair_sorter, f"child {kind['via']}, ancestor {kind['next']}")
        found = cut(found) if hops > 2 else found
    return found


# ---------------------------------------------------------------- category and year homogeneity

def category_homogeneity_mean(assigned: DataFrame) -> DataFrame:
    """run, homogeneity: mean over (cluster, category) of count / greatest count of the cluster."""
    counts = assigned.groupBy("run", "cluster", "category").agg(F.count("*").alias("n"))
    most = counts.groupBy("run", "cluster").agg(F.max("n").alias("most"))
    return counts.join(most, ["run", "cluster"]).groupBy("run").agg(F.avg(F.col("n") / F.col("most")).alias("homogeneity"))


def category_homogeneity(assigned: DataFrame) -> DataFrame:
    """run, cluster, homogeneity: share of the most common category."""
    counts = assigned.filter("cluster IS NOT NULL").groupBy("run", "cluster", "category").agg(F.count("*").alias("n"))
    return counts.groupBy("run", "cluster").agg((F.max("n") / F.sum("n")).alias("homogeneity"))


def temporal_cohesion(assigned: DataFrame) -> DataFrame:
    """run, cohesion: mean of the clusters' sample standard deviation of the year."""
    return assigned.groupBy("run", "cluster").agg(F.stddev_samp("year").alias("s")).groupBy("run").agg(F.avg("s").alias("cohesion"))


# ---------------------------------------------------------------- summaries over runs

def summarise_runs(sizes: DataFrame, metric: DataFrame, value: str) -> DataFrame:
    """mean, spread (4 digits) over runs of the size-weighted mean of a metric.

    Clusters are matched null-safely. A cluster without a value drops out above but its size
    stays below the line.
    """
    m = metric.select(F.col("run").alias("__run"), F.col("cluster").alias("__cluster"), F.col(value).alias("__v"))
    joined = sizes.join(m, sizes["run"].eqNullSafe(m["__run"]) & sizes["cluster"].eqNullSafe(m["__cluster"]), "left")
    per_run = joined.groupBy("run").agg((F.coalesce(F.sum(F.col("size") * F.col("__v")), F.lit(0.0)) / F.sum("size")).alias("v"))
    return per_run.agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("spread"))


def summarise_timings(timings: DataFrame, stages: Sequence[str]) -> DataFrame:
    """measure, mean, spread (2 digits) of each stage, the majority step (seconds -> ms) and their row
    sum; a missing community count counts as 40; all-zero measures are dropped."""
    if "communityCount" not in timings.columns:
        timings = timings.withColumn("communityCount", F.lit(40))
    parts = [*stages, "majority_ms"]
    wide = timings.withColumn("majority_ms", F.col("time_s") * 1000)
    wide = wide.withColumn("total_ms", sum((F.col(c) for c in parts[1:]), F.col(parts[0])))
    names = [*parts, "total_ms", "communityCount"]
    long = wide.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "measure", "value")
    out = long.groupBy("measure").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"))
    return out.filter("mean <> 0 OR spread <> 0").select("measure", F.round("mean", 2).alias("mean"), F.round("spread", 2).alias("spread"))


def needs_log_scale(df: DataFrame, value: str) -> DataFrame:
    """One row: is the greatest value more than 100 times the median?"""
    from quillgraph.operators.ranking import exact_quantile_rows

    top = df.agg(F.max(value)).scalar()
    return exact_quantile_rows(df, value, 0.5).select(
        F.col(value).alias("median"), top.alias("top"), (top > 100 * F.col(value)).alias("log_scale"))
