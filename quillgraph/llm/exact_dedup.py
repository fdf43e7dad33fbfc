"""Exact dedup by two passes over digests with a Bloom filter between them.

Pass 1 sets bits for the 64-bit head of each row's digest and remembers which bits were set more than once. Pass 2
tests each row: a row with a bit set only once is unique and passes straight through; only rows that may be
repeated are shuffled, and exact digests decide there.

The filter is split into segments of 2^16 bits; a row sets all its bits in one segment, so segments are merged
independently. There are 16 bits a row up to MAX_BITS in all (256 MB, the bound of what is collected and broadcast);
beyond that the filter grows fuller and more unique rows are shuffled, but results stay exact.

Hot groups: bits are merged from per-task bitmaps, groups are aggregated before the shuffle, and the way back to the
rows goes through `join_hot`, so a group holding a third of all rows is never in one task.

Defined cases: a null text is empty, and all empty texts are equal. Null ids sort last when the staying row is chosen.
Rows equal in id and text are indistinguishable: `decide` gives each of them the same answer, and `survivors`
keeps one. Extra columns pass through `survivors` under any name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bloom import tested
from quillgraph.llm.common import free_name, join_hot, store

SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """Text without the characters 0x20 and 0x09-0x0D; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def head(digest: Column) -> Column:
    """First 63 bits of a hex digest as a number."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, text_sha256, keep_id, group_size, kept."""
    plain = normalised(F.col(text))
    keys = store(docs.select(
        F.col(doc_id).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_chars"),
        F.sha2(plain.cast("binary"), 256).alias("text_sha256")).withColumn("head", head(F.col("text_sha256"))), "digests")
    flagged = store(tested(keys, "head", "maybe", least=2), "tested")
    alone = flagged.filter(~F.col("maybe")).select(
        "doc_id", "n_chars", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    rest = flagged.filter("maybe").select("doc_id", "n_chars", "text_sha256")
    order = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    groups = store(rest.groupBy("text_sha256").agg(F.min(order).alias("best"), F.count("*").alias("group_size")).select(
        "text_sha256", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("most"), "group_size"), "groups")
    known = join_hot(rest, groups, "text_sha256", "group_size").select(
        "doc_id", "n_chars", "text_sha256", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most"))).alias("kept"))
    return alone.unionByName(known)


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Only ids of dropped rows, and the rows whose id and text occur twice among the staying ones, are moved.
    """
    sha, key = free_name(docs, "text_sha256"), free_name(docs, "row_id")
    decided = store(decide(docs, doc_id, text), "decided")
    tied = store(decided.filter("kept and group_size > 1").groupBy("doc_id", "n_chars", "text_sha256").count().filter("count > 1"), "tied")
    row = lambda i, s: F.xxhash64(i, s, F.coalesce(i.isNull(), F.lit(False)))
    digest = F.sha2(normalised(F.col(text)).cast("binary"), 256)
    chars = F.length(F.coalesce(F.col(text), F.lit(""))).cast("string")
    marked = docs.withColumn(sha, F.concat_ws("-", digest, chars)).withColumn(key, row(F.col(doc_id), F.col(sha)))
    name = lambda df: row(F.col("doc_id"), F.concat_ws("-", F.col("text_sha256"), F.col("n_chars").cast("string"))).alias(key)
    out = marked.join(decided.filter("not kept").select(name(decided)).distinct(), key, "left_anti")
    if tied.isEmpty():
        return out.select(*docs.columns)
    twins = F.broadcast(tied.select(name(tied)).distinct()) if tied.count() <= 10_000 else tied.select(name(tied)).distinct()
    one = out.join(twins, key, "left_semi").dropDuplicates([key])
    return out.join(twins, key, "left_anti").unionByName(one).select(*docs.columns)
