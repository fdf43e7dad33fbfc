"""License detection by ordered signature rules, in DataFrame functions only.

The words of a text are compared with the keywords of all rules first; most texts stop there. At each place of a keyword the next
MAX_WORDS words are joined, and only the regular expressions that this keyword gates are tried on them, from that word on. Every match is a
detection: an interval of words with the level, order and label of its rule.

Overlaps: a detection is dropped if it lies inside another one of the same or a stronger level (of equal intervals the first rule's
stays). Sorted by start and falling end, everything that can contain a detection comes before it, so the furthest
end seen so far in each level decides; no pairs are formed.

The texts are read once and never move. What moves are rows of a few numbers: one per text, and one per detection.

Defined cases: a null text is empty; a text without words has no detections and score 0. Repeated rows give repeated results. Null ids
are kept. Extra columns are not returned by `scan`. A text of many detections is a partition of a window, which Spark sorts on disk if
need be. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import store
from quillgraph.llm.license_rules import BASE, MAX_WORDS, RULES, WEIGHT

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEVELS = sorted(WEIGHT)
BASE_LEVEL = 0


def rule_rows() -> list[tuple[int, int, str, str, str, float]]:
    """order, level, key, regex, label, weight of every rule; the regular expression takes the space after its last word, too."""
    base = [(BASE_LEVEL, phrase.split(" ")[0], f"^{phrase} ", label, 0.0) for phrase, label in BASE.items()]
    own = [(r.level, r.key, f"^(?:{r.regex}) ", r.label, WEIGHT[r.level]) for r in RULES]
    return [(k, *r) for k, r in enumerate(base + own)]


def _rule_array() -> Column:
    """The rules as one constant."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [f"named_struct('rule', {k}, 'level', {level}, 'key', {quote(key)}, 'regex', {quote(regex)}, 'label', {quote(label)}, 'weight', {weight}D)"
            for k, level, key, regex, label, weight in rule_rows()]
    return F.expr(f"array({', '.join(rows)})")


def words_of(text: Column) -> Column:
    """The text is split at its gaps, which is linear; regexp_extract_all copies the rest of the text for every match."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, row (a number of its own), n_words, hits (every match of a rule), as a stored table."""
    rules = _rule_array()
    keys = F.array(*[F.lit(k) for k in sorted({r[2] for r in rule_rows()})])
    worded = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    gated = worded.withColumn("found", F.array_intersect("words", keys))
    place = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(F.col("found"), w), i)), lambda i: i.isNotNull())
    placed = gated.withColumn("places", F.when(F.size("found") > 0, place).otherwise(F.array().cast("array<int>")))
    window = lambda i: F.struct(i.alias("at"), F.get("words", i).alias("key"),
                                F.concat(F.array_join(F.slice("words", i + 1, MAX_WORDS), " "), F.lit(" ")).alias("next"))

    def tried(p: Column) -> Column:
        fits = F.filter(rules, lambda r: (r["key"] == p["key"]) & F.rlike(p["next"], r["regex"]))
        return F.transform(fits, lambda r: F.struct(
            p["at"].alias("start"), (p["at"] + _spaces(F.call_function("regexp_extract", p["next"], r["regex"], F.lit(0)))).alias("stop"),
            r["rule"].alias("rule"), r["level"].alias("level"), r["label"].alias("label"), r["weight"].alias("weight")))

    hits = F.flatten(F.transform(F.transform("places", window), tried))
    return store(placed.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("bigint").alias("n_words"), hits.alias("hits")), "licenses")


def detections(scanned: DataFrame) -> DataFrame:
    """row, start, stop (word numbers from 0, stop is behind the last), rule, level, label, weight, kept; level 0 are base phrases, which always stay."""
    rows = scanned.filter(F.size("hits") > 0).select("row", F.inline("hits"))
    before = Window.partitionBy("row").orderBy("start", F.desc("stop"), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = {k: F.max(F.when((F.col("level") > BASE_LEVEL) & (F.col("level") <= k), F.col("stop"))).over(before) for k in LEVELS}
    furthest = F.lit(None).cast("int")
    for k in LEVELS:
        furthest = F.when(F.col("level") == k, reach[k]).otherwise(furthest)
    return rows.withColumn("furthest", furthest).withColumn("kept", F.coalesce(F.col("furthest") < F.col("stop"), F.lit(True))).drop("furthest")


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (of the surest detection), one row per scanned row."""
    base = F.col("level") == BASE_LEVEL
    names = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    found = detections(scanned).groupBy("row").agg(
        F.sum(base.cast("bigint")).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"), names(base).alias("base_labels"),
        names(base | F.col("kept")).alias("labels"), F.max(F.when(F.col("kept"), F.col("weight"))).alias("score"))
    return scanned.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
