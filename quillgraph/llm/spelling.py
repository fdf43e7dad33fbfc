"""Groups spelling variants: words that differ by one inserted, deleted or replaced code point.

Asymmetric q-chunks: the shorter word of a pair is cut into two disjoint chunks, the longer one gives positional grams. One edit leaves one of
the chunks whole, and it stands in the other word at its own place (first chunk) or shifted by the difference of the
lengths, which is none or one (second chunk). So grams out of a chunk's reach are not emitted, rows are joined on (length of the
shorter word, chunk number, chunk), and each candidate is verified by its edit distance. Of two words of one length
the lesser gives the chunks.

A chunk that too many words share (more than `most` candidates) isn't joined. Its words differ by one edit in the rest behind or
before the chunk, so these rests are cut in the same way and the key grows by a chunk of the rest, until few words share it or the rest is
one code point; then all that share it are near words. Nothing is capped, and no bucket holds a multiple of its links in candidates.

Words, not occurrences, are joined: occurrences are counted with partial sums before the shuffle, so a word that is a third of the text is
one row per task.

Defined cases: null and empty texts have no words; a null id counts as empty text in the typo draw. Repeated rows count each. Runs of letters are never
cut, whatever their length. Columns of the input other than id and text are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All but A-Z, a-z and U+00C0 to U+00FF, as a union of ranges: Java matches the negated class about ten times as slowly.
NO_LETTER = r"[\x00-\x40\x5B-\x60\x7B-\xBF\x{100}-\x{10FFFF}]+"
LETTERS = 5
TIMES = 3
TYPO = 97
MOST = 20_000
RATIO = 2


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LETTERS, times: int = TIMES, typo: int | None = TYPO) -> DataFrame:
    """word, n: words of at least `letters` code points that occur at least `times` times.

    With `typo`, a run whose crc32 together with its id is divisible by it loses one code point.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.split(F.col(text), NO_LETTER)).alias("w"))
    runs = runs.filter(F.length("w") >= letters).select("id", F.translate("w", UPPER, LOWER).alias("w"))
    word = F.col("w")
    if typo:
        h = F.crc32(F.concat("id", F.lit(":"), "w").cast("binary"))
        at = (h % F.length("w")).cast("int")
        word = F.when(h % typo == 0, F.concat(F.substring("w", F.lit(1), at), F.substr("w", at + 2))).otherwise(F.col("w"))
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= letters) & (F.col("n") >= times))


def _halves(rest: Column, size: Column, short: Column) -> Column:
    """Two entries of (side, chunk, rest): the first half of a word of `short` code points and the second, as `rest` of `size` code points shows them."""
    half = F.floor(short / 2).cast("int")
    tail = (short - half).cast("int")
    left, right = F.substring(rest, F.lit(1), half), F.substr(rest, size - tail + 1)
    return F.array(
        F.struct(F.lit(0).alias("side"), left.alias("chunk"), F.substr(rest, half + 1).alias("rest"), F.lit(None).cast("string").alias("other")),
        F.struct(F.lit(1).alias("side"), right.alias("chunk"), F.substring(rest, F.lit(1), size - tail).alias("rest"), left.alias("other")))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row twice, with a half of its rest added to its key.

    `short` is the length of the rest on the chunk side; `others` are the first chunks of those rows that went on by the second: where both are
    whole, the first one finds the pair, and only that one.
    """
    each = rows.withColumn("h", F.explode(_halves(F.col("rest"), F.length("rest"), F.col("short"))))
    return each.select(
        "word", "n", "grams", F.concat_ws("\t", "key", F.col("h.side").cast("string"), "h.chunk").alias("key"), F.col("h.rest").alias("rest"),
        (F.col("short") - F.length("h.chunk")).cast("int").alias("short"),
        F.when(F.col("h.side") == 1, F.array_append("others", F.col("h.other"))).otherwise(F.array_append("others", F.lit(None).cast("string"))).alias("others"))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """a, na, b, nb: every pair of near words once; `words` has word (unique) and n."""
    size = F.length("word")
    roles = F.array(F.struct(F.lit(False).alias("grams"), size.alias("short")), F.struct(F.lit(True).alias("grams"), size.alias("short")),
                    F.struct(F.lit(True).alias("grams"), (size - 1).alias("short")))
    start = words.select("word", "n", F.explode(roles).alias("r")).select(
        "word", "n", "r.grams", F.col("r.short").cast("string").alias("key"), F.col("word").alias("rest"), F.col("r.short").cast("int").alias("short"),
        F.array().cast("array<string>").alias("others"))
    rows, found = store(_cut(start), "chunks"), None
    while True:
        load = rows.groupBy("key").agg(F.count_if(~F.col("grams")).alias("c"), F.count_if(F.col("grams")).alias("g"), F.max("short").alias("short"))
        hot = store(load.filter((F.col("c") * F.col("g") > most) & (F.col("short") > 1)).select("key"), "hot")
        some = not hot.isEmpty()
        cold = rows.join(hot, "key", "left_anti") if some else rows
        pairs = store(_meet(cold), "near")
        found = pairs if found is None else found.unionByName(pairs)
        if not some:
            return found
        rows = store(_cut(rows.join(hot, "key", "left_semi")), "chunks")


def _meet(rows: DataFrame) -> DataFrame:
    chunks = rows.filter(~F.col("grams")).select("key", F.col("word").alias("a"), F.col("n").alias("na"), F.col("others").alias("oa"))
    grams = rows.filter("grams").select("key", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("others").alias("ob"))
    seen = F.exists(F.zip_with("oa", "ob", lambda x, y: x == y), lambda same: same)
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    return chunks.join(grams, "key").filter(once & (F.levenshtein("a", "b", 1) == 1) & ~F.coalesce(seen, F.lit(False))).select("a", "na", "b", "nb")


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest n (then the first in code-point order) if that is `ratio` times the word's own n."""
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))).alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("near").alias("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    chosen = -F.col("best.less") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"),
                         F.when(chosen, -F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a form: counts at least double along forms, so chains end; each round doubles the steps taken."""
    up = store(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "up")
    while True:
        after = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = store(up.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "up")
        up = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return up


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LETTERS, times: int = TIMES, typo: int | None = TYPO,
                   ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word."""
    words = store(vocabulary(docs, doc_id, text, letters, times, typo), "words")
    formed = store(forms(words, near_words(words, most), ratio), "forms")
    return formed.join(roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))
