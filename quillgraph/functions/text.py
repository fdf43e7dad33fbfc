"""Text expressions: sentences, tokens, normalised words, stop words. All native, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The English stop words of Spark ML's StopWordsRemover.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd
he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot
could here's how's let's ought that's there's what's when's where's who's why's would
""".split()

SENTENCE = r"[^.!?\n]+[.!?]*"
WORD_OR_MARK = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
# The cleanup patterns of the topic job, applied one after the other.
CLEANUP = ("[^a-zA-Z.-]+", "^[^a-zA-Z]+", "[^a-zA-Z]+$")


def words(text: Column) -> Column:
    """Lower-case letter-only words split at white space; empty pieces dropped."""
    letters = F.lower(F.regexp_replace(text, r"[^\p{L}\s]+", ""))
    return F.filter(F.split(letters, r"\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def marks_and_words(text: Column) -> Column:
    """Words (inner hyphens and apostrophes kept) and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(WORD_OR_MARK), F.lit(0))


def normalize(tokens: Column, patterns: tuple[str, ...] = CLEANUP, lower: bool = True) -> Column:
    """Delete each pattern from every token, in order; drop tokens left empty."""
    def clean(w: Column) -> Column:
        for p in patterns:
            w = F.regexp_replace(w, p, "")
        return F.lower(w) if lower else w

    return F.filter(F.transform(tokens, clean), lambda w: w != "")


def is_stop_word(word: Column, stop_words: list[str] | None = None) -> Column:
    return word.isin(STOP_WORDS if stop_words is None else stop_words)


def remove_stop_words(tokens: Column, stop_words: list[str] | None = None) -> Column:
    return F.filter(tokens, lambda w: ~is_stop_word(w, stop_words))


def token_rows(docs: DataFrame) -> DataFrame:
    """id, sentence, pos, token (0-based positions)."""
    parts = docs.select("id", F.posexplode(sentences(F.col("text"))).alias("sentence", "s"))
    return parts.select("id", "sentence", F.posexplode(marks_and_words(F.col("s"))).alias("pos", "token"))
