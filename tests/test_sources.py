"""Readers on files of the real formats."""

from quillgraph.operators.terms import cooccurrence, detect_language, language_profiles, trigrams
from quillgraph.operators.upsert import merge_rows
from quillgraph.sources import files as fi


def test_titles_with_escaped_quotes(spark, tmp_path):
    (tmp_path / "titles.tsv").write_text(
        '90244097\tpatterns of trips\tThe article "revisits" distance.\n7\tsay \\"hi\\" now\tNystr\\"om \\ and "plain" \\n\n8\tno abstract\n', encoding="utf-8")
    got = {r["paper_id"]: (r["title"], r["abstract"]) for r in fi.read_titles_tsv(spark, str(tmp_path)).collect()}
    assert got == {90244097: ("patterns of trips", 'The article "revisits" distance.'), 7: ('say "hi" now', 'Nystr"om \\ and "plain" \\n'), 8: ("no abstract", None)}


def test_blank_lines_keep_their_number(spark, tmp_path):
    (tmp_path / "years.csv").write_text("2001\n2002\n\n2004\nx\n2006\n")
    assert {r["id"]: r["year"] for r in fi.read_positional(spark, str(tmp_path), "year").collect()} == {0: 2001, 1: 2002, 2: None, 3: 2004, 4: None, 5: 2006}


def test_overwrite_ties_take_the_greatest_value(spark):
    rows = spark.createDataFrame([(1, 5, 2), (1, 9, 2), (1, 7, 1), (2, None, 9), (2, 3, 1)], "id int, v int, o int")
    assert {r["id"]: r["v"] for r in merge_rows(rows, ["id"], {"v": "overwrite"}, "o").collect()} == {1: 9, 2: 3}


def test_window_of_one_has_no_pairs(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"])], "id int, tokens array<string>")
    assert cooccurrence(rows, window=1, min_weight=1).count() == 0
    assert {(r["first"], r["second"], r["weight"]) for r in cooccurrence(rows, window=2, min_weight=1).collect()} == {("b", "a", 2)}


def test_short_and_null_texts_have_no_language(spark):
    docs = spark.createDataFrame([(1, "en", "the thing that"), (4, "fr", "le chat de la"), (2, None, "thing"), (3, None, None), (5, None, "ab"), (6, None, "")],
                                 "id bigint, language string, text string")
    grams = trigrams(docs)
    got = {r["id"]: r["detected"] for r in detect_language(docs, grams, language_profiles(grams)).collect()}
    assert got == {1: "en", 4: "fr", 2: "en", 3: None, 5: None, 6: None}


def test_read_table_spreads_a_table_of_many_splits(spark, tmp_path):
    spark.range(200).repartition(12).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
        splits = spark.read.parquet(str(tmp_path / "t")).rdd.getNumPartitions()
        rows = fi.read_table(spark, str(tmp_path / "t"), "id bigint", 2, "id")
        assert splits > 2 and rows.rdd.getNumPartitions() == splits and rows.distinct().count() == 200
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert fi.read_table(spark, str(tmp_path / "t"), "id bigint", 500).rdd.getNumPartitions() == 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
