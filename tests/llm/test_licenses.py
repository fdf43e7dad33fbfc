"""License scan against a plain version with all pairs of detections, on hand-made and awkward rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import license_scan as ls
from quillgraph.llm.license_rules import BASE, RULES, WEIGHT
from tests.llm import brute

TEXTS = {
    "Licensed under the GNU General Public License, version 3 or later.": "gpl,gpl-3.0",
    "This work is CC BY-NC-SA 4.0.": "cc-by,cc-by-nc-sa-4.0", "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "under the MIT License. And MIT License": "mit", "GPLv3 code": "gpl-3.0", "the gpl": "gpl", "mit der licence": "",
    "Apache License, Version 2.0 and apache license": "apache,apache-2.0", "Licenced under the BSD-3-Clause license": "bsd-3-clause", "2-clause BSD": "bsd-2-clause",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "GNU\tGENERAL public license": "gpl", "gnu general public license gnu general public license": "gpl", "cc": "", "ccby": "", "CC BYé": "", "All rights reserved": "all-rights-reserved",
    "see http://www.gnu.org/licenses/gpl-3.0.html": "gpl-3.0", "released into the public domain": "public-domain", "Creative Commons Attribution-ShareAlike 3.0 Unported": "cc-by-sa-3.0",
}


COMPILED = [(k, r.level, r.label, re.compile(f"(?:{r.regex}) ")) for k, r in enumerate(RULES)]


def plain(text):
    words = re.findall(brute.TOKEN, brute.lower(text))
    base, found = [], []
    for i in range(len(words)):
        ahead = " ".join(words[i:i + 32]) + " "
        base += [(i, label) for phrase, label in BASE.items() if ahead.startswith(phrase + " ")]
        for k, level, label, regex in COMPILED:
            if (m := regex.match(ahead)):
                found.append((i, i + m[0].count(" "), level, k, label))
    inside = lambda a, b: a is not b and b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2] and (a[:2] != b[:2] or b[2:4] < a[2:4])
    kept = [a for a in found if not any(inside(a, b) for b in found)]
    starts = [i for i, _ in base]
    join = lambda x: ",".join(sorted(set(x)))
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), join(b[1] for b in base), join([b[1] for b in base] + [k[4] for k in kept]),
            max((WEIGHT[k[2]] for k in kept), default=0.0))


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


@pytest.mark.parametrize("text", TEXTS)
def test_labels(text):
    assert plain(text)[5] == TEXTS[text]


def test_scan(spark, awkward):
    rows, df = awkward
    long = " ".join(["word", *TEXTS, "cc", "by"] * 15)
    more = [(500 + k, t) for k, t in enumerate([*TEXTS, " ".join(TEXTS), long, long])] + [(None, "cc by")]
    df = df.select("doc_id", "text", F.lit(1).alias("row"), F.lit("x").alias("hits")).unionByName(
        spark.createDataFrame([(*m, 1, "x") for m in more], "doc_id bigint, text string, row int, hits string"))
    got = ls.summary(ls.scan(df)).collect()
    want = [(i, *plain(t)) for i, t in [r[:2] for r in rows] + more]
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in got) == Counter(want)


def test_detections(spark):
    df = spark.createDataFrame([(1, "x under the Apache License, Version 2.0 y MIT License")], "doc_id bigint, text string")
    got = {(r.start, r.stop, r.label) for r in ls.detections(ls.scan(df)).filter("kept and level > 0").collect()}
    assert got == {(1, 8, "apache-2.0"), (9, 11, "mit")}


def test_rules():
    assert len(RULES) > 300
    for r in RULES:
        assert re.fullmatch("[a-z0-9]+", r.key) and " " in f"{r.regex} " and not re.match(r.regex, "")


def test_native_and_empty(spark, nothing):
    scanned = ls.scan(nothing)
    assert scanned.count() == 0 and ls.summary(scanned).count() == 0
    plan = ls.summary(scanned)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
