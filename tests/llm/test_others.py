"""Language identification, chats, pages, archives, SQL counterparts and the pipeline."""

import hashlib
import html
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import chat_format, html_extract, language_id, queries, warc
from quillgraph.llm.common import remainder, table
from tests.llm import brute
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.SQL[name])
    got, columns = rows_of(df.columns, df.collect())
    want, wanted = rows_of([c[0] for c in res.description], res.fetchall())
    assert columns == wanted and got == want


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op10_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(spark, awkward, nothing):
    rows, df = awkward
    model = language_id.fit(df)
    got = language_id.predict(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        none = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == none and (r.score == 0 if none else r.lang_pred in ("en", "fr"))
    assert len({(r.text, r.lang_pred, r.score) for r in got}) == len({r.text for r in got})
    kept = language_id.accepted(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.lang_pred != "und" for r in got)
    assert language_id.fit(nothing) is None and language_id.accepted(nothing, None).count() == 0
    assert {r.lang_pred for r in language_id.predict(df, None).collect()} == {"und"}


CHATS = [(1, 1, "assistant", "b<|end|>"), (1, 0, "user", "a\\<[INST]"), (1, 2, "assistant", ""), (1, 3, "assistant", "[/INST]</s><"), (2, None, None, None), (2, 0, "user", None),
         (2, 0, "assistant", "x\ny"), (2, 0, "assistant", "x\ny"), (None, 1, "assistant", "<|cont|>"), (None, 0, "ro<le", "é日"), (3, 0, "user", "\\"), (3, 1, "user", "\\\\<|start|>")]
CHATS += [(4, k, "user" if k % 3 else "assistant", f"turn {k} <" + "z" * (k * 37 % 9000)) for k in range(200)]


def test_chats_round_trip(spark):
    rows = spark.createDataFrame([(*r, "extra") for r in CHATS], "conv_id bigint, turn bigint, role string, text string, turns string")
    got = chat_format.format_chats(rows)
    read = got.select("conv_id", "formatted", "loss_spans", chat_format.read_back(F.col("formatted")).alias("t"),
                      chat_format.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(read) == 5
    for r in read:
        mine = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x in CHATS if c == r.conv_id))
        assert [tuple(x) for x in r.t] == [m[2:] for m in mine]
        assert r.loss == "".join(m[3] for m in mine if m[2] == "assistant")
        assert "".join(re.sub(r"(?s)\\(.?)", r"\1", r.formatted[s.start:s.end]) for s in r.loss_spans) == r.loss
        runs = sum(1 for a, b in zip([None, *mine], mine) if a is None or a[2] != b[2])
        assert r.formatted.count(chat_format.START) == runs == r.formatted.count(chat_format.END)
        for bad in ("</s>", "[INST]", "[/INST]"):
            assert bad not in r.formatted
    assert chat_format.format_chats(rows.limit(0)).count() == 0


def article(page):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)[^>]*>", inner)]
    return "\n".join(p for p in parts if p)


def test_articles_of_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = html_extract.extract(pages).join(pages, "page_id").select("text", "html", "n_chars").collect()
    assert got and all(r.text == article(r.html) and r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<nav><a href=x>Home</a></nav>", ""),
    ("""<html><body class="nav-open"><header><h1>Site</h1><a href=x>home</a></header><div id="content-sidebar"><main><article><header class="entry-header"><h1>Title &amp; more</h1>
    </header><p>First para is here,\n  with text.<p>Second &eacute;&#233; para<ul><li>One item<li>Two items</ul><aside>Related things. Read more about it here.</aside>
    <div class="cookie-notice">We use cookies on this site, please accept them all.</div><script>if (a < b) "</p>"</script><p>Last.</p></article>
    <section id="comments"><article class="comment"><p>I think that this is a long reader comment, and nice.</p></article></section></main></div>
    <form><p>Please sign up to our letter. It is free.</p></form><footer>(c) all</footer>""",
     "Title & more\nFirst para is here, with text.\nSecond éé para\nOne item\nTwo items\nLast."),
    ("""<div class=top><a href=1>Home</a> <a href=2>News</a></div><div class=c><h2>A headline here</h2><p>This is a long paragraph of text with several sentences.
    It goes on and on, and then stops.</p><p>Short one.</p><p>Another long paragraph of text that should be there, as it is the main text of the page.</p></div>
    <ul><li><a href=3>Terms</a><li><a href=4>Privacy</a></ul><div>&copy; 2020 Foo</div>""",
     "A headline here\nThis is a long paragraph of text with several sentences. It goes on and on, and then stops.\nShort one.\n"
     "Another long paragraph of text that should be there, as it is the main text of the page."),
    ("<article><p>Open <b>bold text.<p hidden>Secret words are here.</p><p>End &lt;tag&gt; x.", "Open bold text.\nEnd <tag> x."),
])
def test_pages_by_hand(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("start, end", [
    ("<form><article>", "</article></form>"), ("<form><div>", "</div></form>"), ("<div class='with-sidebar'>", "</div>"),
    ("<div id='has-comments'><div>", "</div></div>"), ("<div role=form><main>", "</main></div>")])
def test_wrappers_of_the_main_text(start, end):
    body = "This is a long paragraph of text with several sentences. It goes on and on, and then it stops after some more words."
    menu, small = "<nav><a href=1>Home</a><a href=2>About</a></nav>", "<aside><p>Sign up for our letter today.</p></aside>"
    page = f"<body>{menu}{start}<p>{body}</p><p>{body}</p>{end}{small}</body>"
    assert html_extract.main_text(page) == f"{body}\n{body}"
    talk = "<div class=comments>" + f"<p>{body}</p>" * 5 + "</div>"
    assert html_extract.main_text(f"<div><p>{body}</p><p>{body}</p></div>{talk}") == f"{body}\n{body}"
    assert html_extract.main_text(f"<article><div hidden><p>{body}</p><p>{body}</p></div><p>Seen text, that stays here.</p></article>") == "Seen text, that stays here."


def test_minimum_cut_against_all_labellings():
    import itertools
    import random

    rnd = random.Random(4)
    for _ in range(100):
        n = rnd.randint(1, 7)
        gains = [rnd.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rnd.randint(0, 6)) for a in range(n) for b in range(a) if rnd.random() < 0.5]
        cost = lambda side: (sum(g for g, s in zip(gains, side) if g > 0 and not s) + sum(-g for g, s in zip(gains, side) if g < 0 and s)
                             + sum(c for a, b, c in edges if side[a] != side[b]))
        assert cost(html_extract.min_cut(gains, edges)) == min(cost(s) for s in itertools.product((False, True), repeat=n))


def test_long_page_is_linear():
    import time

    began = time.time()
    text = html_extract.main_text("<nav><a href=x>m</a></nav><article>" + "<p>Some text of the page, with a stop.</p>" * 20_000 + "</article><p>x")
    assert text.count("\n") >= 19_999 and time.time() - began < 30


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extract.extract(pages).count() == 0 and warc.through_archives(pages).count() == 0


def test_archives(spark):
    page = "<p>\r\n\r\nWARC/1.1\r\n\r\nx é\x00</p>"
    rows = [(5, "http://a b/ü", page), (3, None, page), (1, "http://c", None), (2, "http://d", ""), (9, "http://e", "other"), (9, "http://e", "other"), (None, "u", page)]
    pages = spark.createDataFrame([(*r, "no") for r in rows], "page_id bigint, url string, html string, record_type string").repartition(3)
    got = warc.through_archives(pages).collect()
    digest = lambda h: warc.sha1_base32((h or "").encode())
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((h or "").encode()), digest(h)) for i, _, h in rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter([(5, "revisit", 3), (3, "response", None), (1, "response", None), (2, "revisit", 1), (9, "response", None), (9, "revisit", 9), (None, "revisit", 3)])
    assert len({r.record_id for r in got}) == len(rows)


def test_old_arc_lines():
    body = b"HTTP/1.0 200 OK\r\nX-Page-Id: 4\r\n\r\nhello"
    one = warc.arc_version_block("a.arc", 1, "19960101000000") + b"\n"
    one += b"http://x/a b 1.2.3.4 19970203040506 text/html %d\n" % len(body) + body + b"\n"
    two = warc.arc_version_block("b.arc", 2, "19960101000000") + b"\n"
    two += b"dns:x 1.2.3.4 1997 text/dns 200 - - 0 b.arc 5\nabc\nd\n"
    got = list(warc.read_arc(one + two))
    assert [(r.archive, r.url, r.date, r.block) for r in got] == [("filedesc://a.arc", "http://x/a b", "19970203040506", body), ("filedesc://b.arc", "dns:x", "1997", b"abc\nd")]
    (fields, block), = warc.read_warc_records(warc.warc_record(got[0], None) + b"\r\n\r\n")
    assert fields["warc-date"] == "1997-02-03T04:05:06Z" and fields["warc-type"] == "response" and block == body
    assert warc.iso_date("1997") == "1997-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.read_arc(one + b"broken line\n"))


def test_pipeline(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").collect()]
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    model = language_id.fit(table(spark, SF, "documents").filter(remainder("doc_id", 4) != 2))
    known = {r.doc_id for r in language_id.predict(table(spark, SF, "documents"), model).filter("lang_pred <> 'und'").collect()}
    rows = [r for r in docs if r[0] in known]
    rows = [r for r, d in zip(rows, brute.exact([x[:2] for x in rows])) if d[3]]
    rows = [r for r, n in zip(rows, brute.near([x[:2] for x in rows])) if r[0] == n[2]]
    rows = [r for r, c in zip(rows, brute.contaminated([x[:2] for x in rows], items)) if not c[5]]
    want = Counter()
    for r, m in zip(rows, brute.mixing([(x[0], x[1], x[3]) for x in rows])):
        want[r] += m[3]
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == table(spark, SF, "documents").columns
    assert Counter(tuple(r) for r in got.collect()) == +want


def test_stages_on_awkward_rows(spark, awkward):
    df = awkward[1]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        out.collect()


def test_registered_names():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")
