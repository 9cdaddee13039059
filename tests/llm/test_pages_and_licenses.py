"""Operators 8 and 9: pages with known articles, texts with known licences."""

import re
import textwrap
from html import unescape

import duckdb
import pytest

from pyspark.sql import functions as F
from llm_samples import SF_CHECK
from sqlgauge.llm import html_main as HM
from sqlgauge.llm import license_scan as LS


LONG = "A sentence, with commas, and enough words to look like prose in a page. " * 3


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), (" \n ", ""), ("<html><body></body></html>", ""), ("plain  text\nonly", "plain text only"),
    ("a < b &amp; c &lt;d&gt; &copy &#65;&#x42; &nosuch;", "a < b & c <d> © AB &nosuch;"),
    ("<article><h1>T</h1><p>one<br>two <b>th</b>ree<p>four</article>", "T one two three four"),
    ("<article><p>x<a href='unfinished", "x"),
    ("<body><script>var a='</p>';</script><style>p{}</style><p>keep</p><noscript>no</noscript></body>", "keep"),
    ("<!-- <p>hidden</p> --><p>shown</p><!-- open", "shown"),
    ("<p title='a > b'>q</p>", "q"), ("<p>x</q></p></div>y", "x y"),
    ("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", "one two a b"),
    ("<div>" * 3000 + "deep", "deep"),
])
def test_single_pages(html, want):
    assert HM.main_text(html) == want


@pytest.mark.parametrize("around", [
    "<nav><a href=/>Home</a> <a href=/x>More</a></nav>{}", "<header><h1>Site name</h1></header>{}",
    "{}<footer>All rights, reserved, by someone, somewhere</footer>", "<aside><p>Side, side, side</p></aside>{}",
    "<div id='cookie-notice'><p>We use cookies, yes, we do, really.</p></div>{}",
    "<div class='ad'>Buy, now, or, never</div>{}", "<div class=\"side-bar sidebar\"><p>%s</p></div>{}" % LONG,
    "<form><label>Name</label><input><button>Send</button></form>{}",
    "{}<section id=comments><article class='comment'><p>%s</p></article></section>" % LONG,
    "<div role=navigation>menu</div>{}", "<div style='display: none'>%s</div>{}" % LONG,
    "{}<div class='related-posts'><p>%s</p></div>" % LONG,
])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>",
                                  "<div id=content><div class='entry'>{}</div></div>"])
def test_what_surrounds_an_article_goes(around, wrap):
    body = "<h2>Title</h2><p>%s</p><p>Short.</p><p>%s</p>" % (LONG, LONG)
    want = " ".join(["Title", LONG.strip(), "Short.", LONG.strip()])
    page = "<html><head><title>t</title></head><body class='has-sidebar'>%s</body></html>"
    assert HM.main_text(page % around.format(wrap.format(body))) == want


def test_link_lists_lose_to_prose():
    links = "<div>" + "".join(f"<p><a href=/{k}>{LONG}</a></p>" for k in range(20)) + "</div>"
    assert HM.main_text(f"<body>{links}<div><p>{LONG}</p></div></body>") == LONG.strip()


def test_siblings_that_read_like_prose_come_along():
    page = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p><ul><li><a href=x>y</a></li></ul></body>"
    assert HM.main_text(page) == " ".join([LONG.strip()] * 3)


@pytest.mark.parametrize("k", [2, 3, 5, 6, 9])
def test_all_sections_of_a_page_without_article_stay(k):
    inner = "<div class=sec><h2>Part %d</h2><div class=inner><p>%s</p><p>%s</p></div></div>"
    links = "<ul>" + "<li><a href=x>Some page elsewhere</a></li>" * 9 + "</ul>"
    page = f"<body>{links}<div id=content>%s<div class=sec><p>End.</p></div></div>{links}</body>"
    want = " ".join(f"Part {i} {LONG.strip()} {LONG.strip()}" for i in range(k)) + " End."
    assert HM.main_text(page % "".join(inner % (i, LONG, LONG) for i in range(k))) == want


def test_one_long_section_does_not_drop_the_others():
    body = "<div><div><p>%s</p></div></div>" % (LONG * 9) + "<div><div><p>%s</p></div></div>" % LONG
    want = (LONG * 10).strip()
    assert HM.main_text(f"<body><div id=content>{body}</div></body>") == want


@pytest.mark.parametrize("tag", ["pre", "blockquote", "table"])
def test_text_of_other_blocks_beside_the_container_stays(tag):
    text = "x = 1 and more of the same, " * 5
    cell = text if tag != "table" else f"<tr><td>{text}</td></tr>"
    page = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><{tag}>{cell}</{tag}><div><p>{LONG}</p></div></body>"
    assert HM.main_text(page) == " ".join([LONG.strip()] * 2 + [text.strip(), LONG.strip()])


@pytest.mark.parametrize("open_, close", [
    ("<form id=aspnetForm action=x>", "</form>"), ("<div class='page-header-fixed'>", "</div>"),
    ("<div class='sidebar-right'>", "</div>"), ("<div class=nav-open><form>", "</form></div>"),
    ("<div role=banner>", "</div>"),
])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div>{}</div>"])
def test_wrappers_of_the_page_are_not_cut(open_, close, wrap):
    body = f"<p>{LONG}</p><p>{LONG}</p>"
    around = "<div class=menu><a href=/>Home</a></div>{}<section class=comments><p>%s</p></section>" % (LONG * 5)
    page = f"<body>{open_}{around.format(wrap.format(body))}{close}</body>"
    assert HM.main_text(page) == " ".join([LONG.strip()] * 2)


@pytest.mark.parametrize("section", ["<section id='discussion'>{}</section>", "<div class='related-work'>{}</div>"])
def test_sections_of_prose_named_like_surroundings_stay(section):
    part = section.format(f"<h2>On it</h2><p>{LONG}</p>")
    page = f"<article><p>{LONG}</p>{part}<p>{LONG}</p><form><p>Send us mail, please.</p></form></article>"
    assert HM.main_text(page) == f"{LONG.strip()} On it {LONG}{LONG.strip()}"
    said = "<section id='discussion'><div class=comment><p>%s</p></div></section>" % LONG
    teasers = "<div class='related-posts'><p>%s</p></div>" % LONG
    assert HM.main_text(f"<article><p>{LONG}</p>{said}{teasers}</article>") == LONG.strip()


def test_every_given_page(spark):
    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet").withColumn("text", F.lit("x"))
    html = {r.page_id: r.html for r in pages.collect()}
    got = HM.extract_pages(pages).collect()
    assert len(got) == len(html)
    for r in got:
        body = re.search(r"<article>(.*)</article>", html[r.page_id] or "", re.S)
        blocks = re.sub(r"</?b>", "", body[1]) if body else ""
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", blocks)).split())
        assert r.text == want and r.n_chars == len(want)


def test_pages_without_rows_or_html(spark):
    kind = "page_id bigint, url string, html string"
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>é😀</p>")], kind)
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in HM.extract_pages(df).collect()) == [
        ("1", "", 0), ("1", "", 0), ("None", "é😀", 2)]
    assert HM.extract_pages(df.limit(0)).count() == 0


# ---- licences ----

MIT = "\n".join(LS.SENTENCES[i][0] + "." for i in ("MIT_NAME", "MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS", "MIT_LIABLE"))
BSD3 = ". ".join(LS.SENTENCES[i][0] for i in ("BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE", "BSD_AS_IS"))
BSD2 = ". ".join(LS.SENTENCES[i][0] for i in ("BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "BSD_AS_IS"))
GPL = ". ".join(LS.SENTENCES[i][0] for i in ("GPL_FREE", "GPL_HOPE", "GPL_SEE"))
CASES = [
    (1, None, None), (2, "", None), (3, "The license is mine. Public software, no copyright.", None),
    (4, "Text.\nReleased under the MIT License.", ("MIT", 0)),
    (5, "licensed  UNDER the Apache License, version 2.0!", ("Apache-2.0", 0)),
    (6, "x. Licensed under CC BY-NC 4.0. y. Released under the MIT License.", ("MIT,CC-BY-NC-4.0", 0)),
    (7, MIT, ("MIT", 0)), (8, BSD3 + ".", ("BSD-3-Clause", 0)), (9, BSD2 + ".", ("BSD-2-Clause", 0)),
    (10, GPL + ".", ("GPL-3.0-or-later", 0)), (11, LS.SENTENCES["MIT_GRANT"][0] + " ok", None),
    (12, LS.SENTENCES["BSD_REDIST"][0] + "\n" + "Released under the MIT License", ("MIT", 1)),
    (13, "Released under the MIT License.\n" * 3000, ("MIT", 0)),
    (14, "Released under the MIT License, really.", None),
    (15, "This work is licensed under the GNU General Public License, version 3.", ("GPL-3.0", 0)),
    (15, "This work is licensed under the GNU General Public License, version 3.", ("GPL-3.0", 0)),
    (None, "Licensed%%% under### CC&&& BY-NC 4.0.", ("CC-BY-NC-4.0", 0)),
    (16, BSD3 + ".\nother words\n" + MIT, ("BSD-3-Clause,MIT", 0)),
    (17, "Licensed under CC BY 4.0\r\nLicensed under CC BY-SA 4.0", ("CC-BY-4.0,CC-BY-SA-4.0", 0)),
]


@pytest.fixture(scope="module")
def texts(spark):
    return (spark.createDataFrame([c[:2] for c in CASES], "doc_id bigint, text string")
            .withColumn("licenses", F.lit("x")).withColumn("_matched", F.lit("y")))


def test_licences_of_known_texts(texts):
    got = sorted((str(r.doc_id), r.licenses, r.n_unmatched) for r in LS.licensed_documents(texts).collect())
    assert got == sorted((str(i), *want) for i, _, want in CASES if want)


def test_every_row_and_column_stays(texts):
    out = LS.with_licenses(texts, licenses_col="found")
    assert out.count() == len(CASES) and out.where("licenses = 'x' AND _matched = 'y'").count() == len(CASES)
    assert out.where("size(found) = 0 AND n_unmatched = 0").count() == sum(c[2] is None for c in CASES)
    assert LS.licensed_documents(texts.limit(0)).count() == 0


def test_sql_gives_the_same_rows(texts):
    documents = texts.select("doc_id", "text").toArrow()  # noqa: F841  (DuckDB reads it by name)
    want = duckdb.sql(LS.oracle()).fetchall()
    assert sorted(map(str, map(tuple, LS.licensed_documents(texts).collect()))) == sorted(map(str, want))


def _wrapped(paragraphs, lead="", width=78):
    return f"\n{lead.rstrip()}\n".join(
        "\n".join(lead + line for line in textwrap.wrap(p, width)) for p in paragraphs)


def _licence_files():
    say = lambda *names: [LS.SENTENCES[n][-1] for n in names]
    grant, notice, as_is, liable = say("MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS", "MIT_LIABLE")
    mit = ["MIT License", "Copyright (c) 2024 Jo Doe", grant, notice + ".", f"{as_is}. {liable}."]
    redist, source, binary, endorse, as_is = say("BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE", "BSD_AS_IS")
    bsd = ["Copyright 2024, Jo Doe", redist, f"1. {source}.", f"2. {binary}.", f"3. {endorse}.", as_is + "."]
    paren = [bsd[0], redist, f"a) {source};", f"b) {binary};", f"c) {endorse}.", as_is + "."]
    isc = ["Copyright (c) 2024 Jo Doe", *(x + "." for x in say("ISC_GRANT", "ISC_AS_IS"))]
    gpl = [". ".join(say("GPL_FREE", "GPL_HOPE", "GPL_SEE")) + "."]
    gpl2 = [". ".join(say("GPL2_FREE", "GPL_HOPE", "GPL_SEE")) + "."]
    short, comply, copy, basis, see = (LS.SENTENCES[n] for n in (
        "APACHE2_SHORT", "APACHE2_COMPLY", "APACHE2_COPY", "APACHE2_BASIS", "APACHE2_SEE"))
    apache = [f"{short[1]}; {comply[0]}. {copy[0]}", "http://www.apache.org/licenses/LICENSE-2.0",
              f"{basis[0]}. {see[0]}."]
    return [(mit, "MIT"), (bsd, "BSD-3-Clause"), (paren, "BSD-3-Clause"), (isc, "ISC"), (gpl, "GPL-3.0-or-later"),
            (gpl2, "GPL-2.0-or-later"), (apache, "Apache-2.0")]


def test_wrapped_and_flattened_licence_files(spark):
    rows = []
    for paragraphs, name in _licence_files():
        for lead in ("", "# ", " * ", "// ", "    "):
            rows += [(name, _wrapped(paragraphs, lead)), (name, _wrapped(paragraphs, lead, 50).replace("\n", "\r\n"))]
        rows += [(name, " ".join(paragraphs)), (name, "\n".join(paragraphs))]
    df = spark.createDataFrame(rows, "want string, text string")
    for r in LS.with_licenses(df).collect():
        assert r.licenses == [r.want], r.text


def test_wrapped_lines_join_no_other_sentences(spark):
    rows = [("Permission is hereby granted, free of charge, to any person\nobtaining a copy of something.",),
            ("Released under\n\nthe Lesser License",), ("\n" * 200_000 + " : " * 200_000 + "license",),
            ("Released under the MIT License,\nreally.",)]
    out = LS.with_licenses(spark.createDataFrame(rows, "text string")).collect()
    assert [r.licenses for r in out] == [[], [], [], ["MIT"]]


def test_plan_has_no_python_and_no_shuffle(texts):
    plan = LS.licensed_documents(texts)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|Join", plan)


def test_notices_and_rules_are_consistent():
    known = LS.known_parts()
    idents = {v.partition("/")[0] for v in known.values()}
    assert idents == set(LS.SENTENCES) and all(i in idents for _, run in LS.RULES for i in run)
