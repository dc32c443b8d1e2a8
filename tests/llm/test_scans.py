"""Decontamination, license scans and HTML extraction against brute force and planted cases."""

import random
import textwrap

import numpy as np
from glyphmill.llm import decontam, html, licenses, queries
from pyspark.sql import functions as F

from .helpers import empty, odd


def norm(text):
    return "".join(map(chr, decontam.normal(text)[0].tolist())).strip()


def test_every_contained_item_is_found(spark, medium):
    docs = {r["doc_id"]: norm(r["text"] or "") for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    items = {r["item_id"]: norm(r["text"] or "") for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()}
    got = queries.op9_decontamination(spark, medium).collect()
    exact = {(d, i) for d, t in docs.items() for i, s in items.items() if s in t}
    assert exact and exact <= {(r["doc_id"], r["item_id"]) for r in got}
    assert {(r["doc_id"], r["item_id"]) for r in got if r["edits"] == 0} == exact
    for r in got:
        assert r["edits"] <= decontam.budget(len(items[r["item_id"]]))


def edit_distance_within(a, b):
    row = np.zeros(len(b) + 1, dtype=int)
    for x in a:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j, y in enumerate(b, 1):
            new[j] = min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def test_edited_items_match_brute_force():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(6)]
    index = decontam.Index(items)
    for trial in range(40):
        i, item = rng.choice(items)
        chars = list(item)
        for _ in range(rng.randint(0, 16)):
            at = rng.randrange(len(chars))
            kind = rng.randrange(3)
            if kind == 0:
                chars[at] = rng.choice("xyz")
            elif kind == 1:
                chars.insert(at, rng.choice("xyz"))
            else:
                del chars[at]
        text = " ".join(word() for _ in range(20)) + " " + "".join(chars).upper() + ", " + " ".join(word() for _ in range(20))
        least = edit_distance_within(norm(item), norm(text))
        got = [m for m in decontam.matches(index, ["nothing here", text]) if m[1] == i]
        budget = decontam.budget(len(norm(item)))
        if least <= budget:
            assert got and got[0][4] == least and got[0][0] == 1, (trial, least)
        else:
            assert not got


def test_repetitive_texts_and_short_items(monkeypatch):
    import time

    at = time.time()
    index = decontam.Index([(1, "a" * 2000), (2, "ab " * 700), (3, "0" * 300)])
    got = {m[1]: m for m in decontam.matches(index, ["x " + "a" * 8000, "ab " * 3000, "0 " * 900 + "0" * 299 + "1"])}
    assert got[1][4] == 0 and got[2][4] == 0 and got[3][4] == 1 and got[3][0] == 2
    assert time.time() - at < 30
    monkeypatch.setattr(decontam, "HITS", 1000)  # the same counts, few at a time
    assert {m[1]: m for m in decontam.matches(index, ["x " + "a" * 8000, "ab " * 3000, "0 " * 900 + "0" * 299 + "1"])} == got
    index = decontam.Index([(1, "Is it?"), (None, "cat"), (3, "?!"), (4, "42"), (5, "cat")])
    got = decontam.matches(index, ["so IS  it 42", "concatenate 421", "", "a cat"])
    assert [(m[0], m[1], m[2], m[3]) for m in got] == [(0, 1, 3, 9), (0, 4, 10, 12), (3, None, 2, 5), (3, 5, 2, 5)]


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame([(1, "the one text without an id"), (2, None), (3, ""), (4, "short")], "item_id long, text string")
    got = decontam.leaks(odd(spark, start="x", item_id=3), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in got] == [(None, 1, 0)]
    kept = decontam.clean(odd(spark), bench)
    assert kept.columns == odd(spark).columns and kept.count() == 7
    assert decontam.leaks(empty(spark), bench).count() == 0 and decontam.leaks(odd(spark), bench.where("false")).count() == 0
    assert decontam.clean(odd(spark), bench.where("false")).count() == 8


def test_licenses_on_documents(spark, medium):
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    docs = spark.read.parquet(f"{medium}/documents.parquet").collect()
    want = {(r["doc_id"], name) for r in docs for line, name in lines.items() if line in (r["text"] or "")}
    got = queries.op8_license_scan(spark, medium).collect()
    assert want and {(r["doc_id"], r["license"]) for r in got} == want
    text = {r["doc_id"]: r["text"] for r in docs}
    assert all(any(line in text[r["doc_id"]][r["start"] : r["end"]] for line in lines) for r in got)


def test_license_kin_are_told_apart():
    scan = licenses.Scanner().scan
    name = lambda t: [x[2] for x in scan(t)]
    for t in licenses.all_templates():
        assert name(f"hello there\n{t.text}\nbye")[:1] == [t.license], (t.license, t.text[:60])
    assert name("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0"]
    assert name("You need a driving license to rent this car, and a copy of it.") == []
    wrapped = "\n".join(" * " + x for x in textwrap.wrap(licenses._MIT, 60))
    assert name(f"/*\n * Copyright 2020 A\n{wrapped}\n */\nint x;")[:1] == ["MIT"]


def test_all_licenses_of_a_block():
    name = lambda t: {x[2] for x in licenses.Scanner().scan(t)}
    assert name("Licensed under the MIT License or the Apache License, Version 2.0.") == {"MIT", "Apache-2.0"}
    assert name("Released under the MIT License. Licensed under the Apache License, Version 2.0.") == {"MIT", "Apache-2.0"}
    assert name("SPDX-License-Identifier: MIT OR Apache-2.0") == {"MIT", "Apache-2.0"}
    assert name(licenses._MIT + "\n\n" + licenses._APACHE) == {"MIT", "Apache-2.0"}
    assert name("Boost Software License, Version 1.0") == {"BSL-1.0"}
    assert name("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.") == {"CC-BY-NC-4.0"}
    assert name("\n".join(f"Copyright (c) {k} someone{k}" for k in range(1000)) + "\n" + licenses._MIT) == {"MIT"}


def test_ranking_is_by_bytes_saved():
    """Every template's saving, compressed anew; the order is that of the saving."""
    import zstandard

    scanner, ws = licenses.Scanner(), licenses.words("x y z " + licenses._ISC + " and more")
    form = {"level": 9, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    data, want = " ".join(ws).encode(), []
    for k, t in enumerate(scanner.templates):
        own = " ".join(licenses.words(t.text)).encode()
        given = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **form)
        alone = zstandard.ZstdCompressor(**form)
        saved, full = len(alone.compress(data)) - len(given.compress(data)), len(alone.compress(own)) - len(alone.compress(b""))
        if saved > 0 and saved >= licenses.LEAST_SAVED * full:
            want.append((-saved, -saved / full, k))
    assert [k for _, _, k in scanner.ranked(ws)] == [k for _, _, k in sorted(want)]
    assert scanner.templates[scanner.ranked(ws)[0][2]].license == "ISC"


def test_license_odd_rows(spark):
    assert licenses.scan(odd(spark, license="x")).count() == 0 and licenses.scan(empty(spark)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><header><p>Site</p></header><!-- ad --><div class="ad">Buy</div>
<div id="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p><b>One <i>two</i><br>three<p>Four&nbsp;five &#233;</p>
<ul><li>x<li>y</ul><form><input value="q"><p>send</p></form><aside>side</aside><section class="comments"><p>Nice!</p></section></article>
<div class="comments"><p>First</p></div><footer>&copy; me</footer>"""


def test_article_without_furniture():
    assert html.main_text(PAGE) == "A & B\n\nOne two three\n\nFour five é\n\nx\n\ny"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x") == ""
    assert html.main_text("<p>a<div>b</p>c</div>d") == "a\n\nb\n\nc\n\nd"
    assert html.main_text("<div>" * 5000 + "deep") == "deep"


def test_site_templates_go(spark):
    page = lambda i: f"<body><div><p>Welcome to our site</p></div><div><p>Story {i} is told here</p></div><div><p>All rights {i % 2}</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(20)] + [(99, None, "<p>alone</p>"), (100, "http://b.example/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert all(got[i]["text"] == f"Story {i} is told here" for i in range(20))
    assert got[99]["text"] == "alone" and got[100]["text"] == "" and got[100]["n_chars"] == 0
    assert html.extract(pages.where("false")).count() == 0
    far = html.BROADCAST_HASHES
    try:
        html.BROADCAST_HASHES = -1  # the same by a join
        assert {r["page_id"]: r["text"] for r in html.extract(pages).collect()} == {k: r["text"] for k, r in got.items()}
    finally:
        html.BROADCAST_HASHES = far


def test_broken_and_long_pages():
    import time

    turkish = "<p>" + "İ" * 40 + "</p><script>..</script><p>first kept</p><p>second kept</p><SCRIPT>b</Script ><p>third</p>"
    assert html.main_text(turkish) == "İ" * 40 + "\n\nfirst kept\n\nsecond kept\n\nthird"
    assert html.main_text("<p>a &am<b>p;lt; b</b> &lt;</p>") == "a &amp;lt; b <"
    assert html.main_text('<p title="x > y" class=\'z\'>a</p><p data=it\'s>b</p>') == "a\n\nb"
    for part in ("<a '\"", "<!", "<a =\"", "<a ", "<?", '<a b="', "<!--", "<script>", "</p>"):
        at = time.time()
        html.main_text(part * (1_000_000 // len(part)))
        assert time.time() - at < 10, part
    assert html.main_text('<article><p class="alert">once</p><div class="share"><p>x</p></div><p>y</p></article>') == "once\n\ny"


def test_template_counts_match_brute_force(spark):
    rng = random.Random(8)
    hosts = ["a.example", "b.example"]
    part = lambda k: f"<div class=c{k}><p>box {k} said</p></div>"
    rows = []
    for i in range(60):
        inside, outside = (rng.sample(range(22), 3) for _ in range(2))
        rows.append((f"http://{hosts[i % 2]}/{i}", "".join(map(part, outside)) + f"<article><p>own {i} {'and more of it ' * 20}</p>" + "".join(map(part, inside)) + "</article>", set(outside), set(inside)))
    rows += [rows[0], rows[1]] * 3  # repeated pages count once
    got = extracted(spark, [r[:2] for r in rows])
    for k, (url, _, _, inside) in enumerate(rows):
        own = {r[:2]: r for r in rows if r[0].split("/")[2] == url.split("/")[2]}
        often = {x for x in range(22) if sum(x in r[3] for r in own.values()) >= html.LEAST_PAGES}
        want = {f"box {x} said" for x in inside - often}
        assert set(got[k].split("\n\n")[1:]) == want


def extracted(spark, rows):
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html.extract(pages).collect()}


def test_templates_inside_articles_go_and_copies_stay(spark):
    story = lambda i: f"<h2>Notes</h2><p>Story {i} is told here at some length, so that it is the most of the page</p><table><tr><td>{i}</td><td>Yes</td></tr></table><p>Les.</p>"
    rows = [("http://a.example/", f"<article>{story(i)}<div class=x1><p>Read on: ten more</p></div></article>") for i in range(6)]
    rows += [("http://c.example/", f"<p>chrome {i}</p><article>{story(7)}</article>") for i in range(8)]  # one article under many chromes
    rows += [("http://d.example/", f"<article>{story(8)}<p>v{i}</p></article>") for i in range(8)]  # near copies
    got = extracted(spark, rows)
    kept = lambda i: f"Notes\n\nStory {i} is told here at some length, so that it is the most of the page\n\n{i}\n\nYes\n\nLes."
    assert [got[i] for i in range(6)] == [kept(i) for i in range(6)]
    assert all(got[6 + i] == kept(7) for i in range(8))
    assert all(got[14 + i] == f"{kept(8)}\n\nv{i}" for i in range(8))


def test_templates_are_counted_by_distinct_pages(spark):
    rows = [("http://a.example/", "<p>One page</p><p>stored often</p>")] * 10
    rows += [("http://big.example/", f"<div><p>Section menu</p></div><p>Own {i}</p>" if i < 6 else f"<p>Other {i}</p>") for i in range(100)]
    rows += [("http://few.example/", f"<div><p>Menu</p></div><p>Text {i}</p>") for i in range(3)]
    got = extracted(spark, rows)
    assert all(got[i] == "One page\n\nstored often" for i in range(10))
    assert [got[10 + i] for i in range(6)] == [f"Own {i}" for i in range(6)]
    assert [got[110 + i] for i in range(3)] == [f"Text {i}" for i in range(3)]


def test_all_outermost_articles_are_the_text():
    assert html.main_text("<article><p>a</p></article><p>x</p><article><p>longer b</p></article><article class=comment>c</article>") == "a\n\nlonger b"


def test_pages_against_their_articles(spark, small):
    import re
    from html import unescape

    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.op4_html_extraction(spark, small).collect()}
    assert len(got) == len(rows)
    for i, h in rows.items():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer)", h, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = [re.sub(r" ", "", b) for b in blocks if b]
        assert [re.sub(r" ", "", b) for b in got[i]["text"].split("\n\n") if b] == want
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_names_alone_take_no_text_away():
    """Frames named for a menu, sections that only share a word with what is no text, empty and small main elements."""
    inner = "<p>One two three four five six.</p><p>More text of the page here.</p>"
    text = "One two three four five six.\n\nMore text of the page here."
    assert html.main_text(f'<div class="page nav-open">{inner}</div>') == text
    assert html.main_text(f'<div class="has-comments"><article>{inner}</article></div>') == text
    assert html.main_text(f'<div id="sidebar">{inner}</div><div class="c">{inner * 2}</div>') == f"{text}\n\n{text}"
    prose = "<p>Other people have done much the same thing before us in many ways, and said so.</p>"
    links = '<div class="share"><a href=x>Share</a> <a href=y>Tweet</a></div>'
    assert html.main_text(f'<article>{inner}<section id="related-work">{prose}</section>{links}</article>') == f"{text}\n\n{prose[3:-4]}"
    assert html.main_text(f"<main></main><div>{inner}</div>") == text
    assert html.main_text(f'<article class="teaser"><p>Short.</p></article><div class="post">{inner * 4}</div>').count(text) == 4
    assert html.main_text(f'<article>{inner}</article><div class="post"><p>Less.</p></div>') == text
    assert html.main_text(f'<article>{inner}<div class="comments">{prose * 3}</div></article>') == text
    assert html.main_text('<article><p>Seen.</p><p hidden="hidden">Not.</p><div hidden>Nor this.</div><p aria-hidden="false">This.</p></article>') == "Seen.\n\nThis."


def test_templates_change_pages_and_no_host_is_one_key(spark, monkeypatch):
    """A recurring block with a neutral class in and beside articles goes from every page, also where hashes are joined."""
    body = lambda k: f"<p>Page {k} says {k * 7919 % 1000} things of its own, and goes on for a while about the {k + 1}th of them.</p>"
    more = '<div class="box">The same words on every page of this site.</div>'
    rows = [(k, f"http://h{k % 3 // 2}.org/{k}", f"<html><body><div>{more}</div><article>{body(k)}{more}</article></body></html>") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("hashes", F.lit(1)).withColumn("_salt", F.lit("x"))
    plain = {k: html.main_text(h) for k, _, h in rows}
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert sum(got[k] != plain[k] for k in got) == 60 and all(got[k] == body(k)[3:-4] for k in got)
    monkeypatch.setattr(html, "BROADCAST_HASHES", 0)
    assert {r["page_id"]: r["text"] for r in html.extract(pages).collect()} == got


def test_gnu_names_heads_and_ids():
    scanner = licenses.Scanner()
    told = lambda text: sorted({x[2] for x in scanner.scan(text)})
    assert told("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007") == ["GPL-3.0"]
    assert told("GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999\n") == ["LGPL-2.1"]
    assert told("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007") == ["AGPL-3.0"]
    assert told("Licensed under GPLv3.") == ["GPL-3.0"] and told("Licensed under LGPL v2.1.") == ["LGPL-2.1"]
    assert told("// SPDX-License-Identifier: GPL-2.0-or-later") == ["GPL-2.0-or-later"] and told("# SPDX-License-Identifier: LGPL-2.1-only") == ["LGPL-2.1-only"]
    assert told("SPDX-License-Identifier: GPL-2.0") == ["GPL-2.0"] and told("SPDX-License-Identifier: GPL-2.0 OR MIT") == ["GPL-2.0", "MIT"]
    assert told("SPDX-License-Identifier: GPL-2.0-or-later OR MIT") == ["GPL-2.0-or-later", "MIT"]
    assert not {"AGPL-2.0", "AGPL-2.1", "GPL-2.1"} & {t.license for t in licenses.all_templates()}
