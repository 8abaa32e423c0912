"""Elements that are left out, or only look closed, inside an article."""

import random
from collections import Counter, defaultdict

import pytest
from llm_rows import prose

from millrace.llm import html_extract


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<article><p>a <svg class="icon"/> b</p><p>c</p></article>', "a b\nc"),
        ('<article><p>a <svg class="icon"><path d="x"/><text>t</text></svg> b</p><p>c</p></article>', "a b\nc"),
        ("<article><p>a <svg><g><p>b</p></article>", "a\nb"),  # as in browsers, a paragraph ends an open svg
        ("<article><p>a<template><p>t</template> b</p><p>c</article>", "a b\nc"),
        ("<article><p>a <math/> b</p></article>", "a b"),
        ("<article><p>a <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn></math> b</p></article>", "a x=1 b"),
        ("<article><p>a</p><object data=f><p>shown instead</p></object><p>b</p></article>", "a\nshown instead\nb"),
        ("<article><p>a</p><video><source src=x>no video</video><p>b</p></article>", "a\nb"),
        ("<article><div>a<iframe src=x></div><div>b</div></article>", "a\nb"),
        ("<article><p>a<noscript>n</noscript> b<script>if (a < b) x('<p>')</script> c</p></article>", "a b c"),
        ("<article><p>a<template><p>t</p></template><p>b</article>", "a\nb"),
    ],
)
def test_elements_without_text(source, text):
    assert "\n".join(b[2] for b in html_extract.Page(source).main()) == text


@pytest.mark.parametrize("slot", ["article", "main", "div"])
def test_template_of_all_slots(spark, slot):
    """A notice that repeats on a host's pages goes wherever it stands, whatever its class is named; others stay."""
    page = "<html><body><{0}><h1>{1}</h1><div class=zq7><p>Sign up for our letter</p></div><p>{2}</p><p>{3}</p></{0}></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(slot, f"title {i}", prose(20, i), "seldom" if i < 2 else f"other {i}")) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"title {i}\n{prose(20, i)}\n" + ("seldom" if i < 2 else f"other {i}") for i in range(8)}


HOST = "page_id long, url string, html string"


def test_names_of_lines_and_other_names_say_nothing(spark):
    """A line that all pages of a host have goes; paragraphs stay whatever their class; a container goes by a name of its own only."""
    page = "<article><h1>{0}</h1><p>Read this first</p><p class='share-price'>{1}</p><p class='related work'>{2}</p><div class='share-price'><p>{3}</p></div><div class='share buttons'>x{0}</div></article>"
    rows = [(i, f"http://h.example/{i}", page.format(f"t{i}", *(prose(9, f"{i}{k}") for k in "abc"))) for i in range(6)]
    rows += [(100, "http://h.example/0#again", rows[0][2]), (100, "http://h.example/0#again", rows[0][2])]  # repeated rows
    got = sorted((r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame(rows, HOST)).collect())
    want = {i: "\n".join([f"t{i}", *(prose(9, f"{i}{k}") for k in "abc")]) for i in range(6)}
    assert got == sorted([*want.items(), (100, want[0]), (100, want[0])])


def test_slots_are_judged_over_the_host(spark):
    """A slot inside articles that few texts fill in turn goes; one outside that is mostly links goes; the same on other hosts stays."""
    page = "<body><div class=z1><a href=x>{0}</a></div><{4}><p>{1}</p><div class=z2><p>advert {2}</p></div><p>{3}</p></{4}></body>"
    make = lambda i, tag: page.format(f"link {i}", prose(12, i), i % 2, prose(8, -i), tag)
    rows = [(i, f"http://a.example/{i}", make(i, "article")) for i in range(1, 13)]
    rows += [(100 + i, f"http://b.example/{i}", make(i, "section")) for i in range(1, 13)]
    rows += [(200, "http://c.example/1", make(1, "article"))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, HOST)).collect()}
    for i in range(1, 13):
        assert got[i] == got[100 + i] == f"{prose(12, i)}\n{prose(8, -i)}"
    assert got[200] == f"{prose(12, 1)}\nadvert 1\n{prose(8, -1)}"


def test_templates_against_brute_force(spark):
    """Occurrence vectors as lists, classes as groups of equal ones, and each valid element in a valid one."""
    r = random.Random(8)
    rows = []
    for host in range(4):
        for i in range(r.choice([2, 5, 9])):
            parts = [f"<div class=c{k}><p>{r.choice(['one', 'two', 'fixed', 'fixed'])}{k}</p><ul>{'<li>x' * r.randrange(3)}</ul></div>" for k in range(5) if r.random() < 0.7]
            rows.append((len(rows), f"http://h{host}.example/{i}", f"<body><h1>title</h1>{''.join(parts)}<p>{prose(5, len(rows))}</p></body>"))
    rows.append((len(rows), rows[0][1], rows[0][2]))
    read = html_extract.parsed(html_extract._keyed(spark.createDataFrame(rows, HOST)))
    got = {r.host: (set(r.markup), set(r.boilerplate)) for r in html_extract.templates(read).collect()}
    assert len(got) == 4
    for host, (markup, boilerplate) in got.items():
        pages, above = {}, {}
        for _, url, source in rows:
            if f"//{host}/" in url:
                page = html_extract.Page(source)
                texts = Counter(html_extract.token(b[0][-1], b[2]) for b in page.blocks)
                pages["\n".join(b[2] for b in page.blocks)] = {(t, False): n for t, n in page.markup.items()} | {(t, True): n for t, n in texts.items()}
                above |= {x: b[0][:i] for b in page.blocks for i, x in enumerate(b[0][:-1])}
        classes = defaultdict(list)
        for t in {t for p in pages.values() for t in p}:
            classes[tuple(p.get(t, 0) for p in pages.values())].append(t)
        want = {False: set(), True: set()}
        for vector, members in classes.items():
            support = sum(n > 0 for n in vector)
            if support >= html_extract.LEAST_PAGES and sum(1 if text else 2 for _, text in members) >= html_extract.LEAST_TOKENS:
                for t, text in members:
                    if support >= len(pages) * (html_extract.TEXT_SHARE if text else html_extract.LEAST_SHARE):
                        want[text].add(t)
        assert (markup, boilerplate) == (want[False], want[True])
        assert all(x in markup for t in markup for x in above.get(t, ()))  # valid elements nest
