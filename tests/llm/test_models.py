"""Top-k search, extraction, the classifiers and the pipeline."""

import math

import numpy as np
import pytest
from llm_rows import DOCUMENTS, prose, row
from pyspark.sql import functions as F

from millrace.llm import html_extract, quality, topk, toxicity
from millrace.llm.common import written


@pytest.mark.parametrize("shard", [4096, 50])
def test_top_k(spark, shard, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(240, 6)), 2)
    x[100:160] = x[100]  # ties
    rows = [(i, [float(v) for v in v], 1) for i, v in enumerate(x)]
    rows += [(300, None, 1), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (400, [float("nan")] * 6, 1), (450, [math.inf] * 6, 1), (500, [1.0, 2.0], 1), (501, [3.0, 1.0], 1), (None, [1.0] * 6, 1), (550, [], 1)]
    rows += [rows[3], rows[50], (50, [9.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (7, [4.0, 4.0, 4.0, 4.0, 4.0, 4.0], 1)]  # repeated rows, and identifiers with several vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    want = []
    for n, (q, own) in enumerate(whole):
        if q is not None and q % 50 == 0:
            found = sorted((-int(own @ v), i is None, i or 0) for m, (i, v) in enumerate(whole) if n != m and len(v) == len(own))[:5]
            want += [(q, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(found)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize(("x", "score"), [(2.0**21, 2**58 + 256 * 768), (2.0**25, None), (2.0**60, None)])
def test_top_k_of_large_numbers(spark, x, score):
    df = spark.createDataFrame([(0, [x, 1.0]), (1, [x, 3.0]), (2, [-x, 2.0])], "vec_id long, embedding array<double>")
    found = lambda: [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    if score is None:
        with pytest.raises(Exception, match="does not fit a long"):
            found()
    else:
        assert found() == [(1, score), (2, -(2**58) + 256 * 512)]


def test_clusters_and_a_hot_vector_are_split_into_shards(spark, monkeypatch):
    """Exact on clusters, where a third of the rows are one vector, which several shards share."""
    monkeypatch.setattr(topk, "SHARD", 64)
    rng, sent = np.random.default_rng(4), []
    centres = np.eye(8) * 100
    x = np.round(centres[np.arange(1600) % 8] + rng.normal(size=(1600, 8)), 2)
    x = np.concatenate([x, np.repeat(x[:1], 800, axis=0)])
    df = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    routed = topk._routed

    def told(boxes):
        sent.append(sum(len(b[0]) for b in boxes.values()))
        return routed(boxes)

    monkeypatch.setattr(topk, "_routed", told)
    made = []
    monkeypatch.setattr(topk, "written", lambda df, tag: made.append((tag, written(df, tag))) or made[-1][1])
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    whole = np.floor(256 * x).astype(int)
    want = []
    for q in range(0, len(x), 50):
        order = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert got == sorted(want)
    shards = made[[t for t, _ in made].index("shards")][1]
    assert shards.groupBy("shard").count().agg(F.max("count")).first()[0] <= 2 * 64 + 32 and sent[0] > 20


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><p>Site</p></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class="ad">buy</div><div id="cookie-notice">cookies</div>
<article class="post"><h1>A &amp; B</h1><p>one<br>two <b>three</b>
 four<p>five &lt;6&gt;<ul><li>x<li>y</ul><form><input>f</form><aside>see also</aside><div class="comments"><p>bad</p></div></article>
<footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (PAGE.format(), "A & B\none two three four\nfive <6>\nx\ny"),
        ("<body><main><h1>T</h1>a<div role=navigation>n</div></main><p>after", "T\na"),
        ("<p>plain <b>text", "plain text"),
        ("no markup &#233;", "no markup é"),
        ("", ""),
        (None, ""),
        ("<article><p>unclosed <script>x", "unclosed"),
        ('<article><p title="a>b">t</p><p hidden>h</p><table><tr><td>c<td>d</table>', "t\nc\nd"),
        ("<" * 5000 + "<p>x", None),
        ("<div>" * 3000 + "deep" + "</b>" * 3000, "deep"),
    ],
)
def test_extraction(spark, source, text):
    pages = spark.createDataFrame([(1, None, source, "x", 2)], "page_id long, url string, html string, text string, n_chars int")
    (r,) = html_extract.extract(pages).collect()
    assert (r.page_id, r.url, r.n_chars) == (1, None, len(r.text)) and (text is None or r.text == text)


def test_template_of_a_host(spark):
    """Pages without an article: what the host's pages share goes, what they don't stays, and other hosts' text doesn't count."""
    page = "<html><body><div><p>Welcome to the site</p></div><div><p>{}</p></div><div><p>All rights reserved</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(prose(20, i))) for i in range(8)]
    rows += [(20, "http://other.example/", page.format("alone")), (21, "http://h.example/copy", page.format(prose(20, 0)))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(8)} == {prose(20, i) for i in range(8)} and got[21] == got[0]
    assert got[20] == "Welcome to the site\nalone\nAll rights reserved"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _junk(n, seed):
    return " ".join(w.upper() + "!!" for w in prose(n, seed).split())


@pytest.fixture(scope="module")
def judged(spark):
    rows = [row(i, (_junk if i % 5 == 0 else prose)(80, i), f"s{i % 4}")[:5] for i in range(300)]
    rows += [(1000, None, None, None, 0), (1001, "", "en", "s0", 0), (None, prose(80, 1), "en", "s1", 5), (7, prose(80, 7), "en", "s3", 5), (1002, prose(20000, 5), "en", "new", 9)]
    labels = [(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(200)] + [(3, 1, 0), (None, 0, 0), (9, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, judged):
    docs, labels = judged
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 300]
    assert all(r.kept == (r.doc_id % 5 != 0) for r in held)
    left = quality.kept(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in got)
    assert quality.classify(docs, labels.where("quality = 1")).where("kept").count() == docs.count()
    assert quality.classify(docs.limit(0), labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == docs.count()


def test_sites_are_shrunk(spark):
    rows = [row(i, _junk(30, i) if i < 300 else prose(30, i), "bad" if i < 300 else "good", "p")[:5] for i in range(600)] + [row(900, prose(30, 900), "rare", "p")[:5]]
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(600)], "doc_id long, quality int")
    got = {r.doc_id: r.site_score for r in quality.classify(spark.createDataFrame(rows, DOCUMENTS), labels).collect()}
    assert got[1] < got[900] < got[500]


def test_quality_against_a_plain_posterior(spark, judged):
    """Sums, strengths and posteriors of hosts and paths by loops, from each document's own score."""
    docs, labels = judged
    got = quality.classify(docs, labels, whole=True).collect()
    own = [(r.doc["source"], r.doc["lang"], r.own_score) for r in got]
    share = sum(p for *_, p in own) / len(own)

    def groups(key):
        out = {}
        for row in own:
            n, good = out.get(key(row), (0, 0.0))
            out[key(row)] = (n + 1, good + row[2])
        return out

    def strength(found, mean):
        v = sum(n * ((good / n - mean[k]) ** 2 - mean[k] * (1 - mean[k]) / n) for k, (n, good) in found.items())
        w = sum(n * mean[k] * (1 - mean[k]) for k, (n, _) in found.items())
        return min(1e4, max(1.0, w / max(v, 1e-4 * w) - 1))

    hosts, paths = groups(lambda r: r[0]), groups(lambda r: r[:2])
    k = strength(hosts, dict.fromkeys(hosts, share))
    prior = {h: (k * share + good) / (k + n) for h, (n, good) in hosts.items()}
    k = strength(paths, {p: prior[p[0]] for p in paths})
    odds = lambda p: math.log(p / (1 - p))
    for r in got:
        n, good = paths[r.doc["source"], r.doc["lang"]]
        site = min(1 - 1e-6, max(1e-6, (k * prior[r.doc["source"]] + good - r.own_score) / (k + n - 1)))
        score = 1 / (1 + math.exp(-(odds(r.own_score) + quality.SITE_WEIGHT * (odds(site) - odds(share)))))
        assert r.site_score == pytest.approx(site) and r.score == pytest.approx(score) and r.kept == (r.score >= quality.KEEP)


def test_ordinal_fit_reaches_the_best_likelihood():
    """No small change of any weight or threshold makes the penalised likelihood better, and the gradient is near zero."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3))
    y = np.digitize(x @ np.array([1.0, -1, 0.5]) + rng.logistic(size=500), [-0.5, 1.0])
    w, cuts = toxicity.fit(x, y, 3, steps=6000)

    def loss(w, cuts):
        s = lambda v: 1 / (1 + np.exp(-v))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        p = s(edges[y + 1] - x @ w) - s(edges[y] - x @ w)
        return -np.log(p).mean() + toxicity.RIDGE / math.sqrt(500) / 2 * (w @ w)

    best = loss(w, cuts)
    for i in range(5):
        for step in (-1e-3, 1e-3):
            z = np.concatenate([w, cuts])
            z[i] += step
            assert loss(z[:3], z[3:]) >= best - 1e-9


def test_toxicity(spark):
    bad = ["idiotic", "moronish", "scumbag"]
    text = lambda i: prose(60, i) + (" " + " ".join(bad[: 1 + i % 3]) * (1 + i % 2) if i % 4 == 0 else "")
    docs = spark.createDataFrame([(i, text(i), "x", 1) for i in range(400)] + [(None, None, "x", 1), (500, "", "x", 1), (501, prose(20000, 3), "x", 1)], "doc_id long, text string, words string, n int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(280)] + [(5, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.doc_id is not None and 280 <= r.doc_id < 400]
    assert sum(r.toxic == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held) and all(r.toxic for r in held if r.doc_id % 4 == 0)
    assert all(0 <= r.severity <= 2 and r.toxic == (r.grade > 0) for r in got)
    assert not any(r.toxic for r in toxicity.score(docs, labels.where("toxic = 0")).collect())
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = np.digitize(x @ np.array([2.0, -1, 0, 0.5]) + rng.logistic(size=3000), [-1.0, 1.5])
    w, cuts = toxicity.fit(x, y, 3, ridge=0.0, steps=2000)
    assert np.allclose(w, [2, -1, 0, 0.5], atol=0.25) and np.allclose(cuts, [-1, 1.5], atol=0.25)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        sizes.append(docs.count())
        if stage is not corpus_pipeline.packed:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 200 > sizes[0] >= sizes[1] >= sizes[2] > 0
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == sizes[-1]
    texts = {r.doc_id: r.n for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "length(text) AS n").collect()}
    assert {r.doc_id for r in got} <= set(texts)
