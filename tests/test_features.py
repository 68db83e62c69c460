"""Boundaries of features, rules, scores and fusion on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurescope.functions import scores
from lurescope.functions.urls import char_tokens, lexical, with_domain
from lurescope.operators import dataset, dom, evaluation, fusion, graph, panel, vectors
from lurescope.sources import corpus, registry
from lurescope.sources.pages import crawled


def features(spark, url):
    df = with_domain(spark.createDataFrame([(url,)], "url string"))
    return df.select("domain", *scores.columns(lexical(F.col("url"), F.col("domain")))).first()


@pytest.mark.parametrize(
    "url, name, want",
    [
        ("http://1.2.3.4/x", "having_ip_address", 1.0),
        ("http://1.2.3.4:80/x", "having_ip_address", 0.0),
        ("http://a.test/" + "x" * 39, "url_length_score", 0.0),
        ("http://a.test/" + "x" * 40, "url_length_score", 0.5),
        ("http://a.test/" + "x" * 61, "url_length_score", 0.5),
        ("http://a.test/" + "x" * 62, "url_length_score", 1.0),
        ("http://a.b.c.test", "having_sub_domain", 0.5),
        ("http://a.b.c.d.test", "having_sub_domain", 1.0),
        ("http://a.b.test", "having_sub_domain", 0.0),
        ("https://a//b", "double_slash_redirecting", 1.0),
        ("http://a//b", "double_slash_redirecting", 1.0),
        ("https://ab", "double_slash_redirecting", 0.0),
        ("http://a-b.test/c", "prefix_suffix", 1.0),
        ("http://ab.test/c-d", "prefix_suffix", 0.0),
        ("http://u@a.test", "having_at_symbol", 1.0),
        ("HTTP://BIT.LY/x", "shortening_service", 1.0),
        ("a.test/x", "domain", "a.test"),
        ("http:///x/y", "domain", "/x/y"),
        ("http://www[.]a[.]test/x", "domain", "example.com"),
        ("http://https-a.test", "https_token", 1.0),
        ("http://A.test:8080/p?q#f", "domain", "A.test:8080"),
    ],
)
def test_lexical(spark, url, name, want):
    assert features(spark, url)[name] == want


def test_null_url_has_null_features(spark):
    row = features(spark, None)
    assert all(v is None for v in row.asDict().values())


def test_rule_scores(spark):
    df = spark.createDataFrame([("http://paypal-verify.test/login",), ("https://github.com/x",), ("https://plain.test",)], "u string")
    got = [r.asDict() for r in df.select(*scores.columns(scores.whois(F.col("u")))).collect()]
    assert [r["registration_age_days"] for r in got] == [30, 7300, 1200]
    assert [r["domain_risk_score"] for r in got] == [85.0, 10.0, 10.0]
    assert [r.ensemble_score for r in df.select(scores.classical(F.col("u"))["ensemble_score"].alias("ensemble_score")).collect()] == [97.9, 0.2, 0.2]
    assert [r.s for r in df.select(scores.ssl(F.col("u"))["ssl_risk_score"].alias("s")).collect()] == [95.0, 2.0, 2.0]


def test_panel_points_votes_and_pool(spark):
    df = panel.with_points(spark.createDataFrame([(1, "http://paypal-login.test/verify", 1.0), (2, "https://plain.test/", 0.0)], "id int, url string, prefix_suffix double"))
    assert [round(r.points, 1) for r in df.orderBy("id").collect()] == [96.0, 0.1]  # brand 45, three words 36, hyphen 15
    engines = spark.createDataFrame([(i, f"E{i}", 0.9) for i in range(10)], "ord int, name string, reliability double")
    pooled = {r.id: r for r in panel.pooled(panel.fan_out(df, engines), ["id"]).collect()}
    assert (pooled[1].consensus, pooled[1].phishing_votes, pooled[1].agreement) == ("PHISHING", 10, 100.0)
    assert (pooled[2].consensus, pooled[2].legitimate_votes) == ("LEGITIMATE", 10)
    in_row = {r.id: r for r in panel.pooled_in_row(df, engines).collect()}
    for k in (1, 2):
        assert (in_row[k].llm_score, in_row[k].phishing_votes, in_row[k].consensus) == (pooled[k].pooled_score, pooled[k].phishing_votes, pooled[k].consensus)


def test_votes_four_and_five(spark):
    rows = [(k, i, 60.0 if i < k else 10.0, "PHISHING" if i < k else "LEGITIMATE", 0.9) for k in (4, 5) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, i int, score double, verdict string, reliability double")
    got = {r.k: r.consensus for r in panel.pooled(df, ["k"]).collect()}
    assert got == {4: "LEGITIMATE", 5: "PHISHING"}
    assert {r.k: r.verdict for r in panel.compared(df, ["k"]).collect()} == {4: "LEGITIMATE", 5: "PHISHING"}


def test_engine_matching(spark):
    engines = spark.createDataFrame([(0, "Alpha 1"), (1, "Beta Large"), (2, "Beta Small")], "ord int, name string")
    asked = spark.createDataFrame([("beta",), ("BETA_small",), ("zeta",), (None,)], "asked string")
    got = {r.asked: r.engine for r in panel.matched_engines(asked, engines, "asked").collect()}
    assert got == {"beta": "Beta Large", "BETA_small": "Beta Small", "zeta": "Alpha 1"}


def test_fusion_ladder(spark):
    engines = spark.createDataFrame([(i, f"E{i}", 0.9) for i in range(10)], "ord int, name string, reliability double")
    df = spark.createDataFrame([(1, "http://paypal-login-secure.test/verify/account"), (2, "https://plain.test/")], "id int, url string")
    got = {r.id: r for r in fusion.fused(fusion.with_scores(df, engines)).collect()}
    assert got[1].verdict == "PHISHING DETECTED" and got[1].threat_score > 50 and got[1].text_score > 80 and got[1].ensemble_score > 80
    assert got[2].verdict == "LEGITIMATE SITE" and got[2].attack_category == "NONE" and got[2].confidence >= 95
    assert got[1].brand == "PayPal" and got[1].action == "BLOCK"
    assert fusion.evidence_matrix(fusion.fused(fusion.with_scores(df, engines)), "id").count() == 18
    assert fusion.batch_scan(spark.createDataFrame([(" ",), ("a.test",)], "url string"), engines).count() == 1


PAGE = """<html><body><!-- c --><form action=""><input type="password"><input type="hidden"></form><a href="#">x</a><a href="/in">y</a>
<a href="http://away.test/">z</a><img src="http://away.test/a.png"><img src="/b.png"><iframe width="0"></iframe><p style="display: none">un<b>closed
<script>var a = "<div></p>";</script></body></html>"""


def test_dom(spark):
    pages = spark.createDataFrame([(1, "http://here.test/", PAGE), (2, "http://here.test/", ""), (3, None, None), (4, "here.test", "plain text")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in dom.dom_features(pages, "page_id", "html", "url").collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].dom_node_count == 14 and got[1].sfh_external == 1 and got[1].iframe_hidden == 1
    assert got[1].url_of_anchor_ratio == pytest.approx(2 / 3) and got[1].request_url_ratio == 0.5
    assert got[2].dom_node_count == 10 and got[3].dom_node_count == 10 and got[4].dom_node_count == 0
    stats = {r.page_id: r for r in dom.graph_stats(pages, "page_id", "html", "url").collect()}
    assert (stats[1].node_count, stats[1].edge_count) == (14, 26)
    assert (stats[2].node_count, stats[2].edge_count, stats[2].graph_density) == (5, 4, 0.2)
    assert (stats[4].node_count, stats[4].graph_density) == (3, 0.3)
    nodes = dom.node_features(pages, "page_id", "html", "url")
    password = nodes.filter("idx = 3").first()
    assert password.x[2] == 1.0 and len(password.x) == 14
    edges = {r.page_id: r["count"] for r in dom.graph_edges(nodes, "page_id").groupBy("page_id").count().collect()}
    assert edges == {1: 26, 2: 4, 3: 4, 4: 2}  # blank pages and one without elements have the edges of their stand-ins


def test_many_elements_keep_200(spark):
    pages = spark.createDataFrame([(1, "http://a.test", "<div>" + "<p></p>" * 300 + "</div>")], "page_id bigint, url string, html string")
    assert dom.node_features(pages, "page_id", "html", "url").count() == 200
    assert dom.dom_nodes(pages, "page_id", "html").count() == 301


def test_attention_against_loops():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(4, 3)), rng.normal(size=(3, 2, 5))
    a, b = rng.normal(size=(2, 5)), rng.normal(size=(2, 5))
    src, dst = np.array([0, 1, 2, 3]), np.array([1, 0, 0, 0])
    h = np.stack([[x[i] @ w[:, k] for k in range(2)] for i in range(4)])
    want = np.zeros((4, 5))
    for k in range(2):
        e = [sum(h[u, k] * a[k]) + sum(h[v, k] * b[k]) for u, v in zip(src, dst)]
        e = [z if z > 0 else 0.2 * z for z in e]
        for z, u, v in zip(e, src, dst):
            want[v] += np.exp(z - max(e)) * h[u, k] / 2
    want = np.where(want > 0, want, np.exp(want) - 1)
    assert np.allclose(graph.attention(x, src, dst, w, a, b), want)
    assert len(graph.template_edges()) == 28


def test_image_hash_same_as_numpy(spark):
    url = "http://paypal.test/login"
    r = vectors.with_image_hash(spark.createDataFrame([(url,)], "url string")).first()
    v = np.random.RandomState(sum(map(ord, url)) % 10000).rand(8).astype("float32")
    v[0] += 0.5
    v[2] += 0.4
    v /= np.linalg.norm(v)
    d = [np.linalg.norm(v - np.array(ref, "float32")) for _, _, ref in vectors.REFERENCES]
    assert r.image_nearest == vectors.REFERENCES[int(np.argmin(d))][0] and r.image_distance == pytest.approx(min(d), abs=1e-4)


def test_char_tokens(spark):
    got = spark.createDataFrame([("aé漢",), ("x" * 200,)], "t string").select(char_tokens(F.col("t")).alias("c")).collect()
    assert got[0].c[:4] == [97, 233, 255, 0] and len(got[0].c) == 128 and got[1].c == [120] * 128


def test_dataset_operators(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, 1 if i < 36 else 0) for i in range(100)], "id bigint, g int, label int")
    assert dataset.drift(df).first().drifted is False
    at = df.withColumn("label", (F.col("id") < 35).cast("int"))
    assert dataset.drift(at).first().drifted is True  # in floating point, |0.35 - 0.5| is just above 0.15
    parts = {r.part: r.n for r in dataset.ordered_split(df, "id").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 80, "test": 20}
    assert dataset.ordered_split(df, "id").filter("part = 'test'").agg(F.min("id")).first()[0] == 80
    assert dataset.ordered_split(df, "id", shuffled=1).filter("part = 'test'").count() == 20
    assert dataset.ordered_split(df.filter("id < 0"), "id").count() == 0
    assert dataset.stratified(df, ["g"], "id", 5).count() == 15
    made = dataset.synthetic_features(df, "id")
    assert made.filter("label = 1 and dom_node_count >= 120").count() == 0 and made.filter("label = 0 and web_traffic < 0.7").count() == 0
    bad, good = dataset.corpus_by_class(corpus.raw_corpus(spark, None), "URL", "Label")
    assert (bad.count(), good.count()) == (4, 4)  # two addresses for each of four sources
    union = dataset.union_of({"a": bad, "b": good})
    corpus.write_table(union, str(tmp_path / "t.csv"), "csv")
    assert corpus.read_table(spark, str(tmp_path / "t.csv"), union.schema).count() == 8


def test_confusion_guards(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.4, 0), (None, 1), (0.2, None)], "p double, y int")
    r = evaluation.confusion(df, "p", "y").first()
    assert (r.tp, r.fp, r.tn, r.fn, r.accuracy) == (1, 1, 1, 0, pytest.approx(66.666667))
    empty = evaluation.confusion(df.filter("p > 2"), "p", "y").first()
    assert (empty.tp, empty.accuracy, empty.f1) == (0, 0.0, 0.0)
    assert evaluation.roc_auc(df, "p", "y").first().roc_auc == 1.0


def test_registry(spark, tmp_path):
    models = spark.createDataFrame([("m", "v1", 99.456, 1.0, 1.0, 1.0, "w")], "model_name string, version string, accuracy double, precision double, recall double, f1_score double, weights_filepath string")
    for _ in range(2):
        registry.append_models(models, str(tmp_path / "r"))
    shown = registry.listed_models(spark, str(tmp_path / "r")).collect()
    assert len(shown) == 2 and shown[0].accuracy == "99.46%" and shown[0].id != shown[1].id
    users = spark.createDataFrame([("admin",)], "name string")
    assert registry.add_missing(users, spark.createDataFrame([("admin",), ("b",), ("b",)], "name string"), "name").count() == 1


def test_crawled(spark):
    r = crawled(spark.createDataFrame([("a.test/x", "")], "url string, html string"), html="html").first()
    assert (r.domain, r.scheme) == ("a.test", "http") and r.html_length == len(r.html_content) and "Welcome to a.test" in r.html_content


def test_replies_stand_in_where_readable(spark):
    rows = [("a", 10.0, "LEGITIMATE", "rule", 'so: {"threat_score": 120, "verdict": "phishing", "reasoning": "said"} end'), ("b", 10.0, "LEGITIMATE", "rule", "no json"), ("c", 10.0, "LEGITIMATE", "rule", None), ("d", 10.0, "LEGITIMATE", "rule", '{"verdict": "maybe", "threat_score": 1}')]
    df = spark.createDataFrame(rows, "engine string, score double, verdict string, reasons string, reply string")
    got = {r.engine: (r.score, r.verdict, r.reasons) for r in panel.with_replies(df, "reply").collect()}
    assert got == {"a": (100.0, "PHISHING", "said"), **{k: (10.0, "LEGITIMATE", "rule") for k in "bcd"}}


def test_training_measures_what_was_left_out(spark):
    from lurescope.operators import training

    df = dataset.synthetic_features(spark.range(400).select(F.col("id"), (F.col("id") % 2).cast("int").alias("label")), "id")
    df = df.withColumn("favicon", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("favicon")))
    _, measures = training.retrained(df, "id")
    r = measures.first()
    assert 40 < r.tp + r.fp + r.tn + r.fn < 120 and r.accuracy > 95
