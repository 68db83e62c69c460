"""Odd inputs of the operators beside their SQL: empty lists, stored weights, registry, hostile pages, graph stand-ins."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurescope.operators import dataset, dom, fusion, graph, panel, training, vectors
from lurescope.sources import corpus, registry

ENGINES = [(0, "Oxmere Large", 0.9), (1, "Veldrin 2", None), (2, "Tarnbeam 7B", 0.8)]


@pytest.fixture
def engines(spark):
    return spark.createDataFrame(ENGINES, "ord int, name string, reliability double")


def test_empty_input_is_refused(spark, engines):
    for url in (None, "", " \n"):
        with pytest.raises(ValueError, match="empty"):
            fusion.scan_one(url, engines)
    with pytest.raises(ValueError, match="empty"):
        fusion.batch_scan(spark.createDataFrame([], "url string"), engines)
    assert fusion.scan_one("  http://a.test/ ", engines).first().url == "http://a.test/"


def test_first_ten_before_blanks(spark, engines):
    rows = spark.createDataFrame([(i, " " if i < 4 else f" http://a.test/{i} ") for i in range(30)], "i int, url string")
    got = {r.url for r in fusion.batch_scan(rows, engines, first=10, order=["i"]).collect()}
    assert got == {f"http://a.test/{i}" for i in range(4, 10)}


def test_panel_in_the_row_is_the_panel(spark, engines):
    rows = panel.with_points(fusion.with_lexical(spark.createDataFrame([(i, u) for i, u in enumerate(["http://paypal.verify.test/login", "https://a.test", None, "http://1.2.3.4/bank"])], "i int, url string")))
    votes = panel.fan_out(rows, engines)
    want = {r.i: tuple(r)[1:] for r in panel.pooled(votes, ["i"]).collect()}
    got = {r.i: (r.phishing_votes, r.legitimate_votes, r.llm_score, r.agreement, r.consensus) for r in panel.pooled_in_row(rows, engines).collect()}
    assert got == want
    said = {r.i: r.evidence for r in panel.evidence_in_row(rows, engines, 2).filter("evidence is not null").collect()}
    assert said == {r.i: r.evidence for r in panel.evidence(votes, ["i"], 2).collect()} and said


def test_answers_are_read_first(spark):
    rows = [(1, 1, "A-b", "phish", 0.9, "2026-01-01"), (2, 1, "a B", "SAFE", 0.2, "2026-01-02"), (3, 2, "ab", None, 0.7, "2026-01-01"), (4, 2, "C", "Not Phishing", 130.0, "2026-01-01"), (5, 3, "C", None, None, "2026-01-01"), (6, 3, None, "SAFE", 1.0, "2026-01-01")]
    df = spark.createDataFrame(rows, "result_id bigint, scan_id bigint, engine string, verdict string, threat_score double, at string").withColumn("answered_at", F.col("at").cast("timestamp"))
    got = {(r.scan_id, r.engine): (r.verdict, r.score) for r in panel.read_answers(df).collect()}
    assert got == {(1, "ab"): ("LEGITIMATE", 20.0), (2, "ab"): ("PHISHING", 70.0), (2, "c"): ("LEGITIMATE", None)}


def test_weights_are_stored(spark, tmp_path):
    made = graph.seeded_weights(3)
    graph.save_weights(spark, made, f"{tmp_path}/w")
    read = graph.load_weights(spark, f"{tmp_path}/w")
    assert read.keys() == made.keys() and all((read[k] == made[k]).all() and read[k].shape == made[k].shape for k in made)
    assert (graph.load_weights(spark, None)["w1"] == graph.seeded_weights()["w1"]).all()


def test_every_page_has_a_graph_and_a_score(spark):
    pages = spark.createDataFrame([(1, "u", ""), (2, "u", None), (3, "u", " \n\t"), (4, "u", "plain text"), (5, "u", "<p>x</p>"), (6, "u", "<div><a href='#'>y</a></div>")], "k int, url string, html string")
    nodes = dom.node_features(pages, "k", "html", "url")
    scores = {r.k: r.gnn_score for r in graph.graph_scores(nodes, "k").collect()}
    assert set(scores) == {1, 2, 3, 4, 5, 6} and scores[1] == scores[2] == scores[3] != scores[4]
    edges = {}
    for r in dom.graph_edges(nodes, "k").collect():
        edges.setdefault(r.k, set()).add((r.src, r.dst))
    blank = {(0, 1), (0, 2), (1, 2), (1, 3)}
    assert edges == {1: blank, 2: blank, 3: blank, 4: {(0, 1), (1, 2)}, 5: {(0, 0)}, 6: {(0, 1), (1, 0)}}
    x = np.zeros((5, 14), "float32")
    x[0, 0] = x[1, 1] = x[2, 2] = 1
    assert abs(scores[1] - graph.forward(x, np.array([0, 0, 1, 1]), np.array([1, 2, 2, 3]), graph.seeded_weights())[1]) < 1e-6
    stats = {r.k: (r.node_count, r.edge_count) for r in dom.graph_stats(pages, "k", "html", "url").collect()}
    assert stats == {1: (5, 4), 2: (5, 4), 3: (5, 4), 4: (3, 2), 5: (1, 1), 6: (2, 2)}


def test_unmatched_end_tags_take_linear_time():
    began = time.process_time()
    assert len(dom.elements("<b>" * 40_000 + "</i>" * 40_000)) == 40_000
    assert time.process_time() - began < 5
    assert [r[1] for r in dom.elements("<a><b><c></a><d></b><e>")] == [None, 0, 1, None, 3]


def test_retraining_is_registered(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else float(i % 2), i % 2) for i in range(400)], "id int, a double, b double, label int")
    training.retrained_and_registered(rows, "id", f"{tmp_path}/registry", f"{tmp_path}/model", version="v1")
    training.retrained_and_registered(rows, "id", f"{tmp_path}/registry", f"{tmp_path}/model")
    listed = registry.listed_models(spark, f"{tmp_path}/registry").collect()
    assert len(listed) == 2 and listed[0].version != listed[1].version and all(r.accuracy.endswith("%") for r in listed)


def test_table_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        raw = dataset.fallback_corpus(spark)
        made = dataset.training_set(raw, "URL", "Label", total=8)
        return made.withColumn("label", F.col("label").cast("int"))

    for _ in range(2):
        got = corpus.read_or_build(spark, f"{tmp_path}/t", build)
        assert got.count() == 8 and got.columns == corpus.TRAINING.names
    assert len(calls) == 1
    assert dataset.fallback_corpus(spark).count() == 8


def test_buckets_hold_with_an_outlying_key(spark):
    """One far key must not put all others into one bucket: the order is right and ranks are whole whatever the keys."""
    rows = spark.createDataFrame([(i,) for i in range(1000)] + [(1 << 60,)], "k bigint")
    got = dataset.ordered_split(rows, "k")
    assert got.filter("part = 'train'").agg(F.max("k"), F.count(F.lit(1))).first() == (799, 800)
    assert dataset.ordered_split(rows.filter("k < 0"), "k").count() == 0


def test_images_are_made_once_a_session(spark):
    assert vectors.image_table(spark) is vectors.image_table(spark)
    assert vectors.screenshot_report(spark.createDataFrame([(1, None), (2, "")], "i int, url string"), "i").count() == 2
