"""Every query of the engine by name, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.functions import scores
from lurescope.functions.rules import RULES, hit
from lurescope.functions.scripts import markup_flags, with_script_signals
from lurescope.functions.urls import char_tokens, code_sum, for_corpus, for_parsing, with_domain
from lurescope.operators import dataset, dom, evaluation, fusion, graph, panel, vectors
from lurescope.operators import training as learning
from lurescope.plans import oracle, oracle_scores
from lurescope.plans.oracle_pages import SNIPPETS
from lurescope.session import table
from lurescope.sources.pages import crawled
from lurescope.sources.registry import latest_deliveries, opened_scores
from lurescope.streaming.scoring import drift_stream

MAIN = "merged_phishing_multimodal_dataset"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL = {**oracle.SQL, **oracle_scores.SQL}


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[make.__name__] = make
    return make


def training(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, MAIN)


def urls(spark: SparkSession, d: str) -> DataFrame:
    return training(spark, d).select("record_id", "url")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """``page_id, url, html``: the documents' whole texts, all of them, most behind a snippet of markup."""
    n, html = len(SNIPPETS), F.col("text")
    for k, snippet in enumerate(SNIPPETS):
        html = F.when(F.pmod("doc_id", F.lit(n + 2)) == k, F.concat(F.lit(snippet), F.coalesce("text", F.lit("")))).otherwise(html)
    return table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://"), "site_host").alias("url"), html.alias("html"))


def panel_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = training(spark, d).select("record_id", "url", "sfh_external", "iframe_hidden", "url_of_anchor_ratio")
    return fusion.with_lexical(rows)


def ruled(spark: SparkSession, d: str, rule: Callable[[Column], dict[str, Column]]) -> DataFrame:
    return urls(spark, d).withColumn("_u", F.lower("url")).select("record_id", *scores.columns(rule(F.col("_u"))))


@query
def url_lexical_features(spark: SparkSession, d: str) -> DataFrame:
    return fusion.with_lexical(urls(spark, d)).drop("url", "domain")


@query
def url_host_extract(spark: SparkSession, d: str) -> DataFrame:
    staged = with_domain(urls(spark, d))
    return staged.select("record_id", "domain", for_corpus(F.col("url")).alias("corpus_url"), for_parsing(F.col("url")).alias("parsed_url"))


@query
def url_length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return fusion.with_lexical(urls(spark, d)).groupBy("url_length_score").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("url_length"), 6).alias("mean_length"))


@query
def keyword_intent_flags(spark: SparkSession, d: str) -> DataFrame:
    staged = urls(spark, d).withColumn("_u", F.lower("url"))
    return staged.select("record_id", *[hit(r, F.col("url") if r == "browser_fallback" else F.col("_u")).cast("int").alias(r) for r in RULES])


@query
def js_signal_counts(spark: SparkSession, d: str) -> DataFrame:
    return with_script_signals(pages(spark, d), "html").drop("url", "html")


@query
def html_string_flags(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", *scores.columns(markup_flags(F.coalesce("html", F.lit("")))))


@query
def dom_node_list(spark: SparkSession, d: str) -> DataFrame:
    return dom.dom_nodes(pages(spark, d), "page_id", "html")


@query
def dom_structure_features(spark: SparkSession, d: str) -> DataFrame:
    return dom.dom_features(pages(spark, d), "page_id", "html", "url")


@query
def dom_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return dom.graph_stats(pages(spark, d), "page_id", "html", "url")


@query
def dom_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return dom.graph_edges(dom.node_features(pages(spark, d), "page_id", "html", "url"), "page_id")


@query
def dom_node_features(spark: SparkSession, d: str) -> DataFrame:
    """The features of real elements, the one-hot place as a number."""
    nodes = dom.node_features(pages(spark, d), "page_id", "html", "url").filter("stand_in is null")
    at = lambda k: F.round(F.element_at("x", k + 1), 6)
    place = F.array_position(F.slice("x", 1, 10), 1.0).cast("int") - 1
    return nodes.select("page_id", "idx", place.alias("place"), at(11).alias("external"), at(12).alias("hides"), at(10).alias("depth"), at(13).alias("children"))


@query
def graph_model_scores(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_scores(dom.node_features(pages(spark, d), "page_id", "html", "url"), "page_id")


@query
def training_graphs(spark: SparkSession, d: str) -> DataFrame:
    return graph.template_graph(training(spark, d), "record_id").select("record_id", "node", F.array_join(F.transform("x", lambda v: F.round(v, 6).cast("string")), ",").alias("x"))


@query
def crawled_pages(spark: SparkSession, d: str) -> DataFrame:
    return crawled(urls(spark, d)).select("record_id", "domain", "scheme", "html_length", F.element_at("headers", "server").alias("server"))


@query
def whois_rules(spark: SparkSession, d: str) -> DataFrame:
    return ruled(spark, d, scores.whois)


@query
def ssl_rules(spark: SparkSession, d: str) -> DataFrame:
    return ruled(spark, d, scores.ssl)


@query
def threat_intel_rules(spark: SparkSession, d: str) -> DataFrame:
    return ruled(spark, d, scores.threat_intel)


@query
def classical_ensemble_score(spark: SparkSession, d: str) -> DataFrame:
    return ruled(spark, d, scores.classical)


@query
def anomaly_score(spark: SparkSession, d: str) -> DataFrame:
    return ruled(spark, d, scores.anomaly)


@query
def text_intent_score(spark: SparkSession, d: str) -> DataFrame:
    return ruled(spark, d, scores.text_intent)


@query
def brand_match_score(spark: SparkSession, d: str) -> DataFrame:
    return ruled(spark, d, scores.brand_logo)


@query
def layout_match_score(spark: SparkSession, d: str) -> DataFrame:
    return ruled(spark, d, scores.page_layout)


@query
def image_hash_score(spark: SparkSession, d: str) -> DataFrame:
    return vectors.with_image_hash(urls(spark, d)).drop("url")


@query
def hybrid_visual_verdict(spark: SparkSession, d: str) -> DataFrame:
    return vectors.hybrid_visual(urls(spark, d), "record_id")


@query
def screenshot_report(spark: SparkSession, d: str) -> DataFrame:
    return vectors.screenshot_report(urls(spark, d), "record_id")


@query
def member_predictions(spark: SparkSession, d: str) -> DataFrame:
    return ruled(spark, d, scores.members)


@query
def ensemble_importances(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(scores.IMPORTANCES, "feature string, importance double")


@query
def dns_report(spark: SparkSession, d: str) -> DataFrame:
    facts = scores.whois(F.lower("url"))
    return with_domain(urls(spark, d)).select("record_id", "domain", *scores.columns({k: facts[k] for k in ("has_mx_record", "has_spf_record")}))


@query
def text_report(spark: SparkSession, d: str) -> DataFrame:
    """The text model's sub-report with the first two codes it reads and how many of its 128 places a URL fills."""
    said, tokens = scores.text_intent(F.lower("url")), char_tokens(F.col("url"))
    return urls(spark, d).select("record_id", said["text_score"].alias("text_score"), said["intent"].alias("intent"), F.array_join(F.slice(tokens, 1, 2), ",").alias("first_codes"), F.size(F.filter(tokens, lambda c: c > 0)).alias("filled"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    return panel.fan_out(panel.with_points(panel_rows(spark, d)), table(spark, d, "engines"))


@query
def engine_catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "engines").select("ord", F.regexp_replace(F.lower("name"), "[^a-z0-9]", "").alias("engine_id"), "name", "developer", "weight", "reliability", code_sum(F.col("name")).alias("name_sum"))


@query
def engine_fanout_scores(spark: SparkSession, d: str) -> DataFrame:
    return votes(spark, d).select("record_id", "engine", F.round("score", 6).alias("score"), "verdict")


@query
def engine_lookup_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return panel.matched_engines(table(spark, d, "engine_results").withColumnRenamed("engine", "asked"), table(spark, d, "engines"), "asked")


@query
def consensus_pooling(spark: SparkSession, d: str) -> DataFrame:
    rows = panel.pooled_in_row(panel.with_points(panel_rows(spark, d)), table(spark, d, "engines"))
    return rows.select("record_id", "phishing_votes", "legitimate_votes", F.col("llm_score").alias("pooled_score"), "agreement", "consensus")


@query
def engine_comparison(spark: SparkSession, d: str) -> DataFrame:
    return panel.compared(panel.read_answers(table(spark, d, "engine_results")), ["scan_id"], 6)


@query
def evidence_top4(spark: SparkSession, d: str) -> DataFrame:
    rows = panel.evidence_in_row(panel.with_points(panel_rows(spark, d)), table(spark, d, "engines"))
    return rows.filter("evidence is not null").select("record_id", "evidence")


def reports(spark: SparkSession, d: str, image: bool = False) -> DataFrame:
    rows = training(spark, d).select("record_id", "url", "sfh_external", "iframe_hidden", "url_of_anchor_ratio")
    if image:
        rows = vectors.with_image_hash(rows).withColumnRenamed("image_score", "_image").drop("image_nearest", "image_distance", "image_phishing")
    return fusion.fused(fusion.with_scores(rows, table(spark, d, "engines"), image=F.col("_image") if image else None))


REPORT = ["record_id", "llm_score", "visual_score", "intel_score", "verdict", "threat_score", "risk_level", "attack_category", "confidence", "action"]


@query
def fusion_verdict(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d).withColumn("intel_score", F.round("intel_score", 6)).select(*REPORT)


@query
def fusion_verdict_image(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d, image=True).select(*REPORT)


@query
def attack_category(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d).groupBy("attack_category", "risk_level").agg(F.count(F.lit(1)).alias("n"))


@query
def evidence_matrix_long(spark: SparkSession, d: str) -> DataFrame:
    return fusion.evidence_matrix(reports(spark, d), "record_id")


@query
def report_json(spark: SparkSession, d: str) -> DataFrame:
    return fusion.as_json(reports(spark, d), "record_id")


@query
def batch_scan_report(spark: SparkSession, d: str) -> DataFrame:
    scans = table(spark, d, "scan_results").select(F.col("target_url").alias("url"))
    return fusion.batch_scan(scans, table(spark, d, "engines"))


@query
def batch_scan_first10(spark: SparkSession, d: str) -> DataFrame:
    """The batch route: the first ten of the list, of which blanks are then left out; the limit is the feature."""
    scans = table(spark, d, "scan_results").select("id", "ingested_at", F.col("target_url").alias("url"))
    return fusion.batch_scan(scans, table(spark, d, "engines"), first=10, order=["id", "ingested_at"])


@query
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return dataset.balance(training(spark, d))


@query
def class_balance_by_source(spark: SparkSession, d: str) -> DataFrame:
    return dataset.balance(training(spark, d), ["dataset_source"])


@query
def drift_by_source(spark: SparkSession, d: str) -> DataFrame:
    return dataset.drift(training(spark, d), ["dataset_source"])


@query
def drift_overall(spark: SparkSession, d: str) -> DataFrame:
    return dataset.drift(training(spark, d))


@query
def drift_daily(spark: SparkSession, d: str) -> DataFrame:
    return drift_stream(training(spark, d).filter("collected_at is not null"), "collected_at", "label")


@query
def dataset_preview(spark: SparkSession, d: str) -> DataFrame:
    return dataset.preview(training(spark, d).select("record_id", "url", "label"), "record_id")


@query
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(training(spark, d), "url_of_anchor_ratio", "label")


@query
def per_source_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.accuracy_by(training(spark, d), "url_of_anchor_ratio", "label", ["dataset_source"])


@query
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.roc_auc(training(spark, d), "url_of_anchor_ratio", "label")


@query
def reviewed_scan_quality(spark: SparkSession, d: str) -> DataFrame:
    scans = latest_deliveries(table(spark, d, "scan_results").select("id", "overall_threat_score", "ingested_at"), "id", "ingested_at")
    truth = table(spark, d, "scan_labels").select(F.col("scan_id").alias("id"), (F.col("verdict") == "PHISHING").cast("int").alias("label"))
    return evaluation.confusion(scans.join(truth, "id"), "overall_threat_score", "label", cut_at=50.0)


@query
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return dataset.stratified(training(spark, d).select("record_id", "dataset_source", "label"), ["dataset_source", "label"], "record_id", 3, F.col("record_id"))


@query
def ordered_split(spark: SparkSession, d: str) -> DataFrame:
    return dataset.ordered_split(training(spark, d).select("record_id"), "record_id")


@query
def shuffled_split(spark: SparkSession, d: str) -> DataFrame:
    return dataset.ordered_split(training(spark, d).select("record_id"), "record_id", shuffled=42)


@query
def bounded_samples(spark: SparkSession, d: str) -> DataFrame:
    """At most 1,000 rows of the training part and 400 of the test part; the bounds are the feature."""
    parts = dataset.ordered_split(training(spark, d).select("record_id"), "record_id", shuffled=42)
    return dataset.bounded_sample(parts.filter("part = 'train'"), "record_id", 1000).unionByName(dataset.bounded_sample(parts.filter("part = 'test'"), "record_id", 400))


@query
def source_catalog(spark: SparkSession, d: str) -> DataFrame:
    return dataset.source_catalog(spark)


@query
def fallback_rows(spark: SparkSession, d: str) -> DataFrame:
    bad, good = dataset.corpus_by_class(dataset.fallback_corpus(spark), "URL", "Label")
    return bad.unionByName(good).groupBy("url", "label").agg(F.count(F.lit(1)).alias("rows"))


@query
def training_set(spark: SparkSession, d: str) -> DataFrame:
    """A training set built anew from the addresses of the table: 10,000 rows where it has as many."""
    raw = training(spark, d).filter("label is not null").select("url", F.when(F.col("label") == 1, "Bad").otherwise("good").alias("label"))
    return dataset.training_set(raw, "url", "label")


@query
def feature_means(spark: SparkSession, d: str) -> DataFrame:
    return dataset.feature_means(training(spark, d).drop("record_id"))


@query
def epoch_measures(spark: SparkSession, d: str) -> DataFrame:
    """Loss and accuracy of five rounds of predictions, here a feature that gets the more weight the later the round."""
    each = training(spark, d).select("label", "url_of_anchor_ratio", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("epoch"))
    return evaluation.epoch_measures(each.withColumn("prob", F.col("url_of_anchor_ratio") * F.col("epoch") / 5), "epoch", "prob", "label")


@query
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return dataset.found(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_name", "Customer#000000007")


@query
def source_union(spark: SparkSession, d: str) -> DataFrame:
    frames = {"training": training(spark, d).select("url"), "scans": table(spark, d, "scan_results").select(F.col("target_url").alias("url"))}
    return dataset.union_of(frames).groupBy("dataset_source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("url")).alias("chars"))


@query
def scan_deliveries(spark: SparkSession, d: str) -> DataFrame:
    scans = table(spark, d, "scan_results").select("id", "target_url", "verdict", "overall_threat_score", "ingested_at")
    return latest_deliveries(scans, "id", "ingested_at").drop("ingested_at")


@query
def scan_modality_scores(spark: SparkSession, d: str) -> DataFrame:
    each = opened_scores(table(spark, d, "scan_results").distinct()).select(F.inline("scores"))
    return each.groupBy("key").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean_score"))


@query
def nearest_reference_vector(spark: SparkSession, d: str) -> DataFrame:
    vecs = table(spark, d, "embeddings")
    refs = vecs.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    found = vectors.nearest(vecs, "vec_id", "embedding", refs, "label", "ref", "label")
    return found.select("vec_id", "nearest", F.round("distance", 4).alias("distance"))


@query
def pooled_embedding(spark: SparkSession, d: str) -> DataFrame:
    pooled = graph.pooled_vectors(table(spark, d, "embeddings"), ["label"], "embedding", 64)
    return pooled.select("label", F.posexplode("pooled").alias("dim", "value")).select("label", "dim", F.round("value", 5).alias("value"))


@query
def graph_degree_density(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    each = graph.degrees(edges, "src", "dst")
    total = each.agg(F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("ends"), F.max("degree").alias("most"))
    return total.select("nodes", F.col("ends").alias("edges_both_ways"), "most", F.round(graph.density(F.col("nodes"), F.col("ends")), 9).alias("density"))


@query
def message_passing_sum(spark: SparkSession, d: str) -> DataFrame:
    edges, parts = table(spark, d, "lineitem").select("l_partkey", "l_suppkey"), table(spark, d, "part")
    return graph.message_sum(edges, parts, "l_partkey", "l_suppkey", "p_partkey", "p_retailprice").select("l_suppkey", F.round("message", 2).alias("message"))


@query
def char_token_rows(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).select("record_id", F.array_join(F.transform(char_tokens(F.col("url")), lambda c: c.cast("string")), ",").alias("tokens"), code_sum(F.col("url")).alias("code_sum"))


@query
def synthetic_training_set(spark: SparkSession, d: str) -> DataFrame:
    return dataset.synthetic_features(training(spark, d).select("record_id", "url", "label"), "record_id")


@query
def trained_classifier_quality(spark: SparkSession, d: str) -> DataFrame:
    return learning.retrained(training(spark, d).drop("url", "dataset_source", "collected_at"), "record_id")[1]


@query
def replied_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The panel with the recorded answers of engines on training rows of the same address in place of rule scores."""
    scans = latest_deliveries(table(spark, d, "scan_results").select("id", "target_url", "ingested_at"), "id", "ingested_at").select(F.col("id").alias("scan_id"), F.col("target_url").alias("url"))
    recorded, engines = table(spark, d, "engine_results"), table(spark, d, "engines")
    answers = panel.by_catalog_name(panel.read_answers(recorded), engines, "engine")
    raw = F.to_json(F.struct(F.col("score").alias("threat_score"), "verdict"))
    asked = fusion.with_lexical(scans.join(recorded.select("scan_id").distinct(), "scan_id", "left_semi"))
    given = answers.select("scan_id", "engine", raw.alias("reply"))
    each = panel.fan_out(panel.with_points(asked), engines).select("scan_id", "engine", "ord", "reliability", "score", "verdict", "reasons")
    return panel.pooled(panel.with_replies(each.join(given, ["scan_id", "engine"], "left"), "reply"), ["scan_id"])
