"""Pages of the catalog: every document's text is on its page, and only blank texts give empty pages."""

from lurescope.operators import dom
from lurescope.plans import catalog
from lurescope.plans.oracle_pages import SNIPPETS

DOCS = "doc_id bigint, text string, site_host string"


def test_every_text_is_on_its_page(spark, tmp_path):
    n = len(SNIPPETS) + 2
    rows = [(i, f"<p>text {i}</p>", "a.test") for i in range(-n, 2 * n)] + [(None, "<p>no id</p>", "a.test")]
    empty = {2 * n + 4: None, 2 * n + 5: "", 3 * n + 4: " ", 3 * n + 5: None}
    rows += [(i, text, "a.test") for i, text in empty.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.page_id: r.html for r in catalog.pages(spark, str(tmp_path)).collect()}
    assert all((got[i] or "").endswith(text) for i, text, _ in rows if i not in empty)
    assert all(got[i] == text for i, text in empty.items())
    nodes = {r.page_id for r in catalog.QUERIES["dom_node_list"](spark, str(tmp_path)).collect()}
    assert nodes == {i for i, *_ in rows if i not in empty}
    features = {r.page_id: r.dom_node_count for r in catalog.QUERIES["dom_structure_features"](spark, str(tmp_path)).collect()}
    stand_in = dom.EMPTY["dom_node_count"]
    assert {i for i, count in features.items() if count == stand_in} == {i for i, text in empty.items() if not text}


def test_texts_of_the_table_are_on_their_pages(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.page_id: r.html for r in catalog.pages(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    assert all((got[i] or "").endswith(text or "") for i, text in texts.items())
