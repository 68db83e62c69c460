"""Every query of the subpackage runs, with the columns it should have."""

import pytest

from lurescope.llm.queries import QUERIES

COLUMNS = {"p1_found": ["scan_id"], "p2_found": ["tbl", "id_a", "id_b"], "p3_found": ["source_a", "source_b"], "p4_found": ["id_a", "id_b"], "p7_found": ["doc_id", "subject"]}


@pytest.mark.parametrize("name", list(QUERIES))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(rows))


def test_every_row_gets_a_split(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/merged_phishing_multimodal_dataset.parquet")
    made = QUERIES["p3_splits"](spark, sf_dir)
    assert made.count() == rows.count() == made.select("record_id").distinct().count()
