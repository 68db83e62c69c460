"""Recorded answers count for their engine in any spelling of its name."""

from lurescope.plans import catalog


def test_answers_under_other_spellings(spark, tmp_path):
    names = ["Oxmere Large", "Veldrin 2", "Tarnbeam 7B"]
    spark.createDataFrame([(k, n, 0.9) for k, n in enumerate(names)], "ord int, name string, reliability double").write.parquet(f"{tmp_path}/engines.parquet")
    said = {
        1: names, 2: ["OXMERE LARGE", "veldrin-2", "Tarnbeam_7B"], 3: ["Oxmere Large", "oxmere large ", "Veldrin 2", "VELDRIN2", "tarnbeam7b"],
        4: ["Oxmere", "Unheard Of", "--", None], 5: [],
    }
    rows = [(i, n, "PHISHING", 97.0) for i, given in said.items() for n in given]
    spark.createDataFrame(rows, "scan_id bigint, engine string, verdict string, threat_score double").write.parquet(f"{tmp_path}/engine_results.parquet")
    scans = spark.createDataFrame([(i, "http://a.test/x", "2026-01-01") for i in said], "id bigint, target_url string, at string")
    scans.selectExpr("id", "target_url", "cast(at as timestamp) as ingested_at").write.parquet(f"{tmp_path}/scan_results.parquet")
    got = {r.scan_id: (r.phishing_votes, r.pooled_score) for r in catalog.QUERIES["replied_consensus"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1] == got[2] == got[3] and got[1][0] == 3 and got[1][1] > 90
    assert got[4][0] == 0
