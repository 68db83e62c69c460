"""Problem 4: copies that split differently into path and parameters."""

import pytest

from lurescope.llm import overlaps

LONGER = ["http://h.test/?ab=12345&c=2", "http://h.test/a?b=12345&c=2", "http://h.test/ab?12345=&c=2"]
SHORTER = ["http://h.test/?c=2", "http://h.test/a?c=2", "http://h.test/ab?c=2"]


@pytest.mark.parametrize("train", ["longer", "shorter"])
def test_every_marking_counts(spark, train):
    """Each shorter address is one of the copies without a parameter, so it meets all of them; a row outside the splits adds nothing."""
    urls = [*LONGER, *SHORTER, "http://h.test/?ab123=45&c=2", "http://h.test/ab12345?c=2"]
    df = spark.createDataFrame(list(enumerate(urls)), "record_id int, url string")
    of = lambda i: "train" if (i < 3) == (train == "longer") else "test"
    splits = spark.createDataFrame([(i, of(i)) for i in range(6)], "record_id int, split string")
    got = {(r.train_id, r.other_id): r.kind for r in overlaps.overlaps(df, splits, edits=1).collect()}
    pairs = [(i, j) for i in range(3) for j in range(3, 6)]
    assert got == {(i, j) if train == "longer" else (j, i): "parameter" for i, j in pairs}
