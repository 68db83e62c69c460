"""Problem 4: the counts of overlaps against brute force over their pairs."""

import collections
import random

from lurescope.llm import overlaps


def test_counts_are_exact(spark):
    """Groups of hundreds of copies, gaps in labels and sources, splits in any spelling, rows in several splits or delivered twice."""
    rng = random.Random(3)
    addresses = [f"http://h{i % 5}.test/{'x' * (i % 7)}?{'&'.join(f'k{j}={i}{j}99' for j in range(i % 4))}" for i in range(60)]
    rows = [(i, rng.choice([addresses[0], *addresses]) if i % 3 else addresses[0], rng.choice(["a/x", "b/y", None]), rng.choice([0, 1, 2, None]), "x") for i in range(900)] + [(2000, None, "a/x", 1, "x"), (None, addresses[0], "a/x", 1, "x")]
    split = [(i, rng.choice(["train", "train", "test", "validation"])) for i in range(900)]
    extra = [(i, "test") for i in range(0, 900, 9)] + [(i, " Train ") for i in range(0, 900, 14)] + [(5, None), (6, " "), (None, "test"), (2000, "test"), (7, "TEST"), (7, "test")]
    df = spark.createDataFrame(rows + rows[:50], "record_id bigint, url string, dataset_source string, label int, kind string")
    splits = spark.createDataFrame(split + extra, "record_id bigint, split string")
    got = {(r.split, r.dataset_source, r.kind): (r.pairs, r.rows_touched, r.labels_differ) for r in overlaps.overlap_counts(df, splits).collect()}
    pairs = overlaps.overlaps(df, splits).collect()
    source, label = {i: s for i, _, s, _, _ in rows}, {i: x for i, _, _, x, _ in rows}
    listed = collections.defaultdict(set)
    for i, s in split + extra:
        if s and s.strip() and s.strip().lower() != "train":
            listed[i].add(s.strip().lower())
    count, touched, differ = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for t, o, kind in pairs:
        for s in listed[o]:
            at = s, source[o], kind
            count[at] += 1
            touched[at].add(o)
            differ[at] += None not in (label[t], label[o]) and label[t] != label[o]
    assert got == {at: (n, len(touched[at]), differ[at]) for at, n in count.items()}
    assert max(count.values()) > 5_000 and {k for _, _, k in count} == set(overlaps.KINDS)
    assert overlaps.overlap_counts(df.filter("record_id < 0"), splits).count() == 0
    assert overlaps.overlap_counts(df, splits.filter("record_id < 0")).count() == 0
