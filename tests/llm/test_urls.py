"""Problems 2 to 4: keys, copies, sites, components, splits and overlaps."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lurescope.llm import copies, groups, overlaps
from lurescope.llm.urlkeys import site, with_host, with_key

BASE = "http://www.abc-shop.example/login/page.php?tok=a1b2&from=last+notice"
SAME = [
    "HTTP://WWW.abc-shop.EXAMPLE/login/page.php?tok=a1b2&from=last+notice", "www.abc-shop.example/login/page.php?from=last+notice&tok=a1b2", "http://www[.]abc-shop[.]example/login/page.php?tok=a1b2&amp;from=last%20notice",
    "<http:\\\\www.abc-shop.example/log​in/page.php/?tok=a1=\nb2;from=last+notice>", "- http:///www.abc-shop.example./login/./p%61ge.php?&from=last+notice&tok=a1b2#", "//www.abc-shop.example/login/page.php?tok=a1b2&from=last+notice\r\n",
    "http[:]//www(.)abc-shop(.)example/login/page.php?tok=A1B2&&from=last+notice",
]
OTHER = ["https://www.abc-shop.example/login/page.php?tok=a1b2&from=last+notice", "http://abc-shop.example/login/page.php?tok=a1b2&from=last+notice", "http://www.abc-shop.example/page/login.php?tok=a1b2&from=last+notice", "http://www.abc-shop.example/login/page.php?tok=a1b3&from=last+notice"]


def keys(spark, urls):
    rows = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    return [r.key for r in with_key(rows, "url").orderBy("i").collect()]


def test_keys(spark):
    got = keys(spark, [BASE, *SAME, *OTHER])
    assert set(got[: 1 + len(SAME)]) == {got[0]}
    assert len(set(got)) == 1 + len(OTHER)
    assert keys(spark, [None, "", "x%ZZ%", "%E9%"]) == [None, "http", "httpxzz", "http"]


TABLE = "tbl string, id bigint, url string, k1 string, _id string, copies string"


def table_of(spark, urls, tbl="t"):
    return spark.createDataFrame([(tbl, i, u, "a", "b", "c") for i, u in enumerate(urls)], TABLE)


def test_copies(spark):
    df = table_of(spark, [OTHER[0], *SAME, BASE, None, None, "", " ", "x" * 100_000, "X" * 100_000])
    df = df.unionByName(df.filter("id = 3")).unionByName(table_of(spark, [BASE], "u"))
    got = {(r.tbl, r.id_a, r.id_b, r.copies) for r in copies.copy_classes(df, "id", "url", ["tbl"]).collect()}
    n = len(SAME)
    want = {("t", 1, i, n + 1) for i in range(1, n + 2)} | {("t", n + 4, i, 2) for i in (n + 4, n + 5)} | {("t", n + 6, i, 2) for i in (n + 6, n + 7)}
    assert got == want
    records = {(r.tbl, r.id): r.copies for r in copies.collapsed(df, "id", "url", ["tbl"]).collect()}
    assert records[("t", 1)] == n + 1 and records[("t", 0)] == 1 and records[("t", n + 2)] == 1 and len(records) == 7
    assert copies.copy_classes(df.filter("id < 0"), "id", "url", ["tbl"]).count() == 0
    assert copies.collapsed(df.filter("id < 0"), "id", "url").count() == 0


def test_invariant_of_long_texts(spark):
    """The count of letters runs over at 2^18 of them; the order of the parts must not show even there."""
    n = 1 << 18
    made = [("http" + "a" * x + "b" * (n - x - 4 + more), "http" + "b" * (n - x - 4 + more) + "a" * x) for x in (1, 1000, n // 2) for more in (-1, 0, 1)]
    rows = spark.createDataFrame(made, "u string, v string")
    assert rows.filter(copies.invariant(F.col("u")) != copies.invariant(F.col("v"))).count() == 0


def test_invariant_is_one(spark):
    rows = spark.createDataFrame([(u,) for u in [BASE, *SAME]], "url string")
    assert rows.select(copies.invariant(F.col("url"))).distinct().count() == 1


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://u@a.pagecraft.example:8443/x", "a.pagecraft.example"), ("https://bank.example@evil.test/", "evil.test"), ("HTTP:\\\\www.A.co.example.\\x", "a.co.example"),
        ("http:///10.1.2.3:80/x", "10.1.2.3"), ("http://167838211/x", "10.1.2.3"), ("http://0xa010203", "10.1.2.3"), ("x.y.test/p?u=http://z.example/", "y.test"), ("http://pagecraft.example/", "pagecraft.example"),
        ("(https://www[.]b(.)test/a)", "b.test"), ("http://%61.test/", "a.test"), ("http://nosuffix", "nosuffix"), ("", None), (None, None), ("http://", None), ("http://b.te​st?x@y.example", "b.test"),
    ],
)
def test_sites(spark, url, want):
    df = with_host(spark.createDataFrame([(url,)], "url string"), "url", "h")
    assert df.select(site(F.col("h"), ["example", "test", "co.example", "pagecraft.example"]).alias("s")).first().s == want


def plain_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(40 - i, 39 - i) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 5), (1, 2)], [], [(1, 2), (2, 1), (1, 2)], "random"])
def test_components(spark, edges):
    if edges == "random":
        rng = random.Random(5)
        edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)]
    df = spark.createDataFrame([*edges, (None, 3)], "u bigint, v bigint")
    assert {r.id: r.component for r in groups.components(df).collect()} == plain_components(edges)


def test_subset_sums():
    rng = random.Random(2)
    for _ in range(60):
        sizes = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        target = rng.randint(0, sum(s * n for s, n in sizes.items()))
        got = groups.subset_counts(sizes, target)
        assert all(0 <= got[s] <= sizes[s] for s in got)
        reachable = {sum(s * k for s, k in zip(sizes, ks)) for ks in itertools.product(*[range(n + 1) for n in sizes.values()])}
        assert abs(sum(s * n for s, n in got.items()) - target) == min(abs(r - target) for r in reachable)


def totals(got):
    return {k: sum(s * n for s, n in got[k].items()) for k in got}


def test_allocation_is_whole_and_near():
    sizes = {5000: 1, 900: 3, 40: 50, 1: 3000}
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    for core in (1 << 23, 2000, 10):
        got = groups.allocate(sizes, shares, core)
        assert {s: sum(got[k].get(s, 0) for k in got) for s in sizes} == sizes
        total = sum(s * n for s, n in sizes.items())
        for k, share in shares.items():
            assert abs(sum(s * n for s, n in got[k].items()) - share * total) <= 1
    assert groups.allocate({}, shares) == {k: {} for k in shares}
    assert groups.allocate(sizes, {}) == {}


def test_allocation_is_the_same_at_any_number_of_rows():
    """Without small components to settle a gap the whole table is looked at, however small the core it starts with."""
    sizes, shares = {1000: 13, 700: 9, 10: 3}, {"train": 0.8, "validation": 0.1, "test": 0.1}
    exact = totals(groups.allocate(sizes, shares, 1 << 40))
    assert all(totals(groups.allocate(sizes, shares, core)) == exact for core in (1, 966, 5000))
    times = 1_000_000  # 1.9e10 rows: few totals can be reached, so they are listed
    assert totals(groups.allocate({s * times: n for s, n in sizes.items()}, shares)) == {k: t * times for k, t in exact.items()}
    rng = random.Random(8)
    for _ in range(40):
        sizes = {rng.choice([1, 3, 50, 400, rng.randint(1, 900)]): rng.randint(1, 12) for _ in range(rng.randint(1, 6))}
        exact = totals(groups.allocate(sizes, shares, 1 << 40))
        total = sum(s * n for s, n in sizes.items())
        for core in (1, total // 20 + 1):
            got = totals(groups.allocate(sizes, shares, core))
            assert all(abs(got[k] - shares[k] * total) <= abs(exact[k] - shares[k] * total) + 1e-6 or got == exact for k in ("validation", "test"))


def test_lists_and_bits_of_totals_agree():
    rng = random.Random(3)
    for _ in range(50):
        sizes = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(3)}
        limit = rng.randint(1, 300)
        *_, (_, _, bits) = groups.reachable(sizes, limit)
        scaled = {s * 100_000: n for s, n in sizes.items()}
        *_, (_, _, listed) = groups.reachable(scaled, limit * 100_000)
        assert not isinstance(listed, int) and [t // 100_000 for t in listed.tolist()] == [t for t in range(limit + 1) if bits >> t & 1]


ROWS = "record_id bigint, url string, dataset_source string, component string, split string"


def test_grouped_split(spark):
    data = [(i, f"http://s{i % 7}.test/{i}", f" Own{i % 50}/a" if i % 2 else f"own{i % 50} / b", "x", "y") for i in range(500)]
    data += [(1000, None, None, None, None), (1001, None, " ", None, None), (1002, "http://alone.test", None, None, None), (1003, "http://alone.test/2", "", None, None), (None, "http://s1.test", "own1/a", None, None)]
    df = spark.createDataFrame(data, ROWS)
    rows = groups.with_anchor(df, "record_id", "url", "dataset_source", ["test"])
    labels = groups.linked(rows, "_owner", "_site", "_anchor")
    got = groups.grouped_split(rows, labels, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    split = {r._id: r.split for r in got}
    assert len(got) == 504 and split[1002] == split[1003]
    by = {}
    for i, url, source, *_ in data[:500]:
        for tie in (url.split("/")[2], source.split("/")[0].strip().lower()):
            by.setdefault(tie, set()).add(split[i])
    assert all(len(s) == 1 for s in by.values())
    pairs = {(r.source_a, r.source_b) for r in groups.shared_sources(rows, labels).collect()}
    sources = {s for _, _, s, *_ in data[:500]}
    assert pairs == {(a, b) for a, b in itertools.combinations(sorted(sources), 2)}  # seven sites tie all owners together
    assert {(r.source_a, r.source_b) for r in groups.shared_sources(rows, labels, block=3).collect()} == pairs
    assert groups.shared_sources(rows, labels, block=3).count() == len(pairs)
    classes = groups.source_classes(rows, labels).collect()
    assert {r.source for r in classes} == sources and {r.members for r in classes} == {len(sources)} and len(classes) == len(sources)
    none = groups.with_anchor(df.filter("record_id < 0"), "record_id", "url", "dataset_source", ["test"])
    assert groups.grouped_split(none, groups.linked(none, "_owner", "_site", "_anchor"), {"train": 1.0}).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


@pytest.mark.parametrize("hot", [1, 3, 256])
def test_near_pairs_lose_none(spark, hot):
    """Against all pairs, also where every bucket is crowded and has to be refined."""
    rng = random.Random(hot)
    site_part = "httpexampleverylongsite"
    texts = {site_part + "".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(80)}
    texts |= {"".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(40)}
    texts = sorted(texts)
    frame = lambda rows: overlaps.with_sketch(spark.createDataFrame(rows, "kid bigint, text string, room bigint"), "text")
    left = frame([(i, t, 0) for i, t in enumerate(texts) if i % 2])
    right = frame([(i, t, 0) for i, t in enumerate(texts) if i % 2 == 0])
    got = {(r.left, r.right) for r in overlaps.near_pairs(left, right, hot=hot).collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i % 2 and not j % 2 and distance(a, b) <= 3}
    assert want <= got


def test_overlaps(spark):
    urls = {1: BASE, 2: SAME[1], 3: BASE.replace("login", "logn"), 4: BASE + "&sid=77777", 5: "http://www.abc-shop.example/login/page.php?from=last+notice", 6: BASE.replace("login", "elsewhere"), 7: None, 8: BASE, 9: "", 10: "y" * 50_000, 11: "y" * 50_000 + "zz"}
    df = spark.createDataFrame([(i, u, "s", 1, "k", "t") for i, u in urls.items()], "record_id bigint, url string, dataset_source string, label int, k1 string, text string")
    splits = spark.createDataFrame([(1, "train"), (2, "test"), (3, " Validation"), (4, "test"), (5, "test"), (6, "test"), (7, "test"), (8, "train"), (8, "train"), (9, None), (10, "train"), (11, "test"), (None, "train"), (77, "test")], "record_id bigint, split string")
    got = {(r.train_id, r.other_id): r.kind for r in overlaps.overlaps(df, splits).collect()}
    want = {(t, o): k for t in (1, 8) for o, k in ((2, "same"), (3, "edit"), (4, "parameter"), (5, "parameter"))}
    assert got == want | {(10, 11): "edit"}
    assert overlaps.overlaps(df.filter("record_id < 0"), splits).count() == 0
    assert overlaps.overlaps(df, splits.filter("record_id < 0")).count() == 0
