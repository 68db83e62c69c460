"""Problem 1 on made-up engines whose errors are known."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lurescope.llm import consensus as C

ANSWERS = "result_id bigint, scan_id bigint, engine string, verdict string, threat_score double, confidence string, x string, annotator string"


def made(n=400, seed=3):
    rng = random.Random(seed)
    truth = {i: rng.random() < 0.4 for i in range(n)}
    skill = {"Good A": (0.95, 0.95), "Good_B": (0.9, 0.92), "good c": (0.88, 0.9), "Always": (0.97, 0.1), "Inverse": (0.2, 0.2), "Coin": (0.5, 0.5)}
    rows = []
    for i, t in truth.items():
        for e, (sensitive, specific) in skill.items():
            if rng.random() < 0.8:
                yes = rng.random() < sensitive if t else rng.random() >= specific
                rows.append((len(rows), i, e, rng.choice(["PHISHING", "phish ", '{"verdict": "MALICIOUS"}'] if yes else ["Benign", "NOT PHISHING"]), 90.0 if yes else 5.0, "HIGH", "clash", "clash"))
    return rows, truth


@pytest.mark.parametrize("text, want", [("Phishing.", 1.0), (" legit", 0.0), ('{"verdict": "LEGITIMATE"}', 0.0), ("NOT LEGITIMATE", 1.0), ("ERROR", None), ("", None), (None, None)])
def test_claims(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(C.claim_of(F.col("v")).alias("c")).first().c == want


def test_finds_truth_and_trust(spark):
    rows, truth = made()
    claims = C.usable(spark.createDataFrame(rows, ANSWERS), "scan_id", "engine", "verdict", "threat_score")
    found = C.discover(claims)
    got = {r.item: (r.t > 0.5, r.probability > 0.5) for r in C.labels_of(found.claims).collect()}
    assert sum(got[i][0] == truth[i] for i in got) / len(got) > 0.95 and all(a == b for a, b in got.values())
    assert found.moved <= 1e-9 and 0 < found.rounds < 100
    trust = {r.annotator: 1 - (r.miss + r.alarm) / 2 for r in found.annotators.collect()}
    assert trust["gooda"] > 0.88 and trust["inverse"] < 0.35 and abs(trust["coin"] - 0.5) < 0.15 and trust["always"] < 0.7


def test_few_answers_say_little(spark):
    rows, _ = made()
    rows += [(10_000 + k, k, "Newcomer", "PHISHING", 99.0, None, "", "") for k in range(2)]
    found = C.discover(C.usable(spark.createDataFrame(rows, ANSWERS), "scan_id", "engine", "verdict", "threat_score"))
    w = {r.annotator: r for r in found.annotators.collect()}
    assert abs(w["newcomer"].for_yes) < abs(w["gooda"].for_yes) / 3


def test_odd_rows(spark):
    rows = [
        (1, 1, "A", "PHISHING", None, None, None, None), (1, 1, "A", "PHISHING", None, None, None, None), (2, 1, None, "SAFE", 1.0, None, None, None), (3, None, "A", "SAFE", 1.0, None, None, None),
        (4, 2, "B", None, 0.9, "LOW", None, None), (5, 2, "B", "TIMEOUT", 0.8, "LOW", None, None), (6, 3, "B", None, -1.0, None, None, None), (7, 4, " ", "SAFE", 1.0, None, None, None), (8, 5, "C" * 100_000, "SAFE", 1.0, None, None, None),
        (9, 6, "A", "SAFE", None, None, None, None), (10, 6, "B", "PHISHING", None, None, None, None),
    ]
    claims = C.usable(spark.createDataFrame(rows, ANSWERS), "scan_id", "engine", "verdict", "threat_score")
    assert {(r.item, r.annotator[:1], r.x) for r in claims.collect()} == {(1, "a", 1.0), (2, "b", 1.0), (5, "c", 0.0), (6, "a", 0.0), (6, "b", 1.0)}
    known = spark.createDataFrame([(6, 1.0), (None, 0.0), (99, 1.0)], "item bigint, known double")
    labels = {r.item: r for r in C.labels_of(C.discover(claims, known).claims).collect()}
    assert set(labels) == {1, 2, 5, 6} and labels[6].probability > 0.999999 and labels[6].t == 1.0 and labels[6].agreement == 0.5


def test_empty(spark):
    claims = C.usable(spark.createDataFrame([], ANSWERS), "scan_id", "engine", "verdict", "threat_score")
    found = C.discover(claims)
    assert C.labels_of(found.claims).count() == 0 and found.annotators.count() == 0


def by_hand(claims, per_label, rounds=100):
    """The same in loops: labels that minimise the weighted distance, weights from the upper bounds."""
    items, names = sorted({i for i, _, _ in claims}), sorted({a for _, a, _ in claims})
    t = {i: float(sum(x for j, _, x in claims if j == i) * 2 > sum(1 for j, _, _ in claims if j == i)) for i in items}
    for _ in range(rounds):
        bounds = {}
        for a in names:
            e, n = [0.0, 0.0], [0.0, 0.0]
            for i, b, x in claims:
                if b == a:
                    k = int(t[i])
                    n[k] += 1
                    e[k] += abs(x - t[i])
            if not per_label:
                e, n = [sum(e)] * 2, [sum(n)] * 2
            for k in (0, 1):
                m = max(n[k], 0.5)
                q = m * max(1 - 2 / (9 * m) - C.Z * math.sqrt(2 / (9 * m)), 1e-3) ** 3
                bounds[a, k] = min((min(e[k], n[k] - e[k]) + 0.5) / q, 0.5), 2 * e[k] > n[k]
        share = (sum(t.values()) + 0.5) / (len(t) - sum(t.values()) + 0.5)
        new = {}
        for i in items:
            far = [0.0, 0.0]
            for j, a, x in claims:
                if j == i:
                    for k in (0, 1):
                        b, turned = bounds[a, k]
                        d = abs(x - k)
                        far[k] += math.log((1 - b) / b) * (1 - d if turned else d)
            new[i] = float(far[0] - far[1] + math.log(share) > 0)
        if new == t:
            return t
        t = new
    return t


@pytest.mark.parametrize("per_label", [True, False])
def test_is_the_alternating_minimisation(spark, per_label):
    rows, _ = made(60, 5)
    claims = C.usable(spark.createDataFrame(rows, ANSWERS), "scan_id", "engine", "verdict", "threat_score")
    got = {r.item: r.t for r in C.labels_of(C.discover(claims, per_label=per_label).claims).collect()}
    assert got == by_hand([(r.item, r.annotator, r.x) for r in claims.collect()], per_label)
