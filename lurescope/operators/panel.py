"""A panel of engines: scores per URL and engine, pooling, comparison, evidence, engine look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurescope.functions.rules import BRANDS, OFFICIAL, SUSPICIOUS, any_of
from lurescope.functions.urls import code_sum

#: Reliability of an engine that the catalog does not know.
UNKNOWN_RELIABILITY = 0.90
VOTES_NEEDED = 5


def with_points(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``points`` (0.1 to 99.9) and ``reasons``, from the URL and the features of its row; a missing one counts 0.

    Features looked at where DF has them: having_ip_address, prefix_suffix, having_sub_domain, sfh_external,
    external_password_nodes, iframe_hidden, hidden_form_nodes, url_of_anchor_ratio.
    """
    value = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)
    staged = df.withColumn("_u", F.lower(url)).withColumn("_host", F.regexp_extract(F.lower(url), r"https?://([^/]+)", 1))
    staged = staged.withColumn("_host", F.when(F.col("_host") != "", F.col("_host")).otherwise(F.col("_u")))
    staged = staged.withColumn("_words", F.filter(F.array(*[F.lit(w) for w in SUSPICIOUS]), lambda w: F.contains(F.col("_u"), w)))
    checks: list[tuple[Column, Column | float, Column]] = [
        (any_of(F.col("_host"), BRANDS) & ~any_of(F.col("_host"), OFFICIAL), 45.0, F.concat(F.lit("brand on a foreign host: "), "_host")),
        (F.size("_words") > 0, F.size("_words") * 12.0, F.concat(F.lit("keywords: "), F.array_join("_words", ", "))),
        (value("having_ip_address") > 0, 30.0, F.lit("host is an IP address")),
        (value("prefix_suffix") > 0, 15.0, F.lit("hyphen in the host")),
        (value("having_sub_domain") > 0.5, 20.0, F.lit("many subdomains")),
        ((value("external_password_nodes") > 0) | (value("sfh_external") > 0), 35.0, F.lit("form posts to another host")),
        ((value("hidden_form_nodes") > 0) | (value("iframe_hidden") > 0), 25.0, F.lit("hidden frame or form")),
        (value("url_of_anchor_ratio") > 0.5, 15.0, F.lit("most links leave the site")),
    ]
    points = sum((F.when(c, p).otherwise(0.0) for c, p, _ in checks), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(c, r) for c, _, r in checks]))
    staged = staged.withColumn("points", F.least(F.lit(99.9), F.greatest(F.lit(0.1), points))).withColumn("_reasons", reasons)
    text = F.when(F.size("_reasons") == 0, "nothing suspicious").otherwise(F.array_join("_reasons", "; "))
    return staged.withColumn("reasons", text).drop("_u", "_host", "_words", "_reasons")


def bare_name(name: Column) -> Column:
    """An engine's name without case, blanks and punctuation."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def engine_score(points: Column, name: Column) -> Column:
    """An engine's own score: the points, moved a little by the character sum of its name."""
    return F.least(F.lit(99.9), F.greatest(F.lit(0.1), points + (code_sum(name) % 7 - 3) * 0.8))


def fan_out(df: DataFrame, engines: DataFrame) -> DataFrame:
    """A row per row of DF and engine with ``engine, ord, reliability, score, verdict``.

    The catalog is tiny; as it is the small side without a key, Spark broadcasts it and no row of DF is shuffled.
    """
    catalog = engines.select("ord", F.col("name").alias("engine"), F.coalesce("reliability", F.lit(UNKNOWN_RELIABILITY)).alias("reliability"))
    each = df.crossJoin(catalog).withColumn("score", engine_score(F.col("points"), F.col("engine")))
    return each.withColumn("verdict", F.when(F.col("score") >= 50, "PHISHING").otherwise("LEGITIMATE"))


def log_odds(score: Column) -> Column:
    """Log odds of a score in percent at temperature 1.2, kept off certainty."""
    p = F.least(F.lit(99.999), F.greatest(F.lit(0.001), score)) / 100
    warm = 1 / (1 + F.exp(-F.ln(p / (1 - p)) / 1.2))
    return F.ln(F.greatest(F.lit(1e-6), warm) / F.greatest(F.lit(1e-6), 1 - warm))


def pooled(votes: DataFrame, keys: list[str], votes_needed: int = VOTES_NEEDED) -> DataFrame:
    """Votes, agreement and reliability-weighted pooling of ``score, reliability, verdict`` per KEYS.

    Only sums leave a task, so a key with a third of all votes is combined before the shuffle.
    """
    yes = F.count_if(F.col("verdict") == "PHISHING")
    sums = votes.groupBy(*keys).agg(
        yes.alias("phishing_votes"), (F.count(F.lit(1)) - yes).alias("legitimate_votes"),
        F.sum(log_odds(F.col("score")) * F.col("reliability")).alias("_odds"), F.sum("reliability").alias("_weight"),
    )
    pool = 100 / (1 + F.exp(-F.col("_odds") / F.greatest(F.lit(0.1), F.col("_weight"))))
    share = F.greatest("phishing_votes", "legitimate_votes") / (F.col("phishing_votes") + F.col("legitimate_votes")) * 100
    return sums.select(
        *keys, "phishing_votes", "legitimate_votes", F.round(pool, 1).alias("pooled_score"), F.round(share, 1).alias("agreement"),
        F.when(F.col("phishing_votes") >= votes_needed, "PHISHING").otherwise("LEGITIMATE").alias("consensus"),
    )


def listed_engines(engines: DataFrame, at_most: int = 1000) -> list[tuple[str, float, float]]:
    """(name, reliability, shift of its score) of the catalog, in its order; one of more than AT_MOST engines is refused."""
    rows = engines.orderBy("ord").select("name", F.coalesce("reliability", F.lit(UNKNOWN_RELIABILITY)).alias("reliability")).limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} engines")
    return [(r["name"], float(r["reliability"]), (sum(map(ord, r["name"])) % 7 - 3) * 0.8) for r in rows]


def shifted(points: Column, shift: float) -> Column:
    return F.least(F.lit(99.9), F.greatest(F.lit(0.1), points + shift))


def pooled_in_row(df: DataFrame, engines: DataFrame) -> DataFrame:
    """The same for the engines' own scores of ``points`` without leaving the row: no join, no shuffle, no lambda.

    Engines differ in one of seven shifts of the points, so there is one score a shift, whatever the number of engines.
    """
    listed = listed_engines(engines)
    shifts = sorted({s for _, _, s in listed})
    score = {s: shifted(F.col("points"), s) for s in shifts}
    votes = sum((F.when(score[s] >= 50, sum(1 for _, _, t in listed if t == s)).otherwise(0) for s in shifts), F.lit(0))
    odds = sum((log_odds(score[s]) * sum(r for _, r, t in listed if t == s) for s in shifts), F.lit(0.0))
    weight, n = max(0.1, sum(r for _, r, _ in listed)), len(listed)
    staged = df.withColumn("phishing_votes", votes.cast("bigint")).withColumn("llm_score", F.round(100 / (1 + F.exp(-odds / weight)), 1))
    votes = F.col("phishing_votes")
    staged = staged.withColumn("legitimate_votes", n - votes).withColumn("agreement", F.round(F.greatest(votes, n - votes) / F.lit(float(max(1, n))) * 100, 1))
    return staged.withColumn("consensus", F.when(votes >= VOTES_NEEDED, "PHISHING").otherwise("LEGITIMATE"))


def evidence_in_row(df: DataFrame, engines: DataFrame, first: int = 4) -> DataFrame:
    """Adds ``evidence``, as :func:`evidence` has it, for the engines' own scores of ``points``; null where no engine votes PHISHING."""
    listed = listed_engines(engines)

    def said(row: Column) -> Column:
        texts = [F.when(shifted(row["points"], s) >= 50, F.concat(F.lit(f"[{name}] "), row["reasons"])) for name, _, s in listed]
        return F.array_join(F.slice(F.array_compact(F.array(*texts)), 1, first), " | ")

    # A lambda over one row, so that points and reasons are computed once and not once an engine.
    text = F.transform(F.array(F.struct("points", "reasons")), said)[0] if listed else F.lit(None).cast("string")
    return df.withColumn("evidence", F.nullif(text, F.lit("")))


# How the two verdicts are written, after lower case and without anything but letters.
SAYS_PHISHING = ("phishing", "phish", "malicious", "notlegitimate", "malware", "scam", "fraud", "fraudulent", "unsafe", "notsafe", "notbenign", "bad")
SAYS_LEGITIMATE = ("legitimate", "legit", "safe", "benign", "notphishing", "notphish", "notmalicious", "clean", "harmless", "good", "ok")


def read_answers(answers: DataFrame) -> DataFrame:
    """``scan_id, engine, verdict, score``: one answer of each engine on each scan, from ANSWERS as engines and tools wrote them.

    Engines are told by their bare names, verdicts read in any spelling, scores of an engine that mostly stays within
    0 to 1 brought to percent and others left out beyond 0 to 100. Of repeated calls and deliveries the latest counts.
    An answer with neither verdict nor score is none; without a verdict the score speaks, from 50 on for PHISHING.
    """
    when = [c for c in ("answered_at", "result_id") if c in answers.columns]
    word = F.regexp_replace(F.regexp_replace(F.lower("verdict"), r'"?verdict"?\s*:', ""), "[^a-z]+", "")
    rows = answers.select("scan_id", bare_name(F.col("engine")).alias("engine"), word.alias("_w"), F.col("threat_score").cast("double").alias("_s"), *when)
    rows = rows.filter("scan_id is not null and engine is not null and engine != ''")
    scales = rows.groupBy("engine").agg((2 * F.count_if(F.col("_s").between(0, 1)) > F.count_if(F.col("_s").between(0, 100))).alias("_unit"))
    score = F.when(F.col("_unit") & F.col("_s").between(0, 1), F.col("_s") * 100).when(~F.col("_unit") & F.col("_s").between(0, 100), F.col("_s"))
    verdict = F.when(F.col("_w").isin(*SAYS_PHISHING), "PHISHING").when(F.col("_w").isin(*SAYS_LEGITIMATE), "LEGITIMATE").when(F.col("score") >= 50, "PHISHING").when(F.col("score").isNotNull(), "LEGITIMATE")
    read = rows.join(scales, "engine").withColumn("score", score).withColumn("verdict", verdict).filter("verdict is not null or score is not null")
    last = F.max(F.struct(*when, "verdict", "score")).alias("_a")
    return read.groupBy("scan_id", "engine").agg(last).select("scan_id", "engine", "_a.verdict", "_a.score")


def compared(votes: DataFrame, keys: list[str], digits: int = 1) -> DataFrame:
    """Side by side: votes, mean score, and PHISHING if at least half of those asked say so."""
    yes = F.count_if(F.col("verdict") == "PHISHING")
    sums = votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("engines"), yes.alias("phishing_votes"), F.round(F.avg("score"), digits).alias("mean_score"))
    return sums.withColumn("verdict", F.when(F.col("phishing_votes") * 2 >= F.col("engines"), "PHISHING").otherwise("LEGITIMATE"))


def evidence(votes: DataFrame, keys: list[str], first: int = 4) -> DataFrame:
    """The reasons of the FIRST engines, in the catalog's order, that vote PHISHING; at most one a catalog entry is kept."""
    yes = votes.filter("verdict = 'PHISHING'")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    top = yes.withColumn("_rank", rank).filter(F.col("_rank") <= first)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_rank", F.concat(F.lit("["), "engine", F.lit("] "), "reasons").alias("text")))), lambda x: x["text"])
    return top.groupBy(*keys).agg(F.array_join(listed, " | ").alias("evidence"))


def by_catalog_name(answers: DataFrame, engines: DataFrame, name: str) -> DataFrame:
    """ANSWERS with NAME as the catalog spells it, by bare names; answers of engines that it does not list are left out."""
    catalog = engines.select("ord", F.col("name").alias("_engine"), bare_name(F.col("name")).alias("_bare")).filter("_bare != ''")
    known = catalog.groupBy("_bare").agg(F.min_by("_engine", "ord").alias("_engine"))
    named = answers.withColumn("_bare", bare_name(F.col(name))).join(known, "_bare")
    return named.withColumn(name, F.col("_engine")).drop("_bare", "_engine")


def matched_engines(asked: DataFrame, engines: DataFrame, name: str) -> DataFrame:
    """For each NAME the first engine, in catalog order, whose bare name equals or contains it; else the first engine.

    Names are made distinct first: there are few of them, however many rows ask.
    """
    names = asked.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("_bare", bare_name(F.col(name)))
    catalog = engines.select("ord", F.col("name").alias("engine"), bare_name(F.col("name")).alias("_known"))
    hits = names.join(catalog, F.contains(F.col("_known"), F.col("_bare"))).groupBy(name).agg(F.min_by("engine", "ord").alias("engine"))
    first = catalog.agg(F.min_by("engine", "ord").alias("_first"))
    return names.join(hits, name, "left").crossJoin(first).select(name, F.coalesce("engine", "_first").alias("engine"))


def parsed_answers(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``answer`` (score, verdict, reasoning) from the first block in braces of a model's raw reply, null if unreadable."""
    block = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    fields = F.from_json(block, "threat_score double, verdict string, reasoning string")
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), fields["threat_score"]))
    usable = fields["threat_score"].isNotNull() & F.upper(fields["verdict"]).isin("PHISHING", "LEGITIMATE")
    return df.withColumn("answer", F.when(usable, F.struct(score.alias("score"), F.upper(fields["verdict"]).alias("verdict"), fields["reasoning"].alias("reasoning"))))


def with_replies(votes: DataFrame, raw: str) -> DataFrame:
    """VOTES in which a readable reply of the engine stands in for the rule score; an unreadable or missing one doesn't.

    This is the seam for real engines: whatever fetches replies (a ``mapInPandas`` over a service, a table of earlier
    replies) adds the column RAW. Nothing here calls a network.
    """
    read = parsed_answers(votes, raw)
    names = {"score": "score", "verdict": "verdict", "reasons": "reasoning"}
    return read.select(*[F.coalesce(F.col(f"answer.{names[c]}"), F.col(c)).alias(c) if c in names else F.col(c) for c in votes.columns if c != raw])
