"""Problem 4: same or near-same records across splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm.urlkeys import wide_hash, with_parts
from lurescope.plans.lineage import cut, drop
from lurescope.session import table

EDITS = 3
#: Signatures with more training keys than this are refined; it bounds the comparisons of one probe, never the result.
HOT = 64


def probes(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift): where a text with at most EDITS edits must hold one segment unchanged.

    A text in edits + 1 segments keeps one unchanged; of several, one has at most as many edits before it as segments
    before it, and likewise behind, which bounds its shift.
    """
    n = edits + 1
    return [
        (diff, i, shift)
        for diff in range(-edits, edits + 1)
        for i in range(n)
        for shift in range(max(-i, diff - (edits - i)), min(i, diff + (edits - i)) + 1)
    ]


def with_sketch(df: DataFrame, text: str) -> DataFrame:
    """Adds ``sketch``: letters hashed to 32 bits, each the parity of its letters' count; an edit changes at most two bits."""
    return df.withColumn("sketch", F.expr(f"aggregate(split({text}, ''), 0, (bits, c) -> bits ^ shiftleft(1, cast(xxhash64(c) & 31 as int)))"))


def indexed(keys: DataFrame, edits: int = EDITS) -> DataFrame:
    """``sig, kid, sketch, start, size`` for each of the edits + 1 segments of ``text`` within ``room``."""
    n = edits + 1
    each = keys.withColumn("_n", F.length("text")).withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(n)])))
    base, more = F.expr(f"_n div {n}"), F.expr(f"_i - ({n} - _n % {n})")
    each = each.withColumn("start", (F.col("_i") * base + F.greatest(F.lit(0), more)).cast("int")).withColumn("size", (base + (more >= 0).cast("int")).cast("int"))
    return each.withColumn("sig", F.xxhash64("room", "_n", "_i", F.expr("substring(text, start + 1, size)"))).drop("_n", "_i")


def probing(keys: DataFrame, edits: int = EDITS) -> DataFrame:
    """The same for texts that are looked up: every place where a segment of a text of any near length may lie.

    Where ``gap`` is known, the number of letters by which the text is longer than those of its room, only it counts.
    """
    n = edits + 1
    where = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in probes(edits)])
    if "gap" in keys.columns:
        where = F.filter(where, lambda x: x["d"] == F.col("gap"))
    each = keys.withColumn("_at", F.explode(where)).withColumn("_n", F.length("text") - F.col("_at.d")).withColumn("gap", F.col("_at.d"))
    base, more = F.expr(f"_n div {n}"), F.expr(f"_at.i - ({n} - _n % {n})")
    each = each.withColumn("size", (base + (more >= 0).cast("int")).cast("int"))
    each = each.withColumn("start", (F.col("_at.i") * base + F.greatest(F.lit(0), more) + F.col("_at.s")).cast("int"))
    each = each.filter("_n >= 0 and start >= 0 and start + size <= length(text)")
    return each.withColumn("sig", F.xxhash64("room", "_n", "_at.i", F.expr("substring(text, start + 1, size)"))).drop("_n", "_at")


def near_pairs(left: DataFrame, right: DataFrame, edits: int = EDITS, hot: int = HOT) -> DataFrame:
    """Candidate pairs ``left, right`` of (kid, text, room) of the same room: all within EDITS edits are among them.

    Every text of LEFT is filed under the hashes of its edits + 1 segments, every text of RIGHT looks where a segment
    may lie. A hash with more than HOT texts of LEFT isn't joined: its texts go on without the segment they share, in
    a room of their own, where the rest must again hold a segment unchanged, until the rooms are small or the texts
    short; as a room has one length, a text looks there in a few places only. So no bucket is compared as a whole, however many texts share a site or a phrase, and none is lost.
    Candidates are thinned by the sketch, which no pair within EDITS edits fails.
    """
    found = None
    near = F.bit_count(F.col("sketch").bitwiseXOR(F.col("_sketch"))) <= 2 * edits
    near = near & (F.col("left") != F.col("right"))
    while True:
        index, look = indexed(left, edits), probing(right, edits)
        crowded = cut(index.filter("size > 0").groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("sig"))
        last = crowded.isEmpty()
        ours = index.select("sig", F.col("kid").alias("left"), "sketch")
        theirs = look.select("sig", F.col("kid").alias("right"), F.col("sketch").alias("_sketch"))
        if not last:
            ours, theirs = ours.join(crowded, "sig", "left_anti"), theirs.join(crowded, "sig", "left_anti")
        pairs = cut(ours.join(theirs, "sig").filter(near).select("left", "right").distinct())
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            drop(crowded)
            return found.distinct()
        rest = F.expr("concat(substring(text, 1, start), substring(text, start + size + 1))")
        inner = ["kid", rest.alias("text"), F.col("sig").alias("room"), "sketch"]
        left, right = (cut(x.join(crowded, "sig", "left_semi").select(*inner, *more).distinct()) for x, more in ((index, []), (look, ["gap"])))


#: Stand before each parameter and behind the last in a marked key; no canonical key holds them.
PARAM, END = "\x01", "\x02"


def keyed_rows(df: DataFrame, id_col: str, url: str) -> DataFrame:
    """``id, marked, k1, k2``: the canonical key with its parameters marked, and the hashes of the key itself."""
    parts = with_parts(df.select(F.col(id_col).alias("id"), F.col(url).alias("_url")).filter("id is not null and _url is not null"), "_url")
    marked = F.concat("_head", F.array_join(F.transform("_params", lambda p: F.concat(F.lit(PARAM), p)), ""), F.lit(END), "_tail")
    return parts.select("id", marked.alias("marked"), *wide_hash(F.concat("_head", F.array_join("_params", ""), "_tail")))


def markings(keyed: DataFrame, keys: DataFrame, rows: DataFrame) -> DataFrame:
    """``k1, k2, t, e, marked``: each of KEYS with every marking that ROWS have of it, as copies may split differently
    into path and parameters. Keys with several are few, so their rows are looked up; the others have their marking.
    """
    several = cut(keys.filter("several").select("k1", "k2", "t", "e"))
    theirs = cut(keyed.join(several, ["k1", "k2"]).select("id", "k1", "k2", "t", "e", "marked"))
    more = cut(theirs.join(rows.select("id"), "id").select("k1", "k2", "t", "e", "marked").distinct())
    drop(several)
    drop(theirs)
    return keys.filter("not several").select("k1", "k2", "t", "e", "marked").unionByName(more)


def without_one(keys: DataFrame) -> DataFrame:
    """KEYS once for each of their parameters, with ``m1, m2``, the hash of the key without it."""
    pieces = F.split(F.substring_index("marked", END, 1), PARAM)
    each = keys.filter(F.col("marked").contains(PARAM)).withColumn("_pieces", pieces)
    each = each.withColumn("_tail", F.substring_index("marked", END, -1)).withColumn("_i", F.explode(F.expr("sequence(2, size(_pieces))")))
    text = F.expr("concat(array_join(slice(_pieces, 1, _i - 1), ''), array_join(slice(_pieces, _i + 1, size(_pieces)), ''), _tail)")
    m1, m2 = wide_hash(text)
    return each.select("k1", "k2", "t", "e", m1.alias("m1"), m2.alias("m2"))


KINDS = ("same", "edit", "parameter")


def linked_keys(df: DataFrame, splits: DataFrame, id_col: str = "record_id", url: str = "url", split_col: str = "split", train: str = "train", edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """(pairs of keys, rows): ``l1, l2, r1, r2, kind`` for each two keys, one of TRAIN and one of another split, that are
    the same or nearly the same, and ``id, k1, k2, t, e`` for each row and key, with the sides it is on.

    Copies meet as one key here, so that a group of copies of any size is compared once.
    """
    named = named_splits(splits, id_col, split_col)
    named = named.groupBy("id").agg(F.max(F.col("split") == train).alias("t"), F.max(F.col("split") != train).alias("e"))
    keyed = cut(keyed_rows(df, id_col, url))
    rows = cut(keyed.select("id", "k1", "k2").join(named, "id"))
    sides = rows.groupBy("k1", "k2").agg(F.max("t").alias("t"), F.max("e").alias("e"))
    texts = keyed.select("k1", "k2", "marked").groupBy("k1", "k2").agg(F.min("marked").alias("marked"), (F.min(F.xxhash64("marked")) != F.max(F.xxhash64("marked"))).alias("several"))
    text = F.concat(F.replace(F.substring_index("marked", END, 1), F.lit(PARAM), F.lit("")), F.substring_index("marked", END, -1))
    keys = texts.join(sides, ["k1", "k2"]).withColumn("kid", F.monotonically_increasing_id()).withColumn("text", text)
    keys = cut(with_sketch(keys, "text").drop("text")).withColumn("text", text)
    marked = markings(keyed, keys, rows)
    drop(keyed)
    room = F.lit(0).cast("bigint").alias("room")
    left, right = (keys.filter(s).select("kid", "text", room, "sketch") for s in ("t", "e"))
    candidates = near_pairs(left, right, edits)
    pair = lambda a, b, kind: [F.col(f"{a}1").alias("l1"), F.col(f"{a}2").alias("l2"), F.col(f"{b}1").alias("r1"), F.col(f"{b}2").alias("r2"), F.lit(KINDS.index(kind)).alias("kind")]
    of = lambda side, kid: keys.filter(side).select(F.col("kid").alias(kid), F.col("k1").alias(f"_{kid}1"), F.col("k2").alias(f"_{kid}2"), F.col("text").alias(f"{kid}_text"))
    both = candidates.join(of("t", "left"), "left").join(of("e", "right"), "right")
    edited = both.filter(F.levenshtein("left_text", "right_text", edits) >= 0).select(*pair("_left", "_right", "edit"))
    same = keys.filter("t and e").select(*pair("k", "k", "same"))
    whole = keys.select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.col("t").alias("_t"), F.col("e").alias("_e"))
    joined = without_one(marked).join(whole, ["m1", "m2"])
    longer, shorter = (joined.filter(c).select(*pair(a, b, "parameter")) for c, a, b in (("t and _e", "k", "m"), ("_t and e", "m", "k")))
    pairs = same.unionByName(edited).unionByName(longer).unionByName(shorter)
    return pairs.groupBy("l1", "l2", "r1", "r2").agg(F.min("kind").alias("kind")), rows


def named_splits(splits: DataFrame, id_col: str, split_col: str) -> DataFrame:
    """``id, split`` without blanks and case, once each; null or blank ones are left out."""
    return splits.select(F.col(id_col).alias("id"), F.lower(F.trim(split_col)).alias("split")).filter("id is not null and split is not null and split != ''").distinct()


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)


def overlaps(df: DataFrame, splits: DataFrame, id_col: str = "record_id", url: str = "url", split_col: str = "split", train: str = "train", edits: int = EDITS) -> DataFrame:
    """Pairs of rows ``train_id, other_id, kind``, one in TRAIN and one in another split, with the same or nearly the same URL.

    ``kind`` is ``same``, ``edit`` (at most EDITS letters or digits inserted, removed or replaced in the canonical key)
    or ``parameter`` (one has one query parameter more), the first of them that holds. Rows without an id, a URL or a
    split take no part; a row listed in several splits takes part in each, one that stands several times once. Empty
    tables give an empty result; other columns are not looked at.
    """
    pairs, rows = linked_keys(df, splits, id_col, url, split_col, train, edits)
    ours = rows.filter("t").select(F.col("id").alias("train_id"), F.col("k1").alias("l1"), F.col("k2").alias("l2"))
    theirs = rows.filter("e").select(F.col("id").alias("other_id"), F.col("k1").alias("r1"), F.col("k2").alias("r2"))
    found = pairs.join(ours, ["l1", "l2"]).join(theirs, ["r1", "r2"]).filter("train_id != other_id")
    first = found.groupBy("train_id", "other_id").agg(F.min("kind").alias("kind"))
    return first.select("train_id", "other_id", kind_name(F.col("kind")).alias("kind"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlaps(table(spark, sf_dir, "merged_phishing_multimodal_dataset"), table(spark, sf_dir, "dataset_splits"))
    return pairs.select(F.least("train_id", "other_id").alias("id_a"), F.greatest("train_id", "other_id").alias("id_b")).distinct()


def overlap_counts(df: DataFrame, splits: DataFrame, id_col: str = "record_id", url: str = "url", split_col: str = "split", source: str = "dataset_source", label: str = "label", train: str = "train") -> DataFrame:
    """Per SPLIT, SOURCE of the evaluation row and kind: ``pairs``, evaluation rows that have one (``rows_touched``) and
    pairs whose labels are both known and differ (``labels_differ``). All counts are exact.

    No pair of rows is made: rows are counted per key and label, the counts of the training keys are summed up along the
    pairs of keys and multiplied with those of the evaluation keys, so that a URL of a million copies is one row. A
    record that stands several times with one URL counts once, with the largest of its sources and labels; with several
    URLs, once for each. A record in train and in another split is no partner of itself.
    """
    pairs, rows = linked_keys(df, splits, id_col, url, split_col, train)
    known = df.select(F.col(id_col).alias("id"), F.col(source).alias("_source"), F.col(label).alias("_label")).filter("id is not null")
    known = known.groupBy("id").agg(F.max("_source").alias("source"), F.max("_label").alias("label"))
    rows = cut(rows.distinct().join(known, "id"))
    trained = rows.filter("t").groupBy(F.col("k1").alias("l1"), F.col("k2").alias("l2"), "label").agg(F.count(F.lit(1)).alias("n"))
    near = cut(pairs.join(trained, ["l1", "l2"]).groupBy("r1", "r2", "kind", "label").agg(F.sum("n").alias("n")))
    partners = near.groupBy("r1", "r2", "kind").agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).alias("_known"))
    listed = named_splits(splits, id_col, split_col).filter(F.col("split") != train)
    judged = rows.filter("e").join(listed, "id").groupBy(F.col("k1").alias("r1"), F.col("k2").alias("r2"), "split", "source", "label", "t").agg(F.count(F.lit(1)).alias("_rows"))
    equal = near.filter("label is not null").select("r1", "r2", "kind", "label", F.col("n").alias("_equal"))
    met = judged.join(partners, ["r1", "r2"]).join(equal, ["r1", "r2", "kind", "label"], "left")
    itself = F.when((F.col("kind") == KINDS.index("same")) & F.col("t"), 1).otherwise(0)
    met = met.withColumn("_others", F.col("_all") - itself).filter("_others > 0")
    differ = F.when(F.col("label").isNotNull(), F.coalesce("_known", F.lit(0)) - F.coalesce("_equal", F.lit(0))).otherwise(0)
    counts = met.groupBy("split", "source", "kind").agg(
        F.sum(F.col("_rows") * F.col("_others")).alias("pairs"), F.sum("_rows").alias("rows_touched"), F.sum(F.col("_rows") * differ).alias("labels_differ")
    )
    return counts.select("split", F.col("source").alias("dataset_source"), kind_name(F.col("kind")).alias("kind"), "pairs", "rows_touched", "labels_differ")


def p4_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps counted per split, source of the evaluation row and kind, with how often the labels differ."""
    return overlap_counts(table(spark, sf_dir, "merged_phishing_multimodal_dataset"), table(spark, sf_dir, "dataset_splits"))


QUERIES = {"p4_found": p4_found, "p4_overlaps": p4_overlaps}
