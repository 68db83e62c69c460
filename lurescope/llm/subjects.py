"""Problem 7: subject areas of documents, by a classifier chain over term, source and structure features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm.terms import TERMS, ngrams, words_of
from lurescope.plans.lineage import cut
from lurescope.session import table

#: Labelled documents that the chain is fitted on at most; the first by the hash of their id.
SAMPLE_DOCS = 6000
#: Width of the beam over label combinations.
BEAM = 8
#: Texts worked on at once in a task.
CHUNK = 512


def sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of VALUES by their place AT."""
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], 1)


def telling(counts: np.ndarray, prior: float = 2.0, need: float = 0.6) -> np.ndarray:
    """Weights of the terms that tell a subject: most of the texts that have the term are on one, by at least NEED.

    The PRIOR, as many texts of average make-up, keeps rare terms out; the words of every text, which any text may
    repeat, get no weight at all, however often they occur, so that they can't drown a name.
    """
    usual = counts.sum(0) / max(counts.sum(), 1e-9) + 1e-9
    share = (counts + prior * usual) / (counts.sum(1, keepdims=True) + prior)
    clear = (share >= need) & (share >= share.max(1, keepdims=True))
    return np.where(clear, np.log(share / usual), 0).astype("float32")


def add_presence(total: np.ndarray, term: np.ndarray, place: np.ndarray, owner: np.ndarray, share: np.ndarray) -> None:
    """Adds to TOTAL (terms by subjects) the texts that have each term, a text SHAREd between its subjects; repeats count once."""
    on = share.any(1)[owner[place]]
    one = owner[place[on]] * TERMS + term[on]
    one.sort()
    one = one[np.concatenate([[True], one[1:] != one[:-1]])] if len(one) else one
    text, term = one // TERMS, one % TERMS
    n, flat = share.shape[1], total.reshape(-1)
    order = np.argsort(-share, 1, kind="stable")
    for rank in range(n):
        weight = share[np.arange(len(share)), order[:, rank]]
        has = weight[text] > 0
        if not has.any():
            break
        text, term = text[has], term[has]
        np.add.at(flat, term * n + order[text, rank], weight[text])


@dataclass
class Topics:
    """Topic of each sentence: column 0 is none, then the subjects. Sentences without a telling term are all alike in a text."""

    weights: np.ndarray
    margin: float = 1.0

    def __post_init__(self) -> None:
        self.tells = self.weights.any(1)

    def features(self, term: np.ndarray, place: np.ndarray, owner: np.ndarray, n_texts: int, rounds: int = 8) -> np.ndarray:
        """Per text what the chain looks at (:data:`NAMES` per subject, one block each, then the number of sentences).

        A sentence's topics follow from its terms and, in turns, from the share of topics in its text.
        """
        n = self.weights.shape[1]
        found = np.flatnonzero(self.tells[term])
        told, row = np.unique(place[found], return_inverse=True)
        number = np.bincount(owner, minlength=n_texts).astype(float)
        plain = number - np.bincount(owner[told], minlength=n_texts)
        evidence = sums(self.weights[term[found]], row, len(told))
        text = np.concatenate([owner[told], np.arange(n_texts)])
        times = np.concatenate([np.ones(len(told)), plain])[:, None]
        scores = np.zeros((len(text), 1 + n))
        scores[:, 0] = self.margin
        scores[: len(told), 1:] = evidence
        scores -= scores.max(1, keepdims=True)
        mix = np.ones((n_texts, 1 + n))
        mix[:, 0] = 3
        mix /= mix.sum(1, keepdims=True)
        least = np.array([1.0] + [0.1] * n)
        rows, heads = np.unique(owner[told], return_index=True)

        def by_text(values: np.ndarray) -> np.ndarray:
            out = np.zeros((n_texts, values.shape[1]))
            if len(heads):
                out[rows] = np.add.reduceat(values[: len(told)], heads, 0)
            return out

        post = scores
        for _ in range(rounds):
            post = np.exp(scores + np.log(mix)[text])
            post *= times / post.sum(1, keepdims=True)
            counts = by_text(post) + post[len(told) :]
            mix = counts + least
            mix /= mix.sum(1, keepdims=True)
        share = counts / np.maximum(number, 1)[:, None]
        of = owner[told]
        start = np.concatenate([[0], np.cumsum(number)])[of]
        where = (told - start + 0.5) / np.maximum(number[of], 1)
        mine = post[: len(told), 1:]
        mean = by_text(mine * where[:, None]) / np.maximum(by_text(mine), 1e-9)
        most = np.zeros((n_texts, n))
        if len(heads):
            most[rows] = np.maximum.reduceat(evidence, heads, 0)
        per = 5 * np.maximum(number, 1)[:, None]
        return np.concatenate([share[:, 1:], np.log1p(counts[:, 1:]), most / 5, by_text(evidence) / per, mean, number[:, None]], 1)


#: Term features of a subject in a text: share of its sentences, their number, the strongest sentence, evidence a sentence, their mean place.
NAMES = ("share", "count", "strongest", "evidence", "place")


def assumed_shares(base: np.ndarray, n: int, least: float = 0.12) -> np.ndarray:
    """A text's weight for each subject that has at least the share LEAST of its sentences, for learning terms only."""
    kept = np.where(base[:, :n] >= least, base[:, :n], 0)
    return kept / np.maximum(kept.sum(1, keepdims=True), 1e-9)


def logistic(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, center: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic weights, drawn to CENTER by RIDGE: Newton steps, halved until the loss falls."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * (w - center) ** 2).sum())

    w = center.copy()
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * (w - center))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        if size <= 1e-4:
            break
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-7 * abs(now):
            break
    return w


@dataclass
class Chain:
    """A chain of logistic links, one a subject: each sees the text's features and the labels decided by the links before it.

    All weights are learned from labels, with a plain ridge around 0 for those all links share (:meth:`common`), and
    around the shared ones for those of a link. No threshold and no prior on any feature is given.
    """

    n: int
    sources: list[str]
    use_labels: bool = True
    weights: list[np.ndarray] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)

    def source_ids(self, names: list) -> np.ndarray:
        known = {s: i for i, s in enumerate(self.sources)}
        return np.array([known.get(s, len(self.sources)) for s in names], "int64")

    def common(self, base: np.ndarray, source: np.ndarray, k: int) -> np.ndarray:
        """Features of link K whose meaning is the same in every link: terms, structure, source.

        What a text has of other subjects or of none is left out, like the number of labels before: no text without a
        subject is ever labelled, so these would teach that every text must have one.
        """
        own = base[:, k : len(NAMES) * self.n : self.n]
        share, number = base[:, k], base[:, -1]
        structure = [np.ones(len(base)), np.sqrt(share), share * share, np.log1p(number) / 3, np.log1p(number) * share]
        one_hot = np.zeros((len(base), len(self.sources) + 1))
        one_hot[np.arange(len(base)), source] = 1
        return np.concatenate([own, np.stack(structure, 1), one_hot], 1)

    def seen(self, labels: np.ndarray, k: int) -> np.ndarray:
        """The labels before link K. Their number is left out: every labelled text has one, so it would tell texts without any that they must."""
        return labels[:, :k] if self.use_labels else np.zeros((len(labels), k))

    def links(self, base: np.ndarray, source: np.ndarray, y: np.ndarray, ridge: float = 1.0, own: float = 5.0) -> list[np.ndarray]:
        xs = [self.common(base, source, k) for k in range(self.n)]
        x = np.concatenate(xs)
        shared = logistic(x, y.T.reshape(-1), np.full(x.shape[1], ridge), np.zeros(x.shape[1]))
        out = []
        for k, part in enumerate(xs):
            center = np.concatenate([shared, np.zeros(k)])
            out.append(logistic(np.concatenate([part, self.seen(y, k)], 1), y[:, k], np.full(len(center), own), center))
        return out

    def logits(self, weights: list[np.ndarray], base: np.ndarray, source: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([self.common(base, source, k), self.seen(labels, k)], 1) @ weights[k]

    def fit(self, base: np.ndarray, source: np.ndarray, y: np.ndarray) -> Chain:
        """Weights on all rows; the scale that calibrates them on labels held out, in halves and turns."""
        half = np.arange(len(base)) % 2
        logits, truth = [], []
        for h in (0, 1):
            w = self.links(base[half != h], source[half != h], y[half != h])
            for k in range(self.n):
                logits.append(self.logits(w, base[half == h], source[half == h], y[half == h], k))
                truth.append(y[half == h, k])
        z = np.concatenate(logits)
        a, b = logistic(np.stack([z, np.ones_like(z)], 1), np.concatenate(truth), np.array([5.0, 5.0]), np.array([1.0, 0.0]))
        self.weights, self.scale = self.links(base, source, y), (float(max(a, 0.1)), float(b))
        return self

    def decode(self, base: np.ndarray, source: np.ndarray, width: int = BEAM) -> np.ndarray:
        """The likeliest label combination of each row, by a beam of WIDTH over the links."""
        m = len(base)
        labels, score = np.zeros((m, 1, self.n)), np.zeros((m, 1))
        for k in range(self.n):
            w = score.shape[1]
            fixed = self.common(base, source, k)
            z = np.repeat(fixed @ self.weights[k][: fixed.shape[1]], w) + self.seen(labels.reshape(m * w, self.n), k) @ self.weights[k][fixed.shape[1] :]
            z = (self.scale[0] * z + self.scale[1]).reshape(m, w)
            with_it = labels.copy()
            with_it[:, :, k] = 1
            labels = np.concatenate([labels, with_it], 1)
            score = np.concatenate([score - np.logaddexp(0, z), score - np.logaddexp(0, -z)], 1)
            best = np.argsort(-score, 1, kind="stable")[:, :width]
            score = np.take_along_axis(score, best, 1)
            labels = np.take_along_axis(labels, best[:, :, None], 1)
        return labels[:, 0]


def known_subjects(subjects: DataFrame, at_most: int = 200) -> list[tuple[str, str]]:
    """The subjects with what they are about, in order of their names; more than AT_MOST are refused."""
    rows = subjects.filter("subject is not null").groupBy("subject").agg(F.max("about").alias("about")).limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} subjects")
    return sorted((r.subject, r.about or "") for r in rows)


def hand_labels(labels: DataFrame, names: list[str]) -> DataFrame:
    """``doc_id, hand``: the places of the subjects each document is labelled with."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("subject")).cast("int") - 1
    return labels.filter(F.col("doc_id").isNotNull() & F.col("subject").isin(names)).groupBy("doc_id").agg(F.collect_set(place).alias("hand"))


def parsed(docs: DataFrame, hand: DataFrame) -> DataFrame:
    """``doc_id, source, hand, words, lengths``: each whole text once as hashes of its words and the words of its sentences."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", F.col("source").cast("string").alias("source"), "text").join(hand, "doc_id", "left")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                words, lengths, owner = words_of(part.column("text").to_pylist())
                n = part.num_rows
                counts = np.bincount(owner, minlength=n)
                sizes = np.bincount(owner, lengths, minlength=n)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(c)]).astype("int32")), pa.array(v.view("int32"))) for c, v in ((sizes, words), (counts, lengths))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("hand"), *lists], names=["doc_id", "source", "hand", "words", "lengths"])

    return rows.select("doc_id", "source", "hand", "text").mapInArrow(parse, f"doc_id {kind}, source string, hand array<int>, words array<int>, lengths array<int>")


def _opened(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, sentence of the term, text of the sentence) of rows of :func:`parsed`."""
    words, lengths = part.column("words"), part.column("lengths")
    flat = lengths.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(lengths).to_numpy(zero_copy_only=False))
    term, place = ngrams(words.flatten().to_numpy(zero_copy_only=False).view("uint32"), flat)
    return term, place, owner


def _hand(part: pa.RecordBatch, n: int) -> np.ndarray:
    """Rows of 1 for the labels of each text; all 0 where it has none."""
    out = np.zeros((part.num_rows, n))
    lists = part.column("hand")
    at = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    out[at, lists.flatten().to_numpy(zero_copy_only=False)] = 1
    return out


def term_counts(rows: DataFrame, weights: np.ndarray | None, n: int) -> np.ndarray:
    """Texts of all documents that have each term, by subject: summed up in each task before anything is shuffled.

    A labelled text counts for its labels, any other for the subjects that the WEIGHTS find in it, without any for none.
    """
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics, total = None if held.value is None else Topics(held.value), np.zeros((TERMS, n))
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                term, place, owner = _opened(part)
                hand = _hand(part, n)
                share = hand / np.maximum(hand.sum(1, keepdims=True), 1)
                if topics is not None:
                    found = assumed_shares(topics.features(term, place, owner, part.num_rows), n)
                    share = np.where(hand.any(1)[:, None], share, found)
                add_presence(total, term, place, owner, share)
        at = np.flatnonzero(total.any(1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[at, z]) for z in range(n)]], names=["term", *[f"n{z}" for z in range(n)]])

    fields = ", ".join(f"n{z} double" for z in range(n))
    parts = rows.select("hand", "words", "lengths").mapInArrow(count, f"term bigint, {fields}")
    got = parts.groupBy("term").agg(*[F.sum(f"n{z}").alias(f"n{z}") for z in range(n)]).toPandas()
    out = np.zeros((TERMS, n))
    out[got["term"].to_numpy("int64")] = got.drop(columns="term").to_numpy()
    return out


def described(rows: DataFrame, weights: np.ndarray, make: Callable, schema: str) -> DataFrame:
    """MAKE(part, features) over all ROWS of :func:`parsed`, in Arrow batches."""
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = Topics(held.value)
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                yield make(part, topics.features(*_opened(part), part.num_rows))

    return rows.mapInArrow(run, schema)


def labelled_sample(rows: DataFrame, weights: np.ndarray, n: int, bound: int) -> tuple[np.ndarray, list, np.ndarray]:
    """(features, sources, labels) of at most BOUND labelled documents: the first by the hash of the id. No text comes to the driver."""
    first = rows.filter("hand is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "lengths", "words").limit(bound)

    def make(part: pa.RecordBatch, base: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(base) + 1, dtype="int32") * base.shape[1]), pa.array(base.reshape(-1)))
        return pa.RecordBatch.from_arrays([part.column("source"), part.column("hand"), lists], names=["source", "hand", "base"])

    got = described(first, weights, make, "source string, hand array<int>, base array<double>").collect()
    y = np.zeros((len(got), n))
    for k, r in enumerate(got):
        y[k, r.hand] = 1
    return np.array([r.base for r in got]).reshape(len(got), -1), [r.source for r in got], y


def learned_terms(rows: DataFrame, known: list[tuple[str, str]], passes: int = 2) -> np.ndarray:
    """Weights of the terms: from the labelled documents and what is said about the subjects, then from all sentences of
    all documents in PASSES passes, so that words no labelled document has are learned from the company they keep.

    The counts that reach the driver have the fixed size of the model.
    """
    n = len(known)
    words, lengths, owner = words_of([f"{s} {about}" for s, about in known])
    seeds = np.zeros((TERMS, n))
    add_presence(seeds, *ngrams(words, lengths), owner, 2.0 * np.eye(n))
    weights = telling(term_counts(rows.filter("hand is not null"), None, n) + seeds, 0.8, 0.5)
    for _ in range(passes):
        weights = telling(term_counts(rows, weights, n) + seeds)
    return weights


def subjects_of(docs: DataFrame, labels: DataFrame, subjects: DataFrame, bound: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, subject`` for every document and each of its subjects, from DOCS (doc_id, text, source).

    Whole texts are parsed once into hashes of words, which three passes over all documents read: two that learn terms
    and one that assigns. The chain is fitted on at most BOUND labelled documents. A null or blank text has no subject;
    repeated rows of a document give each pair once; rows without a doc_id are left out; without labels or subjects
    nothing can be learned and the result is empty.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = known_subjects(subjects)
    n = len(known)
    rows = cut(parsed(docs, hand_labels(labels, [s for s, _ in known]))) if known else None
    if rows is None or rows.filter("hand is not null").isEmpty():
        return spark.createDataFrame([], f"doc_id {kind}, subject string")
    weights = learned_terms(rows, known)
    base, source, y = labelled_sample(rows, weights, n, bound)
    chain = Chain(n, sorted({s for s in source if s}))
    chain.fit(base, chain.source_ids(source), y)
    held, names = spark.sparkContext.broadcast(chain), np.array([s for s, _ in known], object)

    def assign(part: pa.RecordBatch, base: np.ndarray) -> pa.RecordBatch:
        got = held.value.decode(base, held.value.source_ids(part.column("source").to_pylist()))
        got[base[:, -1] == 0] = 0
        row, col = np.nonzero(got)
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(names[col], pa.string())], names=["doc_id", "subject"])

    return described(rows.select("doc_id", "source", "words", "lengths"), weights, assign, f"doc_id {kind}, subject string").distinct()


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects_of(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("doc_id", "subject")


def p7_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Make-up of the corpus: documents and characters of each subject, and their shares of all documents."""
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("chars"))
    total = docs.count()
    counts = docs.join(_assigned(spark, sf_dir), "doc_id", "left").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("chars").alias("chars"))
    return counts.select(F.coalesce("subject", F.lit("(none)")).alias("subject"), "documents", F.coalesce("chars", F.lit(0)).alias("chars"), F.round(F.col("documents") / F.lit(max(1, total)), 9).alias("share"))


QUERIES = {"p7_found": p7_found, "p7_makeup": p7_makeup}
