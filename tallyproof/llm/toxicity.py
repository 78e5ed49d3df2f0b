"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, one of toxic and one of ordinary texts, share their lowest level:

    p(w | v) = d(c(v w), E) / c(v)  +  a(v) * p(w)
    p(w)     = d(k(w), E) / K       +  b * s(w)

c are the class's bigram counts (one a text; c(v) their sum over w), k(w) its continuation counts
(distinct words before w), K their sum, and s(w) the shared backoff: counts over every document of
the corpus, labelled or not, one more of each. a(v) and b are the masses that the discounts free,
so each level sums to 1 over all words. The discount depends on the word, as in modified
Kneser-Ney it depends on the count: d(x, E) = max(x - E - Z sqrt(E) - D, 0) takes off what the
shared counts alone lead to expect in a class of this size, E, with its sampling error, and D (a
bigram is discounted by what both classes together lead to expect, and keeps nothing where its word
keeps nothing). So an expression that is rare in a class, or as frequent as everywhere, falls back to the
shared counts in both models and says nothing; only what a class uses more than all others, beyond
chance, moves a score. With a constant discount below 1 the models' noise hides toxic texts: on the
held-out rows of sf0.1 the area under the curve is 0.64 then, 0.96 as it is.

A text's evidence is log p_toxic - log p_ordinary over its words, less what each word adds that
neither model supports, divided by the number of words to a power (the length normaliser). A
logistic curve with two coefficients turns it into a score of 0 to 1; curve and power are fitted on
one in HELD_OUT training texts, which the models don't see.

Counts are kept by 64-bit keys of words and bigrams in Spark's tables, which grow with the corpus.
A word that keeps nothing beyond the discounts adds nothing to the evidence, whatever its shared
count, so the model that is sent to executors holds the words, bigrams and first words of bigrams
that do keep something; they are of the labelled rows' vocabulary. The class counts come from at
most LABELLED labelled rows, those of the least hash of doc_id, a documented bound; within it whole
texts are used, equal texts once, of a doc_id with several texts the one of least hash.

Defined results: null and empty texts have no evidence and get the score of evidence 0; repeated
rows get equal scores; without usable labels of both classes every score is 0.5 - EPSILON, so
nothing is predicted toxic; an empty table gives an empty result; labels, lang, source and doc_id
are no input of a score; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import Recent, cut, docs_of, map_rows, ship_code

#: Labelled rows that class models are fitted on, at most.
LABELLED = 20_000
#: Fixed part of the discount of continuation counts and of bigram counts, and its standard errors.
D1, D2, Z = 3.0, 3.0, 4.0
#: One in so many training texts is for the curve.
HELD_OUT = 5
EPSILON = 1e-6
WORD = re.compile(r"[^\W\d_]+")
CACHE = 300_000
#: Words that a task gathers before it sums them up.
HELD = 1 << 20


class Keys:
    """64-bit key of a word, kept in a bounded cache."""

    def __init__(self):
        self.known = Recent(CACHE)

    def of(self, text: str) -> np.ndarray:
        get, put, out = self.known.get, self.known.put, []
        for word in WORD.findall(text.lower()):
            x = get(word)
            if x is None:
                # Never 0, which stands for the begin of a text.
                x = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1
                put(word, x)
            out.append(x)
        return np.array(out, dtype=np.int64)


_keys: list[Keys] = []


def keys_of(text: str | None) -> np.ndarray:
    if not _keys:
        _keys.append(Keys())
    return _keys[0].of(text or "")


def before(words: np.ndarray) -> np.ndarray:
    """The word before each; the first follows 0."""
    return np.concatenate([[0], words[:-1]]).astype(np.int64)


def pair_keys(left: np.ndarray, words: np.ndarray) -> np.ndarray:
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (words.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of every word over all rows; every task sums its own, then Spark sums by word."""
    ship_code(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        def summed(keys, n):
            keys, at = np.unique(keys, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, n)
            return keys, total

        def rows(keys, n):
            for at in range(0, len(keys), HELD // 4):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + HELD // 4]), pa.array(n[at : at + HELD // 4])], names=["word", "n"])

        keys, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for text in batch.column(batch.schema.get_field_index("text")):
                held.append(keys_of(text.as_py()))
                size += len(held[-1])
                if size > HELD:
                    found = np.concatenate(held)
                    keys, n = summed(np.concatenate([keys, found]), np.concatenate([n, np.ones(len(found), np.int64)]))
                    held, size = [], 0
                    if len(keys) > HELD:
                        yield from rows(keys, n)
                        keys, n = keys[:0], n[:0]
        found = np.concatenate([keys[:0], *held])
        yield from rows(*summed(np.concatenate([keys, found]), np.concatenate([n, np.ones(len(found), np.int64)])))

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def labelled(labels: DataFrame, wanted: Column, label: str = "toxic", limit: int = LABELLED) -> DataFrame:
    """(doc_id, label) of at most limit rows: those of the least hash. One label a document: the largest."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & wanted)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def train_rows(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(label, words, held): keys of each labelled text's words; held: is it for the curve. The sample is bounded, so it is broadcast."""
    rows = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("label", "text"), F.xxhash64("text")).alias("s")).select("s.label", "s.text")

    def start():
        return lambda labels, texts: (labels, [keys_of(x).tobytes() for x in texts])

    found = map_rows(rows, start, "label int, words binary")
    # Equal texts are one, with the label that most of them have: copies are no evidence of their own.
    found = found.groupBy("words").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    return found.select("label", "words", (F.pmod(F.xxhash64("words"), F.lit(HELD_OUT)) == 0).alias("held"))


def class_counts(rows: DataFrame) -> DataFrame:
    """(v, w, n0, n1): by label the texts that hold the bigram v w."""
    ship_code(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names = batch.schema.get_field_index
            for label, words in zip(batch.column(names("label")).to_pylist(), batch.column(names("words")).to_pylist(), strict=True):
                w = np.frombuffer(words, np.int64)
                if len(w):
                    # A bigram counts once a text, or one text that repeats itself would weigh as many.
                    v, w = np.unique(np.stack([before(w), w]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), pa.array(np.full(len(v), label, np.int32))], names=["v", "w", "label"])

    found = rows.select("label", "words").mapInArrow(run, "v bigint, w bigint, label int")
    return cut(found.groupBy("v", "w").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")))


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


@dataclass
class Side:
    """A class's model: kept, what each of the model's words keeps beyond its discount; free, the mass b; word, p(w) of these words; pairs, what each of the model's bigrams keeps; left, a(v) of each of their first words."""

    kept: np.ndarray
    free: float
    word: np.ndarray
    pairs: np.ndarray
    left: np.ndarray


@dataclass
class Model:
    #: Sorted keys of the words, the bigrams and the first words of bigrams that keep something in either class.
    words: np.ndarray
    pairs: np.ndarray
    left: np.ndarray
    toxic: Side
    ordinary: Side
    power: float = 1.0
    slope: float = 0.0
    shift: float = -4 * EPSILON

    def evidence(self, words: np.ndarray) -> tuple[float, int]:
        """Sum of log-likelihood differences beyond those of words that neither class supports, and the number of words."""
        if not len(words):
            return 0.0, 0
        v = before(words)
        at, known = find(self.words, words)
        after, tied = find(self.left, v)
        some = known | tied
        if not some.any():
            return 0.0, len(words)
        at, known, after, tied = at[some], known[some], after[some], tied[some]
        pair, paired = find(self.pairs, pair_keys(v[some], words[some]))
        total = 0.0
        for sign, side in ((1, self.toxic), (-1, self.ordinary)):
            a = np.where(tied, side.left[after], 1.0) if len(side.left) else 1.0
            own = np.where(paired, side.pairs[pair], 0.0) if len(side.pairs) else 0.0
            # Of other words, p is free times the shared part, which both models have.
            p = np.where(known, own + a * side.word[at], a * side.free) if len(side.word) else a * side.free
            total += sign * float((np.log(p) - np.log(side.free)).sum())
        return total, len(words)

    def score(self, evidence: float, n: int) -> float:
        z = self.slope * evidence / max(n, 1) ** self.power + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float, float]:
    """Slope, shift and log-loss of a one-variable logistic fit by Newton's steps; classes weigh alike."""
    scale = max(float(np.abs(x).std()), 1e-12)
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + 1e-6 * w
        step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + 1e-6 * np.eye(2), grad)
        w -= np.clip(step, -3, 3)
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-9, 1 - 1e-9)
    loss = -float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
    return float(w[0] / scale), float(w[1]), loss


def more(counts: Column, expected: Column, fixed: float) -> Column:
    """What counts keep beyond the discount."""
    return F.greatest(counts - expected - Z * F.sqrt(expected) - fixed, F.lit(0.0))


def fit(docs: DataFrame, pairs: DataFrame) -> Model | None:
    """The model of class_counts(); all that grows with the vocabulary stays in Spark's tables, what keeps something comes to the driver."""
    total = pairs.agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in (0, 1)), *(F.count_if(F.col(f"n{k}") > 0).alias(f"k{k}") for k in (0, 1))).first()
    if not (total.n0 and total.n1):
        return None
    corpus = cut(corpus_counts(docs))
    size = corpus.agg(F.sum("n").alias("n"), F.count("*").alias("types")).first()
    cont = pairs.groupBy("w").agg(*(F.count_if(F.col(f"n{k}") > 0).alias(f"k{k}") for k in (0, 1)))
    # One more of each word.
    shared = (F.coalesce("n", F.lit(0)) + 1) / float((size.n or 0) + size.types)
    words = cont.where(f"k0 > {D1} or k1 > {D1}").join(corpus, F.col("w") == F.col("word"), "left").select("w", "k0", "k1", shared.alias("shared"))
    kept = [(more(F.col(f"k{k}"), F.col("shared") * total[f"k{k}"], D1) / total[f"k{k}"]).alias(f"kept{k}") for k in (0, 1)]
    got = words.select("w", "shared", *kept).where("kept0 > 0 or kept1 > 0").toArrow().sort_by("w")
    column = lambda table, name: table.column(name).to_numpy().astype(float)
    keys = got.column("w").to_numpy()
    # A bigram keeps something only where its word does in this class.
    speaks = docs.sparkSession.createDataFrame([(int(w), bool(a > 0), bool(b > 0)) for w, a, b in zip(keys, column(got, "kept0"), column(got, "kept1"), strict=True)], "w bigint, s0 boolean, s1 boolean")
    both = F.col("n0") + F.col("n1")
    own = [F.when(F.col(f"s{k}"), more(F.col(f"n{k}"), both * (total[f"n{k}"] / (total.n0 + total.n1)), D2)).otherwise(0.0).alias(f"own{k}") for k in (0, 1)]
    left = pairs.groupBy("v").agg(F.sum("n0").alias("l0"), F.sum("n1").alias("l1"))
    tied = pairs.join(F.broadcast(speaks), "w").select("v", "w", *own).where("own0 > 0 or own1 > 0").join(left, "v").toArrow()
    of_pair = pair_keys(tied.column("v").to_numpy(), tied.column("w").to_numpy())
    order = np.argsort(of_pair)
    first, at = np.unique(tied.column("v").to_numpy(), return_inverse=True)
    sides = []
    for k in (0, 1):
        kept = column(got, f"kept{k}")
        free = float(1 - kept.sum())
        share = column(tied, f"own{k}") / np.maximum(column(tied, f"l{k}"), 1)
        sides.append(Side(kept, free, kept + free * column(got, "shared"), share[order], 1 - np.bincount(at, share, len(first))))
    return Model(keys, of_pair[order], first, sides[1], sides[0])


def train(docs: DataFrame, labels: DataFrame, wanted: Column | None = None, label: str = "toxic", limit: int = LABELLED) -> Model | None:
    """docs: of docs_of(binary=False). wanted: which label rows may be used. None without both classes."""
    spark = docs.sparkSession
    sample = labelled(labels, F.lit(True) if wanted is None else wanted, label, limit)
    rows = cut(train_rows(docs, sample))
    model = fit(docs, class_counts(rows.where("not held")))
    if model is None:
        return None
    # Where a class has too few texts for rows of its own, the curve is fitted on the models' rows too.
    apart = rows.where("held").agg(F.countDistinct("label")).first()[0] == 2
    rows = rows.where("held") if apart else rows
    held = spark.sparkContext.broadcast(model)

    def start():
        def one(label, words):
            w = np.frombuffer(words, np.int64)
            return held.value.evidence(w)

        return lambda labels, words: (labels, *zip(*map(one, labels, words), strict=True))

    got = map_rows(rows.select("label", "words"), start, "label int, evidence double, n bigint").toArrow()
    y, evidence, n = (got.column(c).to_numpy().astype(float) for c in ("label", "evidence", "n"))
    fits = [(*logistic(evidence / np.maximum(n, 1) ** power, y), power) for power in (1.0, 0.75, 0.5, 0.25)]
    slope, shift, _, power = min(fits, key=lambda x: x[2])
    model.power, model.slope, model.shift = power, max(slope, 0.0), shift
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, n_words, evidence and score of each row of docs_of(binary=False)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def one(text):
            m = held.value
            if m is None:
                return 0, 0.0, 0.5 - EPSILON
            evidence, n = m.evidence(keys_of(text))
            return n, evidence, m.score(evidence, n)

        return lambda ids, texts: (ids, *zip(*map(one, texts), strict=True))

    return map_rows(docs, start, "doc_id bigint, n_words bigint, evidence double, score double")


def toxicity(df: DataFrame, labels: DataFrame, wanted: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the labelled rows and score every row."""
    docs = docs_of(df, key, text, binary=False)
    return score(docs, train(docs, labels, wanted))
