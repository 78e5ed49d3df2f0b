"""Mixing sources to target weights by soft membership.

A classifier, fitted on at most LABELLED rows of a labelled table (those of the least hash of
doc_id, a documented bound), gives each document a posterior over domains. A document of t tokens
and posterior p adds r t p to the domains' expected token totals when it is taken at rate r. The
rates solve

    minimise  (A r - T)' W (A r - T),  0 <= r <= MOST,    A r = sum of r t p over all documents

by projected gradient steps from r = 1, accelerated (each step starts beyond the last rate by a part
of the last change) and begun anew where the residual rises. T are the targets. Distances between
rates are measured with the weight t, so that documents of equal posteriors get equal rates whatever
their lengths: the gradient of a rate, t p' W (A r - T), is divided by t. W is the inverse of
G + RIDGE tr(G) / K, G the sum of t p p' over all documents: so a step of length 1 is nearly exact
where no rate meets an end, and a domain of hardly any texts doesn't outweigh the others. A step is
one sum of 2 K numbers over all documents; the driver holds these and nothing else. A rate isn't
stored between steps: the K + 1 numbers of each step, in order, give it from p in the next scan, in
Spark's own functions.

A domain can't have more than MOST times the tokens that it has now. What its weight asks beyond
that goes to the others in proportion, so one without texts doesn't cost the others theirs.

A document is taken floor(rate + u) times, u a hash of its doc_id in [0, 1).

Defined results: null and empty texts have 0 tokens and the rate 1, since they weigh nothing;
repeated rows get equal posteriors and rates; domains without a labelled row have posterior 0;
without any labelled row posteriors are equal for all; targets out of reach (for rates up to MOST) are
met as closely as least squares can in STEPS steps; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.llm import rolling
from tallyproof.llm.common import cut, docs_of, map_rows, ship_code

U = np.uint64
LABELLED = 20_000
SLOTS = 1 << 17
#: No document is taken more often than this on average: a domain of few texts isn't filled up by endless copies of them.
MOST = 4.0
RIDGE = 1e-3
#: Steps at most; a relative residual below DONE ends them sooner, or a step that changes it by less than a part of STILL.
STEPS, DONE, STILL = 60, 1e-9, 1e-6
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UPPER = (np.arange(256) >= 65) & (np.arange(256) < 91)


def read_text(text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Table places of the words, figures of the text's form, and its tokens (words between white space)."""
    raw = np.frombuffer(text or b"", np.uint8)
    n = len(raw)
    tokens = int(np.count_nonzero(np.diff(~SPACE[raw], prepend=False) & ~SPACE[raw])) if n else 0
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(4), 0
    data = LOWER[raw]
    word = ~SEPARATOR[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    places = (rolling.between(rolling.prefix_sums(data), edge[::2], edge[1::2]) % U(SLOTS)).astype(np.int64)
    other = SEPARATOR[raw] & ~SPACE[raw]
    distinct = len(np.unique(places)) / max(len(places), 1)
    form = np.array([np.count_nonzero(other) / n, np.count_nonzero(UPPER[raw]) / n, distinct, np.log1p(tokens) / 10])
    return places, form, tokens


@dataclass
class Classifier:
    """weight[k]: by place, how much a word speaks for domain k; coef: softmax coefficients by domain; there: domains with rows."""

    weight: np.ndarray
    coef: np.ndarray
    there: np.ndarray

    def features(self, places: np.ndarray, form: np.ndarray) -> np.ndarray:
        said = self.weight[:, places].sum(axis=1) / np.sqrt(max(len(places), 1))
        return np.concatenate([[1.0], said, form])

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = self.coef @ x
        z = np.where(self.there, z - z[self.there].max(), -np.inf)
        e = np.exp(z)
        return e / e.sum()


def softmax_fit(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients by accelerated gradient steps on the mean log-loss."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1.0
    a, hot = x / scale, np.eye(k)[y]
    step = 1 / (0.5 * np.linalg.eigvalsh(a.T @ a / len(a))[-1] + ridge)
    w = ahead = np.zeros((k, a.shape[1]))
    for i in range(rounds):
        z = a @ ahead.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * ((p - hot).T @ a / len(a) + ridge * ahead)
        ahead = new + i / (i + 3) * (new - w)
        w = new
    return w / scale


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: Column, k: int, limit: int = LABELLED) -> Classifier:
    """docs: of docs_of(). domain: of a row of labels, 0 to k - 1; rows with another value aren't used."""
    ship_code(docs.sparkSession)
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), domain.cast("int").alias("domain"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("domain").between(0, k - 1))
    sample = rows.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # The sample has at most limit rows, so it is broadcast; of a doc_id with several texts the one of least hash is taken.
    texts = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("domain", "text"), F.xxhash64("text")).alias("s"))
    texts = cut(texts.select("s.domain", "s.text"))

    def count(batches):
        import pyarrow as pa

        total = np.zeros((k, SLOTS), np.int64)
        for batch in batches:
            names = batch.schema.get_field_index
            for d, text in zip(batch.column(names("domain")).to_pylist(), batch.column(names("text")).to_pylist(), strict=True):
                total[d][np.unique(read_text(text)[0])] += 1
        d, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[d, place])], names=["d", "place", "n"])

    got = texts.mapInArrow(count, "d int, place int, n bigint").groupBy("d", "place").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((k, SLOTS))
    table[got.column("d").to_numpy(), got.column("place").to_numpy()] = got.column("n").to_numpy()
    pooled, share = table.sum(axis=0), table.sum(axis=1) / max(table.sum(), 1)
    expected = pooled * share[:, None]
    # A word speaks for a domain only beyond what chance explains; so rare words say nothing.
    beyond = np.abs(table - expected) > 4 * np.sqrt(expected) + 3
    weight = np.where(beyond, np.log((table + 1) / (expected + 1)), 0.0).astype(np.float32)
    model = Classifier(weight, np.zeros((k, 5 + k)), np.ones(k, bool))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def one(text):
            places, form, _ = read_text(text)
            return held.value.features(places, form).tolist()

        return lambda domains, texts: (domains, list(map(one, texts)))

    got = map_rows(texts, start, "domain int, x array<double>").collect()
    held.unpersist()
    if got:
        y = np.array([r[0] for r in got])
        model.coef = softmax_fit(np.array([r[1] for r in got]), y, k)
        model.there = np.isin(np.arange(k), y)
    return model


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, tokens and p (posterior by domain) of each row of docs_of()."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def one(text):
            places, form, tokens = read_text(text)
            return tokens, held.value.posterior(held.value.features(places, form)).tolist()

        return lambda ids, texts: (ids, *zip(*map(one, texts), strict=True))

    return map_rows(docs, start, "doc_id bigint, tokens bigint, p array<double>")


def dot(p: Column, y: Column, k: int) -> Column:
    total = F.get(p, F.lit(0)) * F.get(y, F.lit(0))
    for i in range(1, k):
        total = total + F.get(p, F.lit(i)) * F.get(y, F.lit(i))
    return total


def states(steps: list[tuple[np.ndarray, float]], k: int, p: str = "p", most: float = MOST) -> Column:
    """(r, x) after these steps: the rate, and where the next step starts."""
    one = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("x"))
    if not steps:
        return one
    number = lambda x: f"{float(x)!r}D"
    made = F.expr("array(" + ", ".join(f"named_struct('y', array({', '.join(map(number, y))}), 'b', {number(b)})" for y, b in steps) + ")")

    def step(s, m):
        new = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), s["x"] - dot(F.col(p), m["y"], k)))
        return F.struct(new.alias("r"), (new + m["b"] * (new - s["r"])).alias("x"))

    return F.aggregate(made, one, step)


def rate(steps: list[tuple[np.ndarray, float]], k: int, p: str = "p", most: float = MOST) -> Column:
    """The rate after these steps, from 1."""
    return states(steps, k, p, most)["r"]


def norm_of(gram: np.ndarray) -> np.ndarray:
    """W."""
    k = len(gram)
    return np.linalg.pinv(gram + RIDGE * np.trace(gram) / k * np.eye(k), hermitian=True)


def targets_of(weights: list[float], now: list[float], most: float = MOST) -> list[float]:
    """Tokens by domain: the weights' parts of all tokens, none above most times what there is; what that leaves goes to the others in proportion."""
    want, free, left = [0.0] * len(now), set(range(len(now))), float(sum(now))
    while free:
        total = sum(weights[i] for i in free) or 1.0
        want = [left * weights[i] / total if i in free else x for i, x in enumerate(want)]
        full = {i for i in free if want[i] > most * now[i]}
        if not full:
            break
        for i in full:
            want[i] = most * now[i]
        left -= sum(want[i] for i in full)
        free -= full
    return want


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS, most: float = MOST) -> list[tuple[np.ndarray, float]]:
    """The steps (change by posterior, part of it that the next one goes beyond) whose rates take expected token totals to the targets."""
    k, want = len(targets), np.array(targets, float)
    at = lambda i: F.get("p", F.lit(i))
    gram = rows.agg(*(F.sum(F.col("tokens") * at(i) * at(j)).alias(f"c{i}_{j}") for i in range(k) for j in range(k))).first()
    weight = norm_of(np.array([x or 0.0 for x in gram]).reshape(k, k))
    made: list[tuple[np.ndarray, float]] = []
    since, last = 0, np.inf
    for _ in range(steps):
        r = rows.select("tokens", "p", states(made, k, most=most).alias("s"))
        got = r.agg(*(F.sum(F.col(f"s.{c}") * F.col("tokens") * at(i)).alias(f"{c}{i}") for c in "rx" for i in range(k))).first()
        got = np.array([x or 0.0 for x in got])
        off, ahead = got[:k] - want, got[k:] - want
        residual = float(off @ weight @ off)
        if np.abs(off).max() <= DONE * max(np.abs(want).max(), 1.0) or abs(last - residual) <= STILL * residual:
            break
        if residual > last:
            # Begin anew from the rates themselves.
            made[-1], since, ahead = (made[-1][0], 0.0), 0, off
        last = residual
        step = weight @ ahead
        if not np.abs(step).max() > 0:
            break
        made.append((step, since / (since + 3)))
        since += 1
    return made


def copies(r: Column, key: Column) -> Column:
    """How often a document is taken: floor(rate + u), u fixed by its doc_id."""
    u = F.pmod(F.xxhash64(F.lit("mixing"), key), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(r + u).cast("bigint")


def mix(
    df: DataFrame, labels: DataFrame, domain: Column, weights: list[float], relative: bool = False, key: str = "doc_id", text: str = "text", most: float = MOST
) -> DataFrame:
    """doc_id, tokens, p, rate and copies of each row.

    weights: of each domain its part of all tokens, whose total stays; relative: or its multiple of
    the tokens that it is expected to have now.
    """
    docs, k = docs_of(df, key, text), len(weights)
    model = fit_classifier(docs, labels, domain, k)
    rows = cut(memberships(docs, model))
    now = [x or 0.0 for x in rows.agg(*(F.sum(F.col("tokens") * F.get("p", F.lit(i))) for i in range(k))).first()]
    targets = [w * x for w, x in zip(weights, now, strict=True)] if relative else targets_of(weights, now, most)
    made = fit_rates(rows, targets, most=most)
    return rows.withColumn("rate", rate(made, k, most=most)).withColumn("copies", copies(F.col("rate"), F.coalesce("doc_id", F.lit(-1))))
