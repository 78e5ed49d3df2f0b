"""Near copies, repeated strings, mixing, toxicity and the pipeline against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tallyproof.llm import mixing, near_dup, suffix_dedup, toxicity
from tests.llm.conftest import prose, texts_of


def removed(docs, size=100):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: 2**63 if x[0] is None else x[0]):
        if i in out:
            continue
        data, mark = t.encode(), bytearray(len(t.encode()))
        for p in range(len(data) - size + 1):
            w = data[p : p + size]
            if w in seen:
                mark[p : p + size] = b"\1" * size
            seen.add(w)
        kept = bytes(c for c, m in zip(data, mark, strict=True) if not m)
        out[i] = (len(data), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group", [20_000, 3])
def test_repeats(odd_documents, group):
    rows = suffix_dedup.remove_repeats(odd_documents, group=group).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows}
    assert got == removed(texts_of()) and len(rows) == len(texts_of())


def test_repeats_of_nothing(empty_documents):
    assert suffix_dedup.remove_repeats(empty_documents).count() == 0


def test_long_texts_are_cut_into_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    data = np.random.default_rng(2).integers(97, 100, 3000).astype(np.uint8)
    _, _, lo, hi = suffix_dedup.of_text(data)
    covered = sorted(w for a, b in zip(lo, hi, strict=True) for w in range(a, b + 1))
    assert covered == list(range(3000 - 99))


def factor(s, places, i, size):
    """The longest string at a place, up to size, that an earlier place has."""
    return max((next((k for k in range(size) if s[i + k] != s[j + k]), size) for j in places if j < i), default=0)


@pytest.mark.parametrize("size", [8, 12, 37, 100])
def test_longest_previous_factors(size):
    rng = np.random.default_rng(5)
    for n, letters in ((0, 2), (1, 1), (40, 2), (90, 3), (30, 1), (60, 26)):
        s = bytes(rng.integers(97, 97 + letters, n + size - 1).astype(np.uint8))
        places = np.arange(n) if n % 3 else np.arange(0, n, 2)
        if not len(places):
            continue
        got = suffix_dedup.previous_factors(np.frombuffer(s, np.uint8), places, size)
        assert got.tolist() == [factor(s, places, i, size) for i in places]


def test_smaller_before_is_the_brute_force():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 8, 33, 100):
        for place in (rng.permutation(n), np.arange(n), np.arange(n)[::-1], np.append(np.arange(1, n), 0)):
            common = rng.integers(0, 9, n)
            want = []
            for i in range(n):
                j = next((j for j in range(i - 1, -1, -1) if place[j] < place[i]), None)
                want.append(0 if j is None else int(common[j + 1 : i + 1].min()))
            assert suffix_dedup.smaller_before(place, common).tolist() == want


def test_documents_that_share_a_doc_id_or_have_none(spark):
    """Each text loses what an earlier one has; no text is cut at another's places."""
    import random

    rng = random.Random(31)
    a, b, c = (prose(rng, 80, 10**6) for _ in range(3))
    rows = [(1, a), (2, b), (2, c + " " + a), (None, c), (None, "x" + b), (None, c), (2, b)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    tag = {r.text: r.t for r in suffix_dedup.numbered(suffix_dedup.docs_of(df)).selectExpr("cast(text as string) text", "t").collect()}
    # The same texts numbered in the order that the docstring gives.
    texts = sorted({(2**63 if i is None else i, tag[t], t) for i, t in rows})
    want = removed([(k, t) for k, (_, _, t) in enumerate(texts)])
    of = {(i, t): want[k] for k, (i, _, t) in enumerate(texts)}
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == Counter((i, *of[2**63 if i is None else i, t]) for i, t in rows)


def groups(docs, w, percent=80):
    sets = {}
    for i, t in docs:
        words = t.encode().lower().split()
        sets[i] = frozenset([tuple(words[k : k + w]) for k in range(len(words) - w + 1)] or ([tuple(words)] if words else []))
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if b < a and sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("w", [4, 5])
def test_near_duplicates(odd_documents, w):
    rows = near_dup.near_duplicates(odd_documents, w=w).collect()
    want = groups(texts_of(), w)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    # The row without doc_id has the text of document 7.
    assert [r.component_id for r in rows if r.doc_id is None] == [want[7][1]]
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in rows) and len(rows) == len(texts_of())


def test_groups_whose_copies_are_linked_through_one_text(spark, monkeypatch):
    """Copies at 0.7 of each other and at 0.85 of a base that isn't the smallest; small blocks, so that tiles meet."""
    import random

    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "BUCKET", 5)
    rng = random.Random(11)
    docs, n = [], 0
    for _ in range(3):
        base = prose(rng, 240, 10**6).split()
        group = []
        for k in range(24):
            copy = list(base)
            for _ in range(5 if k % 4 else 9):
                copy[rng.randrange(240)] = f"y{rng.randint(0, 10**9)}"
            group.append(" ".join(copy))
        group.insert(15, " ".join(base))
        docs += [(n + i, t) for i, t in enumerate(group)]
        n += len(group)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, w=4).collect()}
    assert got == groups(docs, 4)


def test_rows_without_doc_id_and_rows_that_share_one(spark):
    """Near copies without doc_id are grouped with others; rows of one doc_id are grouped each by its own text."""
    import random

    rng = random.Random(21)
    a, b, c = (prose(rng, 150, 10**6).split() for _ in range(3))
    changed = lambda x, k: " ".join([*x[:k], f"z{k}", *x[k + 1 :]])
    docs = [(None, changed(a, 3)), (5, " ".join(a)), (5, " ".join(b)), (9, changed(b, 7)), (None, " ".join(c)), (None, changed(c, 9)), (9, changed(b, 7))]
    rows = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), w=4).collect()
    found = Counter((r.doc_id, r.component_id, r.kept) for r in rows)
    assert found == Counter({(None, 5, False): 1, (5, 5, True): 2, (9, 5, False): 2, (None, None, False): 2})


def merged(label, pairs):
    """Groups as sets of places, after the pairs join them."""
    label = list(label)
    for a, b in pairs:
        old, new = label[a], label[b]
        label = [new if x == old else x for x in label]
    return {frozenset(i for i, x in enumerate(label) if x == g) for g in label}


def test_families_bridged_by_single_pairs_join_though_the_largest_changes():
    # A leads and its bridge 0-8 is put off; then B and C merge through 5-9 and outgrow A.
    label, edges = [0] * 5 + [1] * 4 + [2] * 4, {(0, 8), (5, 9)}
    cases = [(label, edges, [0, 5, 8, 9, *range(1, 5), 6, 7, 10, 11, 12])]
    rng = np.random.default_rng(12)
    for _ in range(300):
        n = int(rng.integers(4, 30))
        cases.append((rng.integers(0, n // 2, n), set(map(tuple, rng.integers(0, n, (n // 3, 2)).tolist())), rng.permutation(n)))
    for label, edges, order in cases:
        hits = lambda i, e=edges: sorted({b for a, b in e if a == i} | {a for a, b in e if b == i} | {i})
        found = near_dup.joining(np.array(order), np.unique(label, return_inverse=True)[1], hits)
        assert merged(label, found) == merged(label, edges)


def test_far_groups_that_outgrow_the_near_one_are_tied_to_it(spark):
    """A bucket of two near members and a larger far family; only one far member, which the first look takes in, ties to a near one."""
    at = lambda *bits: np.packbits(np.isin(np.arange(near_dup.BITS), bits)).view(np.int64).tolist()
    family = [at(*range(k, k + 20)) for k in range(5)]
    rows = [(1, 1, at(*range(200, 220))), (2, 1, at(*range(6, 26)))] + [(10 + k, 10 + k, x) for k, x in enumerate(family)]
    df = spark.createDataFrame([(7, *r) for r in rows], "key bigint, id bigint, cluster bigint, sketch array<bigint>")
    found = [(r.a, r.b) for r in near_dup.far_ties(df, 4).collect()]
    assert len(merged(range(16), found) & {frozenset([1, *range(10, 15)])}) == 1


def test_near_duplicates_of_nothing(empty_documents):
    assert near_dup.near_duplicates(empty_documents).count() == 0


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for j in (0.95, 0.8, 0.6):
        errors = []
        for _ in range(40):
            n = 1000
            both = int(2 * n * j / (1 + j))
            x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = (near_dup.odd_sketch(near_dup.min_hashes(s)) for s in (x[:n], x[n - both :]))
            bits = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
            errors.append(near_dup.similarity(bits) - j)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (41, 50)]
    got = {r.id: r.comp for r in near_dup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 41: 40, 50: 40}


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        words = ["the" if rng.random() < 0.05 else f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 120))]
        kind = i % 4
        for _ in range(4 if kind == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "rotten"]))
        text = " ".join(w + "###" for w in words) if kind == 1 else " ".join(words)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if kind == 1 else 1, int(kind == 0), "clash"))
    docs += [(600, None, None, None, None), (601, "", None, None, None), docs[0]]
    labels += [(None, 1, 1, "x"), (5, None, None, "x"), labels[3], (9999, 1, 0, "x")]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string"),
    )


def test_toxicity_held_out(spark, labelled):
    from tallyproof.llm.queries import held_out

    docs, labels = labelled
    rows = toxicity.toxicity(docs, labels, ~held_out()).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    import zlib

    held = [r for r in rows if r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held)
    assert len(held) > 80 and right / len(held) > 0.97
    # Without labels nothing is called toxic, and an empty table stays one.
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert all(r.score < 0.5 for r in none)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxic_word_keeps_counts_of_its_own(spark):
    """A word that would share a place of a table of 2^18 with a word of every ordinary text."""
    import itertools
    import random
    import string
    import zlib

    place = lambda x: zlib.crc32(x.encode()) % ((1 << 18) - 1)
    other = next(x for x in map("".join, itertools.product(string.ascii_lowercase, repeat=5)) if place(x) == place("vile"))
    rng = random.Random(6)
    words = ["".join(rng.choices(string.ascii_lowercase, k=3)) for _ in range(300)]
    texts = [" ".join([*rng.choices(words, k=20), "vile" if i % 4 == 0 else other, *rng.choices(words, k=5)]) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in rows)
    counted = Counter(x for t in texts for x in toxicity.keys_of(t).tolist())
    assert {r.word: r.n for r in toxicity.corpus_counts(docs).collect()} == counted


def test_kneser_ney_levels_sum_to_one_and_scores_are_the_brute_force(spark, labelled, monkeypatch):
    """The model that the query uses, against its formulas written out with dictionaries."""
    import math

    monkeypatch.setattr(toxicity, "D1", 1.0)
    monkeypatch.setattr(toxicity, "D2", 0.5)
    monkeypatch.setattr(toxicity, "Z", 0.2)
    from tallyproof.llm.common import docs_of

    docs, labels = docs_of(labelled[0], binary=False), labelled[1]
    rows = toxicity.train_rows(docs, toxicity.labelled(labels, toxicity.F.lit(True))).collect()
    texts = {r.label: [] for r in rows}
    for r in rows:
        if not r.held:
            texts[r.label].append(np.frombuffer(r.words, np.int64).tolist())
    assert sum(r.held for r in rows) > 50
    s = Counter(x for (t,) in docs.select("text").collect() for x in toxicity.keys_of(t).tolist())
    n_all = sum(s.values()) + len(s)
    c = [Counter(g for t in texts[k] for g in set(zip([0, *t[:-1]], t, strict=True))) for k in (0, 1)]
    cont = [Counter(w for _, w in c[k]) for k in (0, 1)]
    cut_off = lambda x, e, d: max(x - e - 0.2 * math.sqrt(e) - d, 0)
    kept = [{w: cut_off(x, (s[w] + 1) / n_all * len(c[k]), 1.0) / len(c[k]) for w, x in cont[k].items()} for k in (0, 1)]
    size = [sum(x.values()) for x in c]
    own, left = [{}, {}], [Counter(), Counter()]
    for k in (0, 1):
        for (v, _), n in c[k].items():
            left[k][v] += n
        for (v, w), n in c[k].items():
            got = cut_off(n, (c[0][v, w] + c[1][v, w]) * size[k] / sum(size), 0.5) if kept[k].get(w) else 0
            own[k][v, w] = got / left[k][v]
    mass = [Counter(), Counter()]
    for k in (0, 1):
        for (v, _), x in own[k].items():
            mass[k][v] += x

    def p(k, v, w):
        return own[k].get((v, w), 0) + (1 - mass[k][v]) * (kept[k].get(w, 0) + (1 - sum(kept[k].values())) * (s[w] + 1) / n_all)

    model = toxicity.train(docs, labels)
    assert len(model.pairs) > 5 and len(model.words) > 3
    for k, side in ((0, model.ordinary), (1, model.toxic)):
        assert abs(side.kept.sum() + side.free - 1) < 1e-12 and (side.left > 0).all()
        for v in [0, 12345, *model.left.tolist()[:20]]:
            assert abs(sum(p(k, v, w) for w in s) - 1) < 1e-9
    neutral = math.log((1 - sum(kept[1].values())) / (1 - sum(kept[0].values())))
    for r in rows[:150]:
        t = np.frombuffer(r.words, np.int64)
        want = sum(math.log(p(1, v, w) / p(0, v, w)) - neutral for v, w in zip([0, *t[:-1].tolist()], t.tolist(), strict=True))
        assert abs(model.evidence(t)[0] - want) < 1e-9 * max(abs(want), 1)


def test_toxicity_of_long_texts_and_repeated_doc_ids(spark, labelled):
    docs, labels = labelled
    long = "w5 the w7 w9 " * 50_000
    more = spark.createDataFrame([(5000, long), (5000, "w1 w2 w3"), (None, long)], "doc_id bigint, text string")
    rows = toxicity.toxicity(docs.select("doc_id", "text").union(more), labels.select("doc_id", "toxic").union(spark.createDataFrame([(5000, 1)], "doc_id bigint, toxic int"))).collect()
    assert len(rows) == docs.count() + 3
    of_long = [r.score for r in rows if r.doc_id is None and r.n_words > 9] + [r.score for r in rows if r.doc_id == 5000 and r.n_words > 9]
    assert len(of_long) == 2 and of_long[0] == of_long[1] < 0.5
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in rows if r.doc_id is not None and r.doc_id < 600) > 580


def test_mixing_meets_targets(spark, labelled):
    from tallyproof.llm.queries import domain

    docs, labels = labelled
    rows = mixing.mix(docs, labels, domain(), [0.6, 0.3, 0.1]).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    total = sum(r.tokens for r in rows)
    for k, w in enumerate((0.6, 0.3, 0.1)):
        assert abs(sum(r.rate * r.tokens * r.p[k] for r in rows) - w * total) < 1e-6 * total
    assert all(r.tokens == len((t or "").split()) for r, t in ((r, docs_text(docs)[r.doc_id]) for r in rows if r.doc_id is not None))
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    # Posteriors follow the labels.
    right = sum(int(np.argmax(r.p)) == {0: 2, 1: 1}.get(r.doc_id % 4, 0) for r in rows if r.doc_id < 600)
    assert right > 570
    assert mixing.mix(docs, labels.limit(0), domain(), [0.6, 0.3, 0.1]).count() == docs.count()
    assert mixing.mix(docs.limit(0), labels, domain(), [0.6, 0.3, 0.1]).count() == 0


_texts = {}


def docs_text(docs):
    if not _texts:
        _texts.update({r.doc_id: r.text for r in docs.collect()})
    return _texts


def dense_residual(p, t, want, rounds=50_000):
    """The least weighted residual over rates from 0 to MOST, by multiplicative updates on the nonnegative form of the normal equations."""
    a = (p * t[:, None]).T
    gram = (p * t[:, None]).T @ p
    w = np.linalg.inv(gram + 1e-3 * np.trace(gram) / 3 * np.eye(3))
    q, c = a.T @ w @ a, a.T @ w @ want
    plus, minus, r = np.maximum(q, 0), np.maximum(-q, 0), np.ones(len(t))
    for _ in range(rounds):
        up, down = plus @ r, minus @ r
        r = np.minimum(r * (c + np.sqrt(c * c + 4 * up * down)) / np.maximum(2 * up, 1e-300), mixing.MOST)
    return (a @ r - want) @ w @ (a @ r - want), a, w


@pytest.mark.parametrize(("kind", "multiples"), [("spread", (2.0, 0.2, 0.6)), ("spread", (0.5, 1.5, 1.0)), ("two", (3.0, 0.0, 0.0)), ("two", (0.5, 1.5, 0.2)), ("spread", (9.0, 9.0, 9.0))])
def test_fitted_rates_against_a_dense_solver(spark, kind, multiples):
    """fit_rates on a table: targets in reach are met, others as closely as a dense solver does."""
    rng = np.random.default_rng(8)
    t, p = rng.integers(1, 50, 60), rng.dirichlet([0.3, 0.3, 0.3], 60)
    if kind == "two":
        # All documents share the middle domain, so few targets are in reach.
        p = np.where((np.arange(60) % 2 == 0)[:, None], [0.6, 0.4, 0.0], [0.0, 0.5, 0.5])
    df = spark.createDataFrame([(i, int(x), list(map(float, y))) for i, (x, y) in enumerate(zip(t, p, strict=True))], "doc_id bigint, tokens bigint, p array<double>")
    want = (p * t[:, None]).sum(axis=0) * np.array(multiples)
    made = mixing.fit_rates(df, want.tolist())
    rates = {r.doc_id: r.rate for r in df.withColumn("rate", mixing.rate(made, 3)).collect()}
    r = np.array([rates[i] for i in range(60)])
    least, a, w = dense_residual(p, t, want)
    off = a @ r - want
    assert (r >= 0).all() and len(made) <= mixing.STEPS
    assert off @ w @ off <= least * (1 + 1e-3) + 1e-6
    assert r.max() <= mixing.MOST
    if multiples == (9.0, 9.0, 9.0):
        assert np.allclose(r, mixing.MOST)
    elif kind == "spread":
        assert np.abs(off).max() <= 1e-6 * want.max()
    elif multiples == (3.0, 0.0, 0.0):
        assert least > 1 and (r == 0).any()


def test_targets_beyond_what_domains_can_have_go_to_the_others():
    assert np.allclose(mixing.targets_of([0.8, 0.15, 0.05], [50, 30, 20], 4.0), [80, 15, 5])
    assert np.allclose(mixing.targets_of([0.8, 0.15, 0.05], [89, 0, 11], 4.0), [100 * 0.8 / 0.85, 0, 100 * 0.05 / 0.85])
    assert np.allclose(mixing.targets_of([0.5, 0.5], [99, 1], 4.0), [96, 4]) and mixing.targets_of([0.5, 0.5], [0, 0]) == [0, 0]


def test_mixing_of_long_texts_and_repeated_doc_ids(spark, labelled):
    from tallyproof.llm.queries import domain

    docs, labels = labelled
    more = spark.createDataFrame([(3, "word other " * 100_000), (3, "a third text"), (None, "x " * 10)], "doc_id bigint, text string")
    rows = mixing.mix(docs.select("doc_id", "text").union(more), labels, domain(), [0.6, 0.3, 0.1]).collect()
    assert len(rows) == docs.count() + 3 and max(r.tokens for r in rows) == 200_000


def kept_text(docs):
    """Of each (doc_id, text), the text without the code points that lie whole in bytes to remove."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        data, mark = t.encode(), bytearray(len(t.encode()))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(w)
        at, kept = 0, []
        for c in t:
            n = len(c.encode())
            if not all(mark[at : at + n]):
                kept.append(c)
            at += n
        out[i] = "".join(kept)
    return out


def test_pipeline(spark, tmp_path, documents, labelled):
    import corpus_pipeline

    from pyspark.sql import functions as F

    from tallyproof.llm import quality_rules
    from tallyproof.llm.queries import WEIGHTS, domain

    docs = documents.where("doc_id is not null").distinct().union(labelled[0].where("doc_id < 160").distinct().selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars"))
    # Long plain texts that share a passage and pass the quality rules.
    passage = prose(__import__("random").Random(8), 40)
    shared = [(3000 + k, prose(__import__("random").Random(50 + k), 120, 10**4) + " " + passage, "en", "s", 0) for k in range(5)]
    docs = docs.union(spark.createDataFrame(shared, docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    # Texts of low quality don't pass the rules, so that domain has no labelled text and its weight goes to the others.
    labelled[1].selectExpr("doc_id + 1000 as doc_id", "quality", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.n_pieces == len(r.piece_ids) for r in rows)
    # Stage by stage: columns stay, and each decision is the plain version's.
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cut_short = 0
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.collect()]
        after = stage(spark, now, str(tmp_path)).collect()
        assert after[0].__fields__[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.judge(now).collect() if r.kept}
            assert {tuple(r) for r in after} == {r for r in before if r[0] in kept} and 0 < len(after) < len(before)
        if name == "minhash_near_dedup":
            want = groups([(i, t or "") for i, t, *_ in before], 5)
            assert Counter(r.doc_id for r in after) == Counter(r[0] for r in before if want[r[0]][1] == r[0])
        if name == "suffix_array_dedup":
            want = kept_text([(r[0], r[1]) for r in before])
            assert {r.doc_id: (r.text, r.n_chars) for r in after} == {i: (t, len(t)) for i, t in want.items() if t}
            cut_short = sum(want[r[0]] != r[1] for r in before)
        if name == "mixing":
            assert len(after) <= (mixing.MOST + 1) * len(before)
            mixed = mixing.mix(now, spark.read.parquet(str(tmp_path / "labels.parquet")), domain(), list(WEIGHTS)).collect()
            assert Counter(r.doc_id for r in after) == Counter({r.doc_id: r.copies for r in mixed if r.copies})
        if name == "sentencepiece":
            assert Counter(before) == Counter(tuple(r)[:5] for r in after)
        now = spark.createDataFrame([tuple(r)[:5] for r in after], docs.schema)
    assert cut_short >= 4
    # An empty table goes through all stages.
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    labelled[1].select("doc_id", "quality", "toxic").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    # Rows without doc_id and with extra columns of clashing names.
    odd = documents.withColumns({"kept": F.lit(1), "ranges": F.lit("x"), "copies": F.lit(9)})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, str(tmp_path)).count() > 0
