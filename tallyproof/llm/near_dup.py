"""Near-duplicate groups by MinHash bands with odd sketches, each link confirmed on full sets.

A text's set are its distinct w-word shingles. Texts with equal sets form a class, its smallest
doc_id stands for it; all that follows works on classes, so exact copies cost one grouped minimum.

SAMPLES MinHash values of a set make BANDS band keys of ROWS values each. They are also folded
into an odd sketch: each sample flips one of BITS bits, so the XOR of two sketches holds the
parity of their samples' symmetric difference, whose population count gives the Jaccard similarity
with little error where it is high. Sets at the threshold 0.8 share no band with a probability of
(1 - 0.8 ** ROWS) ** BANDS, 1.3e-7 for the values here.

Candidates come without pairing a bucket's members with each other:

1. Each member is paired with one hub, the least of the smallest members of its buckets. Pairs
   whose sketches allow a similarity of threshold - MARGIN (over four standard errors) put both in
   one coarse cluster, and are links if the full sets say so. Every member has one hub, so both
   make forests, whose roots are found by pointer doubling.
2. A bucket's other pairs (member, smallest member) are looked at only where they may still join
   two clusters or two components; those that do are contracted to pairs of labels.
3. In buckets whose members are still of several clusters, these are compared by sketch, and
   ties that join clusters are given out, fewer than the bucket has members.
4. Clusters whose members aren't linked into one component yet are compared in full: an index
   of shared shingles counts a member's exact overlap with all others of two blocks at once;
   members that end in the largest component are compared with nothing, the most central ones
   are taken first, and only links that join components are given out. So many copies of one
   text cost one comparison each, and no list of pairs is ever made.

Groups of any size are dealt to tasks in blocks, two and two: BUCKET members by sketch, BLOCK by
full sets. A block is a hash range of the group, known from the group's size alone, so no task
numbers a whole group; members of one large component have blocks of their own, and pairs of
blocks that hold one label only are left out. Hubs and classes with many rows are salted.

Sets are compared as 64-bit hashes of their shingles; classes are told apart by 128 bits of all
hashes of a set.

Defined results: a text with fewer than w words is one shingle; null, empty and blank texts have
none and are linked with nothing; repeated rows and ties are in one group, the smallest doc_id
stands for it; rows that share a doc_id but differ in text are grouped each by its own text; rows
with a null doc_id are grouped like all others and never kept, and a group of such rows only has a
null component_id; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.llm import rolling
from tallyproof.llm.common import LAST_DOC, cut, docs_of, drop_cut, map_rows, release, ship_code

U = np.uint64
BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
BITS = 512
THRESHOLD = 0.8
MARGIN = 0.15
#: Documents of a block: by full sets, and by sketches.
BLOCK, BUCKET = 4096, 8192
#: A key with more than one row in HOT is salted; pairs of one hub that are compared in one task.
HOT, SALTS, LINKS = 1000, 32, 1000
_random = np.random.Generator(np.random.PCG64(7))
FACTORS = _random.integers(1, 2**63, SAMPLES, dtype=np.uint64) * U(2) + U(1)
PLACE = _random.integers(1, 2**63, 8, dtype=np.uint64) * U(2) + U(1)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(text: bytes | None, w: int) -> np.ndarray:
    """Sorted hashes of the distinct w-word shingles; with fewer words, of all words as one."""
    data = LOWER[np.frombuffer(text or b"", np.uint8)]
    word = ~BLANK[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = rolling.between(rolling.prefix_sums(data), start, end)
    size = min(n, w)
    total = np.full(n - size + 1, U(size))
    for k in range(size):
        total += hashes[k : n - size + 1 + k] * PLACE[k % 8] + U(k)
        if size > 1:
            total = total ^ (total >> U(29))
    return np.unique(rolling.mix(total))


def min_hashes(items: np.ndarray) -> np.ndarray:
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 1024):
        np.minimum(best, (items[at : at + 1024, None] * FACTORS).min(axis=0), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = rolling.mix(key + rows[:, k] * PLACE[k])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """BITS bits as int64 words."""
    place = rolling.mix(samples + np.arange(SAMPLES, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F)) % U(BITS)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=BITS) & 1).view(np.int64)


def similarity(differing: int, samples: int = SAMPLES, bits: int = BITS) -> float:
    """Jaccard similarity that odd sketches differing in so many bits stand for."""
    left = max(1 - 2 * differing / bits, 1e-9)
    return max(0.0, 1 - np.log(left) / np.log(1 - 2 / bits) / (2 * samples))


def most_differing(least: float) -> int:
    """The most bits in which sketches of sets this similar are taken to differ."""
    return int(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - least))))


def signatures(docs: DataFrame, w: int) -> DataFrame:
    """docs: doc_id, text, and maybe tag (a hash of the text), which is handed on."""
    docs = docs if "tag" in docs.columns else docs.withColumn("tag", F.xxhash64("text"))

    def start():
        def one(text):
            items = shingles(text, w)
            if not len(items):
                return 0, None, None, None
            samples = min_hashes(items)
            return len(items), hashlib.blake2b(items.tobytes(), digest_size=16).digest(), band_keys(samples), odd_sketch(samples)

        return lambda ids, tags, texts: (ids, tags, *zip(*map(one, texts), strict=True))

    return map_rows(docs.select("doc_id", "tag", "text"), start, "doc_id bigint, tag bigint, n bigint, set_id binary, bands array<bigint>, sketch array<bigint>")


def differing(a: str, b: str) -> Column:
    bits = [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(BITS // 64)]
    total = bits[0]
    for x in bits[1:]:
        total = total + x
    return total


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over undirected edges (a, b); ids without edges have no row.

    Each round takes the smallest label among the neighbours, then the label's own label, so the
    number of rounds grows with the logarithm of a chain's length.
    """
    spark, at = edges.sparkSession, []
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), at)
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        new = label.join(near, "id").select("id", "comp", F.least("comp", "m").alias("new"))
        up = label.select(F.col("id").alias("new"), F.col("comp").alias("up"))
        old: list[str] = []
        done = cut(new.join(up, "new", "left").select("id", F.least("new", F.coalesce("up", "new")).alias("comp"), (F.least("new", F.coalesce("up", "new")) < F.col("comp")).alias("moved")), old)
        if not done.where("moved").limit(1).count():
            drop_cut(spark, at)
            return label
        label = done.select("id", "comp")


def roots(parents: DataFrame) -> DataFrame:
    """(id, root) of a forest (id, up) in which every id has one up; roots themselves have no row."""
    now = cut(parents.select("id", F.col("up").alias("root")))
    while True:
        above = now.select(F.col("id").alias("root"), F.col("root").alias("higher"))
        done = cut(now.join(above, "root", "left").select("id", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        if not done.where("moved").limit(1).count():
            return now
        now = done.select("id", "root")


def spread(big: DataFrame, small: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of big with small, whose weight column says how many rows of big each key has.

    Keys with more than one in HOT of these rows are fewer than HOT, so their hashes are a list in
    the plan; their rows in big get one of SALTS salts, their row in small is dealt to each.
    """
    rows = small.agg(F.sum(weight)).first()[0] or 0
    hot = [r[0] for r in small.where(F.col(weight) > rows / HOT + SALTS).select(F.xxhash64(key)).collect()]
    # One plan whatever the data: without hot keys the list holds a value that is as good as any.
    is_hot, none = F.xxhash64(key).isin(hot or [0]), F.lit(0).cast("bigint")
    salt = F.pmod(F.xxhash64(*(c for c in big.columns if c != key)), F.lit(SALTS).cast("bigint"))
    sides = small.withColumn("salt", F.explode(F.when(is_hot, F.sequence(none, F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(none))))
    return big.withColumn("salt", F.when(is_hot, salt).otherwise(none)).join(sides, [key, "salt"]).drop("salt")


def link(pairs: DataFrame, sets: DataFrame, w: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b) that the full sets of sets(id, text) link.

    A text is sent to a pair's b; one with many pairs is dealt in salts of LINKS pairs.
    """
    salts = pairs.groupBy("b").agg(F.count("*").alias("n")).select("b", F.ceil(F.col("n") / LINKS).alias("salts"))
    left = sets.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    hubs = salts.join(sets.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts")
    rows = pairs.select("a", "b").join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts"))).drop("salts")
    rows = rows.join(left, "a").join(hubs, ["b", "salt"]).select("a", "b", "ta", "tb")

    def start():
        last: list = [None, None]

        def one(ta, tb):
            x = shingles(ta, w)
            if last[0] != tb:
                last[:] = tb, shingles(tb, w)
            y = last[1]
            both = len(x) + len(y) - len(np.union1d(x, y))
            return 100 * both >= percent * (len(x) + len(y) - both)

        return lambda a, b, ta, tb: (a, b, list(map(one, ta, tb)))

    return map_rows(rows, start, "a bigint, b bigint, linked boolean").where("linked").select("a", "b")


def central_first(sketch: np.ndarray) -> np.ndarray:
    """Places in order of distance from the sketches' bitwise majority: a text that many copies stem from comes first."""
    bits = np.unpackbits(sketch.view(np.uint8).reshape(len(sketch), -1), axis=1)
    return np.argsort((bits != (bits.mean(axis=0) > 0.5)).sum(axis=1), kind="stable")


def joining(order: np.ndarray, label: np.ndarray, hits) -> list[tuple[int, int]]:
    """Pairs of places that join groups; label: each place's group, changed here; hits(i): places that i goes with.

    Two places may both stay without a look only if they end in one group, and the largest group
    changes while groups merge. So members of the largest one are put off to a second pass, where one group is skipped and keeps its label.
    """
    found: list[tuple[int, int]] = []
    count = np.bincount(label)

    def look(i, keep=-1):
        for j in hits(i):
            if label[j] != label[i]:
                found.append((int(i), int(j)))
                old, new = (label[i], label[j]) if label[j] == keep else (label[j], label[i])
                label[label == old] = new
                count[new] += count[old]
                count[old] = 0

    later: list = []
    for i in order:
        if label[i] != count.argmax():
            look(i)
        elif count.max() == len(label):
            return found
        else:
            later.append(i)
    skipped = count.argmax()
    for i in later:
        if label[i] != skipped:
            look(i, skipped)
    return found


def tile_links(ids: np.ndarray, comp: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join components among these documents, found by exact overlaps."""
    m, size = len(ids), np.array(list(map(len, sets)))
    owner = np.repeat(np.arange(m), size)
    items, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[inverse] > 1
    owner, inverse = owner[shared], inverse[shared]
    order = np.argsort(inverse, kind="stable")
    post = owner[order]
    starts = np.searchsorted(inverse[order], np.arange(len(items) + 1))
    mine = np.searchsorted(owner, np.arange(m + 1))

    def hits(i):
        lists = inverse[mine[i] : mine[i + 1]]
        if not len(lists):
            return ()
        both = np.bincount(np.concatenate([post[starts[k] : starts[k + 1]] for k in lists]), minlength=m)
        return np.flatnonzero(100 * both >= percent * (size + size[i] - both))

    label = np.unique(comp, return_inverse=True)[1]
    return [(int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))) for i, j in joining(central_first(sketch), label, hits)]


def in_blocks(rows: DataFrame, by: str, label: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their block, the pairs (by, t0, t1) of blocks that bring each two rows of a group and of two labels together).

    Labels with many rows of a group have blocks of their own, others share blocks.
    """
    sizes = rows.groupBy(by, label).agg(F.count("*").alias("n"))
    own = F.col("n") * 4 > size
    rest = sizes.groupBy(by).agg(F.sum(F.when(~own, F.col("n")).otherwise(0)).alias("rest"))
    sizes = cut(sizes.join(rest, by))
    number = F.when(own, F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / size))).otherwise(F.pmod(F.xxhash64(label), F.greatest(F.ceil(F.col("rest") / size), F.lit(1))))
    block = F.concat_ws(":", F.when(own, F.col(label).cast("string")).otherwise(F.lit("-")), number.cast("string"))
    rows = cut(rows.join(sizes, [by, label]).withColumn("block", block).drop("n", "rest"))
    ends = rows.groupBy(by, "block").agg(F.min(label).alias("low"), F.max(label).alias("high"))
    lists = ends.groupBy(by).agg(F.collect_list(F.struct("block", "low", "high")).alias("all"))
    first = lists.select(by, "all", F.posexplode("all").alias("at", "x"))
    # Two rows of one block meet in each of its pairs, so it needs one with itself only where it is alone.
    others = F.when(F.size("all") == 1, F.col("all")).otherwise(F.expr("slice(all, at + 2, size(all))"))
    pairs = first.select(by, "x", F.explode(others).alias("y")).where("least(x.low, y.low) < greatest(x.high, y.high)")
    return rows, pairs.select(by, F.col("x.block").alias("t0"), F.col("y.block").alias("t1"))


def deal(rows: DataFrame, tiles: DataFrame, by: str) -> DataFrame:
    sides = tiles.select(by, "t0", "t1", F.explode(F.array_distinct(F.array("t0", "t1"))).alias("block"))
    return sides.join(rows, [by, "block"]).drop("block")


def cluster_links(members: DataFrame, sets: DataFrame, w: int, percent: int) -> DataFrame:
    """(a, b) of links that join components of (id, cluster, comp, sketch), which holds clusters of two components or more."""
    ship_code(members.sparkSession)
    rows, tiles = in_blocks(members, "cluster", "comp", BLOCK)
    dealt = deal(rows, tiles, "cluster").join(sets, "id").select("cluster", "t0", "t1", "id", "comp", "sketch", "text")

    def run(table):
        import pyarrow as pa

        sketch = np.array(table.column("sketch").to_pylist(), np.int64)
        sets = [shingles(x, w) for x in table.column("text").to_pylist()]
        found = tile_links(table.column("id").to_numpy(), table.column("comp").to_numpy(), sketch, sets, percent)
        if len(sets) > 100:
            del sets
            release()
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("cluster", "t0", "t1").applyInArrow(run, "a bigint, b bigint")


def far_ties(members: DataFrame, most: int) -> DataFrame:
    """(a, b) of labels that ties by sketch join, among the members of each bucket: (key, id, cluster, sketch)."""
    ship_code(members.sparkSession)
    rows, tiles = in_blocks(members, "key", "cluster", BUCKET)

    def ties(cluster, sketch):
        label = np.unique(cluster, return_inverse=True)[1]
        words = sketch.view(np.uint64)
        hits = lambda i: np.flatnonzero(np.bitwise_count(words ^ words[i]).sum(axis=1) <= most)
        return joining(central_first(sketch), label, hits)

    def run(batches):
        import pyarrow as pa

        held: list = []
        now = None

        def flush():
            if len(held) > 1:
                cluster = np.array([r[0] for r in held])
                found = ties(cluster, np.array([r[1] for r in held], np.int64))
                if found:
                    a, b = (cluster[np.array(x)] for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])
            held.clear()

        for batch in batches:
            for key, t0, t1, *row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("key", "t0", "t1", "cluster", "sketch")), strict=True):
                if (key, t0, t1) != now:
                    yield from flush()
                    now = key, t0, t1
                held.append(row)
        yield from flush()
        release()

    # Many small buckets share a task; a bucket's tile is read in one piece.
    dealt = deal(rows, tiles, "key").repartition("key", "t0", "t1").sortWithinPartitions("key", "t0", "t1", "id")
    return dealt.select("key", "t0", "t1", "cluster", "sketch").mapInArrow(run, "a bigint, b bigint").distinct()


def relabel(placed: DataFrame, label: str, pairs: DataFrame) -> DataFrame:
    """placed with the labels that pairs (a, b) of labels join made one."""
    if not pairs.limit(1).count():
        return placed
    new = components(pairs).select(F.col("id").alias(label), F.col("comp").alias("new"))
    return cut(placed.join(new, label, "left").withColumn(label, F.coalesce("new", label)).select(placed.columns))


def groups_of(classes: DataFrame, docs: DataFrame, w: int, percent: int, most: int) -> DataFrame | None:
    """(id, comp) of the classes that share a band with another; None if none does."""
    keys = classes.select("id", F.explode("bands").alias("key"))
    buckets = cut(keys.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1"))
    # Only buckets of two members or more go on.
    members = cut(spread(keys, buckets, "key", "n"))
    first = cut(members.groupBy("id").agg(F.min("b").alias("b")))
    if not first.limit(1).count():
        return None
    needed = classes.join(first.select("id"), "id").select("id", "doc_id", "tag", "sketch")
    # One text of each class that has a candidate at all: the only time whole texts are shuffled by id.
    same = (F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("d.tag") == F.col("c.tag"))
    sets = cut(docs.alias("d").join(needed.alias("c"), same).select("c.id", "d.text").dropDuplicates(["id"]))
    sketches = cut(needed.select("id", "sketch"))
    a = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))

    def near(pairs):
        return pairs.join(a, "a").join(b, "b").where(differing("sa", "sb") <= most).drop("sa", "sb")

    ties = cut(near(first.where("b < id").select(F.col("id").alias("a"), "b")))
    links = cut(link(ties, sets, w, percent))
    up = lambda pairs, label: roots(pairs.select(F.col("a").alias("id"), F.col("b").alias("up"))).withColumnRenamed("root", label)
    placed = sketches.select("id").join(up(ties, "cluster"), "id", "left").join(up(links, "comp"), "id", "left")
    placed = cut(placed.select("id", F.coalesce("cluster", "id").alias("cluster"), F.coalesce("comp", "id").alias("comp")))

    def ends(pairs, label):
        at = lambda x, y: placed.select(F.col("id").alias(x), F.col(label).alias(y))
        return pairs.join(at("a", "la"), "a").join(at("b", "lb"), "b").where("la != lb")

    stars = cut(members.where("b < id").select(F.col("id").alias("a"), "b").distinct().join(first.select(F.col("id").alias("a"), F.col("b").alias("had")), "a").where("b != had").drop("had"))
    stars = cut(near(ends(stars, "comp").select("a", "b")))
    placed = relabel(placed, "cluster", ends(stars, "cluster").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    linked = cut(link(stars, sets, w, percent))
    placed = relabel(placed, "comp", ends(linked, "comp").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())

    flagged = members.select("key", "id").join(placed.select("id", "cluster"), "id")
    # In a bucket of two, the pair has been looked at.
    mixed = flagged.groupBy("key").agg(F.min("cluster").alias("c0"), F.max("cluster").alias("c1"), F.count("*").alias("n")).where("c0 < c1 and n > 2").select("key", "n")
    far = spread(flagged, cut(mixed), "key", "n").drop("n").join(sketches, "id")
    placed = relabel(placed, "cluster", cut(far_ties(far, most)))

    open_clusters = placed.groupBy("cluster").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).where("c0 < c1").select("cluster", "n")
    left = spread(placed, cut(open_clusters), "cluster", "n").drop("n").join(sketches, "id")
    joined = cut(cluster_links(left, sets, w, percent).distinct())
    return relabel(placed, "comp", ends(joined, "comp").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()).select("id", "comp")


def near_duplicates(df: DataFrame, w: int = 5, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id is the smallest of its component)."""
    docs, percent, most = docs_of(df, key, text), round(100 * threshold), most_differing(threshold - MARGIN)
    docs = docs.withColumn("tag", F.xxhash64("text"))
    sig = cut(signatures(docs, w).withColumn("uid", F.monotonically_increasing_id()))
    # The row of smallest doc_id stands for a class; its uid tells classes apart whatever doc_ids are.
    order = F.struct(F.coalesce("doc_id", F.lit(LAST_DOC)), "tag", "uid")
    classes = cut(
        sig.where("set_id is not null")
        .groupBy("set_id")
        .agg(F.min_by(F.struct("uid", "doc_id", "tag", "bands", "sketch"), order).alias("s"), F.count("*").alias("n_rows"))
        .select("set_id", F.col("s.uid").alias("id"), "s.doc_id", "s.tag", "s.bands", "s.sketch", "n_rows")
    )
    found = groups_of(classes, docs, w, percent, most)
    named = classes.select("set_id", "id", F.col("doc_id").alias("component_id"), "n_rows")
    if found is not None:
        least = named.join(found, "id").groupBy("comp").agg(F.min("component_id").alias("least"))
        named = named.join(found.join(least, "comp").select("id", "least"), "id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    named = cut(named.select("set_id", "component_id", "n_rows"))
    rows = sig.select("doc_id", "n", "set_id")
    grouped = spread(rows.where("set_id is not null"), named, "set_id", "n_rows").select("doc_id", "n", "component_id")
    rows = grouped.union(rows.where("set_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
