"""Removal of repeated byte strings by longest previous factors, the first finding kept.

A byte goes if a string of SIZE bytes that covers it also starts earlier: in a document of smaller
doc_id, or earlier in the same one. In the array of longest previous factors (LPF) of all texts
these strings are the places with LPF >= SIZE.

The suffixes of a corpus are not sorted as a whole. Each window of SIZE bytes has an anchor: the
K bytes of least hash in it, the leftmost at a tie. Equal windows have equal anchors at equal
distances, so a suffix needs comparing with those of its anchor only. The windows of an anchor in a
text follow each other; text from the first one's start to the last one's end is its context.

1. Each task hashes its texts (prefix sums, in arrays), finds anchors and contexts, and merges
   equal contexts: of those only the first goes on, the others are repeats as a whole. So a group
   of copies or a common passage leaves one row a batch for the shuffle.
2. One shuffle by anchor, sorted: again only the first of equal contexts goes on. What is left are
   anchors with several different contexts, which share a part at most (the ends of passages).
3. The bytes of those contexts are fetched by document, shuffled by anchor, and their suffixes are
   put in suffix order (ranks doubled, 8 bytes to SIZE). The common prefixes of neighbours come
   from the same ranks; the previous and the next smaller position of each suffix, found by a tree
   of minima, and the least common prefix on the way there give its longest previous factor, exact
   up to SIZE. A window with LPF >= SIZE is a repeat.
   The windows of an anchor of over GROUP contexts are put in suffix order by Spark's sort, dealt
   by their bytes: there the row before a window is its previous smaller position if it is equal.
4. The ranges found are gathered by document, one list each, and cut out of the text.

Contexts are merged when two 64-bit hashes of theirs agree (of the context and of the anchor's
bytes): a wrong merge among n contexts has a probability of n^2 / 2^129, 1.5e-15 for the 1e12
contexts of 35 TB. Comparing their bytes would send 130 bytes a context through the shuffle, about
four times the input.

Documents are in order of doc_id, null ones last, then of a hash of the text.

Defined results: null and empty texts lose nothing; texts shorter than SIZE neither; an earlier
start in the same text counts, overlapping or not; equal rows are one document, so they keep equal
bytes; rows that share a doc_id (or have none) and differ in text are documents of their own, in
order of that hash; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm import rolling
from tallyproof.llm.common import LAST_DOC, cut, docs_of, map_rows, release, ship_code

U = np.uint64
SIZE = 100
#: Bytes of an anchor. Longer ones leave more anchors, shorter ones meet by chance more often: of 12
#: bytes over a quarter of all contexts shared their anchor with another, of 32 bytes a twentieth.
K = 32
#: Bytes of text whose contexts are settled together in a task, and that a long text is cut into.
BATCH_BYTES = 1 << 23
SEGMENT = 1 << 23
#: Contexts of one anchor that one task puts in suffix order.
GROUP = 20_000
#: Context bytes that are put in suffix order together.
SORT_BYTES = 1 << 22


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each size neighbours, by doubling."""
    step, best = 1, x
    while step * 2 <= size:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    rest = size - step
    return np.minimum(best[:-rest], best[rest:]) if rest else best


def anchors(data: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, last window) of each anchor in a text of at most SEGMENT + size bytes."""
    n = len(data)
    if n < size:
        return (np.zeros(0, np.int64),) * 4
    sums = rolling.prefix_sums(data)
    grams = rolling.windows(sums, K)
    place = np.arange(len(grams), dtype=np.uint64)
    # 40 bits of hash, then the place: the least is the leftmost of equal hashes.
    least = sliding_min((grams & ~U(0xFFFFFF)) | place, size - K + 1)
    at = (least & U(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    anchor = at[first]
    context = rolling.between(sums, first, last + size)
    context = rolling.mix(context + (anchor - first).astype(np.uint64) * U(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64))
    return grams[anchor].view(np.int64), context.view(np.int64), first, last


def of_text(data: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """anchors() of a text of any length, by segments that share no window."""
    if len(data) <= SEGMENT + size:
        return anchors(data, size)
    parts = []
    for at in range(0, len(data) - size + 1, SEGMENT):
        h, c, first, last = anchors(data[at : at + SEGMENT + size - 1], size)
        parts.append((h, c, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def settle(h, c, doc, t, lo) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (h, c, doc, t, lo), and in it: is the row a later one of an equal (h, c)."""
    order = np.lexsort((lo, t, doc, c, h))
    h, c, doc, t, lo = (x[order] for x in (h, c, doc, t, lo))
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    head = np.flatnonzero(new)
    of = np.repeat(head, np.diff(np.append(head, len(order))))
    return order, (doc != doc[of]) | (t != t[of]) | (lo != lo[of])


#: kind: 0 a row to be settled, 1 a range to remove, 2 a context to compare, 3 one of too many for one task.
ROW = "kind int, p bigint, h bigint, c bigint, doc bigint, t bigint, lo bigint, hi bigint"
NAMES = [x.split()[0] for x in ROW.split(", ")]
ARROW = pa.schema([("kind", pa.int32()), *((x, pa.int64()) for x in NAMES[1:])])


def batch_of(kind, p, h, c, doc, t, lo, hi) -> pa.RecordBatch:
    cols = [np.asarray(kind, np.int32), *(np.asarray(x, np.int64) for x in (p, h, c, doc, t, lo, hi))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], schema=ARROW)


def ranges_of(doc, t, lo, hi) -> pa.RecordBatch:
    zero = np.zeros(len(doc))
    return batch_of(zero + 1, doc, zero, zero, doc, t, lo, hi)


def settled_batch(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows (h, c, doc, t, lo, hi): later ones as ranges, dealt by document, first ones to be settled, dealt by anchor."""
    h, c, doc, t, lo, hi = (np.concatenate(x) for x in zip(*rows, strict=True))
    order, later = settle(h, c, doc, t, lo)
    h, c, doc, t, lo, hi = (x[order] for x in (h, c, doc, t, lo, hi))
    return batch_of(later, np.where(later, doc, h), h, c, doc, t, lo, hi)


def numpy_columns(batch: pa.RecordBatch, names) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def find_anchors(docs: DataFrame, size: int) -> DataFrame:
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            docs, tags, texts = (batch.column(batch.schema.get_field_index(n)) for n in ("doc", "t", "text"))
            for doc, t, text in zip(docs, tags, texts, strict=True):
                data = text.as_buffer() if text.is_valid else None
                if data is None or data.size < size:
                    continue
                data = np.frombuffer(data, np.uint8)
                h, c, lo, hi = of_text(data, size)
                rows.append((h, c, np.full(len(h), doc.as_py(), np.int64), np.full(len(h), t.as_py(), np.int64), lo, hi))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield settled_batch(rows)
                    rows, held = [], 0
        if rows:
            yield settled_batch(rows)
        del rows
        release()

    return docs.mapInArrow(run, ROW)


def settle_sorted(rows: DataFrame, group: int) -> DataFrame:
    """Rows of ROW that are partitioned by p and sorted by (h, c, doc, t, lo): ranges to remove, and the contexts of anchors with several, as kind 2, or 3 beyond group.

    Memory holds one batch and at most group rows of the last anchor.
    """
    ship_code(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # (h, c, doc, t, lo) of the context that is being read
        waiting: list[tuple] = []  # first rows of the anchor that is being read
        anchor, many = None, False

        def flush():
            nonlocal waiting
            done, waiting = waiting, []
            if done and (len(done) > 1 or many):
                doc, t, lo, hi = (np.array(x, np.int64) for x in zip(*done, strict=True))
                n = len(done)
                yield batch_of(np.full(n, 3 if many else 2), doc, np.full(n, anchor), np.zeros(n), doc, t, lo, hi)

        for batch in batches:
            kind, h, c, doc, t, lo, hi = numpy_columns(batch, ("kind", "h", "c", "doc", "t", "lo", "hi"))
            done = kind == 1
            if done.any():
                yield ranges_of(doc[done], t[done], lo[done], hi[done])
                h, c, doc, t, lo, hi = (x[~done] for x in (h, c, doc, t, lo, hi))
            n = len(h)
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            if first is not None and h[0] == first[0] and c[0] == first[1]:
                new[0] = False
            head = np.flatnonzero(new)
            of = np.searchsorted(head, np.arange(n), "right") - 1
            in_old = of < 0
            at = head[np.maximum(of, 0)] if len(head) else np.zeros(n, np.int64)
            differs = np.zeros(n, bool)
            for k, x in enumerate((doc, t, lo)):
                held = x[at].copy()
                if in_old.any():
                    held[in_old] = first[2 + k]
                differs |= x != held
            later = ~new & differs
            if later.any():
                yield ranges_of(doc[later], t[later], lo[later], hi[later])
            if len(head):
                first = tuple(x[head[-1]] for x in (h, c, doc, t, lo))
            # Anchors inside the batch that have one context need no row of their own.
            hh = h[head]
            alone = np.ones(len(head), bool)
            alone[1:] &= hh[1:] != hh[:-1]
            alone[:-1] &= hh[:-1] != hh[1:]
            if len(head):
                alone[0] &= hh[0] != anchor
                alone[-1] = False
            for k in head[~alone]:
                if h[k] != anchor:
                    yield from flush()
                    anchor, many = h[k], False
                waiting.append((doc[k], t[k], lo[k], hi[k]))
                if len(waiting) > group:
                    many = True
                if many:
                    yield from flush()
        yield from flush()
        release()

    return rows.mapInArrow(run, ROW)


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("p")).sortWithinPartitions("h", "c", "doc", "t", "lo")


def suffix_order(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' places in order of their first size bytes, ties in place order, and the common prefix of each with the one before it, up to size.

    Each suffix has size bytes at least. Ranks of 8, 16, 32, ... bytes are doubled; common prefixes
    come from the same ranks, the longest first, and the last bytes one by one.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    n = len(data)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << U(8)) | padded[k : n + k].astype(np.uint64)
    ranks, length = [np.unique(word, return_inverse=True)[1].astype(np.int64)], 8

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)

    while length * 2 <= size:
        ranks.append(joined(ranks[-1][: len(ranks[-1]) - length], ranks[-1][length:]))
        length *= 2
    rest = size - length
    order = np.argsort(joined(ranks[-1][starts], ranks[-1][starts + rest]), kind="stable")
    a, b = starts[order[:-1]], starts[order[1:]]
    common = np.zeros(len(a), np.int64)
    for rank in ranks[::-1]:
        fits = np.flatnonzero(common + length <= size)
        same = rank[a[fits] + common[fits]] == rank[b[fits] + common[fits]]
        common[fits[same]] += length
        length //= 2
    going = np.flatnonzero(common < size)
    while len(going):
        going = going[data[a[going] + common[going]] == data[b[going] + common[going]]]
        common[going] += 1
        going = going[common[going] < size]
    return order, np.concatenate([[0], common])


def smaller_before(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of each suffix, in suffix order: its common prefix with the nearest one before it that has a smaller place; 0 for none.

    That is the least of common on the way. A binary tree over the order holds the least place and
    the least common prefix of each node's leaves; all suffixes climb it together until the part
    to the left holds a smaller place, and go down into it.
    """
    n = len(place)
    width = 1 << max(n - 1, 1).bit_length()
    least, link = np.full(2 * width, np.iinfo(np.int64).max), np.full(2 * width, np.iinfo(np.int64).max)
    least[width : width + n], link[width : width + n] = place, common
    level = width
    while level > 1:
        for x in (least, link):
            x[level // 2 : level] = np.minimum(x[level : 2 * level : 2], x[level + 1 : 2 * level : 2])
        level //= 2
    out = np.zeros(n, np.int64)
    who, node, way = np.arange(n), np.arange(n) + width, common.astype(np.int64)
    down: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(who):
        right = (node & 1 == 1) & (node > 1)
        left = node - right
        found = right & (least[left] < place[who])
        if found.any():
            down.append((who[found], left[found], way[found]))
        way = np.where(right & ~found, np.minimum(way, link[left]), way)
        going = ~found & (node > 1)
        who, node, way = who[going], node[going] >> 1, way[going]
    if down:
        who, node, way = (np.concatenate(x) for x in zip(*down, strict=True))
        while len(who):
            leaf = node >= width
            out[who[leaf]] = way[leaf]
            who, node, way = who[~leaf], 2 * node[~leaf] + 1, way[~leaf]
            into = least[node] < place[who]
            way = np.where(into, way, np.minimum(way, link[node]))
            node = node - ~into
    return out


def previous_factors(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Longest previous factors, up to size, of the suffixes at these places, in place order: each with its previous and its next smaller place in suffix order."""
    order, common = suffix_order(data, starts, size)
    before = smaller_before(order, common)
    # From the other end, a suffix's link is the one to what follows it.
    after = smaller_before(order[::-1], np.append(common[1:], 0)[::-1])[::-1]
    out = np.zeros(len(starts), np.int64)
    out[order] = np.maximum(before, after)
    return out


def with_context(docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """rows (kind 2 and 3) with the bytes of their contexts."""
    lists = rows.groupBy("doc", "t").agg(F.collect_list(F.struct("kind", "h", "lo", "hi")).alias("rows"))
    both = docs.where(F.length("text") >= size).join(lists, ["doc", "t"]).dropDuplicates(["doc", "t"])

    def start():
        def work(docs, tags, texts, rows):
            out = [(x["kind"], x["h"], i, t, x["lo"], x["hi"], b[x["lo"] : x["hi"] + size]) for i, t, b, r in zip(docs, tags, texts, rows, strict=True) for x in r]
            return tuple(zip(*out, strict=True)) if out else ((),) * 7

        return work

    return map_rows(both.select("doc", "t", "text", "rows"), start, "kind int, h bigint, doc bigint, t bigint, lo bigint, hi bigint, context binary")


CONTEXT = ("h", "doc", "t", "lo", "hi", "context")
RANGE = "doc bigint, t bigint, lo bigint, hi bigint"


def context_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in CONTEXT), strict=True)


def compare(contexts: DataFrame, size: int) -> DataFrame:
    """Ranges of the windows of kind 2 contexts whose longest previous factor reaches size."""
    ship_code(contexts.sparkSession)

    def ranges(rows: list[tuple]) -> pa.RecordBatch:
        doc, t, lo, hi, context = (list(x) for x in zip(*rows, strict=True))
        doc, t, lo, hi = (np.array(x, np.int64) for x in (doc, t, lo, hi))
        n_windows = hi - lo + 1
        begin = np.concatenate([[0], np.cumsum(n_windows + size - 1)[:-1]])
        of = np.repeat(np.arange(len(doc)), n_windows)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        # Rows are in place order within an anchor, and suffixes of other anchors have no common prefix of size.
        found = previous_factors(np.frombuffer(b"".join(context), np.uint8), begin[of] + inside, size) >= size
        edge = np.diff(found.astype(np.int8), prepend=0)
        # A run of found windows ends with its context.
        first = found & ((edge == 1) | (inside == 0))
        last = found & (np.append(~found[1:], True) | np.append(inside[1:] == 0, True))
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        cols = doc[of[a]], t[of[a]], lo[of[a]] + inside[a], lo[of[b]] + inside[b]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["doc", "t", "lo", "hi"])

    def run(batches):
        rows, held, anchor = [], 0, None
        for batch in batches:
            for h, *row in context_rows(batch):
                if h != anchor and held >= SORT_BYTES:
                    yield ranges(rows)
                    rows, held = [], 0
                anchor = h
                rows.append(row)
                held += len(row[-1])
        if rows:
            yield ranges(rows)
        del rows
        release()

    small = contexts.where("kind = 2").repartition(F.col("h")).sortWithinPartitions("h", "doc", "t", "lo")
    return small.mapInArrow(run, RANGE)


def compare_many(contexts: DataFrame, size: int) -> DataFrame:
    """The same for kind 3: windows are dealt by their bytes and sorted by them, so that the previous smaller place of an equal one is the row before."""
    ship_code(contexts.sparkSession)

    def batch(rows):
        cols = zip(*rows, strict=True) if rows else ((),) * 5
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["w", "doc", "t", "lo", "later"])

    def explode(batches):
        for one in batches:
            # Of equal windows of a batch only the first is sorted; rows are in no order yet.
            first: dict[bytes, tuple] = {}
            out = []
            for _, doc, t, lo, hi, context in context_rows(one):
                for k in range(hi - lo + 1):
                    w, at = context[k : k + size], (doc, t, lo + k)
                    old = first.setdefault(w, at)
                    if old != at:
                        first[w] = min(old, at)
                        out.append((b"", *max(old, at), True))
            yield batch([*out, *((w, *at, False) for w, at in first.items())])

    def settle_windows(batches):
        last = None
        for one in batches:
            out = []
            for w, doc, t, lo in zip(*(one.column(one.schema.get_field_index(n)).to_pylist() for n in ("w", "doc", "t", "lo")), strict=True):
                if w == last:
                    out.append((doc, t, lo, lo))
                last = w
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ((),) * 4)], names=["doc", "t", "lo", "hi"])

    rows = contexts.where("kind = 3").mapInArrow(explode, "w binary, doc bigint, t bigint, lo bigint, later boolean")
    rows = cut(rows)
    ordered = rows.where("not later").repartition(F.xxhash64("w")).sortWithinPartitions("w", "doc", "t", "lo")
    return rows.where("later").select("doc", "t", "lo", F.col("lo").alias("hi")).union(ordered.mapInArrow(settle_windows, RANGE))


def numbered(docs: DataFrame) -> DataFrame:
    """docs_of() with doc and t, the order of documents."""
    return docs.withColumns({"doc": F.coalesce("doc_id", F.lit(LAST_DOC)), "t": F.xxhash64("text")})


def repeats(docs: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """(doc, t, ranges): of each document of numbered() that has any, the ranges of first window bytes that stand earlier."""
    first = cut(settle_sorted(dealt(find_anchors(docs.select("doc", "t", "text"), size)), group))
    contexts = cut(with_context(docs, first.where("kind > 1"), size))
    found = first.where("kind = 1").select("doc", "t", "lo", "hi").union(compare(contexts, size)).union(compare_many(contexts, size))
    return found.groupBy("doc", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def spans(ranges, n: int, size: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of the bytes that the ranges' windows cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + size)
        else:
            out.append([lo, hi + size])
    return [(a, min(b, n)) for a, b in out]


def cut_text(text: str | None, ranges, size: int = SIZE) -> str | None:
    """The text without the ranges' windows; a code point goes only if all its bytes do."""
    if not text or not ranges:
        return text
    data, at, kept = text.encode(), 0, []
    for a, b in spans([(x["lo"], x["hi"]) for x in ranges], len(data), size):
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept).decode()


def texts_without_repeats(df: DataFrame, size: int = SIZE, group: int = GROUP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of df, repeated strings cut out of its text, whole code points only."""
    rows = df.withColumns({"_doc": F.coalesce(F.col(key).cast("bigint"), F.lit(LAST_DOC)), "_t": F.xxhash64(F.col(text).cast("string").cast("binary"))})
    found = repeats(numbered(docs_of(df, key, text)), size, group).select(F.col("doc").alias("_doc"), F.col("t").alias("_t"), F.col("ranges").alias("_ranges"))
    at = df.columns.index(text)

    def start():
        return lambda *cols: (*cols[:at], [cut_text(x, r, size) for x, r in zip(cols[at], cols[-1], strict=True)], *cols[at + 1 : -1])

    return map_rows(rows.join(found, ["_doc", "_t"], "left").select(*df.columns, "_ranges"), start, df.schema)


def remove_repeats(df: DataFrame, size: int = SIZE, group: int = GROUP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start and end of each removed run) and kept (bytes that stay)."""
    docs = numbered(docs_of(df, key, text))
    both = docs.join(repeats(docs, size, group), ["doc", "t"], "left").select("doc_id", "text", "ranges")

    def start():
        def one(text, ranges):
            text = text or b""
            cuts = spans([(x["lo"], x["hi"]) for x in ranges or ()], len(text), size)
            at, kept = 0, []
            for a, b in cuts:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            return len(text), sum(b - a for a, b in cuts), [{"start": a, "end": b} for a, b in cuts], b"".join(kept)

        return lambda ids, texts, ranges: (ids, *zip(*map(one, texts, ranges), strict=True))

    return map_rows(both, start, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
