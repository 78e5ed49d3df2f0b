"""SentencePiece encoding and decoding by N-best segmentation of the piece lattice.

The score of a segmentation is the sum of its pieces' scores in the vocabulary file. A code point
that is no piece has one edge, its UTF-8 bytes as byte pieces, at the lowest ordinary score less
BYTE_PENALTY. Forward Viterbi gives each place the best score from the start; that score is an
exact heuristic for the A-star search which goes backward from the end, so paths come out best
first and nothing but the N best is finished. Ties go to the path whose pieces, read from the end,
are shorter first.

No piece lies across a word's start or a line end, so the lattice falls apart there into units.
A unit's best path and its least loss for another path (the smallest deviation from the forward
scores along the best path) are kept in a bounded cache. A text's N best need other paths only in
the N - 1 units of the smallest losses; the search over those sums is the same best-first one.

Decoding is exact for every text: the escape of the space is a code point of its own (U+2581), so
where a text holds that code point itself it is encoded as bytes.

Defined results: null and empty texts have no pieces and decode to the empty text; repeated rows
and ties get equal results; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct

import numpy as np
from pyspark.sql import DataFrame

from tallyproof.llm.common import Recent, docs_of, map_rows
from tallyproof.llm.pieces import META, Pieces, load, model_path

CACHE = 400_000
KEEP_CHARS = 48
BYTE_PENALTY = 10.0
#: Scores below this stand for none (single and repeated spaces have such); they count as a byte edge does.
PLACEHOLDER = -1e8
#: Segmentations of each text whose scores are returned.
N_BEST = 4


class Codec:
    def __init__(self, pieces: Pieces, cache: int = CACHE):
        self.pieces = pieces
        ordinary = [x for x in pieces.score.values() if x > PLACEHOLDER]
        self.unknown = min(ordinary) - BYTE_PENALTY
        self.score = {p: x if x > PLACEHOLDER else self.unknown for p, x in pieces.score.items()}
        #: Every start of a piece, so that the search for pieces at a place ends early.
        self.starts = {p[:k] for p in self.score for k in range(2, len(p) + 1)}
        #: Bytes that each id stands for.
        self.said = [
            bytes([pieces.byte_of[i]]) if i in pieces.byte_of else x.replace(META, " ").encode() for i, x in enumerate(pieces.names)
        ]
        self.of_unit = Recent(cache)
        self.others = Recent(cache // 10)

    def edges(self, unit: str) -> list[list[tuple[int, float]]]:
        """For each place i > 0: (start, score) of the pieces that end there, shortest first."""
        get, longest, out = self.score.get, self.pieces.longest, [[]]
        for i in range(1, len(unit) + 1):
            here = [(i - 1, get(unit[i - 1], self.unknown))]
            for start in range(i - 2, max(-1, i - longest - 1), -1):
                x = get(unit[start:i])
                if x is not None:
                    here.append((start, x))
            out.append(here)
        return out

    def forward(self, unit: str) -> tuple[list[float], list[int], list[float]]:
        """Of each place: the best score from the start, where its last piece begins, the loss of the next best piece."""
        get, starts, n, none = self.score.get, self.starts, len(unit), float("-inf")
        best, second, back = [none] * (n + 1), [none] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        # Longer pieces come to a place first, so at a tie the shorter one, met last, has to win.
        for i in range(n):
            here, j = best[i], i + 1
            x = here + get(unit[i], self.unknown)
            while True:
                if x is not None:
                    if x >= best[j]:
                        second[j], best[j], back[j] = best[j], x, i
                    elif x > second[j]:
                        second[j] = x
                j += 1
                if j > n or (piece := unit[i:j]) not in starts:
                    break
                x = get(piece)
                if x is not None:
                    x += here
        loss = [a - b for a, b in zip(best, second, strict=True)]
        return best, back, loss

    def first(self, unit: str) -> tuple[float, float, bytes]:
        """Best score, least loss of any other path, and ids of the best path (int32)."""
        found = self.of_unit.get(unit)
        if found is None:
            best, back, loss = self.forward(unit)
            cuts, i, least = [len(unit)], len(unit), float("inf")
            while i > 0:
                least = min(least, loss[i])
                i = back[i]
                cuts.append(i)
            found = best[-1], least, self.to_ids(unit, cuts[::-1])
            if len(unit) <= KEEP_CHARS:
                self.of_unit.put(unit, found)
        return found

    def to_ids(self, unit: str, cuts: list[int]) -> bytes:
        ids, known, by_byte = [], self.pieces.ids, self.pieces.byte_ids
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = unit[a:b]
            if piece in known:
                ids.append(known[piece])
            else:
                ids.extend(by_byte[x] for x in piece.encode())
        return struct.pack(f"<{len(ids)}i", *ids)

    def n_best(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths as (score, cuts): A-star backward from the end, heuristic: forward scores."""
        best, edges = self.forward(unit)[0], self.edges(unit)
        queue, found, order = [(-best[-1], 0, len(unit), 0.0, (len(unit), ()))], [], 0
        while queue and len(found) < n:
            _, _, at, behind, path = heapq.heappop(queue)
            if at == 0:
                cuts = []
                while path:
                    cuts.append(path[0])
                    path = path[1]
                found.append((behind, cuts))
                continue
            for start, x in edges[at]:
                order += 1
                heapq.heappush(queue, (-(best[start] + behind + x), order, start, behind + x, (start, path)))
        return found

    def losses(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """Of the n best paths of a unit, what each loses to the best, and its ids."""
        found = self.others.get((unit, n))
        if found is None:
            paths = self.n_best(unit, n)
            found = [(paths[0][0] - x, self.to_ids(unit, cuts)) for x, cuts in paths]
            self.others.put((unit, n), found)
        return found

    def segmentations(self, text: str, n: int = N_BEST) -> tuple[bytes, list[float], list[list[tuple[int, int, bytes]]]]:
        """ids (int32) of the best segmentation, the scores of the n best, and of each what it changes in the best one: (begin, end, ids) in bytes, in order."""
        if not text:
            return b"", [], []
        ids, total, least = [], 0.0, []
        units, at = [], []
        for part, literal in self.parts(text):
            if literal:
                ids.append(np.array([self.pieces.byte_ids[x] for x in META.encode()], dtype="<i4").tobytes())
                total += self.unknown
                continue
            known = self.of_unit.young.get
            found = [known(x) or self.first(x) for x in part]
            at.append((len(units), len(ids)))
            ids.extend([x[2] for x in found])
            total += sum([x[0] for x in found])
            least.extend([x[1] for x in found])
            units.extend(part)
        # Only the n - 1 smallest losses can be in the n best sums.
        chosen = np.argsort(np.array(least), kind="stable")[: n - 1].tolist() if n > 1 else ()
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for k in chosen:
            if least[k] < float("inf"):
                others = self.losses(units[k], n)
                sums = sorted(((a + b, (*made, (k, rank)) if rank else made) for a, made in sums for rank, (b, _) in enumerate(others)), key=lambda x: x[0])[:n]
        wanted = sorted({k for _, made in sums for k, _ in made})
        place: dict[int, tuple[int, int]] = {}
        size = 0
        if wanted:
            sizes, done = list(map(len, ids)), 0
            for k in wanted:
                first_unit, first_id = next(x for x in reversed(at) if x[0] <= k)
                i = first_id + k - first_unit
                size += sum(sizes[done:i])
                place[k] = size, size + sizes[i]
                done = i
        changes = [[(*place[k], self.losses(units[k], n)[rank][1]) for k, rank in sorted(made)] for _, made in sums]
        return b"".join(ids), [total - x for x, _ in sums], changes

    def encode(self, text: str, n: int = N_BEST) -> tuple[bytes, list[float]]:
        """ids (int32) of the best segmentation, and the scores of the n best."""
        return self.segmentations(text, n)[:2]

    def parts(self, text: str) -> list[tuple[list[str], bool]]:
        """Units of the text; a literal U+2581 is a part of its own."""
        if META not in text:
            return [(self.pieces.units(text), False)]
        out: list[tuple[list[str], bool]] = []
        for k, piece in enumerate((" " + text).split(META)):
            if k:
                out.append(([], True))
            if piece:
                out.append((self.pieces.unit.findall(piece.replace(" ", META)), False))
        return out

    def decode(self, ids) -> str:
        """The text of a list of ids, its dummy space taken off."""
        said = self.said
        return b"".join([said[i] for i in ids]).decode("utf-8", "replace")[1:]


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, cache: int = CACHE) -> Codec:
    """One codec for each worker process, so its cache outlives a task."""
    if (path, cache) not in _codecs:
        _codecs[path, cache] = Codec(load(path), cache)
    return _codecs[path, cache]


def changed(ids: bytes, changes: list[tuple[int, int, bytes]]) -> bytes:
    """The ids of a segmentation from those of the best one."""
    out, at = [], 0
    for begin, end, other in changes:
        out += ids[at:begin], other
        at = end
    return b"".join([*out, ids[at:]])


def encode(df: DataFrame, path: str | None = None, n: int = N_BEST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece_ids, n_pieces, ids_sha256, nbest_scores (best first), nbest_sha256 (of each one's ids), nbest_changes and round_trip (decoding gives the text).

    nbest_changes: of each of the n best, the parts of piece_ids that it replaces (begin and end
    place) and the ids that stand there, so that it is whole with piece_ids.
    """

    def start():
        work_with = codec(model_path(path))

        def work(keys, texts):
            texts = [x or "" for x in texts]
            found = [work_with.segmentations(x, n) for x in texts]
            ids = [np.frombuffer(x[0], dtype="<i4") for x in found]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            part = lambda c: {"begin": c[0] // 4, "end": c[1] // 4, "ids": np.frombuffer(c[2], dtype="<i4")}
            return (
                keys,
                ids,
                list(map(len, ids)),
                [hashlib.sha256(x[0]).hexdigest() for x in found],
                [x[1] for x in found],
                [[sha(changed(x[0], c)) for c in x[2]] for x in found],
                [[list(map(part, c)) for c in x[2]] for x in found],
                [work_with.decode(a.tolist()) == x for a, x in zip(ids, texts, strict=True)],
            )

        return work

    return map_rows(
        docs_of(df, key, text, binary=False),
        start,
        "doc_id bigint, piece_ids array<int>, n_pieces bigint, ids_sha256 string, nbest_scores array<double>, nbest_sha256 array<string>, nbest_changes array<array<struct<begin:int,end:int,ids:array<int>>>>, round_trip boolean",
    )


def encode_rows(df: DataFrame, path: str | None = None, n: int = N_BEST, text: str = "text", cache: int = CACHE) -> DataFrame:
    """The rows of df with piece_ids and n_pieces; a row whose ids don't decode to its text has null in both.

    cache: entries a worker keeps, in each of two generations; about 700 bytes each. Workers outlive
    stages, so where other stages follow in the same executors it should be small.
    """
    at = df.columns.index(text)

    def start():
        work_with = codec(model_path(path), cache)

        def one(x):
            ids = np.frombuffer(work_with.encode(x or "", n)[0], dtype="<i4")
            return ids if work_with.decode(ids.tolist()) == (x or "") else None

        def work(*cols):
            found = list(map(one, cols[at]))
            return (*cols, found, [None if x is None else len(x) for x in found])

        return work

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())])
    return map_rows(df, start, schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "piece_ids") -> DataFrame:
    """doc_id and the text that its piece ids stand for; null ids give the empty text."""

    def start():
        work_with = codec(model_path(path))
        return lambda keys, lists: (keys, [work_with.decode(x or []) for x in lists])

    from pyspark.sql import functions as F

    return map_rows(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), ids), start, "doc_id bigint, text string")
