"""Token counts by prefix dynamic programming over BPE pieces.

For every prefix of a text the last token of its encoding is unique, and a token t ending at place
i is that one exactly if the encoding of (last token before t) + t keeps the two apart. So one pass
gives last token and count at each place, and the count at every prefix is stored. Questions about
truncation and budgets are then sums over the stored bytes and need no encoding.

Stored form: one signed byte for each code point, the change of the count from the prefix before.
A change beyond a signed byte can't occur: a code point adds at most 4 byte tokens, and a merge
takes back at most one piece's length (16 in this vocabulary).

Texts are cut where no piece can lie across (word starts, line ends); results of the pieces
between are kept by their text in a bounded cache.

Defined results: null and empty texts have 0 tokens and an empty prefix array; repeated rows and
ties are counted each; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame

from tallyproof.llm.common import Recent, docs_of, map_rows
from tallyproof.llm.pieces import Pieces, load, model_path

#: Entries a worker keeps of units and of token pairs, in each of two generations.
CACHE = 400_000
#: Units longer than this aren't kept.
KEEP_CHARS = 48


class PrefixCounter:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.of_unit: Recent = Recent(CACHE)
        self.apart: Recent = Recent(CACHE)

    def merge(self, s: str) -> list[str]:
        """The encoding of a short string by its definition: join the best-scored pair, leftmost first."""
        score, parts = self.pieces.score, list(s)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                x = score.get(parts[k] + parts[k + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def keeps_apart(self, left: str, right: str) -> bool:
        """Does the encoding of both together keep them as two tokens."""
        known = self.merge(left + right) == ([left, right] if left else [right])
        self.apart.put((left, right), known)
        return known

    def prefixes(self, unit: str) -> list[int]:
        """counts[i]: tokens of the unit's first i code points."""
        score, longest, apart = self.pieces.score, self.pieces.longest, self.apart.get
        last, counts = [""], [0]
        for i in range(1, len(unit) + 1):
            for size in range(1, min(longest, i) + 1):
                token = unit[i - size : i]
                if size > 1 and token not in score:
                    continue
                left = last[i - size]
                known = apart((left, token))
                if known is None:
                    known = self.keeps_apart(left, token)
                if known:
                    last.append(token)
                    fallback = len(token.encode()) if size == 1 and token not in score else 1
                    counts.append(counts[i - size] + fallback)
                    break
            else:
                raise AssertionError("every prefix has an encoding")
        return counts

    def unit(self, unit: str) -> tuple[int, bytes]:
        """Tokens of the unit, and the changes of the count as signed bytes."""
        found = self.of_unit.get(unit)
        if found is None:
            counts = self.prefixes(unit)
            found = counts[-1], bytes([(b - a) & 255 for a, b in pairwise(counts)])
            if len(unit) <= KEEP_CHARS:
                self.of_unit.put(unit, found)
        return found

    def text(self, text: str) -> tuple[int, bytes]:
        """Tokens of the text, and its stored prefix changes, one for each of its code points."""
        if not text:
            return 0, b""
        known = self.of_unit.young.get
        found = [known(x) or self.unit(x) for x in self.pieces.units(text)]
        changes = b"".join([x[1] for x in found])
        # The dummy space has no code point of its own: its change goes to the first one.
        first = np.frombuffer(changes[:2], dtype=np.int8).sum(dtype=np.int64)
        return sum([x[0] for x in found]), first.astype(np.int8).tobytes() + changes[2:]


def counts_at_prefixes(changes: bytes) -> np.ndarray:
    """tokens[k]: tokens of the first k code points."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(changes, dtype=np.int8), dtype=np.int64)])


def count_at(changes: bytes, k: int) -> int:
    return int(np.frombuffer(changes[: max(k, 0)], dtype=np.int8).sum(dtype=np.int64))


def fit(changes: bytes, budget: int) -> int:
    """The most code points of the text whose encoding has at most that many tokens."""
    within = np.flatnonzero(counts_at_prefixes(changes) <= budget)
    return int(within[-1]) if len(within) else 0


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each worker process, so its caches outlive a task."""
    if path not in _counters:
        _counters[path] = PrefixCounter(load(path))
    return _counters[path]


def prefix_counts(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", budget: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, chars_within and prefix_changes, the stored counts at every prefix.

    chars_within: the most code points whose encoding has at most budget tokens, read from those counts.
    """

    def start():
        count = counter(model_path(path))

        def work(ids, texts):
            texts = [x or "" for x in texts]
            found = [count.text(x) for x in texts]
            within = [len(t) if n <= budget else fit(c, budget) for t, (n, c) in zip(texts, found, strict=True)]
            return ids, [len(x.encode()) for x in texts], [x[0] for x in found], within, [x[1] for x in found]

        return work

    return map_rows(
        docs_of(df, key, text, binary=False), start, "doc_id bigint, n_bytes bigint, n_tokens bigint, chars_within bigint, prefix_changes binary"
    )

