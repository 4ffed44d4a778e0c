"""Periodic runs in texts, by uniting suffix classes in the order of falling common prefixes.

The words of a slice of documents are one sequence, and suffixes are sorted by prefix doubling within
their document. Two neighbours in that order are joined, those with the longest common prefix first,
by union-find over ordered sets of positions. When two sets become one at a common prefix of L words,
each two positions that only now stand next to each other, at a distance of p words within L, begin
stretches that are equal over exactly L words: what lies between has period p over L + p words, and
p is its smallest period, or a position of the same set would stand between. Such a seed is a run unless
the word before it keeps the period too, which another seed of a longer prefix has then found.

A run has at least `least_words` words and `least_exponent` periods, so common prefixes below
(exponent - 1) / exponent of the first need not be united: in ordinary text few are left."""

from __future__ import annotations

from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import by_slice, words

#: Words and periods of a run, at least.
LEAST_WORDS = 6
LEAST_EXPONENT = 4
#: Positions of one block of an ordered set.
BLOCK = 1024


class Positions:
    """An ordered set of positions, in blocks of bounded length."""

    __slots__ = ("blocks", "lows", "size")

    def __init__(self, position: int):
        self.blocks, self.lows, self.size = [[position]], [position], 1

    def _block(self, x: int) -> int:
        return max(0, bisect_left(self.lows, x) - 1)

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The nearest positions before and after x, which is not in the set."""
        k = self._block(x)
        block = self.blocks[k]
        i = bisect_left(block, x)
        after = block[i] if i < len(block) else self.lows[k + 1] if k + 1 < len(self.lows) else None
        return block[i - 1] if i else None, after

    def add(self, x: int) -> None:
        k = self._block(x)
        block = self.blocks[k]
        block.insert(bisect_left(block, x), x)
        self.lows[k] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.lows[k : k + 1] = [block[0], block[half]]


def sorted_suffixes(ids: np.ndarray, doc: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose suffix shares about `prefix` words or more with another of its document, in the order of
    suffixes; and whether each may share that much with the one before it.

    Ranks are those of the first 1, 2, 4, ... words, and a rank is a place in sorted order, so only
    those still tied go on. Those tied at the last size up to `prefix` are returned."""
    n = len(ids)
    _, code, counts = np.unique(doc * (int(ids.max()) + 1) + ids, return_inverse=True, return_counts=True)
    code = code.reshape(-1)
    rank = (np.cumsum(counts) - counts)[code]
    active = np.flatnonzero(counts[code] > 1)
    size, held, group = 1, active, rank
    while len(active):
        if size <= prefix:
            held, group = active, rank.copy()
        after = np.minimum(active + size, n - 1)
        second = np.where((active + size < n) & (doc[after] == doc[active]), rank[after] + 1, 0)
        order = np.lexsort((second, rank[active]))
        moved, first, then = active[order], rank[active][order], second[order]
        head = np.ones(len(moved), bool)
        head[1:] = first[1:] != first[:-1]
        new = head.copy()
        new[1:] |= then[1:] != then[:-1]
        starts = np.flatnonzero(new)
        parted = np.cumsum(new) - 1
        # the group's first rank, moved on by the places before within the group
        rank[moved] = (first[starts] + starts - np.flatnonzero(head)[np.cumsum(head) - 1][starts])[parted]
        active = moved[np.diff(np.append(starts, len(moved)))[parted] > 1]
        size *= 2
    if not len(held):
        return held, np.zeros(0, bool)
    order = held[np.argsort(rank[held], kind="stable")]
    near = np.zeros(len(order), bool)
    near[1:] = group[order[1:]] == group[order[:-1]]
    return order, near


def common_prefixes(ids: np.ndarray, doc: np.ndarray, order: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Words that each suffix of `order` shares with the one before it (0 where not `near`).

    Places are taken from left to right: the suffix that starts a word later shares one word less at
    least with the one before it, so all comparisons together go over a document about once."""
    before = dict(zip(order[1:][near[1:]].tolist(), order[:-1][near[1:]].tolist(), strict=True))
    ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1
    end_of = ends[np.searchsorted(ends, order, side="right")] if len(order) else ends
    stops = dict(zip(order.tolist(), end_of.tolist(), strict=True))
    values, shared, last, length = ids.tolist(), {}, -2, 0
    for i in sorted(before):
        j, stop = before[i], stops[i]
        length = max(0, length - 1) if i == last + 1 and stops.get(last) == stop else 0
        reach = stop - max(i, j)
        while length < reach and values[i + length] == values[j + length]:
            length += 1
        shared[i], last = length, i
    return np.fromiter((shared.get(i, 0) for i in order.tolist()), np.int64, len(order))


def seeds(order: np.ndarray, shared: np.ndarray, least: int):
    """(position, period, common prefix) of positions that become neighbours, by falling prefix.

    The smaller set is dealt into the larger, so a position moves a logarithm of times at most."""
    links = np.flatnonzero(shared >= least)
    links = links[np.argsort(-shared[links], kind="stable")]
    root: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = root[i]
        return i

    for a, b, prefix in zip(order[links - 1].tolist(), order[links].tolist(), shared[links].tolist(), strict=True):
        a, b = find(a), find(b)
        large, small = sets.pop(a, None) or Positions(a), sets.pop(b, None) or Positions(b)
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        moved = list(chain.from_iterable(small.blocks))
        ends = [large.around(x) for x in moved]
        for k, (x, (left, right)) in enumerate(zip(moved, ends, strict=True)):
            # another moved position may stand between: those two were neighbours before
            if left is not None and x - left <= prefix and not (k and moved[k - 1] > left):
                yield left, x - left, prefix
            if right is not None and right - x <= prefix and not (k + 1 < len(moved) and moved[k + 1] < right):
                yield x, right - x, prefix
        for x in moved:
            large.add(x)
        root[b], sets[a] = a, large


def runs_of(
    ids: np.ndarray, doc: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT
) -> np.ndarray:
    """Rows (document, start in the sequence, length, period), by start and period.

    A run: consecutive words of one document with smallest period q, of `least_words` words and
    `least_exponent` * q at least, which no neighbouring word extends."""
    none = np.zeros((0, 4), np.int64)
    if not len(ids) or least_exponent < 2:
        if least_exponent < 2:
            raise ValueError("a run has two periods at least")
        return none
    # a run of period q shares length - q words with itself q words on: least where q is largest
    least = min(max(least_words, least_exponent * q) - q for q in range(1, least_words + 1))
    order, near = sorted_suffixes(ids, doc, least)
    if not len(order):
        return none
    shared = common_prefixes(ids, doc, order, near)
    found = np.array([s for s in seeds(order, shared, least)], np.int64).reshape(-1, 3)
    start, period, prefix = found.T
    length = prefix + period
    before = np.maximum(start - 1, 0)
    open_left = (start > 0) & (doc[before] == doc[start]) & (ids[before] == ids[np.minimum(before + period, len(ids) - 1)])
    good = ~open_left & (length >= np.maximum(least_words, least_exponent * period))
    made = np.stack([doc[start], start, length, period], axis=1)[good]
    return made[np.lexsort((made[:, 3], made[:, 1]))]


def _found(texts: list[str | None], least_words: int, least_exponent: int):
    """Of each text: its words, their runs (start, length, period), and which of its words repeat one."""
    split = [words(t) for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in chain.from_iterable(split)), np.int64, int(counts.sum()))
    doc = np.repeat(np.arange(len(split)), counts)
    first = np.cumsum(counts) - counts
    runs = runs_of(ids, doc, least_words, least_exponent)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, runs[:, 1] + runs[:, 3], 1)
    np.add.at(cover, runs[:, 1] + runs[:, 2], -1)
    again = np.cumsum(cover[:-1]) > 0
    cuts = np.searchsorted(runs[:, 0], np.arange(len(split) + 1))
    for k, mine in enumerate(split):
        rows = runs[cuts[k] : cuts[k + 1], 1:].copy()
        rows[:, 0] -= first[k]
        yield mine, rows, again[first[k] : first[k] + counts[k]]


def runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """doc_id, start, length, period: a row for each run of each row's text, starts in words from 0.

    Null, empty and wordless texts have none; repeated rows have theirs each. A text of any length is
    taken whole. Only doc_id and text are read; an empty table gives no rows."""

    def job(piece: pa.RecordBatch) -> dict:
        made = [r for _, r, _ in _found(piece.column("text").to_pylist(), least_words, least_exponent)]
        names = ("start", "length", "period")
        return {"doc_id": piece.column("doc_id"), "runs": [[dict(zip(names, r, strict=True)) for r in x.tolist()] for x in made]}

    schema = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>"
    return by_slice(docs, ["doc_id", "text"], schema, job).select("doc_id", F.inline("runs"))


def collapsed(docs: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """doc_id, n_runs, the run with the greatest length (start, length, period, exponent_milli; ties: the
    smallest start, then period; null without runs), runs (`start,length,period` and a line feed
    each, by start, then period) and collapsed (the words that no run repeats, joined by one space):
    a row for each row. Awkward rows as in `runs`: a null text collapses to an empty one."""

    def job(piece: pa.RecordBatch) -> dict:
        best, texts, kept, n = [], [], [], []
        for mine, rows, again in _found(piece.column("text").to_pylist(), least_words, least_exponent):
            listed = rows.tolist()
            n.append(len(listed))
            best.append(min(listed, key=lambda r: (-r[1], r[0], r[2])) if listed else [None] * 3)
            texts.append("".join(f"{s},{e},{p}\n" for s, e, p in listed))
            kept.append(b" ".join(w for w, a in zip(mine, again.tolist(), strict=True) if not a).decode())
        start, length, period = zip(*best, strict=True) if best else ((), (), ())
        return {
            "doc_id": piece.column("doc_id"), "n_runs": n, "start": start, "length": length, "period": period,
            "exponent_milli": [None if p is None else 1000 * e // p for e, p in zip(length, period, strict=True)],
            "runs": texts, "collapsed": kept,
        }

    return by_slice(
        docs, ["doc_id", "text"],
        "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        "runs string, collapsed string", job,
    )
