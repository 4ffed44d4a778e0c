"""Quality rules on repetition, by suffix arrays.

The words of a slice of documents are one sequence. Suffixes are sorted by prefix doubling, within
their document: ranks by the first 1, 2, 4, ... words, of which only those still tied go on. The
ranks of all rounds give the longest common prefix of neighbours in that order. A suffix whose
neighbours share `shortest` words or more with it lies in such an interval of common prefixes: the
words it shares with the nearer one are a maximal repeated substring that starts there. The union
of these spans, and the longest of them, are what the rules limit."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postmill.llm.common import by_slice, words

#: Base rules (fixed values).
SYMBOLS = "#*$%&|<>"
SHORTEST = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: The method's own rules: covered words in a hundred, and words of the longest repeat.
COVERED_PERCENT = 25
LONGEST_WORDS = 60
_SPACE = " \t\n\v\f\r"


def shared_prefixes(ids: np.ndarray, doc: np.ndarray, shortest: int) -> np.ndarray:
    """For each place, the words that its suffix shares with the one it shares most with, in its
    document; 0 where they are less than `shortest`."""
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if not n:
        return longest
    # a rank is the place of its group in sorted order, so a group of m has room for m ranks
    _, code, counts = np.unique(
        doc * (int(ids.max()) + 1) + ids, return_inverse=True, return_counts=True
    )
    rank = (np.cumsum(counts) - counts)[code.reshape(-1)]
    levels = [(1, rank)]
    active = np.flatnonzero(counts[code.reshape(-1)] > 1)
    size = 1
    while len(active):
        after = active + size
        inside = after < n
        inside[inside] = doc[after[inside]] == doc[active[inside]]
        second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        # groups keep their order, and are parted by what follows; a place that ends comes first
        order = np.lexsort((second, rank[active]))
        moved, first, then = active[order], rank[active][order], second[order]
        new = np.ones(len(moved), bool)
        new[1:] = (first[1:] != first[:-1]) | (then[1:] != then[:-1])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        head = np.ones(len(moved), bool)
        head[1:] = first[1:] != first[:-1]
        base = starts - np.flatnonzero(head)[np.cumsum(head) - 1][starts]
        rank = rank.copy()
        rank[moved] = first + base[group]
        size *= 2
        levels.append((size, rank))
        counts = np.diff(np.append(starts, len(moved)))
        active = moved[counts[group] > 1]
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    near = doc[a] == doc[b]
    a, b = a[near], b[near]
    shared = _common(levels, a, b, doc)
    np.maximum.at(longest, a, shared)
    np.maximum.at(longest, b, shared)
    longest[longest < shortest] = 0
    return longest


def _common(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words that two suffixes of a document have in common: from the longest known ranks down."""
    n, shared = len(doc), np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        x, y = a + shared, b + shared
        ok = (x < n) & (y < n)
        x, y = np.where(ok, x, 0), np.where(ok, y, 0)
        same = ok & (rank[x] == rank[y]) & (doc[x] == doc[a]) & (doc[y] == doc[b])
        shared = shared + size * same
    return shared


def _measured(texts: list[str | None], shortest: int) -> dict[str, list]:
    found = [words(t) for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    code: dict[bytes, int] = {}
    ids = np.fromiter(
        (code.setdefault(w, len(code)) for w in chain.from_iterable(found)), np.int64, int(counts.sum())
    )
    doc = np.repeat(np.arange(len(found)), counts)
    reach = shared_prefixes(ids, doc, shortest)
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(reach)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + reach[at], -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))
    ends = np.cumsum(counts)
    starts = ends - counts
    longest = np.zeros(len(found), np.int64)
    np.maximum.at(longest, doc[at], reach[at])
    return {
        "n_words": counts.tolist(),
        "word_chars": [sum(map(len, (t or "").split(" "))) - sum((t or "").count(c) for c in _SPACE[1:]) for t in texts],
        "n_symbols": [sum(map((t or "").count, SYMBOLS)) for t in texts],
        "n_dup_lines": [_repeated_lines(t) for t in texts],
        "n_repeat_words": (covered[ends] - covered[starts]).tolist(),
        "longest_repeat": longest.tolist(),
    }


def _repeated_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return len(lines) - len(set(lines))


def judged(
    docs: DataFrame, shortest: int = SHORTEST, covered_percent: int = COVERED_PERCENT,
    longest_words: int = LONGEST_WORDS,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat,
    base_failed, kept: a row for each row.

    n_repeat_words: words in the union of maximal repeats of `shortest` words or more. The base
    fails below 20 words or above 30 repeated ones in a hundred. Beyond it, `kept` asks that
    repeats cover no more than `covered_percent` of the words, and that none is longer than
    `longest_words`. A null text has no words, and so fails. Only doc_id and text are read."""

    def job(piece: pa.RecordBatch) -> dict:
        made = _measured(piece.column("text").to_pylist(), shortest)
        three = list(zip(made["n_words"], made["n_repeat_words"], made["longest_repeat"], strict=True))
        failed = [n < LEAST_WORDS or 100 * r > MOST_REPEATED_PERCENT * n for n, r, _ in three]
        return made | {
            "doc_id": piece.column("doc_id"), "base_failed": failed,
            "kept": [
                not f and 100 * r <= covered_percent * n and most <= longest_words
                for f, (n, r, most) in zip(failed, three, strict=True)
            ],
        }

    return by_slice(
        docs, ["doc_id", "text"],
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, longest_repeat bigint, base_failed boolean, kept boolean", job,
    )
