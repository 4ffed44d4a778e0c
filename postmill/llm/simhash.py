"""SimHash near-duplicates: fingerprints, and a self-join of them by binary tries.

Two of three parts of linked fingerprints (2 bits apart at most) may differ, so one part is equal.
For each part the fingerprints are turned until it leads; those that share it are one trie, whose
nodes are compared with each other: a pair of nodes has the bits in which their prefixes differ,
and is dropped as soon as these are more than allowed. A part that very many fingerprints share is
first split, as pairs of deeper nodes, into tasks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import by_slice, free_name, settle, words
from postmill.llm.graph import components

BITS = 64
#: Node pairs held at a time while a trie is walked.
FRONTIER = 1 << 18
#: Fingerprints of the two nodes of one task; larger pairs are split further.
NODE_ROWS = 1024
#: Bits by which a large pair of nodes is split in one go.
SPLIT_BITS = 4


def shingles(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Hashes of the runs of `shingle` words, in order; of all words, if there are fewer."""
    found = [w.lower() for w in words(text)]  # bytes: lowers A-Z only
    if not found:
        return np.zeros(0, ">u8")
    runs = zip(*(found[i:] for i in range(shingle)), strict=False)
    joined = map(b" ".join, runs if len(found) >= shingle else [tuple(found)])
    return np.array([xxhash.xxh64_intdigest(s, seed) for s in joined], dtype=">u8")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in more than half of the shingles' hashes; zero without words."""
    hashes = shingles(text, shingle, seed)
    if not len(hashes):
        return 0
    set_ = np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, th (hash of the text), fp (a signed integer of 64 bits), a row for each row. Null
    texts have no words."""

    def job(piece: pa.RecordBatch) -> dict:
        made = [fingerprint(t, shingle) for t in piece.column("text").to_pylist()]
        return {
            "doc_id": piece.column("doc_id"), "th": piece.column("th"),
            "fp": pa.array(np.array(made, np.uint64).view(np.int64)),
        }

    hashed = F.xxhash64("text").alias("th")
    return by_slice(docs, ["doc_id", hashed, "text"], "doc_id bigint, th bigint, fp bigint", job)


def _parts(max_bits: int) -> list[tuple[int, int]]:
    """Start and length of max_bits + 1 parts of the 64 bits."""
    n = max_bits + 1
    ends = [BITS * (i + 1) // n for i in range(n)]
    return [(e - (e - s), e - s) for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def _turned(fp, start: int):
    return fp if not start else F.shiftleft(fp, start).bitwiseOR(F.shiftrightunsigned(fp, BITS - start))


def _tasks(unique: DataFrame, max_bits: int, node_rows: int) -> DataFrame:
    """part, task, turned, of (0 or 1): the fingerprints of the two nodes of each task.

    First each part's leading value is a task that pairs a node with itself. While any task has
    more than `node_rows` fingerprints, it becomes the pairs of its child nodes that are near enough;
    fingerprints differ somewhere, so this ends, after (64 - part) / SPLIT_BITS rounds at most."""
    frames = []
    for part, (start, length) in enumerate(_parts(max_bits)):
        turned = _turned(F.col("fp"), start)
        frames.append(unique.select(
            F.lit(part).alias("part"), F.lit(length).alias("depth"),
            F.shiftrightunsigned(turned, BITS - length).alias("a"), turned.alias("turned"),
        ))
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    rows = rows.select("part", "depth", "a", F.col("a").alias("b"), F.lit(0).alias("of"), "turned")
    done = None
    while True:
        sizes = rows.groupBy("part", "depth", "a", "b").agg(F.count("*").alias("n"))
        sizes = settle(sizes.filter("n > 1"))
        big = sizes.filter((F.col("n") > node_rows) & (F.col("depth") < BITS))
        keys = ["part", "depth", "a", "b"]
        ready = rows.join(sizes.filter((F.col("n") <= node_rows) | (F.col("depth") >= BITS)), keys, "left_semi")
        done = ready if done is None else done.unionByName(ready)
        if big.isEmpty():
            return done
        oversized = rows.join(big.select(*keys), keys, "left_semi")
        rows = settle(_split(oversized, max_bits))


def _split(rows: DataFrame, max_bits: int) -> DataFrame:
    """Rows of large node pairs, dealt to the pairs of child nodes SPLIT_BITS deeper."""
    step = F.least(F.lit(SPLIT_BITS), F.lit(BITS) - F.col("depth"))
    near = [d for d in range(1 << SPLIT_BITS) if bin(d).count("1") <= max_bits]
    partners = F.explode(F.array(*map(F.lit, near)))
    both = rows.withColumn("step", step.cast("int")).withColumn(
        "own", F.expr(f"shiftrightunsigned(turned, {BITS} - depth - step)")
    )
    other = both.withColumn("flip", partners)
    other = other.filter(F.expr("flip < shiftleft(1, step)"))
    low = F.col("own").bitwiseXOR(F.col("flip").cast("bigint"))
    # a node paired with itself: children i <= j; else the child under a with any near one under b
    same = F.col("a") == F.col("b")
    mate = F.when(same, low).otherwise(
        low.bitwiseXOR(F.expr("shiftleft(a ^ b, step)"))
    )
    first = F.when(same, F.least("own", "mate")).when(F.col("of") == 0, F.col("own")).otherwise(F.col("mate"))
    second = F.when(same, F.greatest("own", "mate")).when(F.col("of") == 0, F.col("mate")).otherwise(F.col("own"))
    dealt = other.withColumn("mate", mate).select(
        "part", (F.col("depth") + F.col("step")).cast("int").alias("depth"),
        first.alias("a"), second.alias("b"),
        F.when(same, (F.col("own") != F.least("own", "mate")).cast("int")).otherwise(F.col("of")).alias("of"),
        "turned",
    )
    return dealt.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def trie_links(
    turned: np.ndarray, group: np.ndarray, max_bits: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i, j) of `turned` in one group whose values differ in at most `max_bits`.

    Values are unsigned, distinct within a group and sorted by group and value. A node is a range
    of places that agree in their leading bits. Each step takes pairs of nodes one bit down, to
    pairs of their children; a pair ends at two single values, or when it has too many bits apart."""
    if not len(turned):
        return
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(cut[1:], len(turned))
    stack = [(0, cut, ends, cut, ends, np.zeros(len(cut), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, apart = stack.pop()
        if len(alo) > FRONTIER:
            for at in range(0, len(alo), FRONTIER):
                stack.append((bit, *(x[at : at + FRONTIER] for x in (alo, ahi, blo, bhi, apart))))
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any() or bit == BITS:
            i, j = alo[single], blo[single]
            keep = i != j
            i, j = i[keep], j[keep]
            near = np.bitwise_count(turned[i] ^ turned[j]) <= max_bits
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, apart = (x[~single] for x in (alo, ahi, blo, bhi, apart))
        if not len(alo) or bit == BITS:
            continue
        amid, bmid = _middle(turned, alo, ahi, bit), _middle(turned, blo, bhi, bit)
        self_ = alo == blo
        made = []
        for a, b, more, which in (
            ((alo, amid), (blo, bmid), 0, slice(None)), ((amid, ahi), (bmid, bhi), 0, slice(None)),
            ((alo, amid), (bmid, bhi), 1, slice(None)), ((amid, ahi), (blo, bmid), 1, ~self_),
        ):
            x = [v[which] for v in (*a, *b, apart + np.int8(more))]
            ok = (x[1] > x[0]) & (x[3] > x[2]) & (x[4] <= max_bits)
            ok &= (x[0] != x[2]) | (x[1] - x[0] > 1)  # a single value has no pair with itself
            made.append([v[ok] for v in x])
        stack.append((bit + 1, *(np.concatenate(p) for p in zip(*made, strict=True))))


def _middle(turned: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where, in sorted ranges that agree before `bit`, the values with that bit set begin."""
    mask = np.uint64(1 << (BITS - 1 - bit))
    left, right = low.copy(), high.copy()
    while (open_ := left < right).any():
        mid = (left + right) // 2
        set_ = (turned[np.minimum(mid, len(turned) - 1)] & mask) != 0
        right = np.where(open_ & set_, mid, right)
        left = np.where(open_ & ~set_, mid + 1, left)
    return left


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same places as all pairs do, at most n - 1 of them."""
    root = np.arange(n)
    out = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        open_ = root[i] != root[j]
        for x, y in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
            if (p := find(x)) != (q := find(y)):
                root[max(p, q)] = min(p, q)
                out.append((x, y))
        while (root != root[root]).any():
            root = root[root]
    both = np.array(out, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def links(unique: DataFrame, max_bits: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """a, b: links between distinct `fp` that join all those at most `max_bits` apart.

    Of each task a spanning forest is returned, so a dense group gives no more links than rows."""
    starts = [s for s, _ in _parts(max_bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by task; the tasks that one slice completes are walked together
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            same = rest.column("task").to_numpy(zero_copy_only=False) == rest.column("task")[-1].as_py()
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if whole:
                yield walked(rest.slice(0, whole))
                rest = rest.slice(whole)
        if rest is not None and rest.num_rows:
            yield walked(rest)

    def walked(rows: pa.RecordBatch) -> pa.RecordBatch:
        task = rows.column("task").to_numpy(zero_copy_only=False)
        part = rows.column("part").to_numpy(zero_copy_only=False)
        turned = rows.column("turned").to_numpy(zero_copy_only=False).view(np.uint64)
        order = np.lexsort((turned, task))
        task, part, turned = task[order], part[order], turned[order]
        i, j = _forest(trie_links(turned, task, max_bits), len(turned))
        shift = np.array(starts, np.uint64)[part]
        back = np.where(
            shift > 0, (turned >> shift) | (turned << ((np.uint64(BITS) - shift) % np.uint64(BITS))), turned
        )
        return pa.RecordBatch.from_pydict({
            "a": pa.array(back[i].view(np.int64)), "b": pa.array(back[j].view(np.int64)),
        })

    tasks = _tasks(unique, max_bits, node_rows)
    keyed = tasks.select(F.xxhash64("part", "depth", "a", "b").alias("task"), "part", "turned")
    dealt = keyed.repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, with_text_hash: bool = False
) -> DataFrame:
    """doc_id, fp, component_id, a row for each row of `docs` (`with_text_hash`: also th, that of
    the text, and root, a fingerprint that stands for the group).

    Fingerprints link at `max_bits` or fewer differing bits; component_id is the smallest doc_id
    that links lead to, the row's own included. Texts without words (null, empty) all have
    fingerprint zero and so are one group. Rows without a doc_id take part in links, but an id is
    only null where no row of the group has one. Repeated rows are one group like any copies. Other
    columns are not read. An empty table gives an empty result."""
    marks = settle(fingerprints(docs, shingle))
    unique = settle(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(unique.select("fp"), max_bits))
    lowest = unique.join(joined, unique.fp == joined.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    lowest = settle(lowest)
    groups = settle(lowest.groupBy("root").agg(F.min("least").alias("component_id")))
    chosen = settle(lowest.join(groups, "root").select("fp", "root", "component_id"))
    more = ["th", "root"] if with_text_hash else []
    return marks.join(chosen, "fp").select("doc_id", "fp", "component_id", *more)


def first_of_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of `docs` that stand for their group of near-duplicates: its smallest doc_id.

    Of rows equal in doc_id and text one stays. Several texts of that doc_id in one group: the
    smallest text's hash. A group in which no row has a doc_id is represented by its text of the
    smallest hash. All columns are kept as they are, whatever their names."""
    own = free_name("th", docs.columns)
    keyed = docs.withColumn(own, F.xxhash64("text"))
    marks = near_duplicates(docs.select("doc_id", "text"), shingle, max_bits, with_text_hash=True)
    firsts = settle(marks.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min(F.struct("doc_id", "th")).alias("first")
    ).select("first.*"))
    counts = marks.groupBy("doc_id", "th").agg(F.count("*").alias("copies")).filter("copies > 1")
    repeated = settle(counts.select(F.col("doc_id").alias("id"), F.col("th").alias("h")))

    def among(few: DataFrame, kind: str) -> DataFrame:
        doc, th = few.columns
        return keyed.join(few, keyed["doc_id"].eqNullSafe(few[doc]) & (keyed[own] == few[th]), kind)

    same = firsts["doc_id"].eqNullSafe(repeated["id"]) & (firsts["th"] == repeated["h"])
    if repeated.isEmpty():  # the usual case moves no text
        return among(firsts, "left_semi").drop(own)
    single = among(settle(firsts.join(repeated, same, "left_anti")), "left_semi")
    many = among(settle(firsts.join(repeated, same, "left_semi")), "left_semi")
    return single.unionByName(many.dropDuplicates(["doc_id", own])).drop(own)
