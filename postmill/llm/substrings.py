"""Substring dedup by seed and extend.

Every window of `window` words has a seed: of the `anchor`-word runs in it, the first with the
smallest hash (winnowing). So equal windows have equal seeds at equal places, and a shared passage
of a window's length or more shares a seed. Neighbouring windows with one seed form a stretch: the
seed, extended both ways as far as its windows go. Documents are joined on seeds; stretches that
agree as a whole are settled by a minimum, and only the first of each kind has its windows compared
one by one with those of other kinds. Chains of removed windows are the maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import by_slice, free_name, in_slices, settle, words

WINDOW = 20
ANCHOR = 8
#: Distinct words whose hashes a worker keeps.
CACHED_WORDS = 200_000
#: Windows whose least seed is looked for at a time.
PLACES_AT_ONCE = 1 << 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


_HASHES = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def _runs(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of the n words that start at each place (of those that have so many after them)."""
    out, done = None, 0
    power, size, factor = hashes, 1, base % (1 << 64)  # hashes of `size` words, base ** size
    while True:
        if n & 1:
            tail = power[done:]
            out = tail if out is None else out[: len(tail)] * np.uint64(factor) + tail[: len(out)]
            done += size
        n >>= 1
        if not n:
            break
        rest = power[size:]
        power = power[: len(rest)] * np.uint64(factor) + rest
        size, factor = 2 * size, factor * factor % (1 << 64)
    return _mixed(out)


class Stretches:
    """Of a slice of texts: stretches of windows with one seed, in order."""

    def __init__(self, texts: list[str | None], window: int, anchor: int):
        if len(_HASHES) > CACHED_WORDS:
            _HASHES.clear()
        found = [words(t) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((h for w in found for h in map(_HASHES.__getitem__, w)), np.uint64, int(counts.sum()))
        self.words, self.counts = found, counts
        doc = np.repeat(np.arange(len(found)), counts)
        n = len(flat) - window + 1
        empty = np.zeros(0, np.int64)
        self.doc = self.start = self.n = empty
        self.seed = self.kind = self.hashes = np.zeros(0, np.uint64)
        if n <= 0:
            return
        valid = doc[:n] == doc[window - 1 :]
        seeds = _runs(flat, anchor, 0x9E3779B97F4A7C13)
        view = np.lib.stride_tricks.sliding_window_view(seeds, window - anchor + 1)[:n]
        places = np.flatnonzero(valid)
        if not len(places):
            return
        # argmin: the first of equals; some places at a time, as each is a copy of its window
        some = np.array_split(places, len(places) // PLACES_AT_ONCE + 1)
        least = np.concatenate([view[p].argmin(axis=1) + p for p in some])
        self.hashes = _runs(flat, window, 0xC2B2AE3D27D4EB4B)[places]
        first = np.ones(len(places), bool)
        first[1:] = (least[1:] != least[:-1]) | (places[1:] != places[:-1] + 1)
        at = np.flatnonzero(first)
        self.n = np.diff(np.append(at, len(places)))
        self.at = at
        self.doc = doc[places[at]]
        begins = np.cumsum(counts) - counts
        self.start = places[at] - begins[self.doc]
        self.seed = seeds[least[at]]
        last = self.hashes[at + self.n - 1]
        self.kind = _mixed(self.hashes[at] * _M1 + _mixed(last) + self.n.astype(np.uint64))


def _key() -> Column:
    """By which a row is found again: its doc_id, or the text's hash where it has none."""
    return F.coalesce(F.col("doc_id"), F.xxhash64("text"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        _key().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("th"), "text",
    )


def repeated_seeds(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """key, seeds: for each document, its seeds that occur at another place too.

    Seeds are sorted by ranges of (seed, key), so that a seed that a third of all documents share
    is dealt over many tasks. A range's first and last seed may go on in the next range: they count
    as repeated. That adds a few seeds, which the exact comparison then finds to be single."""

    def job(piece: pa.RecordBatch) -> dict:
        s = Stretches(piece.column("text").to_pylist(), window, anchor)
        keys = piece.column("key").to_numpy(zero_copy_only=False)
        cuts = np.searchsorted(s.doc, np.arange(len(keys) + 1))
        seeds = s.seed.view(np.int64)
        return {"key": piece.column("key"), "seeds": pa.ListArray.from_arrays(cuts.astype(np.int32), seeds)}

    # written first: the ranges are drawn from a sample, which would hash all texts once more
    found = settle(by_slice(_rows(docs), ["key", "text"], "key bigint, seeds array<bigint>", job))
    flat = found.select(F.explode("seeds").alias("seed"), "key")
    dealt = flat.repartitionByRange("seed", "key").sortWithinPartitions("seed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, begun = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            seed = rest.column("seed").to_numpy(zero_copy_only=False)
            whole = int(np.searchsorted(seed, seed[-1]))  # the last seed may go on
            if not whole:  # one seed so far, and of more than a batch
                if rest.num_rows > 1:
                    yield rest.slice(1) if begun else rest
                    rest, begun = rest.slice(0, 1), True
                continue
            rows, same = rest.slice(0, whole), np.zeros(whole + 1, bool)
            same[1:-1] = seed[1:whole] == seed[: whole - 1]
            # the first seed may have begun in the range or batch before
            yield rows.filter(pa.array(same[1:] | same[:-1] | (seed[:whole] == seed[0])))
            rest, begun = rest.slice(whole), False
        if rest is not None:
            yield rest

    pairs = dealt.mapInArrow(run, "seed bigint, key bigint")
    return settle(pairs.groupBy("key").agg(F.collect_set("seed").alias("seeds")))


def _candidates(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """seed, kind, doc_id, th, start, n, hashes: the stretches of documents on repeated seeds."""
    schema = (
        "seed bigint, kind bigint, doc_id bigint, th bigint, start bigint, n bigint, hashes array<bigint>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches):
            s = Stretches(piece.column("text").to_pylist(), window, anchor)
            lists = piece.column("seeds")
            wanted = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            seed = s.seed.view(np.int64)
            kept = np.flatnonzero(_among(seed, s.doc, wanted, owner))
            doc = s.doc[kept]
            n = s.n[kept]
            ends = np.cumsum(n)
            take = np.repeat(s.at[kept] - (ends - n), n) + np.arange(int(n.sum())) if len(kept) else []
            yield pa.RecordBatch.from_pydict({
                "seed": pa.array(seed[kept]), "kind": pa.array(s.kind.view(np.int64)[kept]),
                "doc_id": piece.column("doc_id").take(pa.array(doc)),
                "th": piece.column("th").take(pa.array(doc)),
                "start": pa.array(s.start[kept]), "n": pa.array(n),
                "hashes": pa.ListArray.from_arrays(
                    np.append(0, ends).astype(np.int32), s.hashes.view(np.int64)[take]
                ) if len(kept) else pa.array([], pa.list_(pa.int64())),
            })

    both = _rows(docs).join(repeated_seeds(docs, window, anchor), "key")
    return settle(both.select("doc_id", "th", "text", "seeds").mapInArrow(run, schema))


def _among(seed: np.ndarray, doc: np.ndarray, wanted: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which (doc, seed) are among (owner, wanted)."""
    both = np.concatenate((wanted, seed))
    _, code = np.unique(both, return_inverse=True)
    code = code.reshape(-1)
    width = int(code.max()) + 1 if len(code) else 1
    return np.isin(doc * width + code[len(wanted):], owner * width + code[: len(wanted)])


def _place() -> Column:
    """Order of stretches and windows: doc_id (null last), then start; the text's hash for ties."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "th")


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, th (hash of the text), spans: places of windows whose words also start earlier.

    A span (start, n) stands for n windows from that word on, so for n + window - 1 words. Earlier:
    in a smaller doc_id, or before in the same document. Null ids come last, by start and text.
    Rows equal in doc_id and text are one document."""
    found = _candidates(docs, window, anchor)
    at = _place()
    kinds = settle(found.groupBy("seed", "kind").agg(
        F.min(F.struct(at.alias("place"), "n", "hashes")).alias("first")
    ).select("seed", "kind", "first.*"))
    later = found.join(kinds.select("seed", "kind", F.col("place").alias("first")), ["seed", "kind"])
    later = later.filter(at != F.col("first")).select("doc_id", "th", "start", "n")
    many = settle(kinds.groupBy("seed").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    single = kinds.join(many, "seed", "left_semi").select(
        "seed", "place", F.posexplode("hashes").alias("i", "hash")
    ).select(
        "seed", "hash",
        F.struct("place.none", "place.doc_id", (F.col("place.start") + F.col("i")).alias("start"), "place.th").alias("place"),
    )
    single = settle(single)
    firsts = settle(single.groupBy("seed", "hash").agg(F.min("place").alias("first"), F.count("*").alias("c")).filter("c > 1"))
    windows = single.join(firsts, ["seed", "hash"]).filter(F.col("place") != F.col("first"))
    spans = later.unionByName(
        windows.select("place.doc_id", "place.th", "place.start", F.lit(1).cast("bigint").alias("n"))
    )
    return settle(spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("spans")))


def _removed(count: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of `count` words the windows of the spans cover."""
    edges = np.zeros(count + 1, np.int64)
    for s in spans or ():
        edges[s["start"]] += 1
        edges[min(count, s["start"] + s["n"] + window - 1)] -= 1
    return np.cumsum(edges[:-1]) > 0


def _with_spans(docs: DataFrame, window: int, anchor: int) -> tuple[DataFrame, str]:
    """The rows of docs with the spans of their repeated windows, in a column of the name given back."""
    spans = repeats(docs.select("doc_id", "text"), window, anchor)
    mine, name = free_name("h", [*docs.columns, *spans.columns]), free_name("spans", docs.columns)
    hashed = docs.withColumn(mine, F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(spans["doc_id"]) & (hashed[mine] == spans["th"])
    both = hashed.join(spans, same, "left")
    return both.select(*(docs[f"`{c}`"] for c in docs.columns), spans["spans"].alias(name)), name


def removal_digests(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of kept words, joined by one space), a row for each
    row. Texts shorter than a window, empty or null keep all words. Other columns are not read."""
    from hashlib import sha256

    held, name = _with_spans(docs.select("doc_id", "text"), window, anchor)

    def job(piece: pa.RecordBatch) -> dict:
        n, gone, digest = [], [], []
        for text, spans in zip(piece.column("text").to_pylist(), piece.column(name).to_pylist(), strict=True):
            found = words(text)
            out = _removed(len(found), spans, window) if spans else None
            kept = found if out is None else [w for w, x in zip(found, out.tolist(), strict=True) if not x]
            n.append(len(found))
            gone.append(len(found) - len(kept))
            digest.append(sha256(b" ".join(kept)).hexdigest())
        return {"doc_id": piece.column("doc_id"), "n_words": n, "n_removed": gone, "kept_sha256": digest}

    return by_slice(
        held, ["doc_id", "text", name],
        "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", job,
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows of `docs`, `text` without the words of repeated windows (and `n_chars`, if there is
    such a column, to match). Space before a removed word goes with it; other text is unchanged."""
    import re

    word = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "text string"])
    held, name = _with_spans(docs, window, anchor)

    def cut(text: str, spans: list[dict]) -> str:
        pieces = word.findall(text)
        out = _removed(len(pieces), spans, window)
        kept = "".join(p for p, x in zip(pieces, out.tolist(), strict=True) if not x)
        kept += text[sum(map(len, pieces)):]
        return kept.lstrip(" \t\n\v\f\r") if out[0] else kept

    def job(piece: pa.RecordBatch) -> dict:
        both = zip(piece.column("text").to_pylist(), piece.column(name).to_pylist(), strict=True)
        return {c: piece.column(c) for c in rest} | {"text": [cut(t, s) if s else t for t, s in both]}

    done = by_slice(held, [*(f"`{c}`" for c in rest), "text", f"`{name}`"], schema, job)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return done.select(*(f"`{c}`" for c in docs.columns))
