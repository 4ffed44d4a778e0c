from __future__ import annotations

import base64
import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
import zlib
from tokenizers import Tokenizer

import corpus_pipeline
from postmill.llm import packed, tokens
from tests.llm import cases

MULTI = public.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    with open(MULTI, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_reference_library(reference):
    r = random.Random(5)
    pools = ["ab ", "aab=", "=- \n\t", "éèñ ü", "日本語 中", "😀👍🏽 x", " \n\r\t\x0b\x85 a", "'s't're I'm ", "09 ", ".,!?", "\x1c\x1f \xa0"]
    texts = ["".join(r.choice(r.choice(pools) + r.choice(pools)) for _ in range(r.randrange(50))) for _ in range(3000)]
    made = [i.tolist() for i in tokens.codec(MULTI, public.PATTERN).encode(texts)]
    assert made == [reference.encode_ordinary(t) for t in texts]


def test_plain_vocabulary_is_that_of_the_library():
    held = tokens.codec(PLAIN)
    r = random.Random(6)
    texts = ["".join(r.choice("a b'\n\t \xa0é1,<|endoftext|>") for _ in range(60)) for _ in range(2000)]
    end = "<|endoftext|>"
    texts += [f"a {end} b", f"a{end}b", end, f" {end} ", f"{end}{end} x  {end}\n y", "<|endoftext |>"]
    texts += ["".join(r.choice(["a", " b", " ", "\n", end, f" {end}", ",é"]) for _ in range(20)) for _ in range(500)]
    plain = Tokenizer.from_file(PLAIN)
    made = [i.tolist() for i in held.encode(texts)]
    assert made == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [held.decode(i).decode() for i in made] == texts
    assert held.encode([f"a{end}b"])[0].tolist() == [64, 50256, 65]


def test_rows_round_trip_with_awkward_rows(spark, reference):
    docs = cases.clashing(spark, cases.documents(spark), ["ids", "starts", "bytes"])
    encoded = tokens.encode(docs, MULTI, public.PATTERN)
    assert set(docs.columns) <= set(encoded.columns) | {"ids", "starts"}
    back = cases.rows(tokens.decode(encoded, MULTI, public.PATTERN))
    assert Counter((x["doc_id"], x["decoded"]) for x in back) == Counter(
        (i, t or "") for i, t, *_ in cases.awkward()
    )
    for x in back:
        assert x["ids"] == reference.encode_ordinary(x["decoded"])
        text = x["decoded"]
        whole = [text[s:e] for s, e in zip(x["starts"], x["ends"], strict=True)]
        assert all(0 <= s < e <= len(text) for s, e in zip(x["starts"], x["ends"], strict=True))
        if text.isascii():
            assert "".join(whole) == text


def test_a_split_character_decodes_as_a_whole_and_in_parts(spark):
    held = tokens.codec(MULTI, public.PATTERN)
    ids = held.encode(["x😀y"])[0].tolist()
    assert held.decode(ids) == "x😀y".encode()
    starts, ends = held.spans(ids)
    assert [s for s in starts][0] == 0 and ends[-1] == 3
    cut = spark.createDataFrame([(ids[:2],), (None,)], "ids array<int>")
    first, second = cases.rows(tokens.decode(cut, MULTI, public.PATTERN))
    assert first["decoded"].endswith("�") and second["decoded"] is None


def test_digests(spark, reference):
    made = tokens.digests(cases.documents(spark), MULTI, public.PATTERN)
    expected = []
    for i, t, *_ in cases.awkward():
        ids = reference.encode_ordinary(t or "")
        expected.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert Counter(map(tuple, made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == Counter(expected)
    assert tokens.digests(cases.documents(spark, []), MULTI, public.PATTERN).collect() == []


def test_the_pipeline_reads_its_ids_back(spark):
    made = corpus_pipeline.token_ids(spark, cases.documents(spark), cases.SF)
    assert made.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in cases.rows(made)) == Counter(
        (i, sha256((t or "").encode()).hexdigest()) for i, t, *_ in cases.awkward()
    )
    held = tokens.codec(MULTI, public.PATTERN)
    with pytest.raises(ValueError):
        tokens._read_back(held, held.encode(["one"])[0].tolist(), "two")


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
def test_packed_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (
        rng.integers(0, 50_257, n), np.full(n, 7), rng.integers(0, 1 << 32, n),
        np.where(rng.random(n) < 0.05, rng.integers(0, 1 << 32, n), rng.integers(1000, 1016, n)),
    ):
        ids = ids.astype(np.uint32)
        blob = packed.pack(ids)
        assert np.array_equal(packed.unpack(blob), ids)
        for first, last in ((0, 3), (n // 2, n), (n - 1, n + 9), (n, n)):
            assert np.array_equal(packed.unpack(blob, max(0, first), last), ids[max(0, first):last])


def test_outliers_do_not_widen_a_block():
    ids = np.arange(1024, dtype=np.uint32) % 16
    ids[::100] = 4_000_000_000
    assert len(packed.pack(ids)) < 1024 * 4 // 8 + 200
    with pytest.raises(ValueError):
        packed.unpack(b"x" * 64)


def test_files_are_in_order_and_give_all_ids_back(spark, tmp_path):
    held = tokens.codec(PLAIN)
    data = cases.awkward()
    packed.write(cases.documents(spark), f"file://{tmp_path}/a", PLAIN, 0)
    segments = spark.read.schema(packed.SEGMENT).parquet(f"file://{tmp_path}/a")
    at, expected = 0, []
    by = {r.text: r.h for r in cases.documents(spark).selectExpr("text", "xxhash64(text) h").collect()}
    for i, t, *_ in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, by[x[1]])):
        ids = [*held.encode([t or ""])[0], 0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    found = sorted(map(tuple, packed.read(segments).collect()), key=lambda x: x[1])
    assert found == expected
    assert sorted((tuple(x) for x in packed.index(segments).collect()), key=lambda x: x[1]) == [x[:4] for x in expected]
    packed.write(cases.documents(spark, []), f"file://{tmp_path}/b", PLAIN, 0)
    assert packed.index(spark.read.schema(packed.SEGMENT).parquet(f"file://{tmp_path}/b")).collect() == []


def test_pieces_cover_a_text():
    for text in ("", " ", "a b", "a  b", "a\n b", " a", "a ", "a b c"):
        assert " ".join(tokens._pieces(text)) == text
        assert re.sub(r"\s", "", text) == re.sub(r"\s", "", "".join(tokens._pieces(text)))


def test_rows_of_one_id_go_to_several_tasks(spark, tmp_path):
    """Half of the rows have no id and one text, many others one id: no task has them all, order holds."""
    data = [(None, "the same text", "en", "s", 0)] * 400 + [(7, f"text {i}", "en", "s", 0) for i in range(200)]
    data += [(i, "x", "en", "s", 0) for i in range(20, 120)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed.write(cases.documents(spark, data).repartition(4), f"file://{tmp_path}/a", PLAIN, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    segments = spark.read.schema(packed.SEGMENT).parquet(f"file://{tmp_path}/a")
    ids = {r.shard: list(r.doc_ids) for r in segments.collect()}
    assert sum(None in x for x in ids.values()) > 1 and max(x.count(None) for x in ids.values()) < 400
    found = sorted(map(tuple, packed.index(segments).collect()), key=lambda x: x[1])
    assert [x[0] for x in found] == sorted((d[0] for d in data), key=lambda i: (i is not None, i))
    ends = [x[1] + x[2] for x in found]
    assert [x[1] for x in found] == [0, *ends[:-1]]
