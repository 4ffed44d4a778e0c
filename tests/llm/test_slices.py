"""Slices are cut by rows and by bytes, so that long texts do not fill a worker."""

from __future__ import annotations

import subprocess
import sys

import pyarrow as pa

from postmill.llm.common import in_slices


def batch(texts):
    return pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "text": pa.array(texts, pa.string())})


def test_slices_are_bounded_and_keep_order():
    texts = ["a" * n for n in (10, 3_000_000, 5_000_000, 20, 30, 2_000_000, 2_500_000, 1)] + [None, ""] * 600
    pieces = list(in_slices([batch(texts), batch([]), batch(["x"])], 512))
    assert [x for p in pieces for x in p.column("text").to_pylist()] == [*texts, "x"]
    assert all(p.num_rows <= 512 and (p.num_rows == 1 or p.nbytes <= 4 << 20) for p in pieces)
    assert len(pieces) < 20


_JOB = """
import random, resource, sys
import pyarrow as pa
sys.path.insert(0, {root!r})
from postmill.llm.common import in_slices
from postmill.llm.repetition import _measured
from postmill.llm.substrings import Stretches
from postmill.llm.periods import _found
r = random.Random(1)
words = [f"w{{i}}" for i in range(30_000)]
texts = [" ".join(r.choices(words, k=330_000)) for _ in range(64)]
whole = pa.RecordBatch.from_pydict({{"text": pa.array(texts)}})
del texts
for piece in in_slices([whole]):
    found = piece.column("text").to_pylist()
    {call}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""


def test_long_texts_stay_within_a_worker():
    """64 texts of some 2 MB: below 1 GB for repetition, repeated passages and runs."""
    import postmill

    root = postmill.__path__[0].rsplit("/", 1)[0]
    calls = {"op2": "_measured(found, 8)", "op8": "Stretches(found, 20, 8)", "op11": "list(_found(found, 6, 4))"}
    for name, call in calls.items():
        script = _JOB.format(root=root, call=call)
        out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, timeout=600)
        assert int(out.stdout) < 1_000_000, (name, out.stdout)
