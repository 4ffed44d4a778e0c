"""Licence scans: tags and notices by Aho-Corasick, tag expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postmill.llm.common import by_slice

#: Base phrases and their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices from the licences' own texts, as words, with the labels they add.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
_PRIORITY = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
#: A tag's line, after its colon, up to what can't belong to an expression.
_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([A-Za-z0-9.+:() \t-]*)", re.IGNORECASE)
#: Bytes of a text's words: A-Z lowered, ASCII other than letters and digits to spaces.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def in_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: `with` binds closest, then `and`, then `or`; None if it is not well formed.

    Text after a complete expression on the same line (a comment's end, say) is left out."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # one is due
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if operand:
            if token == "(":
                waiting.append(token)
            elif token == ")" or low in _PRIORITY:
                return None
            else:
                out.append(low)
                operand = False
        elif low in _PRIORITY:
            while waiting and waiting[-1] != "(" and _PRIORITY[waiting[-1]] >= _PRIORITY[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = True
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                break  # closes a bracket opened before the tag
            waiting.pop()
        else:
            break
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def choices(postfix: list[str]) -> list[frozenset[str]]:
    """What the expression offers: each choice is a set of licences that hold together.

    `and` joins every choice of either side, so choices are kept minimal (none contains another)."""
    stack: list[list[frozenset[str]]] = []
    for token in postfix:
        if token not in _PRIORITY:
            stack.append([frozenset((token,))])
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            made = left + right
        elif token == "and":
            made = [a | b for a in left for b in right]
        else:  # an exception is part of the licence it is added to
            made = [frozenset(f"{x} with {y}" for x in a for y in b) for a in left for b in right]
        distinct = list(dict.fromkeys(made))
        stack.append([a for a in distinct if not any(b < a for b in distinct)])
    return stack[0]


def operands(postfix: list[str]) -> set[str]:
    """The licences an expression names, whether a choice needs them or not.

    An exception is part of the licence it is added to; brackets after `with` name no exception, so
    licences in them count by themselves."""
    stack: list[list[str]] = []
    for token in postfix:
        if token not in _PRIORITY:
            stack.append([token])
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with" and len(right) == 1:
            stack.append([f"{x} with {right[0]}" for x in left])
        elif len(left) < len(right):  # the shorter list moves
            right.extend(left)
            stack.append(right)
        else:
            left.extend(right)
            stack.append(left)
    return set(stack[0])


@lru_cache(maxsize=4096)
def _tag_labels(expression: str) -> tuple[str, ...]:
    postfix = in_postfix(expression)
    return tuple(sorted(operands(postfix))) if postfix else ()


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for phrase in dict.fromkeys((*BASE, *NOTICES, TAG)):
        made.add_word(f" {phrase} ", (phrase, len(phrase) + 2))
    made.make_automaton()
    return made


def scan(text: str | None) -> dict[str, object]:
    """What one text says. Places are those of whole words in a row; words count from 0."""
    folded = (text or "").encode().translate(_FOLD).split(b" ")
    found = [w for w in folded if w]
    line = " " + b" ".join(found).decode("latin-1") + " "
    base: list[tuple[int, str]] = []
    labels: set[str] = set()
    tagged = False
    for end, (phrase, size) in _automaton().iter(line):
        if phrase in BASE:
            base.append((end - size + 1, BASE[phrase]))
        tagged |= phrase == TAG
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
    if tagged:
        for m in _LINE.finditer(text):
            labels.update(_tag_labels(m[1].strip()))
    # a hit begins at the space before its first word; words are found by their place in the line
    starts = np.cumsum([0, *(len(w) + 1 for w in found[:-1])]) if base else None
    places = np.searchsorted(starts, [at for at, _ in base]).tolist() if base else []
    basic = {label for _, label in base}
    n = len(found)
    return {
        "n_words": n, "n_base": len(base),
        "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(basic)), "labels": ",".join(sorted(basic | labels)),
        "score": _score(n, len(base), len(labels), tagged),
    }


def _score(n: int, places: int, others: int, tagged: bool) -> float:
    """How surely the text is under a licence: each sign leaves half of the doubt, a tag a tenth."""
    return 0.0 if not n else 1 - 0.5 ** (places + others) * (0.1 if tagged else 1.0)


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each row.

    A null text is an empty one: no words, no labels (empty strings), score 0. A tag whose
    expression is not well formed adds no label. Labels of tags are lower case; an expression's
    labels are all licences it names, at any length. Only doc_id and text are read."""

    def job(piece: pa.RecordBatch) -> dict:
        made = [scan(t) for t in piece.column("text").to_pylist()]
        return {"doc_id": piece.column("doc_id")} | {c: [m[c] for m in made] for c in NAMES}

    return by_slice(
        docs, ["doc_id", "text"],
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double", job,
    )
