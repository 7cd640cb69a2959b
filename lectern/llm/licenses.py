"""License scans by conditional compression.

A text holds a template where enough of its words stand in order. So many of each template's words
are its anchors that a place with enough of them holds at least one anchor; the words around every
anchor in a text are a candidate block. Blocks are compressed by zstandard alone and with each
template of their anchor as raw dictionary. All (block, template) of a text are ranked by the bytes
that the dictionary saves, and confirmed in that order by aligning words: a winner takes its words,
and what it lacks of the template and adds inside it is reported exactly. Only templates that save
nothing are not tried.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter, deque
from collections.abc import Container, Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wording of public licence notices.
TEMPLATES = {
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mit-line": "Released under the MIT License.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-or-later-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
#: The share of a template's words that must stand in order, and the effort of compression.
COVERAGE, LEVEL = 0.75, 13
_WORD = re.compile(r"\d+(?:\.\d+)*|\w+(?:-\w+)*")

Word = tuple[str, int, int]  # lower-cased word, first place, place after it


def normal_words(text: str) -> list[Word]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def needed(n: int) -> int:
    """Words in order that confirm a template of n words."""
    return math.ceil(COVERAGE * n - 1e-9)


def anchors_of(words: list[str]) -> list[str]:
    """The longest words, as many that a place without any of them lacks too many of the template's words."""
    out: list[str] = []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(map(words.count, out)) > len(words) - needed(len(words)):
            break
        out.append(word)
    return out


class Templates:
    """The templates' words, compressors and anchors."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.words = {name: words for name, text in templates if (words := [w for w, _, _ in normal_words(text)])}
        self.by = {}
        for name, words in self.words.items():
            wording = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            wording.precompute_compress(level=LEVEL)
            self.by[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=wording)
        self.anchors: dict[str, list[str]] = {}
        for name in sorted(self.words):
            for word in anchors_of(self.words[name]):
                self.anchors.setdefault(word, []).append(name)
        self.reach = max((span(len(w)) for w in self.words.values()), default=0)


prepared = lru_cache(maxsize=4)(Templates)


def span(n: int) -> int:
    """Words that a place of a template of n words may have, those added inside included."""
    return n + n // 4 + 1


def runs_near(text: str, anchors: Container[str], reach: int) -> Iterator[list[Word]]:
    """Stretches of words that hold all within `reach` of an anchor; what is far from anchors is not kept."""
    recent: deque[Word] = deque(maxlen=reach)
    run: list[Word] = []
    left = 0
    for m in _WORD.finditer(text):
        word = (m[0].lower(), m.start(), m.end())
        if word[0] in anchors:
            if not left:
                run = [*recent]
            left = 2 * reach + 1
        if left:
            run.append(word)
            left -= 1
            if not left:
                yield run
        recent.append(word)
    if left:
        yield run


def dense(words: list[str], template: list[str], reach: int) -> Iterator[int]:
    """Places of a template's word from which `reach` words hold enough of its words, repeats as often as it has them."""
    wanted, seen, held, end = Counter(template), Counter(), 0, 0
    for i, word in enumerate(words):
        while end < min(len(words), i + reach):
            if words[end] in wanted:
                seen[words[end]] += 1
                held += seen[words[end]] <= wanted[words[end]]
            end += 1
        if word in wanted:
            if held >= needed(len(template)):
                yield i
            held -= seen[word] <= wanted[word]
            seen[word] -= 1


Place = tuple[float, int, int, list[str], list[str]]


def confirmed(words: list[str], template: list[str]) -> list[Place]:
    """(coverage, first word, word after the last, missing words, added words) of every place of the template, none overlapping a better one."""
    found, past, size = [], 0, len(template)
    for i in dense(words, template, span(size)):
        if i < past:
            continue
        part = words[i : i + span(size)]
        runs = [r for r in difflib.SequenceMatcher(None, template, part, autojunk=False).get_matching_blocks() if r.size]
        held = sum(r.size for r in runs)
        if runs and runs[0].b == 0 and held >= needed(size):
            last = runs[-1].b + runs[-1].size
            kept = {k for r in runs for k in range(r.a, r.a + r.size)}
            inside = {k for r in runs for k in range(r.b, r.b + r.size)}
            found.append((held / size, i, i + last, [w for k, w in enumerate(template) if k not in kept], [w for k, w in enumerate(part[:last]) if k not in inside]))
            if last == size == held:
                past = i + last
    out, taken = [], set()
    for place in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
        if taken.isdisjoint(range(place[1], place[2])):
            taken |= set(range(place[1], place[2]))
            out.append(place)
    return out


def free_stretches(a: int, b: int, taken: set[int]) -> Iterator[tuple[int, int]]:
    """Parts of a..b without a taken place."""
    start = a
    for i in range(a, b + 1):
        if i == b or i in taken:
            if i > start:
                yield start, i
            start = i + 1


def ranked(words: list[str], t: Templates) -> list[tuple[int, float, int, int, str]]:
    """(bytes saved, share saved, first word, word after the last, template) of every block of a run, most saved first."""
    out = []
    for i, word in enumerate(words):
        sizes: dict[int, tuple[bytes, int]] = {}
        for name in t.anchors.get(word, ()):
            reach = span(len(t.words[name]))
            if reach not in sizes:
                raw = " ".join(words[max(0, i - reach + 1) : i + reach]).encode("utf-8", "replace")
                sizes[reach] = raw, len(t.plain.compress(raw))
            raw, alone = sizes[reach]
            saved = alone - len(t.by[name].compress(raw))
            if saved > 0:
                out.append((saved, saved / alone, max(0, i - reach + 1), min(len(words), i + reach), name))
    return sorted(out, key=lambda x: (-x[0], x[2], x[4]))


def scan(text: str | None, templates: tuple[tuple[str, str], ...]) -> list[dict]:
    """Findings in one text: winners of the ranking that word alignment confirms, the same words never twice."""
    t = prepared(templates)
    out = []
    for run in runs_near(text or "", t.anchors, t.reach):
        words, taken = [w for w, _, _ in run], set()
        for _, share_saved, a, b, name in ranked(words, t):
            for start, stop in [*free_stretches(a, b, taken)]:
                for share, first, last, missing, added in confirmed(words[start:stop], t.words[name]):
                    taken.update(range(start + first, start + last))
                    out.append({
                        "start": run[start + first][1], "end": run[start + last - 1][2], "template": name, "reduction": round(share_saved, 6), "coverage": round(share, 6),
                        "verdict": "modified" if missing or added else "exact", "missing": " ".join(missing), "added": " ".join(added),
                    })
    return sorted(out, key=lambda x: (x["start"], x["template"]))


FOUND = "array<struct<start:long,end:long,template:string,reduction:double,coverage:double,verdict:string,missing:string,added:string>>"


def anchor_pattern(anchors: list[str]) -> str:
    """Matches where an anchor may begin a word; letters are only tried at the start of one, and the first letter first."""
    if not anchors:
        return "(?!)"
    return f"(?iu)(?<![a-z_])(?=[{''.join(sorted({re.escape(w[0]) for w in anchors}))}])(?:{'|'.join(map(re.escape, anchors))})"


def scan_documents(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each notice: doc_id, its place in code points, template, size reduction, wording differences.

    Only texts with an anchor word reach Python. Null and empty texts have no notice, an empty table
    and an empty set of templates give an empty result; repeated rows are each scanned; null ids
    stay; other columns are not read. Long texts are scanned whole, keeping only words near anchors.
    Of templates that save equally many bytes the one that stands first, then the first by name, is
    confirmed first.
    """
    chosen = tuple(sorted(templates.items()))
    cues = anchor_pattern(sorted(prepared(chosen).anchors))

    @F.pandas_udf(FOUND)
    def scanned(texts: pd.Series) -> pd.Series:
        return pd.Series([scan(t, chosen) for t in texts])

    cued = docs.where(F.col(text_col).rlike(cues)).select(F.col(id_col).alias("doc_id"), F.explode(scanned(F.col(text_col))).alias("f"))
    return cued.select("doc_id", "f.*")
