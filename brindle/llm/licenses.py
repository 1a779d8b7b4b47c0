"""Fuzzy search for short licence notices: exact seeds by pigeonhole, then bounded-error matching.

A notice with at most k edits, split in k + 1 parts, has one part untouched.  All parts of all notices are found in one pass of an
automaton over the text in lower case; around each hit, wide enough for k insertions, the regex library looks for the
notice with at most k errors, best match first, and reports its span and edits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A notice of several wordings has a tuple of them.
NOTICES: dict[str, str | tuple[str, ...]] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "licensed under the GNU General Public License, version 3"),
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "LGPL": "licensed under the GNU Lesser General Public License",
    "AGPL-3.0": "licensed under the GNU Affero General Public License",
    "MPL-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-long": "licensed under a Creative Commons Attribution",
    "CC0": "dedicated to the public domain under CC0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Boost": "Distributed under the Boost Software License, Version 1.0",
    "EPL-2.0": "made available under the terms of the Eclipse Public License",
    "rights": "All rights reserved. No part of this publication may be reproduced",
}
#: Edits allowed per character of a notice.
RATE = 0.08


@dataclass(frozen=True)
class Notice:
    name: str
    text: str  # in lower case
    edits: int

    def parts(self) -> list[tuple[int, str]]:
        """k + 1 parts of about equal length, with their offsets."""
        n, k = len(self.text), self.edits + 1
        ends = [round(i * n / k) for i in range(k + 1)]
        return [(a, self.text[a:b]) for a, b in zip(ends, ends[1:])]


def notices(texts: dict[str, str | tuple[str, ...]] | None = None, rate: float = RATE) -> list[Notice]:
    """One of each wording."""
    every = [(name, text) for name, of in (texts or NOTICES).items() for text in ((of,) if isinstance(of, str) else of)]
    return [Notice(name, text.lower(), max(1, int(len(text) * rate))) for name, text in every]


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


class Scanner:
    def __init__(self, found: list[Notice]) -> None:
        self.notices = found
        seeds = defaultdict(list)
        for i, notice in enumerate(found):
            for offset, part in notice.parts():
                seeds[part].append((i, offset))
        self.longest = max(len(n.text) + n.edits for n in found)
        self.automaton = ahocorasick.Automaton()
        for part, where in seeds.items():
            self.automaton.add_word(part, (len(part), where))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text, special_only=True)}){{e<={n.edits}}}") for n in found]

    def windows(self, low: str) -> dict[int, list[tuple[int, int]]]:
        """Of each notice the stretches where a match may lie, overlapping ones joined."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, where) in self.automaton.iter(low):
            for i, offset in where:
                n = self.notices[i]
                at = end + 1 - size - offset
                out[i].append((max(0, at - n.edits), min(len(low), at + len(n.text) + n.edits)))
        for i, spans in out.items():
            joined: list[tuple[int, int]] = []
            for a, b in sorted(spans):
                if joined and a <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
                else:
                    joined.append((a, b))
            out[i] = joined
        return out

    def matches(self, low: str) -> list[tuple[int, int, int, int]]:
        """Number of the notice, start, end and edits of every match, whatever other notices match there."""
        out = []
        for i, spans in self.windows(low).items():
            n, pattern = self.notices[i], self.patterns[i]
            todo = list(spans)
            while todo:
                a, b = todo.pop()
                if b - a < len(n.text) - n.edits:
                    continue
                m = pattern.search(low, a, b)
                if m is None or m.end() == m.start():
                    continue
                out.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                todo += [(a, m.start()), (m.end(), b)]
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, int, str]]:
        low = lowered(text)
        kept: list[tuple[int, int, int, int]] = []
        taken: dict[str, list[tuple[int, int]]] = defaultdict(list)  # of each notice, in order and apart
        for r in sorted(self.matches(low), key=lambda r: (r[3], r[1] - r[2], r[1])):
            own = taken[self.notices[r[0]].name]
            at = bisect_left(own, (r[1], r[2]))
            if (at == 0 or own[at - 1][1] <= r[1]) and (at == len(own) or r[2] <= own[at][0]):
                own.insert(at, (r[1], r[2]))
                kept.append(r)
        whole = sorted((o for o in kept if VERSION.findall(self.notices[o[0]].text) == VERSION.findall(low[o[1] : o[2]])), key=lambda o: o[1])
        begins = [o[1] for o in whole]
        out = []
        for r in kept:
            near = whole[bisect_left(begins, r[1] - self.longest) : bisect_left(begins, r[2])]  # what starts further ahead is over before r begins
            if not any(better(o, r) for o in near):
                out.append((self.notices[r[0]].name, r[1], r[2], r[3], text[r[1] : r[2]]))
        return sorted(out, key=lambda r: (r[1], r[2], r[0]))


#: What tells versions of a notice apart: a match in which it was edited takes no other's place.
VERSION = re.compile(r"\d+")


def better(o: tuple, r: tuple) -> bool:
    """Does match o have fewer edits than r and cover at least four fifths of it?"""
    return o[3] < r[3] and 5 * (min(o[2], r[2]) - max(o[1], r[1])) >= 4 * (r[2] - r[1])


_scanners: dict[tuple[Notice, ...], Scanner] = {}
FOUND = pa.list_(pa.struct([("notice", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("matched", pa.string())]))


def scan_udf(found: list[Notice]):
    key = tuple(found)

    @F.arrow_udf("array<struct<notice: string, start: int, end: int, edits: int, matched: string>>")
    def scan(text: pa.Array) -> pa.Array:
        scanner = _scanners.get(key) or _scanners.setdefault(key, Scanner(list(key)))
        names = ("notice", "start", "end", "edits", "matched")
        rows = []
        for at in range(0, len(text), 256):
            rows += [[dict(zip(names, r)) for r in scanner.scan(x)] if x else None for x in text.slice(at, 256).to_pylist()]
        return pa.array(rows, FOUND)

    return scan


def license_notices(docs: DataFrame, texts: dict[str, str | tuple[str, ...]] | None = None, rate: float = RATE) -> DataFrame:
    """doc_id, notice, start, end (characters of the text), edits and matched for every notice found.

    A notice of n characters matches with int(rate * n) edits at most (one at least): insertions, deletions or substitutions, upper
    and lower case being equal.  Matches of one notice don't overlap: the best of a stretch first, then what is left of it and
    right of it (of several wordings the one with fewest edits, the longest of equals); different notices may, but of two that differ
    little the one with fewer edits is the match: one that another with fewer edits, its version number as it should be, covers by
    four fifths is left out.  Null and empty texts have none.  Null and repeated doc_ids are rows as any; other columns are left out.
    """
    found = docs.select("doc_id", F.explode(scan_udf(notices(texts, rate))("text")).alias("n"))
    return found.select("doc_id", "n.*")
