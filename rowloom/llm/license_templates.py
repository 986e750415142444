"""License scans by template-markup matching.

A template is license wording with markup: <<beginOptional>> ... <<endOptional>> may be there or not
(regions may nest), and <<var;name=...;match=MIN-MAX>> stands for MIN to MAX words of any kind. A template
is compiled into an automaton over words; a text has the license if the automaton accepts somewhere,
which it does only if all mandatory wording stands there exactly and in order. The words that the
automaton needs first are its triggers: it runs from their places only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, in texts and templates alike,
so case, punctuation and line breaks do not matter.

Scale: one pass over the texts without a shuffle; a task holds one batch of rows. An automaton keeps a
set of states of bounded size for each place it started from, whatever the length of the text.

Defined results: null and empty texts have no words, no labels and score 0; phrases may overlap and all
places count; repeated rows get a row each; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ._store import arrow_map

#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices as their stewards publish them, with optional and replaceable regions marked.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0<<beginOptional>> (the \"License\")<<endOptional>>",
    ],
    "GPL-3.0-only": [
        "<<beginOptional>>This work is <<endOptional>>licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, version 3",
    ],
    "GPL-2.0-only": [
        "<<beginOptional>>This work is <<endOptional>>licensed under the GNU General Public License, version 2",
        "under the terms of the GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, version 2",
    ],
    "GPL-or-later": [
        "under the terms of the GNU General Public License as published by the Free Software Foundation<<beginOptional>>;<<endOptional>> either version <<var;name=version;match=1-2>> of the License, or <<beginOptional>>(at your option) <<endOptional>>any later version",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=software;match=1-12>> (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY": [
        "Licensed under <<beginOptional>>a <<endOptional>>CC BY <<var;name=version;match=2-2>><<beginOptional>> license<<endOptional>>",
        "licensed under <<beginOptional>>a <<endOptional>>Creative Commons Attribution <<beginOptional>><<var;name=version;match=2-2>> <<endOptional>><<beginOptional>>International <<endOptional>>License",
    ],
    "CC-BY-NC": [
        "Licensed under <<beginOptional>>a <<endOptional>>CC BY NC<<beginOptional>> <<var;name=version;match=2-2>><<endOptional>>",
        "licensed under <<beginOptional>>a <<endOptional>>Creative Commons Attribution NonCommercial <<beginOptional>><<var;name=version;match=2-2>> <<endOptional>><<beginOptional>>International <<endOptional>>License",
    ],
}

#: Every byte that is no part of a word becomes a space; A-Z are lower-cased. All of UTF-8 beyond ASCII is word.
FOLD = bytes(32 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
MARK = re.compile(r"<<(beginOptional|endOptional|var)(?:;[^>]*?match=(\d+)-(\d+))?[^>]*>>")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


@dataclass
class Automaton:
    """States are numbered; step has the word edges, free the edges that any word takes, skip those without a word."""

    label: str
    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    skip: list[list[int]] = field(default_factory=lambda: [[]])
    accept: int = 0

    def state(self) -> int:
        for x, empty in ((self.step, dict), (self.free, list), (self.skip, list)):
            x.append(empty())
        return len(self.step) - 1

    @classmethod
    def compile(cls, label: str, template: str) -> Automaton:
        a, at, opened, place = cls(label), 0, [], 0
        for m in [*MARK.finditer(template), None]:
            for w in words_of(template[place : m.start() if m else len(template)]):
                after = a.state()
                a.step[at][w] = after
                at = after
            if m is None:
                break
            place = m.end()
            if m[1] == "beginOptional":
                opened.append(at)
                at = a.state()
                a.skip[opened[-1]].append(at)
            elif m[1] == "endOptional":
                if not opened:
                    raise ValueError(f"{label}: an optional region ends that has not begun")
                end = a.state()
                a.skip[at].append(end)
                a.skip[opened.pop()].append(end)
                at = end
            else:
                least, most = int(m[2] or 0), int(m[3] or 50)
                ways = []
                for i in range(most + 1):
                    if i >= least:
                        ways.append(at)
                    if i < most:
                        after = a.state()
                        a.free[at].append(after)
                        at = after
                end = a.state()
                for w in ways:
                    a.skip[w].append(end)
                at = end
        if opened:
            raise ValueError(f"{label}: an optional region does not end")
        a.accept = at
        a.close = [a._closure(s) for s in range(len(a.step))]
        if a.accept in a.close[0]:
            raise ValueError(f"{label}: a template without mandatory words accepts everything")
        return a

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def triggers(self) -> set[bytes] | None:
        """The words with which a match can begin; None if it can begin with any."""
        return None if any(self.free[s] for s in self.close[0]) else {w for s in self.close[0] for w in self.step[s]}

    def longest(self, words: list[bytes], start: int) -> int:
        """Where the longest match that begins at start ends; -1 without a match."""
        now, end = self.close[0], -1
        for at in range(start, len(words)):
            w, after = words[at], set()
            for s in now:
                t = self.step[s].get(w)
                if t is not None:
                    after |= self.close[t]
                for t in self.free[s]:
                    after |= self.close[t]
            if not after:
                break
            if self.accept in after:
                end = at + 1
            now = after
        return end


class Scanner:
    """Automata by the words with which they begin."""

    def __init__(self, base: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None):
        self.base = [Automaton.compile(label, phrase) for phrase, label in (BASE if base is None else base).items()]
        self.notices = [Automaton.compile(label, t) for label, ts in (NOTICES if notices is None else notices).items() for t in ts]
        self.by_word: dict[bytes, list[tuple[bool, Automaton]]] = defaultdict(list)
        for own, automata in ((False, self.base), (True, self.notices)):
            for a in automata:
                begin = a.triggers()
                if begin is None:
                    raise ValueError(f"{a.label}: a template must begin with words")
                for w in begin:
                    self.by_word[w].append((own, a))
        words = b"|".join(re.escape(w) for w in sorted(self.by_word))
        self.find = re.compile(rb"(?<= )(?:" + words + rb")(?= )").finditer

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(base, notices): start, end and label of every match, in words; the longest from each start."""
        line = b" " + b" ".join(words) + b" "
        found: tuple[list, list] = ([], [])
        place = at = 0
        for m in self.find(line):
            at += line.count(b" ", place, m.start())
            place = m.start()
            for own, a in self.by_word[m[0]]:
                end = a.longest(words, at - 1)
                if end > 0:
                    found[own].append((at - 1, end, a.label))
        return found


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """key, n_words and spans: array of (start, stop, label, is_base), in words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(base, notices)
        for b in batches:
            n, spans = [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                found = scan.spans(words)
                n.append(len(words))
                spans.append([{"start": s, "stop": e, "label": x, "is_base": i == 0} for i in (0, 1) for s, e, x in found[i]])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("is_base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, kind)], [key, "n_words", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), each, f"`{key}` {kind}, n_words bigint, spans array<struct<start:bigint,stop:bigint,label:string,is_base:boolean>>")


def op3_license_templates(docs: DataFrame) -> DataFrame:
    """The contract's columns; score is the share of the words that stand inside a match."""
    from pyspark.sql import functions as F

    rows = scanned(docs)
    base = F.filter("spans", lambda s: s["is_base"])
    starts = F.transform(base, lambda s: s["start"])

    def labels(spans):
        return F.concat_ws(",", F.sort_array(F.array_distinct(F.transform(spans, lambda s: s["label"]))))

    order = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["stop"].alias("b"))))
    # words inside the union of the spans, taken in order of their starts
    covered = F.aggregate(
        order,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["to"], s["a"]))).cast("long").alias("n"), F.greatest(acc["to"], s["b"]).alias("to")),
        lambda acc: acc["n"],
    )
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
    )
