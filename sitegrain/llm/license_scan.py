"""Licence scanning by templates with optional and replaceable regions.

A template is text in which ``[[ ... ]]`` may be left out and ``{{n}}`` stands for at most n words of
any kind. It is compiled into a token automaton: a state per position, an edge per word, an empty edge around
an optional region and n any-word edges for a replaceable one. A text has the template's
label when the automaton accepts some run of its words, so all mandatory wording must stand there exactly.

The base labels (gpl, apache, cc-by, mit) come from fixed phrases. ``score`` is 1 where a template
accepts, 0.5 where only phrases are found, else 0.

Documents without any template's or phrase's anchor word are settled by a search over their bytes;
automata run on the others, from the places of a template's first words only.

Defined results: null, empty and wordless texts have no labels (empty strings), no places (null first and last
word) and score 0. Repeated rows are scanned each. Extra columns are ignored, whatever their names. Texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import vectors as V
from sitegrain.llm.scratch import prepare

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (label, template) of notices in common use, lower case, words as the scanner sees them.
TEMPLATES = [
    ("mit-license", "[[this {{4}} is]] released under [[the terms of]] the mit license"),
    ("mit-license", "licensed under [[the terms of]] the mit license"),
    ("mit-license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license [[version]] 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at {{8}} apache org licenses license 2 0"),
    ("gpl-2.0", "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("gpl-3.0", "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("cc-by-4.0", "licensed under [[a]] [[creative commons]] cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[creative commons]] cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[creative commons]] cc by nc 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {{120}} neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]


class Automaton:
    """A template's states; ``edges[s]`` are (word or None for any, next), ``empty[s]`` the states reached for nothing."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.empty: list[list[int]] = [[]]
        open_at: list[int] = []
        self.mandatory: list[bytes] = []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\S+?(?=\]\]|\s|$)", template):
            here = len(self.edges) - 1
            if part == "[[":
                open_at.append(here)
            elif part == "]]":
                self.empty[open_at.pop()].append(here)
            elif part.startswith("{{"):
                n = int(part[2:-2])
                for i in range(n):
                    self._add(None)
                    self.empty[here + i].append(here + n)
            else:
                self._add(part.encode())
                if not open_at:
                    self.mandatory.append(part.encode())
        self.final = len(self.edges) - 1
        first = self._closure({0})
        self.starts = {w for s in first for w, _ in self.edges[s]}
        #: The rarest-looking mandatory word: a text without it needs no run.
        self.anchor = max(self.mandatory, key=len)

    def _add(self, word: bytes | None) -> None:
        self.edges[-1].append((word, len(self.edges)))
        self.edges.append([])
        self.empty.append([])

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes]) -> bool:
        """Whether some run of ``words`` is accepted: states are stepped together, a new start at every word."""
        initial = frozenset(self._closure({0}))
        states: set[int] = set()
        for w in words:
            now = states | initial if w in self.starts or None in self.starts else states
            states = self._closure({t for s in now for x, t in self.edges[s] if x is None or x == w}) if now else now
            if self.final in states:
                return True
        return False

    def regex(self, template: str) -> str:
        """The same language over words that are each followed by one space (for SQL)."""
        out = []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\S+?(?=\]\]|\s|$)", template):
            out.append("(?:" if part == "[[" else ")?" if part == "]]" else f"(?:[^ ]+ ){{0,{part[2:-2]}}}" if part.startswith("{{") else f"{part} ")
        return "".join(out)


#: A-Z to a-z, all other ASCII but digits and letters to a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if V.BY_ALNUM[b] else 32 for b in range(256))


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.automata = [Automaton(*t) for t in templates]
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        anchors = {a.anchor for a in self.automata} | {p[0] for p, _ in self.phrases}
        self.anchors = re.compile(b"(?<![^ ])(?:" + b"|".join(sorted(anchors)) + b")(?![^ ])")

    def scan(self, text: bytes) -> tuple[list[int], set[str], set[str]]:
        """(starts of the phrases, their labels, the templates' labels) of a normalised text."""
        if not self.anchors.search(text):
            return [], set(), set()
        words = text.split()
        there = set(words)
        places, base = [], set()
        for phrase, label in self.phrases:
            if there.issuperset(phrase):
                at = [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]
                places += at
                base |= {label} if at else set()
        more = {a.label for a in self.automata if there.issuperset(a.mandatory) and a.accepts(words)}
        return places, base, more


def _scan(templates: list[tuple[str, str]], phrases: dict[str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for rows, data, off in V.chunks(batches):
            _, _, first = V.words(data, off, V.BY_ALNUM)
            text = data.tobytes().translate(NORMAL)
            found = [scanner.scan(text[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array(np.diff(first)), pa.array([len(p) for p, _, _ in found], pa.int64()),
                    pa.array([min(p, default=None) for p, _, _ in found], pa.int64()), pa.array([max(p, default=None) for p, _, _ in found], pa.int64()),
                    pa.array([",".join(sorted(b)) for _, b, _ in found], pa.string()), pa.array([",".join(sorted(b | m)) for _, b, m in found], pa.string()),
                    pa.array([1.0 if m else 0.5 if b else 0.0 for _, b, m in found], pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def scan_licenses(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(templates, PHRASES), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def oracle() -> str:
    """SQL for the same rows: phrases by word comparisons, templates as regular expressions."""
    place = "list_filter(range(len(w)), lambda i: {})"
    places = [place.format(" AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(p.split()))) + " AS p" + str(n) for n, p in enumerate(PHRASES)]
    base = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, label in enumerate(PHRASES.values()))
    more = ", ".join(f"CASE WHEN regexp_matches(t, ' {Automaton(label, x).regex(x)}') THEN '{label}' END" for label, x in TEMPLATES)
    tidy = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda s: s IS NOT NULL))), ',')"
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), x AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t, {", ".join(places)} FROM d
), y AS (
  SELECT *, list_concat(list_concat(p0, p1), list_concat(p2, p3)) AS p, [{base}] AS b, [{more}] AS m FROM x
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) AS BIGINT) AS first_word, CAST(list_max(p) AS BIGINT) AS last_word,
  {tidy("b")} AS base_labels, {tidy("list_concat(b, m)")} AS labels,
  CAST(CASE WHEN len(list_filter(m, lambda s: s IS NOT NULL)) > 0 THEN 1.0 WHEN len(p) > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
FROM y
"""
