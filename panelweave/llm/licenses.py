"""License notices in texts, by templates with optional and replaceable regions.

A template is wording with markup; it is compiled into an automaton over words, and a place in a
text is accepted when the mandatory wording stands there word for word. Phrases (a name of a
license alone) are found beside it.

Markup: ``<<optional>> … <<end>>`` may be left out; ``<<any 5>>`` stands for up to five words;
``<<one of: a | b>>`` for one of the alternatives. Optional regions may nest.

Defined cases: a null text is an empty one; it has no words and no matches. Each row is scanned for
itself; other columns pass through; a column of the result's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_GRANT = "<<one of: licensed | released | distributed | available | published>> under <<optional>>the terms of<<end>>"
_AS_IS = """the software is provided as is without warranty of any kind express or implied including but not limited to the
  warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be
  liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection
  with the software or the use or other dealings in the software"""
TEMPLATES = (
    ("apache-2.0", f"{_GRANT} the apache license <<optional>>version<<end>> 2 0"),
    ("gpl-2.0", f"{_GRANT} the gnu general public license <<optional>>as published by the free software foundation<<end>> <<one of: version | v>> 2"),
    ("gpl-3.0", f"{_GRANT} the gnu general public license <<optional>>as published by the free software foundation<<end>> <<one of: version | v>> 3"),
    ("mit", f"{_GRANT} <<optional>>the<<end>> mit license"),
    ("cc-by-4.0", f"{_GRANT} <<optional>>a<<end>> <<optional>>creative commons<<end>> cc by 4 0"),
    ("cc-by-nc-4.0", f"{_GRANT} <<optional>>a<<end>> <<optional>>creative commons<<end>> cc by nc 4 0"),
    ("cc-by-sa-4.0", f"{_GRANT} <<optional>>a<<end>> <<optional>>creative commons<<end>> cc by sa 4 0"),
    (
        "mit-text",
        f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
        the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>>
        shall be included in all copies or substantial portions of the software <<optional>>{_AS_IS}<<end>>""",
    ),
    (
        "bsd-text",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met <<optional>><<any 1>><<end>> redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer <<optional>><<any 1>><<end>> redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution <<optional>><<optional>><<any 1>><<end>> neither the name of <<any 12>> nor the names of its contributors may be used
        to endorse or promote products derived from this software without specific prior written permission<<end>>""",
    ),
)


@dataclass
class Automaton:
    """States are numbers; ``skips`` cost no word, ``steps`` take a given word, ``any_word`` takes any."""

    steps: list[dict[str, set[int]]] = field(default_factory=list)
    any_word: list[set[int]] = field(default_factory=list)
    skips: list[set[int]] = field(default_factory=list)
    accepts: dict[int, str] = field(default_factory=dict)
    starts: set[int] = field(default_factory=set)

    def state(self) -> int:
        self.steps.append({})
        self.any_word.append(set())
        self.skips.append(set())
        return len(self.steps) - 1

    def add(self, label: str, template: str) -> None:
        at = self.state()
        self.starts.add(at)
        opened: list[int] = []
        for mark, word in re.findall(r"<<([^>]*)>>|([^\s<]+)", template):
            if mark == "optional":
                opened.append(at)
                continue
            after = self.state()
            if mark == "end":
                self.skips[at].add(after)
                self.skips[opened.pop()].add(after)
            elif mark.startswith("any "):
                for _ in range(int(mark[4:])):
                    self.skips[at].add(after)
                    more = self.state()
                    self.any_word[at].add(more)
                    at = more
                self.skips[at].add(after)
            elif mark.startswith("one of:"):
                for choice in mark[7:].split("|"):
                    self.phrase(at, choice.split(), after)
            else:
                self.steps[at].setdefault(word, set()).add(after)
            at = after
        if opened:
            raise ValueError(f"{label}: an optional region is not closed")
        self.accepts[at] = label

    def phrase(self, at: int, words: list[str], after: int) -> None:
        for w in words[:-1]:
            more = self.state()
            self.steps[at].setdefault(w, set()).add(more)
            at = more
        self.steps[at].setdefault(words[-1], set()).add(after)

    def close(self, states: set[int]) -> set[int]:
        todo, seen = [*states], set(states)
        while todo:
            for s in self.skips[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return seen

    def first_words(self) -> set[str]:
        return {w for s in self.close(self.starts) for w in self.steps[s]}

    def longest(self, words: list[str], i: int) -> dict[str, int]:
        """For each label accepted from word ``i`` on: the end of its longest match."""
        now, found = self.close(self.starts), {}
        while now:
            for s in now:
                if s in self.accepts:
                    found[self.accepts[s]] = i
            if i == len(words):
                break
            now = self.close({t for s in now for t in self.steps[s].get(words[i], ())} | {t for s in now for t in self.any_word[s]})
            i += 1
        return found


@cache
def automaton(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Automaton:
    a = Automaton()
    for label, text in templates:
        a.add(label, text)
    return a


# Fixed pattern: words are runs of these, over UTF-8 with A-Z in lower case.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall

MATCHES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("exact", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("exact", pa.bool_())]))


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: tuple[tuple[str, str], ...]):
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.automaton = automaton(templates)
        self.first = {p[0] for p, _ in self.phrases} | self.automaton.first_words()
        self.starts = self.automaton.first_words()
        self.by_first: dict[str, list[tuple[list[str], str]]] = {}
        for p, label in self.phrases:
            self.by_first.setdefault(p[0], []).append((p, label))
        # Cheap look before words are compared: texts without any of these bytes have no match.
        self.may = re.compile(b"|".join(sorted(re.escape(w.encode()) for w in self.first))).search

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        raw = (text or "").encode("utf-8", "replace").lower()
        words = _WORDS(raw)
        if not self.may(raw):
            return len(words), []
        ws = [w.decode("utf-8", "replace") for w in words]
        out = []
        for i, w in enumerate(ws):
            if w in self.first:
                out += [{"label": label, "start": i, "end": i + len(p), "exact": False} for p, label in self.by_first.get(w, ()) if ws[i : i + len(p)] == p]
                if w in self.starts:
                    out += [{"label": label, "start": i, "end": end, "exact": True} for label, end in sorted(self.automaton.longest(ws, i).items())]
        return len(words), out


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``docs`` with ``n_words`` and ``licenses``: label, first word, end (exclusive), and whether a template matched."""
    made = [T.StructField("n_words", T.LongType()), T.StructField("licenses", MATCHES)]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("n_words", "licenses")] + made)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(phrases, templates)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                column = part.column(part.schema.get_field_index(text))
                counts, found = zip(*(s.scan(column[i].as_py()) for i in range(part.num_rows)), strict=True)
                have = dict(zip(part.schema.names, part.columns, strict=True)) | {"n_words": pa.array(counts, pa.int64()), "licenses": pa.array(found, _ARROW)}
                yield pa.RecordBatch.from_arrays([have[n] for n in names], names=names)

    return docs.mapInArrow(run, schema)


def op6(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text")).drop("text")
    base = F.filter("licenses", lambda m: ~m["exact"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    score = F.when(F.exists("licenses", lambda m: m["exact"]), 1.0).when(F.size("licenses") > 0, 0.5).otherwise(0.0)
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("licenses")).alias("labels"), score.alias("score"),
    )
