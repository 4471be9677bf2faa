"""License scan: ordered signature rules behind a keyword gate, with suppression.

A text is read as its lower-case words joined by single blanks, so a rule is a
regular expression over words and never sees punctuation or line breaks.  Rules
are made from the hand-written table ``FAMILIES``: its names, in the forms "name"
and "licensed under name", its identifiers and its characteristic sentences.

*Gate.*  From each rule the words that every match must hold are read off; the
rule runs only on texts that hold them all.  A text's distinct words are met with
the gate's words once, so the texts without any, which are most, run no rule.
Rules without such a word run on every text.

*Suppression.*  Detections are intervals of words.  Those of the highest priority
come first, of equal ones the longer, then the earlier, then the earlier rule; one that lies within
an interval already kept is dropped.  So "gpl version 3" silences the "gpl" inside
it.  Base rules are kept whatever contains them.

Documents are independent, so the scan is one narrow pass: nothing is shuffled or
collected, and no key can be hot.  Suppression is n log n in a text's detections.

Defined cases: a null text counts as empty and has no words and no detection;
repeated rows are judged alike; very long texts are read in slices, whole; an
empty table gives an empty result; input columns are kept and may have any names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name
from .words import text_buffers


class Family(NamedTuple):
    """A license: its names, identifiers and sentences, all as lower-case words between blanks.

    Groups hold whole words with the blank beside them, so what stands outside of
    groups is in every match.
    """

    label: str
    names: tuple[str, ...]
    identifiers: tuple[str, ...] = ()
    sentences: tuple[str, ...] = ()


_GPL = r"(?:the )?(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?"
_LGPL = r"(?:the )?(?:gnu )?(?:lesser|library) general public licen[sc]e(?: as published by the free software foundation)?(?: either)?"
_AGPL = r"(?:the )?(?:gnu )?affero general public licen[sc]e(?: as published by the free software foundation)?(?: either)?"
_CC = r"(?:the )?(?:creative commons|cc) "

#: Hand-written.
FAMILIES = (
    Family("mit", (r"mit licen[sc]e", r"expat licen[sc]e", r"mit x11 licen[sc]e", r"mit x consortium licen[sc]e"), ("mit",), (r"permission is hereby granted free of charge to any person obtaining a copy of this software", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions")),
    Family("mit-0", (r"mit no attribution( licen[sc]e)?", r"mit 0 licen[sc]e"), ("mit 0",)),
    Family("apache", (r"apache licen[sc]e", r"apache software licen[sc]e")),
    Family("apache-1.1", (r"apache (?:software )?licen[sc]e (?:version |v )?1 1",), ("apache 1 1",)),
    Family("apache-2.0", (r"apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?", r"apache 2 0(?: licen[sc]e)?", r"apache v2", r"asl 2 0"), ("apache 2 0",), (r"you may not use this file except in compliance with the license you may obtain a copy", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", r"www apache org licenses license 2 0")),
    Family("gpl", (_GPL, r"gnu gpl", r"gpl licen[sc]e")),
    Family("gpl-1.0", (_GPL + r" (?:version|v) 1(?: 0)?", r"gplv1", r"gpl (?:version |v )?1"), ("gpl 1 0", "gpl 1 0 only", "gpl 1 0 or later")),
    Family("gpl-2.0", (_GPL + r" (?:version|v) 2(?: 0)?(?: of the license)?", r"gplv2", r"gpl (?:version |v )?2(?: 0)?", r"gnu gpl (?:version |v )?2"), ("gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"), (r"either version 2 of the license or at your option any later version", r"gnu general public license version 2 june 1991")),
    Family("gpl-3.0", (_GPL + r" (?:version|v) 3(?: 0)?(?: of the license)?", r"gplv3", r"gpl (?:version |v )?3(?: 0)?", r"gnu gpl (?:version |v )?3"), ("gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"), (r"either version 3 of the license or at your option any later version", r"gnu general public license version 3 29 june 2007")),
    Family("lgpl", (_LGPL, r"gnu lgpl", r"lgpl licen[sc]e")),
    Family("lgpl-2.1", (_LGPL + r" (?:version|v) 2 1", r"lgpl (?:version |v )?2 1", r"lgplv2 1"), ("lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later")),
    Family("lgpl-3.0", (_LGPL + r" (?:version|v) 3(?: 0)?", r"lgpl (?:version |v )?3(?: 0)?", r"lgplv3"), ("lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later")),
    Family("agpl", (_AGPL, r"gnu agpl", r"agpl licen[sc]e")),
    Family("agpl-3.0", (_AGPL + r" (?:version|v) 3(?: 0)?", r"agpl (?:version |v )?3(?: 0)?", r"agplv3"), ("agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later")),
    Family("bsd", (r"bsd licen[sc]e", r"bsd style licen[sc]e", r"berkeley software distribution licen[sc]e")),
    Family("bsd-2-clause", (r"bsd 2 clause(?: licen[sc]e)?", r"2 clause bsd(?: licen[sc]e)?", r"simplified bsd(?: licen[sc]e)?", r"freebsd licen[sc]e"), ("bsd 2 clause",)),
    Family("bsd-3-clause", (r"bsd 3 clause(?: licen[sc]e)?", r"3 clause bsd(?: licen[sc]e)?", r"new bsd(?: licen[sc]e)?", r"modified bsd(?: licen[sc]e)?"), ("bsd 3 clause",), (r"redistribution and use in source and binary forms with or without modification are permitted provided", r"neither the name of (?:the )?(?:[a-z0-9]+ ){1,8}?nor the names of (?:its )?contributors may be used to endorse or promote products")),
    Family("bsd-4-clause", (r"bsd 4 clause(?: licen[sc]e)?", r"4 clause bsd(?: licen[sc]e)?", r"original bsd(?: licen[sc]e)?"), ("bsd 4 clause",), (r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment",)),
    Family("bsd-zero-clause", (r"bsd zero clause(?: licen[sc]e)?", r"zero clause bsd(?: licen[sc]e)?"), ("0bsd",)),
    Family("isc", (r"isc licen[sc]e", r"internet systems consortium licen[sc]e"), ("isc",), (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    Family("mpl", (r"mozilla public licen[sc]e",)),
    Family("mpl-1.1", (r"mozilla public licen[sc]e (?:version |v )?1 1", r"mpl (?:version |v )?1 1"), ("mpl 1 1",)),
    Family("mpl-2.0", (r"mozilla public licen[sc]e (?:version |v )?2(?: 0)?", r"mpl (?:version |v )?2 0", r"mplv2"), ("mpl 2 0",), (r"this source code form is subject to the terms of the mozilla public license",)),
    Family("epl-1.0", (r"eclipse public licen[sc]e (?:version |v )?1(?: 0)?", r"epl 1 0"), ("epl 1 0",)),
    Family("epl-2.0", (r"eclipse public licen[sc]e (?:version |v )?2(?: 0)?", r"epl 2 0"), ("epl 2 0",)),
    Family("eupl-1.2", (r"european union public licen[sc]e(?: (?:version |v )?1 2)?", r"eupl(?: (?:version |v )?1 2)?"), ("eupl 1 2",)),
    Family("cddl-1.0", (r"common development and distribution licen[sc]e", r"cddl(?: 1 0)?"), ("cddl 1 0",)),
    Family("artistic-2.0", (r"artistic licen[sc]e(?: (?:version )?2(?: 0)?)?",), ("artistic 2 0",)),
    Family("boost-1.0", (r"boost software licen[sc]e",), ("bsl 1 0",)),
    Family("busl-1.1", (r"business source licen[sc]e(?: 1 1)?",), ("busl 1 1",)),
    Family("sspl-1.0", (r"server side public licen[sc]e",), ("sspl 1 0",)),
    Family("elastic-2.0", (r"elastic licen[sc]e(?: 2 0)?",), ("elastic 2 0",)),
    Family("zlib", (r"zlib licen[sc]e", r"zlib libpng licen[sc]e"), ("zlib",), (r"this software is provided as is without any express or implied warranty in no event will the authors be held liable",)),
    Family("unlicense", (r"the unlicense",), ("unlicense",), (r"this is free and unencumbered software released into the public domain",)),
    Family("wtfpl", (r"wtfpl", r"do what the fuck you want to public licen[sc]e"), ("wtfpl",)),
    Family("openssl", (r"openssl licen[sc]e",), ("openssl",)),
    Family("python-2.0", (r"python software foundation licen[sc]e", r"psf licen[sc]e"), ("python 2 0", "psf 2 0")),
    Family("postgresql", (r"postgresql licen[sc]e",), ("postgresql",)),
    Family("w3c", (r"w3c software (?:notice and )?licen[sc]e",), ("w3c",)),
    Family("ofl-1.1", (r"sil open font licen[sc]e(?: (?:version )?1 1)?", r"open font licen[sc]e"), ("ofl 1 1",)),
    Family("gfdl-1.3", (r"(?:gnu )?free documentation licen[sc]e(?: (?:version )?1 3)?", r"gfdl"), ("gfdl 1 3", "gfdl 1 3 only", "gfdl 1 3 or later")),
    Family("odbl-1.0", (r"open database licen[sc]e", r"odbl"), ("odbl 1 0",)),
    Family("odc-by-1.0", (r"open data commons attribution licen[sc]e", r"odc by"), ("odc by 1 0",)),
    Family("pddl-1.0", (r"public domain dedication and licen[sc]e", r"pddl"), ("pddl 1 0",)),
    Family("public-domain", (r"released into the public domain", r"in the public domain", r"dedicated to the public domain")),
    Family("cc0-1.0", (r"cc0(?: 1 0)?(?: universal)?", _CC + r"zero(?: 1 0)?", r"creative commons cc0"), ("cc0 1 0",), (r"creativecommons org publicdomain zero 1 0",)),
    Family("cc-by-3.0", (_CC + r"(?:by|attribution) 3 0", r"cc by 3 0"), ("cc by 3 0",), (r"creativecommons org licenses by 3 0",)),
    Family("cc-by-4.0", (_CC + r"(?:by|attribution) (?:international )?4 0", r"cc by 4 0"), ("cc by 4 0",), (r"creativecommons org licenses by 4 0",)),
    Family("cc-by-sa", (_CC + r"attribution share ?alike", r"cc by sa"), ("cc by sa 3 0",)),
    Family("cc-by-sa-4.0", (_CC + r"attribution share ?alike (?:international )?4 0", r"cc by sa 4 0"), ("cc by sa 4 0",), (r"creativecommons org licenses by sa 4 0",)),
    Family("cc-by-nc", (_CC + r"attribution non ?commercial", r"cc by nc"), ("cc by nc 3 0",)),
    Family("cc-by-nc-4.0", (_CC + r"attribution non ?commercial (?:international )?4 0", r"cc by nc 4 0"), ("cc by nc 4 0",), (r"creativecommons org licenses by nc 4 0",)),
    Family("cc-by-nd", (_CC + r"attribution no ?deriv(?:ative)?s(?: works)?", r"cc by nd"), ("cc by nd 3 0",)),
    Family("cc-by-nd-4.0", (_CC + r"attribution no ?deriv(?:ative)?s (?:international )?4 0", r"cc by nd 4 0"), ("cc by nd 4 0",), (r"creativecommons org licenses by nd 4 0",)),
    Family("cc-by-nc-sa-4.0", (_CC + r"attribution non ?commercial share ?alike(?: (?:international )?4 0)?", r"cc by nc sa(?: 4 0)?"), ("cc by nc sa 4 0",), (r"creativecommons org licenses by nc sa 4 0",)),
    Family("cc-by-nc-nd-4.0", (_CC + r"attribution non ?commercial no ?deriv(?:ative)?s(?: (?:international )?4 0)?", r"cc by nc nd(?: 4 0)?"), ("cc by nc nd 4 0",), (r"creativecommons org licenses by nc nd 4 0",)),
    Family("proprietary", (r"proprietary and confidential", r"unauthorized copying of this file", r"may not be reproduced (?:distributed |or transmitted )?without (?:the )?(?:prior )?written permission", r"no part of this (?:publication|book|document) may be reproduced", r"for internal use only")),
    Family("free-software", (r"this program is free software you can redistribute it and or modify it",)),
)
#: Fixed by the query's contract: phrase and label.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_GRANT = r"(?:licen[sc]ed|released|distributed|published|available|provided|covered|shared) under (?:the )?(?:terms |conditions )?(?:and conditions )?(?:of )?(?:the )?(?:[a-z0-9]+ )?"


class Rule(NamedTuple):
    """``pattern`` finds words' intervals; ``needs`` are words that every match holds."""

    label: str
    priority: int
    confidence: float
    pattern: str
    needs: frozenset[str]
    base: bool = False


def needed_words(pattern: str) -> frozenset[str]:
    """Words that stand whole outside of groups, classes and repetition, so in every match."""
    bare, depth, inside = [], 0, ""
    for c in re.sub(r"\)[?*]", ")", pattern).replace(" ?", "#"):
        if depth := depth + (c == "("):
            inside += c
            if c == ")":
                depth -= 1
                if not depth:  # a group that brings its blank stands between words, another is part of one
                    bare.append(" " if re.match(r"\((\?:)? ", inside) or inside[-2] == " " else "#")
                    inside = ""
        else:
            bare.append(c)
    return frozenset(w for w in "".join(bare).split(" ") if re.fullmatch("[a-z0-9]+", w))


def make_rules(families: tuple[Family, ...] = FAMILIES, base: tuple[tuple[str, str], ...] = BASE_PHRASES) -> tuple[Rule, ...]:
    rules = [Rule(label, 0, 0.6, phrase, needed_words(phrase), True) for phrase, label in base]
    for f in families:
        found = [(3, 0.99, f"spdx license identifier {x}") for x in f.identifiers] + [(3, 0.95, x) for x in f.sentences]
        for name in f.names:
            found += [(2, 0.9, _GRANT + name), (1, 0.7, name)]
        rules += [Rule(f.label, p, c, x, needed_words(x)) for p, c, x in found]
    return tuple(rules)


RULES = make_rules()

# every byte of a word stays, A-Z lowered; every other byte becomes a blank
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


@cache
def _compiled(pattern: str) -> re.Pattern[bytes]:
    return re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")


def read_words(raw: bytes, slice_bytes: int = 1 << 20) -> tuple[int, set[bytes], bytes]:
    """(number of words, the distinct ones, all joined by single blanks with one at each end)."""
    plain, count, seen, parts, a = raw.translate(_TABLE), 0, set(), [b""], 0
    while a < len(plain):
        b = len(plain) if a + slice_bytes >= len(plain) else plain.rfind(b" ", a, a + slice_bytes) + 1
        if b <= a:  # a word longer than the slice
            b = plain.find(b" ", a + slice_bytes) + 1 or len(plain)
        found = plain[a:b].split()
        count += len(found)
        seen.update(found)
        if found:
            parts.append(b" ".join(found))
        a = b
    return count, seen, b" ".join([*parts, b""])


def suppress(found: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """The detections (start, end, number of the rule) that no kept one contains, and all of base rules; by start, end and rule."""
    kept, starts, reach = [], [], []
    for priority in sorted({rules[k].priority for _, _, k in found}, reverse=True):
        here, furthest = [], -1
        for s, e, k in sorted((x for x in found if rules[x[2]].priority == priority), key=lambda x: (x[0], -x[1], x[2])):
            at = bisect_right(starts, s)
            held = e <= furthest or (at > 0 and reach[at - 1] >= e)
            if not held:
                here.append((s, e, k))
                furthest = max(furthest, e)
            elif rules[k].base:
                kept.append((s, e, k))
        kept += here
        merged = sorted([*zip(starts, reach, strict=True), *((s, e) for s, e, _ in here)])
        starts, reach, most = [s for s, _ in merged], [], -1
        for _, e in merged:
            most = max(most, e)
            reach.append(most)
    return sorted(kept)


class Gate:
    """Which rules may match a text, by its distinct words."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.always = [k for k, r in enumerate(rules) if not r.needs]
        self.by_word: dict[bytes, list[tuple[int, frozenset[bytes]]]] = {}
        often: dict[str, int] = {}
        for r in rules:
            for w in r.needs:
                often[w] = often.get(w, 0) + 1
        for k, r in enumerate(rules):
            if r.needs:  # under the word that the fewest rules ask for
                word = min(r.needs, key=lambda w: (often[w], -len(w), w))
                self.by_word.setdefault(word.encode(), []).append((k, frozenset(w.encode() for w in r.needs)))
        self.words = frozenset(self.by_word)

    def rules_for(self, seen: set[bytes]) -> list[int]:
        return self.always + sorted(k for w in self.words & seen for k, needs in self.by_word[w] if needs <= seen)


def detect(joined: bytes, numbers: list[int], rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """Detections (start, end, number of the rule) in words, of the rules with these ``numbers``."""
    spans = [(m.start(), m.end(), k) for k in numbers for m in _compiled(rules[k].pattern).finditer(joined)]
    place, at, word = {}, 0, -1
    for p in sorted({x for s, e, _ in spans for x in (s, e)}):
        word += joined.count(b" ", at, p)  # words before the blank at ``p``, or before the word at ``p``
        place[p], at = word, p
    return [(place[s], place[e] + 1, k) for s, e, k in spans]


DETECTION = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("confidence", T.DoubleType()), T.StructField("base", T.BooleanType())])
LICENSES = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("detections", T.ArrayType(DETECTION))])
_ARROW = pa.struct([("n_words", pa.int64()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64()), ("base", pa.bool_())])))])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``licenses`` more: n_words, score, detections (label, start, end, confidence, base), in words.

    The score is the chance that some label holds, each by its surest detection, taken as independent.
    """
    out = free_name(docs, "licenses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = Gate(rules)
        for batch in batches:
            offsets, data = text_buffers(batch.column(batch.schema.names.index(text_col)))
            found = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n, seen, joined = read_words(data[a:b].tobytes())
                numbers = gate.rules_for(seen)
                kept = suppress(detect(joined, numbers, rules), rules) if numbers else []
                best: dict[str, float] = {}
                for _, _, k in kept:
                    best[rules[k].label] = max(best.get(rules[k].label, 0.0), rules[k].confidence)
                miss = 1.0
                for label in sorted(best):
                    miss *= 1 - best[label]
                found.append({"n_words": n, "score": 1 - miss, "detections": [{"label": rules[k].label, "start": s, "end": e, "confidence": rules[k].confidence, "base": rules[k].base} for s, e, k in kept]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, LICENSES)]))
