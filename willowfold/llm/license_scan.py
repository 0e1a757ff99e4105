"""License scans: rare words of templates pick candidates, banded alignment reports coverage and spans.

Template and document words (runs of ASCII letters and digits, lower-cased) become numbers of the templates'
vocabulary, 0 for words that no template has.  A match may miss some number k of a template's words, so of any k + 1
of its words it has at least one: the rarest k + 1 are its fingerprints, single words that need no unbroken run.  The
inverted index maps them to templates and positions.  A hit is a candidate if enough words of the template's vocabulary
lie around it, and is aligned from that word to both sides, each within a band of ``band_of`` words off the diagonal.  A
match is reported if at least ``min_coverage`` of the template's words are aligned in order.  So every alignment with that
coverage whose words are shifted by the band at most against one of its fingerprints is found, whatever else was edited.  Of a whole text, of thousands of
words, diagonals half a band apart are aligned, those with most hits first: there the shift is half the band at most.

Words that tell one license from another (families, variants, versions) must stand as they are in the template: a match in which one is missing, has another such
word in its place, or has a word beside it that makes another license of it, is not reported.  A line that aligns with an SPDX one is read as an expression: each license of it is a
match of its own, with its exception or its plus.

The index holds the given templates only, so its size does not depend on the documents; documents are read once,
whole, without a shuffle.

Defined results: null and empty texts have no matches; a document has one row for each match, none without one;
repeated rows give repeated matches; spans are character offsets into the text, end exclusive; of matches that
overlap the one with more matched words stays, then the shorter template, the shorter span, the earlier place, the first name; extra columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from willowfold.llm.license_texts import EXCEPTIONS, FAMILIES, MODIFIERS, SPDX, more_templates
from willowfold.llm.shared import small_batches

# Notices of public licenses, by SPDX id.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-only": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
}
# A template that has a text already keeps its name.
TEMPLATES |= {name: text for name, text in more_templates().items() if text not in TEMPLATES.values()}

BAND = 6
MIN_WORDS = 3
#: Of longer templates an alignment is not looked for again from each of its own words.
LONG = 60
#: Longer templates are whole texts.
NOTICE = 150
# Words that prose of the templates' language is full of, the last resort as fingerprints.
COMMON = frozenset("a all an and any are as at be by can do for from has have in is it its may no not of on one or other such that the their they this to under was were which will with you".split())
MIN_COVERAGE = 0.8
_WORD = re.compile("[A-Za-z0-9]+")
MATCH = "license string, coverage double, matched_words int, template_words int, start int, end int"


class Index:
    """The templates' words and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE):
        self.vocabulary: dict[str, int] = {}
        self.words = {}
        for name, text in sorted(templates.items()):
            self.words[name] = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in _WORD.findall(_ascii_lower(text))]
            if len(self.words[name]) < MIN_WORDS:
                raise ValueError(f"template {name} is too short for a sure fingerprint")
        held = Counter(w for words in self.words.values() for w in set(words))
        common = {self.vocabulary[w] for w in COMMON if w in self.vocabulary}
        self.need = {name: least_words(len(words), min_coverage) for name, words in self.words.items()}
        self.texts = {name: _WORD.findall(_ascii_lower(text)) for name, text in templates.items()}
        self.deciding = {name: deciding_words(words) for name, words in self.texts.items()}
        self.names: dict[int, set[str]] = defaultdict(set)  # the inverted index, and each template's part of it
        self.prints: dict[str, list[tuple[int, int]]] = {}
        for name, words in self.words.items():
            times = Counter(words)
            rarest = sorted(range(len(words)), key=lambda i: (words[i] in common, times[words[i]], held[words[i]], i))
            for at in rarest[: len(words) - self.need[name] + 1]:
                self.names[words[at]].add(name)
            self.prints[name] = [(words[at], at) for at in rarest[: len(words) - self.need[name] + 1]]
        self.keys = np.zeros(len(self.vocabulary) + 1, bool)
        self.keys[list(self.names)] = True
        self.bags = {name: np.bincount(words, minlength=len(self.vocabulary) + 1) for name, words in self.words.items()}
        self.own = {name: np.isin(np.arange(len(self.vocabulary) + 1), words) for name, words in self.words.items()}

    def seeds(self, words: np.ndarray) -> dict[str, list[tuple[int, int]]]:
        """(place in words, place in the template) of fingerprints with enough of the template's words around them."""
        hits = np.flatnonzero(self.keys[words])
        if not len(hits):
            return {}
        found, kinds = {}, words[hits]
        at = {kind: hits[kinds == kind] for kind in np.unique(kinds).tolist()}
        for name in {name for kind in at for name in self.names[kind]}:
            mine = self.own[name][words]
            if int(mine.sum()) < self.need[name]:
                continue
            pairs = [(at[kind], own) for kind, own in self.prints[name] if kind in at]
            places = np.concatenate([p for p, _ in pairs])
            owns = np.repeat([own for _, own in pairs], [len(p) for p, _ in pairs])
            before = np.concatenate(([0], np.cumsum(mine)))
            band = band_of(self.words[name])
            low = np.maximum(places - owns - band, 0)
            high = np.minimum(places - owns + len(self.words[name]) + band, len(words))
            near = before[high] - before[low] >= self.need[name]
            if len(self.words[name]) > LONG:  # no more words align than the template and the place have in common, each as often as in either
                for low_, high_ in {*zip(low[near].tolist(), high[near].tolist(), strict=True)}:
                    if int(np.minimum(np.bincount(words[low_:high_], minlength=len(self.keys)), self.bags[name]).sum()) < self.need[name]:
                        near &= (low != low_) | (high != high_)
            if near.any():
                found[name] = sorted(zip(places[near].tolist(), owns[near].tolist(), strict=True))
        return found


def deciding_words(words: list[str]) -> list[int]:
    """Places of the words that tell a license from others: families and their variants, and versions; none in texts of thousands of words, which tell by themselves."""
    if len(words) > NOTICE:
        return []
    found: list[int] = []
    for i, word in enumerate(words):
        version = word.isdigit() and (len(words) <= LONG // 2 or i and (words[i - 1] in ("version", "v") or i - 1 in found and words[i - 1].isdigit()))
        if word in FAMILIES or version:
            found.append(i)
    return found


def least_words(n: int, min_coverage: float) -> int:
    """The words that a match needs of a template of n words."""
    return next(k for k in range(1, n + 2) if k >= min_coverage * n)


def band_of(template: list[int]) -> int:
    """Words that an alignment may be off its diagonal, on each side of its fingerprint; more for long templates."""
    return max(BAND, len(template) // 12)


def align(template: list[int], words: list[int]) -> list[int]:
    """Positions in words aligned to equal words of the template, in order, most of them, within the band."""
    return [at for at, _ in pairs_of(template, words, band_of(template))]


def pairs_of(template: list[int], words: list[int], band: int) -> list[tuple[int, int]]:
    """(position in words, position in the template) of the alignment.

    The diagonal runs from the word after the band; ties prefer the earlier place.
    """
    width = 2 * band + 1
    if len(template) > LONG:
        best = _table(np.array(template), np.array(words), width)
    else:
        best = [[0] * (width + 2) for _ in range(len(template) + 1)]  # best[i][k]: template[i:], words[i + k - 1:]
        for i in range(len(template) - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for k in range(width, 0, -1):
                at = i + k - 1
                equal = at < len(words) and template[i] == words[at]
                row[k] = max(below[k] + equal, row[k + 1], below[k - 1])
    found, i, k = [], 0, 1
    while i < len(template) and k <= width:
        at = i + k - 1
        if at < len(words) and template[i] == words[at] and best[i][k] == best[i + 1][k] + 1:
            found.append((at, i))
            i += 1
        elif best[i][k] == best[i + 1][k]:
            i += 1
        elif best[i][k] == best[i][k + 1]:
            k += 1
        else:
            i, k = i + 1, k - 1
    return found


def _table(template: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """``pairs_of``'s table, a row at once: what may be skipped in a row is the greatest so far from its end."""
    best = np.zeros((len(template) + 1, width + 2), np.int32)
    padded = np.concatenate([words, np.full(max(0, len(template) + width - len(words)), -1)])
    for i in range(len(template) - 1, -1, -1):
        here = np.maximum(best[i + 1, 1:-1] + (padded[i : i + width] == template[i]), best[i + 1, :-2])
        best[i, 1:-1] = np.maximum.accumulate(here[::-1])[::-1]
    return best


def aligned(template: list[int], words: list[int], place: int, own: int) -> list[tuple[int, int]]:
    """(place in words, place in the template) of an alignment that joins words[place] and template[own], near words preferred."""
    band = band_of(template)
    blank = [0] * band  # no word of a template
    right = pairs_of(template[own + 1 :], blank + words[place + 1 : place + len(template) - own + band], band)
    left = pairs_of(template[:own][::-1], blank + words[max(0, place - own - band) : place][::-1], band)
    return [*((place - 1 - at + band, own - 1 - i) for at, i in left[::-1]), (place, own), *((place + 1 + at - band, own + 1 + i) for at, i in right)]


def decided(index: Index, name: str, hits: list[tuple[int, int]], raw: Callable[[int], str], dotted: Callable[[int], bool]) -> bool:
    """Whether an alignment leaves the words that tell the license as they are: none is left out, none has another such word in its place, and none has a
    word beside it that makes another license of it.  raw gives a word of the document by its place, or nothing outside of it; dotted tells whether but a full
    stop parts it from the word before."""
    deciding, has = index.deciding[name], {own: place for place, own in hits}
    if not deciding:
        return True
    aligned_places, order = {place for place, _ in hits}, [own for _, own in hits]
    for own in deciding:
        number = index.texts[name][own].isdigit()
        if (place := has.get(own)) is None:
            at = bisect.bisect_left(order, own)
            first = hits[at - 1][0] + 1 if at else hits[0][0] - order[0]
            last = hits[at][0] if at < len(hits) else hits[-1][0] + 1 + len(index.words[name]) - 1 - order[-1]
            gap = [raw(i) for i in range(max(0, first), last)]
            again = any(index.texts[name][i] == index.texts[name][own] for i in has)  # said once more, and there it stands
            if not any(gap) and not again or any(w in FAMILIES or w.isdigit() and number for w in gap):
                return False
            continue
        if any(beside not in aligned_places and raw(beside) in MODIFIERS for beside in (place - 1, place + 1)):
            return False
        after = place + 1
        while number and dotted(after) and raw(after).isdigit() and after not in aligned_places:  # 3.0 is 3, 3.1 is not
            if raw(after).strip("0"):
                return False
            after += 1
    return True


_SPDX_LINE = re.compile(r"(?i)spdx-license-identifier:[ \t]*")
_SPDX_PART = re.compile(r"[ \t]*(?:(\(|\))|([A-Za-z0-9][A-Za-z0-9.-]*\+?))")


def spdx_expression(text: str, at: int) -> list[tuple[str, int, int]]:
    """(license, start, end) of each license of the expression that begins there; with an exception, both are one.

    Names are told whatever their case; those that are no template of ours are not listed, a license with an exception we do not know neither.
    """
    found: list[tuple[str, int, int] | None] = []
    operator = "("
    while part := _SPDX_PART.match(text, at):
        at = part.end()
        if part[1]:
            operator = operator if part[1] == "(" else ")"
            continue
        word = part[2].rstrip(".")
        if word.upper() in ("AND", "OR", "WITH") and operator in ("", ")"):
            operator = word.upper()
        elif operator == "WITH":
            name = _EXCEPTION.get(word.lower())
            found[-1] = (f"{found[-1][0]} WITH {name}", found[-1][1], part.start(2) + len(word)) if name and found[-1] else None
            operator = ""
        elif operator in ("(", "AND", "OR"):
            name, plus = _LISTED.get(word.lower().removesuffix("+")), "+" * word.endswith("+")
            found.append((name + plus, part.start(2), part.start(2) + len(word)) if name else None)
            operator = ""
        else:
            break
    return [f for f in found if f]


_LISTED, _EXCEPTION = ({name.lower(): name for name in names} for names in (SPDX, EXCEPTIONS))


def scan(text: str, index: Index) -> list[dict]:
    """The matches of one whole text."""
    get = index.vocabulary.get
    words = [get(w, 0) for w in _WORD.findall(text.lower() if text.isascii() else _ascii_lower(text))]
    seeds = index.seeds(np.array(words, np.int64))
    if not seeds:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]

    def raw(at: int) -> str:
        return _ascii_lower(text[slice(*spans[at])]) if 0 <= at < len(spans) else ""

    def dotted(at: int) -> bool:
        return 0 < at < len(spans) and text[spans[at - 1][1] : spans[at][0]] == "."

    found, seen, lines, unsure = [], {}, set(), defaultdict(set)
    for name, places in sorted(seeds.items()):
        template, need, known = index.words[name], index.need[name], set()
        band = band_of(template)
        whole, tried = len(template) > NOTICE, []  # diagonals of whole texts that were aligned
        if whole:
            votes = Counter((place - own) // band for place, own in places)
            places = sorted(places, key=lambda s: (-votes[(s[0] - s[1]) // band], s))
        for place, own in places:
            if (place, own) in known or whole and any(abs(place - own - d) <= band // 2 for d in tried):
                continue
            tried.append(place - own)
            # equal surroundings have equal alignments: repeated text costs one
            begin = place - own - band
            around = (name, own, min(0, begin), tuple(words[max(0, begin) : begin + len(template) + 2 * band])) if len(template) <= LONG else None
            if around in seen:
                hits = [(place + a, i) for a, i in seen[around]]
            else:
                hits = aligned(template, words, place, own)
                if around:
                    seen[around] = [(a - place, i) for a, i in hits]
            if len(hits) < need:
                continue
            if len(hits) == len(template) or len(template) > LONG:
                known.update(hits)
            if name.endswith("-SPDX") and (line := _SPDX_LINE.match(text, spans[hits[0][0]][0])):
                lines.add((hits[0][0], line.end()))
            elif decided(index, name, hits, raw, dotted):
                found.append((len(hits), hits[0][0], hits[-1][0], name))
                if not {own for _, own in hits}.issuperset(index.deciding[name]):
                    unsure[found[-1][:3]].add(name)
    # an unknown word where a telling one belongs may be a misspelt one, if there is one license only that it could tell
    found = [match for match in found if match[3] not in unsure[match[:3]] or len(unsure[match[:3]]) == 1]
    taken, starts, stops = [], [], []
    for match in sorted(found, key=lambda x: (-x[0], len(index.words[x[3]]), x[2] - x[1], x[1], x[3])):
        at = bisect.bisect_left(starts, match[1])  # those taken do not overlap, so the neighbours tell
        if (at == len(starts) or match[2] < starts[at]) and (at == 0 or stops[at - 1] < match[1]):
            starts.insert(at, match[1])
            stops.insert(at, match[2])
            taken.append(match)
    rows = [
        {"license": name, "coverage": n / len(index.words[name]), "matched_words": n, "template_words": len(index.words[name]), "start": spans[a][0], "end": spans[b][1]}
        for n, a, b, name in taken
    ]
    for first, end in lines:  # an expression is read as such: its licenses are named, whatever aligned with it
        for k, (name, begin, stop) in enumerate(spdx_expression(text, end)):
            n = len(_WORD.findall(name)) + 3
            rows.append({"license": f"{name}-SPDX", "coverage": 1.0, "matched_words": n, "template_words": n, "start": spans[first][0] if not k else begin, "end": stop})
    return sorted(rows, key=lambda r: (r["start"], r["end"]))


_LOWER = {c: c + 32 for c in range(65, 91)}


def _ascii_lower(text: str) -> str:
    """Lower case that keeps every character's place."""
    return text.translate(_LOWER)


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, matched_words, template_words, start, end), a row for every match."""
    small_batches(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    kind = docs.schema[id_col].dataType.simpleString()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, min_coverage)
        for batch in batches:
            matches = [scan(t or "", index) for t in batch.column(1).to_pylist()]
            rows = [i for i, own in enumerate(matches) for _ in own]
            flat = [m for own in matches for m in own]
            types = {"license": pa.string(), "coverage": pa.float64(), "matched_words": pa.int32(), "template_words": pa.int32(), "start": pa.int32(), "end": pa.int32()}
            columns = [pa.array([m[c] for m in flat], t) for c, t in types.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], ["doc_id", *types])

    return docs.select(id_col, text_col).mapInArrow(scanned, f"doc_id {kind}, {MATCH}")
