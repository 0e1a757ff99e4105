import random

import pytest

from willowfold.llm import license_scan as scan

INDEX = scan.Index(scan.TEMPLATES)


def plain_common(template, words):
    """Words of the template found in order in some stretch of words, by a full table over every stretch of its length."""
    best = 0
    for at in range(max(1, len(words) - len(template) + 1)):
        part = words[at : at + len(template)]
        row = [0] * (len(part) + 1)
        for t in template:
            new = [0]
            for j, w in enumerate(part):
                new.append(row[j] + 1 if t == w else max(row[j + 1], new[j]))
            row = new
        best = max(best, row[-1])
    return best


def plain_banded(template, words, band):
    """The most words aligned in order, by a full table of which only the places within the band are used."""
    best = {}
    for i in range(len(template) + 1):
        for j in range(len(words) + 1):
            near = [best[i - 1, j], best[i, j - 1]] if i and j else [0]
            if i and j and template[i - 1] == words[j - 1] and -band <= (j - 1) - (i - 1) - band <= band:
                near.append(best[i - 1, j - 1] + 1)
            best[i, j] = max(near)
    return best[len(template), len(words)]


def test_alignment_is_as_long_as_that_of_a_full_table_within_the_band():
    rng = random.Random(2)
    for _ in range(400):
        template = [rng.randint(1, 9) for _ in range(rng.randint(5, 30))]
        words, band = list(template), scan.band_of(template)
        for _ in range(rng.randint(0, 2 * band)):
            words.pop(rng.randrange(len(words)))
            words.insert(rng.randint(0, len(words)), rng.randint(0, 9))
        part = [0] * band + words + [0] * band
        pairs = scan.pairs_of(template, part, band)
        assert all(template[i] == part[at] for at, i in pairs)
        assert [at for at, _ in pairs] == sorted({at for at, _ in pairs}) and [i for _, i in pairs] == sorted({i for _, i in pairs})
        assert len(pairs) == plain_banded(template, part, band)


def test_spans_edits_and_overlaps():
    text = "İntro. released UNDER the mit-License! tail\nThis work is licensed under the GNU General Public License, version 3. Released under a MIT License."
    got = scan.scan(text, INDEX)
    assert [(m["license"], m["coverage"], text[m["start"] : m["end"]]) for m in got][:2] == [
        ("MIT", 1.0, "released UNDER the mit-License"), ("GPL-3.0-only", 1.0, "This work is licensed under the GNU General Public License, version 3"),
    ]
    long = scan.TEMPLATES["BSD-3-Clause"].replace("binary", "compiled")
    (match,) = scan.scan("x " * 500 + long, INDEX)
    assert match["license"] == "BSD-3-Clause" and match["matched_words"] == match["template_words"] - 1
    assert scan.scan("the license under the version of a work", INDEX) == []
    assert len(scan.scan("Released under the MIT License. " * 2000, INDEX)) == 2000
    with pytest.raises(ValueError):
        scan.Index({"short": "MIT License"})


def test_documents_against_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = scan.scan_documents(docs).collect()
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = {r.doc_id for r in got}
    get = INDEX.vocabulary.get
    for d, text in rows.items():
        words = [get(w, 0) for w in scan._WORD.findall(scan._ascii_lower(text))]
        if sum(map(bool, words)) < 4 or d % 5 and d not in found:
            continue  # the plain search is slow; documents with matches are all checked
        assert (d in found) == any(plain_common(t, words) >= 0.8 * len(t) for t in INDEX.words.values() if len(t) < 15), d
    lines = ("GNU General Public License, version 3", "Licensed under CC BY-NC 4.0", "Released under the MIT License", "Licensed under the Apache License, Version 2.0")
    assert len(got) == sum(text.count(line) for text in rows.values() for line in lines)


def test_odd_rows(odd, nothing):
    assert scan.scan_documents(odd).count() == 0
    assert scan.scan_documents(nothing).count() == 0


def test_all_matches_of_edited_lines():
    text = "\u0130ntro. released UNDER the mit-License! tail\nThis work is licensed under the GNU General Public License, version 3. Released under a MIT License."
    assert [(m["license"], m["coverage"], text[m["start"] : m["end"]]) for m in scan.scan(text, INDEX)] == [
        ("MIT", 1.0, "released UNDER the mit-License"), ("GPL-3.0-only", 1.0, "This work is licensed under the GNU General Public License, version 3"), ("MIT", 0.8, "Released under a MIT License"),
    ]
    (match,) = scan.scan("x Released under the terms of the MIT License", INDEX)
    assert (match["license"], match["coverage"]) == ("MIT", 1.0)


def test_randomly_edited_notices_are_found():
    rng = random.Random(8)
    own = {name: scan.Index({name: scan.TEMPLATES[name]}) for name in INDEX.words}
    back = {i: w for w, i in INDEX.vocabulary.items()}
    short = sorted((name, words) for name, words in INDEX.words.items() if len(words) <= 60)
    for _ in range(4000):
        name, template = rng.choice(short)
        words = [(w, True) for w in template]
        spread = rng.sample(range(len(words)), rng.randint(0, len(words) - INDEX.need[name]))
        for at in spread:
            words[at] = (0, False)
        for _ in range(rng.randint(0, scan.BAND)):
            words.insert(rng.randint(1, len(words) - 1), (0, False))
        kept = sum(own for _, own in words)
        text = "zz " * 9 + " ".join(back.get(w, "zz") for w, _ in words) + " zz" * 9
        got = scan.scan(text, own[name])
        assert got and max(m["matched_words"] for m in got) >= kept, (name, text)


def test_whole_texts_truncated_ones_and_variants():
    for name in ("MIT-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "ISC-text", "Unlicense-text", "Apache-2.0-notice", "MPL-2.0-notice", "AGPL-3.0-or-later-notice", "LGPL-3.0-only-notice"):
        text = scan.TEMPLATES[name]
        got = scan.scan("Copyright 2026 A. Holder\n\n" + text + "\n\nmain", INDEX)
        assert [(m["license"], m["coverage"]) for m in got] == [(name, 1.0)]
        ends = [m.end() for m in scan._WORD.finditer(text)]
        (cut,) = scan.scan(text[: ends[int(len(ends) * 0.9)]], INDEX)
        assert cut["license"] == name and 0.8 <= cut["coverage"] < 1
        assert not [m for m in scan.scan(text[: ends[len(ends) // 2]], INDEX) if m["license"] == name]
    held = scan.TEMPLATES["BSD-3-Clause-text"].replace("the copyright holder nor", "Some Company, Inc. and others nor")
    assert [m["license"] for m in scan.scan(held, INDEX)] == ["BSD-3-Clause-text"]
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        assert [m["license"] for m in scan.scan(f"Text. Licensed under CC {kind} 4.0. End", INDEX)] == [f"CC-{kind}-4.0-line"]
    for name in ("MIT", "GPL-2.0-only", "GPL-2.0-or-later", "CC-BY-4.0", "LGPL-2.1-only"):
        assert [m["license"] for m in scan.scan(f"# SPDX-License-Identifier: {name}\n", INDEX)] == [f"{name}-SPDX"]


def test_no_license_is_named_for_anothers_word():
    name = lambda text: [m["license"] for m in scan.scan(text, INDEX)]
    for version in ("1", "4", "2.1", "3.0.1"):
        assert name(f"This work is licensed under the GNU General Public License, version {version}.") == []
    assert name("This work is licensed under the GNU Lesser General Public License, version 2.0.") == []
    assert name("Released under the License.") == [] and name("Released under the ZZZ License.") == []
    assert name("Licensed under the Apachee License, Version 2.0.") == ["Apache-2.0"]  # an unknown word may be a misspelt one, if only one license fits
    for own, other in (("MIT", "ISC"), ("MIT", "BSD"), ("ISC", "MIT")):
        line = {"MIT": "Released under the MIT License.", "ISC": "Released under the ISC License."}[own]
        assert all(own not in found for found in name(line.replace(own, other)))
    short = {n: t for n, t in scan.TEMPLATES.items() if len(INDEX.texts[n]) <= scan.NOTICE and not n.endswith("-SPDX")}
    back = {tuple(words): n for n, words in INDEX.texts.items()}
    swaps = sorted({INDEX.texts[n][i] for n in short for i in INDEX.deciding[n]})
    rng = random.Random(6)
    for n in short:
        words = INDEX.texts[n]
        for i in INDEX.deciding[n]:
            for other in rng.sample(swaps, 6):
                if other == words[i] or other.isdigit() != words[i].isdigit():
                    continue
                changed = [*words[:i], other, *words[i + 1 :]]
                if words.count(words[i]) == 1 and tuple(changed) not in back:
                    assert n not in name(" ".join(changed)), (n, words[i], other)


def test_spdx_expressions():
    def found(text):
        return [(m["license"], text[m["start"] : m["end"]]) for m in scan.scan(text, INDEX)]

    assert found("SPDX-License-Identifier: LGPL-2.0-only") == []
    assert [n for n, _ in found("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0")] == ["GPL-2.0-only WITH Classpath-exception-2.0-SPDX"]
    assert found("SPDX-License-Identifier: GPL-2.0-only WITH No-such-exception") == []
    text = "# SPDX-License-Identifier: (mit OR Apache-2.0) AND GPL-3.0-only+\nx"
    assert found(text) == [("MIT-SPDX", "SPDX-License-Identifier: (mit"), ("Apache-2.0-SPDX", "Apache-2.0"), ("GPL-3.0-only+-SPDX", "GPL-3.0-only+")]
    assert [n for n, _ in found("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC")] == ["MIT-SPDX", "ISC-SPDX"]
    for name in scan.SPDX:
        assert [n for n, _ in found(f"/* SPDX-License-Identifier: {name} */")] == [f"{name}-SPDX"]


def test_whole_published_texts():
    import time

    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"):
        text = scan.TEMPLATES[f"{name}-text"]
        began = time.process_time()
        first = scan.scan("Intro\n" + text, INDEX)[0]
        assert (first["license"], first["coverage"]) == (f"{name}-text", 1.0) and time.process_time() - began < 10
        ends = [m.end() for m in scan._WORD.finditer(text)]
        cut = scan.scan(text[: ends[int(len(ends) * 0.85)]], INDEX)
        assert [m["license"] for m in cut if m["coverage"] > 0.8][:1] == [f"{name}-text"]


def test_repeats_cost_little():
    import time

    text = "Released under the MPL License. This is MIT License of the GNU General Public, version 9 or so. " * 3400
    began = time.process_time()
    scan.scan(text, INDEX)
    assert time.process_time() - began < 4
