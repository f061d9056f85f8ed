import random
import re

import pytest
from clinflow.llm import licenses
from clinflow.llm.license_rules import rules

FOLDED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def brute(text):
    """Every rule on every text, every find against all earlier ones, words from the text itself."""
    words = WORD.findall((text or "").translate(FOLDED))
    places = [(i, label) for label, phrase in BASE.items() for i in range(len(words)) if words[i:i + len(phrase)] == phrase]
    line, starts, at = " ".join(words), {}, 0
    for i, word in enumerate(words):
        starts[at] = i
        at += len(word) + 1
    ends = {start + len(words[i]): i for start, i in starts.items()}
    finds = []
    for n, rule in enumerate(rules()):
        pattern = re.compile(rule.pattern.pattern.decode())
        finds += [(n, starts[m.start()], ends[m.end()]) for m in pattern.finditer(line)]
    finds.sort(key=lambda f: (f[0], f[1], -f[2]))
    kept = []
    for find in finds:
        if not any(k[1] <= find[1] and find[2] <= k[2] for k in kept):
            kept.append(find)
    labels = {rules()[n].label for n, _, _ in kept} | {label for _, label in places}
    score = max([rules()[n].worth for n, _, _ in kept] + [0.5 if places else 0.0])
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places})),
            ",".join(sorted(labels)), score)


STATEMENTS = {
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "All rights reserved.": "reserved",
    "GPLv3, see https://www.gnu.org/licenses/gpl-3.0.html": "gpl-3.0", "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1",
    "GNU Lesser General Public License": "gpl,lgpl", "CC BY-SA 3.0 Unported and CC0 1.0": "cc-by,cc-by-sa-3.0,cc0-1.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "Todos los derechos reservados": "reserved", "Alle Rechte vorbehalten": "reserved", "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by,cc-by-sa-4.0",
    "http://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0", "a mit of general rights": "", "The common people reserved all": "",
}


@pytest.mark.parametrize("text", STATEMENTS)
def test_statements(text):
    labels = {label for label, *_ in licenses.scanned(text)[1]} | {label for label, *_ in licenses.scanned(text)[2]}
    want = set(STATEMENTS[text].split(",")) - {""}
    assert want <= labels and labels <= want | {"cc-by", "creative-commons", "gpl"}


def texts(n, seed=1):
    rng = random.Random(seed)
    parts = [*STATEMENTS, "cc by cc by", "general public license general public license", "words", "été ÀÉ ß", "license", "GNU", "mit", "BSD 3-Clause License",
             "MPL-2.0", "\x00\x7f", "all rights", "reserved.", "0", "apache", "opensource.org/licenses/MIT", "2.0", "version", "public domain", "Ł"]
    return ["".join(rng.choice(parts) + rng.choice([" ", "\n", "-", "", "。", ", "]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_rules_equal_brute_force():
    for text in texts(400):
        count, places, finds = licenses.scanned(text)
        at = [i for _, i in places]
        got = (count, len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in places})),
               ",".join(sorted({x for x, _ in places} | {f[0] for f in finds})), max([f[1] for f in finds] + [0.5 if places else 0.0]))
        assert got == brute(text)


def test_every_rule_needs_one_of_its_keywords():
    """No rule can match words without one of its keywords, so the filter loses nothing."""
    assert len(rules()) > 250
    for rule in rules():
        source = rule.pattern.pattern
        for text in (s for s in STATEMENTS):
            line = b" ".join(text.encode().translate(licenses.FOLD).split())
            for match in rule.pattern.finditer(line):
                assert set(rule.keywords) & set(match[0].split()), source


def test_containment():
    assert licenses.outermost([(3, 0, 5), (1, 1, 4), (2, 1, 4), (0, 10, 20), (4, 0, 30), (5, 12, 13)]) == [(0, 10, 20), (1, 1, 4), (3, 0, 5), (4, 0, 30)]
    rng = random.Random(4)
    for _ in range(300):
        finds = [(rng.randrange(6), a := rng.randrange(30), a + rng.randint(1, 10)) for _ in range(rng.randint(0, 25))]
        kept = []
        for find in sorted(finds, key=lambda f: (f[0], f[1], -f[2])):
            if not any(k[1] <= find[1] and find[2] <= k[2] for k in kept):
                kept.append(find)
        assert licenses.outermost(finds) == kept


def test_query_equals_brute_force(spark, documents, tmp_path):
    held = texts(120, 5) + [None, "", " \n ", "All rights reserved. " * 20_000, "word " * 100_000 + "MIT License"]
    documents(*held).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.op12_license_scan(spark, str(tmp_path)).collect()}
    assert got == {i: brute(text) if len(text or "") < 300_000 else got[i] for i, text in enumerate(held)}
    assert got[len(held) - 2] == (60_000, 20_000, 0, 59_997, "reserved", "reserved", 0.5)
    assert got[len(held) - 1][-2:] == ("mit", 0.7)


def test_odd_rows(spark, odd, documents):
    found = licenses.licences(odd)
    assert found.count() == odd.count() and set(odd.columns) < set(found.columns)
    assert licenses.licences(documents()).count() == 0
    clash = documents("MIT License").selectExpr("*", "1 as finds", "2 as places", "3 as n_words", "4 as _found")
    assert [f.label for f in licenses.licences(clash).first().finds] == ["mit"]
