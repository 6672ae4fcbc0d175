import random
import re
import textwrap

import pytest

from flowlens.llm import licenses as L


def brute(texts, dice, templates):
    out = []
    for i, t in texts:
        t = t or ""
        units = [("line", k, x) for k, x in enumerate(t.split("\n"))]
        blocks = re.split("\n[ \t\r]*\n", t)
        units += [("block", k, x) for k, x in enumerate(blocks)] if len(blocks) > 1 else []
        units += [("document", 0, t)] if "\n" in t else []
        for kind, k, body in units:
            a = set(L.bigrams_of(body))
            for number, name, b in L.template_rows(templates):
                d = 2 * len(a & set(b)) / (len(a) + len(b))
                if d >= dice:
                    out.append((i, kind, k, number, name, round(d, 9)))
        words = re.sub("[^a-z0-9]+", " ", t.lower()).split()
        for number, (name, body) in enumerate(L.TEMPLATES if templates is None else templates):
            b = set(L.bigrams_of(body))
            wide, best = len(re.findall("[a-z0-9]+", body.lower())), (0, 0)
            for at in range(len(words) - 1):
                if b and f"{words[at]} {words[at + 1]}" in b:
                    a = set(zip(words[at:at + wide], words[at + 1:at + wide]))
                    d = 2 * len({f"{x} {y}" for x, y in a} & b) / (len(a) + len(b))
                    best = max(best, (d, -at))
            if best[0] >= dice:
                out.append((i, "window", -best[1], number, name, round(best[0], 9)))
    return sorted(out, key=str)


TEXTS = [None, "", "  \n\n ", "Released under the MIT License.", "RELEASED under -- the mit license!!", "Released under MIT license",
         "text\nLicensed under the Apache License, Version 2.0.\nmore text here", "x " * 5000 + "\nReleased under the MIT License.",
         L.TEMPLATES[13][1], L.TEMPLATES[13][1].replace(", ", ",\n"), "intro\n\n" + L.TEMPLATES[5][1].replace(" the ", "\nthe ") + "\n \t\nend",
         "a a a a a a", "Licensed under CC BY 4.0.", "é Released under the MIT License. é", "the the the MIT MIT license license"]


@pytest.mark.parametrize("dice", [0.5, 0.75, 1.0])
def test_equals_brute_force(make, dice):
    got = sorted(((r["doc_id"], r["unit"], r["unit_no"], r["template"], r["license"], round(r["dice"], 9))
                  for r in L.scan(make(TEXTS), dice).collect()), key=str)
    assert got == brute(list(enumerate(TEXTS)), dice, None)


def test_repeated_rows_empty_tables_and_templates(make):
    twice = L.scan(make(["Released under the MIT License."] * 2, ids=[None, None])).collect()
    assert [(r["doc_id"], r["license"]) for r in twice] == [(None, "MIT")] * 4  # line and window each
    assert L.scan(make([])).collect() == []
    assert L.scan(make(["one two"]), templates=[("X", "word")]).collect() == []
    assert len(L.scan(make(["one two three"]), templates=[("X", "One two, three"), ("Y", "one-two-three")])
               .where("unit = 'line'").collect()) == 2


def commented(text: str, mark: str, wide: int = 60) -> str:
    return "\n".join(f"{mark} {x}".rstrip() for x in textwrap.wrap(text, wide))


def test_notices_of_source_files_are_found(make):
    """A header between comment lines, a notice that is wrapped and followed by code, one
    within a long line, whole licences in comments; code alone gives none."""
    whole = {k: t for k, (_, t) in enumerate(L.TEMPLATES)}
    code = "\nimport os\nprint(os.environ)  # released program\n" * 40
    paragraphs = whole[20].replace(" This program is dist", "\n\nThis program is dist").replace(" You should", "\n\nYou should")
    texts = ["/*\n * tool.c\n * Copyright 2020 A. Person\n *\n"
             + "\n *\n".join(commented(x, " *") for x in paragraphs.split("\n\n")) + "\n */\n" + code,
             code + "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n" + code,
             "word " * 300 + "This project is licensed under the terms of the MIT license. " + "more " * 300,
             "# Copyright (c) 2019 Someone\n" + commented(whole[15], "#") + code,
             commented(whole[18], "//") + code, commented(whole[19], ";;") + code, code]
    found = {}
    for r in L.scan(make(texts)).where("unit = 'window'").collect():
        found.setdefault(r["doc_id"], {})[r["template"]] = r["dice"]
    assert found[0][20] == 1.0 and found[0][5] == 1.0
    assert found[1] == {14: 1.0} and found[2] == {1: 1.0}
    assert found[3][15] == 1.0 and found[4][18] == 1.0 and found[5][19] == 1.0
    assert 6 not in found


def test_random_texts_equal_brute_force(make):
    rng = random.Random(4)
    templates = [("A", "one two three four"), ("B", "two three two three one"), ("C", "four " * 3 + "one")]
    texts = [" ".join(rng.choice(["one", "two", "three", "four", "x\n", "\n\ny"]) for _ in range(rng.randint(0, 30)))
             for _ in range(150)]
    got = sorted(((r["doc_id"], r["unit"], r["unit_no"], r["template"], r["license"], round(r["dice"], 9))
                  for r in L.scan(make(texts), 0.75, templates).collect()), key=str)
    assert got == brute(list(enumerate(texts)), 0.75, templates) and any(r[1] == "window" for r in got)


def test_plan_is_native_and_without_shuffle(make):
    plan = L.scan(make(TEXTS, parts=1).sortWithinPartitions("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join|Cartesian", plan)


def test_size_bounds_hold():
    for n in range(1, 40):
        for m in range(1, 120):
            best = 2 * min(n, m) / (n + m)
            lo, hi = L.size_bounds(n, 0.75)
            assert (best >= 0.75) <= (lo - 1e-9 <= m <= hi + 1e-9)


@pytest.mark.parametrize("dice", [0.3, 0.75, 1.0])
def test_every_match_holds_a_telling_word(dice):
    rng = random.Random(8)
    for _, _, b in L.template_rows():
        words = set(L.telling_words(b, dice))
        for _ in range(200):  # parts of the template and other bigrams
            some = set(rng.sample(b, rng.randint(0, len(b))))
            size = len(some) + rng.randint(0, 3)
            if 2 * len(some) / (size + len(b)) >= dice:
                assert any(words & set(x.split(" ")) for x in some)
