"""Digest lookup of whole texts against a plain normaliser that tries every run of lines."""

import random
import re
import textwrap

import pytest

from palaver.llm import licenses


def plain(text):
    """Lines as lists of words, token by token."""
    out = []
    for line in re.split(r"\r\n|\r|\n", text.lower()):
        if re.match(r"[ \t]*(copyright[ \t]*(\(c\)|©|\d|:|by\b|the\b)|\(c\)|©)", line):
            line = ""
        words = re.findall(r"[^\W_]+", line)
        out.append([dict(licenses.SPELLINGS).get(w, w) for w in words])
    return out


KNOWN = {}
for _name, _text in licenses.KNOWN:
    _key = tuple(w for line in plain(_text) for w in line)
    KNOWN[_key] = min(_name, KNOWN.get(_key, _name))
LONGEST = max(map(len, KNOWN))


def by_force(rows):
    want = []
    for i, text in rows:
        if text is None:
            continue
        lines = plain(text)
        whole = tuple(w for line in lines for w in line)
        if whole in KNOWN:
            want.append((i, -1, len(lines), KNOWN[whole]))
        for a in range(len(lines)):
            run = []
            for b in range(a, len(lines)):
                run += lines[b]
                if not lines[a] or len(run) > LONGEST:
                    break
                if lines[b] and tuple(run) in KNOWN:
                    want.append((i, a, b - a + 1, KNOWN[tuple(run)]))
    return sorted(want)


FULL = {name: text for name, text in licenses.KNOWN}
TEXTS = ["Released under the MIT License.", "RELEASED  under\tthe “MIT” licence!!", "Copyright 2020 A. B.\nReleased under the MIT License.\n", "Released under the\nMIT License.",
         "x\nLicensed under CC BY-NC 4.0.\ny\r\nlicensed under cc by nc 4 0\rz", "Not released under the MIT License.", "", None, "©", "Licensed under the Apache License, Version 2.0.\n" * 3,
         "w " * 100_000 + "\nThis work is licensed under the GNU General Public Licence, version 3.", "Licensed under\n\n\nthe MIT\nLicense. And more", "a\n" * 3000 + "Released\nunder\nthe\nMIT\nlicence"]


def scanned(spark, rows):
    df = spark.createDataFrame([(*r, "c", 0) for r in rows], "doc_id long, text string, license string, part int")
    return sorted(tuple(r) for r in licenses.scan(df, licenses.known_digests(spark)).collect())


def test_scan(spark):
    rows = [*enumerate(TEXTS), (0, TEXTS[0])]
    got = scanned(spark, rows)
    assert got == by_force(rows)
    assert {(0, -1, 1, "MIT"), (1, -1, 1, "MIT"), (2, -1, 3, "MIT"), (3, 0, 2, "MIT"), (4, 1, 1, "CC-BY-NC-4.0"), (4, 3, 1, "CC-BY-NC-4.0"), (10, 1, 1, "GPL-3.0"), (12, 3000, 5, "MIT")} <= set(got)
    assert not {5, 6, 7, 8, 11} & {g[0] for g in got} and scanned(spark, []) == []


@pytest.mark.parametrize("width", [30, 72, 500])
def test_whole_licences_wrapped_and_embedded(spark, width):
    rng = random.Random(width)
    rows, want = [], []
    for k, (name, text) in enumerate(licenses.KNOWN):
        body = "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))
        head = f"Some file\nMIT License\n\nCopyright (c) 20{width} Some One\n\n"
        rows += [(k, head + body + "\n\nint main"), (k + 100, body.replace("the", "teh", 1) if "the" in body else body + "x"), (k + 200, body.upper())]
        want += [(k, name), (k + 200, name)]
    rng.shuffle(rows)
    got = scanned(spark, rows)
    assert got == by_force(rows)
    assert set(want) <= {(g[0], g[3]) for g in got}
    assert {g[3] for g in got if 100 <= g[0] < 200} <= {"ISC"}  # the first paragraph alone is known too


def test_spellings_side_by_side(spark):
    words = [old for old, _ in licenses.SPELLINGS]
    twice = " ".join(w for w in words for _ in range(2)) + " licence licence licence"
    new = dict(licenses.SPELLINGS)
    known = licenses.known_digests(spark, [("x", " ".join(new[w] for w in twice.split()))])
    df = spark.createDataFrame([(1, twice), (2, twice.replace(" ", ", ")), (3, twice + " more")], "doc_id long, text string")
    assert {r["id"] for r in licenses.scan(df, known).collect()} == {1, 2}
    assert licenses.scan(df, known.filter("false")).collect() == []


def test_large_known_table_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(licenses.checked_broadcast, "__defaults__", (3, None))
    df = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    assert sorted(r["part"] for r in licenses.scan(df, licenses.known_digests(spark)).collect()) == [-1, 0]
