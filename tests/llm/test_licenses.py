import random

import pytest

from vectorloom.llm import licenses as L


def scan(spark, docs, **options):
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string").repartition(2)
    return sorted((r.doc_id if r.doc_id is not None else -1, r.license, r.first_word, r.last_word, round(r.containment, 2)) for r in L.license_scan(df, **options).collect())


def test_places(spark):
    mit = next(t for n, t in L.TEMPLATES if n == "MIT" and len(t) > 100)
    docs = [(1, "foo bar\nReleased under the MIT License.\nbaz"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "This work is licensed under the GNU General Public License, version 2."), (4, "nothing licensed here"), (5, "x " * 500 + mit.upper() + " y" * 500), (6, "ALL RIGHTS RESERVED"), (7, "a Licensed under CC BY-NC 4.0. b Licensed under CC BY 4.0. c Released under the MIT License. d")]
    got = scan(spark, docs)
    words = len(mit.split())
    assert got == [(1, "MIT", 2, 6, 1.0), (2, "GPL-3.0", 0, 11, 1.0), (3, "GPL-2.0", 0, 11, 1.0), (5, "MIT", 500, 499 + words, 1.0), (6, "all-rights-reserved", 0, 2, 1.0), (7, "CC-BY-4.0", 7, 11, 1.0), (7, "CC-BY-NC-4.0", 1, 5, 1.0), (7, "MIT", 13, 17, 1.0)]


def brute(scanner, text):
    """Every template held against every window of the text, without grid or bands; the same choice among what overlaps."""
    flat, _ = L.word_hashes([text], L.DROP)
    found = set()
    for t, words in enumerate(scanner.words):
        size = scanner.window(len(words))
        near = set(words.tolist())
        for first in [k for k in range(max(1, len(flat) - 1)) if len(flat) > 1 and int(flat[k]) in near]:
            found |= {(t, first + got[0], first + got[1], *got[2:]) for got in scanner.verify(t, flat[first : first + 3 * size // 4 + 1])}
    out = []
    for f in sorted(found, key=lambda f: (-f[4], -f[3], -len(scanner.words[f[0]]), f[1], f[2], f[0])):
        if all(f[2] < g[1] or f[1] > g[2] for g in out):
            out.append(f)
    return sorted((scanner.names[f[0]], f[1], f[2], f[3]) for f in out)


def test_against_whole_texts_in_any_company():
    """Statements, cut and changed, between other words: as brute force finds them, whatever stands beside the document."""
    rng = random.Random(21)
    scanner = L.Scanner(L.TEMPLATES, 0.85, 0.9999, 17)
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(L.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "changed"
            words += ["".join(rng.choices("qxz", k=6)) for _ in range(rng.choice([0, 1, 5, 90, 200]))] + own[: rng.choice([len(own), len(own), len(own) - 1])]
        texts.append(" ".join(words))
    texts += ["", "one", None]
    want = [brute(scanner, t) for t in texts]
    assert sum(map(len, want)) > 60
    for _ in range(4):
        order = rng.sample(range(len(texts)), len(texts))
        got = [[] for _ in texts]
        for doc, template, first, last, share in scanner.find([texts[i] for i in order]):
            got[order[doc]].append((scanner.names[template], first, last, share))
        assert [sorted(g) for g in got] == want


def test_planted_statements(spark):
    """Every template, with a word changed in the long ones, at random places of random text."""
    rng = random.Random(11)
    docs = []
    for i in range(150):
        name, text = rng.choice(L.TEMPLATES)
        words = text.split()
        if len(words) > 25:
            words[rng.randrange(2, len(words) - 2)] = "changed"
        noise = ["".join(rng.choices("abcdef", k=5)) for _ in range(rng.randint(0, 300))]
        at = rng.randint(0, len(noise))
        docs.append((i, " ".join([*noise[:at], *words, *noise[at:]]), name, at))
    got = {(g[0], g[1], g[2]) for g in scan(spark, [d[:2] for d in docs])}
    assert got == {(i, name, at) for i, _, name, at in docs}


def test_edges(spark):
    assert scan(spark, [(1, None), (2, ""), (3, " \n"), (4, "MIT")]) == []
    got = scan(spark, [(None, "All rights reserved."), (5, "w " * 300_000 + "all rights reserved")])
    assert [(g[0], g[1]) for g in got] == [(-1, "all-rights-reserved"), (5, "all-rights-reserved")]
    assert scan(spark, [(1, "All rights reserved.")], templates=[]) == []
    assert scan(spark, [(1, "some proprietary work text")], templates=[("p", "proprietary work")]) == [(1, "p", 1, 2, 1.0)]
    for short in ("proprietary", ""):
        with pytest.raises(ValueError):
            scan(spark, [(1, "x")], templates=[("p", short)])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.license_scan(df).count() == 0


def test_bands_follow_from_the_guarantee():
    b = L.plan_bands(0.3, 1, 0.9999)
    assert (1 - 0.3) ** b <= 1e-4 < (1 - 0.3) ** (b - 1)


def test_statements_side_by_side():
    """Statements that follow one another, alike or the same, at every offset from the windows' grid."""
    scanner = L.Scanner(L.TEMPLATES, 0.85, 0.9999, 17)
    short = {n: t for n, t in L.TEMPLATES if 4 <= len(t.split()) <= 6 and t.startswith("Licensed")}
    for one in short:
        for two in short:
            for shift in range(9):
                noise = [f"n{k}" for k in range(shift)]
                a, b = short[one].split(), short[two].split()
                got = scanner.find([" ".join([*noise, *a, *b, "end"])])
                ends = shift + len(a)
                assert sorted((scanner.names[g[1]], g[2], g[3]) for g in got) == sorted([(one, shift, ends - 1), (two, ends, ends + len(b) - 1)])
    mit = next(t for n, t in L.TEMPLATES if n == "MIT" and len(t) > 100)
    size = len(mit.split())
    assert sorted((g[2], g[3]) for g in scanner.find([" ".join([mit] * 3)])) == [(k * size, (k + 1) * size - 1) for k in range(3)]
