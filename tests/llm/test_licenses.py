import random

import numpy as np
import pytest

from chronofact.llm import licenses, shingles


def brute(text, templates, least):
    """Templates of which some run of words contains enough shingles, trying every run of up to twice the length."""
    words = licenses.plain_bytes(text or "").split()
    found = set()
    for name, template in templates.items():
        wanted = licenses.plain_bytes(template).split()
        grams = {tuple(wanted[i:i + 3]) for i in range(len(wanted) - 2)}
        for start in range(len(words)):
            part = words[start:start + len(wanted)]
            if len({tuple(part[i:i + 3]) for i in range(len(part) - 2)} & grams) >= least * len(grams):
                found.add(name)
                break
    return found


def test_equals_brute_force_on_planted_notices():
    rng = random.Random(3)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    filler = [f"w{i}" for i in range(400)] + "the license of this software is under permission copy".split()
    for _ in range(150):
        text = " ".join(rng.choices(filler, k=rng.randint(0, 300)))
        planted = rng.sample(sorted(licenses.TEMPLATES), rng.randint(0, 2))
        for name in planted:
            words = licenses.TEMPLATES[name].split()
            if rng.random() < 0.4 and len(words) > 20:
                words[rng.randrange(len(words))] = "changed"
            text += " " + " ".join(words).upper() + "; " + " ".join(rng.choices(filler, k=rng.randint(0, 200)))
        got = {h[0] for h in scanner.scan(text)}
        want = brute(text, licenses.TEMPLATES, licenses.CONTAINMENT)
        assert got <= want
        # of templates that overlap in the text only the best is given
        assert got >= {n for n in planted if n in want and not any(p != n and family(p) == family(n) for p in want)}


def family(name):
    return name.split("-")[0].removeprefix("L").removeprefix("A") if name.split("-")[0].endswith("GPL") else name.split("-")[0]


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_the_most_complete_of_a_family_is_given(name):
    text = "Some words before. " + licenses.TEMPLATES[name] + " And some after it."
    assert [h[0] for h in licenses.Scanner(licenses.TEMPLATES).scan(text)] == [name]


def test_spans_are_exact():
    text = "é— " * 50 + "Released under the MIT License. And " + licenses.TEMPLATES["Apache-2.0-notice"] + " end"
    hits = licenses.Scanner(licenses.TEMPLATES).scan(text)
    assert [h[0] for h in hits] == ["MIT", "Apache-2.0-notice"]
    assert text[hits[0][1]:hits[0][2]] == "Released under the MIT License"
    assert text[hits[1][1]:hits[1][2]] == licenses.TEMPLATES["Apache-2.0-notice"]


def test_bands_meet_their_promise():
    rng = np.random.default_rng(0)
    for similarity in (0.4, 0.7):
        bands = licenses.bands_for(similarity)
        assert 1 - (1 - similarity**licenses.ROWS)**bands >= licenses.COLLISION
        met = 0
        for _ in range(150):
            pool = rng.integers(0, 1 << 63, 200, np.uint64)
            both = int(200 * similarity)
            a, b = pool[:both + (200 - both) // 2], np.concatenate([pool[:both], pool[both + (200 - both) // 2:]])
            f = shingles.hash_functions(bands * licenses.ROWS, 5)
            met += bool(set(enumerate(licenses.Scanner._keys(a, f))) & set(enumerate(licenses.Scanner._keys(b, f))))
        assert met >= 149


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "x" * 100_000), (None, "released under the mit license"), (5, "Released under the MIT License. " * 3),
            (5, "Released under the MIT License. " * 3)]
    got = sorted(((r["doc_id"] or 0, r["license"]) for r in licenses.find_licenses(
        spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, license int")).collect()))
    assert got == [(0, "MIT")] + [(5, "MIT")] * 6
    assert licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        licenses.Scanner({"short": "two words"})
