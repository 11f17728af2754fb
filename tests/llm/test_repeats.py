import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zonewatch.llm import repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def all_runs(w):
    """Every stretch tried by its definition."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            s = w[start:start + length]
            smallest = next(p for p in range(1, length + 1) if all(s[k] == s[k + p] for k in range(length - p)))
            if smallest == q and length >= max(6, 4 * q):
                found.append((start, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, plant):
    w = WORD.findall(text or "")
    n = len(w)
    if plant and n and doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = all_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts(rng):
    out = ["", None, "a", " \t\n", "x " * 6, "x " * 5, "ab cd " * 4, "ab cd " * 3 + "ab", "é \x0b è\xa0 " * 9, "A a " * 9]
    for _ in range(60):
        words = []
        while len(words) < rng.randrange(1, 220):
            unit = [rng.choice("abcdef"[:rng.randint(1, 6)]) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30]))]
            words += unit * rng.randint(1, 7) + unit[:rng.randrange(len(unit))]
        out.append(rng.choice([" ", "\n", "  "]).join(words))
    fib = ["a", "a b"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + " " + fib[-2])
    unit = [rng.choice("ab") for _ in range(40)]
    return out + [fib[-1], " ".join((unit + unit[:20] * 2) * 5), " ".join("w%d" % (i % 700) for i in range(3000))]


@pytest.mark.parametrize("plant", [False, True])
def test_against_all_stretches(spark, plant):
    rng = random.Random(2)
    rows = [(i, t, "x", 0) for i, t in enumerate(texts(rng))]
    rows += [(None, "a b " * 9, "x", 0), (3, "a b " * 9, "y", 1), (3, "a b " * 9, "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int").repartition(2)
    got = sorted(map(tuple, repeats.scan(df, plant=plant).collect()), key=str)
    assert got == sorted((expected(r[0], r[1], plant) for r in rows), key=str)


def test_details_and_other_ids(spark):
    df = spark.createDataFrame([("k", "so it goes " * 4 + "end"), (None, None)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in repeats.scan(df, detail=True).collect()}
    assert [tuple(x) for x in got["k"]["runs"]] == [(0, 12, 3)] and got["k"]["collapsed"] == "so it goes end"
    assert got[None]["runs"] == [] and got[None]["collapsed"] == "" and got[None]["n_runs"] == 0
    assert repeats.scan(df.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90))
def test_small_alphabets(w):
    ended = np.append(np.array(w, np.int64), 10 ** 6)
    assert [tuple(x) for x in repeats.runs_of(ended, len(w)).tolist()] == sorted(all_runs(w))
