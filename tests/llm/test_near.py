import random
import re

import numpy as np
import pyarrow as pa

from zonewatch.llm.components import connected
from zonewatch.llm.hashing import row_sets, row_words, shingle_hashes
from zonewatch.llm.near import near_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, lang string"


def brute(rows):
    """Sizes and components by comparing every pair."""
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(vocab, k=30))
    rows = []
    for g in range(12):
        base = rng.choices(vocab, k=rng.randint(20, 200))
        for _ in range(rng.randint(1, 8)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append(" ".join(t))
    rows += [line + " " + " ".join(rng.choices(vocab, k=40)) for _ in range(30)]
    hot = rng.choices(vocab, k=120)
    for _ in range(60):  # a large near-copy group
        t = list(hot)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = f"x{rng.random()}"
        rows.append(" ".join(t))
    rows += [" ".join(hot), "", "  \n", None, None, "one", "ONE", "one two three four", "one two\tthree  four", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)] + [(3, rows[1]), (None, rows[5]), (None, "only null id here")]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, None, "en") for d, t in rows], DOCS)
    for cells in (1 << 8, 1 << 14):  # the order of tokens never changes the result
        got = sorted((tuple(r) for r in near_components(df, order_cells=cells).collect()), key=str)
        assert got == brute(rows)


def test_empty_table(spark):
    assert near_components(spark.createDataFrame([], DOCS)).collect() == []


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 8), (7, 9), (5, 5)] + [(i, i + 1) for i in range(100, 160)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{i: 100 for i in range(100, 161)}}


def test_hashes_follow_words():
    texts = ["The cat  sat\non THE mat", None, "", "the cat sat on the mat", "é b", "x" * 5000, " the", "the "]
    rows = [h.tolist() for _, h in row_words(pa.array(texts))]
    assert rows[0] == rows[3] and rows[1] == rows[2] == [] and rows[0][0] == rows[0][4] == rows[6][0] == rows[7][0]
    assert len(rows[5]) == 1 and len(rows[4]) == 2
    assert [len(s) for _, s in row_sets(pa.array(texts))] == [2, 0, 0, 2, 1, 1, 1, 1]
    assert shingle_hashes(np.array([1, 2], np.uint64))[0] != shingle_hashes(np.array([2, 1], np.uint64))[0]


def test_hashes_do_not_depend_on_batches():
    texts = ["a bc def ghij k " * (i % 7) + f"t{i}" for i in range(300)]
    whole = [h.tolist() for _, h in row_words(pa.array(texts))]
    assert whole == [h.tolist() for t in texts for _, h in row_words(pa.array([t]))]
    assert whole[10:] == [h.tolist() for _, h in row_words(pa.array(texts)[10:])]
