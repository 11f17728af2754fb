import hashlib
import random
import re

import numpy as np
import pytest

from zonewatch.llm import chat, mixing, sharding

TURNS = "conv_id long, turn long, role string, text string, source string"


def _expected(rows):
    out = {}
    for c, *_ in rows:
        out[c] = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c])
    return {c: (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in t).encode()).hexdigest(),
                sum(len(x) for _, _, r, x in t if r == "assistant"),
                hashlib.sha256("".join(x for _, _, r, x in t if r == "assistant").encode()).hexdigest()) for c, t in out.items()}


def test_chat_reads_back(spark):
    rng = random.Random(3)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "\\", "<\\|", "<", "|", "\n", "é😀", "word ", "<\\\\|x", "\\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(bits, k=rng.randint(0, 60))), None)
            for c in range(8) for t in range(rng.randint(1, 40))]
    rows += [(50, 0, "system", "s " * 40, None)] + [(50, t, ["user", "assistant"][t % 2], "word " * rng.randint(0, 700), None) for t in range(1, 80)]
    rows += [(51, None, None, None, None), (51, 1, "odd\\role\\\\n\n<|x", "a", None), (None, 0, "assistant", "b", "x"), (51, 1, "user", "a", None), (51, 1, "user", "a", None)]
    win = chat.windows(spark.createDataFrame(rows, TURNS))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(win).collect()}
    assert got == _expected(rows)


def test_windows_keep_the_budget_and_the_system_turn(spark):
    rows = [(1, 0, "system", "be good", None)] + [(1, t, ["user", "assistant"][t % 2], f"t{t} " * (t % 50 + 1), None) for t in range(1, 200)]
    win = chat.windows(spark.createDataFrame(rows, TURNS), budget=300, history=80).orderBy("window").collect()
    count = lambda s: len(re.findall(r"[^\W\d_]{1,6}|\d{1,3}|[^\w\s]|_", s))
    assert len(win) > 10
    for w in win:
        assert w["text"].startswith("<|im_start|>system\nbe good<|im_end|>\n") and count(w["text"]) <= 300
    assert sum(w["n_repeated"] > 1 for w in win) > 5
    learned = [w["text"][x["start"]:x["start"] + x["length"]] for w in win for x in w["loss"]]
    assert learned == [r[3] for r in rows if r[2] == "assistant"]


@pytest.mark.parametrize("turns", [[100] * 299, [2, 1900, 30, 1600, 2000, 40, 1540] * 8, [1990] * 9, [3, 600, 700, 800] * 20, [2400, 5, 2100]])
def test_windows_never_go_over_budget(spark, turns):
    """turns: tokens each (a turn takes six for its template). Longer ones than the budget stand alone."""
    rows = [(1, t, "user", "a " * (n - 6), None) for t, n in enumerate(turns)]
    win = chat.windows(spark.createDataFrame(rows, TURNS)).orderBy("window").collect()
    count = lambda s: len(re.findall(r"[^\W\d_]{1,6}|\d{1,3}|[^\w\s]|_", s))
    sizes = [[count(p) + 4 for p in w["text"].split("<|im_end|>\n")[:-1]] for w in win]
    assert all(count(w["text"]) <= chat.BUDGET or len(s) == 1 for w, s in zip(win, sizes))
    tokens = sum(count(f"<|im_start|>user\n{r[3]}<|im_end|>\n") for r in rows)
    alone = sum(n > chat.HISTORY for n in turns)
    assert len(win) <= 1.1 * (tokens / (chat.BUDGET - chat.HISTORY)) + alone + 1
    assert sum(len(s) for s in sizes) - sum(w["n_repeated"] for w in win) == len(turns)


def test_no_turns(spark):
    assert chat.read_back(chat.windows(spark.createDataFrame([], TURNS))).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 1000, 12345])
def test_permutation(n):
    place = sharding.place_of(np.arange(n), n)
    assert sorted(place) == list(range(n))
    assert (sharding.row_at(place, n) == np.arange(n)).all()


def test_shards(spark):
    rows = [(i, "t" * (i % 5), None) for i in range(500)] + [(7, "x", "s")] * 40 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, shard_size string")
    got = sharding.feistel_shards(df, shards=16)
    assert got.columns == ["doc_id", "text", "shard_size", "shard", "slot"]
    got = got.collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == sorted(rows, key=str)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.feistel_shards(df.repartition(7), shards=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.feistel_shards(df.limit(0)).collect() == []


def _fill(sizes, weights, cap=3):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            target.update({s: left * weights[s] / total for s in free})
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_mix_targets(spark):
    rng = random.Random(5)
    for k in (1, 2, 7, 20):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 300, 20000]) for i in range(k)}
        names = sorted(sizes) + [None]
        sizes[None] = 11
        weights = {s: 1 + i % 3 for i, s in enumerate(names)}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = _fill(sizes, weights)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_mix_comes_near_the_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 40), f"s{int(rng.random() ** 3 * 6)}", i % 9) for i in range(6000)]
    rows += [(-1, None, None, 0), (-2, "", None, 0), (-3, "a b c", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size long")
    made = mixing.copies(df).select("doc_id", "source", "mix_.*").collect()
    taken, target = {}, {}
    for r in made:
        assert r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert [r["size"] for r in made if r["doc_id"] == -3] == [2]  # no-break space is part of a word
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] + 60 for s in target)
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in made)
    assert mixing.mix(df.limit(0)).count() == 0
