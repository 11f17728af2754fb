import glob
import os
import random

import pytest

import corpus_pipeline
from oracle import connect, norm
from test_near import brute
from zonewatch.llm import queries

SF = os.environ.get("ZONEWATCH_SF", "/root/testdata/sf0.001")
OWN = [q for q in queries.ORACLE if q.startswith("op")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with planted cases, as tables."""
    rng = random.Random(11)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(2500)]
    bad = ["idiot", "moron", "scum", "clown"]
    say = lambda n: rng.choices(words, k=n)
    items = [(i, " ".join(say(25))) for i in range(10)]
    docs, labels = [], []
    for i in range(700):
        t = say(rng.randint(30, 120))
        if i % 7 == 0:
            for _ in range(5):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        docs.append((i, " ".join(t), "en", f"s{i % 4}" if i % 11 else None, len(" ".join(t))))
        labels.append((i, 1, int(i % 7 == 0)))
    copies = {}
    for i in range(1, 60, 2):
        if i % 7:
            t = docs[i][1].split() * 2
            for k in range(rng.randint(1, 4)):
                base = list(t)
                base[rng.randrange(len(base))] = "changed"
                d = 1000 + i * 10 + k
                docs.append((d, " ".join(base), "en", "s1", 1))
                copies.setdefault(i, []).append(d)
    leaks = []
    for k in range(10):
        d = 3000 + k
        docs.append((d, " ".join(say(50)) + "\n" + items[k][1] + "\n" + " ".join(say(50)), "en", "s2", 1))
        leaks.append(d)
    docs += [(4000, None, None, None, None), (4001, "", "en", "s0", 0)]
    top = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, docs, copies, leaks


def test_stages(spark, tables):
    top, rows, copies, leaks = tables
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]

    def ids(df):
        return sorted(r["doc_id"] for r in df.select("doc_id").collect())
    every = sorted(r[0] for r in rows)
    kept = stages["toxicity"](spark, docs, top)
    assert kept.columns == columns
    assert ids(kept) == [d for d in every if d >= 700 or d % 7]
    kept = stages["n-gram Jaccard join"](spark, docs, top)
    assert kept.columns == columns
    assert ids(kept) == sorted(d for d, _, c in brute([r[:2] for r in rows]) if d == c)
    assert sum(len(v) > 1 and len(set(v) & set(ids(kept))) < len(v) for v in copies.values()) > 10
    kept = stages["benchmark decontamination"](spark, docs, top)
    assert kept.columns == columns and ids(kept) == sorted(set(every) - set(leaks))
    mixed = stages["mixing sources to target weights"](spark, docs, top)
    assert mixed.columns == columns and set(ids(mixed)) <= set(every)
    out = stages["sharding"](spark, docs, top).collect()
    assert sorted(r["doc_id"] for r in out) == every


def test_near_copies_of_rows_without_ids(spark, tables):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, "en", None, 1), (None, text + " x", "en", "b", 1), (5, text, "en", None, 1), (6, "other words here", "en", None, 1),
            (6, "other words here", "en", None, 1), (6, "and more other words here", "en", None, 1), (7, None, "en", None, 1), (7, None, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, tables[0]).collect()
    assert sorted(str(r["text"])[:5] for r in kept) == ["None", "None", "and m", "other", "w0 w1"]


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    by = {}
    for r in out.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_written_and_nothing_left_behind(spark, tables, tmp_path):
    from zonewatch.session import shared_dir
    shared = shared_dir(spark)
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    corpus_pipeline.write(spark, tables[0], str(tmp_path / "out"))
    assert set(os.listdir(shared)) - before == set() and spark.read.parquet(str(tmp_path / "out")).count() > 500


def test_empty_tables(spark, tables, tmp_path):
    for f in glob.glob(f"{tables[0]}/*.parquet"):
        spark.read.parquet(f).limit(0).write.parquet(f"{tmp_path}/{os.path.basename(f)}")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", OWN)
def test_query_against_sql(spark, name):
    con = connect(SF)
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=str)
    cur = con.execute(queries.ORACLE[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=str) and got
