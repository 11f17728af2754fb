import hashlib
import math
import random

import numpy as np
import pyarrow as pa

from zonewatch.llm import decontaminate, fingerprint, licences, pages, toxicity, urlrank
from zonewatch.llm.hashing import row_words

PAGES = "page_id long, url string, html string, host string"


def _page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_article_without_what_surrounds_it(spark):
    body = ("<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
            "<article class='post'><header><h1>A &amp; B &lt;c&gt;</h1></header><p>One <b>t</b>wo\n three<br>four<p>five &eacute;&#33;"
            "<script>var t='</p>';</script><!-- <p>no</p> --><aside>Aside</aside><form><label>Mail</label><input></form><ul><li>x<li>y</ul>"
            "<div class=\"ad box\">Buy</div><section id='comments'><article>Nice</article></section><footer>By</footer></article>"
            "<div id='sidebar'>Side</div><footer>&copy; me</footer>")
    rows = [(1, "http://a.org/x", _page(body), "keep"), (2, "http://a.org/y", None, None), (3, None, "", None), (4, None, "plain <i>te</i>xt", None),
            (5, "http://a.org/z", _page("<main><p>In main.</p><div class='related'>More</div></main><div>out</div>"), None),
            (6, "http://b.org/", _page("<div class='article-content'><p>c1<p>c2</div><p>out"), None), (7, "http://c.org/", "<article><p>cut off <a hre", None),
            (8, "http://d.org/", "<article><div class=ad>unclosed<p>gone</article><p>rest", None)]
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in pages.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    text = {k: v[1] for k, v in got.items()}
    assert text == {1: "A & B <c> One two three four five é! x y", 2: "", 3: "", 4: "plain text", 5: "In main.", 6: "c1 c2", 7: "cut off", 8: "rest"}
    assert got[1][0] == "http://a.org/x" and all(v[2] == len(v[1]) for v in got.values())
    assert pages.main_text(spark.createDataFrame([], PAGES)).collect() == []


def test_shared_lines_go_where_the_structure_says_nothing(spark):
    def plain(i):
        return _page(f"<div>Top line</div><p>Own {i} a.</p><p>Read more</p><p>Own {i} b.</p><div>Bottom</div>")
    rows = [(i, f"https://h.com/news/{i:03d}", plain(i), None) for i in range(40)]
    rows += [(90, "https://alone.com/", plain(90), None), (91, "https://m.com/a", plain(7), None), (92, "https://m.com/b", plain(7), None)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"Own {i} a. Own {i} b." for i in range(40))
    assert got[90] == "Top line Own 90 a. Read more Own 90 b. Bottom" and got[91] == got[92] == "Top line Own 7 a. Read more Own 7 b. Bottom"


def test_differencing_names_the_region_of_every_page(spark):
    def teaser(i):  # the article is the same on all pages; what differs stands in the main element
        return _page(f"<nav>Menu {i}</nav><main><article><p>Join us today.</p></article><p>Story {i}.</p><p>Shared passage.</p><p>End {i}.</p></main>")
    rows = [(i, f"https://h.com/news/{i:03d}", teaser(i), None) for i in range(6)]
    # a plain page between two that have articles is compared with them
    bare = "<div>Top line</div>{}<p>More to read</p><div>Bottom line</div>"
    rows += [(20 + i, f"https://p.com/{i}", _page(bare.format(f"<article><p>Own {i}.</p></article>" if i != 1 else "<p>Plain own.</p>")), None) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"Story {i}. Shared passage. End {i}." for i in range(6))
    assert got[20] == "Own 0." and got[21] == "Plain own." and got[22] == "Own 2."


def test_lines_that_repeat_a_lot_are_aligned_as_well(monkeypatch):
    rng = random.Random(2)
    cases = [(rng.choices("ab", k=rng.randint(0, 30)), rng.choices("abc", k=rng.randint(0, 30))) for _ in range(200)]
    plain = [len(pages.common_lines(a, b)) for a, b in cases]
    monkeypatch.setattr(pages, "PAIRS", 3)
    for (a, b), n in zip(cases, plain):
        at, rest = sorted(pages.common_lines(a, b)), iter(b)
        assert len(at) == n and all(a[i] in rest for i in at)
    monkeypatch.undo()
    assert len(pages.common_lines(["p", *["x"] * 20_000, "q"], ["r", *["x"] * 15_000, "s"])) == 15_000


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = rng.choices("abcd", k=rng.randint(0, 12)), rng.choices("abcd", k=rng.randint(0, 12))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        at = sorted(pages.common_lines(a, b))
        rest = iter(b)
        assert len(at) == best[-1][-1] and all(a[i] in rest for i in at)


def test_licences(spark):
    mit = dict((t, n) for n, t in licences.KNOWN)
    whole = next(t for t in mit if t.startswith("the mit license"))
    varied = "/*\n * The MIT License\n *\n * Copyright (c) 2001 A. B.\n" + whole[len("the mit license "):].replace(" without ", " WITHOUT, ").replace("sublicense", "sub-license") + "\n*/"
    rows = [(1, varied, "x"), (2, whole + " and more", None), (3, None, None), (4, "", None), (5, "text\nReleased under the MIT Licence!\nReleased under the MIT license\n", None),
            (5, "(c) 2020 all", None), (None, "Copyright 1999 me\nLicensed under CC BY 4.0", None)]
    got = [(r["doc_id"], r["licence"], r["n_notices"], r["notices"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, licence string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT", 1, ["MIT"]), (2, None, 0, []), (3, None, 0, []), (4, None, 0, []), (5, None, 2, ["MIT"]), (5, None, 0, []),
                                           (None, "CC-BY-4.0", 1, ["CC-BY-4.0"])], key=str)
    mine = spark.createDataFrame([("mine", "My own terms."), ("also", "my OWN terms")], "licence string, text string")
    assert licences.scan(spark.createDataFrame([(1, "my own -- terms")], "doc_id long, text string"), mine).first()["licence"] == "also"
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rules_and_links(spark):
    def html(*links):
        return "".join(f'<a href="{x}">x</a>' for x in links)
    rows = [(1, "http://good.org/a?x", html("https://Friend.net/1", "//friend.net/2", "/local", "http://good.org/b"), None), (2, "https://friend.net", html("http://third.net"), None),
            (3, "http://bad.com/de/1", "", None), (4, "http://link.net/x", html("http://bad.com/"), None), (5, "http://www.example.org/es/q#f", None, None),
            (6, "HTTP://EXAMPLE.org/en/17", "", None), (7, None, html("http://bad.com"), None), (8, "no host", "", "x"), (9, "http://a.com/fr/x", "", None),
            (10, "http://org", "", None), (10, "http://org", "", None), (11, "http://third.net/y", html("http://link.net"), None), (12, "http://xorg/", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrank.judge(df).collect() if r["page_id"] != 0)
    by = {g[0]: g[1:] for g in got}
    assert len(got) == 13 and by[1] == ("good.org", "/a", "org/", "allow") and by[2] == ("friend.net", "", None, "allow")
    assert by[3] == ("bad.com", "/de/1", "com/de/", "block") and by[4] == ("link.net", "/x", None, "block")
    assert by[5] == ("www.example.org", "/es/q", "example.org/es/", "block") and by[6] == ("example.org", "/en/17", "example.org/en/1", "block")
    assert by[7] == ("", "", None, "allow") and by[8] == ("", "", None, "allow") and by[9][2:] == ("com/fr/", "allow") and by[10][2:] == (None, "allow")
    # against the same rounds on small matrices
    scores = {r["host"]: (r["trust"], r["distrust"]) for r in urlrank.judge(df).collect()}
    hosts = sorted({g[1] for g in got if g[1]})
    links = {("good.org", "friend.net"), ("friend.net", "third.net"), ("link.net", "bad.com"), ("third.net", "link.net")}
    seeds = {"good.org": (1, 0), "bad.com": (0, 1), "www.example.org": (0, 1), "example.org": (0, 1), "a.com": (1, 0)}
    trust, distrust = ({h: float(seeds.get(h, (0, 0))[k]) for h in hosts} for k in (0, 1))
    for _ in range(60):
        t = {h: 0.15 * seeds.get(h, (0, 0))[0] + 0.85 * sum(trust[a] / sum(x == a for x, _ in links) for a, b in links if b == h) for h in hosts}
        d = {h: 0.15 * seeds.get(h, (0, 0))[1] + 0.85 * sum(distrust[b] / sum(x == b for _, x in links) for a, b in links if a == h) for h in hosts}
        trust, distrust = t, d
    assert all(abs(scores[h][0] - trust[h]) < 1e-3 and abs(scores[h][1] - distrust[h]) < 1e-3 for h in hosts)
    assert urlrank.judge(df.limit(0)).collect() == []


def test_scores_of_a_cycle_stand_still(spark):
    """Around a cycle of hosts scores move for long; they end where they belong."""
    rows = [(i, f"http://h{i}.org/" if not i else f"http://h{i}.net/", f'<a href="http://h{(i + 1) % 4}.{"net" if (i + 1) % 4 else "org"}/">x</a>') for i in range(4)]
    got = {r["host"]: r["trust"] for r in urlrank.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert abs(got[f"h{i}.net" if i else "h0.org"] - 0.15 * 0.85 ** i / (1 - 0.85 ** 4)) < 1e-3


def test_a_licence_is_known_however_its_lines_are_cut(spark):
    import textwrap
    whole = next(t for n, t in licences.KNOWN if n == "MIT" and "permission is hereby granted" in t)
    notice = ["Copyright (c) 2019 Some One", "Copyright 2001-2003, Some Body", "# Copyright Some One", "(c) 2020 all", "All rights reserved."]
    rows = [(w, "\n".join([notice[w % 5], *textwrap.wrap(whole, w)])) for w in range(30, 140)]
    got = {r["doc_id"]: r["licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {w for w, n in got.items() if n != "MIT"} == set() and len(got) == 110


def test_distrust_has_one_scale(spark):
    kind = "page_id long, url string, html string"
    bad = '<a href="http://bad.com/">x</a>'
    for n in (3, 3000):
        rows = [(0, "http://bad.com/de/1", "")] + [(i, f"http://h{i}.net/", bad) for i in range(1, n + 1)]
        got = {r["host"]: (r["verdict"], r["distrust"]) for r in urlrank.judge(spark.createDataFrame(rows, kind)).collect()}
        assert len(got) == n + 1 and all(v == "block" and abs(d - 0.15 * (0.85 if h != "bad.com" else 1)) < 1e-9 for h, (v, d) in got.items())
    mixed = [(i, f"http://mixed.com/{'de' if i < 2 else 'en'}/{i}", "") for i in range(10)]
    mostly = [(20 + i, f"http://mostly.com/{'de' if i < 8 else 'en'}/{i}", "") for i in range(10)]
    link = [(40, "http://one.net/", '<a href="http://two.net/">x</a>')]
    want = {i: "block" if i < 2 or i >= 20 else "allow" for i in [*range(10), *range(20, 30)]}
    alone, linked = ({r["page_id"]: (r["verdict"], r["trust"], r["distrust"]) for r in urlrank.judge(spark.createDataFrame(rows, kind)).collect()}
                     for rows in (mixed + mostly, mixed + mostly + link))
    assert {k: v[0] for k, v in alone.items()} == want and all(linked[k] == v for k, v in alone.items())


def test_fingerprints(spark):
    rng = random.Random(2)
    rows = [(i * 2, " ".join(rng.choices(["the", "of", "and", "Ünder", "x1", "zz", f"q{i}"], k=rng.randint(0, 300))), None) for i in range(80)]
    rows += [(3, None, None), (5, "", None), (7, "ab", None), (9, rows[4][1], None), (1, "z" * 200_000, None)]
    got = {r["doc_id"]: r for r in fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()}
    down = sorted(((d, t or "") for d, t, _ in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(down):
        after = down[(k + 1) % len(down)][1]
        half = len(t) // 2
        e = t[:len(t) - half] + after[:half]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = (fingerprint.codes_of(x.encode()) for x in (t, e, after))
        assert r["fingerprint"] == fingerprint.as_text(a) and r["edited_fingerprint"] == fingerprint.as_text(b)
        assert (fingerprint.from_text(r["fingerprint"]) == a).all()
        assert r["near_edited"] == fingerprint.likeness(a, b) and r["near_next"] == fingerprint.likeness(a, c)
        assert 0 <= r["near_next"] <= 1
    assert got[8]["fingerprint"] == got[9]["fingerprint"]
    one = fingerprint.with_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    assert fingerprint.with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bucket_counts():
    data = bytes(random.Random(3).choices(range(256), k=fingerprint.CHUNK + 1000))
    assert fingerprint.bucket_counts(data).sum() == (len(data) - 2) + 2 * (len(data) - 3)
    assert fingerprint.bucket_counts(b"ab").sum() == 0


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_against_edit_distance():
    rng = random.Random(4)
    terms = {"idiot": 1.0, "moron": 1.0, "disgusting": 1.0, "scum": 1.0, "lowei*": 1.0, "abcdefghij*": 1.0}
    m = toxicity.Matcher(terms)
    for _ in range(4000):
        w = list(rng.choice(["idiot", "moron", "disgusting", "scum", "loweischaft", "abcdefghijkl", "idol", "lower"]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(1, len(w) + 1)
            rng.choice([lambda: w.insert(k, rng.choice("abidot")), lambda: w.pop(min(k, len(w) - 1)), lambda: w.__setitem__(min(k, len(w) - 1), rng.choice("abidotx"))])()
            w = w or ["a"]
        w = "".join(w)
        best = None
        for t in terms:
            word = t.rstrip("*")
            allowed = (len(word) >= 5) + (len(word) >= 9)
            for e in {w, *([w[:k] for k in range(1, len(w))] if t[-1] == "*" else [])}:
                if e and e[0] == word[0]:
                    d = _levenshtein(e[1:], word[1:])  # the first letter is never wrong
                    if d <= allowed and (best is None or (d, t) < best):
                        best = (d, t)
        assert m.match(w) == best, w


def test_automata_with_errors_at_the_first_letter():
    rng = random.Random(9)
    terms = {"idiot": 1.0, "moron": 1.0, "asshole": 1.0, "disgusting": 1.0, "scum": 1.0, "lowei*": 1.0, "abcdefghij*": 1.0}
    m = toxicity.Matcher(terms)
    for _ in range(4000):
        w = list(rng.choice([*terms, "idol", "closer", "loweischaft", "abcdefghijkl", "diotima"])) * rng.choice([1, 1, 1, 2])
        for _ in range(rng.randint(0, 3)):
            k = rng.choice([0, rng.randrange(len(w))])
            rng.choice([lambda: w.insert(k, rng.choice("abidot*1")), lambda: len(w) > 1 and w.pop(k), lambda: w.__setitem__(k, rng.choice("abidotx@"))])()
        w = "".join(w)
        best = None
        for t in terms:
            word = t.rstrip("*")
            allowed = (len(word) >= 5) + (len(word) >= 9)
            for e in {w, *([w[:k] for k in range(1, len(w))] if t[-1] == "*" else [])}:
                d = _levenshtein(e, word)
                if d <= allowed and (best is None or (d, t) < best):
                    best = (d, t)
        assert m.match(w) == best, w


def test_masked_words_are_met():
    terms = {"idiot": 3.0, "asshole": 3.0, "scum": 3.0}
    m = toxicity.Matcher(terms)
    for text in ("you 1diot", "you xidiot", "you @sshole", "you id*ot", "you diot", "you *scum*", "fine.scum", "id_ot"):
        assert sum(toxicity.features(text, terms, m)[:2]) > 0, text
    assert m.words("he id*ot and/or well-known e.g. scum-idiot") == ["he", "id*ot", "and", "or", "well", "known", "e", "g", "scum", "idiot"]


def test_toxicity_learns_and_spares(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(300)]
    bad = ["idiot", "moron", "scum", "loweischaft", "loweient", "loweiwei", "loweiqua"]

    def text(toxic, n=40):
        t = rng.choices(words, k=n)
        for _ in range(3 * toxic):
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        return " ".join(t)
    rows = [(i, text(i % 6 == 0), int(i % 6 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(1, None), (10 ** 6, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {"idiot", "moron", "scum", "lowei*"} <= set(model.terms)
    new = [(1, text(1), None), (2, text(0), None), (3, None, None), (4, "", None), (5, text(0).replace(" ", " loweizzz idi0t ", 3), None),
           (6, text(0, 5000), None), (7, text(0, 30000) + " ", None), (2, "x", "y")]
    got = model.score(spark.createDataFrame(new, "doc_id long, text string, score string")).select("doc_id", "score").collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert score[1] > 0.7 and score[5] > 0.7 and max(score[k] for k in (2, 3, 4, 6, 7)) < 0.5
    terms, m = model.terms, toxicity.Matcher(model.terms)
    open_, quoted = toxicity.features("he is an idiot", terms, m), toxicity.features("they said “idiot” to him", terms, m)
    assert open_[0] > quoted[0] and quoted[2] > 0
    assert toxicity.train(docs, labels.filter("toxic = 0")).score(docs.limit(3)).agg({"score": "max"}).first()[0] == 0.0
    assert model.score(docs.limit(0)).collect() == []


def test_copies_of_a_toxic_text_displace_no_terms(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(300)]
    bad = ["idiot", "moron", "scum", "clown"]
    hot = " ".join("".join(rng.choices("bcdfgjklmpquvwxyz", k=9)) for _ in range(700))
    rows = [(i, " ".join(rng.choices(words, k=40) + ([bad[i // 6 % 4]] * 2 if i % 6 == 0 else [])), int(i % 6 == 0)) for i in range(900)]
    rows += [(10_000 + i, hot, 1) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert set(bad) <= set(model.terms) and not set(hot.split()) & set(model.terms)
    new = spark.createDataFrame([(i, " ".join(rng.choices(words, k=40) + [w] * 2)) for i, w in enumerate(bad)], "doc_id long, text string")
    assert model.score(new).filter("score < 0.7").count() == 0


def test_lexicon_has_all_significant_terms(spark):
    terms = [f"{a}{b}{c}" for a in "bcdfgjklmp" for b in "aeiou" for c in "qvwxyzbcdfgjkl"]
    counts = spark.createDataFrame([("", 5000, 50_000)] + [(t, 50, 0) for t in terms], "term string, pos long, neg long")
    assert toxicity.choose_terms(counts, 5000, 50_000).keys() == set(terms) and len(terms) == 700


def _bm25(items):
    toks = {i: t.lower().split() for i, t in items}
    mean = sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    impact = {i: {w: math.log1p((len(items) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
                  for w in set(t)} for i, t in toks.items()}
    return {i: {w: x / sum(m.values()) for w, x in m.items()} for i, m in impact.items()}


def test_wand_against_all_scores(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(300)] + [(900, "w1 w2 w3")]
    bench = spark.createDataFrame([*items, (901, None), (902, ""), (None, "w1")], "item_id long, text string")
    want = _bm25(items)
    for postings in (10 ** 6, 900):
        parts = decontaminate.build(bench, postings)
        assert len(parts) == (1 if postings > 10 ** 5 else len(parts)) and (postings > 10 ** 5 or len(parts) > 1)
        for _ in range(60):
            passage = rng.choices(words, k=rng.randint(1, 40))
            h = next(row_words(pa.array([" ".join(passage)])))[1]
            for least in (0.3, 0.5, 0.8):
                got = {}
                for x in parts:
                    t = np.minimum(np.searchsorted(x.terms, h), len(x.terms) - 1)
                    got |= {x.ids[d]: s for d, s in x.retrieve(np.unique(t[x.terms[t] == h]), least)}
                exact = {i: sum(m.get(w, 0) for w in set(passage)) for i, m in want.items()}
                assert got.keys() == {i for i, s in exact.items() if s >= least - 1e-9}
                assert all(abs(got[i] - exact[i]) < 1e-9 for i in got)


def test_leaks(spark):
    rng = random.Random(7)
    words = [f"v{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    items = [(i, "\n".join(" ".join(rng.choices(words, k=rng.randint(6, 25))) for _ in range(rng.randint(1, 3)))) for i in range(50)]
    clean = [(i, " ".join(rng.choices(words, k=rng.randint(0, 900)))) for i in range(200)]
    dirty = []
    for i in range(60):
        t = rng.choices(words, k=rng.randint(1, 900))
        k, at = rng.randrange(50), rng.randrange(len(t))
        dirty.append((1000 + i, " ".join(t[:at]) + "\n" + items[k][1].replace("\n", "  ").upper() + " " + " ".join(t[at:]), k))
    rows = clean + [(d, t) for d, t, _ in dirty] + [(None, None), (5000, ""), (5001, dirty[0][1]), (5001, dirty[0][1])]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect())
    assert got == sorted([(d, k) for d, _, k in dirty] + [(5001, dirty[0][2])] * 2)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted([d for d, _ in clean] + [-1, 5000])
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == [] and decontaminate.leaks(docs.limit(0), bench).collect() == []
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


def test_every_row_of_the_benchmark_is_searched(spark):
    rng = random.Random(10)
    words = [f"v{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(6)]
    ids = [1, 1, 1, 2, None, None]
    bench = spark.createDataFrame([*zip(ids, texts), (1, texts[0]), (3, None)], "item_id long, text string")
    around = lambda t: " ".join(rng.choices(words, k=50)) + " " + t + " " + " ".join(rng.choices(words, k=50))
    docs = spark.createDataFrame([(k, around(t)) for k, t in enumerate(texts)] + [(10, around("")), (11, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()), key=str)
    assert got == sorted(enumerate(ids), key=str)
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [10, 11]
    unnamed = bench.filter("item_id IS NULL")
    assert [r["item_id"] for r in decontaminate.leaks(docs, unnamed).collect()] == [None, None]


def test_the_trie_is_shared_and_small_caches_change_nothing():
    terms = {"disgusting": 1.0, "disgust*": 1.0, "disgrace": 1.0, "idiot": 1.0, "idio*": 1.0}
    m, tight = toxicity.Matcher(terms), toxicity.Matcher(terms, cache_bytes=2000, seen_bytes=500)
    assert len(m.trie.most) == 1 + len("disgusting") + len("race") + len("idiot")
    rng = random.Random(7)
    for _ in range(1500):
        w = list(rng.choice([t.rstrip("*") for t in terms]) + rng.choice(["", "s", "ed"]))
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice("disgut"))
            w.pop(rng.randrange(len(w)))
        assert m.match("".join(w)) == tight.match("".join(w))
    assert tight.size < 2000 + 20_000 and len(tight.states) < len(m.states)
    assert toxicity.Matcher({}).match("idiot") is None


def test_an_apostrophe_closes_no_quotation():
    terms = {"idiot": 5.0}
    m = toxicity.Matcher(terms)
    quoted = lambda t: toxicity.features(t, terms, m)[2] > 0
    assert quoted("they said “you idiot” there") and quoted("they said “don’t you idiot” there") and quoted("‘isn’t he an idiot’ they said")
    assert not quoted("they said “don’t” you idiot") and not quoted("it isn’t you idiot") and not quoted("the dogs’ idiot")
    assert m.words("“don’t”") == ["“", "don", "t", "”"]
