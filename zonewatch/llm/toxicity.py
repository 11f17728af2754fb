"""Operator 7: toxic documents by a learned lexicon, met exactly or misspelled, in context.

1. **Lexicon.** Over all distinct texts of labelled training rows, every word and every word beginning of
   four to eight letters is counted once per text and class; copies of a text add nothing. All terms whose
   smoothed log odds are high enough and that pass the significance test become the lexicon, however many
   they are; a beginning covers the forms built on it.
2. **Matching.** The terms form a trie, and the Levenshtein automaton of a word is intersected with it: a
   state is the set of trie nodes in reach, each with the fewest errors by which the letters so far lead to it.
   What terms begin with in common is worked out once. A node is in reach while a term below it allows its errors.
   States are built when first met and kept for all tasks of a Python worker, up to `CACHE_BYTES`. A word runs
   through them letter by letter and stops as soon as no node is left. Terms of at least `FUZZY_MIN` letters may be one error off, those of at least nine
   letters two; an error may be anywhere, the first letter included. Up to two masking signs between letters
   stay in a word (`id*ot`), which is then tried whole and in pieces; the better of the two counts, and pieces
   where they are equally good. A sign before a word needs no such care: leaving a letter out costs the same.
   An apostrophe between letters is no quotation mark.
3. **Context.** A hit counts fully in open text and at `QUOTED` of its weight inside quotation marks
   opened at most `WINDOW` words before it. The densest window of hits is a feature of its own.
4. **Score.** A logistic regression over a handful of such features, fitted on about `FIT_ROWS` distinct
   texts of labelled training rows at most (by a hash of the text). Everything else uses all of them.

Only the text is scored; labels, language, source and id are not features. Null and empty texts have no
hits and get the score of a text without hits. Without training labels of both classes every score is 0.
Labels that disagree for one id, or for one text, count as toxic; null labels are left out. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewatch.llm.common import long_rows, lookup_side
from zonewatch.session import materialize, release

MIN_DOCS = 3
MIN_LOG_ODDS = 2.5
FIT_ROWS = 20_000
FUZZY_MIN = 5
WINDOW = 12
QUOTED = 0.25
THRESHOLD = 0.7
FEATURES = 8
_TOKEN = re.compile(r"[^\W_]+(?:[*@#$%&!?+|~^._-]{1,2}[^\W_]+)*|[\"“”„«»]|(?<![^\W_])[‘’]|[‘’](?![^\W_])")
_PIECE = re.compile(r"[^\W_]+")
_OPEN, _CLOSE, _EITHER = set("“„«‘"), set("”»’"), {'"'}
_QUOTES = _OPEN | _CLOSE | _EITHER
_FLUSH = 300_000
#: Memory for states and for words seen, per Python worker; beyond it they are built anew.
CACHE_BYTES, SEEN_BYTES = 200 << 20, 16 << 20


def forms(word: str) -> list[str]:
    """The word and its beginnings that may become terms; a beginning ends in '*'."""
    return [word, *[word[:k] + "*" for k in range(4, min(8, len(word)) + 1)]] if len(word) > 2 else []


def distinct_texts(labelled: DataFrame) -> DataFrame:
    """(text, toxic), each text once; toxic if any of its rows is. Copies meet in the tasks that read them first."""
    return labelled.groupBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")).agg(
        F.max("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def term_counts(labelled: DataFrame) -> DataFrame:
    """term, toxic texts, other texts: over all rows of (text, toxic). The empty term counts the rows themselves."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = (Counter(), Counter())

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(t, by[1][t], by[0][t]) for t in by[1].keys() | by[0].keys()], columns=["term", "pos", "neg"])
            by[0].clear(), by[1].clear()
            return out.astype({"pos": "int64", "neg": "int64"})

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = {w for w in _PIECE.findall((text or "").lower()) if len(w) > 2}
                by[int(toxic > 0)].update({"", *(f for w in words for f in forms(w))})
                if len(by[0]) + len(by[1]) > _FLUSH:
                    yield flush()
        yield flush()

    return labelled.select("text", "toxic").mapInPandas(count, "term string, pos long, neg long") \
        .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose_terms(counts: DataFrame, n_pos: int, n_neg: int) -> dict[str, float]:
    """All terms that pass, with their log odds.

    A term must be more lopsided than the most lopsided of equally many terms would be by chance (G test,
    all terms counted). Of a beginning and a longer form with nearly the same documents the longer is kept;
    otherwise a kept beginning stands for all its longer forms.
    """
    counts = counts.filter("term != ''")
    tried = counts.filter(F.col("pos") + F.col("neg") >= MIN_DOCS).count()
    base = n_pos / (n_pos + n_neg)
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    gain = (F.col("pos") * F.log(share / base)
            + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - base))).otherwise(0.0))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
    rows = (counts.filter(F.col("pos") >= MIN_DOCS).withColumn("odds", odds).withColumn("gain", gain)
            .filter((F.col("odds") >= MIN_LOG_ODDS) & (F.col("gain") >= float(np.log(max(tried, 1)) + 1)))
            .select("term", "pos", "odds").collect())
    found = {r["term"]: r for r in rows}
    longer: dict[str, int] = {}
    for t, r in found.items():
        word = t.rstrip("*")
        shorter = word + "*" if t[-1] != "*" else word[:-1] + "*"
        for s in {shorter, word[:-1] + "*"}:
            if s != t:
                longer[s] = max(longer.get(s, 0), r["pos"])
    kept: dict[str, float] = {}
    for t in sorted(found, key=lambda t: (len(t.rstrip("*")), t[-1] != "*", t)):
        word = t.rstrip("*")
        covered = any(word[:k] + "*" in kept for k in range(4, len(word) + 1))
        if not covered and longer.get(t, 0) < 0.9 * found[t]["pos"]:
            kept[t] = float(found[t]["odds"])
    return kept


class Trie:
    """The terms by their letters. Per node: children by letter, the most errors that a term at or below it allows,
    and the terms that end there, with whether they are beginnings."""

    def __init__(self, terms: list[str], allowed: list[int]):
        self.children: list[dict[str, int]] = [{}]
        self.most = [-1]
        self.ends: dict[int, list[tuple[int, bool]]] = {}
        for n, t in enumerate(terms):
            at = 0
            self.most[0] = max(self.most[0], allowed[n])
            for c in t.rstrip("*"):
                at = self.children[at].setdefault(c, len(self.most))
                if at == len(self.most):
                    self.children.append({})
                    self.most.append(-1)
                self.most[at] = max(self.most[at], allowed[n])
            self.ends.setdefault(at, []).append((n, t[-1] == "*"))


class Matcher:
    """Words against all terms at once: sets of (trie node, errors), built as they are met."""

    def __init__(self, terms: dict[str, float], cache_bytes: int = CACHE_BYTES, seen_bytes: int = SEEN_BYTES):
        self.terms = sorted(terms)
        self.allowed = [int(len(t.rstrip("*")) >= FUZZY_MIN) + int(len(t.rstrip("*")) >= 9) for t in self.terms]
        self.trie = Trie(self.terms, self.allowed)
        self.cache_bytes, self.seen_bytes = cache_bytes, seen_bytes
        self.seen: dict[str, tuple[int, str] | None] = {}
        self.seen_size = 0
        self.clear()

    def clear(self) -> None:
        #: per state: its (node, errors), best end of a beginning, best end of any term
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.size = 0
        self.start = self._state({0: 0} if self.terms else {})

    def _state(self, reach: dict[int, int]) -> int:
        """The state of these nodes and of those that letters left out lead to; -1 without any."""
        children, most = self.trie.children, self.trie.most
        todo = [n for n, e in reach.items() if e < most[n]]
        for n in todo:  # grows as it is walked
            e = reach[n] + 1
            for k in children[n].values():
                if e <= most[k] and reach.get(k, 9) > e:
                    reach[k] = e
                    if e < most[k]:
                        todo.append(k)
        if not reach:
            return -1
        key = tuple(sorted(reach.items()))
        if key not in self.number:
            ends = [(e, self.terms[t], open_) for n, e in key for t, open_ in self.trie.ends.get(n, ()) if e <= self.allowed[t]]
            best = [min(((e, t) for e, t, open_ in ends if open_ or every), default=None) for every in (False, True)]
            self.number[key] = len(self.states)
            self.states.append((key, *best))
            self.moves.append({})
            self.size += 500 + 130 * len(key)
        return self.number[key]

    def _move(self, at: int, c: str) -> int:
        """The state after one more letter: it is a child's letter, or stands for one, or is one too many."""
        children, most = self.trie.children, self.trie.most
        reach: dict[int, int] = {}
        for n, e in self.states[at][0]:
            if e < most[n]:
                if reach.get(n, 9) > e + 1:
                    reach[n] = e + 1
                for letter, k in children[n].items():
                    now = e if letter == c else e + 1
                    if now <= most[k] and reach.get(k, 9) > now:
                        reach[k] = now
            elif (k := children[n].get(c)) is not None and e <= most[k] and reach.get(k, 9) > e:
                reach[k] = e
        to = self._state(reach)
        self.moves[at][c] = to
        self.size += 150
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """(errors, term) of the best term that the word, or a beginning of it, is; else None."""
        if word in self.seen:
            return self.seen[word]
        if self.size > self.cache_bytes:
            self.clear()  # they are built anew, at the same results
        if self.seen_size > self.seen_bytes:
            self.seen, self.seen_size = {}, 0  # the states stay: they are few, words are many
        at, best = self.start, None
        for c in word:
            if at < 0:
                break
            to = self.moves[at].get(c)
            at = self._move(at, c) if to is None else to
            if at < 0:
                break
            end = self.states[at][1]
            if end and (best is None or end < best):
                best = end
        if at >= 0 and (end := self.states[at][2]) and (best is None or end < best):
            best = end
        self.seen[word] = best
        self.seen_size += 200 + 4 * len(word)
        return best

    def words(self, text: str) -> list[str]:
        """Words and quotation marks of a text; of a word with masking signs the pieces, unless it matches better whole."""
        found = _TOKEN.findall(text)
        out: list[str] = []
        for w in found:
            if w.isalnum() or w in _QUOTES:
                out.append(w)
                continue
            pieces = _PIECE.findall(w)
            whole = self.match(w)
            if whole is not None and all(h is None or h[0] > whole[0] for h in (self.match(p) for p in pieces if len(p) > 2)):
                out.append(w)
            else:
                out += pieces
        return out


_MATCHERS: dict[tuple[str, ...], Matcher] = {}


def matcher_of(terms: dict[str, float]) -> Matcher:
    """The matcher of this Python process for these terms; the one of other terms goes."""
    key = tuple(sorted(terms))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(terms)
    return _MATCHERS[key]


def features(text: str | None, terms: dict[str, float], matcher: Matcher) -> list[float]:
    """What the regression sees of one whole text; all zero without hits but for the length."""
    text = (text or "").lower()
    words = matcher.words(text)
    if not any(len(w) > 2 and matcher.match(w) is not None for w in set(words)):  # most texts: no hit at all
        n = sum(w not in _QUOTES for w in words)
        return [0.0] * (FEATURES - 1) + [np.log1p(n) / 10.0]
    n = exact = fuzzy = quoted = 0.0
    kinds: dict[str, float] = {}
    opened, at, place = None, [], []
    for w in words:
        if w in _QUOTES:
            inside = opened is not None and n - opened <= WINDOW
            opened = n if w in _OPEN or (w in _EITHER and not inside) else None
            continue
        n += 1
        hit = matcher.match(w) if len(w) > 2 else None
        if hit is None:
            continue
        in_quotes = opened is not None and n - opened <= WINDOW
        weight = terms[hit[1]] * (1.0 if hit[0] == 0 else 0.6) * (QUOTED if in_quotes else 1.0)
        quoted += in_quotes
        exact += hit[0] == 0 and not in_quotes
        fuzzy += hit[0] > 0 and not in_quotes
        kinds[hit[1]] = max(kinds.get(hit[1], 0.0), weight)
        at.append(n)
        place.append(weight)
    dense = lo = 0
    total = 0.0
    for hi in range(len(at)):
        total += place[hi]
        while at[hi] - at[lo] > WINDOW:
            total -= place[lo]
            lo += 1
        dense = max(dense, total)
    best = max(kinds.values(), default=0.0)
    return [np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), best / 5.0, np.log1p(sum(kinds.values())),
            np.log1p(dense), 100.0 * sum(place) / (5.0 * (n + 20.0)), np.log1p(n) / 10.0]


def fit(x: np.ndarray, y: np.ndarray, strength: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Newton steps for a logistic regression with a small quadratic penalty; the constant comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([strength] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Terms and weights; a plain value that tasks receive."""

    def __init__(self, terms: dict[str, float], weights: np.ndarray | None):
        self.terms, self.weights = terms, weights

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """`docs` with the score of each whole text as a new column (which replaces one of that name)."""
        terms, weights = self.terms, self.weights
        long_rows(docs.sparkSession)

        @F.pandas_udf("double")
        def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = matcher_of(terms)
            for texts in parts:
                if weights is None:
                    yield pd.Series(np.zeros(len(texts)))
                    continue
                x = np.array([features(t, terms, matcher) for t in texts]).reshape(-1, FEATURES)
                yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))

        return docs.withColumn(name, scored(F.col(text_col)))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from documents (doc_id, text) and labels (doc_id, toxic). The caller leaves out held-out rows."""
    long_rows(docs.sparkSession)
    marks = lookup_side(labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), 1_000_000)
    labelled = docs.select("doc_id", "text").join(marks, "doc_id")
    counts = materialize(term_counts(distinct_texts(labelled)))
    size = counts.filter("term = ''").first()
    if size is None or not size["pos"] or not size["neg"]:
        release(counts)
        return Model({}, None)
    terms = choose_terms(counts, size["pos"], size["neg"])
    release(counts)
    share = min(1.0, fit_rows / (size["pos"] + size["neg"]))
    taken = distinct_texts(labelled.filter(
        (F.pmod(F.xxhash64(F.lit("fit"), F.coalesce("text", F.lit(""))), F.lit(1_000_000)) < int(share * 1_000_000)) | F.lit(share >= 1.0)))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = matcher_of(terms)
        for b in batches:
            yield pd.DataFrame({"y": (b["toxic"] > 0).astype("int64"), "x": [features(t, terms, matcher) for t in b["text"]]})

    sample = taken.select("text", "toxic").mapInPandas(rows, "y long, x array<double>").limit(2 * fit_rows).collect()
    y = np.array([r["y"] for r in sample], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(terms, None)
    return Model(terms, fit(np.array([r["x"] for r in sample]).reshape(-1, FEATURES), y))
