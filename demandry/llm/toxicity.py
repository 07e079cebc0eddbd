"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, with context windows that tell quotation from abuse."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, texts
from .langid import remainder

#: Labelled rows that are learned from at most.
ROWS = 40_000
#: A term shows in this many toxic documents at least, with at least these log-odds against the others, and so that its
#: likelihood ratio is beyond what chance gives among a million words.
LEAST, ODDS, RATIO = 3, 2.5, 25.0
#: Lengths of word beginnings that may become terms (written with a final *); least length of a term that may be misspelled.
STEMS, FUZZY_LENGTH = (4, 5, 6), 5
#: Words on either side of a hit that its context has; characters of words that the automaton holds at once.
WINDOW, HELD = 8, 1 << 22
#: Words of a quotation at most; between marks further apart nothing is quoted.
QUOTED = 40

#: What marks a report of someone's words, and what addresses somebody.
REPORT = frozenset("said says wrote writes called calling quote quoted quotes word words term terms slur insult claims claimed reported".split())
ADDRESS = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi vous votre usted ustedes vosotros ti".split())
QUOTES = regex.compile(r'["“”„«»]')

SPACE = {c: " " for c in map(ord, '.,;:?!()[]{}<>|/\\"“”„«»…\0')}


def words_of(text: bytes | None) -> list[str]:
    return (text or b"").decode("utf-8", "replace").lower().translate(SPACE).split()


class Automaton:
    """A deterministic automaton: the union of the Levenshtein automata of terms, intersected with their trie.

    Terms are (term, edits allowed); one that ends in * is a stem, which takes no edits. A state is the set of the trie's
    nodes that a word may have led to, with the edits that it took; state 0 is dead, and a state that has met a stem
    accepts whatever follows. States are built when a word first leads to them, so that a large lexicon costs no more
    than what texts have of it.
    """

    def __init__(self, terms: list[tuple[str, int]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int, bool] | None] = [None]
        self.allow = [0]
        for number, (term, edits) in enumerate(terms):
            stem, node = term.endswith("*"), 0
            self.allow[0] = max(self.allow[0], edits)
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.allow.append(0)
                node = self.children[node][c]
                self.allow[node] = max(self.allow[node], edits)
            if self.ends[node] is None:
                self.ends[node] = (number, edits, stem)
        self.alphabet = [None, *sorted({c for node in self.children for c in node})]
        self.classes = np.zeros(0x110000, dtype=np.int32)
        self.classes[[ord(c) for c in self.alphabet[1:]]] = np.arange(1, len(self.alphabet))
        #: Characters that decide: a longer word is dead by then, or has met a stem.
        self.width = max((len(t) + e for t, e in terms), default=0) + 1
        self.table = np.full((64, len(self.alphabet)), -1, dtype=np.int32)
        self.table[0] = 0
        self.states, self.number, self.term, self.errors = [], {}, [], []
        self._state(frozenset())
        self._state(self._closed({(0, 0)}))

    def __reduce__(self):
        return Automaton, (self.terms,)

    def _state(self, states: frozenset) -> int:
        if states not in self.number:
            self.number[states] = len(self.states)
            self.states.append(states)
            term, errors = self._accepted(states)
            self.term.append(term)
            self.errors.append(errors)
            if len(self.states) > len(self.table):
                self.table = np.r_[self.table, np.full_like(self.table, -1)]
        return self.number[states]

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With the characters that may have been left out; of each node the fewest edits."""
        todo, least = list(states), {}
        while todo:
            node, e = todo.pop()
            if e >= least.get(node, e + 1):
                continue
            least[node] = e
            if node >= 0:
                todo += [(child, e + 1) for child in self.children[node].values() if e < self.allow[child]]
        return frozenset(least.items())

    def _accepted(self, states: frozenset) -> tuple[int, int]:
        best = min(((e, self.ends[n][0]) for n, e in states if n >= 0 and self.ends[n] and e <= self.ends[n][1]), default=None)
        best = min([*[(0, -1 - n) for n, _ in states if n < 0], *([best] if best else [])], default=None)
        return (best[1], best[0]) if best else (-1, 0)

    def _step(self, states: frozenset, c: str | None) -> frozenset:
        after = set()
        for node, e in states:
            if node < 0:
                after.add((node, e))
                continue
            if c in self.children[node]:
                after.add((self.children[node][c], e))
            if e < self.allow[node]:
                after.add((node, e + 1))
                after.update((child, e + 1) for child in self.children[node].values() if e < self.allow[child])
        found = self._closed(after)
        return found | {(-1 - self.ends[n][0], 0) for n, e in found if n >= 0 and self.ends[n] and self.ends[n][2] and e == 0}

    def match(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """The words that the automaton accepts, with their term and errors. Words are read whole."""
        found: dict[str, tuple[int, int]] = {}
        lot = max(1, HELD // self.width)
        for k in range(0, len(words) if self.terms else 0, lot):
            found |= self._match(words[k : k + lot])
        return found

    def _match(self, words: list[str]) -> dict[str, tuple[int, int]]:
        chars = np.array(words, dtype=f"U{self.width}").view(np.uint32).reshape(len(words), self.width)
        kind = self.classes[chars]
        state, live = np.ones(len(words), dtype=np.int32), np.arange(len(words))
        for k in range(self.width):
            live = live[chars[live, k] != 0]
            if not len(live):
                break
            now, by = state[live].astype(np.int64), kind[live, k]
            after = self.table[now, by]
            if (after < 0).any():
                for pair in np.unique(now[after < 0] * len(self.alphabet) + by[after < 0]).tolist():
                    at, c = divmod(pair, len(self.alphabet))
                    to = self._state(self._step(self.states[at], self.alphabet[c]))
                    self.table[at, c] = to
                after = self.table[now, by]
            state[live] = after
            live = live[after != 0]
        term = np.array(self.term)[state]
        return {words[i]: (int(term[i]), self.errors[state[i]]) for i in np.flatnonzero(term >= 0)}


def learn_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[tuple[str, float]]:
    """(term, log-odds), the strongest first, of (word or stem, toxic documents, other documents)."""
    found, most = [], Counter()
    for term, t, _ in counts:
        for n in STEMS if not term.endswith("*") else ():
            most[term[:n]] = max(most[term[:n]], t)
    for term, t, c in counts:
        if term.endswith("*") and t < 1.5 * most[term[:-1]]:
            continue  # one word makes up most of the stem
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        if t >= LEAST and odds >= ODDS and likelihood_ratio(t, c, toxic, clean) >= RATIO:
            found.append((t * odds, term, odds))
    found.sort(key=lambda x: (-x[0], x[1]))
    taken: dict[str, float] = {}
    begun: set[str] = set()
    for _, term, odds in found:
        bare = term.rstrip("*")
        inside = any(bare[:n] + "*" in taken for n in range(1, len(bare) + 1))
        if not inside and not (term.endswith("*") and bare in begun):
            taken[term] = odds
            begun.update(bare[:n] for n in STEMS)
    return list(taken.items())


def likelihood_ratio(t: int, c: int, toxic: int, clean: int) -> float:
    """Twice the log of how much likelier the counts are with the two shares that they show than with one share."""
    expected = (t + c) * toxic / max(toxic + clean, 1)
    rest = t + c - expected
    return 2 * ((t * math.log(t / expected) if t else 0.0) + (c * math.log(c / rest) if c else 0.0)) if expected > 0 and (rest > 0 or not c) else 0.0


@dataclass
class Lexicon:
    terms: list[str]
    odds: np.ndarray
    machine: Automaton

    @classmethod
    def of(cls, terms: list[tuple[str, float]]) -> Lexicon:
        """Every word of FUZZY_LENGTH letters or more may be misspelled by one edit."""
        edits = [int(not t.endswith("*") and len(t) >= FUZZY_LENGTH) for t, _ in terms]
        return cls([t for t, _ in terms], np.array([o for _, o in terms]), Automaton([(t, e) for (t, _), e in zip(terms, edits, strict=True)]))

    def features(self, part: list[bytes | None]) -> np.ndarray:
        """A row for each whole text: hits as they are, misspelled, quoted or reported, addressed; their weights. All 0 without a hit."""
        split = [words_of(t) for t in part]
        matched = self.machine.match(list(set().union(*split))) if split else {}
        out = np.zeros((len(part), 8))
        for row, (text, words) in enumerate(zip(part, split, strict=True)):
            places = [i for i, w in enumerate(words) if w in matched]
            if not places:
                continue
            marks = len(QUOTES.findall(text.decode("utf-8", "replace")))
            spans = quoted_words(text) if marks else None
            exact = fuzzy = quoted = aimed = 0
            weight, top = 0.0, 0.0
            for i in places:
                term, errors = matched[words[i]]
                near = words[max(0, i - WINDOW) : i + WINDOW + 1]
                said = bool(spans and i < len(spans) and spans[i]) or not REPORT.isdisjoint(near)
                exact += not errors
                fuzzy += bool(errors)
                quoted += said
                aimed += not ADDRESS.isdisjoint(near)
                value = float(self.odds[term]) * (0.5 if errors else 1.0) * (0.25 if said else 1.0)
                weight += value
                top = max(top, value)
            out[row] = [exact > 0, math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(aimed), top, math.log1p(weight), math.log1p(100 * len(places) / len(words))]
        return out


def quoted_words(text: bytes) -> list[bool]:
    """For each word whether it stands between two quotation marks no more than QUOTED words apart."""
    pieces = QUOTES.split(text.decode("utf-8", "replace").lower())
    sizes = [len(p.translate(SPACE).split()) for p in pieces]
    return [k % 2 == 1 and k + 1 < len(pieces) and size <= QUOTED for k, size in enumerate(sizes) for _ in range(size)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the offset last) of a logistic regression by Newton's method."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(z.shape[1] - 1, ridge), 1e-3]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


@dataclass
class Judge:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, part: list[bytes | None]) -> np.ndarray:
        z = (self.lexicon.features(part) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_judge(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, rows: int) -> Judge:
    """A judge from at most about `rows` labelled documents, drawn by a hash of the id.

    Their ids (a bounded table) are broadcast to the documents; the drawn texts become a table of bounded size, on which
    words are counted in partial sums and features are taken.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & F.coalesce(learn, F.lit(False))).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64(id_col, F.lit("toxic")), F.lit(1 << 30)) < int(min(1.0, rows / max(n, 1)) * (1 << 30))) if n > rows else known
    drawn = drawn.select(F.col(id_col).alias("__id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    picked = materialise(docs.join(F.broadcast(drawn), F.col(id_col) == F.col("__id")).select("toxic", F.col(text_col).alias("text")), "toxicity")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for label, text in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                own = set(words_of(text))
                seen[label].update(own)
                seen[label].update({w[:n] + "*" for w in own for n in STEMS if len(w) >= n})
            names = list(seen[1] | seen[0])
            yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array([seen[1][w] for w in names], type=pa.int64()), pa.array([seen[0][w] for w in names], type=pa.int64())], ["term", "toxic", "clean"])

    sums = {r[0]: r[1] for r in picked.groupBy("toxic").count().collect()}
    toxic, clean = sums.get(1, 0), sums.get(0, 0)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    expected = (F.col("t") + F.col("c")) * F.lit(toxic / max(toxic + clean, 1))
    ratio = 2 * (F.col("t") * F.log(F.col("t") / expected) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (F.col("t") + F.col("c") - expected))).otherwise(0.0))
    counts = picked.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    # No more than the words of the drawn rows, of which few are that telling.
    best = counts.where((F.col("t") >= LEAST) & (odds >= ODDS) & (ratio >= RATIO - 0.1)).collect() if toxic and clean else []
    lexicon = Lexicon.of(learn_terms([tuple(r) for r in best], toxic, clean))

    def take(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = lexicon.features(texts(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(rows), type=pa.list_(pa.float64()))], ["toxic", "x"])

    got = sorted((r[0], tuple(r[1])) for r in picked.mapInArrow(take, "toxic int, x array<double>").collect())
    x, y = np.array([r[1] for r in got]).reshape(len(got), 8), np.array([r[0] for r in got], dtype=float)
    return Judge(lexicon, *logistic(x, y))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """docs with score (0 to 1, higher: toxic likelier) and predicted (1 from 0.5 on).

    `learn` (over the id column) says which labels may be learned from; the lexicon and the regression are fitted on a
    bounded sample of them, and every whole text is scored from the text alone. Null and empty texts get the score of a
    text without a hit; without labels every score is 0.5. Repeated rows stay, columns pass through (score and predicted
    are replaced), repeated labels of an id count once (the largest), an empty table gives no rows.

    A term of FUZZY_LENGTH letters or more is met with one edit as well; shorter terms and stems as they are. What stands
    between two quotation marks counts as quoted up to QUOTED words; beyond these the marks are taken for unpaired ones.
    """
    judge = fit_judge(docs, labels, learn, id_col, text_col, rows)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = part.schema.get_field_index(text_col)
            for k in range(0, part.num_rows, 2000):
                cut = part.slice(k, 2000)
                score = judge.score(texts(cut.column(at)))
                yield pa.RecordBatch.from_arrays([*[cut.column(i) for i in range(len(kept))], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    inner = docs.select(*kept)
    schema = T.StructType([*inner.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return inner.mapInArrow(run, schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = remainder("doc_id", 5) == 0
    found = score_toxicity(docs.select("doc_id", "text"), labels, ~held)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
