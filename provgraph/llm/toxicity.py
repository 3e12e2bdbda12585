"""Toxicity scores from a learned lexicon, matched by a Levenshtein automaton over its trie.

From a bounded sample of labelled rows the driver learns the terms (whole words, and stems that
start many words) that mark toxic texts, and a logistic model over what a text has of them. The
Levenshtein automata of all terms, intersected with the lexicon trie, form one automaton whose
states are made when first needed; a word is read once, whatever the size of the lexicon. Each
hit gets the score of its context window: a quoted or reported term counts less than an abusive
one, and a misspelled term has a feature of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows of either class that the model is fitted on, taken by hash of the id.
MAX_TOXIC, MAX_CLEAN = 1500, 4500
MIN_TERM_DOCS, MIN_LOG_ODDS, MIN_EVIDENCE = 3, 2.0, 14.0
STEM_LENGTHS = range(4, 9)
#: Only whole terms of at least this length are matched with an edit, and only if at most this share
#: of the clean sample has such a near miss; it counts as that much of an exact hit.
FUZZY_LENGTH, MAX_EDITS, MAX_NEAR_MISSES, MISSPELLED = 5, 1, 0.001, 0.7
#: Characters on each side of a hit that decide whether it is quoted, and what a quoted hit counts.
CONTEXT, QUOTED = 60, 0.25
FOLDS = 5

_TOKEN = re.compile(r"\w+")
#: Words with signs in place of letters, such as m@ron, b*d or $cum.
_MASK = re.compile(r"[@$*!]")
_MASKED = re.compile(r"[@$]?\w+(?:[@$*!]+\w+)+|[@$]\w+")
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
_REPORT = re.compile(r"\b(said|says|wrote|writes|called|calls|quote[ds]?|quoting|dit|écrit|sagte|schrieb|dijo|escribió)\b")
_LEET = str.maketrans("0134578@$!", "oieastbasi")
_CACHE = 400_000


@dataclass
class State:
    """A set of (trie node, edits) pairs that the characters read so far can lead to."""

    items: frozenset
    whole: tuple | None = None
    stem: float = 0.0
    go: dict = field(default_factory=dict)


class Lexicon:
    """Terms with weights in a trie; ``match`` runs the automaton over a word."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], fuzzy: frozenset[str] | None = None):
        """``fuzzy``: the terms that may be misspelled; None: all words that are long enough."""
        self.words, self.stems = words, stems
        self.fuzzy = frozenset(w for w in words if len(w) >= FUZZY_LENGTH) if fuzzy is None else fuzzy
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, tuple[float, str]] = {}
        self.stem_at: dict[int, float] = {}
        self.fuzzy_at: set[int] = set()
        for term, weight in words.items():
            self.word_at[end := self._add(term)] = (weight, term)
            if term in self.fuzzy:
                self.fuzzy_at.add(end)
        for term, weight in stems.items():
            self.stem_at[self._add(term)] = weight
        self._reset()

    def __reduce__(self):
        return Lexicon, (self.words, self.stems, self.fuzzy)

    def _add(self, term: str) -> int:
        at = 0
        for c in term:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
            at = self.children[at][c]
        return at

    def _reset(self) -> None:
        self.states: dict[frozenset, State] = {}
        self.start = self._state({(0, 0)})
        self.seen: dict[str, tuple[float, int, str] | None] = {}

    def _state(self, items: set[tuple[int, int]]) -> State | None:
        queue = list(items)
        while queue:  # a term's character that the word lacks
            node, edits = queue.pop()
            if edits < MAX_EDITS:
                for child in self.children[node].values():
                    if (child, edits + 1) not in items:
                        items.add((child, edits + 1))
                        queue.append((child, edits + 1))
        if not items:
            return None
        key = frozenset(items)
        if key not in self.states:
            whole = max(((-e, *self.word_at[n]) for n, e in key if n in self.word_at and (e == 0 or n in self.fuzzy_at)), default=None)
            self.states[key] = State(key, whole, max((self.stem_at.get(n, 0.0) for n, e in key if e == 0), default=0.0))
        return self.states[key]

    def _step(self, state: State, c: str) -> State | None:
        items = set()
        for node, edits in state.items:
            if (child := self.children[node].get(c)) is not None:
                items.add((child, edits))
            if edits < MAX_EDITS:
                items.add((node, edits + 1))
                items.update((child, edits + 1) for child in self.children[node].values())
        return self._state(items)

    def match(self, word: str) -> tuple[float, int, str] | None:
        """(weight, edits, term) of the best term for a lower-cased word, or None. Stems match exactly."""
        if word in self.seen:
            return self.seen[word]
        if len(self.seen) >= _CACHE or len(self.states) >= _CACHE:
            self._reset()
        state, stem = self.start, 0.0
        for c in word:
            try:
                state = state.go[c]
            except KeyError:
                state.go[c] = after = self._step(state, c)
                state = after
            if state is None:
                break
            stem = max(stem, state.stem)
        found = None
        if state is not None and state.whole is not None:
            found = (state.whole[1], -state.whole[0], state.whole[2])
        if stem and (found is None or found[1] or stem > found[0]):
            found = (stem, 0, "")
        if found is None and not word.isalpha() and (plain := word.translate(_LEET)) != word and plain.isalpha():
            other = self.match(plain)
            found = other and (other[0], max(1, other[1]), other[2])
        self.seen[word] = found
        return found

    def match_masked(self, word: str) -> tuple[float, int, str] | None:
        """The best term for a word with signs in place of letters: read as letters, or the stars as one wrong letter."""
        plain = word.translate(_LEET)
        found = self.match(plain) if plain.isalpha() else None
        if found is None and "*" in word:
            at = self.match(plain)
            found = at if at and at[2] else None
        return found and (found[0], max(1, found[1]), found[2])


class Quotes:
    """Tells which places of a text are quoted; double quotes and line ends are looked up once for all hits."""

    def __init__(self, text: str):
        self.text = text
        self.marks: np.ndarray | None = None

    def _odd_before(self, at: int) -> bool:
        """Whether the line of ``at`` has an odd number of straight double quotes before it."""
        if self.marks is None:
            self.marks = np.array([m.start() for m in re.finditer('"', self.text)], np.int64)
        line = self.text.rfind("\n", 0, at) + 1
        return bool((np.searchsorted(self.marks, at) - np.searchsorted(self.marks, line)) % 2)

    def around(self, start: int, end: int) -> bool:
        """Whether a hit lies between an opening and a closing quote, or after a word of reporting with one."""
        text = self.text
        before, after = text[max(0, start - CONTEXT) : start].rpartition("\n")[2], text[end : end + CONTEXT].partition("\n")[0]
        opened = max((before.rfind(q) for q in _OPEN), default=-1)
        if opened < 0 or not any(q in after for q in _CLOSE):
            return False
        inside = before[opened + 1 :]
        if any(q in inside for q in "”»") or (before[opened] == '"' and self._odd_before(max(0, start - len(inside) - 1))):
            return bool(_REPORT.search(before))
        return True


N_FEATURES = 6


def features(lexicon: Lexicon, text: str | None) -> np.ndarray:
    """What a whole text has of the lexicon, none of it negative; zeros for null and empty.

    A misspelled hit counts ``MISSPELLED`` of an exact one, a quoted hit ``QUOTED`` of another.
    """
    out = np.zeros(N_FEATURES)
    low = (text or "").lower()
    tokens = _TOKEN.findall(low)
    hits = {w: m for w in set(tokens) if (m := lexicon.match(w))}
    masked = {w: m for w in set(_MASKED.findall(low)) if (m := lexicon.match_masked(w))} if _MASK.search(low) else {}
    if not hits and not masked:
        return out
    count = strength = 0.0
    best: dict[str, float] = {}
    quotes = Quotes(low)
    for pattern, known in ((_TOKEN, hits), (_MASKED, masked)):
        if not known:
            continue
        for found in pattern.finditer(low):
            m = known.get(word := found.group())
            if m is None:
                continue
            share = (QUOTED if quotes.around(found.start(), found.end()) else 1.0) * (MISSPELLED if m[1] else 1.0)
            count += share
            strength += share * m[0]
            best[word] = max(best.get(word, 0.0), share * m[0])
    values = list(best.values())
    out[:] = [math.log1p(count), math.log1p(strength), math.log1p(sum(values)), max(values) / 4, sum(values) / len(values) / 4, math.log1p(100 * count / len(tokens))]
    return out


def learn_lexicon(texts: list[str], labels: np.ndarray) -> Lexicon:
    """Terms by document frequency: at least 3 toxic texts, log odds of 2, and a G statistic of 14. Copies count once."""
    once = dict.fromkeys(zip(texts, labels.tolist(), strict=True))
    texts, labels = [t for t, _ in once], np.array([y for _, y in once])

    def terms(text: str) -> set[str]:
        words = {w for w in _TOKEN.findall(text.lower()) if len(w) >= 3 and not w.isdigit()}
        return words | {w[:k] + "*" for w in words for k in STEM_LENGTHS if k < len(w)}

    toxic, clean = Counter(), Counter()
    for text, y in zip(texts, labels, strict=True):
        if y:
            toxic.update(terms(text))
    toxic = Counter({t: n for t, n in toxic.items() if n >= MIN_TERM_DOCS})
    for text, y in zip(texts, labels, strict=True):
        if not y:
            clean.update(terms(text) & toxic.keys())
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    found = []  # no bound of their number: the sample bounds it
    for t, a in toxic.items():
        b = clean[t]
        odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        mean = (a + b) / (n1 + n0)
        g = 2 * (a * math.log(a / (n1 * mean)) + (b * math.log(b / (n0 * mean)) if b else 0))
        if odds >= MIN_LOG_ODDS and g >= MIN_EVIDENCE:
            found.append((g, t, odds))
    found.sort(key=lambda x: (-x[0], x[1]))
    lexicon = Lexicon({t: w for _, t, w in found if t[-1] != "*"}, {t[:-1]: w for _, t, w in found if t[-1] == "*"})
    near = Counter()
    for text, y in zip(texts, labels, strict=True):
        if not y:
            near.update({m[2] for w in set(_TOKEN.findall(text.lower())) if (m := lexicon.match(w)) and m[1]})
    return Lexicon(lexicon.words, lexicon.stems, frozenset(t for t in lexicon.fuzzy if near[t] <= MAX_NEAR_MISSES * n0))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        z = float(self.weights[0] + features(self.lexicon, text) @ self.weights[1:])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(texts: list[str], labels: Iterable[int]) -> Model:
    """Lexicon and logistic weights. Features of each half come from the other half's lexicon."""
    y = np.array(list(labels), np.float64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if len(set(y.tolist())) < 2:
        return Model(Lexicon({}, {}), np.array([math.log(rate / (1 - rate)), *[0.0] * N_FEATURES]))
    half = np.zeros(len(y), bool)
    for c in (0, 1):
        half[np.flatnonzero(y == c)[::2]] = True
    x = np.zeros((len(y), N_FEATURES))
    for part in (half, ~half):
        other = learn_lexicon([t for t, p in zip(texts, part, strict=True) if not p], y[~part])
        for k in np.flatnonzero(part):
            x[k] = features(other, texts[k])
    x = np.column_stack([np.ones(len(y)), x])
    use = np.ones(x.shape[1], bool)
    while True:  # every feature speaks for toxicity; one that would speak against it is left out
        w = np.zeros(x.shape[1])
        w[use] = _ridge_logistic(x[:, use], y)
        against = use & (w < 0)
        against[0] = False
        if not against.any():
            break
        use &= ~against
    return Model(learn_lexicon(texts, y), w)


def _ridge_logistic(x: np.ndarray, y: np.ndarray, strength: float = 0.05) -> np.ndarray:
    """Newton steps; the first column is the constant and is not held back."""
    w = np.zeros(x.shape[1])
    ridge = np.array([1e-6, *[strength] * (x.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Fold 0 of five by the CRC-32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on at most ``max_toxic + max_clean`` labelled rows outside the held-out fold.

    Only their ids (chosen by hash among the labels) are broadcast, and only their texts reach
    the driver. Labels that are null or without a document are left out; of several labels of an
    id the highest counts, and of several texts the least. The number of terms has no bound but
    the sample.
    """
    known = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("y"))
    by_hash = [F.xxhash64("label_id"), F.col("label_id")]
    chosen = known.filter("y = 1").orderBy(*by_hash).limit(max_toxic).unionByName(known.filter("y = 0").orderBy(*by_hash).limit(max_clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).groupBy("label_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    sample = rows.toPandas().sort_values("label_id")
    return fit([t or "" for t in sample["text"]], sample["y"].astype(int))


def scored(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """(*keep, score) per row; only the text is looked at."""
    out = docs.select(*keep, F.col("text").alias("_text"))
    fields = [f for f in out.schema.fields if f.name != "_text"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model.score(t) for t in batch.column("_text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score)], [*names, "score"])

    return out.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"]))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Other columns are not looked at, whatever they are called; an empty table gives an empty table.
    Null and empty texts get the score of a text without a hit. Without labels of both classes
    every score is the (smoothed) share of toxic ones. Repeated rows get equal scores.
    """
    out = scored(docs, train(docs, labels), F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
