"""Toxicity by a lexicon that also catches misspelled terms, and the context a term stands in.

The lexicon is learned: words that stand in toxic documents far more often than in others. Its terms form a trie. A
Levenshtein automaton walks the trie while it reads a word: its states are (trie node, edits so far), made
deterministic as words need them, so one pass over the letters of a word compares it with all terms at once and
stops at the first letter that no term is near to.

A hit counts by its term's strength, less for every edit. A window around it tells a quotation (quotation marks,
words of reporting) from abuse (address, further hits). A logistic regression over the sums for abuse and quotation
gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

TOKEN = re.compile(r"[$@*]?\w+(?:[*@$!]+\w+)*[*$]?")
EDGES = "$@*"
# What may stand for a letter that a writer hides; "*" stands for any.
LOOKS = {"@": "a", "4": "a", "8": "b", "3": "e", "9": "g", "!": "il", "1": "il", "0": "o", "$": "s", "5": "s", "7": "t", "v": "u", "u": "v"}
WINDOW_CHARS, WINDOW_WORDS = 160, 12
QUOTES = [('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("‘", "’"), ("‹", "›")]
REPORTING = frozenset(
    "said says saying called calls word words term terms quote quoted quotes wrote slur insult meaning dit mot mots "
    "écrit appelé sagte wort wörter schrieb nannte begriff dijo palabra palabras escribió llamó".split()
)
ADDRESS = frozenset("you your yours u ur du dich dein ihr euch tu toi ton vous votre tú usted ustedes vosotros".split())


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def masks_allowed(term: str) -> int:
    """Letters that may be hidden behind look-alikes: one even where no other edit is allowed."""
    return max(1, edits_allowed(term))


def _hides(written: str, letter: str) -> bool:
    return written == "*" or letter in LOOKS.get(written, "")


class LexiconAutomaton:
    """Deterministic Levenshtein automaton over the trie of a lexicon, built as it is used.

    A member of a state is (trie node, whether any edit was more than a hidden letter) with its fewest edits. Terms that
    are too short for edits match by hidden letters only.
    """

    def __init__(self, terms: Iterable[str], remember: int = 400_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.budget = [[0, 0]]  # most hidden letters, most edits of any term below a node
        for term in sorted(set(terms)):
            node, most = 0, (masks_allowed(term), edits_allowed(term))
            for c in ["", *term]:
                if c and c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.budget.append([0, 0])
                node = self.children[node][c] if c else node
                self.budget[node] = [max(x) for x in zip(self.budget[node], most, strict=True)]
            self.term[node] = term
        self.letters = {c for x in self.children for c in x} | set(LOOKS) | {"*"}
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.found: list[tuple[str, int] | None] = []
        self.moves: list[dict[str, int]] = []
        self.dead = self._state({})
        self.start = self._state(self._closed({(0, False): 0}))
        self.remember, self.harmless = remember, set()
        self.hits: dict[str, tuple[str, int]] = {}

    def _reach(self, at: dict[tuple[int, bool], int], node: int, edited: bool, e: int) -> bool:
        """Add a member unless a member of the same node allows no less."""
        if e > self.budget[node][edited] or e >= at.get((node, edited), 99) or (edited and e >= at.get((node, False), 99)):
            return False
        at[node, edited] = e
        return True

    def _closed(self, at: dict[tuple[int, bool], int]) -> dict[tuple[int, bool], int]:
        """Add what is reached by leaving out letters of the term."""
        todo = list(at)
        while todo:
            here = todo.pop()
            for child in self.children[here[0]].values():
                if self._reach(at, child, True, at[here] + 1):
                    todo.append((child, True))
        return at

    def _state(self, at: dict[tuple[int, bool], int]) -> int:
        key = frozenset(at.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            ends = []
            for (node, edited), e in at.items():
                term = self.term[node]
                if term and e <= (edits_allowed(term) if edited else masks_allowed(term)):
                    ends.append((e, term))
            self.found.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.states[key]

    def _move(self, state: int, letter: str) -> int:
        at: dict[tuple[int, bool], int] = {}
        for (node, edited), e in sorted(self.members[state]):
            self._reach(at, node, True, e + 1)  # a letter too many
            for c, child in self.children[node].items():
                if c == letter:
                    self._reach(at, child, edited, e)
                else:
                    self._reach(at, child, edited or not _hides(letter, c), e + 1)
        return self._state(self._closed(at))

    def match(self, word: str) -> tuple[str, int] | None:
        """(nearest term, edits); ties to the first term. None if no term is near."""
        state = self.start
        for c in word:
            c = c if c in self.letters else "\0"
            moves = self.moves[state]
            if c not in moves:
                moves[c] = self._move(state, c)
            state = moves[c]
            if state == self.dead:
                return None
        return self.found[state]

    def near(self, words: set[str]) -> dict[str, tuple[str, int]]:
        """The words that match, with their matches; what did not match is remembered."""
        new = words - self.harmless
        if len(self.harmless) > self.remember:
            self.harmless.clear()
        out = {}
        for word in new:
            hit = self.hits.get(word) or self.match(word) or self.match(word.strip(EDGES))
            if hit is None:
                self.harmless.add(word)
            else:
                out[word] = hit
                if len(self.hits) < self.remember:
                    self.hits[word] = hit
        return out


def _quoted(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] stands between quotation marks of one kind on its line, within the window."""
    before = text[max(0, a - WINDOW_CHARS):a].rpartition("\n")[2]
    after = text[b:b + WINDOW_CHARS].partition("\n")[0]
    for left, right in QUOTES:
        if left == right:
            if before.count(left) % 2 and left in after:
                return True
        elif before.rfind(left) > before.rfind(right) and right in after:
            return True
    return False


class ToxicityModel:
    """Lexicon (term -> strength from 0 to 1), words near a term that are known to be harmless, and weights."""

    def __init__(self, lexicon: dict[str, float], harmless: Iterable[str] = (), weights: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.lexicon, self.harmless, self.weights = lexicon, frozenset(harmless), weights
        self._automaton: LexiconAutomaton | None = None

    def __getstate__(self):
        return self.lexicon, self.harmless, self.weights

    def __setstate__(self, state):
        self.lexicon, self.harmless, self.weights = state
        self._automaton = None

    def features(self, text: str | None) -> tuple[float, float]:
        """Logarithms of 1 plus the strengths of abuse and of quotation in a whole text."""
        if self._automaton is None:
            self._automaton = LexiconAutomaton(self.lexicon)
            self._automaton.harmless.update(self.harmless)
        lower = (text or "").lower()
        near = self._automaton.near(set(TOKEN.findall(lower)))
        near = {w: x for w, x in near.items() if w not in self.harmless and w.strip(EDGES) not in self.harmless}
        if not near:
            return 0.0, 0.0
        tokens = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(lower)]
        places = [i for i, t in enumerate(tokens) if t[0] in near]
        abuse = quotation = 0.0
        for k, i in enumerate(places):
            word, a, b = tokens[i]
            term, edits = near[word]
            around = {t[0].strip(EDGES) for t in tokens[max(0, i - WINDOW_WORDS):i + WINDOW_WORDS + 1]}
            context = 1.0 - 0.6 * _quoted(lower, a, b) - 0.2 * bool(around & REPORTING) + 0.2 * bool(around & ADDRESS)
            context += 0.2 * any(0 <= j < len(places) and j != k and abs(places[j] - i) <= WINDOW_WORDS for j in (k - 1, k + 1))
            strength = self.lexicon[term] * 0.7**edits
            if context >= 0.7:
                abuse += strength * min(context, 1.4)
            else:
                quotation += strength
        return math.log1p(abuse), math.log1p(quotation)

    def score(self, text: str | None) -> float:
        a, q = self.features(text)
        z = self.weights[0] * a + self.weights[1] * q + self.weights[2]
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


COUNTS = "word string, place long, toxic int"


def word_places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, hash of its neighbours, toxic) for the first place of each word in each document.

    Copies of a passage give the same place, so a group of copies is counted about once.
    """
    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            tokens = [t.strip(EDGES) for t in TOKEN.findall(text.lower())]
            first: dict[str, int] = {}
            for i, token in enumerate(tokens):
                first.setdefault(token, i)
            padded = ["", *tokens, ""]
            words = [w for w in first if len(w) >= 3 and not w.isdigit()]
            near = [f"{padded[first[w]]} {padded[first[w] + 2]}" for w in words]
            yield pd.DataFrame({"word": pd.Series(words, dtype=object), "place": pd.util.hash_array(np.array(near, object)).astype("int64"), "toxic": int(toxic)})


def lower_bound(hits, n, z: float = 2.6):
    """Lower Wilson bound of a share."""
    p = hits / n
    middle = p + z * z / (2 * n)
    return (middle - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def learn(
    docs: DataFrame, labels: DataFrame, train_rows: int = 10_000, terms: int = 500, least_share: float = 0.5, least_spread: float = 0.02,
) -> ToxicityModel:
    """Fit a model on ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks; null texts and labels do not count.

    Uses about ``train_rows`` different texts (per label) at most, chosen by a hash of the text before texts are moved; copies
    with the same label count once. The lexicon has the
    words whose share of toxic places is ``least_share`` or more with confidence and whose toxic places are as many as
    ``least_spread`` of the toxic texts or more, at most ``terms``, strongest first. A null doc_id meets no label.
    Words near a term that occur in the sample without being terms are kept as harmless. Without rows of both labels the
    score is the share of toxic rows (0 if there are none).
    """
    marks = labels.filter("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    usable = docs.filter("text IS NOT NULL").select("doc_id", "text")
    hashes = usable.select("doc_id", F.xxhash64("text").alias("h"))
    rows = hashes.join(marks, "doc_id").select("h", "toxic").distinct().agg(F.count(F.lit(1)).alias("n")).first().n
    rate = min(1.0, train_rows / max(rows, 1))
    chance = F.xxhash64("text").cast("double") / F.lit(2.0**64) + 0.5
    chosen_texts = usable.filter((chance < rate) if rate < 1 else F.lit(True))
    sample = materialize(chosen_texts.join(marks, "doc_id").select("text", "toxic").distinct())
    places = sample.mapInPandas(word_places, COUNTS).groupBy("word", "place").agg(
        F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("n")
    )
    counted = materialize(places.groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n")))
    share = lower_bound(F.col("t"), F.col("t") + F.col("n"))
    seen = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    spread = F.col("t") >= least_spread * seen.get(1, 0)
    chosen = counted.withColumn("share", share).filter((F.col("share") >= least_share) & spread).orderBy(F.desc("share"), "word").limit(terms).collect()
    model = ToxicityModel({r.word: float(r.share) for r in chosen})

    def known(frames):
        automaton = LexiconAutomaton(model.lexicon)
        for frame in frames:
            near = automaton.near(set(frame["word"]))
            yield pd.DataFrame({"word": [w for w, (_, edits) in near.items() if edits]}, dtype=object)

    if chosen:  # bounded by the words of the sample
        model.harmless = frozenset(r.word for r in counted.filter("n > 0").select("word").mapInPandas(known, "word string").collect())

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: list(model.features(x)))

    ready = sample.select(array_to_vector(features("text")).alias("features"), F.col("toxic").cast("double").alias("label"))
    if len(seen) < 2:
        return ToxicityModel({}, (), (0.0, 0.0, 40.0 if seen.get(1) else -800.0))
    fitted = LogisticRegression(maxIter=50, regParam=1e-4).fit(materialize_vectors(ready))
    a, q = fitted.coefficients
    return ToxicityModel(model.lexicon, model.harmless, (float(a), float(q), float(fitted.intercept)))


def materialize_vectors(rows: DataFrame) -> DataFrame:
    """Write features once as plain columns: the regression reads them in every iteration."""
    from pyspark.ml.functions import vector_to_array

    plain = materialize(rows.select(vector_to_array("features").alias("f"), "label"))
    return plain.select(array_to_vector("f").alias("features"), "label")


def predict_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5) to every row; null and empty texts score as texts without hits."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype("float64")

    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
