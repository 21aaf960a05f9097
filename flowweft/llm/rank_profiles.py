"""Language identification by rank-order profiles.

A profile is a list of n-grams (one to three characters) in falling order of their counts. A document's profile is
compared to each language's by the out-of-place distance: the sum, over the document's n-grams, of how far apart the
two ranks are, with the profile's length as the distance of an n-gram that the language lacks. The nearest language
wins.

Text is lower-cased, and every run of characters that are not letters becomes one word mark, so digits, symbols and
layout carry no weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import free_name, release_memory

UNKNOWN = "und"
_BITS = 21  # a code point
_CHUNK = 200_000  # characters of a text that are counted at once
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams in a whole text. A key holds one to three code points, a word mark as 0."""
    keys: list[np.ndarray] = []
    carried = np.zeros(1, np.int64)  # a text starts after a word mark
    lower = (text or "").lower()
    for at in range(0, len(lower) + 1, _CHUNK):
        last = at + _CHUNK > len(lower)
        raw = np.frombuffer(lower[at:at + _CHUNK].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        codes = np.where(_letters()[raw], raw, 0)
        codes = np.concatenate([carried, codes, [0] if last else []]).astype(np.int64)
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        keep[: len(carried)] = True
        codes = codes[keep]
        fresh = np.arange(len(codes)) >= len(carried)  # n-grams that end in this part
        for n in (1, 2, 3):
            if len(codes) < n:
                continue
            key = codes[: len(codes) - n + 1].copy()
            for j in range(1, n):
                key = key << _BITS | codes[j: len(codes) - n + 1 + j]
            # No mark alone, and none in the middle.
            good = fresh[n - 1:] & ((n == 2) | (codes[n // 2: len(codes) - n + 1 + n // 2] != 0))
            keys.append(key[good] if n == 3 else key[good] | n << 3 * _BITS - 2)
        carried = codes[-2:]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, n = np.unique(np.concatenate(keys), return_counts=True)
    return found, n


def top_grams(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` commonest keys in rank order; ties by key."""
    if len(keys) > 4 * most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= floor], counts[counts >= floor]
    return keys[np.lexsort((keys, -counts))][:most]


def learn_profiles(labelled: DataFrame, most: int = 400, train_rows: int = 5_000, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Profiles (n-gram keys in rank order) per language, from rows with a language and a text.

    Fitted on about ``train_rows`` different texts of each language at most, chosen by a hash of the text; copies count
    once. Counts are combined map-side and again per n-gram, so only ``most`` n-grams a language reach the driver.
    """
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("_lang"), F.col(text).alias("_text")
    )
    rates = [  # as many as there are profiles
        F.when(F.col("_lang") == r["_lang"], F.lit(train_rows / r["n"]))
        for r in usable.select("_lang", F.xxhash64("_text").alias("_h")).distinct().groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()
    ]
    if not rates:
        return {}
    chance = F.pmod(F.xxhash64("_text"), F.lit(1_000_000)) / 1e6
    sample = usable.filter(chance < F.coalesce(*rates)).distinct()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def rows():
            for language, parts in held.items():
                keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in parts]), len(keys))
                yield pd.DataFrame({"lang": language, "gram": keys, "n": n.astype("int64")})

        for frame in frames:
            for language, one in zip(frame["_lang"], frame["_text"], strict=True):
                held.setdefault(language, []).append(gram_counts(one))
                size += len(held[language][-1][0])
            if size > 2_000_000:
                yield from rows()
                held, size = {}, 0
        yield from rows()

    counted = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted)
    profiles = {}
    for language in sorted(r["lang"] for r in counted.select("lang").distinct().collect()):  # one row a language
        best = counted.filter(F.col("lang") == language).orderBy(F.desc("n"), "gram").limit(most).collect()
        profiles[language] = np.array([r.gram for r in best], np.int64)
    return profiles


class Judge:
    """Distances of one text to all profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], most: int):
        self.names, self.most = sorted(profiles), most
        self.keys = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.rank = np.full((len(self.keys) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.rank[np.searchsorted(self.keys, profiles[name]), j] = np.arange(len(profiles[name]))

    def decide(self, text: str | None) -> tuple[str, float]:
        keys, counts = gram_counts(text)
        if not len(keys) or not self.names:
            return UNKNOWN, 0.0
        mine = top_grams(keys, counts, self.most)
        at = np.searchsorted(self.keys, mine)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != mine] = len(self.keys)
        theirs = self.rank[at]
        apart = np.where(theirs < 0, self.most, np.abs(theirs - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(apart.argmin())  # ties: the first name
        return self.names[best], 1.0 - float(apart[best]) / (self.most * len(mine))


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], most: int = 400, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row of ``docs``.

    A null text or one without letters gets ``und`` and 0. Else the score is 1 less the distance as a share of the
    largest possible one. Without profiles everything is ``und``. The whole text counts, however long. Columns named
    lang_pred or score are replaced.
    """
    judge = Judge(profiles, most)

    @F.pandas_udf("lang string, score double")
    def decide(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge.decide(x) for x in texts], columns=["lang", "score"])

    found: Column = decide(F.col(text))
    name = free_name(docs, "found")
    told = docs.withColumn(name, found)
    return told.withColumns({"lang_pred": F.col(name)["lang"], "score": F.col(name)["score"]}).drop(name)


def has_letters(text: str = "text") -> Column:
    """Whether a text is there and holds a letter, as n-grams see it."""

    @F.pandas_udf("boolean")
    def lettered(texts: pd.Series) -> pd.Series:
        return pd.Series([x is not None and any(map(str.isalpha, x)) for x in texts], dtype=bool)

    return lettered(F.col(text))


def least_scores(docs: DataFrame, profiles: dict[str, np.ndarray], most: int = 400, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """Per language, the lowest score of all documents that name it and are found to be in it.

    All rows count, not only those that profiles are fitted on. A language that no such document has gets the lowest
    bound of the others. A score of 0 (no n-gram in common) is none that a document can be found by, so bounds are positive.
    """
    named = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    found = predict_language(named, profiles, most, "_text").filter((F.col("lang_pred") == F.col("_lang")) & (F.col("score") > 0))
    least = {r["lang_pred"]: r["least"] for r in found.groupBy("lang_pred").agg(F.min("score").alias("least")).collect()}
    other = min(least.values(), default=float(np.nextafter(0.0, 1.0)))
    return {name: least.get(name, other) for name in profiles}


def keep_told(docs: DataFrame, profiles: dict[str, np.ndarray], least: dict[str, float], most: int = 400, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents with letters whose text bears out the language they name, or tells one where they name none.

    A language is told if the text's score reaches the least one of the language found. A document that names another
    language than the one told goes, as does one that names none and is told none. One that names a language stays if its text
    tells none, being too short or too odd to speak against it. Those that named no language name the one told from
    then on; all other columns stay.
    """
    judge = Judge(profiles, most)

    @F.pandas_udf("string")
    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, named in batches:
            keep = []
            for one, known in zip(texts, named, strict=True):
                if one is None or not any(map(str.isalpha, one)):
                    keep.append(None)
                    continue
                name, score = judge.decide(one)
                found = name if name != UNKNOWN and score >= least[name] else None
                keep.append(found if known is None else known if found in (None, known) else None)
            yield pd.Series(keep, dtype=object)
        release_memory()

    name = free_name(docs, "told")
    found = docs.withColumn(name, told(F.col(text), F.col(lang))).filter(F.col(name).isNotNull())
    return found.withColumn(lang, F.col(name)).select(*docs.columns)
