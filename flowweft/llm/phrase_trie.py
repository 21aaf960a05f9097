"""Phrases of words that stand together more often than their parts suggest, counted in HAT-tries.

A task counts the phrases of its texts in one trie a language. Its inner nodes branch by word numbers; below them hang
hash containers of the rest of a phrase. A container that grows past a bound bursts: the words that begin most of its
rows get containers of their own. When a task's tries hold too much, the largest subtrees go out whole, as runs sorted by
words, and their memory is free again. The runs are tables; they are merged per range of phrases (a prefix, or a part of a
prefix that has many phrases), so no word and no pair of words has to fit into one task.

Phrases of three words are counted in a second pass, and only where both pairs in them may be frequent: a phrase is no
more frequent than its parts. The pairs are told by a bit table of fixed size, whose false alarms cost work but no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize

# What ends a piece, what parts words, which letters have a lower case.
STOPS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"

_PLAIN = bytes.maketrans(UPPER + STOPS + BLANKS, LOWER + b"." * len(STOPS) + b" " * len(BLANKS))
_BITS = 21  # of a word's number; three fill a key
_WORD = (1 << _BITS) - 1
_ENTRY = "lang string, phrase string, f long"


class Words(dict):
    """Numbers of words from 1 on, in the order met; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})
        self.names, self.hashes = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return number


class Node:
    """Counts of phrases of ``width`` word numbers, packed: a hash container, and a node for each word that burst out of it."""

    __slots__ = ("width", "burst", "table", "children")

    def __init__(self, width: int, burst: int):
        self.width, self.burst = width, burst
        self.table: dict[int, int] = {}
        self.children: dict[int, Node] = {}

    def __len__(self) -> int:
        return len(self.table) + sum(map(len, self.children.values()))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add the counts of keys, which are sorted and different."""
        if self.children:
            shift = _BITS * (self.width - 1)
            heads = keys >> shift
            own = np.zeros(len(keys), bool)
            for head in self.children.keys() & set(heads.tolist()):
                a, b = np.searchsorted(heads, [head, head + 1]).tolist()
                self.children[head].add(keys[a:b] & ((1 << shift) - 1), counts[a:b])
                own[a:b] = True
            keys, counts = keys[~own], counts[~own]
        table = self.table
        known = table.get
        for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
            table[key] = known(key, 0) + n
        if self.width > 1 and len(table) > self.burst:
            self._burst()

    def _burst(self) -> None:
        shift = _BITS * (self.width - 1)
        keys = np.fromiter(self.table, np.int64, len(self.table))
        heads, size = np.unique(keys >> shift, return_counts=True)
        for head in heads[size * 64 > self.burst].tolist():
            self.children[head] = Node(self.width - 1, self.burst)
        rest = {}
        for key, n in self.table.items():
            child = self.children.get(key >> shift)
            if child is None:
                rest[key] = n
            else:
                child.table[key & ((1 << shift) - 1)] = n
        self.table = rest
        if len(rest) > self.burst // 2:
            self.burst *= 2  # many words of few phrases: the container is as good as it gets
        for child in self.children.values():
            if child.width > 1 and len(child.table) > child.burst:
                child._burst()

    def take(self, prefix: int = 0) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """All keys, with the prefix before them, and counts; the node is empty afterwards."""
        base = prefix << (_BITS * self.width)
        keys = [np.fromiter(self.table.keys(), np.int64, len(self.table)) + base]
        counts = [np.fromiter(self.table.values(), np.int64, len(self.table))]
        for head, child in self.children.items():
            more = child.take((prefix << _BITS) | head)
            keys += more[0]
            counts += more[1]
        self.table, self.children = {}, {}
        return keys, counts


class PhraseCounter:
    """Counts of the phrases of ``sizes`` words in the texts of one language.

    ``pairs``: bit table of the pairs that may stand in a phrase of three words (see ``pair_places``).
    """

    def __init__(self, sizes: tuple[int, ...], pairs: np.ndarray | None = None, salt: np.uint64 = np.uint64(0), burst: int = 100_000, slice_bytes: int = 2_000_000):
        self.sizes, self.pairs, self.salt, self.slice_bytes = sizes, pairs, salt, slice_bytes
        self.width, self.burst = max(sizes), burst
        self.n = 0
        self.start()

    def start(self) -> None:
        self.words = Words()
        self.root = Node(self.width, self.burst)

    def count(self, texts: list[bytes]) -> Iterator[None]:
        """Count whole texts; stops after each slice of their words, so that the caller may spill."""
        data = b"\n".join([*texts, b""]).translate(_PLAIN).replace(b".", b" . ")
        at, before = 0, []
        while at < len(data):
            end = len(data)
            if end - at > self.slice_bytes:
                end = data.rfind(b" ", at, at + self.slice_bytes) + 1 or data.find(b" ", at) + 1 or end
            tokens = before + data[at:end].split()
            ids = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
            self.n += int(np.count_nonzero(ids[len(before):]))
            self._add(ids, len(before))
            before, at = tokens[max(0, len(tokens) - self.width + 1):] if self.width > 1 else [], end
            yield

    def _add(self, ids: np.ndarray, known: int) -> None:
        """Count the phrases that end after the first ``known`` words."""
        found, hashes = [], None
        for size in self.sizes:
            first = max(0, known - size + 1)
            parts = [ids[first + i:len(ids) - size + 1 + i] for i in range(size)]
            good = np.logical_and.reduce([p > 0 for p in parts])
            if size == 3 and self.pairs is not None and good.any():
                if hashes is None:
                    hashes = np.array(self.words.hashes, np.uint64)
                near = pair_places(hashes[ids[:-1]], hashes[ids[1:]], self.salt, len(self.pairs) * 8)
                likely = self.pairs[near >> 3] >> (near & 7).astype(np.uint8) & 1 > 0
                good &= likely[first:len(ids) - 2] & likely[first + 1:len(ids) - 1]
            key = np.zeros(np.count_nonzero(good), np.int64)
            for i, part in enumerate(parts):
                key |= part[good] << (_BITS * (self.width - 1 - i))
            found.append(key)
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        self.root.add(keys, counts)

    def full(self) -> bool:
        """Whether the next slice could use up the numbers of words."""
        return len(self.words.names) + self.slice_bytes // 2 + self.width > _WORD

    def subtrees(self) -> list[tuple[int, int | None]]:
        """(rows, first word) of every subtree below the root, the root's own container as None."""
        return [(len(self.root.table), None), *[(len(c), head) for head, c in self.root.children.items()]]

    def spill(self, heads: list[int | None]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Runs (phrases sorted by words, counts) of whole subtrees, which are empty afterwards."""
        order = np.array(sorted(range(len(self.words.names)), key=self.words.names.__getitem__))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))  # the end of a piece, here of a shorter phrase, is the empty word and stays 0
        names = pa.array(self.words.names, pa.binary()).cast(pa.string()).take(pa.array(order))
        for head in heads:
            if head is None:
                keys, counts = [np.fromiter(self.root.table.keys(), np.int64)], [np.fromiter(self.root.table.values(), np.int64)]
                self.root.table = {}
            else:
                keys, counts = self.root.children.pop(head).take(head)
            key, n = np.concatenate(keys), np.concatenate(counts)
            ranked = np.zeros(len(key), np.int64)
            for i in range(self.width):
                ranked |= place[key >> (_BITS * i) & _WORD] << (_BITS * i)
            by = np.argsort(ranked)
            ranked, n = ranked[by], n[by]
            for a in range(0, len(ranked), 50_000):
                part, phrases = ranked[a:a + 50_000], None
                for i in reversed(range(self.width)):
                    word = part >> (_BITS * i) & _WORD
                    text = names.take(pa.array(word))
                    if phrases is not None:
                        text = pc.if_else(pa.array(word > 0), pc.binary_join_element_wise(phrases, text, " "), phrases)
                    phrases = text
                yield phrases, n[a:a + 50_000]


def pair_places(first: np.ndarray, second: np.ndarray, salt: np.ndarray, bits: int) -> np.ndarray:
    """Places of pairs of words, given by their hashes, in a bit table; ``salt`` is the language's hash."""
    with np.errstate(over="ignore"):
        x = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second * np.uint64(0xD1B54A32D192ED03) + salt)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(24)) % np.uint64(bits)).astype(np.int64)


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def phrase_runs(docs: DataFrame, sizes: tuple[int, ...], pairs=None, most: int = 1_500_000, at_once: int = 4_000_000) -> DataFrame:
    """(lang, phrase, f): runs of phrase counts, one or more a task; the empty phrase has the number of words.

    ``docs``: lang, text. ``most``: entries that a task's tries hold; then the largest subtrees are spilled until half is
    left. ``pairs``: broadcast bit table. ``at_once``: bytes of text that are gathered before they are counted.
    """

    def batch(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrases, pa.array(n, pa.int64())], ["lang", "phrase", "f"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, PhraseCounter] = {}
        waiting: dict[str, list[bytes]] = {}
        held = 0
        table = None if pairs is None else np.frombuffer(pairs.value, np.uint8)

        def work() -> Iterator[pa.RecordBatch]:
            for lang, texts in waiting.items():
                if lang not in counters:
                    counters[lang] = PhraseCounter(sizes, table, _salt(lang))
                for _ in counters[lang].count(texts):
                    if counters[lang].full():
                        yield from out(lang, None)
                    yield from make_room()
            waiting.clear()

        def make_room() -> Iterator[pa.RecordBatch]:
            trees = sorted(((n, lang, head) for lang, c in counters.items() for n, head in c.subtrees()), key=lambda t: -t[0])
            left, chosen = sum(t[0] for t in trees), {}
            if left > most:
                for n, lang, head in trees:
                    if left > most // 2:
                        chosen.setdefault(lang, []).append(head)
                        left -= n
                for lang, heads in chosen.items():
                    yield from out(lang, heads)

        def out(lang: str, heads: list[int | None] | None) -> Iterator[pa.RecordBatch]:
            counter = counters[lang]
            for phrases, n in counter.spill([h for _, h in counter.subtrees()] if heads is None else heads):
                yield batch(lang, phrases, n)
            if heads is None:
                counter.start()

        for rows in batches:
            for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                waiting.setdefault(lang, []).append(text)
                held += len(text)
                if held >= at_once:
                    yield from work()
                    held = 0
        yield from work()
        for lang, counter in counters.items():
            yield from out(lang, None)
            yield batch(lang, pa.array([""], pa.string()), np.array([counter.n]))

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(count, _ENTRY)


def merge_runs(runs: DataFrame, least: int) -> DataFrame:
    """Counts of at least ``least`` from written runs, and the numbers of words, merged per range of phrases."""
    ranged = runs.repartitionByRange("phrase", "lang")
    return ranged.groupBy("phrase", "lang").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def pair_table(grams: DataFrame, bits: int) -> np.ndarray:
    """Bit table of the pairs of words in ``grams``. What comes to the driver is the table, whatever the number of pairs."""
    segment = min(bits, 1 << 20)

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            halves = [p.split(" ") for p in frame["phrase"]]
            first, second = (np.array([xxhash.xxh3_64_intdigest(h[i].encode()) for h in halves], np.uint64) for i in (0, 1))
            salts = np.array([_salt(lang) for lang in frame["lang"]], np.uint64)
            at = pair_places(first, second, salts, bits)
            yield pd.DataFrame({"segment": at // segment, "byte": at % segment >> 3, "value": 1 << (at & 7)})

    def write(group: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(segment >> 3, np.uint8)
        part[group["byte"]] = group["value"]
        return pd.DataFrame({"segment": group["segment"].iloc[:1], "part": [part.tobytes()]})

    marks = grams.filter("phrase LIKE '% %'").mapInPandas(places, "segment long, byte long, value long")
    ones = marks.groupBy("segment", "byte").agg(F.expr("bit_or(value)").alias("value"))
    table = np.zeros(bits >> 3, np.uint8)
    for row in ones.groupBy("segment").applyInPandas(write, "segment long, part binary").toLocalIterator():
        table[row.segment * (segment >> 3):(row.segment + 1) * (segment >> 3)] = np.frombuffer(row.part, np.uint8)
    return table


def _cuts(candidates: DataFrame) -> DataFrame:
    """A row per cut of a phrase into two parts: k words and the rest."""
    words = F.size(F.split("phrase", " "))
    cut = lambda k: F.struct(
        F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("first"),
        F.expr(f"substr(phrase, length(substring_index(phrase, ' ', {k})) + 2)").alias("rest"),
    )
    cuts = F.when(words == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))
    return candidates.withColumn("c", F.explode(cuts)).select("lang", "phrase", "a", "c.*")


def phrase_counts(docs: DataFrame, least: int, bits: int = 1 << 27, most: int = 1_500_000) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all words and pairs that occur ``least`` times, with the numbers of words at the empty
    phrase, and of all phrases of three words that do."""
    spark = docs.sparkSession
    small = materialize(merge_runs(materialize(phrase_runs(docs, (1, 2), most=most)), least))
    pairs = spark.sparkContext.broadcast(pair_table(small, bits).tobytes())
    large = materialize(merge_runs(materialize(phrase_runs(docs, (3,), pairs, most)), least).filter("phrase <> ''"))
    return small, large


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, scale: int = 1_000_000, **options) -> DataFrame:
    """The phrases of two or three words of each language that score highest: lang, rank, phrase, a, l, r, n, score.

    A phrase that occurs a times and is cut into parts that occur l and r times scores floor(scale a a / (l r)); the
    cut that scores lowest counts, of equal ones the first. Phrases inside a longer one that occurs in ``share`` of 100
    of their places are left out. Ranks are by score, then a, then the phrase's bytes. A null language is ``und``, a null
    text empty; blank texts, texts without two words in a piece and empty tables give no phrases. Repeated rows count
    each; other columns are not read.
    """
    small, large = phrase_counts(docs.select("lang", "text"), least, **options)
    parts = small.filter("phrase <> ''").unionByName(large)
    candidates = parts.filter("phrase LIKE '% %'").withColumnRenamed("f", "a")
    inner = F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)))
    longer = large.select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = candidates.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"coalesce(100 * longer < {share} * a, true)"))
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    scored = (
        _cuts(free.select("lang", "phrase", "a"))
        .join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .withColumn("over", F.lit(scale).cast("decimal(7,0)") * exact("a") * exact("a")).withColumn("under", exact("l") * exact("r"))
        .withColumn("score", F.expr("`over` div under"))
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
        .select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's first rows are among the first rows of its parts.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored.withColumn("part", part).withColumn("rn", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order)))
    ranked = first.filter(F.col("rn") <= top).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    n = small.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.filter(F.col("rank") <= top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), occurrences AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM words
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM words
), counted AS (
  SELECT lang, size, phrase, count(*) AS f FROM occurrences GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS part1, array_to_string(w[2:size], ' ') AS part2 FROM candidates
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE size = 3
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.part1 JOIN counted y ON y.lang = c.lang AND y.phrase = c.part2
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE size = 3
  UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE size = 3
), longer AS (
  SELECT lang, phrase, max(a) AS f FROM inside GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
