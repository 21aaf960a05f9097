import random
import re
from collections import Counter

import numpy as np
import pytest

from flowweft.llm import phrase_trie as P

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    """Counts per language and phrase of one to three words, by going through the texts."""
    found, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split("[.,;:!?\n-\r]", (r[1] or "").translate(LOW)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                found.update((lang, " ".join(words[i:i + size])) for i in range(len(words) - size + 1))
    return found, n


def brute(rows, least, top):
    found, n = counted(rows)
    out = []
    wide = {k: a for k, a in found.items() if k[1].count(" ") and a >= least}
    for (lang, phrase), a in wide.items():
        words = phrase.split(" ")
        if any(k[0] == lang and f" {phrase} " in f" {k[1]} " and k[1] != phrase and 100 * f >= 50 * a for k, f in wide.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = found[lang, " ".join(words[:k])], found[lang, " ".join(words[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts, key=lambda c: c[:2])
        out.append((lang, phrase, a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(ranked)


def random_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "漢字", "New", "york", "city", "x y", "a", "b", "c", "\x1c", "😀"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text + " new york city hall" * (i % 3), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows


def told(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"bits": 64}), (3, {"most": 40})])
def test_as_by_brute_force(make_docs, odd_rows, seed, options):
    """Also with a bit table in which all pairs fall together, and with tries that are spilled all the time."""
    rows = random_rows(seed) + odd_rows
    assert told(P.collocations(make_docs(rows), least=4, top=30, **options)) == brute(rows, 4, 30)


def test_empty_blank_and_single_words(make_docs):
    assert told(P.collocations(make_docs([]))) == []
    assert told(P.collocations(make_docs([(1, None, None), (2, " \t\n", "en"), (3, "one. two. three", "en")] * 20))) == []


def test_products_beyond_64_bits(text_spark):
    small = text_spark.createDataFrame([("a b", "en", 9 * 10**12), ("a", "en", 9 * 10**12), ("b", "en", 10**13), ("", "en", 10**14)], "phrase string, lang string, f long")
    large = small.filter("false")
    real, P.phrase_counts = P.phrase_counts, lambda *a, **b: (small, large)
    try:
        assert told(P.collocations(text_spark.createDataFrame([], "lang string, text string"))) == [
            ("en", 1, "a b", 9 * 10**12, 9 * 10**12, 10**13, 10**14, 900_000)]
    finally:
        P.phrase_counts = real


@pytest.mark.parametrize(("burst", "slice_bytes"), [(8, 40), (1000, 10), (3, 10**6)])
def test_trie_counts_what_goes_in(burst, slice_bytes):
    """Bursting, spilling of single subtrees and cutting texts anywhere between words keep every count; runs are sorted."""
    rng = random.Random(burst)
    texts = [" ".join(rng.choice("a b c dd ee ff . , g".split()) for _ in range(rng.randint(0, 80))) for _ in range(30)]
    counter, got = P.PhraseCounter((1, 2, 3), burst=burst, slice_bytes=slice_bytes), Counter()

    def keep(heads):
        for phrases, n in counter.spill(heads):
            names = phrases.to_pylist()
            assert [p.split(" ") for p in names] == sorted(p.split(" ") for p in names)
            for p, c in zip(names, n.tolist(), strict=True):
                got["en", p] += c

    for i, text in enumerate(texts):
        for _ in counter.count([text.encode()]):
            if rng.random() < 0.3:
                keep([max(counter.subtrees(), key=lambda t: t[0])[1]])
        if i == 20:
            keep([h for _, h in counter.subtrees()])
            counter.start()
    keep([h for _, h in counter.subtrees()])
    want, n = counted([(0, t, "en") for t in texts])
    assert got == want and counter.n == n["en"] and len(counter.root) == 0


def test_pair_table_has_no_false_alarm_missing(text_spark):
    pairs = [("en", f"w{i} é{i}") for i in range(300)]
    grams = text_spark.createDataFrame([(p, lang, 10) for lang, p in pairs] + [("w1", "en", 10), ("", "en", 5)], "phrase string, lang string, f long")
    table = P.pair_table(grams, 1 << 21)
    import xxhash
    h = [np.array([xxhash.xxh3_64_intdigest(p.split(" ")[i].encode()) for _, p in pairs], np.uint64) for i in (0, 1)]
    at = P.pair_places(*h, P._salt("en"), 1 << 21)
    assert (table[at >> 3] >> (at & 7) & 1 > 0).all() and np.unpackbits(table).sum() == len(set(at.tolist()))
