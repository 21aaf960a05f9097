import random
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from flowweft.llm import dart_minhash as N
from flowweft.llm.queries import QUERIES
from flowweft.runtime import materialize

D = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    common = sum((a & b).values())
    every = sum(a.values()) + sum(b.values()) - common
    return common / every if every else 0.0


def brute_classes(rows, least=0.8):
    """Class per place in ``rows`` of (doc_id, text): the smallest doc_id, nulls last."""
    sets, holders, parent = [shingles(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, j in {(a, b) for same in holders.values() for k, b in enumerate(same) for a in same[:k]}:
        if jaccard(sets[i], sets[j]) >= least:
            parent[find(j)] = find(i)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(i)
    name = lambda ids: min(ids, key=lambda x: (x is None, x or 0))
    return {i: name([rows[j][0] for j in same]) for same in classes.values() for i in same}, len(classes)


def test_signatures_agree_as_weighted_sets_overlap():
    rng = random.Random(1)
    for changes, repeats in ((0, 1), (3, 1), (10, 1), (10, 5), (40, 1)):
        words = [f"w{rng.randint(0, 60)}" for _ in range(200)] * repeats
        other = list(words)
        for i in range(changes):
            other[rng.randrange(len(other))] = f"z{i}"
        a, b = (N.shingles(N.word_hashes(" ".join(x))) for x in (words, other))
        want = jaccard(shingles(" ".join(words)), shingles(" ".join(other)))
        assert abs(N.similarity(a, b) - want) < 1e-12
        assert abs((N.signature(*a, 3000) == N.signature(*b, 3000)).mean() - want) < 0.045


def test_signatures_do_not_depend_on_the_time_limit():
    a = N.shingles(N.word_hashes(" ".join(f"w{i % 50}" for i in range(300))))
    regions = N.mix(np.arange(40, dtype=np.uint64))
    early, late = N._throw(regions, 1.5), N._throw(regions, 9.0)
    assert set(early[1].tolist()) == {int(d) for t, d in zip(*late, strict=True) if t <= 1.5}
    assert abs(len(late[0]) / 360 - 1) < 0.2
    assert (N.signature(*a, 64) == N.signature(*a, 64)).all() and len(N.signature(np.array([7], np.uint64), np.array([1]), 50)) == 50


def near_rows():
    """Groups of edited copies, chains, shared passages, single words, and the odd rows' like."""
    rng = random.Random(7)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n)]
    passage, rows = words(60), []
    for _ in range(25):
        base = words(rng.randint(30, 150))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = "new"
            rows.append(" ".join(copy))
        rows.append(" ".join([*words(40), *passage, *words(20)]))
    chain = words(120)
    for i in range(12):
        chain = [*chain[:10 * i], "link", *chain[10 * i + 1:]]
        rows.append(" ".join(chain))
    rows += ["one", "one", "ONE", "two words", "same words same words same words", "", " ", "same words same words same words"]
    return [(1000 - i, t) for i, t in enumerate(rows)]


def test_classes_equal_brute_force(text_spark, make_docs):
    rows = near_rows()
    want, n = brute_classes(rows)
    for options in ({}, {"block_rows": 3}):
        got = N.near_duplicates(make_docs(rows), **options).collect()
        assert {r.doc_id: r.class_id for r in got} == {rows[i][0]: c for i, c in want.items()}
        assert sum(r.kept for r in got) == n and all(r.doc_id == r.class_id for r in got if r.kept)


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = N.near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    want, n = brute_classes([r[:2] for r in odd_rows])
    assert sum(r.kept for r in got) == n
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in got) == sorted((odd_rows[i][0] or 0, c or 0) for i, c in want.items())
    left = N.drop_near_duplicates(docs)
    assert left.columns == docs.columns and Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert N.near_duplicates(make_docs([])).count() == 0


def test_a_large_group_of_near_copies(text_spark, make_docs):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i % 50}"
        rows.append((i, " ".join(copy)))
    got = N.near_duplicates(make_docs(rows)).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_query_equals_brute_force(text_spark):
    rows = [tuple(r) for r in text_spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    want, n = brute_classes(rows)
    got = QUERIES["op9_dart_minhash"](text_spark, D).collect()
    assert {r.doc_id: r.class_id for r in got} == {rows[i][0]: c for i, c in want.items()} and sum(r.kept for r in got) == n


def test_pipeline_stages(text_spark):
    docs = text_spark.read.parquet(f"{D}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near duplicates", "private data", "source mix", "packing"]
    by = {None: docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = by[name] = materialize(stage(text_spark, docs, D))
    told, distinct, masked, mixed = (by[n] for n in names[:4])
    assert all(by[n].columns == by[None].columns for n in names[:4])
    before = {r.doc_id: r.text for r in by[None].collect()}
    assert {r.doc_id for r in told.collect()} == {i for i, t in before.items() if t and any(c.isalpha() for c in t)}
    texts = {r.doc_id: r.text for r in told.collect()}
    want, _ = brute_classes(list(texts.items()))
    assert {r.doc_id for r in distinct.collect()} == set(want.values())
    assert {r.doc_id for r in masked.collect()} == set(want.values())
    assert all(r.n_chars == len(r.text) for r in masked.collect())
    assert "@mail" not in " ".join(r.text for r in masked.collect())
    again = Counter(r.doc_id for r in mixed.collect())
    assert max(again.values()) <= 3 and set(again) <= set(want.values())
    words = sum(len((r.text or "").split()) for r in masked.collect())
    assert abs(sum(len((r.text or "").split()) for r in mixed.collect()) - words) < 0.02 * words
    packed = by["packing"].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == again


def test_pipeline_runs_whole(text_spark):
    assert corpus_pipeline.ORACLE_SQL is None
    rows = corpus_pipeline.run(text_spark, D).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 1024


def test_pipeline_of_no_documents(text_spark):
    docs = text_spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(text_spark, docs, D))
    assert docs.count() == 0


def test_language_stage_rejects_what_no_profile_is_near_to(text_spark, make_docs):
    docs = text_spark.read.parquet(f"{D}/documents.parquet")
    rng = random.Random(9)
    noise = " ".join("".join(rng.choice("qxzjkwvy") for _ in range(9)) for _ in range(200))
    english = docs.filter("lang = 'en' AND n_chars > 300").select("text").first().text
    odd = make_docs([
        (-1, "Это текст на другом языке, которого нет ни в одном профиле.", None), (-2, noise, None), (-3, english, None),
        (-4, "123 ...", "en"), (-5, None, "en"), (-6, None, None), (-7, "", None), (-8, "Имя", "en"),
    ]).select(*docs.columns)
    everything = docs.unionByName(odd)
    rows = corpus_pipeline.identify_language(text_spark, everything, D).collect()
    kept = Counter(r.doc_id for r in rows)
    want = Counter(r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
    assert kept == want + Counter([-3, -8])
    named = {r.doc_id: r.lang for r in everything.collect()} | {-3: "en"}  # what the stage found is named from then on
    assert {r.doc_id: r.lang for r in rows} == {i: named[i] for i in kept}


def test_language_stage_without_named_languages(text_spark, make_docs):
    docs = make_docs([(1, "some words"), (2, None), (3, ""), (4, "12 *** 34"), (5, "слова")])
    assert {r.doc_id for r in corpus_pipeline.identify_language(text_spark, docs, D).collect()} == {1, 5}
