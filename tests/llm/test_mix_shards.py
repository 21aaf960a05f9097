from collections import Counter, defaultdict

import duckdb
import pytest

from flowweft.llm import label_shards as L
from flowweft.llm import source_mix as M
from flowweft.llm.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


def test_same_mix_as_sql(text_spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = sorted(con.execute(ORACLES["op2_source_mix"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op2_source_mix"](text_spark, D).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want


def water_fill(sizes, weights, most=3.0):
    """Targets by capping and resharing until nothing is above its top."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target | {s: most * sizes[s] for s in capped}
        capped |= above


def test_targets(text_spark):
    for sizes in ({"a": 10, "b": 1000, None: 3}, {"x": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 1, "d": 500, "é": 2, "Z": 7}):
        rows = text_spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in M.source_targets(rows, (5, 2, 1)).collect()}
        assert got == pytest.approx(water_fill(sizes, (5, 2, 1)))


def test_mix_of_odd_rows(text_spark, make_docs, odd_rows):
    got = M.mix_sources(make_docs(odd_rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    assert {r.size for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert M.mix_sources(make_docs([])).count() == 0


def test_words_come_near_targets_and_reruns_agree(text_spark):
    rows = [(i, "w " * (1 + i * 7919 % 97), None, f"s{i % 5}" if i % 3 else "hot") for i in range(900)]
    docs = text_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got, again = M.mix_sources(docs).collect(), M.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 5 for s in target)


def test_unequal_weights_change_inclusion(text_spark):
    rows = [(i, "one two three four", "a" if i < 1000 else "b", 3.0 if i % 2 else 1.0) for i in range(2000)]
    docs = text_spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    got = M.mix_sources(docs, weights=(1, 3), doc_weight="w").collect()
    share = lambda odd: sum(r.copies for r in got if r.source == "a" and r.doc_id % 2 == odd)
    assert 2.5 < share(1) / share(0) < 3.5


def test_drawn_documents(text_spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    drawn = M.draw_mix(docs)
    assert drawn.columns == docs.columns
    want = Counter()
    for r in M.mix_sources(docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in drawn.collect()) == +want


def test_shards_are_even_and_keep_copies_together(text_spark):
    rows = [(i, f"text {i // 3 if i < 600 else i} " * (1 + i % 40 if i >= 600 else 20)) for i in range(3000)]
    docs = text_spark.createDataFrame(rows, "doc_id long, text string")
    got = L.shard_documents(docs, shards=8).collect()
    loads, slots, where = Counter(), defaultdict(list), defaultdict(set)
    text = dict(rows)
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 8
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[text[r.doc_id]].add(r.shard)
    mean = sum(loads.values()) / 8
    assert len(loads) == 8 and max(abs(x - mean) for x in loads.values()) < 0.03 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = [t for t, n in Counter(t for _, t in rows).items() if n > 1]
    assert sum(len(where[t]) > 1 for t in groups) < 0.1 * len(groups)


def test_a_group_larger_than_a_shard_is_split(text_spark):
    docs = text_spark.createDataFrame([(i, "copy" * 10 if i % 3 else f"single {i} " * 4) for i in range(3000)], "doc_id long, text string")
    loads = Counter()
    for r in L.shard_documents(docs, shards=12).collect():
        loads[r.shard] += r.size
    assert len(loads) == 12 and max(loads.values()) < 1.03 * sum(loads.values()) / 12


def test_shards_of_odd_rows(text_spark, make_docs, odd_rows):
    got = L.shard_documents(make_docs(odd_rows), shards=24).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None for r in got)
    none = next(r for r in got if r.doc_id == 2)
    assert (none.size, none.text_crc32) == (8, 0)
    assert L.shard_documents(make_docs([]), shards=3).count() == 0


def test_propagation_follows_edges(text_spark):
    """Two cliques held by edges (groups of two) end with fewer cut edges than they start with."""
    items = [(i, 1) for i in range(40)]
    pairs = [(a, b) for block in (range(20), range(20, 40)) for a in block for b in block if a < b]
    members = [(x, f"{a}-{b}") for a, b in pairs for x in (a, b)]
    state = L.propagate(
        text_spark.createDataFrame(items, "item long, size long"), text_spark.createDataFrame(members, "item long, hub string"), 2, 6, slack=0.5
    )
    at = {r.item: r.shard for r in state.collect()}
    first = L.propagate(
        text_spark.createDataFrame(items, "item long, size long"), text_spark.createDataFrame(members, "item long, hub string"), 2, 0
    )
    was = {r.item: r.shard for r in first.collect()}
    cut = lambda s: sum(s[a] != s[b] for a, b in pairs)
    assert cut(at) < cut(was)
