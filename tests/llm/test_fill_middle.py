import hashlib
import random

import numpy as np
import pytest

from flowweft.llm import fill_middle as M


@pytest.mark.parametrize("one_in", [2, 8])
def test_every_rank_of_the_list(one_in):
    rng = random.Random(one_in)
    for n in (0, 1, 2, 9, 100, 3000):
        widths = [rng.randint(1, 12) for _ in range(n)]
        lanes = M.SkipList(np.array(widths, np.int64), one_in)
        ends = np.concatenate([[0], np.cumsum(widths)]) if n else [0]
        assert [lanes.seek(r) for r in range(n + 1)] == list(ends)
        assert all(u.sum() == n for u in lanes.units) and all(c.sum() == sum(widths) for c in lanes.chars)
        assert n < 3000 or len(lanes.units) > 2
    with pytest.raises(IndexError):
        M.SkipList(np.array([1])).seek(2)


def brute(doc_id, text):
    """Units one character at a time, parts by joining units."""
    text = text or ""
    units, seen_word = [], False
    for c in text:
        blank = c in " \t\n\x0b\x0c\r"
        if not units or blank and seen_word:
            units.append("")
            seen_word = False
        units[-1] += c
        seen_word = seen_word or not blank
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", text, None, None
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_texts_as_by_brute_force(make_docs, odd_rows):
    rng = random.Random(5)
    made = ["".join(rng.choice(["ab", "é", "😀", " ", "  ", "\t", "\n", "\x0b", " ", "<", ">", "P", "S>", "<M"]) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(made)] + [(1000 + i, "a <S> b") for i in range(9)] + odd_rows
    docs = make_docs(rows)
    cut = M.restore_texts(M.fill_middle(docs)).collect()
    want = sorted([repr((r[0], *brute(r[0], r[1]), r[1] or "")) for r in rows])
    assert sorted(repr((c.doc_id, c.n, c.form, c.output, c.prefix_chars, c.middle_chars, c.restored)) for c in cut) == want
    assert {c.form for c in cut} == {"plain", "spm", "psm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = {(d.doc_id, d.output_sha256, d.restored_sha256) for d in M.middle_digests(docs).collect()}
    assert digests == {(c.doc_id, sha(c.output), sha(c.restored)) for c in cut}


def test_rates_and_empty_table(make_docs):
    rows = [(i, "one two three") for i in range(50)]
    assert {r.form for r in M.fill_middle(make_docs(rows), rate=0).collect()} == {"plain"}
    assert {r.form for r in M.fill_middle(make_docs(rows), rate=100, spm_rate=0).collect()} == {"psm"}
    assert M.middle_digests(make_docs([])).collect() == []


def test_restore_says_when_it_cannot():
    with pytest.raises(ValueError):
        M.restore("<P>a<S>b<M>c", "spm")
    with pytest.raises(ValueError):
        M.restore("<P>a", "psm")
