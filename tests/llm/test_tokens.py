import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs as pafs
from tokenizers import Tokenizer

from flowweft.llm import token_files as T
from flowweft.llm import vector_packing as V
from flowweft.llm.common import shared_folder
from flowweft.llm.encode import PieceEncoder, encoder

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def direct(path, text):
    one = Tokenizer.from_file(path)
    one.encode_special_tokens = True
    return one.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_ids_of_whole_texts(path):
    rng = random.Random(4)
    parts = ["a", "Bc", " ", "  ", "\n", "'s", "1", "é", "", "\t", ".", ",", "_", "!?", "中", "'ll", " ", "ﬁ", "é", "<|endoftext|>", "İ", "Σ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    one = PieceEncoder(path, remember=500)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    for at in range(0, len(texts), 60):
        group = [*texts[at:at + 60], None, ""]
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in group]
        assert [np.frombuffer(x, "<u4").tolist() for x in one.encode_all(group)] == want


def test_known_pieces_are_looked_up_once():
    """Also with a table that turns over between batches, and ids stay those of whole texts."""
    looked = []

    class Counted(dict):
        def get(self, key, other=None):
            looked.append(key)
            return super().get(key, other)

        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

        def __contains__(self, key):
            looked.append(key)
            return super().__contains__(key)

    path = public_tokenizers.path("byte_bpe_50k.json")
    one, text = PieceEncoder(path), "some words, and some words again"
    want = [np.array(one.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert one.encode_all([text]) == want
    one.known = Counted(one.known)
    assert one.encode_all([text]) == want and len(looked) == 7  # six words and a comma
    small = PieceEncoder(path, remember=8)
    texts = ["a b c d e f", "c d x y z", "a b x q r s", "", "a  b", "x y . z"]
    for batch in (texts, texts[2:], texts[:2], texts[::-1]):
        assert small.encode_all(batch) == [np.array(small.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_operators_give_the_ids_of_the_tokenizer_as_it_is(path):
    rng, whole = random.Random(5), Tokenizer.from_file(path)
    parts = ["a", "Bc", " ", "  ", "\n", ".", ",", "1", "é", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "\t"]
    texts = ["a <|endoftext|> b", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(path).encode_all(texts)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert whole.token_to_id("<|endoftext|>") in got[0]


def test_token_index_and_packing_of_added_tokens(make_docs):
    text = "a <|endoftext|> b"
    for path, n, crc in (
        (WORD, "n_tokens", {r.doc_id: r for r in T.token_index(make_docs([(1, text)]), WORD, 1).collect()}),
        (BYTE, "length", {r.doc_id: r for r in V.pack_documents(make_docs([(1, text)]), BYTE, 2).collect()}),
    ):
        ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1 if path == WORD else 2]
        assert crc[1][n] == len(ids) and crc[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_packing_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = T.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (T.unpack(data, 1001, bits) == ids).all()


def test_bits_for_vocabulary():
    assert [T.bits_for(v) for v in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


def test_random_access(tmp_path):
    rng, store, path = np.random.default_rng(1), pafs.LocalFileSystem(), f"{tmp_path}/one.bin"
    docs = [rng.integers(0, 2**13, n).astype(np.uint32) for n in (0, 5, 1000, 1, 0, 777)]
    writer = T.TokenWriter(store.open_output_stream(path), 13, block_tokens=64)
    for i, ids in enumerate(docs):
        writer.add(None if i == 1 else i, ids)
    writer.close()
    file = T.TokenFile(store, path)
    assert len(file) == 6 and file.tokens == sum(map(len, docs)) and file.has_id.tolist() == [True, False, *[True] * 4]
    for i in (3, 5, 0, 2, 1, 4):
        assert (file.document(i) == docs[i]).all()
    assert (file.tokens_between(60, 70) == np.concatenate(docs)[60:70]).all()
    for i, ids in file.documents(at_once=1):
        assert (ids == docs[i]).all()


def test_token_files_of_odd_rows(text_spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    folder = shared_folder(text_spark)
    manifest = T.write_tokens(docs, folder, WORD, 1, file_tokens=1000)
    got = [tuple(r) for r in T.read_tokens(manifest, folder).orderBy("start").collect()]
    start, want = 0, []
    for doc, text in sorted(((r[0], r[1]) for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*direct(WORD, text), 1], "<u4")
        want.append((doc, len(ids), zlib.crc32(ids.tobytes())))
    # Rows with equal ids are ordered by a hash of the text: compare them as sets.
    assert sorted(((r[0] is not None, r[0] or 0), r[2:]) for r in got) == sorted(((d is not None, d or 0), (n, c)) for d, n, c in want)
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    for r in got:
        assert r[1] == start
        start += r[2]
    with_ids = T.read_tokens(manifest, folder, with_ids=True).filter("doc_id = 1").first()
    assert with_ids.ids == [*direct(WORD, odd_rows[0][1]), 1]


def test_no_documents(text_spark, make_docs):
    assert T.token_index(make_docs([]), WORD, 1).count() == 0
    assert V.pack_documents(make_docs([]), BYTE, 2).count() == 0


def check_plan(counts, capacity, plan):
    cover, sequences = defaultdict(list), defaultdict(list)
    for length, rank0, rank1, per, sequence0, offset0 in plan:
        cover[length].append((rank0, rank1))
        for r in range(rank1 - rank0):
            sequences[sequence0 + r // per].append((offset0 + r % per * length, length))
    for length, n in counts.items():
        spans = sorted(cover[length])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    for items in sequences.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity[0] and len(items) <= capacity[1] and sum(x * x for _, x in items) <= capacity[2]
    return len(sequences)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plans_keep_every_capacity(score):
    rng = random.Random(1)
    for _ in range(40):
        counts = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
        for capacity in ((64, 64, 4096), (64, 3, 4096), (64, 64, 4100), (64, 5, 5000)):
            check_plan(counts, capacity, V.plan_packing(counts, capacity, score=score))


def test_plan_is_near_the_bound():
    rng = random.Random(2)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(1024, max(1, int(rng.lognormvariate(5.5, 1.2))))] += 1
    used = check_plan(counts, (1024, 1024, 1024**2), V.plan_packing(counts, (1024, 1024, 1024**2)))
    assert used <= -(-sum(x * n for x, n in counts.items()) // 1024) + 2
    assert V.plan_packing({}, (8, 8, 64)) == []
    with pytest.raises(ValueError):
        V.plan_packing({9: 1}, (8, 8, 64))


def test_packed_documents(text_spark, make_docs, odd_rows):
    got = V.pack_documents(make_docs(odd_rows), BYTE, 2).collect()
    want = []
    for doc, text, *_ in odd_rows:
        ids = np.array([*direct(BYTE, text), 2], "<u4")
        start, end, piece = 0, len(ids) % 1024 or 1024, 0
        while start < len(ids):
            want.append((doc, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            start, end, piece = end, end + 1024, piece + 1
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r)[:5] for r in got), key=lambda r: (r[0] or 0, r[1:])) == sorted(want, key=lambda r: (r[0] or 0, r[1:]))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 1024
    assert key(want[0])
