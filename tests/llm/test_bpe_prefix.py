import hashlib
import json
import random
import time
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowweft.llm import bpe_prefix as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_as_the_library(library):
    one, rng = B.PrefixEncoder(PATH, remember=200), random.Random(3)
    chars = list("ab the  \n\r\t.,'s I'll éñ漢😀 　aaaa1234567890ǅ́\x85\x00 ") + ["<|endoftext|>", "ing", "==", "--", "‍"]
    for _ in range(4000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        assert list(array("I", one.encode(text))) == want
        assert one.decode(want) == library.decode(want, skip_special_tokens=False) == text


def test_pairs_as_merging_says(library):
    """Two tokens are neighbours exactly if encoding their joined bytes gives them back."""
    one, rng = B.prefix_encoder(PATH), random.Random(4)
    ids = [i for i in one.made if all(ord(c) < 128 and c.isalpha() for c in library.id_to_token(i))]
    for _ in range(4000):
        a, b = rng.choice(ids), rng.choice(ids)
        joined = library.id_to_token(a) + library.id_to_token(b)
        assert one.may_follow(a, b) == (library.encode(joined, add_special_tokens=False).ids == [a, b])


def test_any_ids_decode_as_the_library(library):
    one, rng = B.prefix_encoder(PATH), random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 30))]
        assert one.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("big", ["x" * 300_000, "ab" * 200_000, "1" * 200_000, "=" * 200_000, " " * 200_000 + "a"])
def test_one_long_piece_takes_linear_time(library, big):
    one = B.prefix_encoder(PATH)
    one.encode("warm")
    begun = time.process_time()
    raw = one.encode(big)
    assert time.process_time() - begun < 10
    assert list(array("I", raw)) == library.encode(big, add_special_tokens=False).ids


def test_table(make_docs, odd_rows, library):
    rows = odd_rows + [(20, "a<|endoftext|>b <|endoftext|>"), (21, "<|endoftext|")]
    docs = make_docs(rows)
    want = []
    for r in rows:
        raw = array("I", library.encode(r[1] or "", add_special_tokens=False).ids).tobytes()
        want.append((r[0], len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in B.round_trip(docs, PATH).collect())
    back = B.decode_ids(B.encode_texts(docs, PATH), PATH).collect()
    assert sorted(repr((r.doc_id, r.decoded)) for r in back) == sorted(repr((r[0], r[1] or "")) for r in rows)
    assert B.round_trip(make_docs([]), PATH).collect() == []


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        B.PrefixEncoder(public_tokenizers.path("word_bpe_49k.json"))
    stored = json.load(open(PATH, encoding="utf-8"))
    stored["model"]["merges"].append(stored["model"]["merges"][0])
    odd = tmp_path / "odd.json"
    odd.write_text(json.dumps(stored))
    with pytest.raises(ValueError):
        B.PrefixEncoder(str(odd))
