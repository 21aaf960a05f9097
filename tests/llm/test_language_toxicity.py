import random
from collections import Counter

import duckdb
import numpy as np

from flowweft.llm import fuzzy_lexicon as X
from flowweft.llm import rank_profiles as R
from flowweft.llm.queries import QUERIES

D = "/root/testdata/sf0.01"


def brute_grams(text):
    marked, out = "_", Counter()
    for c in (text or "").lower():
        marked += c if c.isalpha() else "" if marked[-1] == "_" else "_"
    marked += "" if marked[-1] == "_" else "_"
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            gram = marked[i:i + n]
            if n == 2 or gram[n // 2] != "_":
                out[gram] += 1
    return out


def test_gram_counts(monkeypatch):
    rng = random.Random(2)
    for size in (5, 200_000):
        monkeypatch.setattr(R, "_CHUNK", size)
        for _ in range(300):
            text = "".join(rng.choice("ab Zé1-ß\n中") for _ in range(rng.randint(0, 30)))
            keys, counts = R.gram_counts(text)
            assert sorted(counts.tolist()) == sorted(brute_grams(text).values()) and len(set(keys.tolist())) == len(keys)
    assert len(R.gram_counts(None)[0]) == len(R.gram_counts("12 !?")[0]) == 0


def brute_decide(text, profiles, most):
    mine = list(R.top_grams(*R.gram_counts(text), most))
    if not mine:
        return "und", 0.0
    best = min((sum(abs(list(p).index(g) - i) if g in set(p) else most for i, g in enumerate(mine)), name) for name, p in sorted(profiles.items()))
    return best[1], 1 - best[0] / (most * len(mine))


def test_distance_is_out_of_place():
    texts = {"en": "the cat and the dog and the house", "de": "der hund und die katze und das haus", "fr": "le chien et le chat et la maison"}
    profiles = {k: R.top_grams(*R.gram_counts(v), 40) for k, v in texts.items()}
    judge = R.Judge(profiles, 40)
    for text in [*texts.values(), "the house", "und", "a", "", None, "zzz", "et la"]:
        name, score = judge.decide(text)
        want = brute_decide(text, profiles, 40)
        assert name == want[0] and abs(score - want[1]) < 1e-12


def test_languages_of_odd_rows(make_docs, odd_rows, text_spark):
    docs = make_docs(odd_rows)
    profiles = R.learn_profiles(docs.select("text", "lang"), most=50)
    assert set(profiles) == {"en", "fr"}  # German and Spanish rows have no letters
    got = R.predict_language(docs, profiles, 50)
    assert got.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score"] or set(got.columns) == {*docs.columns, "lang_pred"}
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows)
    for r in rows:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in (2, 3, 4, 10))
    assert R.learn_profiles(make_docs([])) == {}
    assert {r.lang_pred for r in R.predict_language(docs, {}).collect()} == {"und"}
    assert R.predict_language(make_docs([]), profiles).count() == 0


def test_profiles_hold_the_commonest_grams(make_docs):
    docs = make_docs([(1, "aaa bbb ab", "x"), (2, "ab ab", "x"), (3, "zz", "y")])
    total = Counter()
    for text in ("aaa bbb ab", "ab ab"):
        keys, counts = R.gram_counts(text)
        total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    want = [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))][:6]
    assert R.learn_profiles(docs, most=6)["x"].tolist() == want


def test_held_out_language_accuracy(text_spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{D}/documents.parquet'").fetchall())
    rows = [r for r in QUERIES["op4_rank_profiles"](text_spark, D).collect() if r.held_out]
    assert len(rows) > 200 and np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.97


def test_a_text_in_another_language_than_it_names_goes(text_spark, make_docs):
    docs = text_spark.read.parquet(f"{D}/documents.parquet").filter("n_chars > 300")
    english, german = (docs.filter(f"lang = '{x}'").orderBy("doc_id").first().text for x in ("en", "de"))
    named = docs.select("text", "lang")
    profiles = R.learn_profiles(named)
    least = R.least_scores(named, profiles)
    odd = make_docs([
        (1, english, "en"), (2, english, "de"), (3, german, "en"), (4, german, "de"), (5, english, None), (6, "Имя", "en"),
        (7, english, "xx"), (8, "12 --", "en"), (9, None, "de"), (2, english, "de"),
    ])
    rows = R.keep_told(odd, profiles, least).collect()
    assert {r.doc_id: r.lang for r in rows} == {1: "en", 4: "de", 5: "en", 6: "en"} and len(rows) == 4


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_automaton_equals_edit_distance():
    terms = ["scum", "idiot", "stupid", "moron", "worthless", "disgusting", "stump", "naïve", "morons"]
    automaton, rng = X.LexiconAutomaton(terms), random.Random(3)
    words = set(terms)
    for _ in range(6000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(word))
            word[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "é", "s", "o", "0"])
        words.add("".join(word))
    for word in words:
        near = [(levenshtein(word, t), t) for t in terms if levenshtein(word, t) <= X.edits_allowed(t)]
        assert automaton.match(word) == ((min(near)[1], min(near)[0]) if near else None), word
    assert automaton.near(words).keys() == {w for w in words if automaton.match(w)}


def test_short_terms_match_by_hidden_letters_only():
    automaton = X.LexiconAutomaton(["scum", "scumbag", "idiot", "rat"])
    hidden = {"scvm": "scum", "sc*m": "scum", "$cum": "scum", "5cum": "scum", "r@t": "rat", "r*t": "rat", "*rat*": "rat", "@scum": "scum"}
    found = automaton.near({*hidden, "scam", "scu", "sccum", "sc**m", "rot", "$c*m", "scumba", "scvmbag", "scambag", "1diot", "rats"})
    assert {w: found[w][0] for w in hidden} == hidden
    assert found["scumba"] == ("scumbag", 1) and found["scvmbag"] == ("scumbag", 1) and found["scambag"] == ("scumbag", 1)
    assert found["1diot"] == ("idiot", 1) and not {"scam", "scu", "sccum", "sc**m", "rot", "$c*m", "rats"} & set(found)
    model = X.ToxicityModel({"scum": 0.9}, [], (8.0, 0.0, -3.0))
    assert all(model.score(f"what {w} you are") > 0.5 for w in ("scum", "scvm", "sc*m", "$cum", "*scum*"))
    assert model.score("a scam") == model.score("it costs $100 at @home, 50*2!")


def test_automaton_with_hidden_letters_equals_brute_force():
    terms, rng = ["scum", "rat", "fool", "idiot", "scumbag", "degenerate"], random.Random(4)
    automaton = X.LexiconAutomaton(terms)

    def masked(word, term):
        return len(word) == len(term) and sum(a != b for a, b in zip(word, term, strict=True)) == sum(
            a != b and (a == "*" or b in X.LOOKS.get(a, "")) for a, b in zip(word, term, strict=True))

    words = set()
    for _ in range(6000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(word))
            word[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "*", "@", "v", "0", "$", "1"])
        words.add("".join(word))
    for word in words:
        near = []
        for t in terms:
            away = levenshtein(word, t)
            hidden = sum(a != b for a, b in zip(word, t, strict=True)) if masked(word, t) else 99
            near += [(away, t)] * (away <= X.edits_allowed(t)) + [(hidden, t)] * (hidden <= X.masks_allowed(t))
        assert automaton.match(word) == ((min(near)[1], min(near)[0]) if near else None), word


def test_quotation_is_not_abuse():
    model = X.ToxicityModel({"idiot": 0.9, "stupid": 0.9}, ["stupa"], (8.0, 0.0, -3.0))
    assert model.score("what an idiot") > 0.5 and model.score("what an idi0t you are") > 0.5
    assert model.score('they wrote "idiot" on the wall') < 0.5 and model.score("the term «stupid» is an insult") < 0.5
    assert model.score("a stupa in the hills") == model.score("") == model.score(None) < 0.5
    assert model.features("stupid " * 50_000)[0] > model.features("stupid")[0]


def test_model_from_few_or_no_labels(make_docs, odd_rows, text_spark):
    docs = make_docs(odd_rows)
    labels = text_spark.createDataFrame([(1, 1), (3, None), (99, 0)], "doc_id long, toxic int")
    none, ones = X.learn(docs, labels.filter("doc_id > 500")), X.learn(docs, labels)
    assert {r.score for r in X.predict_toxicity(docs, none).select("score").collect()} == {0.0}
    assert all(r.score == 1.0 and r.predicted == 1 for r in X.predict_toxicity(docs.drop("score"), ones).collect())
    assert X.predict_toxicity(make_docs([]), ones).count() == 0


def test_held_out_toxicity(text_spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{D}/labels.parquet'").fetchall())
    rows = QUERIES["op8_fuzzy_lexicon"](text_spark, D).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.93 and sum(b and not a for a, b in held) <= 1


def test_a_sample_counts_texts_and_not_their_copies(make_docs):
    words = {"en": "the river runs past old stone houses", "de": "der alte Fluss fließt an steinernen Häusern vorbei"}
    once = [(0, f"{words[x]} {x}{i}", x) for x in words for i in range(20)]
    copies = [(0, t, x) for _, t, x in once for _ in range(100)]
    single, many = (R.learn_profiles(make_docs(r), train_rows=20) for r in (once, copies))
    assert set(single) == set(many) == {"en", "de"}
    assert all((single[x] == many[x]).all() for x in words)


def test_a_lexicon_sample_counts_texts_and_not_their_copies(text_spark, make_docs):
    texts = [f"plain talk number {i} of the day" if i % 2 else f"you are vermin and scoundrel {i}" for i in range(40)]
    docs = make_docs([(100 * i + j, t) for i, t in enumerate(texts) for j in range(50)])
    labels = text_spark.createDataFrame([(100 * i + j, int(i % 2 == 0)) for i in range(40) for j in range(50)], "doc_id long, toxic int")
    model = X.learn(docs, labels, train_rows=40)
    assert model.lexicon and model.score("you are vermin and scoundrel") > 0.5 > model.score("plain talk of the day")
