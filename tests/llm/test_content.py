import random

import numpy as np
import pytest
import sentences
from oracle import TESTDATA
from sentences import film as sentence_film

from trackweave.llm import content, passages
from trackweave.llm.boosting import Boosted, Isotonic, cross_scores
from trackweave.llm.passages import Weights
from trackweave.llm.textform import fold, plain_form, repaired
from trackweave.runtime import Scratch, table

CUE = "{n}\n00:00:{n:02d},000 --> 00:00:{n:02d},900\n{text}\n\n"


def film(*cues: str) -> str:
    return "".join(CUE.format(n=i + 1, text=c) for i, c in enumerate(cues))


def speech(text: str) -> str:
    return plain_form([text]).text.strip()


@pytest.mark.parametrize(
    "shown",
    ["You idiot", "YOU IDIOT!", "you 1d10t", "you i d i o t", "you i.d.i.o.t", "yоu idiоt", "you idi-\not", "you <i>idiot</i>", "TOVI: you idiot", "you [door slams] idiot", "you id​iot", "you\nidiot", "yóu ïdiot", "you idiooot"],
)
def test_spellings_meet(shown):
    assert speech(film(shown)) == fold("you idiot")


def test_cues_adverts_and_directions():
    text = film("Who painted it?", "[a dog barks]", "*un chien aboie*", "Naked girls at www.spam.invalid\nnow", "Go home.")
    assert speech(text) == fold("who painted it go home")
    assert speech("WEBVTT\n\n" + film("One", "two").replace(",", ".").replace("\n", "\r\n")) == fold("webvtt one two")


def test_misread_encodings():
    word = "réveille ça — œil"
    once = word.encode().decode("cp1252", "replace")
    assert repaired(once) == word and repaired(word) == word and repaired("Ñandú ¿qué?") == "Ñandú ¿qué?"
    twice = "réveille ça".encode().decode("cp1252").encode().decode("cp1252")
    assert repaired(twice) == "réveille ça"


NO_WEIGHTS = Weights(np.zeros(0, np.int64), np.zeros(0))


def patterns(text: str) -> set[str]:
    _, code, _ = passages.passages(passages.read([text]), NO_WEIGHTS)
    return {name for bit, name in enumerate(passages.PATTERNS) if (code >> bit & 1).any()}


def test_texts_do_not_touch():
    texts = [film("You"), "", film("idiot"), "no cue at all", film("x" * 5000), film("You idiot. I will kill you!")]
    doc, code, dense = passages.passages(passages.read(texts), NO_WEIGHTS)
    for i, text in enumerate(texts):
        _, own, own_dense = passages.passages(passages.read([text]), NO_WEIGHTS)
        assert code[doc == i].tolist() == own.tolist() and np.allclose(dense[i], own_dense[0])
    assert passages.passages(passages.read([]), NO_WEIGHTS)[2].shape == (0, len(passages.DENSE))


@pytest.mark.parametrize("text", ["What a sc*mbag", "What a scumbag", "What a sc#mbag", "What a scummmmbag"])
def test_masked_words_count(text):
    assert "insult" in patterns(film(text)) and "insult" not in patterns(film("What a bag"))


def test_patterns_keep_to_a_sentence():
    assert "kill_you" in patterns(film("I will kill you")) and "kill_you" not in patterns(film("They kill. You wait."))
    assert "insult_no" in patterns(film("You were no idiot to wait"))
    assert not patterns(film("You can see it with the naked eye.")) & {"sex", "insult"}


def test_word_groups_are_weighted_by_the_documents_that_hold_them():
    texts = [film("Look at the stupid pond")] * 20 + [film("Look at the stupid wall")] * 20
    yes = np.repeat([1.0, 0.0], 20)
    doc, code = passages.groups_of(passages.read(texts))
    codes, which = np.unique(code, return_inverse=True)
    weights = Weights.of_counts(codes, np.bincount(which, yes[doc]), np.bincount(which, 1 - yes[doc]), 20, 20)
    own = passages.word_weights(passages.read([film("the stupid pond"), film("the stupid wall"), film("the calm wall")]), weights)
    assert own.max() > 0.8 and own.min() < -0.8 and set(own[-3:]) == {0.0}
    assert len(Weights.of_counts(codes, np.zeros(len(codes)), np.ones(len(codes)), 0, 40).codes) == 0


def test_speech_beside_addresses_and_in_brackets_stays():
    assert speech(film("Get lost.you idiot")) == fold("get lost you idiot")
    assert speech(film("(you filthy idiot, go to hell)")) == fold("you filthy idiot go to hell")
    assert speech(film("(a door slams)")) == ""
    assert speech(film("You stupid idiot! Visit www.example.com now")) == fold("you stupid idiot")
    assert speech(film("Naked girls at www.example.com")) == ""


def test_sentences_that_no_list_holds(spark):
    """Recall and precision on sentences written for the test, by the model of the rated documents of sf0.1."""
    tables = [table(spark, f"{TESTDATA}/sf0.1", name) for name in ("documents", "doc_labels")]
    model, weights = content.fitted(*tables, Scratch(spark, "t"))

    def reported(sentences: dict) -> tuple[int, int]:
        texts = [sentence_film(lang, s) for lang, group in sentences.items() for s in group]
        return int((model.probability(*passages.passages(passages.read(texts), weights)) >= content.THRESHOLD).sum()), len(texts)

    for harsh, calm in ((sentences.UNSEEN, sentences.HARMLESS), (sentences.FRESH, sentences.FRESH_HARMLESS)):
        (found, cases), (wrong, _) = reported(harsh), reported(calm)
        assert found >= 0.8 * cases and found >= 0.9 * (found + wrong)


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (x[:, 2] > 1.5)).astype(float)
    half = slice(0, 2000)
    model = Boosted().fit(x[half], y[half])
    assert ((model.score(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    scores = cross_scores(x[half], y[half], np.ones(2000))
    fit = Isotonic().fit(scores, y[half], np.ones(2000))
    p = fit(model.score(x[2000:]))
    assert np.all(np.diff(fit.to) >= 0) and abs(p.mean() - y[2000:].mean()) < 0.03
    assert Boosted().fit(x[:5], np.ones(5)).score(x[:2]).shape == (2,)


def test_held_out_accuracy_on_planted_documents(spark):
    rng = random.Random(1)
    calm = ["Who painted the ledger?", "Wait for me at the harbour.", "The cock crows at five.", "She went to bed early.", "You can see it with the naked eye.", "Les rats ont rongé le câble.", "He beat me again."]
    harsh = ["You filthy pig, go to hell!", "I'll break every bone in your body.", "They breed like rats, drive them out.", "Put your mouth on my cock.", "Du dreckiges Schwein, verschwinde!", "Te voy a matar.", "Ferme ta gueule, espèce d'idiot !"]
    rows, truth = [], {}
    for i in range(900):
        cues = [rng.choice(calm) for _ in range(6)]
        truth[i] = i % 4 == 0
        if truth[i]:
            cues[rng.randrange(6)] = rng.choice(harsh)
        rows.append((i, film(*cues), rng.choice(["a", "b", None]), "en", "x"))
    rows += [(900, None, None, None, None), (901, "", "a", "en", None)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, probability string")
    labels = spark.createDataFrame([(i, "r", int(truth[i] != (i % 37 == 0)), 0, None, 1) for i in range(400)] + [(5, "q", None, None, None, 1)], "doc_id bigint, rater string, abusive int, hateful int, sexual int, features int")
    found = {r.doc_id: r.probability for r in content.scored(documents, labels, Scratch(spark, "t")).collect()}
    assert len(found) == 902 and found[900] == found[901] < 0.5
    held_out = [i for i in range(400, 900)]
    assert sum((found[i] >= 0.5) == truth[i] for i in held_out) / len(held_out) > 0.97
    rates = {r.source: r for r in content.rates(content.scored(documents, labels, Scratch(spark, "t"))).collect()}
    assert set(rates) == {"a", "b", None} and sum(r.documents for r in rates.values()) == 902


def test_without_labels_all_scores_are_alike(spark):
    documents = spark.createDataFrame([(1, film("You idiot"), "s", "en"), (2, "", "s", "en")], "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, abusive int, hateful int, sexual int")
    assert {r.probability for r in content.scored(documents, labels, Scratch(spark, "t")).collect()} == {0.5}
    assert content.scored(documents.limit(0), labels, Scratch(spark, "t")).count() == 0


def test_adverts_end_with_their_text():
    texts = [film("Get it at www.example.com"), "Speech without any timing line\nYou idiot", film("You"), "See www.example.com\nand more speech"]
    together, alone = plain_form(texts), [plain_form([t]) for t in texts]
    assert together.letters.tolist() == [int(p.letters[0]) for p in alone]
    assert together.letters[1] > 0 and together.letters[2] > 0 and together.letters[3] > 0
