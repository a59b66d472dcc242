import random
from collections import Counter

import numpy as np
import pytest

from recallgrid.llm.language import DIMENSIONS, Profiles, Scorer, bind, fit_profiles, label_language, language_findings, letter_vectors, letters, parts, read_languages, read_texts, trigrams

SCHEMA = "doc_id bigint, text string, lang string, segments int, confidence string"
SPOKEN = {
    "en": "the keeper of the ferry had never seen the letter that was lying under the bridge when they came back from the market",
    "de": "der wirt hatte den brief noch nie gesehen der unter der brücke lag als sie vom markt zurückkamen und nichts davon wussten",
    "fr": "le gardien du bac n’avait jamais vu la lettre qui se trouvait sous le pont quand ils sont revenus du marché avec elle",
    "es": "el guardián de la barca nunca había visto la carta que estaba debajo del puente cuando volvieron del mercado con ella",
    "ru": "хозяин парома никогда не видел письма которое лежало под мостом когда они вернулись с рынка и ничего не знали",
}


def sentence(lang, r):
    w = SPOKEN[lang].split()
    at = r.randrange(0, len(w) - 9)
    return " ".join(w[at : at + r.randint(7, 9)]).capitalize() + "."


@pytest.fixture(scope="module")
def scorer():
    r = random.Random(1)
    counts = {k: Counter(t for _ in range(40) for t in trigrams(letters(sentence(k, r))).tolist()) for k in SPOKEN}
    return Scorer(Profiles.fit(counts))


def test_vectors_are_nearly_orthogonal():
    v = bind(np.array([5, 500, 50_000]), letter_vectors()).astype(float)
    c = v @ v.T / DIMENSIONS
    assert np.allclose(np.diag(c), 1) and abs(c - np.eye(3)).max() < 0.08


def test_scores_are_cosines(scorer):
    text = letters(sentence("fr", random.Random(4)))
    numbers, n = np.unique(trigrams(text), return_counts=True)
    bundle = n @ bind(numbers, letter_vectors()).astype(float)
    exact = bundle @ scorer.prototypes / np.linalg.norm(bundle)
    assert np.abs(exact - scorer.cosines([text])[0]).max() < 0.05


def test_held_out_sentences(scorer):
    r = random.Random(9)
    texts = [(k, sentence(k, r)) for k in SPOKEN for _ in range(60)]
    got = read_texts([t if i % 2 else t.upper() for i, (_, t) in enumerate(texts)], scorer)
    assert sum(g.main == k for g, (k, _) in zip(got, texts)) >= 0.97 * len(texts)


def test_mixed_quoted_and_borrowed(scorer):
    r = random.Random(2)
    english = " ".join(sentence("en", r) for _ in range(6))
    mixed = read_texts([english + " " + sentence("de", r), f"Anna: {english}\nBo: “{sentence('es', r)}” said the keeper of the ferry.", english.replace("letter", "Brief"), english], scorer)
    assert [m.main for m in mixed] == ["en"] * 4
    assert [m.languages for m in mixed] == [["de", "en"], ["en", "es"], ["en"], ["en"]]
    text = english + " " + sentence("de", random.Random(2))
    start, end, lang, confidence = read_texts([text], scorer)[0].segments[-1]
    assert lang == "de" and end == len(text) and 0 < confidence <= 1


def test_texts_without_sentences(scorer):
    for text in (None, "", "  ", "12 8 10", "👍👍", '{"a": [1, 2, 3]}', "----", "```\nfor i in range(3): pass\n```"):
        assert read_texts([text], scorer)[0].main is None, text
    assert parts("Name:") == []
    assert read_texts(["the letter " * 100_000], scorer)[0].main == "en"


def test_labels(spark, as_rows):
    df = spark.createDataFrame([(x,) for x in ("en", "EN-gb", "eng", " Deutsch ", "français", "xx", "-", "", None, "pt_BR", "Russian")], "l string")
    assert [r[0] for r in df.select(label_language(df.l)).collect()] == ["en", "en", "en", "de", "fr", None, None, None, None, "pt", "ru"]


def test_findings(spark, as_rows):
    r = random.Random(7)
    rows = [(i, " ".join(sentence(k, r) for _ in range(4)), k, 1, "x") for i, k in enumerate(list(SPOKEN) * 30)]
    rows += [(900, sentence("de", r) + " " + sentence("de", r), "fr", 1, "x"), (901, sentence("es", r), None, 1, "x"), (902, "123", None, 1, "x"), (903, None, "en", 1, "x"), (904, sentence("fr", r), "fra", 1, "x")]
    rows += [(905, " ".join(sentence("en", r) for _ in range(3)) + " " + sentence("ru", r), "en", 1, "x"), (901, sentence("es", r), None, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    read = read_languages(df, ["doc_id", "lang"], fit_profiles(df))
    got = as_rows(language_findings(read))
    assert got == sorted([(900, "label", "de"), (901, "label", "es"), (901, "label", "es"), (905, "mixed", "en"), (905, "mixed", "ru")], key=str)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    profiles = fit_profiles(df)
    assert profiles.languages == []
    assert read_languages(df, ["doc_id", "lang"], profiles).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text without any label at all.", None, 1, "x")], SCHEMA)
    assert read_languages(unlabelled, ["doc_id", "lang"], fit_profiles(unlabelled)).first()["lang_found"] is None
