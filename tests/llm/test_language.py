"""Languages: accuracy on held-out sentences, mixed texts, labels and what isn't language."""

import pytest

from millrace.llm import language as L

PARTS = {
    "en": (["The old worker", "Our second reviewer", "A quiet clerk"], ["checked the rows of the table", "sorted all letters from the archive", "wrote a short note about it"], ["before the others came back", "because there was no time", "with the help of friends"]),
    "de": (["Der alte Arbeiter", "Unsere zweite Prüferin", "Ein stiller Schreiber"], ["prüfte die Zeilen der Tabelle", "sortierte alle Briefe aus dem Archiv", "schrieb eine kurze Notiz darüber"], ["bevor die anderen zurückkamen", "weil keine Zeit mehr war", "mit der Hilfe von Freunden"]),
    "fr": (["Le vieil ouvrier", "Notre deuxième lectrice", "Un commis silencieux"], ["a vérifié les lignes du tableau", "a classé toutes les lettres des archives", "a écrit une courte note à ce sujet"], ["avant le retour des autres", "parce que le temps manquait", "avec l'aide de quelques amis"]),
    "es": (["El viejo obrero", "Nuestra segunda revisora", "Un escribiente callado"], ["comprobó las filas de la tabla", "ordenó todas las cartas del archivo", "escribió una nota breve sobre ello"], ["antes de que volvieran los demás", "porque ya no había tiempo", "con la ayuda de unos amigos"]),
}
SENTENCES = [(k, f"{a} {b} {c}.") for k, (x, y, z) in PARTS.items() for a in x for b in y for c in z]


@pytest.fixture(scope="module")
def model():
    return L.fit(SENTENCES[::2])


def test_held_out(model):
    rest = SENTENCES[1::2]
    cosines = model.cosines([L.words_of(t) for _, t in rest])
    right = sum(model.languages[k] == language for k, (language, _) in zip(cosines.argmax(axis=1), rest))
    assert right / len(rest) >= 0.97


def test_lost_accents(model):
    rest = [(k, t.translate(L._PLAIN_ACCENTS)) for k, t in SENTENCES[1::2]]
    cosines = model.cosines([L.words_of(t) for _, t in rest])
    assert sum(model.languages[k] == language for k, (language, _) in zip(cosines.argmax(axis=1), rest)) / len(rest) >= 0.95


def test_sentences_leave_out_what_is_no_sentence():
    text = (
        "# The heading of a long part that has more than eight words in it\n- Too short.\n```\nthis is code with more than eight words in a row here\n```\n"
        "SELECT a, b, c, d, e, f, g, h, i FROM t;\n[00:12] One two three four five six seven eight nine. [chunk 3 / 9]\n<p>Ten words are in this one and («cinq mots ne comptent pas») no more.</p>\n"
        '{"key": "a b c d e f g h i j"}'
    )
    assert [" ".join(w) for _, w in L.sentences_of(text)] == ["one two three four five six seven eight nine", "ten words are in this one and no more"]


def test_wrapped_lines_are_one_sentence():
    text = "one two three four,\nfive six seven 8 eight\nnine ten. Next words stand\nHere on a new line"
    assert [" ".join(w) for _, w in L.sentences_of(text)] == ["one two three four five six seven eight nine ten"]


def test_mixed_and_wrong_labels(spark, model):
    by = {}
    for k, t in SENTENCES[1::2]:
        by.setdefault(k, []).append(t)
    rows = [
        (1, " ".join(by["en"][:4]), "en"), (2, " ".join(by["en"][:4]), "en-GB"), (3, " ".join(by["de"][:4]), "EN"), (4, " ".join(by["fr"][:3]) + "\n" + by["es"][0], "fr"),
        (5, " ".join(by["es"][:3]), None), (6, " ".join(by["es"][:3]), "spanish"), (7, None, "en"), (8, "", None), (9, "1 2 3 ===", "en"), (10, " ".join(by["de"][:2]), "DE_at"), (10, " ".join(by["de"][:2]), "DE_at"),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, language string")
    assert {tuple(r) for r in L.wrong_labels(frame, model).collect()} == {(3, "de"), (4, "fr"), (4, "es"), (5, "es"), (6, "es")}
    every = L.document_languages(frame, model).collect()
    assert all(0 < r.confidence <= 1 for r in every)
    parts = [(r.segment, r.language, r.sentences) for r in sorted(L.segments(frame.where("doc_id = 4"), model).collect(), key=lambda r: r.segment)]
    assert parts == [(0, "fr", 3), (1, "es", 1)]
    assert L.wrong_labels(frame.limit(0), model).count() == 0


def test_very_long_text(spark, model):
    text = " ".join(t for k, t in SENTENCES if k == "en") * 40 + "y" * 50_000
    frame = spark.createDataFrame([(1, text, "de")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.wrong_labels(frame, model).collect()] == [(1, "en")]


def test_refit_learns_from_labelled_documents():
    docs = [(k, " ".join(t for language, t in SENTENCES[1::2] if language == k)) for k in PARTS] + [("en", " ".join(t for k, t in SENTENCES if k == "de"))]
    better = L.refit(SENTENCES[::2], docs)
    cosines = better.cosines([L.words_of(t) for _, t in SENTENCES])
    assert all(better.languages[k] == language for k, (language, _) in zip(cosines.argmax(axis=1), SENTENCES))


def test_refit_learns_phrases_that_look_foreign_to_the_samples():
    """Borrowed words make a phrase look French; labelled documents, a fifth of them labelled wrongly, say otherwise."""
    own = [(k, t) for k, t in SENTENCES[::2] if k in ("en", "fr")]
    strange = [f"{a} {b} {c} courtes notes manque" for a in ("Her", "His", "Their") for b in ("souvenir entree fits", "menu dessert suits", "boutique decor needs") for c in ("classic", "modern", "plain")]
    first = L.fit(own)
    assert all(first.languages[k] == "fr" for k in first.cosines([L.words_of(t) for t in strange]).argmax(axis=1))
    docs = [("fr" if at % 5 == 0 else "en", f"{text}. {SENTENCES[at % 27][1]}") for at, text in enumerate(strange * 5)]
    docs += [("fr", t) for k, t in SENTENCES if k == "fr"]
    better = L.refit(own, docs)
    assert all(better.languages[k] == "en" for k in better.cosines([L.words_of(t) for t in strange]).argmax(axis=1))
    cosines = better.cosines([L.words_of(t) for k, t in SENTENCES if k == "fr"])
    assert all(better.languages[k] == "fr" for k in cosines.argmax(axis=1))


def test_fit_is_the_same_in_any_process():
    """The order of sets differs from process to process; the model doesn't."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    code = "from millrace.llm import language as L; from tests.llm.test_language import SENTENCES as S; print(L.refit(S[::2], S[1::2]).centroids.sum(axis=0)[:50].tolist())"
    found = {subprocess.run([sys.executable, "-c", code], env={"PYTHONHASHSEED": seed, "PYTHONPATH": root}, cwd=root, capture_output=True, text=True, check=True).stdout for seed in "123"}
    assert len(found) == 1


def test_language_without_words():
    model = L.fit([*SENTENCES, ("xx", "1 2 3"), ("yy", "")])
    cosines = model.cosines([L.words_of(t) for _, t in SENTENCES])
    assert not ({model.languages[k] for k in cosines.argmax(axis=1)} & {"xx", "yy"})


def test_fit_from_tables(spark):
    samples = spark.createDataFrame([*SENTENCES, (None, "x"), ("en", None)], "language string, sample string")
    documents = spark.createDataFrame([(1, SENTENCES[0][1], "en"), (2, None, "en"), (3, "x", None)], "doc_id long, text string, lang string")
    assert L.fit_model(samples, documents).languages == ["de", "en", "es", "fr"]


def test_without_labelled_sentences_no_text_has_a_language(spark):
    samples = spark.createDataFrame([], "language string, sample string")
    documents = spark.createDataFrame([(1, SENTENCES[0][1], "en"), (2, None, None)], "doc_id long, text string, lang string")
    model = L.fit_model(samples, documents)
    assert model.languages == [] and L.fit_model(samples).languages == []
    assert L.wrong_labels(documents, model).count() == 0 and L.segments(documents, model).count() == 0
