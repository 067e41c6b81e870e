"""Personal data: what is found, what isn't, and that all other text stays."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import normalise as N
from millrace.llm import personal as P

NAMES = P.COMMON | {"annika", "harriet", "kathe", "rocio", "elodie"}

FOUND = [
    ("Minutes taken by Harriet L. Fenwick-Low, approved.", "name", "Harriet L. Fenwick-Low"),
    ("Dr. FENLOW, Harriet asked", "name", "FENLOW, Harriet"),
    ("La riunione era guidata da di Gortini, Chiara e", "name", "di Gortini, Chiara"),
    ("La riunione era guidata da GORLOTTO, Chiara e", "name", "GORLOTTO, Chiara"),
    ("Wie Frau Käthe von Halmann sagte", "name", "Käthe von Halmann"),
    ("Das Gespräch leitete Annika VON CALKRUG und am", "name", "Annika VON CALKRUG"),
    ("a Rocío Daldugal Istgal antes", "name", "Rocío Daldugal Istgal"),
    ("Selon Mme Élodie R. de Calveau-Torgnac, les", "name", "Élodie R. de Calveau-Torgnac"),
    ("write to a.b+news@mail.example.org, please", "email", "a.b+news@mail.example.org"),
    ("write to a_b (at) mail (dot) example now", "email", "a_b (at) mail (dot) example"),
    ("write to ab[at]mail[dot]example[dot]org now", "email", "ab[at]mail[dot]example[dot]org"),
    ("write to ab @ example.com now", "email", "ab @ example.com"),
    ("<a href=\"mailto:X.Y@POST.TEST\">", "email", "X.Y@POST.TEST"),
    ("call +49 (0)30 23125-094 now", "phone", "+49 (0)30 23125-094"),
    ("call (303) 555-0157 now", "phone", "(303) 555-0157"),
    ("call 01.99.00.39.47 now", "phone", "01.99.00.39.47"),
    ("call 0049 171 3920021 now", "phone", "0049 171 3920021"),
    ("call 14155550181 now", "phone", "14155550181"),
    ("call zero one nine nine zero zero three nine four seven now", "phone", "zero one nine nine zero zero three nine four seven"),
    ("number 942-10-5207 in the box", "id", "942-10-5207"),
    ("number QQ 89 07 91 A in the box", "id", "QQ 89 07 91 A"),
    ("número 00.772.131-I en", "id", "00.772.131-I"),
    ("numéro 9 15 08 99 256 369 59 a", "id", "9 15 08 99 256 369 59"),
    ("codice PCMSSF 47U23 Z611G è", "id", "PCMSSF 47U23 Z611G"),
    ("lives at 163c Marrowgate Lane, Velmora", "addr", "163c Marrowgate Lane"),
    ("habite 121, chemin des Tilleuls Gris et ne", "addr", "121, chemin des Tilleuls Gris"),
    ("vive en Calle de la Mirabuena, 15 y", "addr", "Calle de la Mirabuena, 15"),
    ("mora na R. dos Moleiros, 84 e", "addr", "R. dos Moleiros, 84"),
    ("abita in Piazza San Orlando, 175 e", "addr", "Piazza San Orlando, 175"),
    ("ging an Mühlbruchstr. 69a, Valdeorla", "addr", "Mühlbruchstr. 69a"),
]

NOTHING = [
    "Thanks, Harriet. On Monday we moved it.", "ticket TCK-2025-32002 and part 00110-04 of 00400-11", "invoice 2585/30 of 2025-07-13 19:41:43",
    "host 192.0.2.179:2616, sha256:1530927242703646, build 1.3.0-rc5", "unit-filters@8.2.7 for @oncall", "tokens=16022 ms=2686; 37 773 rows",
    "Atlas Harvester v8 and Blue Meridian", "000000000000000000000017", "93 cracked wells, 724 bridges", "id a1113f53-60bd-4011-9e5e-073d0b19a4f1",
]


@pytest.mark.parametrize(("text", "kind", "piece"), FOUND)
def test_found(text, kind, piece):
    assert [(k, text[a:b]) for a, b, k in P.spans(text, NAMES)] == [(kind, piece)]


@pytest.mark.parametrize("text", NOTHING)
def test_nothing(text):
    assert P.spans(text, NAMES) == []


def test_spans_survive_invisible_and_lookalike_characters():
    text = "write to a​b@mаil.example now"
    assert [(k, text[a:b]) for a, b, k in P.spans(text)] == [("email", "a​b@mаil.example")]
    wide = "call ０１ ９９ ００ ３９ ４７ now"
    assert [text for a, b, k in P.spans(wide) for text in [wide[a:b]]] == ["０１ ９９ ００ ３９ ４７"]


def test_redaction_changes_nothing_else():
    whole = " | ".join(t for t, _, _ in FOUND[:-10]) + " plain end"
    clean = P.redact(whole, NAMES)
    at, out = 0, []
    for a, b, kind in P.spans(whole, NAMES):
        out += [re.escape(whole[at:a]), re.escape(f"[{kind.upper()}]")]
        at = b
    assert re.fullmatch("".join(out) + re.escape(whole[at:]), clean)
    assert P.redact(None) is None and P.redact("") == ""


def test_frames_with_nulls_repeats_and_long_texts(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "write to a@b.example or A@B.EXAMPLE", "k"), (3, "write to a@b.example", "k"), (4, "x" * 200_000 + " a@b.example", "k"), (None, "a@b.example", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    found = {tuple(r) for r in P.personal_found(frame).collect()}
    assert found == {(3, "email", "abexample"), (4, "email", "abexample"), (None, "email", "abexample")}
    clean = {(r.doc_id, r.n_replaced): r.text for r in P.redacted(frame).collect()}
    assert clean[1, 0] is None and clean[2, 0] == "" and clean[3, 2] == "write to [EMAIL] or [EMAIL]"
    assert P.personal_found(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_names_are_learnt_where_persons_stand(spark):
    """Zebulon signs, speaks and is greeted with three family names, so he is known in running text; Sorrel with two isn't, and Product is no person."""
    texts = [
        "all done.\n-- \nZebulon Fenmore\n", "[11:03] Daltal, Zebulon: it is done", "Dear Zebulon Krugmann,\nwe moved it", "Then Zebulon Fenmore asked Ms. Sorrel Fenmore", "Mr. Sorrel Daltal",
        "Later Zebulon Quarrow and Sorrel Quarrow left", "Product Launch and Product Design met Product Owner", None, "", "Dear Support Team,\n", "hello",
    ]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, kind string")
    assert P.given_names(frame) - P.COMMON == {"zebulon"}
    found = {(r.doc_id, r.found) for r in P.personal_found(frame.repartition(5)).collect()}
    assert found == {(0, "zebulonfenmore"), (1, "daltalzebulon"), (2, "zebulonkrugmann"), (3, "zebulonfenmore"), (3, "sorrelfenmore"), (4, "sorreldaltal"), (5, "zebulonquarrow")}
    clean = {r.doc_id: r.text for r in P.redacted(frame).collect()}
    assert clean[5] == "Later [NAME] and Sorrel Quarrow left" and clean[7] is None
    assert P.given_names(frame.limit(0)) == P.COMMON


PLACED = [
    ("The call with Richard Fenmore was short.", "Richard Fenmore"), ("Nous avons vu Sophie Calvel hier", "Sophie Calvel"), ("ha scritto Giuseppe Gortini ieri", "Giuseppe Gortini"),
    ("Then Mr. Zebulon Fenmore asked", "Zebulon Fenmore"), ("Wie Frau Ortrun von Halmann sagte", "Ortrun von Halmann"), ("Dr. FENLOW, Zebulon asked", "FENLOW, Zebulon"),
    ("Minutes taken by Zebulon T. Fenmore, approved", "Zebulon T. Fenmore"), ("Dear Zebulon Fenmore,\nwe moved it.", "Zebulon Fenmore"),
    ("[11:03] Fenmore, Zebulon: it is done", "Fenmore, Zebulon"), ("all done.\r\n-- \r\nZebulon Fenmore\r\n", "Zebulon Fenmore"), ("Best regards,\nZebulon Fenmore", "Zebulon Fenmore"),
    ("La conduzida por Istvidim Daltal, João e", "Istvidim Daltal, João"),
]


@pytest.mark.parametrize(("text", "piece"), PLACED)
def test_names_outside_the_first_list(text, piece):
    assert [(k, text[a:b]) for a, b, k in P.spans(text)] == [("name", piece)]


def test_owner_of_an_address_and_no_names_by_place():
    text = "| Zebulon Fenmore | z.f@mail.example |"
    assert [(k, text[a:b]) for a, b, k in P.spans(text)] == [("name", "Zebulon Fenmore"), ("email", "z.f@mail.example")]
    for text in ("Dear Support Team,\nwe", "[11:03] Open questions: none", "12 MS Office Files", "Hello Everyone Else, hi", "From: The Harvester\n", "Mr. Fenmore asked", "VENDIERON AMBER ABOUT 571"):
        assert P.spans(text) == []


@pytest.mark.parametrize("name", ["Pilar Ortega Calderón", "Antonio López Martín", "Lucía Ruiz Salazar", "Inês Prat Duarte", "JUAN VIDAL FERRER", "Maria Lopes Albuquerque"])
def test_second_family_names_of_any_ending(name):
    text = f"y {name} dijo"
    assert [(k, text[a:b]) for a, b, k in P.spans(text)] == [("name", name)]


@pytest.mark.parametrize(("text", "piece"), [("Laut Anna Krug Ende Mai", "Anna Krug"), ("met Sarah Fenwick Monday", "Sarah Fenwick"), ("JUAN VIDAL CON ELLA", "JUAN VIDAL"), ("Notes by Paul Fenlow And Others", "Paul Fenlow"), ("David Fenlow Ltd is", "David Fenlow")])
def test_words_after_a_name_that_are_no_second_family_name(text, piece):
    assert [(k, text[a:b]) for a, b, k in P.spans(text)] == [("name", piece)]


@given(st.text(alphabet=st.sampled_from("aZ9 .-İßŒﬁÉé\u0301ΑаВ５\u200b\u00a0–漢Σς𝐀K"), max_size=40))
def test_aligned_text_keeps_its_places(text):
    plain, places = N.aligned(text)
    assert len(plain) == (len(text) if places is None else len(places))
    if places is not None:
        assert [text[i] for i in places] == [c for c in text if c not in N.INVISIBLE]
    for at, char in enumerate(plain):
        assert char == N.aligned(text[at if places is None else places[at]])[0]


@given(st.text(alphabet=st.sampled_from("aZ9 .-ßŒﬁÉé\u0301ΑаВ５–漢"), max_size=40))
def test_plain_letters_as_character_by_character(text):
    assert N._PLAIN_OF.over(text) == text.translate(N._PLAIN)
