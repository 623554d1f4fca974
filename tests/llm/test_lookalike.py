import unicodedata

from tidewright.llm import lookalike as L

PLAIN = "The final café offer (No. 5), soaked"
ALIKE = [
    PLAIN.replace("a", "а").replace("o", "о"),  # Cyrillic
    unicodedata.normalize("NFD", PLAIN),
    PLAIN.replace(" ", " "),
    PLAIN[:4] + "​﻿­" + PLAIN[4:],
    "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in PLAIN),
    PLAIN.replace("fi", "ﬁ").replace("ff", "ﬀ"),
    PLAIN.replace("T", "Τ"),  # Greek
]
APART = [PLAIN.lower(), PLAIN.replace("é", "e"), PLAIN.replace("5", "⁵"), PLAIN + ".", PLAIN.replace(" ", "\n", 1), PLAIN.replace(" ", "  ", 1), "", None]


def test_skeletons():
    assert all(L.skeleton(t) == L.skeleton(PLAIN) for t in ALIKE)
    assert all(L.skeleton(t) != L.skeleton(PLAIN) for t in APART if t is not None)
    assert L.skeleton("10 µg") == L.skeleton("10 μg") and L.skeleton("m²") != L.skeleton("m2")
    assert L.skeleton("a\r\nb") == L.skeleton("a\nb")


def test_letters_of_other_scripts_and_fonts():
    for shown, plain in (("ꓮꓐꓪ", "ABW"), ("Ⲟⲟ", "Oo"), ("𝐀𝗛ℍ", "AHH"), ("ᴏᴠᴢ", "ovz"), ("ᎪᎢᏚ", "ATS"), ("ιυγı", "iuyi"), ("β", "ß"), ("κτ", "кт"), ("𝛂", "a")):
        assert L.skeleton(shown) == L.skeleton(plain)
    assert L.skeleton("0") != L.skeleton("O") and L.skeleton("1") != L.skeleton("l") and L.skeleton("ᴀ") != L.skeleton("a")


def test_skeleton_of_a_skeleton():
    for t in [*ALIKE, "ﬁ", "ё", "Å", "µ", "ﾊﾞ", "β", "κ", "𝛂", "ᴛ"]:
        assert L.skeleton(L.skeleton(t)) == L.skeleton(t)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", b"y") for i, t in enumerate(texts)], "doc_id bigint, text string, look string, exact binary")


def test_pairs_against_brute_force(spark):
    texts = [PLAIN, *ALIKE, *APART, PLAIN, ALIKE[0], "", None, "​"]
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and a != b and L.skeleton(a) == L.skeleton(b)}
    got = {(r.doc_id_a, r.doc_id_b) for r in L.alike_pairs(docs(spark, texts)).collect()}
    assert got == want
    classes = {r.doc_id: (r.class_id, r.n_forms, r.n_texts) for r in L.alike_classes(docs(spark, texts)).collect()}
    assert classes[0] == (0, 8, 10) and len(classes) == sum(bool(t) for t in texts)


def test_forms_empty_and_long(spark):
    long = "о" * 300_000
    got = {r.doc_id: r.text_form for r in L.one_form(docs(spark, [long, None, "", ALIKE[1]])).collect()}
    assert got == {0: "o" * 300_000, 1: None, 2: "", 3: PLAIN}
    assert L.alike_pairs(docs(spark, [])).count() == 0 and L.alike_classes(docs(spark, [])).count() == 0


def test_a_text_with_very_many_copies(spark):
    texts = [PLAIN] * 3000 + [ALIKE[0]] + [f"other {i}" for i in range(2000)] + [f"оther {i}" for i in range(3)]
    got = {(r.doc_id_a, r.doc_id_b) for r in L.alike_pairs(docs(spark, texts)).collect()}
    assert got == {(i, 3000) for i in range(3000)} | {(3001 + i, 5001 + i) for i in range(3)}
