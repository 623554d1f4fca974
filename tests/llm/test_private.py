import pytest

from tidewright.llm import private as P

KEY = b"test key"


def kinds(text):
    return [(k, text[s:e]) for k, s, e in P.find(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Reach at mei.quist7@home.invalid.", [("email", "mei.quist7@home.invalid")]),
        ("cc bruno_hall at example [dot] com on letters", [("email", "bruno_hall at example [dot] com")]),
        ("x ANNE+CLINIC(at)mail dot northgate dot example", [("email", "ANNE+CLINIC(at)mail dot northgate dot example")]),
        ("Takes Pelmide 7.5 mg @ bedtime", []),
        ("Call +61 491-570-027 after 5", [("phone", "61 491-570-027")]),
        ("Tel: (276) 555-0120", [("phone", "276) 555-0120")]),
        ("Mobile 555-0129", [("phone", "555-0129")]),
        ("Dose window 500-1000 mg, batch 555 of 0100 vials", []),
        ("030/23125-279 or 01.99.00.97.76", [("phone", "030/23125-279"), ("phone", "01.99.00.97.76")]),
        ("BP 128/85, pulse 74. Platelets 283976, visit 2001-01-23", []),
        ("Form shows MRN# R812-6793, verified", [("id_number", "R812-6793")]),
        ("SSN: 000-66-3890, verified", [("id_number", "000-66-3890")]),
        ("973-35-1138 on file", [("id_number", "973-35-1138")]),
        ("Registered with NHS 999 729 9066", [("id_number", "999 729 9066")]),
        ("insurance member no. QAA426362171", [("id_number", "QAA426362171")]),
        ("NI number QQ 86 50 28 A", [("id_number", "QQ 86 50 28 A")]),
        ("Lives at 23b coringwick ave", [("street_address", "23b coringwick ave")]),
        ("Moved to 59 rue de Birchel, 00149 Branhaven now", [("street_address", "59 rue de Birchel, 00149 Branhaven")]),
        ("Home at Quillfordweg 12", [("street_address", "Quillfordweg 12")]),
        ("Grew up in Birchmoor, moved 7 times. Works nights at Amber Mill.", []),
        ("Brisk syndrome in remission, positive Harlow-Venn sign", []),
        ("Son P. Marsteriwicz manages the pill box", [("person_name", "P. Marsteriwicz")]),
        ("Referred by Harnurault, Pavel, community nurse", [("person_name", "Harnurault, Pavel")]),
        ("Followed by Dr. Zoë since May", [("person_name", "Zoë")]),
        ("pt soren njeriström slept", [("person_name", "soren njeriström")]),
        ("Emergency contact is Xolani Dube.", [("person_name", "Xolani Dube")]),
        ("pt maria walked home", [("person_name", "maria")]),
        ("pt soren njeristrom slept well", [("person_name", "soren njeristrom")]),
        ("please contact Wolfgang Huber", [("person_name", "Wolfgang Huber")]),
        ("Xiulan Zhou came", [("person_name", "Xiulan Zhou")]),
        ("Akua Mensah slept badly", [("person_name", "Akua Mensah")]),
        ("paid with 4111 1111 1111 1111 today", [("id_number", "4111 1111 1111 1111")]),
        ("lot 4111 1111 1111 1112 today", []),
        ("account GB82 WEST 1234 5698 7654 32.", [("id_number", "GB82 WEST 1234 5698 7654 32")]),
        ("Leila Clinic reopened", []),
        ("", []),
    ],
)
def test_mentions(text, want):
    assert kinds(text) == want


def test_feistel_is_a_permutation():
    for size in (2, 7, 10, 97, 1000):
        image = [P.permute(i, size, KEY, "t") for i in range(size)]
        assert sorted(image) == list(range(size))
        assert [P.permute(i, size, KEY, "t", invert=True) for i in image] == list(range(size))


def test_pseudonyms_keep_the_format_and_come_back():
    for value in ("263-555-0157", "R812-6793", "QQ 86 50 28 A", "ZZ7714398", "x9"):
        new = P.pseudonym(value, KEY)
        assert len(new) == len(value) and all((a.isdigit(), a.isalpha(), a.isupper()) == (b.isdigit(), b.isalpha(), b.isupper()) for a, b in zip(value, new))
        assert P.pseudonym(new, KEY, invert=True) == value
        assert P.pseudonym(value, b"another key") != new or len(value) < 4


def test_valid_numbers_and_dates_stay_valid():
    good = [f"{n:010d}" for n in range(9_990_000_000, 9_990_000_300) if P.nhs_valid(f"{n:010d}")]
    assert good
    for n in good[:5]:
        new = P.pseudonym(n, KEY)
        assert P.nhs_valid(new) and P.pseudonym(new, KEY, invert=True) == n
    for value, holds in (("4111111111111111", P.luhn_valid), ("GB82WEST12345698765432", P.iban_valid), ("123-45-6789", lambda v: P.ssn_valid(P.plain(v))), ("000-45-6789", lambda v: not P.ssn_valid(P.plain(v)))):
        new = P.pseudonym(value, KEY)
        assert holds(new) and new != value and P.pseudonym(new, KEY, invert=True) == value
    assert P.nanp_valid(P.plain(P.pseudonym("263-555-0157", KEY, "phone")))
    for value in ("2001-01-23", "03/12/1961", "25.12.1999", "12/25/1999", "3 March 2019", "March 3rd, 2019", "1 May 2020", "9 Sep. 2001"):
        new = P.pseudonym_date(value, KEY)
        assert P.is_date(new) and new != value and P.pseudonym_date(new, KEY, invert=True).replace("rd", "") == value.replace("rd", "")
    assert P.pseudonym_date("31/31/2001", KEY) == "31/31/2001"
    days = {P._day(next(m for r in P.DATES if (m := r.fullmatch(P.pseudonym_date(v, KEY)))))[0] for v in ("2019-03-03", "3 March 2019", "03.03.2019", "March 3, 2019")}
    assert len(days) == 1  # one day, one pseudonym


def test_redaction_links_equal_values():
    a, b = P.redact("Call 263-555-0157 now, BP 120/80", KEY), P.redact("Tel 263-555-0157", KEY)
    assert a.startswith("Call [PHONE ") and a.endswith("] now, BP 120/80") and "263-555-0157" not in a
    assert a[a.index("[") : a.index("]")] == b[b.index("[") : b.index("]")]
    assert P.redact("Ring +44 7700 900511 x", KEY).startswith("Ring [PHONE ")
    assert P.redact("nothing here", KEY) == "nothing here"
    with_code = P.redact("Tel +1 263-555-0157", KEY)
    assert with_code[with_code.index("-") - 3 : -1] == b[b.index("-") - 3 : -1]
    assert "03/12/1961" not in P.redact("born 03/12/1961, seen 3 March 2019", KEY) and "3 March 2019" not in P.redact("seen 3 March 2019", KEY)
    assert len(P.redact("Pt Mei reports pain", KEY).split()[2]) == P.TAG + 1


def test_recall_on_names_and_phrases_of_no_list():
    """Names that no list holds, after common cues: measured here, stated in the README."""
    names = [f"{a} {b}" for a, b in zip("Wolfgang Xiulan Akua Bjarne Thandiwe Rahul Ozan Ludmila Hiroshi Noemi".split(), "Huber Zhou Mensah Holm Nkosi Verma Demir Petrova Tanaka Keller".split(), strict=True)]
    said = ["spoke with {} by phone", "{} came to the clinic", "lives with {}", "Next of kin: {}", "her uncle {} drives", "{} said the pain eased", "letter from {} arrived", "Dr. {} agreed"]
    hit = sum(("person_name", n) in kinds(t.format(n)) for n in names for t in said)
    assert hit >= 0.85 * len(names) * len(said)


SCHEMA = "summary_id bigint, summary string, medical_history array<string>, kind string, t string"


def test_operators(spark):
    rows = [
        (1, "Pt Mei reports pain.", ["x", None, "Call 555-0170"], "k", "t"),
        (2, None, None, None, None),
        (3, "", [], "k", None),
        (1, "Pt Mei reports pain.", None, "k", "t"),
        (4, "noise " * 100_000 + "Call 555-0171", ["a" * 200_000, "A-" * 100_000, "Mei " * 2000], "k", "t"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.summary_id, r.field_name, r.elem_no, r.kind, r.begin_at) for r in P.mentions(df, "summary_id", ["summary"], ["medical_history"], KEY).where("summary_id < 4").collect())
    assert got == [(1, "medical_history", 3, "phone", 6), (1, "summary", 0, "person_name", 4), (1, "summary", 0, "person_name", 4)]
    assert ("phone", 600_006) in {(r.kind, r.begin_at) for r in P.mentions(df, "summary_id", ["summary"], ["medical_history"], KEY).where("summary_id = 4").collect()}
    red = P.redacted(df, ["summary"], ["medical_history"], KEY)
    assert red.columns == df.columns
    one = {r.summary_id: r for r in red.collect()}
    assert one[2].summary is None and one[2].medical_history is None and one[3].summary == "" and one[3].medical_history == []
    assert red.where("summary_id = 1 and medical_history is not null").first().medical_history[:2] == ["x", None]
    assert P.mentions(spark.createDataFrame([], SCHEMA), "summary_id", ["summary"], ["medical_history"], KEY).count() == 0
