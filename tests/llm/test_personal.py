import pytest
from hypothesis import given
from hypothesis import strategies as st

from marlstone.llm.personal import identifiers, normalised, personal_types, redact, redacted

CASES = [
    ("write me at zoe.radk@mail.example.net today", {"email"}),
    ("mail anouk85 [at] example [dot] com please", {"email"}),
    ("mail anouk85 at example dot com please", {"email"}),
    ("mail chiara53 @ in.webbox.test.", {"email"}),
    ("m​ail zo­e@exаmple.com", {"email"}),
    ("call +44 7700 900781", {"phone"}),
    ("call (359) 555-0179 or 359.555.0179", {"phone"}),
    ("call 0 55556 40271", {"phone"}),
    ("call ０７７００９０００１７ now", {"phone"}),
    ("call zero seven seven double zero nine double zero zero one seven", {"phone"}),
    ("PAN fykxl2974r linked.", {"identity_number"}),
    ("Passport no Z8069614 is on file.", {"identity_number"}),
    ("SSN on record: 956-23-8607.", {"identity_number"}),
    ("KYC done with ID UR 27 21 05 N.", {"identity_number"}),
    ("Id proof 1305-3074-7992 accepted for Kavya R. Sandalvar.", {"identity_number", "name"}),
    ("Deliver to 23 Kingfisher Street, Kestrel Bay.", {"street_address"}),
    ("Lieferung an Hafenstr. 184, 00521 Port Calloway.", {"street_address"}),
    ("Livraison au 83 rue du Vieux Puits, Altbruck.", {"street_address"}),
    ("NEFT of Rs 5 from ROHAN FENNICK deposited in A/c x1", {"name"}),
    ("Mrs Zarrindel left", {"name"}),
    # no cases
    ("paid to quillstoneshop@oklum from A/c XX3115", set()),
    ("Ref 643583473291 on card XXXXXX1015, SMS BLOCK to 56012", set()),
    ("2,985 spent at Saffron Lane Pharmacy in Brackenford", set()),
    ("Cab HZB1974 is booked, pick-up 2025-07-15 01:16", set()),
    ("", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_types(text, want):
    assert {k for *_, k in identifiers(text)} == want


def test_only_the_spans_change():
    text = "Hi 🙂 mail zo​e@example­.com or ring +44 7700 900781, ok?"
    assert redact(text, identifiers(text)) == "Hi 🙂 mail <EMAIL> or ring <PHONE>, ok?"


@given(st.text(alphabet=st.sampled_from("ab@.[ ]ﬁé́​１а9"), max_size=40))
def test_origins_stay_in_order(text):
    t, _ = normalised(text)
    if t.origin is not None:
        assert len(t.origin) == len(t.text) and t.origin == sorted(t.origin)
        assert all(0 <= o < e <= len(text) for o, e in zip(t.origin, t.ends))
    for a, b, _ in identifiers(text):
        assert 0 <= a < b <= len(text)


@pytest.mark.parametrize("disguised, kind", [
    ("bob at example dot com", "EMAIL"), ("bob [at] example [dot] com", "EMAIL"), ("bob @ example.com", "EMAIL"), ("b\u200bob@example.co\u00adm", "EMAIL"), ("bob＠example．com", "EMAIL"), ("ＢＯＢ@example.com", "EMAIL"),
    ("zero seven seven double zero nine double zero zero one seven", "PHONE"), ("zero one two three four five six seven eight nine", "PHONE"), ("５５５-０１２-３４５６", "PHONE"), ("020 7946 0958", "PHONE"),
    ("4111 1111 1111 1111", "IDENTITY_NUMBER"), ("4111-1111-1111-1111", "IDENTITY_NUMBER"), ("GB82 WEST 1234 5698 7654 32", "IDENTITY_NUMBER"), ("DE89370400440532013000", "IDENTITY_NUMBER"), ("Dr Oﬀ", "NAME"),
])
@pytest.mark.parametrize("after", ["", " please"])
def test_nothing_of_a_disguise_stays(disguised, kind, after):
    """Every disguise, also as the last words of a text, goes whole."""
    text = f"send it to {disguised}{after}"
    assert redact(text, identifiers(text)) == f"send it to <{kind}>{after}"


def test_numbers_with_wrong_check_digits_are_not_redacted_in_part():
    for text in ("order 4111 1111 1111 1112", "ref GB83 WEST 1234 5698 7654 32"):
        assert identifiers(text) == []


#: Sentences that no pattern was written for.
PLAIN = [
    ("My name is Anna Schmidt and I wait", "Anna Schmidt"), ("Dear Anna Schmidt, we have news", "Anna Schmidt"), ("All is well. Regards, Thomas Müller", "Thomas Müller"), ("Spoke with Priya Natarajan about it", "Priya Natarajan"),
    ("Sehr geehrter Thomas Müller, hallo", "Thomas Müller"), ("Mein Name ist Jürgen Klein.", "Jürgen Klein"), ("spoke to Dr. Mary Ann Lee.", "Mary Ann Lee"), ("Cordialement,\nChloé Besson", "Chloé Besson"),
]


@pytest.mark.parametrize("text, name", PLAIN)
def test_names_in_plain_sentences(text, name):
    spans = [(a, b) for a, b, k in identifiers(text) if k == "name"]
    assert len(spans) == 1 and name in text[slice(*spans[0])]


@pytest.mark.parametrize("text", ["Dear Customer, pay", "Dear Ostra Savings team", "Regards, Zuma Credit", "Regards,\nZuma Credit care desk", "Dear Sir", "spoke to Copper Kettle Fuels"])
def test_no_names(text):
    assert identifiers(text) == []


def test_names_by_the_corpus(spark):
    """Words of names, counted over all senders and announced names, make up names wherever they stand together."""
    people = [(a, b) for a in ("Ingrid", "Rohan", "Wilma", "Tariq") for b in ("Dravenhall", "Fennick", "Olsberg")]
    rows = [(k, "ok", f"{a} {b}") for k, (a, b) in enumerate(people)] + [(50 + k, "Copper Kettle has news", "VM-X") for k in range(9)]
    rows += [(100, "I saw Wilma Fennick and tariq olsberg at Copper Kettle with Rohan Someone", "x"), (101, "Ingrid Olsberg Fennick said so", "x"), (102, None, None), (103, "Ask for Wilma Fennick.", "x"), (None, "Wilma Fennick", "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, sender string").selectExpr("*", "1 AS pair", "2 AS word")
    got = {r["id"]: r["text"] for r in redacted(df).where("array_contains(text_types, 'name')").collect()}
    assert got == {100: "I saw <NAME> and tariq olsberg at Copper Kettle with Rohan Someone", 101: "<NAME> said so", 103: "Ask for <NAME>."}


def test_rows(spark):
    rows = [(1, "call +44 7700 900781", "a.b@c.example"), (2, None, None), (3, "", ""), (4, "nothing", "VM-LUMBNK"), (5, "x" * 100_000, "Ingrid Dravenhall"), (5, "x" * 100_000, "Ingrid Dravenhall"), (6, "me", "me"), (7, "t", "5600 0"), (8, "t", "+915555692302")]
    df = spark.createDataFrame(rows, "id bigint, text string, sender string").selectExpr("*", "1 AS types", "2 AS pii_type")
    got = sorted(tuple(r) for r in personal_types(df).collect())
    assert got == [(1, "sender", "email"), (1, "text", "phone"), (5, "sender", "name"), (5, "sender", "name"), (8, "sender", "phone")]
    assert personal_types(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail ravi <at> example <dot> com please", {"email"}),
        ("call zero.seven.seven.double zero.nine.double zero.zero.one.seven", {"phone"}),
        ("call zero\nseven\nseven\nzero\nzero\nnine\nzero\nzero\nzero\none\nseven", {"phone"}),
        ("home (12 Maple Street) is yours", {"street_address"}),
        ("home is 12 Maple Road; come", {"street_address"}),
        ("it's '12 Maple Lane'", {"street_address"}),
        ("ring/Mr Harlow", {"name"}),
        ("“Dr. Harlow” was here", {"name"}),
    ],
)
def test_nothing_that_a_pattern_accepts_is_left_at_the_gate(text, want):
    assert {k for *_, k in identifiers(text)} == want
