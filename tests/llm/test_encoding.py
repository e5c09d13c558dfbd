import pytest

from marlstone.llm.encoding import candidates, garbled, undo

CLEAN = ["Zahlung über €12 bestätigt, schöne Grüße", "Votre colis a été expédié, à bientôt", "Saldo ₹500 – Brightwell", "don’t forget — it’s on the table", "Ваш заказ прибудет завтра. Спасибо!", "ok 👍 fine"]


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", ["Café Lumière", "₹500", "Grüße", "it’s"])
def test_every_chain_is_undone(text, wrong):
    """An exact round trip: encode as UTF-8, decode wrongly, and one of the candidates is the text as sent."""
    bad = "".join(bytes([b]).decode(wrong, "replace") if wrong != "cp1252" else bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())
    if "�" in bad:
        pytest.skip("bytes that this set leaves out are lost")
    assert text in [to for _, _, to in candidates(bad)]


def test_undo_follows_the_chain():
    twice = "it’s".encode().decode("cp1252").encode().decode("cp1252")
    chain = next(c for c, _, to in candidates(twice) if to == "it’s")
    assert undo(twice, chain) == "it’s"


def test_found_and_restored(spark):
    """Held-out rows: each clean text is left alone, each garbled copy comes back."""
    rows, want = [], {}
    n = 0
    for k in range(40):
        for t in CLEAN:
            n += 1
            rows.append((n, f"{t} {k}"))
    for t in CLEAN:
        for wrong in ("cp1252", "mac_roman", "cp437"):
            try:
                bad = t.encode().decode(wrong)
            except UnicodeDecodeError:
                continue
            n += 1
            rows.append((n, bad))
            want[n] = t
    rows += [(n + 1, "lost � here"), (n + 2, None), (n + 3, ""), (n + 4, "plain"), (n + 4, "plain")]
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("*", "'x' AS restored", "'y' AS chain")
    got = {r["id"]: r for r in garbled(df).collect()}
    assert {i: got[i]["restored"] for i in got if i in want} == want
    assert set(got) == set(want) | {n + 1}
    assert got[n + 1]["lossy"] and got[n + 1]["chain"] == "none"


def test_nothing_and_very_long(spark):
    empty = spark.createDataFrame([], "id bigint, text string")
    assert garbled(empty).count() == 0
    long = "it’s ".encode().decode("cp1252") * 4_000
    rows = [(1, long)] + [(k, "it’s fine") for k in range(2, 30)]
    got = garbled(spark.createDataFrame(rows, "id bigint, text string")).collect()
    assert [r["id"] for r in got] == [1] and got[0]["restored"] == "it’s " * 4_000


def test_rare_words_count(spark):
    """A swap leads to a word that the corpus holds twice only, behind more than 20,000 more frequent ones."""
    letters = "abcdefghijklmnopqrst"
    made = [f"{a}{b}é{c}{d}" for a in letters for b in letters for c in letters for d in letters[:3]]
    rows = [(k, " ".join(made[k : k + 100])) for k in range(0, len(made), 100)] * 3
    rows += [(80_000 + k, f"Die Zahlung ist bestätigt und schöne Grüße {k}") for k in range(9)]
    rows += [(90_000 + k, f"Ihr Paket liegt bei zzschöneberg bereit {k}") for k in range(2)]
    bad = "Ihr Paket liegt bei zzschöneberg bereit 7".encode("cp1252").decode("mac_roman")
    got = {r["id"]: r["restored"] for r in garbled(spark.createDataFrame([*rows, (99_999, bad)], "id bigint, text string")).collect()}
    assert got == {99_999: "Ihr Paket liegt bei zzschöneberg bereit 7"}


def test_no_result_depends_on_length(spark):
    """A garbled sentence is found and restored, and a clean one left alone, whatever stands around them and however long their words are."""
    clean, bad = "Zahlung bestätigt, schöne Grüße von Café Lumière", "Zahlung bestätigt, schöne Grüße von Café Lumière".encode().decode("cp1252")
    long = "ü".join(["lang"] * 60)
    rows = [(k, f"{clean} {k} {long}") for k in range(40)]
    rows += [(100, bad + " ok" * 20_000), (101, "ok " * 20_000 + bad), (102, f"{clean}. " * 300 + bad), (103, f"{clean}. " * 300), (104, "x" * 200_000 + " " + bad), (105, f"{long.encode().decode('cp1252')} da"), (106, "a" * 100_000 + "é")]
    got = {r["id"]: r["restored"] for r in garbled(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert got == {100: clean + " ok" * 20_000, 101: "ok " * 20_000 + clean, 102: f"{clean}. " * 300 + clean, 104: "x" * 200_000 + " " + clean, 105: f"{long} da"}
