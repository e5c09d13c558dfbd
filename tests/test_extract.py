import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import patterns as P
from marlstone.operators.extract import amount, date, other_category, transaction, transaction_category, which_extractor

MESSAGES = {
    "hdfc_sent": ("Sent Rs.1,250.50\nFrom HDFC Bank A/C *1234\nTo Oak Shop\nOn 05/03/25\nRef 1", (1250.5, "Oak Shop", "05-03-2025", "debit", "A/C *1234")),
    "hdfc_txn_card": ("Txn Rs.99 On HDFC Bank Card 1234 At Oak Shop by UPI 55 On 7-Mar-25 x", (99.0, "Oak Shop", "07-03-2025", "debit", "Card 1234")),
    "hdfc_spent_on": ("Spent Rs.99.5 On HDFC Bank Card 1234 At Oak Shop On 2025-03-07:10:00", (99.5, "Oak Shop", "07-03-2025", "debit", "Card 1234")),
    "hdfc_rs_spent": ("Rs.12 spent on HDFC Bank Card x1234 at Oak Shop on 2025-03-07.", (12.0, "Oak Shop", "07-03-2025", "debit", "Card x1234")),
    "hdfc_credit_alert": ("Credit Alert!\nRs.5 credited to HDFC Bank A/c XX12 on 07-03-25 from VPA oak@pay (UPI 9)", (5.0, "oak@pay", "07-03-2025", "credit", "A/c XX12")),
    "hdfc_card_payment": ("Online Payment of Rs.5 via X was credited to your card ending 1234 On 7/MAR/2025", (5.0, None, "07-03-2025", "credit", "card ending 1234")),
    "hdfc_neft_deposit": ("INR 5,000 deposited in HDFC Bank A/c XX12 on 07-MAR-25 for NEFT Cr-AB12-Oak Ltd-X.Avl bal", (5000.0, "Oak Ltd", "07-03-2025", "credit", "A/c XX12")),
    "hdfc_refund": ("Rs. 5 refunded by Oak Shop on 07/MAR/2025 to your HDFC Bank Credit Card 1234", (5.0, "Oak Shop", "07-03-2025", "credit", "Credit Card 1234")),
    "icici_spent": ("INR 5.00 spent using ICICI Bank Card XX12 on 07-Mar-25 on Oak Shop. Avl Limit", (5.0, "Oak Shop", "07-03-2025", "debit", "Card XX12")),
    "icici_debited": ("ICICI Bank Credit Card XX12 debited for INR 5.00 on 07-Mar-25 for UPI-55-Oak Shop.. To dispute call", (5.0, "Oak Shop", "07-03-2025", "debit", "Credit Card XX12")),
    "icici_payment": ("Payment of Rs 5 has been received on your ICICI Bank Credit Card XX12 through UPI on 07-MAR-25.", (5.0, None, "07-03-2025", "credit", "Credit Card XX12")),
    "sbi_credit": ("A/c X12-credited by Rs.5 on 07Mar25 transfer from Oak Ref No 1", (5.0, "Oak", "07-03-2025", "credit", "A/c X12")),
    "sbi_debit": ("A/c X12-debited by Rs.5 on 07Mar25 transfer to Oak Ref No 1", (5.0, "Oak", "07-03-2025", "debit", "A/c X12")),
}


def test_each_extractor(spark):
    rows = [(n, t) for n, (t, _) in MESSAGES.items()] + [("none", "hello"), ("null", None), ("empty", ""), ("long", "x" * 100_000)]
    df = spark.createDataFrame(rows, "n string, t string").select("n", which_extractor(F.col("t")).alias("w"), transaction(F.col("t")).alias("x"))
    got = {r["n"]: r for r in df.collect()}
    assert {n: (got[n]["w"], tuple(got[n]["x"])) for n in MESSAGES} == {n: (n, want) for n, (_, want) in MESSAGES.items()}
    assert all(got[n]["x"] is None for n in ("none", "null", "empty", "long"))


def python_date(raw):
    """Written from the description of the shapes alone."""
    raw = re.sub(r"\.+$", "", raw.strip())
    mon = dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), (f"{k:02d}" for k in range(1, 13))))
    shapes = [
        (r"(\d{4})-(\d{2})-(\d{2})", lambda a, b, c: f"{c}-{b}-{a}"),
        (r"(\d{1,2})/(\d{2})/(\d{2})$", lambda a, b, c: f"{a:0>2}-{b}-20{c}"),
        (r"(\d{1,2})/([A-Za-z]{3})/(\d{4})", lambda a, b, c: f"{a:0>2}-{mon[b.lower()]}-{c}"),
        (r"(\d{1,2})-([A-Za-z]{3})-(\d{2,4})", lambda a, b, c: f"{a:0>2}-{mon[b.lower()]}-{c if len(c) == 4 else '20' + c}"),
        (r"(\d{1,2})([A-Za-z]{3})(\d{2})$", lambda a, b, c: f"{a:0>2}-{mon[b.lower()]}-20{c}"),
        (r"(\d{2})-(\d{2})-(\d{2})$", lambda a, b, c: f"{a}-{b}-20{c}"),
    ]
    for p, to in shapes:
        if m := re.match(p, raw):
            try:
                return to(*m.groups())
            except KeyError:
                return raw
    return raw


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.from_regex(r"[0-9]{1,4}[-/]([0-9]{2}|Jan|OCT|xyz)[-/][0-9]{2,4}[. ]{0,2}", fullmatch=True), st.from_regex(r"[0-9]{1,2}(Feb|dec|Foo)[0-9]{2}\.?", fullmatch=True), st.sampled_from(["99/99/26", "", " ", "2025-01-02T10", "x"])), min_size=1, max_size=60))
def test_dates(spark, raws):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, r string").select("k", date(F.col("r")).alias("d"))
    assert {r["k"]: r["d"] for r in df.collect()} == {k: python_date(r) for k, r in enumerate(raws)}


def test_amounts_and_categories(spark):
    df = spark.createDataFrame([("1,250.50",), (",",), ("",), (None,), ("12",)], "t string")
    assert [r[0] for r in df.select(amount(F.col("t"))).collect()] == [1250.5, None, None, None, 12.0]
    texts = [(t,) for t in ("Txn Rs.5\nOn HDFC Bank Card 1", "Sent  Rs 5", "hello", None)]
    got = [tuple(r) for r in spark.createDataFrame(texts, "t string").select(transaction_category(F.col("t")), other_category(F.col("t"))).collect()]
    assert [g[0] for g in got] == ["hdfc_txn", "hdfc_sent", "other", "other"]
    # The other categories don't read across lines.
    lines = spark.createDataFrame([("minimum\ndue by",), ("minimum x due by",), ("one time pass",), ("Recharge now",)], "t string")
    assert [r[0] for r in lines.select(other_category(F.col("t"))).collect()] == ["other", "statement", "otp", "telecom"]
    assert len(P.EXTRACTORS) == 13
