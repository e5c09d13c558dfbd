"""Derived messages: bank texts of each extractor's form, made from ``orders`` by SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import table, written

#: {S}: the engine's name of the string type.
_AMT = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS {S})"
_DAY = "substr(CAST(o_orderdate AS {S}), 9, 2)"
_MON = "substr(CAST(o_orderdate AS {S}), 6, 2)"
_YEAR = "substr(CAST(o_orderdate AS {S}), 1, 4)"
_ISO = f"{_YEAR} || '-' || {_MON} || '-' || {_DAY}"
_SLASH = f"{_DAY} || '/' || {_MON} || '/' || substr({_YEAR}, 3, 2)"
_NAMED = f"CASE CAST({_MON} AS INTEGER) WHEN 1 THEN 'Jan' WHEN 2 THEN 'FEB' WHEN 3 THEN 'Mar' WHEN 4 THEN 'apr' WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sep' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Xyz' ELSE 'Dec' END"
_DASH = f"{_DAY} || '-' || {_NAMED} || '-' || substr({_YEAR}, 3, 2)"
_JOINED = f"{_DAY} || {_NAMED} || substr({_YEAR}, 3, 2)"
_SHOP = "'Shop ' || CAST(o_custkey % 97 AS {S})"
_ACC = "substr(CAST(o_orderkey % 10000 + 10000 AS {S}), 2, 4)"

TEXTS = [
    f"'Sent Rs.' || {_AMT} || chr(10) || 'From HDFC Bank A/C *' || {_ACC} || chr(10) || 'To ' || {_SHOP} || chr(10) || 'On ' || {_SLASH} || chr(10) || 'Ref 9'",
    f"'Txn Rs.' || {_AMT} || ' On HDFC Bank Card ' || {_ACC} || ' At ' || {_SHOP} || ' by UPI 77 On ' || {_DASH} || ' Not You?'",
    f"'Spent Rs.' || {_AMT} || ' On HDFC Bank Card ' || {_ACC} || ' At ' || {_SHOP} || ' On ' || {_ISO} || ':10'",
    f"'Alert: Rs.' || {_AMT} || ' spent on HDFC Bank Card x' || {_ACC} || ' at ' || {_SHOP} || ' on ' || {_ISO} || '.'",
    f"'Credit Alert! Rs.' || {_AMT} || ' credited to HDFC Bank A/c XX' || {_ACC} || ' on ' || {_SLASH} || ' from VPA shop@pay (UPI 99)'",
    f"'Online Payment of Rs.' || {_AMT} || ' via NB was credited to your card ending ' || {_ACC} || ' On ' || {_DASH} || '.'",
    f"'INR ' || {_AMT} || ' deposited in HDFC Bank A/c XX' || {_ACC} || ' on ' || {_DASH} || ' for NEFT Cr-AAAA-' || {_SHOP} || '-X.Avl bal INR 5'",
    f"'Rs. ' || {_AMT} || ' refunded by ' || {_SHOP} || ' on ' || {_DAY} || '/' || {_NAMED} || '/' || {_YEAR} || ' to HDFC Bank Credit Card ' || {_ACC}",
    f"'INR ' || {_AMT} || ' spent using ICICI Bank Card XX' || {_ACC} || ' on ' || {_DASH} || ' on ' || {_SHOP} || '. Avl Limit: INR 9'",
    f"'ICICI Bank Credit Card XX' || {_ACC} || ' debited for INR ' || {_AMT} || ' on ' || {_DASH} || ' for UPI-123-' || {_SHOP} || '.. To dispute call'",
    f"'Payment of Rs ' || {_AMT} || ' has been received on your ICICI Bank Credit Card XX' || {_ACC} || ' through UPI on ' || {_DASH} || '.'",
    f"'Dear user, A/c X' || {_ACC} || '-credited by Rs.' || {_AMT} || ' on ' || {_JOINED} || ' transfer from ' || {_SHOP} || ' Ref No 7'",
    f"'Dear user, A/c X' || {_ACC} || '-debited by Rs.' || {_AMT} || ' on ' || {_JOINED} || ' transfer to ' || {_SHOP} || ' Ref No 8'",
    f"{_ACC} || ' is the OTP for Rs ' || {_AMT} || ' on card ending ' || {_ACC}",
    f"{_SHOP} || ' has requested money Rs.' || {_AMT} || ' from A/c XX' || {_ACC} || ', will be debited'",
    f"'Statement is sent. Total Amount Due Rs ' || {_AMT} || ' paid for card ' || {_ACC}",
    "CAST(NULL AS {S})",
    f"'Recharge plan expires, hours, we can help. Pre-approved loan of ' || {_AMT}",
]
SENDERS = ["'VM-LUMBNK'", "'+915555000001'", "'56012'", "'me'", "'Fepiho'", "CAST(NULL AS {S})", "'!!'", "'AD-BRTWEL'"]


def sms_sql(string: str, orders: str = "orders") -> str:
    """``(id, date, sender, text)`` from ``orders``."""
    texts = " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(TEXTS))
    senders = " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(SENDERS))
    out = (
        f"SELECT o_orderkey AS id, '202' || CAST(5 + o_orderkey % 2 AS {{S}}) || substr({_ISO}, 5) || 'T10:00:00' AS date, CASE o_custkey % {len(SENDERS)} {senders} END AS sender, "
        f"CASE o_orderkey % {len(TEXTS)} {texts} END AS text FROM " + orders
    )
    return out.replace("{S}", string)


def bank_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The view is parsed once; its name is never reused between calls.
    view = f"orders_{abs(hash(sf_dir)):x}"
    table(spark, sf_dir, "orders").createOrReplaceTempView(view)
    # Written once: a filter would else inline the text's long CASE into each of its patterns.
    return written(spark.sql(sms_sql("STRING", view)), "bank-messages")


BANK_SQL = f"({sms_sql('VARCHAR')})"
