import json
import re
from collections import Counter

import pytest

from marlstone.llm import pairs
from marlstone.llm.pairs import Answer, LabelModel, Languages, built_cases, defects, languages_of, trigrams, validated_cutoffs, votes

SMS = "Lumora Bank notice lemon: sum Rs.83.81 debited at Credit Card XX2443 toward Quillstone Sports heron counter 98099, trace nectar indigo 40144 stays open"
GOOD = '{"amount": 83.81, "counterparty": "Größe & Söhne", "type": "debit", "account": "Card XX2443"}'
CASES = [
    (GOOD, set()), ("null", set()), ("Null.", set()), (f"<think>I am sorry, I cannot see one.</think>\n{GOOD}", set()), (f"```json\n{GOOD}\n```", set()),
    (None, {"empty"}), ("", {"empty"}), ("<think>x</think>\n", {"empty"}), ("{}", {"empty"}), ("```json\n```", {"empty"}), ('""', {"empty"}),
    (GOOD[:40], {"truncated"}), (f"```json\n{GOOD[:30]}", {"truncated"}), ("<think>I cannot see a counterparty, sorry", {"truncated"}), ('{"amount": 1, "counterparty": {"title": "X"}', {"truncated"}),
    ("I'm sorry, but I can't help with that.", {"refusal"}), ('{"error": "I must decline: this is against my guidelines."}', {"refusal"}),
    (SMS, {"copy"}), (SMS.upper(), {"copy"}), (json.dumps({"text": SMS}), {"copy"}), (f"SMS: {SMS}\nOutput:", {"copy"}),
    ("Die Nachricht nennt eine Zahlung von 5 Rupien für Wren Cafe.", {"other_language"}), ('{"betrag": 5, "gegenpartei": "X", "konto": "Y"}', {"other_language"}), ("यह कोई लेनदेन नहीं है।", {"other_language"}),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, {"sms": SMS, "sender": "x"}, GOOD, [[GOOD]], [GOOD]) for k in range(1000, 1400)]
    rows += [(k, {"sms": SMS, "sender": "x"}, "null", [["null"]], ["null"]) for k in range(2000, 2200)]
    # Every kind of case several times, so that the model has something to learn from.
    rows += [(k * 10 + j, {"sms": SMS, "sender": "x"}, GOOD, [[a]], [a]) for k, (a, _) in enumerate(CASES) for j in range(5)]
    schema = "sample_id bigint, doc struct<sms:string,sender:string>, target string, resps array<array<string>>, filtered_resps array<string>"
    gold = [(k, SMS.replace("83.81", str(k)), GOOD if k % 2 else "null") for k in range(40)]
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 AS defect", "2 AS field"), spark.createDataFrame(gold, "item_id bigint, sms string, expected string")


def test_every_case(table):
    got = {}
    for r in defects(*table).collect():
        got.setdefault(r["sample_id"], set()).add(r["defect"])
    assert {i: d for i, d in got.items() if i >= 1000} == {}
    wrong = [(CASES[k][0], got.get(k * 10, set())) for k in range(len(CASES)) if got.get(k * 10, set()) != CASES[k][1]]
    assert wrong == []


def test_missing_parts(spark, table):
    s, g = table
    odd = spark.createDataFrame([(1, None, None, None, None), (2, {"sms": None, "sender": None}, "null", [], []), (3, {"sms": SMS, "sender": ""}, "null", [[]], [None])], s.drop("defect", "field").schema)
    both = s.drop("defect", "field").where("sample_id >= 1000").unionByName(odd)
    assert {(r["sample_id"], r["defect"]) for r in defects(both, g).collect()} == {(1, "empty"), (2, "empty"), (3, "empty")}
    assert defects(s.limit(0), g.limit(0)).count() == 0


#: Answers of words that no function was written for, with and without trigrams of their language.
UNSEEN = [
    ("I'd rather not do that.", {"refusal"}), ("Request denied for safety reasons.", {"refusal"}), ("I do not have permission to see your messages of this kind.", {"refusal"}), ("I would prefer not to answer.", {"refusal"}),
    ("Ich kann dabei leider nicht helfen.", {"refusal", "other_language"}), ("Lo siento, no puedo ayudar con eso.", {"refusal", "other_language"}),
    ("The message shows a payment of 500 to", {"truncated"}), ("The amount is 500 and the", {"truncated"}), ("nul", {"truncated"}), ("This is a debit of Rs 40 at some", {"truncated"}),
    ("Nessuna transazione.", {"other_language"}), ('{"belopp": 5}', {"other_language"}), ("Det här är ingen transaktion.", {"other_language"}),
    ("No transaction.", set()), ("This is not a transaction.", set()), ("The customer paid 500 to Wren Books.", set()),
]


def test_unseen_answers(spark, table):
    s, g = table
    texts = {
        "en": "The bank wrote that the customer made a payment to the shop and that this transaction is not yet posted; no message was sent about it.",
        "de": "Die Bank schreibt, dass der Kunde im Laden bezahlt hat; diese Buchung ist noch nicht gebucht und es gibt keine Nachricht dazu.",
        "es": "El banco escribe que el cliente pagó en la tienda; esta transacción no está registrada y ningún mensaje se ha enviado, nunca llegó nada.",
        "fr": "La banque écrit que le client a payé au magasin; cette transaction n'est pas enregistrée et aucun message n'a été envoyé.",
    }
    docs = spark.createDataFrame([(k * 10 + j, lang.upper(), t) for k, (lang, t) in enumerate(texts.items()) for j in range(5)] + [(99, None, "x"), (98, "de", None)], "doc_id bigint, lang string, text string")
    rows = spark.createDataFrame([(50_000 + k, {"sms": SMS, "sender": "x"}, GOOD, [[a]], [a]) for k, (a, _) in enumerate(UNSEEN)], s.drop("defect", "field").schema)
    got = {}
    for r in defects(s.drop("defect", "field").unionByName(rows), g, docs).where("sample_id >= 50000").collect():
        got.setdefault(r["sample_id"] - 50_000, set()).add(r["defect"])
    assert [(UNSEEN[k][0], got.get(k, set())) for k in range(len(UNSEEN)) if got.get(k, set()) != UNSEEN[k][1]] == []


def test_label_model_weighs_functions():
    """Two good functions against one that votes at random: the posteriors follow the good ones."""
    m = LabelModel({"yyn": 45, "yyy": 55, "nnn": 900, "nny": 900})
    assert m.posterior("yyn") > 0.9 and m.posterior("nny") < 0.1 and 0.03 < m.prior < 0.1
    assert abs(m.posterior("---") - m.prior) < 1e-9


def test_cutoffs_are_validated():
    models = {d: LabelModel({v: 1}) for d, v in votes(Answer(GOOD, SMS)).items()}
    cut = validated_cutoffs(models, built_cases([(SMS, GOOD)] * 30))
    assert set(cut) == {"empty", "truncated", "refusal", "copy", "other_language"} and all(0 < c < 1 for c in cut.values()) and len(set(cut.values())) > 1


def test_languages_count_every_document(spark, monkeypatch):
    """Far more documents than any draw would take, a word of its own in each, with their counts handed on in parts."""
    own = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    texts = [(k, ["en", "DE"][k % 2], f"Größe-{own(k)} ΑΣ, {own(k)}2{own(k * 7)}\u00a0x") for k in range(3000)]
    expected: dict[str, Counter] = {"en": Counter(), "de": Counter()}
    for _, lang, text in texts:
        expected[lang.lower()].update(trigrams(re.findall(r"[^\W\d_]+", text.lower())))
    counts = {}
    monkeypatch.setattr(pairs, "Languages", counts.update)
    languages_of(spark.createDataFrame([*texts, (-1, "en", None), (-2, None, "none"), (-3, "sv", "other")], "doc_id bigint, lang string, text string").repartition(3))
    assert counts == expected
    monkeypatch.setattr(pairs, "HELD", 50)
    parts = list(pairs._counted(iter([spark.createDataFrame(texts, "doc_id bigint, lang string, text string").selectExpr("lower(lang) AS lang", "text").toPandas()])))
    total = {k: Counter() for k in expected}
    for part in parts:
        for lang, gram, n in part.itertuples(index=False):
            total[lang][gram] += n
    assert total == expected and len(parts) > 10


def test_likelihoods_do_not_sink_with_more_documents():
    """A text with words that no document holds is as strange to a thousand times the documents."""
    text = "This is a perfectly ordinary sentence about the customer and the transaction that was made at Quixwyzzle Vjornqek.".lower().split()
    counts = {"en": Counter(trigrams(("this is a perfectly ordinary sentence about customer and the transaction that was made at " * 8000).split())), "de": Counter(trigrams(("dies ist ein gewöhnlicher satz " * 30000).split()))}
    few, many = (Languages({k: {g: n * times for g, n in c.items()} for k, c in counts.items()}).likely(text) for times in (1, 1000))
    assert few == pytest.approx(many, abs=0.01)


def test_every_item_validates(spark):
    """Cases come from every item of an unsorted evaluation set, each by its place in the order of ids."""
    items = [(k * 3, SMS.replace("83.81", str(k)), GOOD.replace("83.81", str(k)) if k % 2 else "null") for k in range(1500)]
    gold = spark.createDataFrame([*items[700:], (1, None, GOOD), (2, SMS, None), *items[:700]], "item_id bigint, sms string, expected string").repartition(5)
    judged = pairs.judged_items(gold, Languages({}))
    assert judged == pairs.judged_cases(built_cases([(sms, expected) for _, sms, expected in items]))


def test_items_beyond_the_first_move_the_cutoff(spark, table):
    """An apology that names the payment is no refusal where the later part of a long evaluation set has it."""
    s, _ = table
    answer = "Sorry, a debit of 5 at Wren Books."
    rows = spark.createDataFrame([(60_000, {"sms": SMS, "sender": "x"}, GOOD, [[answer]], [answer])], s.drop("defect", "field").schema)
    short = [(k, SMS.replace("83.81", str(k)), GOOD if k % 2 else "null") for k in range(400)]
    found = []
    for items in (short, short + [(k, SMS.replace("83.81", str(k)), answer) for k in range(400, 1000)]):
        got = defects(s.drop("defect", "field").unionByName(rows), spark.createDataFrame(items, "item_id bigint, sms string, expected string"))
        found.append({r["defect"] for r in got.where("sample_id = 60000").collect()})
    assert found == [{"refusal"}, set()]
