import itertools
import random

from marlstone.llm.lookalikes import Forms, UnionFind, unified

LATIN = {c: 1000 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"} | {"fi": 50, "é": 40}


def test_classes_are_transitive():
    u = UnionFind()
    u.join("a", "b")
    u.join("c", "d")
    u.join("b", "c")
    assert sorted(map(sorted, u.classes())) == [["a", "b", "c", "d"]]


def test_rewrites():
    odd = "\u200d１ａ𝐚ﬁé​ 　оеαο"
    f = Forms(LATIN | {c: 1 for c in odd} | {"é": 3, "о": 5, "е": 5})
    assert f.rewrite("ａ​b１") == "ab1"
    assert f.rewrite("conﬁrmed") == "confirmed"
    assert f.rewrite("café x") == "café x"
    assert f.rewrite("bооk tо") == "book to"
    # Real words of another script stay, also beside Latin ones.
    assert f.rewrite("Ваш заказ MDHDAY7") == "Ваш заказ MDHDAY7"
    assert f.rewrite("кoд") == "код"
    # Joiners that build an emoji stay, others go.
    assert f.rewrite("👩‍💻 o‍k") == "👩‍💻 ok"


def test_every_mixture_of_equal_letters_comes_out_equal():
    """All ways to write a word with letters of several scripts and styles, alone and within a Latin text."""
    like = {"p": "pрρｐ𝐩ᴘ", "a": "aаαａ", "y": "yуγ", "l": "lӏⅼʟ"}
    f = Forms(LATIN | {c: 1 for cs in like.values() for c in cs[1:]})
    mixed = {"".join(w) for w in itertools.product(*(like[c] for c in "paypal"))}
    assert {f.rewrite(f.rewrite(w)) for w in mixed} == {"paypal"}
    assert {f.rewrite(f.rewrite(f"due with {w} now")) for w in random.Random(1).sample(sorted(mixed), 500)} == {"due with paypal now"}
    assert f.rewrite("ꓑꓮꓬꓑꓮꓡ ᏢᎪYᏢᎪᏞ") == "PAYPAL PAYPAL"
    # With letters of its own a word is of its script, and so is a mixed word in a text of that script alone.
    assert f.rewrite("Ваш зaкaз") == "Ваш заказ"


def test_rows(spark):
    rows = [(1, "bооk"), (2, "book"), (3, None), (4, ""), (5, "Ваш заказ уже тут"), (6, "ａ" * 50_000), (6, "ａ" * 50_000), (7, "₹5 – “ok” é"), (8, "â‚¹5 x")] + [(k, "it’s ₹5 book") for k in range(10, 40)]
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("*", "0 AS unit", "0 AS n")
    got = sorted((r["id"], r["text"]) for r in unified(df).collect())
    assert got == [(1, "book"), (6, "a" * 50_000), (6, "a" * 50_000)]
    assert 8 in {r["id"] for r in unified(df, garbled=True).collect()}
    assert unified(df.limit(0)).count() == 0
