import random

import pytest

from marlstone.llm.cuts import PIECE, _least, beginnings, by_source, cut, ends_early, ends_whole, shingles, whole, words_of

VOCABULARY = [a + b + c for a in ("ba", "ke", "li", "mo", "nu", "sa", "te") for b in ("rin", "lop", "mad", "nek", "sul", "tov", "wex") for c in ("a", "en", "is", "o", "um")]


def text(rng, n):
    return " ".join(rng.choice(VOCABULARY) + ("." if k % 9 == 8 else "") for k in range(n))


def test_endings():
    assert ends_whole("It is done.") and ends_whole("Really?”") and ends_whole("ok 🙂") and ends_whole("किया।")
    assert ends_whole("It costs Rs.") is False and ends_whole("he sai�") is False and ends_whole("[truncated]") is False
    assert ends_whole("and then the") is None and ends_whole("") is None
    assert not whole("It was. More text that sto", {}) and not whole("and twi...", {})
    assert whole("Done.\nThanks and best wishes", {"\nAhanks and best wishes": 1.0})
    assert not whole("Done.\nThanks and bes", {"\nAhanks and best wishes": 1.0})


def test_alignment():
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y zebra and more"
    assert ends_early(long[:-12], long) and not ends_early(long, long) and not ends_early("z y x w v u t s", long)


def own_keys(words):
    grade, key = beginnings(shingles(words))
    return set(key[grade == grade[-1]].tolist())


@pytest.mark.parametrize("kept", [0.1, 0.3, 0.5, 0.7, 0.9])
def test_a_cut_text_meets_its_original(kept):
    """Recall of the banding over originals of which any part is gone and the rest edited here and there."""
    rng, met, n = random.Random(1), 0, 80
    for _ in range(n):
        a = text(rng, rng.randint(100, 400)).replace(".", "").split()
        b = a[: int(kept * len(a))]
        for _ in range(len(b) // 80):
            b[rng.randrange(len(b))] = "edited"
        met += bool(own_keys(b) & set(beginnings(shingles(a))[1].tolist()))
    assert met / n >= 0.95


def test_long_texts_hash_alike_in_pieces():
    import numpy as np

    runs = np.random.default_rng(1).integers(0, 2**63, 2 * PIECE + 5).astype(np.uint64)
    starts = [0, 1, 2, 4, PIECE + 1]
    parts = [_least(runs[a:b], [0])[:, 0] for a, b in zip(starts, [*starts[1:], len(runs)])]
    assert (_least(runs, starts) == np.stack(parts, axis=1)).all()


def test_planted_originals(spark):
    """Texts cut at 30 to 90 % of an original, some edited, are found through it though their last sentence is whole."""
    rng, rows, planted = random.Random(5), [], []
    for k in range(60):
        a = text(rng, rng.randint(220, 400)).replace(".", "").split()
        b = a[: int(rng.uniform(0.3, 0.9) * len(a))]
        if k % 3 == 0:
            b[len(b) // 2] = "edited"
        rows += [(2 * k, " ".join(b) + "."), (2 * k + 1, " ".join(a) + ".")]
        planted.append(2 * k)
    got = {r["doc_id"] for r in cut(spark.createDataFrame(rows, "doc_id bigint, text string")).where("how = 'copy'").collect()}
    assert got <= set(planted) and len(got) >= 0.9 * len(planted)


def test_rows(spark):
    rng = random.Random(4)
    rows = [(k, text(rng, 60) + f" end of {k}.", "s1") for k in range(200)]
    rows += [(300 + k, text(rng, 60) + " and th", "s2") for k in range(20)]
    rows += [(400 + k, text(rng, 60) + ".\nSent from my handset", "s1") for k in range(30)]
    original = text(rng, 300) + "."
    ends = " ".join(original.split()[:279])  # a whole sentence, but a near-copy goes on
    rows += [(500, original, "s1"), (501, ends + ("" if ends.endswith(".") else "."), "s1"), (502, rows[200][1], "s1")]
    rows += [(600, None, "s1"), (601, "", "s1"), (602, "  ", None), (603, "yes " * 50_000 + "no.", None), (604, "Hi", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS h", "2 AS key", "3 AS closing")
    got = {r["doc_id"]: r["how"] for r in cut(df).collect()}
    assert got == {300 + k: "closing" for k in range(20)} | {501: "copy", 502: "closing", 604: "closing"}
    shares = {r["source"]: (r["documents"], r["cut"]) for r in by_source(df).collect()}
    assert shares["s2"] == (20, 20) and shares["s1"][1] == 2
    assert cut(df.limit(0)).count() == 0


def test_every_longer_near_copy_is_met(spark):
    """Cut variants stand next to each other by size; the copies that go on stand behind them, most edited elsewhere."""
    rng = random.Random(9)
    base = text(rng, 600).replace(".", "").split()
    variant = lambda k, n: [*base[:20], f"name{k}", *base[20:n]]
    rows = [(k, " ".join(variant(k, 560)) + ".") for k in range(12)]
    rows += [(100 + k, " ".join([*variant(k, 558), "so", "it", "ends", "here"]) + ".") for k in range(60)]
    rows += [(200, " ".join([*variant(3, 600), "and", "on"]) + ".")]
    got = sorted(r["doc_id"] for r in cut(spark.createDataFrame(rows, "doc_id bigint, text string")).where("how = 'copy'").collect())
    assert got == list(range(12))
    # The same by brute force.
    assert got == sorted({i for i, a in rows for j, b in rows if i != j and ends_early(a, b)})


def test_short_and_repeated_texts_are_met(spark):
    w = "here are ten small words that all stand by themselves again and".split()
    rows = [(k, " ".join(w[:k])) for k in (9, 10, 11)] + [(20, "la " * 60 + "lo."), (21, "la " * 90 + "lo lu.")]
    got = {r["doc_id"] for r in cut(spark.createDataFrame(rows, "doc_id bigint, text string")).where("how = 'copy'").collect()}
    assert got == {9, 10, 20} == {i for i, a in rows for j, b in rows if i != j and ends_early(a, b)}


def test_stock_sentences_that_begin_longer_texts_are_no_copies():
    a = "Thank you for your order today. We will write to you soon."
    assert not ends_early(a, a + " Until then keep well.") and ends_early(a[:-3], a + " Until then keep well.")


def test_a_third_of_all_texts_in_one_family(spark):
    """Copies of one original cut anywhere, each edited a little: every one but the longest is found, and in little time."""
    rng = random.Random(11)
    base = text(rng, 400).replace(".", "").split()
    rows = []
    for k in range(1500):
        words = base[: rng.randint(70, 380)]
        words[rng.randrange(len(words) - 12)] = f"edit{k}"
        rows.append((k, " ".join(words) + "."))
    rows.append((5000, " ".join(base) + "."))
    rows += [(10_000 + k, text(rng, 80) + " that is all.") for k in range(3000)]
    got = {r["doc_id"] for r in cut(spark.createDataFrame(rows, "doc_id bigint, text string")).where("how = 'copy'").collect()}
    assert len(got & set(range(1500))) >= 0.99 * 1500 and got <= set(range(1500))
