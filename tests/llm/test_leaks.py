import random
import re

from marlstone.llm.leaks import index, leaks, proximity

WORDS = "the of and maple heron lemon quartz delta moss amber 17 22 903 bank card sum".split()


def brute(docs, items, n):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, t in items:
        runs = {tuple(w(t)[k : k + n]) for k in range(len(w(t)) - n + 1)}
        for d, text in docs:
            x = w(text)
            if any(tuple(x[k : k + n]) in runs for k in range(len(x) - n + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice(WORDS) + str(rng.randint(0, 9) or "") for _ in range(rng.randint(3, 25)))) for k in range(30)] + [(90, None), (91, ""), (92, "the the the the the the")]
    docs = []
    for d in range(60):
        words = [rng.choice(WORDS) for _ in range(40)]
        src = rng.choice(items[:30])[1].split()
        at, n = rng.randint(0, len(src) - 1), rng.randint(2, 12)
        words[10:10] = [rng.choice([x, x.upper()]) + rng.choice(["", ",", " -", "\n>"]) for x in src[at : at + n]]
        docs.append((d, " ".join(words)))
    docs += [(100, None), (101, ""), (102, "the " * 30000), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS token", "2 AS position")
    it = spark.createDataFrame(items, "item_id bigint, sms string").selectExpr("*", "3 AS at", "4 AS n")
    for n in (3, 6):
        got = {tuple(r) for r in leaks(index(df), it, n).collect()}
        assert got == brute(docs, items, n)
    assert leaks(index(df.limit(0)), it).count() == 0 and leaks(index(df), it.limit(0)).count() == 0


def test_proximity_bridges_an_inserted_word(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "x one two three four five EXTRA six seven eight nine ten y"), (2, "one two three")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, sms string")
    assert [tuple(r) for r in proximity(index(docs), items, 8).collect()] == [(1, 7, 10, 5)]
    assert leaks(index(docs), items, 8).count() == 0


def test_one_stored_index_serves_many_searches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "three four five six")], "doc_id bigint, text string")
    path = f"file://{tmp_path}/index"
    index(docs, path=path)
    kept = index(docs.limit(0), path=path)  # read, not built
    of = lambda sms: sorted(tuple(r) for r in leaks(kept, spark.createDataFrame([(7, sms)], "item_id bigint, sms string"), 3).collect())
    assert of("Two, three, four") == [(1, 7)] and of("THREE four five") == [(1, 7), (2, 7)] and of("six five four") == []
