"""Text cut off by field limits: near-copies that go on, and closing-word terminality.

Near-copies are found through min-hash banding over the five-word shingles of all texts' beginnings, so that a text meets
its original however much of it is gone; they are aligned from the end of the shorter and verified as far as it goes, and
the copy whose alignment ends early was cut. For all other records the closing decides: whether the words that a text ends with
are words that texts end with. Closings and how often they close a text are counted over the whole corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import bounded_broadcast, require, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 7
#: Sets of so many shingles are similar by ``SIMILARITY`` only if they are equal.
EXACT = 8
#: A text that ends with a whole sentence is only held against its copies from so many words on: a few stock sentences
#: begin many texts by chance.
CHANCE_WORDS = 60
#: Shingles that are hashed at once.
PIECE = 16_384
#: A closing counts as one if this part of all documents end with it. So there are at most 1 / FREQUENT of them.
FREQUENT = 0.0003
#: The part of its occurrences that must end a text.
TERMINAL = 0.5
CLOSING_CHARS = 60

# What ends a sentence, what may stand after it, marks that a cut leaves, abbreviations, closings.
_ENDS = re.compile(r"[.?!।।。！？؟‽][\"'”’»)\]*_]*$")
_EMOJI = re.compile("(?:[☀-➿\U0001f000-\U0001faff]️?|[\U0001f1e6-\U0001f1ff]|‍)$|[:;]-?[)(DP]$")
_CUT_MARK = re.compile(r"(?:\.\.\.|…|\[(?:\.\.\.|…|more|cut|truncated|snip|continued)\]|\((?:more|cut|truncated|continued|…|\.\.\.)\)|�)\W*$", re.I)
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:[Rr]s|RS|No|Nr|Mr|Mrs|Ms|Dr|vs|e\.g|i\.e|n\.o|z\.B|approx|Ref|Tel|bzw|ca|Sra?|Mme)\.$")
_SIGNED = re.compile(r"(?i)^(?:--\s*\S.*|regards,?.*|best( wishes)?,?.*|thanks\b.*|sent from .+|see also:? https?://\S+|ref:? ?\S+|\(?page \d+\)?|\[end[^\]]*\]|[*\s-]{3,}|(?:[^\W\d_]\w*\s){1,3}(?:desk|team))$")
_URL = re.compile(r"https?://\S*")
_MASK = {**{ord(c): "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}}


def masked(text: str) -> str:
    """Capitals and digits alike, hosts of links alike: closings differ in names, numbers and codes only."""
    if "http" in text:
        text = _URL.sub(lambda m: "https://" + re.sub("[0-9]+", "0", re.sub("[a-z](?=[a-z]*[./])", "a", m[0].partition("//")[2])), text)
    return text.translate(_MASK)


def closing(text: str) -> str:
    """What stands after the last whole sentence or line, masked, at most ``CLOSING_CHARS`` of it; a line of its own keeps its line break."""
    end = text.rstrip()[-CLOSING_CHARS * 2 :]
    line = end.rfind("\n")
    sentence = max((m.end() for m in re.finditer(r"[.?!।][\"'”’)\]]*\s+", end)), default=-1)
    return masked(end[line:] if line >= sentence - 1 and line >= 0 else end[max(sentence, 0) :])[-CLOSING_CHARS:]


def ends_whole(text: str) -> bool | None:
    """True for a finished sentence or emoji, False for a mark of a cut; None where the closing has to decide."""
    t = text.rstrip()
    if not t:
        return None
    if _CUT_MARK.search(t):
        return None if t.endswith(("...", "…")) else False
    if _EMOJI.search(t):
        return True
    if _ENDS.search(t):
        return not _ABBREVIATION.search(t)
    if re.search(r"\S[”»\"]$", t):
        return True
    return None


def ending(text: str) -> tuple[bool | None, str | None, bool, str | None]:
    """What is judged of a text's end: ``ends_whole``, and where that leaves it open the closing, whether dots end it, and its last line."""
    known = ends_whole(text)
    if known is not None:
        return known, None, False, None
    line = text.rstrip().rsplit("\n", 1)
    return None, closing(text), text.rstrip().endswith(("...", "…")), line[1] if len(line) > 1 else None


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(i, *ending(t)) for i, t in zip(b["doc_id"], b["text"])]
        yield pd.DataFrame([x for x in out if x[1] is not True], columns=["doc_id", "known", "closing", "dots", "line"], dtype=object)


def _automaton(forms: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, f in enumerate(forms):
        out.add_word(f, (k, len(f)))
    if forms:
        out.make_automaton()
    return out


def _occurrences(forms: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(forms)
        n, last = np.zeros(len(forms), np.int64), np.zeros(len(forms), np.int64)
        for b in batches:
            for t in b["text"]:
                m = masked(t.rstrip())
                for end, (k, size) in automaton.iter(m):
                    # A closing stands at the beginning of a line or after a sentence.
                    start = end - size + 1
                    if start == 0 or m[start] == "\n" or m[start - 1] == "\n" or m[start - 1] == " " and m[start - 2 : start - 1] in ".?!।\"'”)]":
                        n[k] += 1
                        last[k] += end == len(m) - 1
        yield pd.DataFrame({"k": np.arange(len(forms)), "n": n, "last": last})

    return run


def terminality(rows: DataFrame, endings: DataFrame) -> dict[str, float]:
    """For each frequent closing of ``endings``, the part of its occurrences in all documents that end a text.

    At most 1 / ``FREQUENT`` closings can be that frequent, whatever the number of documents.
    """
    total = rows.count()
    least = max(3, math.ceil(FREQUENT * total))
    counted = endings.where("known IS NULL").groupBy("closing").count().where((F.col("count") >= least) & (F.trim("closing") != ""))
    forms = sorted(r["closing"] for r in counted.collect())
    if not forms:
        return {}
    seen = rows.mapInPandas(_occurrences(forms), "k bigint, n bigint, last bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("last").alias("last")).collect()
    return {forms[r["k"]]: r["last"] / r["n"] for r in seen if r["n"]}


def whole(text: str, closings: dict[str, float]) -> bool:
    """Whether ``text`` ends as texts end."""
    return judged(*ending(text), closings)


def judged(known: bool | None, form: str | None, dots: bool, line: str | None, closings: dict[str, float]) -> bool:
    """Whether an ``ending`` is one of those that end texts."""
    if known is not None:
        return known
    if form in closings and (not dots or len(form.split()) > 1):
        return closings[form] >= TERMINAL
    if dots:
        return False
    # A closing too rare to count: only if it looks like one and no frequent closing begins with it.
    return line is not None and bool(_SIGNED.match(line)) and not any(f.startswith(form) and len(f) > len(form) for f in closings)


# ---- near-copies -----------------------------------------------------------------------------------------------------


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def _run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return out ^ (out >> np.uint64(29)) ^ np.uint64(width)


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of the different runs of five words, in the order of their first occurrence; a shorter text is one run."""
    if not words:
        return np.zeros(0, np.uint64)
    runs = _run_hashes(_word_hashes(words), min(SHINGLE, len(words)))
    return runs[np.sort(np.unique(runs, return_index=True)[1])]


_A = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1 for k in range(1, BANDS * ROWS + 1)], dtype=np.uint64)
_B = np.array([xxhash.xxh64_intdigest(str(k)) for k in range(BANDS * ROWS)], dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(runs: np.ndarray) -> np.ndarray:
    out = runs[None, :] * _A[:, None] + _B[:, None]
    out ^= out >> np.uint64(32)
    return out


def _least(runs: np.ndarray, starts: list[int]) -> np.ndarray:
    """The min-hashes of each stretch; a long text goes piece by piece, so that memory stays bounded."""
    if len(runs) <= PIECE:
        return np.minimum.reduceat(_mixed(runs), starts, axis=1)
    stretches = zip(starts, [*starts[1:], len(runs)])
    return np.stack([np.min([_mixed(runs[k : min(k + PIECE, end)]).min(axis=1) for k in range(begin, end, PIECE)], axis=0) for begin, end in stretches], axis=1)


def beginnings(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(grade, key)`` of every band of the first 1, 2, 4, 8 … shingles: the min-hashes of all beginnings of a text.

    The first 2 ** ``grade`` shingles are the beginning. Two sets of up to ``EXACT`` shingles that are similar by 0.8 are
    equal, so one key of the whole set does for them.
    """
    grades = len(runs).bit_length()
    starts = [0, *(1 << g for g in range(grades - 1))]
    # The least of a beginning is the least of its stretches' least.
    least = np.minimum.accumulate(_least(runs[: 1 << (grades - 1)], starts), axis=1).reshape(BANDS, ROWS, grades)
    key = np.zeros((BANDS, grades), dtype=np.uint64)
    for r in range(ROWS):
        key = key * _MIX + (least[:, r] ^ (least[:, r] >> np.uint64(31)))
    grade = np.broadcast_to(np.arange(grades), key.shape)
    key = (key + np.arange(BANDS, dtype=np.uint64)[:, None]) * _MIX + grade.astype(np.uint64)
    sums = np.bitwise_xor.accumulate(runs[:EXACT] * _A[0] ^ (runs[:EXACT] >> np.uint64(32)))
    few = np.arange(min(grades, EXACT.bit_length()))
    exact = sums[(1 << few) - 1] * _MIX + few.astype(np.uint64)
    many = key[:, len(few) :]
    return np.concatenate([few, grade[:, len(few) :].ravel()]), np.concatenate([exact, many.ravel()])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of each beginning; ``own`` for those of the longest, in which a text is looked for."""
    for b in batches:
        ids, grades, keys, own = [], [np.zeros(0, int)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            words = words_of(t)
            if len(runs := shingles(words)):
                grade, key = beginnings(runs)
                ids += [i] * len(key)
                grades.append(grade)
                keys.append(key)
                own.append((grade == grade[-1]) & looked_for(t, words))
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, b.schema.field("doc_id").type), "grade": pa.array(np.concatenate(grades).astype(np.int8)), "bucket": pa.array(np.concatenate(keys).astype(np.int64)), "own": pa.array(np.concatenate(own))})


def going_on(a: list[str], b: list[str]) -> Iterator[int]:
    """Where in ``b`` the last word of ``a`` stands behind its final words, wherever ``b`` goes on from there."""
    tail = a[-2 * SHINGLE - 1 : -1]  # the last word may be cut itself
    if len(tail) >= SHINGLE:
        for at in range(len(tail), len(b)):
            if b[at].startswith(a[-1]) and b[at - len(tail) : at] == tail and (at + 1 < len(b) or len(b[at]) > len(a[-1])):
                yield at


def looked_for(text: str, words: list[str]) -> bool:
    """Whether a copy that goes on would tell that ``text`` was cut."""
    return len(words) > SHINGLE and (len(words) >= CHANCE_WORDS or not ends_whole(text))


def ends_early(short: str, long: str) -> bool:
    """Whether ``short`` is a near-copy of the beginning of ``long`` that ends where ``long`` goes on."""
    a, b = words_of(short), words_of(long)
    if not looked_for(short, a):
        return False
    if not (places := list(going_on(a, b))):
        return False
    x, y = shingles(a[:-1]), _run_hashes(_word_hashes(b), SHINGLE)
    begins = np.sort(np.unique(y, return_index=True)[1])
    # How many different shingles ``b`` has up to each of them, and how many of them are also in ``a``.
    shared = np.cumsum(np.isin(y[begins], x))
    n = np.searchsorted(begins, np.array(places) - SHINGLE, "right")
    both = shared[n - 1]
    return bool((both >= SIMILARITY * (len(x) + n - both)).any())


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": [i for i, short, long in zip(b["doc_id"], b["short"], b["long"]) if ends_early(short, long)]}, dtype=object)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``going_on`` asks of a text: its tail with its last word (``tail``), and where its runs of words stand with the word after them."""
    for b in batches:
        for i, t in zip(b.column("doc_id"), b.column("text").to_pylist()):
            w = words_of(t)
            hashes, n, full = _word_hashes(w), len(w), 2 * SHINGLE
            tails, runs, after, more, so_far = [], [], [], [], []
            if n > SHINGLE:
                width = min(full, n - 1)
                tails.append(int(_run_hashes(hashes[n - 1 - width : n - 1], width)[0]))
                after.append(w[-1])
                more.append(False)
                so_far.append(0)
            # How many different shingles end up to each word.
            fives = _run_hashes(hashes, SHINGLE)
            new = np.zeros(n + 1, int)
            new[np.unique(fives, return_index=True)[1] + SHINGLE] = 1
            different = np.cumsum(new).tolist()
            # A text of up to ten words has a shorter tail; it runs along the first words of its near-copies.
            for width in range(SHINGLE, full + 1):
                for k, h in enumerate(_run_hashes(hashes[: n if width == full else 2 * full], width).tolist()):
                    if k + width < n:
                        runs.append(h)
                        after.append(w[k + width])
                        more.append(k + width + 1 < n)
                        so_far.append(different[k + width])
            total = len(tails) + len(runs)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([i.as_py()] * total, b.schema.field("doc_id").type), "tail": pa.array([True] * len(tails) + [False] * len(runs), pa.bool_()),
                "run": pa.array(np.array(tails + runs, np.uint64).astype(np.int64)), "word": pa.array(after, pa.string()), "more": pa.array(more, pa.bool_()), "so_far": pa.array(so_far, pa.int32()),
            })


def ended_early(classes: DataFrame) -> DataFrame:
    """``doc_id`` of each text that is a near-copy of the beginning of a text that goes on where it ends.

    Banding is over beginnings: every text stands in the buckets of its first 1, 2, 4, 8 … shingles and is looked for in
    those of the longest alone, which covers more than half of it. However much of a text is gone, what is left meets
    the beginning of its original. Within a bucket a text is held against every longer one that has its final words with
    a going on behind them. One that goes on is enough, so the longer ones are taken in salted parts, four times as many
    each time, by the texts still without one, until they have it or all parts are through.
    """
    kind = dict(classes.dtypes)["doc_id"]
    bands = written(classes.select("doc_id", "text").mapInArrow(_banded, f"doc_id {kind}, grade tinyint, bucket bigint, own boolean"), "bands")
    # Buckets that some text is looked for in and that hold another one. Each goes by its least member: texts that share
    # many buckets, as in a large family of near-copies, share few names.
    met = bands.groupBy("bucket").agg(F.bool_or("own").alias("own"), F.count("*").alias("n"), F.min("doc_id").alias("name")).where("own AND n > 1")
    named = bands.join(bounded_broadcast(written(met.select("bucket", "name"), "met")), "bucket")
    buckets = written(named.groupBy("doc_id", "grade", "name").agg(F.bool_or("own").alias("own")), "buckets")
    shared = bounded_broadcast(written(buckets.select("doc_id").distinct(), "near-copies"))
    texts = written(classes.select("doc_id", "text").join(shared, "doc_id", "left_semi"), "near-texts")
    runs = written(texts.mapInArrow(_runs, f"doc_id {kind}, tail boolean, run bigint, word string, more boolean, so_far int"), "runs")
    tails = runs.where("tail").select("doc_id", "run", F.col("word").alias("last"))
    # A tail's last word may be cut itself: the word behind the run has to begin with it, and something has to follow.
    asked = tails.select("run", F.length("last").alias("n")).distinct()
    on = runs.where("NOT tail").join(asked, "run").where("n < length(word) OR n = length(word) AND more")
    on = on.select(F.col("doc_id").alias("other"), "run", F.substring("word", F.lit(1), F.col("n")).alias("last"), "so_far").distinct()
    at = F.xxhash64("grade", "name", "run", "last").alias("at")
    # Where a text of a grade can end in a text that is similar up to there.
    size = F.pow(F.lit(2.0), F.col("grade"))
    within = (F.col("so_far") >= SIMILARITY * (size - 1)) & (F.col("so_far") <= 2 * size / SIMILARITY)
    goes = on.join(buckets.select(F.col("doc_id").alias("other"), "grade", "name"), "other").where(within).select(at, "other").distinct()
    # Parts are powers of two, so that texts are in the same part of all buckets of like size.
    parts = written(goes.groupBy("at").agg(F.pow(F.lit(2), F.ceil(F.log2(F.count("*").cast("double")))).cast("bigint").alias("parts")), "going-on-parts")
    goes = written(goes.join(parts, "at").withColumn("part", F.pmod(F.xxhash64("other"), "parts")), "going-on")
    open_ = written(tails.join(buckets.where("own"), "doc_id").select(at, "doc_id").join(parts, "at"), "open-ends")
    found, begin, end = None, 0, 1
    while not open_.isEmpty():
        mine = open_.withColumn("step", F.explode(F.sequence(F.lit(begin), F.least(F.lit(end), F.col("parts")) - 1)))
        mine = mine.withColumn("part", F.pmod(F.xxhash64("doc_id") + F.col("step"), "parts"))
        pairs = written(mine.join(goes.drop("parts"), ["at", "part"]).where("doc_id <> other").select("doc_id", "other").distinct(), "near-pairs")
        a, b = texts.withColumnRenamed("text", "short"), texts.select(F.col("doc_id").alias("other"), F.col("text").alias("long"))
        now = written(pairs.join(a, "doc_id").join(b, "other").mapInPandas(_aligned, f"doc_id {kind}").distinct(), "goes-on")
        found = now if found is None else found.unionByName(now)
        open_ = written(open_.where(F.col("parts") > end).join(now, "doc_id", "left_anti"), "open-ends")
        begin, end = end, 4 * end
    return classes.select("doc_id").limit(0) if found is None else found.distinct()


def cut(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, how)`` of each cut document: ``copy`` if a near-copy goes on, else ``closing``.

    Null and blank texts aren't cut. Exact copies of a cut text are cut too: texts are compared as classes, then every
    member gets its class's answer. A tie in size goes by id; extra columns are ignored.
    """
    docs = require(documents, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"(?U)\S"))
    kind = dict(docs.dtypes)["doc_id"]
    member = docs.select("doc_id", F.md5("text").alias("h"), F.xxhash64("text").alias("x"))
    first = written(member.groupBy("h", "x").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "text-classes")
    classes = docs.join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    early = ended_early(classes)
    # From class representatives back to every member of their class.
    by_copy = written(first.join(early.withColumnRenamed("doc_id", "rep"), "rep", "left_semi").join(member, ["h", "x"]).select("doc_id"), "ended-early")
    # Texts are read for their endings once; whole ones are done with.
    endings = written(docs.mapInPandas(_endings, f"doc_id {kind}, known boolean, closing string, dots boolean, line string"), "endings")
    closings = terminality(docs.select("text"), endings)

    def cut_ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = zip(b["doc_id"], b["known"], b["closing"], b["dots"], b["line"])
            yield pd.DataFrame({"doc_id": [i for i, known, *rest in ends if not judged(None if pd.isna(known) else bool(known), *rest, closings)]}, dtype=object)

    rest = endings.join(by_copy, "doc_id", "left_anti").mapInPandas(cut_ones, f"doc_id {kind}")
    return by_copy.withColumn("how", F.lit("copy")).unionByName(rest.withColumn("how", F.lit("closing")))


def by_source(documents: DataFrame) -> DataFrame:
    """For each source: documents, cut ones and their share, and the most frequent length in characters of the cut ones."""
    found = cut(documents).select("doc_id", F.lit(1).alias("cut"))
    d = documents.select("doc_id", "source", F.char_length("text").alias("length")).join(found, "doc_id", "left")
    return d.groupBy("source").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("cut"), F.lit(0)).alias("cut"), F.round(F.coalesce(F.sum("cut"), F.lit(0)) / F.count("*"), 6).alias("share"),
        F.mode(F.when(F.col("cut") == 1, F.col("length")), True).alias("usual_length"),
    )
