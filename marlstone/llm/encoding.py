"""Garbled text from wrong character encoding: found and restored by minimum description length.

Every way a text can have been decoded wrongly (a *chain*) is undone where it can be; each candidate is compressed with
one zstandard dictionary per language, and the chain with the shortest description, its own cost included, wins. A text
that no chain shortens stays as it is. Only the words that hold non-ASCII characters, with a word on either side, are
compressed: the rest is the same in every candidate.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import bounded_broadcast, require, written

#: Dictionary sizes are bounded for each language: so many phrases, the most frequent over all rows, and so many bytes.
PHRASES = 4000
DICTIONARY_BYTES = 64_000
#: Word counts that a task keeps.
KEPT = 500_000
LEVEL = 9
#: Characters of segments that are decided about together.
PART = 2000
#: Bytes that a chain costs. A swap of single-byte sets explains any accented letter, but has to lead to known words.
COST = {"utf8": 1.0, "utf8 twice": 2.0, "single": 1.0}
#: Bytes to spell a character that no dictionary holds. All text is described in UTF-16, so that scripts cost alike.
ESCAPE = 5.0
#: A phrase is noise if one of its candidates is this many times as frequent.
NOISE = 4

# Character sets that exporters decode with by mistake.
WRONG = ["cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp1253", "cp1250", "mac_cyrillic"]
# Single-byte sets that were really meant, for each one used by mistake.
SINGLE = {"cp437": ["cp1252"], "cp850": ["cp1252"], "mac_roman": ["cp1252"], "cp1252": ["mac_roman", "cp437", "cp850"], "cp1251": ["cp1252"], "koi8_r": ["cp1251"], "cp866": ["cp1251"]}
# Frequent words that tell languages of the Latin script apart.
STOPWORDS = {
    "de": "der|die|das|ist|wird|von|für|und|Ihr|Ihre|Bitte|am|über|wurde|schöne",
    "fr": "le|la|les|est|été|votre|de la|chez|avant|régler|paiement|colis|accès|Numéro",
    "es": "el|su|los|llegará|pago|cargo|operación|cliente|más|código|envío|por",
    "pt": "na|sua|não|com|desconto|débito|conta|em|operação|pontos|mais",
}

CYRILLIC = ("cp1251", "koi8_r", "cp866", "mac_cyrillic")
MARK = re.compile("[\u0300-\u036f]")
# From a word's beginning on and without going back, so that long words take no more than their length.
_ODD = r"[\x00-\x08\x0e-\x1f!-\x7f]*+[^\x00-\x7f][^\s]*+"
_WORD = rf"(?<![^\s])(?:[^\s]++ )?{_ODD}(?: [^\s]++)?"
SEGMENT = re.compile(_WORD, re.ASCII)
NON_ASCII_WORD = re.compile(rf"(?<![^\s]){_ODD}", re.ASCII)
ZEROS = {ord(c): "0" for c in "123456789"}
DAMAGE = re.compile("[�\x80-\x9f]")


def _byte_chars(charset: str) -> list[str]:
    """The character of each byte; bytes a Windows set leaves out become control characters, as exporters do it."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache
def _undo_utf8(charset: str) -> tuple[re.Pattern, dict[str, int]]:
    """The characters that ``charset`` makes of UTF-8 sequences, and the bytes behind them."""
    chars = _byte_chars(charset)
    of = {c: b for b, c in enumerate(chars) if b >= 0x80}
    if charset == "cp1252":  # control characters of bytes that it does define: from the ISO set
        of |= {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in of}
    group = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in of.items() if lo <= b <= hi) + "]"
    tail = group(0x80, 0xBF)
    return re.compile(f"(?:{group(0xC2, 0xDF)}{tail}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xF0, 0xF4)}{tail}{{3}})+"), of


def _from_utf8(text: str, charset: str) -> str:
    pattern, of = _undo_utf8(charset)

    def back(m: re.Match) -> str:
        try:
            return bytes(of[c] for c in m[0]).decode()
        except UnicodeDecodeError:
            return m[0]

    return pattern.sub(back, text)


@lru_cache
def _swap(wrong: str, meant: str) -> dict[int, str]:
    a, b = _byte_chars(wrong), _byte_chars(meant)
    return {ord(a[i]): b[i] for i in range(0x80, 256) if b[i].isprintable() and a[i].isprintable()}


#: Ranges that no wrong decoding can leave (checked below); a text of these and ASCII only is as it was sent.
UNTOUCHED = [(0x0900, 0x0DFF), (0x200B, 0x200D), (0x2060, 0x2060), (0x20B9, 0x20B9), (0x2600, 0x27BF), (0x3000, 0x30FF), (0xFE00, 0xFE0F), (0xFF00, 0xFFEF), (0x1D400, 0x1D7FF), (0x1F000, 0x1FAFF)]


def suspicious() -> str:
    """A native pattern for texts with at least one character that a wrong decoding can leave."""
    left = {ord(c) for w in WRONG for c in _byte_chars(w)[0x80:]} | {0xFFFD}
    ranges = [(a, b) for a, b in UNTOUCHED if not any(a <= c <= b for c in left)]
    return r"[^\x00-\x7f" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def candidates(text: str) -> list[tuple[str, float, str]]:
    """(chain, cost, text with it undone) for each chain that changes ``text``; each different text once, cheapest first."""
    out: list[tuple[str, float, str]] = []
    seen = {text}

    def add(chain: str, cost: float, to: str) -> bool:
        if to in seen:
            return False
        seen.add(to)
        out.append((chain, cost, to))
        return True

    for w in WRONG:
        once = _from_utf8(text, w)
        if add(f"utf8<{w}", COST["utf8"], once):
            for v in WRONG[:3]:
                add(f"utf8<{v}<utf8<{w}", COST["utf8 twice"], _from_utf8(once, v))
    for w, meant in SINGLE.items():
        for m in meant:
            add(f"{m}<{w}", COST["single"], text.translate(_swap(w, m)))
    return out


def language(text: Column) -> Column:
    """A rough language by script or frequent words, only to sort phrases into dictionaries."""
    # Most texts leave at the first test.
    out = F.when(~text.rlike("[À-ÿऀ-ॿЀ-ӿͰ-Ͽ]"), "en").when(text.rlike("[ऀ-ॿ]{2}"), "hi").when(text.rlike("[Ѐ-ӿ]{3}"), "ru").when(text.rlike("[Ͱ-Ͽ]{3}"), "el")
    for lang, words in STOPWORDS.items():
        out = out.when(F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?i)\b({words})\b"), F.lit(1)))) >= 2, lang)
    return out.otherwise("en")


def phrases(rows: DataFrame, text_col: str) -> tuple[list[tuple[str, str, int]], DataFrame]:
    """(language, phrase, count) of each language's most frequent words with non-ASCII characters and their neighbours, and
    ``(word, count)`` of all such words alone; both are counted over all rows; digits read 0.
    """
    text = F.col(text_col)
    # The language is found before the rows multiply, once for each text.
    found = rows.where(text.rlike(r"[^\x00-\x7f]")).select(language(text).alias("lang"), F.regexp_extract_all(F.regexp_replace(text, "[0-9]", "0"), F.lit(f"({_WORD})"), F.lit(1)).alias("phrases"))
    each = found.select("lang", F.explode_outer("phrases").alias("phrase"))
    each = each.where(~F.col("phrase").rlike("[\ufffd\u0080-\u009f]"))
    counted = written(each.groupBy("lang", "phrase").count(), "phrases")
    words = counted.select(F.explode_outer(F.split("phrase", " ")).alias("word"), "count").where(F.col("word").rlike(r"[^\x00-\x7f]")).groupBy("word").agg(F.sum("count").alias("count"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "phrase"))
    top = _frequent(counted).withColumn("rank", rank).where(F.col("rank") <= PHRASES).select("lang", "phrase", "count")
    return sorted((tuple(r) for r in top.collect()), key=lambda r: (-r[2], r[0], r[1])), written(words, "words")


def _frequent(counted: DataFrame) -> DataFrame:
    """The phrases as frequent as the ``PHRASES``-th of their language, of equally frequent ones about twice as many as fit.

    How many phrases are how frequent is a small table, so few rows move to be ranked however many partitions there are.
    """
    by = Window.partitionBy("lang").orderBy(F.desc("count"))
    often = counted.groupBy("lang", "count").agg(F.count("*").alias("n")).withColumn("above", F.sum("n").over(by) - F.col("n")).where(F.col("above") < PHRASES)
    part = often.select("lang", "count", F.least(F.lit(1.0), 2 * (PHRASES - F.col("above")) / F.col("n")).alias("part"))
    return counted.join(bounded_broadcast(written(part, "phrase-counts")), ["lang", "count"]).where(F.pmod(F.xxhash64("phrase"), F.lit(1_000_000)) < F.col("part") * 1_000_000).drop("part")


def _non_ascii(counted: list[tuple[str, str, int]]) -> set[str]:
    return {w for _, p, _ in counted for w in p.split(" ") if not w.isascii()}


def counts_for(counted: list[tuple[str, str, int]], words: DataFrame) -> dict[str, int]:
    """The counts of the phrases' words and of what chains make of them; the phrases bound their number."""
    seen = _non_ascii(counted)
    asked = sorted(seen | {to for w in seen for _, _, to in candidates(w)})
    if not asked:
        return {}
    asked = words.sparkSession.createDataFrame(pd.DataFrame({"word": asked}), "word string")
    return {r["word"]: r["count"] for r in words.join(F.broadcast(asked), "word", "left_semi").collect()}


def dictionaries(counted: list[tuple[str, str, int]], total: dict[str, int]) -> dict[str, bytes]:
    """Dictionary content for each language out of (language, phrase, count), the most frequent last as zstandard likes it.

    Phrases with a word that a chain turns into one more frequent, or into known characters as UTF-8, are left out: they are what is looked for.
    """
    seen = _non_ascii(counted)
    undone = {w: [(c, to) for c, _, to in candidates(w)] for w in seen}
    # Characters of words that are no UTF-8 read wrongly; what only they spell was meant.
    plain = {ch for w, to in undone.items() if not any(c.startswith("utf8") for c, _ in to) for ch in w} | set(map(chr, range(128)))
    by: dict[str, list[str]] = defaultdict(list)
    for lang, p, n in counted:
        words = [w for w in p.split(" ") if not w.isascii()]
        if any(total.get(to, 0) >= NOISE * total.get(w, 1) or c.startswith("utf8") and (total.get(to, 0) >= total.get(w, 1) or {ch for ch in to if not ch.isspace()} <= plain) for w in words for c, to in undone[w]):
            continue
        by[lang].append(p)
    out = {}
    for lang, ps in by.items():
        size, kept = 0, []
        for p in ps:
            if (size := size + 2 * len(p) + 2) > DICTIONARY_BYTES:
                break
            kept.append(p)
        out[lang] = "\n".join(reversed(kept)).encode("utf-16-le")
    return out


class Describer:
    """Description lengths in bytes under the best dictionary."""

    def __init__(self, content: dict[str, bytes], known: dict[str, int] | None = None, level: int = LEVEL):
        # Counts may be added: those that a text needs have to be there before it is looked at.
        self.by, self.known = [], known or {}
        self.alphabet = {ch for c in content.values() for ch in c.decode("utf-16-le")} | set(map(chr, range(128)))
        for _, c in sorted(content.items()):
            d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.by = self.by or [zstandard.ZstdCompressor(level=level, write_content_size=False)]

    def length(self, text: str) -> int:
        raw = text.encode("utf-16-le", "surrogatepass")
        return min(len(c.compress(raw)) for c in self.by) + ESCAPE * len(set(text) - self.alphabet)

    @lru_cache(200_000)
    def settled(self, word: str) -> bool:
        """Whether no chain can be chosen for a word: none reads it as UTF-8, and every swap is vetoed by its frequency."""
        return all(not c.startswith("utf8") and self.known.get(word, 0) > self.known.get(to, 0) for c, _, to in candidates(word))

    @lru_cache(200_000)
    def choose(self, segment: str) -> str | None:
        """The chain with the least description, None if that is no chain."""
        tried = [c for c in candidates(segment) if not self.vetoed(segment, c[0], c[2])]
        if not tried:
            return None
        best, chain = self.length(segment), None
        for name, cost, to in tried:
            if (now := self.length(to) + cost) < best:
                best, chain = now, name
        return chain

    def vetoed(self, segment: str, chain: str, to: str) -> bool:
        """Whether a chain can't be the answer whatever its length: see the rules of swaps and of look-alike words."""
        utf8 = chain.startswith("utf8")
        if utf8 and not chain.endswith(CYRILLIC):
            return False
        changed = [(a, b) for a, b in zip(segment.split(), to.split()) if a != b]
        # A word of two scripts is a look-alike, unless it is a known word in UTF-8.
        if chain.endswith(CYRILLIC) and any(re.search("[A-Za-z]", a) and (not utf8 or MARK.search(b) or b not in self.known) for a, b in changed):
            return True
        # A swap of single-byte sets reads any accented word as another; it has to lead to a known word, and may not trade
        # a known word for a rarer one.
        return not utf8 and (not any(b in self.known for _, b in changed) or any(self.known.get(a, 0) > self.known.get(b, 0) for a, b in changed))


def undo(text: str, chain: str) -> str:
    """``text`` with ``chain`` undone wherever it applies."""
    steps = chain.split("<")
    for meant, wrong in zip(steps[-2::-2], steps[::-2]):
        text = _from_utf8(text, wrong) if meant == "utf8" else text.translate(_swap(wrong, meant))
    return text


def _pieces(text: str) -> list[tuple[int, int, str]]:
    """``(begin, end, what is described of it)`` of each part of a text whose digits read 0.

    Parts are made of whole segments. A text has one unless its segments have more than ``PART`` characters; then each
    part is decided by itself.
    """
    out: list[list] = [[0, len(text), []]]
    size = 0
    for m in SEGMENT.finditer(text):
        if size and size + len(m[0]) > PART:
            out[-1][1] = m.start()
            out.append([m.start(), len(text), []])
            size = 0
        out[-1][2].append(m[0])
        size += len(m[0])
    return [(begin, end, "\n".join(segments)) for begin, end, segments in out]


def asked_of(text: str) -> set[str]:
    """The words whose counts, with those of what chains make of them, decide about a text."""
    return set(NON_ASCII_WORD.findall(text.translate(ZEROS)))


def mended(d: Describer, text: str) -> tuple[list[str], str]:
    """The chains of ``text``, most often one or none, and the text with each undone in its part."""
    read = text.translate(ZEROS)
    if all(map(d.settled, NON_ASCII_WORD.findall(read))):
        return [], text
    chains, parts = [], []
    for begin, end, piece in _pieces(read):
        # Long parts are not worth remembering.
        chain = d.choose(piece) if len(piece) <= PART else d.choose.__wrapped__(d, piece)
        parts.append(undo(text[begin:end], chain) if chain else text[begin:end])
        if chain:
            chains.append(chain)
    return chains, "".join(parts)


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"text": b["text"], "words": [sorted(asked_of(t)) for t in b["text"]]}, dtype=object)


def _read_as(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each word with itself and what chains make of it, and whether one reads it as UTF-8."""
    for b in batches:
        out = []
        for w in b["word"]:
            tried = candidates(w)
            utf8 = any(c.startswith("utf8") for c, _, _ in tried)
            out += [(w, to, utf8) for to in (w, *(to for _, _, to in tried))]
        yield pd.DataFrame(out, columns=["word", "to", "utf8"], dtype=object)


def _mended(content: dict[str, bytes]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Describer(content)
        for b in batches:
            out = []
            for t, facts in zip(b["text"], b["facts"]):
                if len(d.known) > KEPT:
                    d.known.clear()
                d.known.update((f["to"], f["count"]) for f in (() if facts is None else facts))
                found, to = mended(d, t)
                if not found and not DAMAGE.search(t):
                    continue
                out.append((t, found[0] if found else "none", to, bool(DAMAGE.search(to))))
            yield pd.DataFrame(out, columns=["text", "chain", "restored", "lossy"], dtype=object)

    return run


def garbled_texts(rows: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """``(text, chain, restored, lossy)`` of each different garbled ``text`` of ``among``, by the counts of all ``rows``.

    Only texts with a word that a chain could be chosen for are described, each with the exact counts that it needs.
    """
    counted, words = phrases(rows, "text")
    content = dictionaries(counted, counts_for(counted, words))
    texts = (rows if among is None else among).select("text").where(F.col("text").rlike(suspicious())).distinct()
    texts = written(texts.mapInPandas(_asked, "text string, words array<string>"), "asked")
    each = texts.select("text", F.explode("words").alias("word"))
    tried = each.select("word").distinct().mapInPandas(_read_as, "word string, to string, utf8 boolean")
    tried = tried.join(words.withColumnRenamed("word", "to"), "to", "left")
    own = F.max(F.when(F.col("to") == F.col("word"), F.coalesce("count", F.lit(0))))
    best = F.max(F.when(F.col("to") != F.col("word"), F.coalesce("count", F.lit(0))))
    fact = F.when(F.col("count").isNotNull(), F.struct("to", "count"))
    # Open: not settled, see Describer.
    facts = written(tried.groupBy("word").agg(F.collect_set(fact).alias("facts"), (F.bool_or("utf8") | F.coalesce(own <= best, F.lit(False))).alias("open")), "word-facts")
    near = written(each.join(bounded_broadcast(facts.where("open").select("word")), "word", "left_semi").select("text").distinct(), "open-texts")
    told = each.join(near, "text", "left_semi").join(facts.where(F.size("facts") > 0).select("word", "facts"), "word", "left")
    told = told.groupBy("text").agg(F.flatten(F.collect_list("facts")).alias("facts"))
    damaged = texts.where(F.col("text").rlike("[\ufffd\u0080-\u009f]")).select("text").join(near, "text", "left_anti")
    judged = told.unionByName(damaged, allowMissingColumns=True)
    return written(judged.mapInPandas(_mended(content), "text string, chain string, restored string, lossy boolean"), "garbled")


def garbled(messages: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, chain, restored, lossy)`` of each garbled row: what was undone, the text after it, whether a part is lost.

    Rows with only replacement or control characters left have chain ``none``. Null, empty and plain ASCII texts are
    never garbled; repeated rows give repeated results; a tie leaves the text unchanged; other columns are ignored.
    """
    rows = require(messages, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(garbled_texts(rows), "text").select("id", "chain", "restored", "lossy")
