"""Visually identical text with different characters, brought to one form.

Look-alike pairs (single code points and short strings) are joined to transitive classes by union-find; the member most
frequent in the corpus represents its class; texts are rewritten greedily, the longest member first, with one automaton.
Members of another script replace each other only inside words that mix scripts, or in words that have no letter of
their own in a text without any other word of that script: real foreign-language text stays as it is. Which script a
word gets depends on its look alone and on letters that only one script has, not on how many letters come from where.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.textfold import INVISIBLE, LOOKALIKES, SPACES
from marlstone.llm.encoding import garbled_texts
from marlstone.session import require

#: Compatibility forms that are only another style of the same letter; superscripts, fractions and the like are not.
STYLES = ("<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<compat>")
#: Invisible characters that may build an emoji.
JOINER = "‍"
_MARKS = "̀-ͯ"
_EMOJI = r"\x{1F000}-\x{1FAFF}\x{2190}-\x{2BFF}\x{FE0F}"
#: Ranges that hold nothing to change (checked below); few of them, as each costs time at every character.
PLAIN = [(0x00, 0x7F), (0xA1, 0xAC), (0xAE, 0x130), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E), (0x900, 0xDFF), (0x2010, 0x2027), (0x20A0, 0x20CF), (0x2190, 0x245F), (0x2500, 0x2BFF), (0xFE0F, 0xFE0F), (0x1F000, 0x1F10F), (0x1F260, 0x1FAFF)]
NOT_PLAIN = "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in PLAIN) + r"\x{200d}]"
LONE_JOINER = rf"(?<![{_EMOJI}])\x{{200D}}|\x{{200D}}(?![{_EMOJI}])"


def gate(text: Column) -> Column:
    """Whether ``text`` needs a look at all."""
    return text.rlike(NOT_PLAIN) | (text.contains(JOINER) & text.rlike(LONE_JOINER))


#: Scripts with letters drawn like those of another.
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "cherokee", "lisu")


class UnionFind:
    """Classes of strings under the pairs joined so far."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (p := self.parent.setdefault(root, root)) != root:
            root = p
        while (p := self.parent[x]) != root:
            self.parent[x], x = root, p
        return root

    def join(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        by: dict[str, list[str]] = defaultdict(list)
        for x in self.parent:
            by[self.find(x)].append(x)
        return list(by.values())


def script(ch: str) -> str:
    """A letter's script; empty for everything else."""
    cp = ord(ch)
    if ch.isascii():
        return "latin" if ch.isalpha() else ""
    if 0xC0 <= cp <= 0x24F or 0x1E00 <= cp <= 0x1EFF or cp in (0x251, 0x261):
        return "latin" if ch.isalpha() else ""
    if 0x370 <= cp <= 0x3FF or 0x1F00 <= cp <= 0x1FFF:
        return "greek" if ch.isalpha() else ""
    if 0x400 <= cp <= 0x52F:
        return "cyrillic"
    if 0x530 <= cp <= 0x58F:
        return "armenian"
    if 0x13A0 <= cp <= 0x13FF:
        return "cherokee"
    if 0xA4D0 <= cp <= 0xA4FF:
        return "lisu"
    return "other" if ch.isalpha() else ""


def pairs(unit: str) -> list[str]:
    """What ``unit``, a code point or a letter with marks, looks like."""
    if len(unit) > 1:
        composed = unicodedata.normalize("NFC", unit)
        return [composed] if len(composed) < len(unit) else []
    if unit in INVISIBLE:
        return [""]
    if unit in SPACES:
        return [" "]
    out = [LOOKALIKES[unit]] if unit in LOOKALIKES else []
    form = unicodedata.decomposition(unit)
    if form.startswith(STYLES) and ord(unit) > 0xFF:
        to = unicodedata.normalize("NFKC", unit)
        if form.startswith(("<wide>", "<narrow>")) or unicodedata.category(unit)[0] in "LN" and to.isalnum() or unicodedata.category(unit) == "So" and to.isalnum() and len(to) == 1:
            out.append(to)
    return out


assert not any(pairs(chr(c)) for a, b in PLAIN for c in range(a, b + 1))


class Forms:
    """The classes, their representatives and the automata that rewrite with them."""

    def __init__(self, counts: dict[str, int]):
        joined = UnionFind()
        for unit in counts:
            for to in pairs(unit):
                joined.join(unit, to)
        for a, b in LOOKALIKES.items():
            joined.join(a, b)
        self.fixed: dict[str, str] = {}
        self.by_script: dict[str, dict[str, str]] = defaultdict(dict)
        for members in joined.classes():
            # The most frequent member stands for the class; ties go to the shorter, then the lower code point.
            # A letter with its marks apart never does.
            order = sorted(members, key=lambda m: (len(m) > 1 and "̀" <= m[-1] <= "ͯ", -counts.get(m, 0), len(m), m))
            best = "" if "" in members else " " if " " in members else order[0]
            plain = {}
            for m in order:
                if len(m) == 1 and (s := script(m)) in SCRIPTS:
                    plain.setdefault(s, m)
            for m in members:
                own = script(m) if len(m) == 1 else ""
                if own in plain:  # a letter of a script: it may only change with the script of its word
                    if m != plain[own] and unicodedata.decomposition(m).startswith("<"):
                        self.fixed[m] = plain[own]
                    for s, to in plain.items():
                        if s != own:
                            self.by_script[s][m] = to
                elif m:
                    # Styled letters go to the plain letter, however frequent the style is.
                    to = best if best in ("", " ") else plain.get("latin", next(iter(plain.values()), best))
                    if m != to:
                        self.fixed[m] = to
        self.automaton = ahocorasick.Automaton()
        for m, to in self.fixed.items():
            self.automaton.add_word(m, (len(m), to))
        if self.fixed:
            self.automaton.make_automaton()

    def _emoji(self, ch: str) -> bool:
        return ord(ch) >= 0x1F000 or 0x2190 <= ord(ch) <= 0x2BFF or ch == "️"

    def rewrite(self, text: str) -> str:
        """``text`` with every member replaced, leftmost and longest first, then words of mixed scripts made one."""
        if self.fixed:
            parts, at = [], 0
            for end, (n, to) in self.automaton.iter_long(text):
                start = end - n + 1
                if text[start : end + 1] == JOINER and 0 < start and end + 1 < len(text) and self._emoji(text[start - 1]) and self._emoji(text[end + 1]):
                    continue
                parts += [text[at:start], to]
                at = end + 1
            if parts:
                text = "".join(parts) + text[at:]
        return self._words(text) if FOREIGN.search(text) else text

    def _words(self, text: str) -> str:
        own = Counter(s for ch in text if (s := script(ch)) and not any(ch in t for t in self.by_script.values()))

        def word(m: re.Match) -> str:
            w = m[0]
            scripts = Counter(filter(None, map(script, w)))
            if set(scripts) <= {"latin"} or "other" in scripts:
                return w
            if len(scripts) == 1:
                s = next(iter(scripts))
                if own[s] or not all(ch in self.by_script["latin"] or not script(ch) for ch in w):
                    return w  # a real word of its script
                to = "latin"
            else:
                # Letters that nothing of another script looks like decide, first the word's, then the text's. A word that
                # could be of any script is Latin, however many of its letters are: all its mixtures come out equal.
                sure = Counter(script(ch) for ch in w if script(ch) and not any(ch in t for t in self.by_script.values()))
                foreign = {s for s in own if s != "latin" and own[s]}
                to = max(sorted({*scripts, "latin"} if not sure else scripts), key=lambda s: (sure[s], s in foreign and "latin" not in own, s == "latin", scripts[s]))
            return "".join(self.by_script[to].get(ch, ch) if script(ch) not in ("", to) else ch for ch in w)

        return WORD.sub(word, text)


FOREIGN = re.compile("[Ͱ-֏ἀ-῿Ꭰ-\u13ffꓐ-\ua4ffɑɡı]")
WORD = re.compile(r"[^\W_]+")
_MARKED = re.compile(f"[^\\W\\d_][{_MARKS}]{{1,2}}")


#: The strings that joined letters stand for.
STRINGS = sorted({unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xFB00, 0xFB07), 0x132, 0x133, *range(0x1C4, 0x1CD))})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()
    for b in batches:
        s = "".join(b.column(0).to_pylist())
        total.update(s)
        total.update(_MARKED.findall(s))
        for lig in STRINGS:
            total[lig] += s.count(lig)
    yield pa.RecordBatch.from_pydict({"unit": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})


def unit_counts(rows: DataFrame) -> dict[str, int]:
    """How often each code point, and each letter with marks apart, occurs over all rows.

    The result is bounded by the size of Unicode, not by the data.
    """
    counted = rows.select("text").mapInArrow(_counted, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))
    return {r["unit"]: r["n"] for r in counted.collect()}


def unified(messages: DataFrame, id_col: str = "id", text_col: str = "text", garbled: bool = False) -> DataFrame:
    """``(id, text)`` of each row whose text changes, in its one consistent form.

    Rows that a wrong decoding garbled are left to that operator unless ``garbled``. Null and empty texts never change;
    repeated rows give repeated results; ties between representatives go to the lower code point; other columns are
    ignored.
    """
    rows = require(messages, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    forms = Forms(unit_counts(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["text"]):
                to = forms.rewrite(t)
                if to != t:
                    to = forms.rewrite(to)  # what an invisible character kept apart
                if to != t:
                    out.append((i, to))
            yield pd.DataFrame(out, columns=["id", "text"], dtype=object)

    gated = rows.where(gate(F.col("text")))
    own = gated if garbled else gated.join(garbled_texts(rows, gated).select("text"), "text", "left_anti").select("id", "text")
    return own.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, text string")
