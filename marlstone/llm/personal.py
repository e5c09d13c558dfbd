"""Personal information in free text: found behind its disguises and replaced by typed placeholders.

Transducers rewrite a text step by step (styled and look-alike characters, invisible characters, spelled digits, at/dot
disguises) and carry along where each character came from. Identifiers are detected in the rewritten text; their spans
are mapped back to source characters, so everything else in the text stays untouched. Names are found by what announces
them and by the corpus: words that make up names, of senders or announced ones, are counted over all rows, and two such
words beside each other are a name wherever they stand.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.textfold import INVISIBLE, LOOKALIKES, SPACES, compat_ascii
from marlstone.session import bounded_broadcast, require, written

TYPES = ["email", "phone", "identity_number", "street_address", "name"]

# ---- transducers: (text, origins) -> (text, origins); origins is None while every character is its own origin -------


@cache
def _one_to_one() -> dict[int, str]:
    return {ord(a): b for a, b in {**compat_ascii(), **dict.fromkeys(SPACES, " "), **LOOKALIKES}.items()}


_UNEVEN = re.compile(f"[{INVISIBLE}̀-ͯﬀ-ﬆ]")
# Spoken digits and repeaters.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
REPEATS = {"double": 2, "triple": 3}
_SPOKEN = re.compile(
    rf"(?i)\b(?:(?:{'|'.join(REPEATS)})[\s-]+)?(?:{'|'.join(DIGIT_WORDS)})(?:[\s,.-]+(?:(?:{'|'.join(REPEATS)})[\s-]+)?(?:{'|'.join(DIGIT_WORDS)})){{5,}}\b"
)
_AT = re.compile(r"(?i)\s*[\[({<]\s*at\s*[\])}>]\s*|\s+@\s+|\s+@|@\s+(?=[\w-]+\s*[.\[(])")
_DOT = re.compile(r"(?i)\s*[\[({<]\s*(?:dot|punkt|punto|point)\s*[\])}>]\s*")
_SPOKEN_MAIL = re.compile(r"(?i)\b[\w.+-]+ at (?:[\w-]+ dot )+[a-z]{2,}\b")


class Traced:
    """A text with the source span of each of its characters: where it begins (``origin``) and ends (``ends``)."""

    __slots__ = ("text", "origin", "ends")

    def __init__(self, text: str, origin: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.origin, self.ends = text, origin, ends

    def rewrite(self, pattern: re.Pattern, to) -> "Traced":
        """Every match replaced; the characters put in share the source of the match, spread over it, the last up to its end."""
        parts, begins, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = to(m) if callable(to) else to
            parts += [self.text[at : m.start()], new]
            begins += range(at, m.start())
            ends += range(at + 1, m.start() + 1)
            n, size = m.end() - m.start(), len(new)
            begins += [m.start() + min(k * n // size, n - 1) for k in range(size)]
            ends += [m.end() if k == size - 1 else m.start() + max(1, (k + 1) * n // size) for k in range(size)]
            at = m.end()
        if not parts:
            return self
        parts.append(self.text[at:])
        begins += range(at, len(self.text))
        ends += range(at + 1, len(self.text) + 1)
        if self.origin is not None:
            begins, ends = [self.origin[k] for k in begins], [self.ends[k - 1] for k in ends]
        return Traced("".join(parts), begins, ends)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.origin is None else (self.origin[start], self.ends[end - 1])


def _spoken(m: re.Match) -> str:
    out, times = "", 1
    for w in re.findall("[a-z]+", m[0].lower()):
        if w in REPEATS:
            times = REPEATS[w]
        else:
            out, times = out + DIGIT_WORDS[w] * times, 1
    return out


def normalised(text: str) -> tuple[Traced, set[str]]:
    """``text`` without disguises, traced to its source, and which patterns its words call for."""
    t = Traced(text)
    if not text.isascii():
        if not _one_to_one().keys().isdisjoint(map(ord, text)):
            t.text = text.translate(_one_to_one())  # one to one: the origins stay
        if _UNEVEN.search(t.text):
            t = t.rewrite(re.compile(f"[{INVISIBLE}]+"), "")
            t = t.rewrite(re.compile("[ﬀ-ﬆ]"), lambda m: unicodedata.normalize("NFKC", m[0]))
            t = t.rewrite(re.compile("[^\\W\\d_][̀-ͯ]+"), lambda m: unicodedata.normalize("NFC", m[0]))
    hints = hinted(t.text)
    if "disguise" in hints:
        t = t.rewrite(_AT, "@").rewrite(_DOT, ".")
        t = t.rewrite(_SPOKEN_MAIL, lambda m: re.sub("(?i) dot ", ".", re.sub("(?i) at ", "@", m[0], count=1)))
    if "spoken" in hints:
        t = t.rewrite(_SPOKEN, _spoken)
    return t, hints


@cache
def _hints() -> ahocorasick.Automaton:
    """One automaton for all the words without which a pattern cannot match; it says which patterns to try."""
    words = {
        "disguise": ["@", "[", "(", "{", "<", " dot "],
        "name": ["ansprech", "nominee", "ask", "ship", "accepted", "holder", "contacto", "attn", "benefic", "rider", "contact", "reach", "deposited"],
        "announced": ["pan", "passport", "ssn", "tax", "proof", "with", "national", "aadhaar", "nino", "dni", "ausweis"],
        "address": ["cross", "main", "c/", "calle", "avda", "plaza"]
        + ["rue", "avenue", "boulevard", "place", "chemin", "allée", "impasse", "quai", "route"]
        + ["weg", "straße", "strasse", "allee", "platz", "gasse", "ufer", "str."],
    }
    # Words with what has to stand before and after them.
    words["general"] = GENERAL
    between = [
        ("spoken", DIGIT_WORDS, _edge, lambda c: c in ",.-" or c.isspace()), ("honoured", ["mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau"], _edge, lambda c: c == "." or c.isspace()),
        ("address", STREETS.split("|"), str.isspace, _edge), ("address", ["am", "an", "auf", "im", "zum", "zur"], _edge, str.isspace), ("address", ["str"], str.isalpha, str.isspace),
        ("name", ["hi"], _edge, _separates), ("name", ["to"], str.isspace, _separates),
    ]
    by: dict[str, tuple[set[str], list]] = {}
    for kind, ws in words.items():
        for w in ws:
            by.setdefault(w, (set(), []))[0].add(kind)
    for kind, ws, before, after in between:
        for w in ws:
            by.setdefault(w, (set(), []))[1].append((kind, before, after))
    out = ahocorasick.Automaton()
    for w, (kinds, edged) in by.items():
        out.add_word(w, (kinds, len(w), edged))
    out.make_automaton()
    return out


def _edge(c: str) -> bool:
    """Whether a word can end or begin beside ``c``."""
    return not c.isalnum() and c != "_"


def _separates(c: str) -> bool:
    return c in ":–-" or c.isspace()


def hinted(text: str) -> set[str]:
    s, out = f" {text.lower()} ", set()
    for end, (kinds, n, edged) in _hints().iter(s):
        out |= kinds
        for kind, before, after in edged:
            if kind not in out and end + 1 < len(s) and after(s[end + 1]) and before(s[end - n]):
                out.add(kind)
    return out


# ---- identifiers ----------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"(?i)[\w.+%'-]*[\w+%-]@(?:[\w-]+\.)+[a-z]{2,}\b")
PHONE = re.compile(
    r"(?<![\w+.,/-])(?:\+\d(?:[\s().-]{0,2}\d){7,14}|00[1-9]\d(?:[\s().-]?\d){7,12}|0[1-9]\d{9}|0[\s-]?\d{5}[\s-]\d{5}|0\d{4}[\s-]\d{6}"
    r"|0\d{2}[\s-]\d{4}[\s-]\d{4}|0\d{3}[\s-]\d{3}[\s-]\d{4}|0\d{4}[\s-]\d{5}"
    r"|\(\d{3}\)[\s.-]?\d{3}[\s.-]?\d{4}|\d{3}([.\s-])\d{3}\1\d{4}|\d{3}\s\d{3}[-.]\d{4})(?![\w-]|[.,]\d)"
)
#: Card and account numbers count if their check digits are right; a shape of an identity number within one is a part of it.
NUMBERS = re.compile(
    r"(?i)(?<![\w.,/+*-])(?:(?P<card>\d{4}([\s-]?)\d{4}\2\d{4}\2\d{4}(?:\2\d{1,3})?|\d{4}([\s-])\d{6}\3\d{5}|\d{13,19})|(?P<account>[a-z]{2}\d{2}(?:\s?[a-z0-9]{4}){2,7}(?:\s?[a-z0-9]{1,3})?)"
    r"|(?P<shape>\d{4}([\s-])\d{4}\6\d{4}|\d{3}([\s-])\d{2}\7\d{4}|[a-z]{5}\d{4}[a-z]|[a-z]{2}\s\d{2}\s\d{2}\s\d{2}\s[a-z]))(?![\w-]|[.,]\d)"
)
#: After words that announce an identity document, compact forms count too.
ID_ANNOUNCED = re.compile(
    r"(?i)\b(?:pan|passport|passport\s+no|ssn(?:\s+on\s+record)?|tax\s+id|id\s+proof|(?:kyc\s+done\s+)?with\s+id|national\s+id|aadhaar|nino|dni|ausweis(?:nummer)?)[\s.:#–-]{1,4}"
    r"((?=[a-z\s-]*\d)(?:[a-z]{0,5}[\s-]?\d{2,12}(?:[\s-]?\d{2,4}){0,3}[\s-]?[a-z]?))(?![\w])"
)
# Words for streets and shops, and words that never are part of a street's name.
STREETS = "street|st|road|rd|lane|ln|avenue|ave|drive|close|way|court|place|square|boulevard|blvd|terrace|crescent|layout|marg"
SHOPS = "books|cafe|electronics|footwear|fuels|grocers|mart|pharmacy|sports|travels"
NOT_STREET = "to|at|for|on|by|from|in|of|and|is|was|spent|paid|towards|as|the|your|with|inr|rs|off|up|via|order|til|till|ref|bal|amt|bank|card|a|gb|min|days|hours"
_WORDS = rf"(?:(?!(?:{NOT_STREET})\b)[^\W\d_][\w'’-]*\.?\s+){{1,3}}"
ADDRESS = re.compile(
    rf"(?i)(?:(?<![\w.,₹*/:-])(?:(?:flat|apt|unit|no)\.?\s*\d+[a-z]?,?\s+)?\d{{1,4}}(?:/\d{{1,3}}|[a-z])?,?\s+{_WORDS}(?:{STREETS})\b(?!\s+(?:{SHOPS})\b)(?:,?\s+(?:apt|flat|unit)\.?\s*\d+)?"
    r"|\bno\.?\s*\d+,?\s+\d+(?:st|nd|rd|th)\s+(?:cross|main)\b(?:,?\s+(?:[^\W\d_][\w'’-]*\s+){1,3}layout\b)?"
    r"|(?<!\w)(?:c/|calle|avda\.?|plaza)\s*(?:[^\W\d_][\w'’-]*\s+){1,4}\d{1,4}\b(?:,?\s+\d{1,2}\s?[ºo°]\s?[a-z]\b)?"
    r"|(?<![\w.,])\d{1,4}(?:\s?bis)?,?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route)\s+(?:[^\W\d_][\w'’-]*\s*){1,5}"
    r"|\b(?:[^\W\d_]+(?:weg|straße|strasse|allee|platz|gasse|ufer|str\.?)|(?:am|an|auf|im|zum|zur)\s+(?:[^\W\d_]+\s+){1,2}[^\W\d_]+|(?:am|im|zum|zur)\s+[^\W\d_]+)\s+\d{1,4},?\s+\d{5}\b)"
    # the place that follows
    r"(?:(?:,|(?<=\d{5})|\n)\s*(?-i:[A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)?)(?:\s+\d{5,6}\b)?)?"
)

_HON = r"(?:mr|mrs|ms|miss|dr|prof|herr|frau|sr|sra|mme)\.?"
# Words after which a person's name stands, with what must follow it.
_STOP = r"(?!(?:a|an|the|us|our|your|you|my|me|it|them|payee|support|customer|team|bank|branch|help|desk)\b)"
_TOK = rf"{_STOP}[^\s\d,;:()<>|/@₹.]{{2,25}}"
NAME = rf"(?:{_HON}\s+{_TOK}|{_TOK},\s+{_TOK}|[^\W\d_]\.\s*{_TOK}|{_TOK}\s+(?:[^\W\d_]\.?\s+)?{_TOK})"
_SEP = r"[\s:–-]+"
NAME_AFTER = re.compile(
    rf"(?i)\b(?:(?:ansprechpartner(?:in)?|nominee\s+is|ask\s+for|ship\s+to|accepted\s+for|holder|contacto\s+es|attn|beneficiary){_SEP}(?P<a>{NAME})"
    rf"|rider{_SEP}(?P<b>{NAME})(?=\s*\(|\s+\+?\d|\s+is\b)|hi{_SEP}(?P<c>{NAME})(?=\s+here\b)|contact{_SEP}(?P<d>{NAME})(?=\s+on\b)|reach{_SEP}(?P<h>{NAME})"
    rf"|a/?c\s+\S+\s+to{_SEP}(?P<e>{NAME})(?=\s+on\b)|from{_SEP}(?P<f>{NAME})(?=\s+deposited\b))"
    rf"|(?:^|(?<=[\s\"“.]))(?P<g>{NAME})(?=\s+asked\s+for\s+you\b)"
)
# Words after which anybody's name stands, and words that never are part of a person's name.
GENERAL = ["my name is", "dear", "regards", "sincerely", "spoke with", "spoke to", "speaking to", "talked to", "signed by", "sehr geehrte", "grüßen", "cordialement", "atentamente", "estimado", "estimada", "mein name ist", "je m'appelle", "me llamo"]
NO_NAME = f"{SHOPS}|{STREETS}|bank|card|credit|savings|trust|union|team|desk|support|customers?|clients?|service|branch|insurance|sir|madam|all|friends?|kunden?|cliente|account|user|member|valued|brightwell|bay|hub"
_CAP = r"[A-ZÀ-ÖØ-ÞĀ-ŽА-Я][\w'’-]*\w"
NAMED = re.compile(
    rf"(?i:\b(?:{'|'.join(GENERAL)})(?:r|n|s)?\b[,:.]?\s+)(?:{_HON}\s+)?(?P<n>(?!(?i:{NO_NAME})\b){_CAP}(?:(?:\s[A-Z]\.)?[ ](?!(?i:{NO_NAME})\b){_CAP}){{1,2}})(?!\w|\s+(?i:{NO_NAME})\b)".replace(_HON, f"(?i:{_HON})", 1)
)
HONOURED = re.compile(rf"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau)\.?\s+[^\W\d_a-z][^\W\d_]+(?:[-'’][^\W\d_]+)?")
SENDER_NAME = re.compile(rf"(?i)\s*(?:{_HON}\s+[^\W\d_][\w'’-]+|[^\W\d_][\w'’-]+,\s+[^\W\d_][\w'’-]+|[^\W\d_]\.\s*[^\W\d_][\w'’-]+|[^\W\d_][\w'’-]+\s+(?:[^\W\d_]\.?\s+)?[^\W\d_][\w'’-]+)\s*")
#: Brand codes: two letters, a separator, then capitals or digits.
BRAND_CODE = re.compile(r"(?i)\s*[a-z]{2}\s*[-_ ]\s*[a-z0-9]{4,8}\s*")


def card_checks(digits: str) -> bool:
    """The check digit of card numbers: every second digit from the right doubled, its digits added, in all a multiple of ten."""
    turned = [int(c) for c in reversed(digits)]
    return (sum(turned[::2]) + sum(sum(divmod(2 * d, 10)) for d in turned[1::2])) % 10 == 0


def iban_checks(text: str) -> bool:
    """The check digits of account numbers: the number, its first four characters last, letters as 10 to 35, leaves 1 over 97."""
    whole = "".join(text.split()).upper()
    return 15 <= len(whole) <= 34 and int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4])) % 97 == 1


def _numbers(s: str) -> Iterator[tuple[int, int]]:
    """Identity numbers by shape; of cards and accounts the longest beginning that ends with a group and checks."""
    for m in NUMBERS.finditer(s):
        if m["shape"]:
            yield m.span()
        else:
            right = _card if m["card"] else iban_checks
            ends = [m.end(), *(m.start() + g.start() for g in reversed(list(re.finditer(r"\s", m[0]))))]
            if end := next((e for e in ends if right(s[m.start() : e])), None):
                yield m.start(), end


def _card(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return 13 <= len(digits) <= 19 and card_checks(digits)


def _named(s: str, pairs: set[tuple[str, str]]) -> Iterator[tuple[int, int]]:
    """Words of ``s`` of which each two neighbours are one of ``pairs``."""
    begin, last = None, None
    for m in re.finditer(r"[^\W\d_](?:[\w'’-]*\w)?", s):
        if last is not None and s[last.end() : m.start()] == " " and (last[0].upper(), m[0].upper()) in pairs:
            begin = last.start() if begin is None else begin
        elif begin is not None:
            yield begin, last.end()
            begin = None
        last = m
    if begin is not None:
        yield begin, last.end()


def identifiers(text: str, sender: bool = False, pairs: set[tuple[str, str]] = frozenset()) -> list[tuple[int, int, str]]:
    """Spans in ``text`` itself with their type, in order; what two hold goes to the earlier, then the longer.

    ``pairs``: neighbouring words, in capitals, that the corpus tells to be a name.
    """
    t, hints = normalised(text)
    s, found = t.text, []
    digits = any(c.isdigit() for c in s) if sender else True
    if "@" in s:
        found += [(m.start(), m.end(), "email") for m in EMAIL.finditer(s)]
    if digits:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(s)]
        if sender:
            if not found and re.fullmatch(r"\s*\+?\d(?:[\s().-]{0,2}\d){9,14}\s*", s):
                found.append((len(s) - len(s.lstrip()), len(s.rstrip()), "phone"))
        else:
            if t.origin is not None:  # digits that were spelled in words
                found += [(m.start(), m.end(), "phone") for m in re.finditer(r"(?<![\w+.,/-])\d{10,15}(?![\w-])", s) if any(c.isalpha() for c in text[slice(*t.span(m.start(), m.end()))])]
            found += [(*x, "identity_number") for x in _numbers(s)]
            if "announced" in hints:
                found += [(*m.span(1), "identity_number") for m in ID_ANNOUNCED.finditer(s)]
            if "address" in hints:
                found += [(m.start(), m.end(), "street_address") for m in ADDRESS.finditer(s)]
    if sender:
        if not found and not digits and not BRAND_CODE.fullmatch(s) and SENDER_NAME.fullmatch(s):
            found.append((len(s) - len(s.lstrip()), len(s.rstrip()), "name"))
    else:
        if "name" in hints:
            found += [(*m.span(m.lastgroup), "name") for m in NAME_AFTER.finditer(s)]
        if "general" in hints:
            found += [(*m.span("n"), "name") for m in NAMED.finditer(s)]
        if pairs:
            found += [(*x, "name") for x in _named(s, pairs)]
        if "honoured" in hints:
            found += [(m.start(), m.end(), "name") for m in HONOURED.finditer(s)]
    out: list[list] = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and a < out[-1][1] < b:  # nothing that either holds stays in clear
            if kind == out[-1][2]:
                out[-1][1] = b
            a = b - len(s[out[-1][1] : b].lstrip())
        if a < b and (not out or a >= out[-1][1]):
            out.append([a, b, kind])
    return [(*t.span(a, b), kind) for a, b, kind in out]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(parts) + text[at:]


def _words(text: str, spans: list[tuple[int, int, str]]) -> list[str]:
    """The neighbouring words of each name, in capitals, as ``A B``."""
    out = []
    for a, b, kind in spans:
        if kind == "name":
            words = [w.upper() for w in re.findall(r"[^\W\d_](?:[\w'’-]*\w)", text[a:b])]
            out += [" ".join(x) for x in zip(words, words[1:])]
    return out


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        told = b["pairs"] if "pairs" in b else [()] * len(b)
        for i, text, sender, pairs in zip(b["id"], b["text"], b["sender"], told):
            of_text = identifiers(text, pairs={tuple(p.split(" ")) for p in pairs}) if text else []
            of_sender = identifiers(sender, sender=True) if sender and sender != "me" else []
            if of_text or of_sender:
                out.append((i, redact(text, of_text) if of_text else text, redact(sender, of_sender) if of_sender else sender, sorted({k for *_, k in of_text}), sorted({k for *_, k in of_sender}), _words(text, of_text), _words(sender, of_sender)))
        yield pd.DataFrame(out, columns=["id", "text", "sender", "text_types", "sender_types", "text_names", "sender_names"], dtype=object)


#: Capitalised words beside each other, as Java reads them.
CAPITALISED = r"(?<![\p{L}\p{N}@./_-])\p{Lu}[\p{L}'’-]*\p{L}(?: \p{Lu}[\p{L}'’-]*\p{L})+(?![\p{L}\p{N}@_])"
#: Names in which a word must occur to count as one that makes up names, and the part of its capitalised pairs that must be names.
SUPPORT, NAME_SHARE = 3, 0.5


def corpus_names(rows: DataFrame, scanned: DataFrame) -> DataFrame:
    """``(id, pairs)``: neighbouring capitalised words of a text that were not found as a name but are one by the corpus.

    Both words must make up names, of senders or announced in texts, and the pairs that each stands in must mostly be
    names. All counts are over all rows, combined before they move.
    """
    runs = F.transform(F.regexp_extract_all("text", F.lit(f"({CAPITALISED})"), F.lit(1)), lambda r: F.split(F.upper(r), " "))
    pairs = F.flatten(F.transform(runs, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda k: F.concat_ws(" ", F.get(w, k), F.get(w, k + 1)))))
    each = written(rows.where(F.col("text").rlike(CAPITALISED)).select("id", F.explode(F.array_distinct(pairs)).alias("pair")), "capitalised")
    word = F.explode(F.split("pair", " ")).alias("word")
    named = scanned.select("id", F.explode("text_names").alias("pair"))
    in_text = named.groupBy("pair").count().select(word, "count").groupBy("word").agg(F.sum("count").alias("in_text"))
    of_sender = scanned.select(F.explode("sender_names").alias("pair")).groupBy("pair").count().select(word, "count").groupBy("word").agg(F.sum("count").alias("of_sender"))
    seen = written(each.groupBy("pair").count(), "pairs")
    total = seen.select(word, "count").groupBy("word").agg(F.sum("count").alias("total"))
    known = in_text.join(of_sender, "word", "full").na.fill(0).where(F.col("in_text") + F.col("of_sender") >= SUPPORT)
    known = known.join(total, "word").where((F.col("in_text") + F.col("of_sender")) >= NAME_SHARE * F.col("total")).select("word")
    known = bounded_broadcast(written(known, "name-words"))
    parts = F.split("pair", " ")
    both = seen.select("pair", parts.getItem(0).alias("a"), parts.getItem(1).alias("b")).join(known.withColumnRenamed("word", "a"), "a", "left_semi").join(known.withColumnRenamed("word", "b"), "b", "left_semi")
    fresh = each.join(bounded_broadcast(written(both.select("pair"), "name-pairs")), "pair", "left_semi").join(named, ["id", "pair"], "left_anti")
    return fresh.groupBy("id").agg(F.collect_set("pair").alias("pairs"))


def redacted(messages: DataFrame, id_col: str = "id", text_col: str = "text", sender_col: str = "sender") -> DataFrame:
    """``(id, text, sender, text_types, sender_types)`` of each row that holds personal data, placeholders put in.

    Nulls and empty strings hold nothing; repeated rows give repeated results; what overlapping finds share goes
    to the earlier, then the longer; other columns are ignored. All rows are read once in Python, without a shuffle; only rows with a name
    that the corpus alone tells are read again.
    """
    rows = require(messages, id_col, text_col, sender_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(sender_col).alias("sender"))
    kind = dict(rows.dtypes)["id"]
    found = f"id {kind}, text string, sender string, text_types array<string>, sender_types array<string>, text_names array<string>, sender_names array<string>"
    scanned = written(rows.mapInPandas(_searched, found), "personal")
    names = bounded_broadcast(written(corpus_names(rows, scanned), "corpus-names"))
    again = rows.join(names, "id").mapInPandas(_searched, found)
    return scanned.join(names.select("id"), "id", "left_anti").unionByName(again).select("id", "text", "sender", "text_types", "sender_types")


def personal_types(messages: DataFrame) -> DataFrame:
    """``(id, field, pii_type)``: one row for each type that a field of a row holds."""
    found = redacted(messages)
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_types").alias("types")) for f in ("text", "sender")))
    return found.select("id", F.explode(each).alias("x")).select("id", "x.field", F.explode("x.types").alias("pii_type"))
