"""Broken prompt and response pairs: noisy labelling functions, one label model per defect.

Each field of a sample (answer, filtered answer, stored target) is put before several labelling functions for each
defect, which vote yes, no or nothing. Vote patterns are counted over all rows; expectation-maximization fits, from the
counts alone, how far each function can be trusted and how frequent the defect is. A field has every defect whose
posterior exceeds its cutoff; cutoffs are validated on cases built from the whole evaluation set, whose defects are known
and whose words are not those that the functions look for. Languages are told apart by character trigrams, counted over all
documents that name their language. A function that sees nothing abstains; it votes no only on evidence of the contrary.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import parallelism, require, written

YES, NO, ABSTAIN = "y", "n", "-"
ROUNDS = 50
#: Odds (logarithm) beyond which posteriors are alike.
SURE = 4.0
#: Distinct words of a language that a task holds before it hands their trigrams on.
HELD = 200_000
#: Share of a language's trigrams that one it hasn't shown counts for, where half a trigram would be less.
RAREST = 1e-6
#: Pairs judged last that a task remembers, for a filtered answer or a target that repeats; none with longer texts.
LATELY, LATELY_LENGTH = 4096, 10_000
#: Letters that an answer must have for its trigrams to count, and how much likelier (in nats a trigram) a language must be.
LEAST_LETTERS, MARGIN = 8, 0.5
#: Below this likelihood a trigram (in nats) a text is no English, whatever other languages are known.
STRANGE = -9.6

# Keys of the answer format and of usual wrappers; words of refusals; function words of languages.
ENGLISH_KEYS = {"amount", "counterparty", "type", "account", "merchant", "date", "error", "text", "title", "message", "sms", "answer", "response", "result", "output", "name", "currency", "transaction", "reason", "status"}
ANSWER_KEYS = ("amount", "counterparty", "type", "account")
APOLOGY = re.compile(
    r"(?i)\b(?:sorry|apolog\w+|unfortunately|regret|i'm afraid|i am afraid|forgive me|tut mir leid|leider|bedaure|désolée?|regrette|lo siento|lamento|mi dispiace|desculpe|helaas|spijt me|maaf)\b|क्षमा|माफ़"
)
INABILITY = re.compile(
    r"(?i)\b(?:can(?:no|['’])t|cannot|can not|unable|not able|not possible|not comfortable|rather not|declin\w+|denied|won['’]t|will not|refus\w+|isn['’]t something|not something|against my|not allowed|not permitted|not authori[sz]ed"
    r"|not appropriate|(?:do not|don['’]t) have (?:\w+ )?(?:permission|access|authori[sz]ation)|prohibited|forbidden|kann ich (?:\w+ )?nicht|darf ich nicht|ich (?:kann|darf|werde) (?:\w+ )*nicht|ne (?:peux|puis|suis) pas|no (?:puedo|me es posible)"
    r"|non (?:posso|mi è possibile)|não (?:posso|consigo|me é possível)|(?:kan|mag) ik (?:\w+ )?niet|nahi kar sakta)\b|नहीं कर सकत"
)
POLICY = re.compile(
    r"(?i)\b(?:as an ai|ai (?:language )?model|ai assistant|language model|guidelines?|polic(?:y|ies)|private|privacy|personal financial|sensitive|confidential|permission|(?:safety|security|legal|ethical) (?:reasons|grounds|concerns)|account data"
    r"|consult a professional|your safety|ask your bank|help with that|else i can)\b"
)
#: The speaker of a refusal, or a request that it speaks of; a statement about the message has neither.
SPEAKER = re.compile(r"(?i)\b(?:i|i['’](?:m|d|ll|ve)|my|me|we|your request|this request|that request|request)\b")
FUNCTION_WORDS = {
    "en": "the of and to is are was in for with on this that it no not by at from be has have i you your an a",
    "de": "der die das ist ein eine einen von für und nicht um es sich wird wurde bei handelt keine kein den dem über",
    "fr": "le la les est une un des de pour et ne pas ce cette il du au aucune dans message n'est",
    "es": "el la los es una un de para y no se por esta este ninguna en del indica su",
    "pt": "o a os é uma um de para e não se por esta este nenhuma em do mostra isto",
    "it": "il lo la è una un di per e non si da questo questa nessuna alcun in presso messaggio risulta quindi segnala",
    "nl": "de het een is van voor en niet geen dit er naar bij bericht op aan toont",
    "hi": "yeh hai koi nahi mein ka ki ke se aur ko par ek is nahin len den hain rupaye",
}
_WORDS = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}
# Words that never end a sentence.
OPEN_WORDS = set("the of and to for with by a an from at in on as der die das und zu für mit von ein eine le la les de et pour avec un une el los y para con por del il di e per o da em het van en voor met ki ka ko ke se aur".split())
_THINK = re.compile(r"(?is)^\s*(?:<think>.*?</think>\s*)+")
_FENCE = re.compile(r"(?s)^```[\w-]*[ \t]*\n?(.*?)(\n?```)?\s*$")


class Answer:
    """What the labelling functions see of one field."""

    def __init__(self, raw: str | None, prompt: str | None, languages: "Languages | None" = None):
        self.raw = raw
        body = _THINK.sub("", raw or "").strip()
        self.unclosed_think = bool(re.match(r"(?is)<think>(?!.*</think>)", body))
        fence = _FENCE.match(body) if body.startswith("```") else None
        self.fenced, self.open_fence = bool(fence), bool(fence and not fence[2])
        self.body = (fence[1] if fence else body).strip()
        self.words = re.findall(r"[^\W_]+(?:['’][^\W_]+)?", self.body.lower())
        self.json = self.body[:1] in "{[" and self.body[:1] != ""
        self.balanced, self.value = _balance(self.body) if self.json else (True, None)
        self.keys = re.findall(r'"([^"\\]+)"\s*:', self.body) if self.json else []
        said = " ".join(map(str, self.value.values())) if isinstance(self.value, dict) else self.body
        # An unfinished thought isn't said yet.
        self.said = "" if self.unclosed_think else said
        self.is_null = self.body.lower().strip(" .") == "null"
        grams = lambda ws: set(zip(ws, ws[1:], ws[2:]))
        self.prompt_words = re.findall(r"[^\W_]+", (prompt or "").lower())
        mine = re.findall(r"[^\W_]+", self.body.lower())
        a, p = grams(mine), grams(self.prompt_words)
        self.of_prompt = len(a & p) / len(p) if p else 0.0
        self.of_answer = len(a & p) / len(a) if a else 0.0
        self.size = len(mine) / len(self.prompt_words) if self.prompt_words else 0.0
        self.n = len(mine)
        # What it says in words of its own; names and numbers of the message tell no language.
        own = " ".join(self.keys) if self.json else self.body
        of_prompt = set(self.prompt_words)
        self.own_words = [w for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", own.lower()) if w not in of_prompt]
        self.likely = languages.likely(self.own_words) if languages and not self.unclosed_think and not self.is_null else None


def trigrams(words: list[str]) -> list[str]:
    return [f" {w} "[k : k + 3] for w in words for k in range(len(w))]


class Languages:
    """Likelihoods of words under the trigram counts of each language.

    What each trigram is raised by, seen or not, grows with the counts from ``0.5 / RAREST`` on, so that the likelihood of a
    text doesn't sink as documents are added.
    """

    def __init__(self, counts: dict[str, dict[str, int]]):
        size = len(set().union(*counts.values())) if counts else 0
        total = {k: sum(c.values()) for k, c in counts.items()}
        raised = {k: max(0.5, t * RAREST) for k, t in total.items()}
        self.of_all = {k: math.log(t + 0.5 * size) for k, t in total.items()}
        self.unseen = {k: math.log(r) for k, r in raised.items()}
        self.logs = {k: {g: math.log(n + raised[k]) for g, n in c.items()} for k, c in counts.items()}

    def _mean(self, lang: str, grams: list[str]) -> float:
        seen, unseen = self.logs[lang].get, self.unseen[lang]
        return sum(seen(g, unseen) for g in grams) / len(grams) - self.of_all[lang]

    def likely(self, words: list[str]) -> tuple[float, float] | None:
        """The mean log-likelihood of a trigram in English and in the likeliest other language; None if too little is said."""
        if "en" not in self.logs or sum(map(len, words)) < LEAST_LETTERS:
            return None
        grams = trigrams(words)
        return self._mean("en", grams), max((self._mean(k, grams) for k in self.logs if k != "en"), default=-math.inf)


def _balance(s: str) -> tuple[bool, object]:
    try:
        return True, json.loads(s)
    except ValueError:
        pass
    depth, quoted, k = 0, False, 0
    while k < len(s):
        c = s[k]
        if quoted:
            if c == "\\":
                k += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        k += 1
    return depth <= 0 and not quoted, None


def _vote(yes: bool, no: bool = True) -> str:
    return YES if yes else NO if no else ABSTAIN


def _prose(a: Answer) -> bool:
    return not a.json and not a.is_null and len(a.words) >= 3


def _foreign(a: Answer) -> tuple[int, int]:
    """Function words of the best other language, and English ones, in what the answer says in prose."""
    words = Counter(re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", a.body.lower()))
    own = sum(n for w, n in words.items() if w in _WORDS["en"])
    return max(sum(n for w, n in words.items() if w in ws) for k, ws in _WORDS.items() if k != "en"), own


def _copied(a: Answer) -> bool:
    return a.of_prompt >= 0.5 or a.of_answer >= 0.8


def _foreign_keys(a: Answer) -> bool:
    return bool(a.keys) and not ENGLISH_KEYS & {k.lower() for k in a.keys}


def _trigrams_vote(a: Answer) -> str:
    if a.likely is None or _copied(a) or a.json and ENGLISH_KEYS & {k.lower() for k in a.keys}:
        return ABSTAIN
    english, other = a.likely
    return YES if other > english or english < STRANGE else NO if english - other >= MARGIN else ABSTAIN


def _breaks_off(a: Answer) -> bool:
    """Prose that ends in a word that nothing ends with, or in a mark that asks for more."""
    return _prose(a) and a.of_prompt < 0.5 and (a.words[-1] in OPEN_WORDS and not a.body.rstrip().endswith((".", "!", "?", "।")) or bool(re.search(r"[,(\[{:–-]\s*$", a.body)))


def _stops(a: Answer) -> str:
    """Prose stops with a mark, or breaks off after a letter; after a digit either may be."""
    if not _prose(a) or a.of_prompt >= 0.5 or a.unclosed_think:
        return ABSTAIN
    return NO if re.search(r"[.!?।…:;)\"'’”\]}>]\W*$", a.body) else ABSTAIN if re.search(r"\d\W*$", a.body) else YES


def _sound(a: Answer) -> bool:
    """Evidence that the question was answered."""
    return a.is_null or "amount" in a.keys


def _english(a: Answer) -> bool:
    """Evidence that the answer is in English: its keys, ``null``, the message repeated, or its function words."""
    if a.json:
        return bool(ENGLISH_KEYS & {k.lower() for k in a.keys})
    f = _foreign(a)
    return a.is_null or _copied(a) or f[1] > f[0]


def _letters(text: str) -> float:
    letters = [c for c in text if c.isalpha()]
    return sum(ord(c) > 0x24F for c in letters) / len(letters) if len(letters) >= 5 else 0.0


#: The labelling functions of each defect.
FUNCTIONS: dict[str, list[Callable[[Answer], str]]] = {
    "empty": [
        lambda a: _vote(not any(c.isalnum() for c in a.body)),
        lambda a: _vote(a.raw is None or not a.raw.strip(), False),
        lambda a: _vote(not a.words and not a.unclosed_think),
    ],
    "truncated": [
        lambda a: _vote(a.unclosed_think or a.json and not a.balanced or a.open_fence, a.json or a.is_null),
        lambda a: _vote(not a.balanced, a.json),
        lambda a: _vote(a.unclosed_think, a.is_null),
        _stops,
        lambda a: _vote(_breaks_off(a), False),
        lambda a: _vote(0 < len(a.body) < 4 and "null".startswith(a.body.lower()), a.is_null),
        lambda a: _vote(a.json and not a.balanced and not all(k in a.keys for k in ANSWER_KEYS), a.json and all(k in a.keys for k in ANSWER_KEYS) or a.is_null),
    ],
    "refusal": [
        lambda a: _vote(bool(APOLOGY.search(a.said)) and a.of_prompt < 0.5, _sound(a) or _copied(a)),
        lambda a: _vote(bool(INABILITY.search(a.said)) and a.of_prompt < 0.5, _sound(a) or _copied(a)),
        lambda a: _vote(bool(POLICY.search(a.said)) and a.of_prompt < 0.5, _sound(a)),
        # No field of the answer, no number or name of the message, but a speaker.
        lambda a: _vote("error" in a.keys or _prose(a) and not _copied(a) and bool(SPEAKER.search(a.said)) and not any(c.isdigit() for c in a.said), _sound(a) or _prose(a) and any(c.isdigit() for c in a.said)),
    ],
    "copy": [
        lambda a: _vote(a.of_prompt >= 0.6),
        lambda a: _vote(a.of_answer >= 0.8 and a.n >= 8),
        lambda a: _vote(0.6 <= a.size <= 1.5 and a.of_answer >= 0.5, a.is_null or "amount" in a.keys),
    ],
    "other_language": [
        lambda a: _vote(_foreign_keys(a), bool(_english(a))),
        lambda a: _vote(_prose(a) and not _copied(a) and (lambda f: f[0] >= 2 and f[0] > f[1])(_foreign(a)), _english(a)),
        lambda a: _vote(not a.unclosed_think and not _english(a) and _letters(a.body) > 0.5, _english(a)),
        lambda a: _vote(_foreign_keys(a) or _prose(a) and not _copied(a) and not a.unclosed_think and _foreign(a)[1] == 0, _english(a)),
        _trigrams_vote,
    ],
}


def votes(answer: Answer) -> dict[str, str]:
    """The vote pattern for each defect. An answer that isn't there votes for ``empty`` only."""
    out = {}
    for defect, fs in FUNCTIONS.items():
        out[defect] = "".join(f(answer) for f in fs)
    return out


#: How far a function is trusted to begin with: the chance of a vote of yes on a defective and on a sound field.
START = {1: 0.85, 0: 0.03}
#: Rows that the start counts for, so that a rare class can't drift off.
SMOOTHING = 10


class LabelModel:
    """Naive Bayes over vote patterns, fitted by expectation-maximization from their counts alone.

    Abstentions say nothing: a field on which every function abstains keeps the prior.
    """

    def __init__(self, patterns: dict[str, int], rounds: int = ROUNDS):
        self.prior = 0.05
        self.yes = [dict(START) for _ in range(len(next(iter(patterns), "")))]
        total = sum(patterns.values())
        for _ in range(rounds if total else 0):
            post = {v: self.posterior(v) for v in patterns}
            mass = sum(n * post[v] for v, n in patterns.items())
            self.prior = min(0.5, max(1e-4, (mass + 1) / (total + 20)))
            for j, p in enumerate(self.yes):
                for y in (1, 0):
                    part = {m: sum(n * (post[v] if y else 1 - post[v]) for v, n in patterns.items() if v[j] == m) for m in (YES, NO)}
                    p[y] = (part[YES] + SMOOTHING * START[y]) / (part[YES] + part[NO] + SMOOTHING)

    def posterior(self, pattern: str) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        for p, m in zip(self.yes, pattern):
            if m != ABSTAIN:
                odds += math.log(p[1] / p[0]) if m == YES else math.log((1 - p[1]) / (1 - p[0]))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


# Sentences for validation cases, of other words than the functions look for.
_REFUSALS = ["I would prefer to leave this one alone, thank you.", "Your request was turned down for security reasons.", "I have no access to messages of other people.", "I am not going to read that, it is confidential.", "My rules forbid me to touch such texts, sorry.", "Es tut mir leid, das darf ich nicht beantworten."]
_OTHER = ["Der Kunde hat {} Rupien an den Laden überwiesen.", "Nessuna transazione.", "Aucun achat ici, seulement une annonce.", "El cliente ha pagado {} rupias en la tienda.", "यहाँ कोई भुगतान नहीं हुआ।", '{{"belopp": {}, "motpart": "X"}}', "Det här är bara reklam, ingen betalning.", "To nie jest transakcja, tylko reklama."]
_BROKEN = ["The message names a sum that was paid to", "This is a purchase of some goods at the", "nul", "It says that the customer, "]


def cases_of(k: int, sms: str, expected: str) -> list[tuple[str, str, str]]:
    """(defects or sound, prompt, answer) cases made from one item of the evaluation set, its ``k``-th."""
    out = [("sound", sms, expected), ("sound", sms, f"<think>It names a sum.</think>\n{expected}"), ("sound", sms, f"```json\n{expected}\n```")]
    out.append(("empty", sms, ["", " \n", "<think>Hm.</think>\n", "{}", "```\n```"][k % 5]))
    if expected.startswith("{"):
        out.append(("truncated", sms, expected[: len(expected) * (3 + k % 6) // 10]))
    out += [("truncated", sms, "<think>The text names an amount and"), ("truncated", sms, _BROKEN[k % 4])]
    foreign = " other_language" if k % 6 == 5 else ""
    out.append((f"refusal{foreign}", sms, [r := _REFUSALS[k % 6], json.dumps({"error": r}), f"<think>Hm.</think>\n{r}"][k % 3]))
    out.append(("copy", sms, [sms, sms.upper(), f"SMS: {sms}", json.dumps({"text": sms}), " ".join(sms.split()[2:])][k % 5]))
    out.append(("other_language", sms, _OTHER[k % 8].format(100 + k)))
    return out


def built_cases(items: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """The cases made from (message, expected answer) of the evaluation set."""
    return [case for k, (sms, expected) in enumerate(items) for case in cases_of(k, sms, expected)]


def judged_cases(cases: list[tuple[str, str, str]], languages: Languages | None = None) -> Counter:
    """How many cases have each (defect, vote pattern, whether they have the defect)."""
    return Counter((defect, pattern, defect in kind.split()) for kind, sms, answer in cases for defect, pattern in votes(Answer(answer, sms, languages)).items())


def validated_cutoffs(models: dict[str, LabelModel], cases: list[tuple[str, str, str]], languages: Languages | None = None) -> dict[str, float]:
    """For each defect the cutoff with the best F1 on the cases; 0.5 without cases."""
    return best_cutoffs(models, judged_cases(cases, languages))


def best_cutoffs(models: dict[str, LabelModel], judged: dict[tuple[str, str, bool], int]) -> dict[str, float]:
    """For each defect the cutoff with the best F1 on counted cases; 0.5 without cases.

    Cutoffs lie between neighbouring posteriors of the cases, halfway by their odds; of equal ones that in the widest gap
    is taken. Odds beyond ``SURE`` count as that, so that a cutoff stays away from certainty.
    """
    out = {}
    for defect, model in models.items():
        scored: dict[float, list[int]] = {}
        for (d, pattern, has), n in judged.items():
            if d == defect:
                scored.setdefault(max(-SURE, min(SURE, logit(model.posterior(pattern)))), [0, 0])[has] += n
        steps, best = sorted(scored), (-1.0, 0.0, 0.0)
        above, positive = sum(map(sum, scored.values())), sum(n for _, n in scored.values())
        hit = positive
        for odds, following in zip(steps, steps[1:]):
            above, hit = above - sum(scored[odds]), hit - scored[odds][1]
            best = max(best, (2 * hit / (above + positive), following - odds, (odds + following) / 2))
        out[defect] = 1 / (1 + math.exp(-best[2]))
    return out


def logit(p: float) -> float:
    return math.log(p / (1 - p)) if 0 < p < 1 else math.copysign(math.inf, p - 0.5)


def _voted(languages: Languages):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = lambda text, sms: votes(Answer(text, sms, languages))
        remembered = lru_cache(LATELY)(judge)
        for b in batches:
            out = []
            for i, sms, field, text in zip(b["sample_id"], b["sms"], b["field"], b["text"]):
                short = len(text or "") + len(sms or "") <= LATELY_LENGTH
                for defect, pattern in (remembered if short else judge)(text, sms).items():
                    out.append((i, field, defect, pattern))
            yield pd.DataFrame(out, columns=["sample_id", "field", "defect", "pattern"], dtype=object)

    return run


def _trigram_counts(words: dict[str, Counter]) -> pd.DataFrame:
    total: Counter = Counter()
    for lang, counted in words.items():
        for word, n in counted.items():
            for part in re.findall(r"[^\W\d_]+", word):
                for g in trigrams([part]):
                    total[lang, g] += n
    return pd.DataFrame([(*k, n) for k, n in total.items()], columns=["lang", "gram", "n"])


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts of all texts. What stands between blanks is counted first, so that each distinct word is taken apart once."""
    words: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            words.setdefault(lang, Counter()).update(text.lower().split())
            if len(words[lang]) > HELD:
                yield _trigram_counts({lang: words.pop(lang)})
    yield _trigram_counts(words)


def languages_of(documents: DataFrame) -> Languages:
    """Trigram counts of all documents of each language that ``FUNCTION_WORDS`` knows."""
    docs = require(documents, "lang", "text").select(F.lower("lang").alias("lang"), "text").where(F.col("lang").isin(list(FUNCTION_WORDS)) & F.col("text").isNotNull())
    counts: dict[str, dict[str, int]] = {}
    for r in docs.mapInPandas(_counted, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    return Languages(counts)


def _judged(languages: Languages):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for k, sms, expected in zip(b["k"], b["sms"], b["expected"]):
                total.update(judged_cases(cases_of(int(k), sms, expected), languages))
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["defect", "pattern", "has", "n"])

    return run


def judged_items(gold: DataFrame, languages: Languages) -> dict[tuple[str, str, bool], int]:
    """``judged_cases`` of all items of the evaluation set, in the order of their ids.

    Items are numbered part by part of the sorted table, and dealt out, since the sorted parts may be few; the driver gets vote patterns only.
    """
    items = require(gold, "item_id", "sms", "expected").where("sms IS NOT NULL AND expected IS NOT NULL").orderBy("item_id", "sms", "expected")
    items = written(items.select("sms", "expected", F.monotonically_increasing_id().alias("at")), "validation-items").withColumn("part", F.shiftright("at", 33))
    before = items.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    numbered = items.join(F.broadcast(before), "part").select((F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("k"), "sms", "expected").repartition(parallelism(gold.sparkSession))
    rows = numbered.mapInPandas(_judged(languages), "defect string, pattern string, has boolean, n bigint").groupBy("defect", "pattern", "has").agg(F.sum("n").alias("n"))
    return {(r["defect"], r["pattern"], r["has"]): r["n"] for r in rows.collect()}


def fields(samples: DataFrame) -> DataFrame:
    """``(sample_id, sms, field, text)``: the answer, the filtered answer and the target of each sample."""
    s = require(samples, "sample_id", "doc", "target", "resps", "filtered_resps")
    raw = F.try_element_at(F.try_element_at("resps", F.lit(1)), F.lit(1))
    each = F.array(*(F.struct(F.lit(n).alias("field"), c.alias("text")) for n, c in (("resps", raw), ("filtered_resps", F.try_element_at("filtered_resps", F.lit(1))), ("target", F.col("target")))))
    return s.select("sample_id", F.col("doc.sms").alias("sms"), F.explode(each).alias("x")).select("sample_id", "sms", "x.field", "x.text")


def labelled(samples: DataFrame, gold: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``(sample_id, field, defect, posterior)`` of every field that has a defect.

    Null fields, empty arrays and blank texts are ``empty``; a field may have several defects; repeated samples give
    repeated results; a posterior equal to the cutoff doesn't count; samples without a message can't be copies; extra
    columns are ignored; an empty table gives an empty result. Without ``documents`` trigrams abstain.
    """
    languages = languages_of(documents) if documents is not None else Languages({})
    spark = samples.sparkSession
    kind = dict(samples.dtypes)["sample_id"]
    cast = written(fields(samples).mapInPandas(_voted(languages), f"sample_id {kind}, field string, defect string, pattern string"), "votes")
    # At most three to the number of functions patterns for each defect, however many rows.
    counts: dict[str, dict[str, int]] = {d: {} for d in FUNCTIONS}
    for r in cast.groupBy("defect", "pattern").count().collect():
        counts[r["defect"]][r["pattern"]] = r["count"]
    models = {d: LabelModel(c) for d, c in counts.items()}
    cutoffs = best_cutoffs(models, judged_items(gold, languages))
    over = [(d, v, p) for d, c in counts.items() for v in c if (p := models[d].posterior(v)) > cutoffs[d]]
    table = spark.createDataFrame(over, "defect string, pattern string, posterior double")
    return cast.join(F.broadcast(table), ["defect", "pattern"]).select("sample_id", "field", "defect", "posterior")


def defects(samples: DataFrame, gold: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``(sample_id, defect)``: each defect that occurs in any field of a sample, once."""
    return labelled(samples, gold, documents).select("sample_id", "defect").distinct()
