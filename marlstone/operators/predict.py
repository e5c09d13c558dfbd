"""Prompts, and the hook behind which any model answers them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.answers import EXEMPLARS

INSTRUCTION = (
    "Read one bank message and answer with one JSON object: amount, counterparty, type (debit or credit), account.\n"
    "Answer null if no money has moved: codes, offers, reminders and requests are not transactions."
)


def prompt_prefix(exemplars: list[tuple[str, str, str]] = EXEMPLARS) -> str:
    """The part all prompts share, made once."""
    shown = "\n\n".join(f"Sender: {s}\nMessage: {m}\nAnswer: {a}" for s, m, a in exemplars)
    return f"{INSTRUCTION}\n\n<examples>\n{shown}\n</examples>\n"


def prompt(sender: Column, sms: Column, exemplars: list[tuple[str, str, str]] = EXEMPLARS) -> Column:
    return F.concat(F.lit(prompt_prefix(exemplars) + "\nSender: "), F.coalesce(sender, F.lit("")), F.lit("\nMessage: "), sms, F.lit("\nAnswer:"))


def without_bos(text: Column, bos: str) -> Column:
    """A chat template's first token taken off, where the model adds its own."""
    return F.when(F.startswith(text, F.lit(bos)), F.substring(text, len(bos) + 1, 1 << 30)).otherwise(text)


def predicted(prompts: DataFrame, model: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``(doc_id, response)``: ``model`` is made once in each task and answers ``(doc_id, prompt)`` batch by batch.

    A null prompt gets a null response. Scores of likelihood aren't offered.
    """
    kind = dict(prompts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = model()
        for b in batches:
            out = [None if p is None else answer(p) for p in b.column("prompt").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "response"])

    return prompts.select("doc_id", "prompt").mapInArrow(run, f"doc_id {kind}, response string")


class TwoPhase:
    """A model that first thinks in free text up to the closing tag, then answers under a constraint."""

    def __init__(self, think: Callable[[str], str], answer: Callable[[str], str]):
        self.think, self.answer = think, answer

    def __call__(self, prompt_: str) -> str:
        thought = self.think(prompt_).partition("</think>")[0].removeprefix("<think>").strip()
        return f"<think>{thought}</think>\n{self.answer(f'{prompt_}<think>{thought}</think>')}"


class RulePredictor:
    """A predictor without weights: amount, direction, account and counterparty by plain cues.

    The patterns are such that SQL reads them alike.
    """

    AMOUNT = r"(?i)(?:rs\.?|inr|₹)\s*([0-9,]+(?:\.[0-9]+)?)"
    ACCOUNT = r"(?i)((?:a/c|(?:credit |debit )?card)(?: ending)?\s*[x*]*[0-9]{3,})"
    OUT = r"(?i)\b(?:debited|spent|sent|paid|withdrawn|purchase)\b"
    IN = r"(?i)\b(?:credited|refunded|received|deposited)\b"
    WHO = r"(?:toward|into|beside|shop|out of|at|to)\s+([A-ZÀ-Þ&][0-9A-Za-z_'&À-ÿ]+\s?(?:[A-ZÀ-Þ&][0-9A-Za-z_'&À-ÿ]*\s?){0,3})"
    _AMOUNT, _ACCOUNT, _OUT, _IN, _WHO = map(re.compile, (AMOUNT, ACCOUNT, OUT, IN, WHO))

    def __call__(self, prompt_: str) -> str:
        sms = prompt_.rpartition("Message: ")[2].removesuffix("\nAnswer:")
        a, acc, out, back = self._AMOUNT.search(sms), self._ACCOUNT.search(sms), self._OUT.search(sms), self._IN.search(sms)
        if not (a and acc and (out or back)):
            return "null"
        who = self._WHO.search(sms)
        kind = "credit" if back and (not out or back.start() < out.start()) else "debit"
        return json.dumps({"amount": float(a[1].replace(",", "") or 0), "counterparty": who[1].strip() if who else None, "type": kind, "account": acc[1]}, ensure_ascii=False)
