"""Whether a question asks for an engineering calculation, which is out of scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.normalize import scope_text

# Signals in normalised text.
EXECUTION = r"\b(calcul\w*|estim\w*|dimension\w*)\b"
REQUEST = r"\b(calculeaza|calculati|calculez|calculam|estimeaza|estimati|estimez|estimam|dimensioneaza|dimensionati|dimensionez|dimensionam|stabileste|stabiliti|stabilesc|stabilim)\b"
NOMINAL = r"\b(?:solicit|doresc|vreau|cer)\b[\s,;:!?-]*(?:(?:va|te)\s+rog[\s,;:!?-]*)?\b(?:calcularea|estimarea|dimensionarea|stabilirea)\b"
METHOD = r"\b(cum|metod\w*|formula|formul\w*|prevede|conform)\b"
METHOD_FORM = r"\bcum\s+se\s+(?:calculeaza|estimeaza|dimensioneaza)\b"
DOCUMENTARY = r"\bin\s+ce\b.{0,40}\barticol\w*\b|\bunde\b.{0,60}\b(?:articol\w*|descrie|explica)\w*\b|\barticol\w*\b.{0,60}\b(?:descrie|explica)\w*\b"
POWER = r"\b(?:cati|cata|cat)\s+kw\b.*\b(?:(?:imi|ne)\s+trebuie|(?:am|avem)\s+nevoie)\b"
PRESCRIPTION = r"\bprevaz\w*\b"
CAPACITY = r"\bcapacitat\w*\b.*\b(?:frigorific\w*|racir\w*|necesar\w*|instalat\w*)\b"
COOLING = r"\b(sarcina|necesar\w*)\b.*\b(racire|termic\w*)\b"
PROJECT = r"\b(\d+(?:[.,]\d+)?\s*(?:kw|w|mp|m2|m³|m3|°c|c)|hala|cladire|spatiu|inaltime|temperatur\w*|oras|localitate|buzau)\b"
PRESCRIBED = r"\b(?:debit\w*\s+minim|prag\w*|valo\w*\s+prescris\w*)\b"


def is_calculation_request(question: Column) -> Column:
    """The first signal that holds decides: an order beats every exception, then what makes it a question about the
    text, then signs of a calculation. Null and blank questions are not requests."""
    text = scope_text(question)
    has = lambda pattern: text.rlike(pattern)
    rest = F.regexp_replace(text, METHOD_FORM, "")
    return (
        F.when(rest.rlike(REQUEST) | rest.rlike(NOMINAL), True)
        .when(has(PRESCRIBED) | has(PRESCRIPTION) | has(DOCUMENTARY), False)
        .when(has(METHOD_FORM) | has(METHOD), False)
        .when(has(EXECUTION), True)
        .when(has(POWER) | has(CAPACITY), True)
        .otherwise(has(COOLING) & has(PROJECT))
    )
