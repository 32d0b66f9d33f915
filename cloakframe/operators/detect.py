"""Detectors: text columns to arrays of spans, a registry of them, and chains in the order of their names."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.registry import load

Detector = Callable[[Column], Column]
log = logging.getLogger(__name__)


def email(text: Column) -> Column:
    return P.scan(text, P.EMAIL, "EMAIL")


def phone(text: Column) -> Column:
    return P.scan(text, P.PHONE, "PHONE")


def credit_card(text: Column) -> Column:
    return P.scan(text, P.CREDIT_CARD, "CREDIT_CARD", P.is_card_number)


def card_candidates(text: Column) -> Column:
    """Card numbers before the Luhn test."""
    return P.scan(text, P.CREDIT_CARD, "CREDIT_CARD")


def ip_address(text: Column) -> Column:
    return P.scan(text, P.IP_ADDRESS, "IP_ADDRESS")


def tags(text: Column) -> Column:
    """All tags of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(P.TAG), F.lit(0))


REGISTRY: dict[str, Detector] = {"email": email, "phone": phone, "credit_card": credit_card, "ip_address": ip_address}


def register(name: str, detector: Detector) -> None:
    """Add a detector: a function of a text column that gives a column of spans (P.NO_SPANS)."""
    REGISTRY[name] = detector


def resolve_names(names: Iterable[str]) -> list[Detector]:
    """Detectors by short name or module.function, in order; names that can't be loaded are logged and skipped."""
    found = []
    for name in names:
        try:
            found.append(REGISTRY[name] if name in REGISTRY else load(name))
        except ValueError:
            log.warning("no detector %s: skipped", name)
    return found


def chain(text: Column, names: Iterable[str]) -> Column:
    """Spans of all named detectors, concatenated in the order of the names; none for blank texts."""
    own = [d(text) for d in resolve_names(names)]
    none = F.array().cast(P.NO_SPANS)
    return F.when(P.is_blank(text), none).otherwise(F.concat(*own)) if own else none
