"""Denylist matching: whole words, any case, optional plural."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaspark.functions.text import col

# What may stand next to a whole word.
BEFORE = r"(^|[^\p{L}\p{N}_])"
AFTER = r"s?($|[^\p{L}\p{N}_])"


@dataclass(frozen=True)
class Category:
    key: str
    display_name: str
    banned: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    safe: str = ""
    use_archive: bool = False
    library_path: str = ""
    parent: str | None = None
    context: str = ""


def _quote(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", term)


def term_pattern(term: str) -> str:
    """Pattern of one lower-case term.  The term itself comes first, so that
    the search skips to its occurrences; only there the neighbours are tested."""
    quoted = _quote(term)
    return rf"{quoted}(?<![\p{{L}}\p{{N}}_]{quoted})s?(?![\p{{L}}\p{{N}}_])"


def mentions_any(text: Column | str, terms: Iterable[str], lowered: bool = False) -> Column:
    body = col(text) if lowered else F.lower(col(text))
    tests = [body.rlike(term_pattern(t.lower())) for t in terms]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def violates(keyword: Column | str, category: Column | str, categories: Iterable[Category]) -> Column:
    """Whether a generated keyword hits its category's denylist."""
    branch = None
    for cfg in categories:
        hit = mentions_any(keyword, cfg.banned)
        test = col(category) == cfg.key
        branch = F.when(test, hit) if branch is None else branch.when(test, hit)
    return F.coalesce(branch, F.lit(False)) if branch is not None else F.lit(False)


def make_safe(keyword: Column | str, category: Column | str, categories: Iterable[Category]) -> Column:
    """The keyword, or the category's safe one when it hits the denylist."""
    categories = list(categories)
    safe = F.create_map(*[F.lit(x) for c in categories for x in (c.key, c.safe)])
    return F.when(violates(keyword, category, categories), F.try_element_at(safe, col(category))).otherwise(col(keyword))


def make_all_safe(keywords: Column | str, category: Column | str, categories: Iterable[Category]) -> Column:
    categories = list(categories)
    return F.transform(col(keywords), lambda k: make_safe(k, category, categories))


def first_banned(text: Column | str, cfg: Category, lowered: bool = False) -> Column:
    """First banned term, in list order, of a catalogue text that mentions no
    positive term.  ``lowered`` says that the text is in lower case already."""
    body = col(text) if lowered else F.lower(col(text))
    named = F.lit(None).cast("string")
    for term in reversed(cfg.banned):
        named = F.when(body.rlike(term_pattern(term.lower())), F.lit(term)).otherwise(named)
    if not cfg.positive:
        return named
    return F.when(~mentions_any(body, cfg.positive, True), named)


def first_banned_by_category(text: Column | str, categories: Iterable[Category], lowered: bool = False) -> Column:
    """map(category key -> first banned term or null) of a text."""
    return F.create_map(*[x for c in categories for x in (F.lit(c.key), first_banned(text, c, lowered))])


def first_banned_from_arrays(text: Column | str, banned: Column | str, positive: Column | str) -> Column:
    """The same test with the term lists in columns, for category tables too
    large to be spelled out as expressions.  The plain substring test runs
    first, so a pattern is built only for terms that do occur."""
    lowered = F.lower(col(text))

    def found(term: Column) -> Column:
        quoted = F.regexp_replace(F.lower(term), r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")
        return F.contains(lowered, F.lower(term)) & F.rlike(
            lowered, F.concat(F.lit(BEFORE), quoted, F.lit(AFTER))
        )

    return F.when(
        ~F.exists(col(positive), found), F.try_element_at(F.filter(col(banned), found), F.lit(1))
    )
