"""Many patterns at once: a rule book as an automaton in every task, so that no text meets every rule.

Texts that have to contain a pattern are found by an Aho-Corasick automaton over all patterns. A regular expression is tried only on
texts that hold one of the literals it can't do without, which a second automaton finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (bank, mode, pattern, category): patterns of mode ``contains`` are normalized.
Entry = tuple[str | None, str, str, str]


def needed_literals(pattern: str) -> list[str] | None:
    """Upper-case texts of which every match of the expression holds one; null where that isn't plain. Groups and classes aren't
    looked into."""
    found, pieces, piece, k = [], [], "", 0
    while k <= len(pattern):
        c = pattern[k] if k < len(pattern) else "|"
        if c in "()[]":
            return None
        if c == "\\" and k + 1 < len(pattern) and not pattern[k + 1].isalnum():
            piece, k = piece + pattern[k + 1], k + 2
            continue
        if c in "?*{":  # what stands before may be missing
            pieces, piece = [*pieces, piece[:-1]], ""
            k = pattern.find("}", k) if c == "{" else k
            if k < 0:
                return None
        elif c == "|":
            longest = max([*pieces, piece], key=len)
            if not longest or not longest.isascii():
                return None
            found, pieces, piece = [*found, longest.upper()], [], ""
        elif c in ".^$+\\":
            pieces, piece = [*pieces, piece], ""
            k += c == "\\"
        else:
            piece += c
        k += 1
    return found


class Matcher:
    """The first of a book's rules that fits a text, by bank; ``None`` as a bank stands for rules of any."""

    def __init__(self, entries: Iterable[Entry]):
        self.books: dict = {}
        for place, (bank, mode, pattern, category) in enumerate(entries):
            book = self.books.setdefault(bank, {"all": None, "contains": ahocorasick.Automaton(), "literals": ahocorasick.Automaton(), "always": [], "regexes": {}})
            if mode == "contains":
                if not pattern:
                    book["all"] = (place, category) if book["all"] is None else book["all"]
                elif pattern not in book["contains"]:
                    book["contains"].add_word(pattern, (place, category))
            elif mode == "regex":
                book["regexes"][place] = (re.compile(pattern, re.IGNORECASE), category)
                literals = needed_literals(pattern)
                if literals is None:
                    book["always"].append(place)
                for word in literals or []:
                    book["literals"].add_word(word, [*book["literals"].get(word, []), place])
        for book in self.books.values():
            book["contains"].make_automaton()
            book["literals"].make_automaton()

    def first(self, bank: str | None, text: str | None, normal: str | None) -> tuple[int, str] | None:
        book = self.books.get(bank)
        if book is None or text is None:
            return None
        hits = [book["all"]] if book["all"] else []
        if len(book["contains"]):
            hits += [hit for _, hit in book["contains"].iter(normal or "")]
        best = min(hits, default=None)
        if not text.isascii():  # letters that fold in unusual ways
            tried: Iterable[int] = book["regexes"]
        else:
            tried = [*book["always"], *(p for _, places in (book["literals"].iter(text.upper()) if len(book["literals"]) else []) for p in places)]
        for place in sorted(set(tried)):
            if best is not None and place > best[0]:
                break
            regex, category = book["regexes"][place]
            if regex.search(text):
                return place, category
        return best


#: By the identity of a book's value, which stays as long as the worker holds the broadcast.
_built: dict[int, tuple[list[Entry], Matcher]] = {}


def _matcher(book: Broadcast) -> Matcher:
    """A worker builds the automaton of the last book once, for all its tasks."""
    if id(book.value) not in _built:
        _built.clear()
        _built[id(book.value)] = (book.value, Matcher(book.value))
    return _built[id(book.value)][1]


def first_category(book: Broadcast, bank: Column, text: Column, normal: Column) -> Column:
    """The category of the first rule that fits, null where none does; each distinct text of a batch is matched once."""

    @F.pandas_udf("string")
    def category(bank: pd.Series, text: pd.Series, normal: pd.Series) -> pd.Series:
        matcher, known = _matcher(book), {}
        out = []
        for key in zip(bank, text, normal, strict=True):
            if key not in known:
                hit = matcher.first(*key)
                known[key] = hit and hit[1]
            out.append(known[key])
        return pd.Series(out, dtype=object)

    return category(bank, text, normal)
