"""Rule patterns as Java regular expressions, and tests built from them.

The rules are specified in the ECMAScript dialect.  Java reads four things
differently: ``\\b`` is Unicode-aware, ``\\s`` is ASCII only, ``.`` knows other line
ends and ``$`` also matches before a last line end.  ``java_pattern`` spells these out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks as a Java character class, and the same characters one by one for btrim.
BLANKS = r"\t\n\x0B\f\r    -     　﻿"
BLANK_CHARS = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
# One blank.  The outer class is two tests, so that the many characters that are none don't go through all ranges.
BLANK = rf"[[\t\n\x0B\f\r \xA0\u1680-\uFEFF]&&[{BLANKS}]]"
WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
ANY_BUT_LINE_END = r"[^\n\r  ]"


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            escaped = pattern[i : i + 2]
            if escaped == r"\b" and not in_class:
                # One look-around is enough where the neighbour is known to be a word character.
                if _starts_word(pattern[i + 2 :]):
                    out.append(r"(?<!\w)")
                else:
                    out.append(r"(?!\w)" if _ends_word(pattern[:i]) else WORD_EDGE)
            elif escaped == r"\s":
                out.append(BLANKS if in_class else BLANK)
            else:
                out.append(escaped)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "." and not in_class:
            c = ANY_BUT_LINE_END
        elif c == "$" and not in_class:
            c = r"\z"
        out.append(c)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def _starts_word(rest: str) -> bool:
    if rest.startswith("("):
        end = _group_end(rest, 0)
        if rest[end + 1 : end + 2] in ("?", "*", "{"):
            return False
        return all(_starts_word(a) for a in alternatives(rest[1:end].removeprefix("?:")))
    return bool(rest) and rest[0].isascii() and rest[0].isalnum() and rest[1:2] not in ("?", "*", "{")


def _ends_word(before: str) -> bool:
    # A letter or digit of its own, or an optional one after another.
    if re.search(r"(?:^|[^\\])[A-Za-z0-9]$|(?:^|[^\\])[A-Za-z0-9][A-Za-z0-9]\?$", before):
        return True
    if before.endswith(")"):
        start = max(i for i in range(len(before)) if before[i] == "(" and _group_end(before, i) == len(before) - 1)
        return all(_ends_word(a) for a in alternatives(before[start + 1 : -1].removeprefix("?:")))
    return False


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(java_pattern(pattern, ignore_case))


def matches_any(text: Column, patterns: Iterable[str], ignore_case: bool = True) -> Column:
    """One alternation instead of one regex pass per pattern."""
    return matches(text, "|".join(f"(?:{p})" for p in patterns), ignore_case)


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def text_list(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def fold_blanks(text: Column) -> Column:
    """Every run of blanks, no-break space included, becomes one space."""
    return trim_blanks(one_space(text, BLANK))


def one_space(text: Column, blank: str) -> Column:
    """Every run of what ``blank``, a class with the space in it, stands for becomes one space.

    Single spaces, by far the most of them, are no match and are not put together anew.
    """
    return F.regexp_replace(text, f"(?: (?={blank})|[{blank}&&[^ ]]){blank}*", " ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` reads it.

    Array functions are interpreted, so a sub-expression written twice would run twice.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Name of the first rule whose pattern matches."""
    chain = F.lit(otherwise).cast("string")
    for name, pattern in reversed(rules):
        chain = F.when(matches(text, pattern), F.lit(name)).otherwise(chain)
    return chain


# -- literal tests before patterns -----------------------------------------------------
#
# A substring test costs a fraction of a pattern test.  Most alternatives of the rules are
# plain words, and the others hold a word that must be present for them to match.


def alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    out, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif not in_class:
            depth += (c == "(") - (c == ")")
            if c == "|" and depth == 0:
                out.append(pattern[start:i])
                start = i + 1
        i += 1
    return [*out, pattern[start:]]


def _group_end(pattern: str, start: int) -> int:
    depth = 0
    for i in range(start, len(pattern)):
        depth += (pattern[i] == "(") - (pattern[i] == ")")
        if depth == 0:
            return i
    return len(pattern)


def anchors(alternative: str) -> set[str] | None:
    """Lower-case words of which one must occur for the alternative to match, if that can be told."""
    rest = alternative
    while rest.startswith(r"\b"):
        rest = rest[2:]
    if rest.startswith("("):
        end = _group_end(rest, 0)
        if rest[end + 1 : end + 2] in ("?", "*", "{"):
            return anchors(rest[end + 1 :].lstrip("?*"))
        inner = rest[1:end].removeprefix("?:")
        found = [anchors(a) for a in alternatives(inner)]
        return None if inner.startswith("?") or any(f is None for f in found) else set().union(*found)
    word = ""
    while rest:
        if rest.startswith(r"\."):
            char, size = ".", 2
        elif rest[0] in "\\.[](){}?*+^$|":
            break
        else:
            char, size = rest[0], 1
        if rest[size : size + 1] in ("?", "*", "{"):
            break
        word, rest = word + char, rest[size:]
    return {word.lower()} if len(word) >= 2 or (word and not word.isascii()) else None


def holds_any(lowered: Column, words: Iterable[str]) -> Column:
    """True when any of the words occurs; one expression however long the list."""
    found = sorted(words)
    if len(found) < 3:
        return any_of([F.contains(lowered, F.lit(w)) for w in found])
    listed = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in found)
    return F.exists(F.expr(f"array({listed})"), lambda w: F.contains(lowered, w))


def words_of(patterns: Iterable[str]) -> set[str]:
    """Words of which one must occur for any of the patterns to match; each alternative must have some."""
    found = [anchors(a) for a in alternatives("|".join(patterns))]
    assert all(found), "a pattern without a word that must occur"
    return set().union(*found)


def unbroken(words: Iterable[str]) -> set[str]:
    """The longest part without a blank of each word."""
    return {max(w.split(), key=len) for w in words}


def one_of(words: Iterable[str]) -> str:
    """A pattern that finds any of the words, letter by letter, so that all are looked for in one pass."""
    tree: dict = {}
    for word in sorted(words):
        node = tree
        for char in word:
            if node.get("") is not None:
                break  # a shorter word ends here
            node = node.setdefault(char, {})
        else:
            node[""] = {}

    def pattern(node: dict) -> str:
        if "" in node:
            return ""
        parts = [re.escape(char) + pattern(below) for char, below in node.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return pattern(tree)


def starts_of(words: Iterable[str]) -> str:
    """A cheap pattern that holds wherever one of the words may begin: three letters of ASCII words, a range for others.

    Four first letters at a time, and most places fail at the first two letters already.
    """
    letters: dict[str, dict[str, set[str]]] = {}
    for word in words:
        if word.isascii():
            letters.setdefault(word[0], {}).setdefault(word[1:2], set()).add(word[2:3])

    def one_class(chars: Iterable[str]) -> str:
        found = sorted(set(chars))
        return "" if "" in found else f"[{''.join(map(re.escape, found))}]"

    first, parts = sorted(letters), []
    for group in (first[i : i + 4] for i in range(0, len(first), 4)):
        ends = [f"{re.escape(a)}(?:{'|'.join(re.escape(b) + one_class(c) for b, c in sorted(letters[a].items()))})" for a in group]
        two = one_class(group) + one_class(b for a in group for b in letters[a])
        parts.append(f"(?={two})(?:{'|'.join(ends)})")
    if other := sorted({w[0] for w in words if not w.isascii()}):
        parts.append(f"[{other[0]}-{other[-1]}]")
    return "|".join(parts)


def hints(text: Column, words: Iterable[str]) -> Column:
    """Those pieces of a text, in lower case and without blanks, in which an unbroken part of any of the words stands.

    A piece goes from such a part to the next space or line feed, so others behind it are in it too.  One pass over the text
    serves all words; then each is looked for in these few pieces.
    """
    parts = sorted(unbroken(words))
    pattern = f"(?={starts_of(parts)})(?:{one_of(parts)})[^ \\n]*"
    return F.array_join(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))), " ")


def hinted(found: Column, words: Iterable[str]) -> Column:
    """False when none of the words can occur in the text of these hints."""
    return holds_any(found, unbroken(words))


def known_of(found: Column, words: Iterable[str]) -> Column:
    """The unbroken parts of the words that stand in these hints, for ``knows_any``."""
    return F.filter(text_list(sorted(unbroken(words))), lambda w: F.contains(found, w))


def knows_any(known: Column, patterns: Iterable[str]) -> Column:
    """``hinted`` for the words of patterns, from the parts that ``known_of`` has found."""
    return F.arrays_overlap(known, text_list(sorted(unbroken(words_of(patterns)))))


def quick_any(text: Column, lowered: Column, patterns: Iterable[str], found: Column | None = None) -> Column:
    """``matches_any`` for text whose lower-case form is at hand: words first, patterns only behind them.

    ``found``: the ``hints`` of the text, made for words that cover these patterns.
    """
    if found is not None:
        return F.when(hinted(found, words_of(patterns)), quick_any(text, lowered, patterns)).otherwise(F.lit(False))
    plain, guarded, guards, open_ended = set(), [], set(), []
    for alternative in alternatives("|".join(patterns)):
        found = anchors(alternative)
        if found and re.sub(r"\\(.)", r"\1", alternative).lower() in found:
            plain |= found
        elif found:
            guarded.append(alternative)
            guards |= found
        else:
            open_ended.append(alternative)
    test = holds_any(lowered, plain)
    if guarded:
        test = test | (holds_any(lowered, guards) & matches_any(text, guarded))
    if open_ended:
        test = test | matches_any(text, open_ended)
    return test
