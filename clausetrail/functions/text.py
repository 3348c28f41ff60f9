"""Text preparation: sentences, clauses, blocks, titles, tokens and excerpts."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions.patterns import BLANK, any_of, fold_blanks, holds_any, java_pattern, let, one_space, text_list, trim_blanks


def bounded(body: Column, max_chars: int | None = None) -> Column:
    """Text limited to ``max_chars`` (no limit when None) without outer blanks."""
    text = F.coalesce(body, F.lit(""))
    return trim_blanks(F.substring(text, 1, max_chars) if max_chars else text)


def windows(text: Column, size: int = R.MAX_SENTENCE_CHARS, overlap: int = R.SENTENCE_OVERLAP_CHARS) -> Column:
    """Overlapping windows that cover the whole text; short text stays one window."""
    step = size - overlap
    last = F.ceil((F.length(text) - F.lit(size)) / F.lit(step)).cast("int")
    many = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.substring(text, i * F.lit(step) + F.lit(1), F.lit(size)),
    )
    return F.when(F.length(text) <= size, F.array(text)).otherwise(many)


def sentences(text: Column) -> Column:
    """Sentences in order; a blank line ends one even without a stop mark."""
    pieces = F.split(F.replace(text, F.lit("\r"), F.lit("")), f"{BLANK}(?<=[.!?。！？](?s:.)){BLANK}*|\n{{2,}}")
    folded = F.transform(pieces, lambda p: trim_blanks(one_space(p, "[ \t\n]")))
    return F.filter(F.flatten(F.transform(folded, lambda s: windows(s))), lambda s: s != "")


def clauses(sentence: Column) -> Column:
    """Parts of a sentence that carry their own subject, verb or contrast."""
    # Most sentences hold none of the joining words and stay whole.
    joined = F.regexp_replace(sentence, java_pattern(R.COORDINATED_SUBJECT), "; ")
    joined = F.regexp_replace(joined, java_pattern(R.KOREAN_NEGATED_CONNECTIVE, False), "$1; ")
    marked = F.when(holds_any(F.lower(sentence), ["and", "while", "whereas", "않", "아니"]), joined).otherwise(sentence)

    def parts(text: Column) -> Column:
        pieces = F.transform(F.split(text, java_pattern(R.CLAUSE_SEPARATOR)), trim_blanks)
        return F.when(
            holds_any(F.lower(text), [";", "but", "however", "except that", "하지만", "그러나", "다만"]),
            F.filter(pieces, lambda c: c != ""),
        ).otherwise(F.filter(F.array(trim_blanks(text)), lambda c: c != ""))

    return let(marked, parts)


def _block_text(text: Column) -> Column:
    text = F.replace(text, F.lit("\r"), F.lit(""))
    text = one_space(text, "[ \t]")
    return trim_blanks(F.regexp_replace(text, "\n{3,}", "\n\n"))


def _long_enough(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: F.length(b) >= R.MIN_BLOCK_CHARS)


def heading_blocks(text: Column) -> Column:
    """Blocks that start at a line which looks like a heading."""
    return _long_enough(F.transform(F.split(_block_text(text), java_pattern(R.BLOCK_HEADING, False)), trim_blanks))


def packed_blocks(text: Column) -> Column:
    """Sentences put together until a block is longer than the limit."""
    empty = F.struct(F.array().cast("array<string>").alias("full"), F.lit("").alias("open"))

    def add(state: Column, sentence: Column) -> Column:
        fresh = (state["open"] == "") | (F.length(state["open"]) > R.PACKED_BLOCK_CHARS)
        closed = F.when(fresh & (state["open"] != ""), F.concat(state["full"], F.array(state["open"])))
        return F.struct(
            closed.otherwise(state["full"]).alias("full"),
            F.when(fresh, sentence).otherwise(F.concat_ws(" ", state["open"], sentence)).alias("open"),
        )

    return _long_enough(
        F.aggregate(sentences(_block_text(text)), empty, add, lambda s: F.concat(s["full"], F.array(s["open"])))
    )


def blocks(heading: Column, packed: Column, most: int | None = None) -> Column:
    """Heading blocks where there are at least three, else packed blocks; all of them unless ``most`` is given."""
    chosen = F.when(F.size(heading) >= 3, heading).otherwise(packed)
    return F.slice(chosen, 1, most) if most else chosen


def excerpt(text: Column, limit: int) -> Column:
    def cut(folded: Column) -> Column:
        return F.concat(F.substring(folded, 1, limit - 3), F.lit("..."))

    whole = let(fold_blanks(text), lambda t: F.when(F.length(t) > limit, cut(t)).otherwise(t))
    # The beginning of a long text is enough unless it is mostly blanks.
    start = fold_blanks(F.substring(text, 1, 4 * limit))
    return F.when(F.length(text) <= 4 * limit, whole).otherwise(let(start, lambda t: F.when(F.length(t) > limit, cut(t)).otherwise(whole)))


def block_title(block: Column) -> Column:
    """First line without its number, or the first sentence when that line is long."""
    lines = F.filter(F.transform(F.split(block, "\n"), trim_blanks), lambda line: line != "")
    sentence = F.coalesce(F.try_element_at(sentences(bounded(block)), F.lit(1)), F.lit(""))
    return let(
        F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")),
        lambda first: F.when(
            F.length(first) <= R.BLOCK_TITLE_CHARS, F.regexp_replace(first, java_pattern(r"^\d{1,2}[.)]\s*"), "")
        ).otherwise(excerpt(sentence, R.FALLBACK_TITLE_CHARS)),
    )


# Spark's own collations bring this library; the method takes a text and whether compatibility forms are folded.
_NORMALIZER = ("com.ibm.icu.text.Normalizer", "compose")
# Letter by letter, as a class tells single characters far faster than ranges.
_LATIN = string.ascii_lowercase + string.digits
# Below U+00A0 a text is as NFKC has it.
_OTHER_LETTERS = r"[^\x00-\x9F]"


def nfkc(text: Column) -> Column:
    """The text in NFKC; only rows with letters beyond ASCII are looked at."""
    composed = F.java_method(F.lit(_NORMALIZER[0]), F.lit(_NORMALIZER[1]), text, F.lit(True))
    return F.when(text.rlike(_OTHER_LETTERS), composed).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters, digits and Hangul with single spaces, of the text in NFKC.

    Ligatures, full-width and decomposed letters, and marks that join letters count as what they stand for.
    """
    plain = nfkc(F.coalesce(text, F.lit("")))
    spaced = F.regexp_replace(plain, "[A-Z](?<=[a-z0-9].)", " $0")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.btrim(one_space(F.lower(spaced), f"[^{_LATIN}가-힣]"))


def word_count(text: Column) -> Column:
    trimmed = trim_blanks(text)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"{BLANK}+")))


def plural(words: str) -> str:
    """English plural of the last word, by ending."""
    if words.endswith("y") and words[-2:-1] not in "aeiou":
        return words[:-1] + "ies"
    return words + ("es" if words.endswith(("s", "x", "z", "ch", "sh")) else "s")


def searchable(token_text: Column) -> Column:
    """Normalised text in the three forms words are looked up in."""
    # "ip address" names a device fact, never a postal address.
    no_ip = F.regexp_replace(token_text, java_pattern(r"\bip address(?:es)?\b", False), "")
    space = F.lit(" ")
    return F.struct(
        token_text.alias("text"),
        F.concat(space, token_text, space).alias("padded"),
        F.concat(space, no_ip, space).alias("no_ip"),
    )


def has_data_word(where: Column, word: str) -> Column:
    """Hangul words match anywhere, other words whole and also in the plural."""
    if hangul(word):
        return F.contains(where["text"], F.lit(word))
    padded = where["no_ip"] if word == "address" else where["padded"]
    return F.contains(padded, F.lit(f" {word} ")) | F.contains(padded, F.lit(f" {plural(word)} "))


def hangul(word: str) -> bool:
    return any("가" <= c <= "힣" for c in word)


def may_hold(where: Column, word: str) -> Column:
    """False when the word can't be present: a first word of it must be among ``known``, Hangul needs a text with some."""
    if hangul(word):
        return where["hangul"]
    return any_of([F.array_contains(where["known"], w) for w in {word.split()[0], plural(word).split()[0]}])


def data_categories(token_text: Column) -> Column:
    """Array of (id, matched words) for every data category present, words in list order."""
    listed = [w for _, words in R.DATA_CATEGORIES for w in words if not hangul(w)]
    first = sorted({form.split()[0] for w in listed for form in (w, plural(w))})

    def look_up(where: Column) -> Column:
        def present(word: str) -> Column:
            return may_hold(where, word) & has_data_word(where, word)

        return F.array(
            *[
                F.struct(
                    F.lit(name).alias("id"),
                    F.array_compact(F.array(*[F.when(present(w), F.lit(w)) for w in words])).alias("matched"),
                )
                for name, words in R.DATA_CATEGORIES
            ]
        )

    def forms(text: Column) -> Column:
        known = F.array_intersect(F.split(text, " "), text_list(first))
        return searchable(text).withField("known", known).withField("hangul", text.rlike("[가-힣]"))

    found = F.filter(let(let(token_text, forms), look_up), lambda h: F.size(h["matched"]) > 0)
    return F.transform(
        found, lambda h: F.struct(h["id"].alias("id"), F.slice(h["matched"], 1, R.MATCHED_WORDS).alias("matched"))
    )
