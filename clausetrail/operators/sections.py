"""Policy sections: which of the 13 topics a text covers and where."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions import text as T
from clausetrail.functions.patterns import any_of, hints, java_pattern, known_of, knows_any, let, quick_any, text_list, words_of
from clausetrail.operators.policy import with_text
from clausetrail.operators.settle import settle


def with_blocks(prepared: DataFrame) -> DataFrame:
    """Adds ``blocks``: (idx, title, block) of the document in ``text``."""
    step = prepared.withColumn("_heading", T.heading_blocks(F.col("text")))
    # Packing is only worked out where there are too few headings.
    step = step.withColumn("_packed", F.when(F.size("_heading") < 3, T.packed_blocks(F.col("text"))))
    step = step.withColumn("_blocks", T.blocks(F.col("_heading"), F.col("_packed")))

    def titled_block(title: Column, block: Column, idx: Column) -> Column:
        return F.struct(idx.alias("idx"), title.alias("title"), block.alias("block"))

    titled = F.transform("_blocks", lambda b, i: let(T.block_title(b), lambda title: titled_block(title, b, i)))
    return step.withColumn("blocks", titled).drop("_heading", "_packed", "_blocks")


SECTION_WORDS = {w for _, headings, contents in R.SECTION_RULES for w in words_of([*headings, *contents])}


def block_score(block: Column, headings: list[str], contents: list[str]) -> Column:
    title, text = [(block[f], block[f"{f}_lowered"]) for f in ("title", "block")]

    def shows(where: tuple[Column, Column], patterns: list[str]) -> Column:
        return knows_any(block["known"], patterns) & quick_any(*where, patterns)

    score = F.when(shows(title, headings), 6).otherwise(0)
    for pattern in contents:
        score = score + F.when(shows(text, [pattern]), 2).otherwise(0)
    for pattern in headings:
        score = score + F.when(shows(text, [pattern]), 1).otherwise(0)
    return score


def with_hints(block: Column) -> Column:
    """The block with its lower-case forms and the hints of block and title."""
    return F.struct(
        block["idx"].alias("idx"),
        block["title"].alias("title"),
        F.lower(block["title"]).alias("title_lowered"),
        block["block"].alias("block"),
        F.lower(block["block"]).alias("block_lowered"),
        hints(F.concat(block["title"], F.lit(" "), block["block"]), SECTION_WORDS).alias("hints"),
    )


def section_scores(blocks: Column) -> Column:
    """Array of (section_id, scored blocks with a score above zero)."""

    def scored(held: Column, headings: list[str], contents: list[str]) -> Column:
        # Few blocks know a word of a section; the others score nothing.
        every = F.transform(
            F.filter(held, lambda b: knows_any(b["known"], [*headings, *contents])),
            lambda b: F.struct(
                (-block_score(b, headings, contents)).alias("order"),
                b["idx"].alias("idx"),
                b["title"].alias("title"),
                b["block"].alias("block"),
            ),
        )
        return F.filter(every, lambda s: s["order"] < 0)

    def per_section(held: Column) -> Column:
        return F.array(
            *[
                F.struct(F.lit(section).alias("section_id"), scored(held, headings, contents).alias("scored"))
                for section, headings, contents in R.SECTION_RULES
            ]
        )

    # A block without any word of the rules scores nothing anywhere.
    telling = F.filter(F.transform(blocks, with_hints), lambda b: b["hints"] != "")
    return let(F.transform(telling, lambda b: b.withField("known", known_of(b["hints"], SECTION_WORDS))), per_section)


def with_sections(prepared: DataFrame, keep_blocks: bool = False) -> DataFrame:
    """Adds ``sections``: one (section_id, found, evidence) per rule, found or not."""
    step = with_blocks(prepared).withColumn("_scores", section_scores(F.col("blocks")))
    best = F.transform(
        "_scores",
        lambda s: F.struct(
            s["section_id"].alias("section_id"),
            (F.size(s["scored"]) > 0).alias("found"),
            F.transform(
                F.slice(F.array_sort(s["scored"]), 1, R.BLOCKS_PER_SECTION),
                lambda b: F.struct(
                    F.when(b["title"] == "", s["section_id"]).otherwise(b["title"]).alias("title"),
                    T.excerpt(b["block"], R.EXCERPT_CHARS).alias("excerpt"),
                ),
            ).alias("evidence"),
        ),
    )
    out = step.withColumn("sections", best).drop("_scores")
    return out if keep_blocks else out.drop("blocks")


def found_ids(sections: Column) -> Column:
    """Ids of the sections present, in rule order."""
    return F.transform(F.filter(sections, lambda s: s["found"]), lambda s: s["section_id"])


def has(found: Column, *section_ids: str) -> Column:
    """True when any of the sections is present."""
    return F.arrays_overlap(found, text_list(section_ids))


def section_text(sections: Column, section_id: str) -> Column:
    """Joined excerpts of one section, empty when it is not present."""
    mine = F.filter(sections, lambda s: (s["section_id"] == section_id) & s["found"])
    return F.array_join(F.flatten(F.transform(mine, lambda s: F.transform(s["evidence"], lambda e: e["excerpt"]))), " ")


def disclosed_categories(sections: Column, text: Column) -> Column:
    """Data categories named in the collected-data section, or in the text when there is none."""
    source = let(section_text(sections, "collected_data"), lambda t: F.when(t != "", t).otherwise(text))
    hits = T.data_categories(T.tokens(source))
    return F.transform(hits, lambda h: h["id"])


def section_rows(policies: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per (document, section)."""
    found = with_sections(with_text(policies.select(key, "body")))
    return found.select(key, F.inline_outer("sections"))


def presence(policies: DataFrame, key: str = "doc_id") -> DataFrame:
    """One boolean column per section, without a shuffle."""
    found = with_sections(with_text(policies.select(key, "body"))).select(key, found_ids(F.col("sections")).alias("ids"))
    return found.select(key, *[F.array_contains("ids", s).alias(s) for s in R.SECTION_IDS])


def vendor_aliases(vendors: list[str]) -> dict[str, list[str]]:
    """Names a vendor may go by in a text; names under four letters are too short to trust."""
    split = {v: [a.strip().lower() for a in v.split("/")] for v in vendors}
    return {v: [a for a in names if sum(c.isalnum() for c in a) >= 4] for v, names in split.items()}


def names_alias(text: Column, alias: str) -> Column:
    """The alias as whole words, letters and digits of any script counting as word characters."""
    words = r"\s+".join(re.escape(w) for w in alias.split())
    return F.contains(text, F.lit(alias.split()[0])) & text.rlike(rf"(?iu)(?:^|[^\p{{L}}\p{{N}}]){words}(?=$|[^\p{{L}}\p{{N}}])")


FACTS = ("found_sections", "disclosed", "policy_domains", "named_vendors", *(f"mentions_{name}" for name in R.MENTIONS))


def with_facts(prepared: DataFrame) -> DataFrame:
    """Adds what the behaviour checks need of a policy (FACTS) to documents with ``text``."""
    base = with_sections(prepared).withColumn("_lowered", F.lower("text"))
    domains = F.when(
        F.col("_lowered").rlike(r"[a-z0-9-]\.[a-z0-9-]"),
        F.regexp_extract_all(F.col("_lowered"), F.lit(java_pattern(R.POLICY_DOMAIN)), F.lit(0)),
    ).otherwise(F.array().cast("array<string>"))
    aliases = vendor_aliases([v[0] for v in R.VENDOR_RULES])
    named = F.array_compact(
        F.array(
            *[
                F.when(any_of([names_alias(F.col("_lowered"), a) for a in names]), F.lit(vendor))
                for vendor, names in aliases.items()
                if names
            ]
        )
    )
    facts = base.select(
        *prepared.columns,
        found_ids(F.col("sections")).alias("found_sections"),
        disclosed_categories(F.col("sections"), F.col("text")).alias("disclosed"),
        F.array_distinct(F.transform(domains, lambda d: F.regexp_replace(d, r"^www\.", ""))).alias("policy_domains"),
        named.alias("named_vendors"),
        *[quick_any(F.col("_lowered"), F.col("_lowered"), [p]).alias(f"mentions_{name}") for name, p in R.MENTIONS.items()],
    )
    return settle(facts)


def policy_facts(policies: DataFrame, key: str = "doc_id") -> DataFrame:
    """The facts alone, in one narrow row per document.

    The text itself is dropped, so joining these rows to pages moves a few hundred bytes.
    """
    return with_facts(with_text(policies.select(key, "body"))).select(key, *FACTS)
