"""Puts the check statements together: named parts in ``*.sql``, joined as CTEs on demand."""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from clausetrail import rules as R
from clausetrail.operators.labels import LABELS
from clausetrail.sources.documents import ERROR_WORDS
from clausetrail.sources.sample_views import VIEWS
from clausetrail.sources.suffixes import default_rules

HERE = Path(__file__).parent


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pattern(patterns: str | list[str], ignore_case: bool = True) -> str:
    if isinstance(patterns, list):
        patterns = "|".join(f"(?:{p})" for p in patterns)
    return _text(("(?i)" if ignore_case else "") + patterns)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


@lru_cache(maxsize=1)
def constants() -> dict[str, str]:
    """Fixed values the statements refer to as ``$NAME``."""
    out = {}
    for name in dir(R):
        value = getattr(R, name)
        if not name.isupper():
            continue
        if isinstance(value, str):
            out[name] = _pattern(value)
            out[f"{name}_CS"] = _pattern(value, False)
        elif isinstance(value, int):
            out[name] = str(value)
        elif isinstance(value, list) and value and all(isinstance(v, str) for v in value):
            out[name] = _list(value)
            out[f"{name}_RE"] = _pattern(value)
    for section, headings, contents in R.SECTION_RULES:
        out[f"HEAD_{section}"] = _pattern(headings)
        for i, p in enumerate(headings):
            out[f"HEAD{i}_{section}"] = _pattern(p)
        for i, p in enumerate(contents):
            out[f"BODY{i}_{section}"] = _pattern(p)
    for name, p in R.MENTIONS.items():
        out[f"MENTIONS_{name}"] = _pattern(p, False)
    for rule in R.RISK_RULES:
        for i, group in enumerate(rule.needs):
            out[f"NEED{i}_{rule.id}"] = _pattern(group)
        if rule.vetoes:
            out[f"VETO_{rule.id}"] = _pattern(rule.vetoes)
    for name, patterns in R.POSITIVE_RULES:
        out[f"POSITIVE_{name}"] = _pattern(patterns)
    for name, patterns in R.SENSITIVE_FIELDS:
        out[f"FIELD_{name}"] = _pattern([p.replace(r"(?!\s+number\b)", "") for p in patterns])
    for i, p in enumerate(R.WEAK_TERMS_SIGNALS):
        out[f"WEAK{i}"] = _pattern(p)
    for name, _, patterns in R.CONSENT_CATEGORIES:
        out[f"CONSENT_{name}"] = _pattern(patterns)
    for name, p in R.CHOICE_BUTTONS:
        out[f"CHOICE_{name}"] = _pattern(p)
    for name, p in R.RECORDED_CHOICES:
        out[f"RECORDED_{name}"] = _pattern(p)
    out["DATA_WORDS"] = ", ".join(
        f"({i}, {_text(name)}, {j}, {_text(word)})"
        for i, (name, words) in enumerate(R.DATA_CATEGORIES)
        for j, word in enumerate(words)
    )
    out["VENDOR_PATTERNS"] = ", ".join(
        f"({i}, {_text(v)}, {_text(p.split('/')[0].removeprefix('www.'))}, "
        f"{_text('/' + p.split('/', 1)[1] if '/' in p else '')}, {_text(c)}, {_text(r)}, {_list(s)})"
        for i, (v, patterns, c, r, s) in enumerate(R.VENDOR_RULES)
        for p in patterns
    )
    tests = [(category, [f"contains(lower(error_message), {_text(word)})" for word in words]) for category, words in ERROR_WORDS]
    tests += [("http_status", [r"regexp_matches(lower(error_message), 'policy fetch failed:\s*\d{3}')"])]
    tests += [("network", [f"contains(lower(error_message), '{word}')" for word in ("fetch", "network")])]
    out["ERROR_CATEGORY"] = "CASE " + " ".join(f"WHEN {' OR '.join(t)} THEN {_text(c)}" for c, t in tests) + " ELSE 'unknown' END"
    for kind in ("exact", "wildcard", "exception"):
        out[f"SUFFIXES_{kind.upper()}"] = _list([s for s, k in default_rules() if k == kind] or [""])
    out["LABEL_ROWS"] = ", ".join(f"({_text(p)}, {_text(en)}, {_text(ko)})" for p, en, ko in LABELS)
    out["COUNTRY_ROWS"] = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in R.COUNTRY_TLDS.items())
    return out


@lru_cache(maxsize=1)
def parts() -> dict[str, str]:
    found = {name: sql.strip() for name, sql in VIEWS.items()}
    for path in sorted(HERE.glob("*.sql")):
        for chunk in re.split(r"^-- name: ", path.read_text(encoding="utf8"), flags=re.M)[1:]:
            name, body = chunk.split("\n", 1)
            found[name.strip()] = body.strip().rstrip(";")
    # The policy steps once more, over saved versions instead of current policies.
    for name in [n for n in found if n.startswith("o_")]:
        copy = re.sub(r"\bo_(?=\w)", "v_", found[name]).replace("fx_policies", "o_vpolicies")
        found.setdefault("v_" + name[2:], copy)
    return found


def _fill(sql: str) -> str:
    def value(m: re.Match) -> str:
        return constants()[m[1]]

    return re.sub(r"\$([A-Za-z][A-Za-z0-9_]*)", value, sql)


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\b(?:fx|o|v)_\w+", sql)) if n in parts()]


def statement(name: str) -> str:
    """The check for one query as a single SELECT."""
    order: list[str] = []

    def visit(part: str) -> None:
        for need in _needs(parts()[part]):
            if need not in order and need != part:
                visit(need)
        if part not in order:
            order.append(part)

    for need in _needs(parts()[name]):
        if need not in order:
            visit(need)
    # Parts with long lists are worked out once, not put in wherever they are named.
    kind = lambda n: "AS MATERIALIZED" if n in ("o_suffixes", "o_sites_of") else "AS"
    ctes = ",\n".join(f"{n} {kind(n)} (\n{_fill(parts()[n])}\n)" for n in order)
    body = _fill(parts()[name])
    return f"WITH {ctes}\n{body}" if ctes else body


def statements() -> dict[str, str]:
    return {name: statement(name) for name in parts() if not name.startswith(("fx_", "o_", "v_"))}
