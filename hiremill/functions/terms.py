"""Term canonicalisation and rejection as column expressions, driven by rule tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiremill.functions.text import (canon, compact, contains_any, distinct_by_canon, family, first_made, is_in, let, lit_list, lit_map,
                                     lst, matches, ordered_distinct, s, single_spaces, squeeze)
from hiremill.rules import board as BR
from hiremill.rules import signals as SR
from hiremill.rules import wording as WR

# Characters trimmed from the ends of a line, spellings of which each gets a test of its own, and the shape of a token.
EDGE_MARKS = " -–—·•▪*"
FOLDED = ("ſ", "ı", "i̇")
OWN_TESTS = 8
TOKEN = "[A-Za-z][A-Za-z0-9+#./-]{1,}|[가-힣]{2,}"


@dataclass(frozen=True)
class TermRules:
    """Dictionaries of term handling; the defaults are the fixed values of the domain."""

    inline: Sequence[tuple[str, str]] = tuple(SR.INLINE_TERM_REPLACEMENTS)
    canonical: Mapping[str, str] = field(default_factory=lambda: dict(SR.CANONICAL_TERM_MAP))
    generic: Sequence[str] = tuple(SR.GENERIC_KEYWORD_PATTERNS)
    weak_suffixes: Sequence[str] = tuple(SR.WEAK_KEYWORD_SUFFIXES)
    weak_focus_patterns: Sequence[str] = tuple(SR.WEAK_FOCUS_LABEL_PATTERNS)
    weak_focus_terms: Sequence[str] = tuple(SR.WEAK_FOCUS_LABEL_TERMS)
    broad: Sequence[str] = tuple(SR.BROAD_FOCUS_LABEL_TERMS)
    tools: Sequence[str] = tuple(SR.TOOL_LIKE_KEYWORDS)
    board_canonical: Mapping[str, str] = field(default_factory=lambda: dict(BR.BOARD_FOCUS_CANONICAL_MAP))
    board_broad: Sequence[str] = tuple(BR.BOARD_BROAD_FOCUS_LABELS)
    board_generic: Sequence[str] = tuple(WR.GENERIC_TOKENS)
    bad_suffixes: Sequence[str] = tuple(BR.SIGNAL_BAD_SUFFIXES)
    stop_words: Sequence[str] = tuple(BR.SIGNAL_STOPWORDS)
    role_names: Sequence[str] = tuple(WR.ROLE_NAMES)


TERMS = TermRules()


def ends_with(c: Column, suffixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for x in suffixes:
        out = out | c.endswith(x)
    return out


def literal_core(pattern: str) -> str:
    """Longest literal run of a pattern, lower case: a cheap test that comes before the regular expression."""
    import re

    bare = re.sub(r"\\[bsdwBSDW]|\(\?[^)]*\)", " ", pattern)
    return max(re.split(r"[^0-9A-Za-z가-힣/&.-]+|[.*+?]", bare), key=len).strip(".").lower()


def plain_pattern(pattern: str) -> bool:
    """Words, word borders and white space only: every match holds the longest word."""
    import re

    return re.fullmatch(r"(?:\\b|\\s[*+]?|[0-9A-Za-z가-힣])+", pattern) is not None


def literal_first(pattern: str) -> str:
    """A pattern that opens with a word border and a literal tests the literal first; the border is the costlier test."""
    import re

    opening = re.match(r"\\b([0-9A-Za-z가-힣]{3,})", pattern)
    return f"(?={opening[1][:-1]}){pattern}" if opening and "|" not in pattern else pattern


def signal_text(c: str | Column, rules: TermRules = TERMS) -> Column:
    """Running text with known spellings replaced, doubled `X(X)` folded and edge marks trimmed."""
    cores = sorted({literal_core(p) for p, _ in rules.inline})

    def spelled(given: Column, pattern: str, term: str) -> Column:
        # A plain pattern searches only texts that hold its own literal run, or a letter that a search without case takes for a plain s or i.
        needles = [literal_core(pattern), *FOLDED] if plain_pattern(pattern) else cores

        def one(text: Column) -> Column:
            near = let(F.lower(text), lambda low: contains_any(low, needles))
            return F.when(near, F.regexp_replace(text, f"(?iU){literal_first(pattern)}", term)).otherwise(text)

        return let(given, one)

    def replace(text: Column) -> Column:
        out = text
        for pattern, term in rules.inline:
            # A test of its own nests a lambda for each rule, and Spark gives up resolving deep nests: long tables go without.
            out = spelled(out, pattern, term) if len(rules.inline) <= OWN_TESTS else F.regexp_replace(out, f"(?iU){pattern}", term)
        # Plain substring tests decide whether any of the replacements can apply at all.
        return F.when(let(F.lower(text), lambda low: contains_any(low, cores)), out).otherwise(text) if rules.inline else text

    def whole(given: Column) -> Column:
        text = let(squeeze(given), replace)
        text = let(text, lambda x: F.when(F.contains(x, F.lit("(")), F.regexp_replace(x, "(?U)\\b([A-Za-z0-9가-힣/+]+)\\(\\1\\)", "$1")).otherwise(x))
        return trim_edges(single_spaces(text))

    # A single word without marks changes only if a known spelling occurs in it.
    def plain(x: Column) -> Column:
        return x.rlike("^[0-9A-Za-z가-힣]+$") & ~let(F.lower(x), lambda low: contains_any(low, cores))

    return let(s(c), lambda x: F.when(plain(x), x).otherwise(whole(x)))


def trim_edges(c: Column) -> Column:
    """Texts without line breaks: the marks are stripped as characters, not by a search."""
    return F.btrim(c, F.lit(EDGE_MARKS))


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    if not table:
        return c
    m, keys = lit_map(table), list(table)
    # Most terms are not in the table: a hashed test comes before the walk over its entries.
    return let(c, lambda x: F.when(F.lower(x).isin(keys) | x.isin(keys), F.coalesce(F.try_element_at(m, F.lower(x)), F.try_element_at(m, x), x)).otherwise(x))


def canonical_term(c: str | Column, rules: TermRules = TERMS) -> Column:
    return lookup(signal_text(c, rules), rules.canonical)


def canonical_each(arr: str | Column, rules: TermRules = TERMS) -> Column:
    """canonical_term of every element. In a list of plain words only those that hold a known spelling are worked on."""
    import re

    cores, keys = sorted({literal_core(p) for p, _ in rules.inline}), sorted({k.lower() for k in rules.canonical})
    search = "|".join(re.escape(c) for c in cores)

    def known(x: Column) -> Column:
        return (F.lower(x).rlike(search) if cores else F.lit(False)) | is_in(F.lower(x), keys)

    def tested(a: Column) -> Column:
        words = "[0-9A-Za-z가-힣]++"
        plain = let(F.array_join(a, "\n"), lambda j: j.rlike(f"\\A{words}(?:\n{words})*+\\z") & (F.regexp_count(j, F.lit("\n")) == F.size(a) - 1))
        return F.struct(a.alias("a"), F.when(F.size(a) < 8, False).otherwise(plain).alias("plain"))

    each = lambda p: F.transform(p["a"], lambda x: F.when(p["plain"] & ~known(x), x).otherwise(canonical_term(x, rules)))
    return let(let(lst(arr), tested), each)


def generic_keyword(c: Column, rules: TermRules = TERMS) -> Column:
    """`c` is already signal text."""
    return (matches(F.lower(c), rules.generic, False)
            | let(canon(c), lambda key: (F.length(key) <= 1) | ends_with(key, rules.weak_suffixes)))


def weak_focus(c: Column, rules: TermRules = TERMS) -> Column:
    keys = sorted({_py_canon(x) for x in rules.weak_focus_terms})
    return (c == "") | generic_keyword(c, rules) | matches(F.lower(c), rules.weak_focus_patterns, False) | is_in(canon(c), keys)


def _py_canon(x: str) -> str:
    """Canonical form of a rule constant, computed once when the plan is built."""
    import re

    return re.sub("[^0-9a-z가-힣]+", "", x.lower())


def broad_focus(c: Column, rules: TermRules = TERMS) -> Column:
    return is_in(c, rules.broad)


def is_tool(c: Column, rules: TermRules = TERMS) -> Column:
    return is_in(c, rules.tools)


def canonical_terms(arr: str | Column, limit: int | None = None, rules: TermRules = TERMS, reject_generic: bool = True) -> Column:
    """Canonical, non-generic terms in order, each once."""
    def make(a: Column) -> Column:
        done = canonical_each(a, rules)
        if reject_generic:
            done = F.filter(done, lambda x: ~generic_keyword(x, rules))
        return ordered_distinct(done)

    return make(lst(arr)) if limit is None else first_made(lst(arr), make, limit)


# Board-side canonical form and tests.

def board_focus(c: str | Column, rules: TermRules = TERMS) -> Column:
    table = {_py_canon(k): v for k, v in rules.board_canonical.items()}
    return let(squeeze(c), lambda x: F.coalesce(F.try_element_at(lit_map(table), canon(x)), x)) if table else squeeze(c)


def board_broad(c: Column, rules: TermRules = TERMS) -> Column:
    return is_in(canon(c), {_py_canon(x) for x in rules.board_broad})


def board_invalid(c: Column, rules: TermRules = TERMS) -> Column:
    """Labels that cannot be a focus: blank, too long, with marks, a job title, a role name."""
    return ((canon(c) == "") | (F.length(c) > 28) | c.rlike("[|_()]") | c.rlike("(?i)(engineer|developer|manager|analyst|researcher)$")
            | is_in(canon(c), {_py_canon(x) for x in rules.role_names}))


def non_generic_filter(arr: Column, rules: TermRules = TERMS) -> Column:
    tokens = {_py_canon(x) for x in rules.board_generic}
    cleaned = F.transform(arr, squeeze)
    return F.filter(cleaned, lambda x: let(canon(x), lambda k: (k != "") & ~is_in(k, tokens) & ~ends_with(k, rules.bad_suffixes)))


def unique_non_generic(arr: str | Column, limit: int | None = None, rules: TermRules = TERMS) -> Column:
    make = lambda a: ordered_distinct(non_generic_filter(a, rules))
    return make(lst(arr)) if limit is None else first_made(lst(arr), make, limit)


def keyword_candidates(arr: str | Column, limit: int = 5, rules: TermRules = TERMS) -> Column:
    pool = unique_non_generic(arr, limit * 2, rules)
    good = F.filter(pool, lambda x: (F.length(x) <= 18) & ~F.contains(x, F.lit(" 또는 ")) & ~x.endswith("경험") & ~x.endswith("소통"))
    return F.slice(good, 1, limit)


def text_terms(text: str | Column, company: str | Column, rules: TermRules = TERMS) -> Column:
    """Tokens of a text that may be signals: no stop words, no parts of the company name."""
    own = F.transform(F.regexp_extract_all(squeeze(company), F.lit("[A-Za-z][A-Za-z0-9]+|[가-힣]{2,}"), F.lit(0)), canon)
    whole = canon(company)
    tokens = F.regexp_extract_all(squeeze(text), F.lit(TOKEN), F.lit(0))
    kept = let(F.struct(own.alias("o"), whole.alias("w")), lambda p: F.filter(tokens, lambda t: let(canon(t), lambda k: (
        (F.length(k) >= 2) & ~is_in(k, rules.stop_words) & (k != p["w"]) & ~F.array_contains(p["o"], k) & ~ends_with(k, rules.bad_suffixes)))))
    return F.transform(kept, lambda t: F.when(t.rlike("[A-Za-z]"), F.lower(t)).otherwise(t))
