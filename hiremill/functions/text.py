"""Column expressions for text and ordered lists. All of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything outside digits, Latin letters and Hangul is ignored when terms are compared.
CANON_KEEP, CANON_WORD = "[0-9a-z가-힣]+", "\\A[0-9a-z가-힣]*+\\z"
LIST_DELIMITERS = "[\\n\\r,;/|·]+"
LINE_DELIMITERS = "[\\n\\r]+"
EMPTY = "cast(array() as array<string>)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def s(c: str | Column) -> Column:
    """Missing and blank are one thing: NULL becomes ''."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def is_ascii(x: Column) -> Column:
    return F.octet_length(x) == F.length(x)


def blanks_only(x: Column) -> Column:
    """ASCII text whose only white space is the blank: byte tests, so that most texts are spared a regular expression."""
    return is_ascii(x) & ~contains_any(x, ["\n", "\t", "\r", "\x0b", "\x0c"])


def strip(c: str | Column) -> Column:
    return let(s(c), lambda x: F.when(blanks_only(x), F.trim(x)).otherwise(F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")))


def single_spaces(c: Column) -> Column:
    """Whitespace runs become one space."""
    return let(c, lambda x: F.when(blanks_only(x) & ~F.contains(x, F.lit("  ")), x).otherwise(F.regexp_replace(x, "(?U)\\s+", " ")))


def squeeze(c: str | Column) -> Column:
    """Whitespace runs become one space, ends trimmed."""
    return F.trim(single_spaces(s(c)))


def null_if_blank(c: str | Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_filled(*cols: str | Column) -> Column:
    return F.coalesce(*[null_if_blank(c) for c in cols], F.lit(""))


def canon(c: str | Column) -> Column:
    return canon_lower(F.lower(s(c)))


def canon_lower(low: Column) -> Column:
    """canon of a text that is in lower case already."""
    # Blanks go first. What stays is collected: a search for what goes fails at every letter, which takes eight times as long.
    return let(F.replace(low, F.lit(" "), F.lit("")),
               lambda x: F.when(x.rlike(CANON_WORD), x).otherwise(F.array_join(F.regexp_extract_all(x, F.lit(CANON_KEEP), F.lit(0)), "")))


def empty_list() -> Column:
    return F.expr(EMPTY)


def lst(c: str | Column) -> Column:
    return F.coalesce(col(c), empty_list())


def lit_list(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else empty_list()


def lit_map(mapping: Mapping[str, object]) -> Column:
    parts = []
    for k, v in mapping.items():
        parts += [F.lit(k), F.lit(v)]
    return F.create_map(*parts)


def is_in(c: Column, values: Iterable[str]) -> Column:
    values = sorted(values)
    return c.isin(values) if values else F.lit(False)


def non_blank(arr: Column) -> Column:
    return F.filter(arr, lambda x: x != "")


def ordered_distinct(arr: Column, limit: int | None = None) -> Column:
    """Distinct non-blank elements in first-seen order."""
    out = F.array_distinct(F.filter(arr, lambda x: x.isNotNull() & (x != "")))
    return F.slice(out, 1, limit) if limit is not None else out


def first_made(arr: Column, make, limit: int, head: int = 48) -> Column:
    """The first `limit` elements of make(arr), for a `make` that reads from left to right: the head of a list is often enough."""
    # Two rounds, the head and then the whole list, with one copy of `make` in the plan.
    def found(a: Column) -> Column:
        enough = lambda some, n: (n > head) & ((F.size(some) >= limit) | (F.size(a) <= head))
        return F.aggregate(F.array(F.lit(head), F.lit(2**31 - 1)), empty_list(), lambda some, n: F.when(enough(some, n), some).otherwise(make(F.slice(a, F.lit(1), n))))

    return F.slice(let(arr, found), 1, limit)


def let(value: Column, body) -> Column:
    """Bind an expression once for use inside `body`; a lambda body would otherwise evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distinct_by_canon(arr: Column, limit: int | None = None, key=None) -> Column:
    """First element of every non-empty key, in order: sort by (key, position), keep group heads, restore order."""
    key = key or canon

    def heads(a: Column) -> Column:
        kept = F.filter(a, lambda x, i: (x["k"] != "") & ((i == 0) | (F.get(a, i - 1)["k"] != x["k"])))
        back = F.sort_array(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v"))))
        return F.transform(back, lambda x: x["v"])

    keyed = F.sort_array(F.transform(arr, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("v"))))
    out = let(keyed, heads)
    return F.slice(out, 1, limit) if limit is not None else out


def split_lines(c: str | Column) -> Column:
    return non_blank(F.transform(F.split(s(c), LINE_DELIMITERS), strip))


def split_tags(c: str | Column) -> Column:
    return F.array_distinct(non_blank(F.transform(F.split(s(c), LIST_DELIMITERS), strip)))


def split_terms(c: str | Column) -> Column:
    """Delimited list whose elements are distinct by canonical key."""
    return distinct_by_canon(F.transform(F.split(s(c), LIST_DELIMITERS), squeeze))


def family(patterns: Sequence[str], ignore_case: bool = True) -> str:
    """One alternation per pattern family; Unicode classes so that word borders see Hangul.

    When every pattern starts at the beginning, the anchor is written once, so a search gives up after one try.
    """
    flags = "(?iU)" if ignore_case else "(?U)"
    if patterns and all(p.startswith("^") and "|^" not in p for p in patterns):
        return flags + "^(?:" + "|".join(f"(?:{p[1:]})" for p in patterns) + ")"
    return flags + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def literal_alternatives(pattern: str) -> list[str] | None:
    """The words of a pattern that is nothing but `a|b|c`; None for a real regular expression."""
    body = pattern[1:-1] if pattern.startswith("(") and pattern.endswith(")") and pattern.count("(") == 1 else pattern
    parts = body.split("|")
    return parts if all(p and re.fullmatch("[0-9A-Za-z가-힣 /&·_-]+", p) for p in parts) else None


def matches(c: Column, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    """Does any pattern occur? Literal alternatives become substring tests, which are far cheaper than a regex scan."""
    words, rest = [], []
    for p in patterns:
        lits = literal_alternatives(p)
        if lits is None:
            rest.append(p)
        else:
            words += lits
    out = c.rlike(family(rest, ignore_case)) if rest else F.lit(False)
    if words:
        found = let(F.lower(c), lambda x: contains_any(x, [w.lower() for w in words])) if ignore_case else contains_any(c, words)
        out = found | out
    return out


def hit_count(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur in the text (each counted once)."""
    total = F.lit(0)
    for t in terms:
        total = total + F.when(F.contains(text, F.lit(t)), 1).otherwise(0)
    return total


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def overlaps(arr: Column, values: Iterable[str]) -> Column:
    return F.arrays_overlap(arr, lit_list(sorted(values)))


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def join_list(arr: str | Column, sep: str = "|") -> Column:
    return F.array_join(lst(arr), sep)


def epoch_seconds(c: str | Column) -> Column:
    """Seconds since 1970 of an ISO text, 0 when it does not parse; texts without an offset are UTC, whatever the session's zone."""
    x = strip(c)
    zoned = F.when(F.length(x) == 10, F.concat(x, F.lit("T00:00:00Z"))).when(x.rlike("(Z|[+-]\\d{2}:?\\d{2})$"), x).otherwise(F.concat(x, F.lit("Z")))
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.when(x != "", zoned))), F.lit(0))


def at(arr: Column, i: int = 1) -> Column:
    return F.get(arr, i - 1)
