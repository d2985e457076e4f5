"""Normalising projections: source rows to postings, taxonomy labels, enrichment, content signatures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.functions.rank import one_per_key
from hiremill.functions.text import (
    LIST_DELIMITERS, at, canon, col, compact, contains_any, empty_list, first_filled, is_in, lit_list, lit_map, lst,
    matches, non_blank, null_if_blank, ordered_distinct, s, split_lines, split_tags, strip,
)
from hiremill.rules import briefing as R

# Stands for a blank inside a protected phrase while a line is split on blanks.
GLUE = ""


def pick_fields(source: DataFrame, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """First non-blank of the known column names for every wanted field; unknown columns count as blank."""
    have = set(source.columns)
    out = [F.col("ord")] if "ord" in have else []
    for name, candidates in fields.items():
        known = [F.col(f"`{c}`") for c in candidates if c in have]
        out.append((first_filled(*known) if known else F.lit("")).alias(name))
    return source.select(*out)


def split_skills(value: str | Column, phrases: Sequence[str] = tuple(R.PROTECTED_PHRASES)) -> Column:
    """Delimited skills; a delimiter-free line of three or more tokens is split on blanks, phrases kept whole."""
    text = s(value)
    guarded = text
    for phrase in sorted(phrases, key=len, reverse=True):
        body = "\\Q" + phrase + "\\E"
        guarded = F.regexp_replace(guarded, f"(?iU)(?<!\\S){body}(?!\\S)", phrase.replace(" ", GLUE))
    parts = non_blank(F.transform(F.split(guarded, LIST_DELIMITERS), strip))
    words = non_blank(F.split(strip(guarded), "(?U)\\s+"))
    plain = ~text.rlike(LIST_DELIMITERS) & (F.size(words) >= 3)
    chosen = F.when(plain, words).otherwise(parts)
    return F.array_distinct(F.transform(chosen, lambda x: F.translate(x, GLUE, " ")))


def normalize_postings(source: DataFrame, fields: Mapping[str, Sequence[str]] = R.SOURCE_FIELDS,
                       phrases: Sequence[str] = tuple(R.PROTECTED_PHRASES)) -> DataFrame:
    """Source rows to the posting schema in a single projection."""
    picked = pick_fields(source, fields)

    def value(name: str) -> Column:
        c = F.col(name)
        return F.when(c == "", F.lit(R.FIELD_DEFAULTS[name])).otherwise(c) if name in R.FIELD_DEFAULTS else c

    plain = ["id", "company", "company_tier", "source", "title", "experience", "track", "focus", "role",
             "role_display", "group_summary", "detail_body", "record_state", "job_url", "source_url",
             "snapshot_date", "first_seen_at", "last_seen_at"]
    return picked.select(
        "ord", *[value(n).alias(n) for n in plain],
        split_tags("focus").alias("focus_axes"), split_tags("group_summary").alias("summary_tags"),
        is_in(F.lower("active_text"), R.TRUE_VALUES).alias("active"),
        split_lines("tasks_text").alias("tasks"), split_lines("requirements_text").alias("requirements"),
        split_lines("preferred_text").alias("preferred"), split_skills("skills_text", phrases).alias("skills"))


def alias_of(x: Column, table: Mapping[str, str]) -> Column:
    m = lit_map(table)
    return F.coalesce(F.try_element_at(m, F.lower(x)), F.try_element_at(m, x), x)


def normalize_skills(arr: str | Column, aliases: Mapping[str, str] = R.SKILL_ALIASES) -> Column:
    return ordered_distinct(F.transform(lst(arr), lambda x: alias_of(strip(x), aliases)))


def normalize_focus(c: str | Column, aliases: Mapping[str, str] = R.FOCUS_ALIASES) -> Column:
    tokens = F.transform(F.split(s(c), "[/,]+"), lambda x: F.regexp_replace(x, "(?U)\\s+", ""))
    labels = ordered_distinct(F.transform(non_blank(tokens), lambda x: alias_of(x, aliases)))
    return F.when(strip(c) == R.UNCLASSIFIED, empty_list()).otherwise(labels)


def normalize_track(c: str | Column, known: Sequence[str] = tuple(R.TRACKS)) -> Column:
    return F.filter(lit_list(known), lambda x: F.contains(s(c), x))


def experience_years(c: str | Column) -> Column:
    return F.regexp_extract(s(c), "(\\d+)\\s*년", 1).try_cast("bigint")


def normalize_experience(c: str | Column) -> tuple[Column, Column]:
    """(label, band): words win in their order, then years, then the bare mention of experience."""
    raw, years = strip(c), experience_years(c)
    label = F.when((raw == "") | (raw == R.EXPERIENCE_UNKNOWN), R.EXPERIENCE_UNKNOWN)
    band = F.when((raw == "") | (raw == R.EXPERIENCE_UNKNOWN), "unknown")
    for word, word_label, word_band in R.EXPERIENCE_WORDS:
        label = label.when(F.contains(raw, F.lit(word)), word_label)
        band = band.when(F.contains(raw, F.lit(word)), word_band)
    label = label.when(years.isNotNull(), F.concat(F.lit("경력 "), years.cast("string"), F.lit("년+")))
    band = (band.when(years <= 2, "junior").when(years <= 5, "mid").when(years <= 8, "senior")
            .when(years.isNotNull(), "lead"))
    mention = F.contains(raw, F.lit("경력"))
    return (label.when(mention, R.EXPERIENCE_NO_YEARS).otherwise(raw),
            band.when(mention, "mid").otherwise("unknown"))


def normalize_taxonomy(postings: DataFrame) -> DataFrame:
    label, band = normalize_experience("experience")
    return postings.withColumns({
        "normalized_skills": normalize_skills("skills"),
        "experience_label": label, "experience_band": band,
        "track_labels": normalize_track("track"), "focus_labels": normalize_focus("focus"),
        "first_seen_date": F.try_to_date(F.substring("first_seen_at", 1, 10)),
        "last_seen_date": F.try_to_date(F.substring("last_seen_at", 1, 10)),
    })


def apply_enrichment(postings: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Non-empty normalised values (`experience_label`, `track_labels`, `focus_labels`, `skills`) replace the originals."""
    e = one_per_key(enrichments).select(
        "id", F.col("experience_label").alias("_exp"), F.col("track_labels").alias("_track"),
        F.col("focus_labels").alias("_focus"), F.col("skills").alias("_skills"),
        F.col("applied_at").alias("ai_applied_at"), F.col("reviewer_note").alias("ai_reviewer_note"),
        F.lit(True).alias("_hit"))
    j = postings.join(e, "id", "left")
    filled = lambda c: F.size(F.coalesce(F.col(c), empty_list())) > 0
    return j.withColumns({
        "experience": F.coalesce(F.nullif(F.col("_exp"), F.lit("")), F.col("experience")),
        "track": F.when(filled("_track"), F.array_join("_track", " / ")).otherwise(F.col("track")),
        "focus": F.when(filled("_focus"), F.array_join("_focus", " / ")).otherwise(F.col("focus")),
        "skills": F.when(filled("_skills"), F.col("_skills")).otherwise(F.col("skills")),
        "ai_enriched": F.coalesce(F.col("_hit"), F.lit(False)),
        "ai_reviewer_note": F.coalesce(F.col("ai_reviewer_note"), F.lit("")),
    }).drop("_exp", "_track", "_focus", "_skills", "_hit")


# Field sets whose change makes a posting count as changed, or a stored decision as stale.
SYNC_FIELDS = ["active", "company", "detail_body", "group_summary", "job_url", "last_seen_at", "preferred",
               "requirements", "role", "role_display", "skills", "tasks", "title"]
DECISION_FIELDS = ["company", "detail_body", "experience", "job_url", "preferred", "requirements", "role",
                   "role_display", "skills", "source", "source_url", "tasks", "title", "track"]
INSIGHT_FIELDS = ["active", "company", "detail_body", "focus_label", "group_summary", "job_url", "keywords",
                  "preferred", "requirements", "role", "skills", "summary", "tasks", "title"]


def content_signature(df: DataFrame, cols: Sequence[str]) -> Column:
    """Stable content hash: columns in name order, missing values as the blank of their type."""
    types = dict(df.dtypes)
    parts = []
    for c in sorted(set(cols)):
        if c not in types:
            parts.append(F.lit("").alias(c))
        elif types[c].startswith("array"):
            parts.append(F.coalesce(F.col(c), F.expr(f"cast(array() as {types[c]})")).alias(c))
        elif types[c] == "boolean":
            parts.append(F.coalesce(F.col(c), F.lit(False)).alias(c))
        else:
            parts.append(s(c).alias(c))
    return F.sha1(F.to_json(F.struct(*parts)))


def overlay_candidate_results(rows: DataFrame, results: DataFrame, label_cols: Sequence[str], key: str = "id") -> DataFrame:
    """Label columns come from the new result; rows without one are left out."""
    kept = [c for c in rows.columns if c not in label_cols]
    return rows.select(*kept).join(results.select(key, *label_cols), key).select(*rows.columns)
