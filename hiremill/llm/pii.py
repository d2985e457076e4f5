"""Personal data: regular expressions, gazetteers and context vote on spans; expectation-maximisation weighs the voters and a linear
span classifier learns their posterior. DataFrame functions only.

The base spans (email, ip, card, phone) are fixed by their patterns and always stay. Wider patterns propose more spans of the same kinds
(written-out addresses, IPv6, shorter or dotted card numbers, national phone numbers). Labellers vote on every span; Spark counts the
combinations of kind, votes and shape, of which there is a fixed number, and the models are fitted on those counts. The classifier is a
sum of table look-ups, so that it is applied in the row that holds the text; no text and no span is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns. Possessive forms and the look-behind find the same matches as the plain ones in linear time and
#: without recursion: a match can begin inside a run of its first class only where the previous match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE_PATTERNS = [
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
WIDE_PATTERNS = [
    rf"(?i)(?<!{_LOCAL}){_LOCAL}++\x20?(?:\(at\)|\[at\])\x20?[a-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[a-z0-9-]++)++",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9.-])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9.-])",
    r"(?<![0-9+(.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
]
#: Words of the gazetteers: those that announce a kind, and those that announce something else.
NEAR_WORDS = ["e-?mail|mail|contact|write|correo|courriel", "ip|host|server|client|login|addr", "card|visa|master|amex|credit|karte|carte|tarjeta", "tel|phone|fax|call|mobile|cell|handy|fono"]
OTHER_WORDS = "version|release|chapter|section|isbn|issn|order|invoice|article|build|sha|md5|token|key"
DOMAIN_ENDS = "(?i)[.\\x20)\\]](?:com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu|us)$"
#: Code points of a span's context, spans of a run, code points of a piece.
CONTEXT, RUN, PIECE = 24, 64, 1024
LABELLERS = ["pattern", "structure", "gazetteer", "other_words", "joined", "variety"]
_SHAPES = 4

Span = "struct<start:int,end:int,value:string,before:string,after:string>"


def _let(value: Column, body) -> Column:
    """Evaluates a value once inside an expression."""
    return F.transform(F.array(value), body)[0]


def _spans(pieces: Column, matches: Column) -> Column:
    """Start, end (code points) and surroundings of the matches, from the pieces between them.

    Matches are placed in runs of RUN, whose first positions are summed beforehand, so that thousands of matches take linear time.
    """
    empty = F.expr(f"CAST(array() AS array<{Span}>)")
    runs = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int"))

    def indexes(run: Column) -> Column:
        return F.sequence(run * RUN, F.least(F.size(matches), run * RUN + RUN) - 1)

    def length(run: Column) -> Column:
        return F.aggregate(indexes(run), F.lit(0), lambda acc, i: acc + F.length(pieces[i]) + F.length(matches[i]))

    offsets = F.aggregate(runs, F.array(F.lit(0)), lambda acc, run: F.concat(acc, F.array(acc[F.size(acc) - 1] + length(run))))

    def step(acc: Column, i: Column) -> Column:
        piece, value = pieces[i], matches[i]
        return _let(acc["pos"] + F.length(piece), lambda start: F.struct(
            (start + F.length(value)).alias("pos"),
            F.concat(acc["out"], F.array(F.struct(
                start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
                F.right(piece, F.lit(CONTEXT)).alias("before"), F.left(pieces[i + 1], F.lit(1)).alias("after")))).alias("out")))

    def placed(run: Column, begin: Column) -> Column:
        return F.aggregate(indexes(run), F.struct(begin.alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])

    found = _let(offsets, lambda o: F.flatten(F.transform(runs, lambda run: placed(run, o[run]))))
    return F.when(F.size(matches) > 0, found).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    return F.call_function("luhn_check", _digits(value))


def _parts_ok(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


def _base_ok(kind: int, value: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return _parts_ok(value)
    n = F.length(_digits(value))
    return n.between(16, 19) & _luhn(value) if kind == 2 else n.between(8, 15)


def _kept(spans: str, kind: int) -> Column:
    return F.filter(spans, lambda s: _base_ok(kind, s["value"]))


def _base_count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def _votes(kind: int, base: bool, s: Column) -> list[Column]:
    """Votes of the labellers on a span: 1 for, -1 against, 0 none."""
    value, before = s["value"], s["before"]
    digits = _digits(value)
    if kind == 0:
        structure = F.when(value.rlike(DOMAIN_ENDS), 1).otherwise(-1)
    elif kind == 1:
        structure = F.when(_parts_ok(value), 1).otherwise(-1) if base else F.lit(1)
    elif kind == 2:
        structure = F.when(_luhn(value), 1).otherwise(-1)
    else:
        structure = F.when(F.length(digits).between(10, 13), 1).otherwise(0)
    return [
        F.lit(1 if base else 0), structure,
        F.when(before.rlike(f"(?i)(?:{NEAR_WORDS[kind]})"), 1).otherwise(0),
        F.when(before.rlike(f"(?i)(?:{OTHER_WORDS})\\W*$"), -1).otherwise(0),
        F.when(before.rlike(r"[\p{L}\p{N}_]$") | s["after"].rlike(r"^[\p{L}\p{N}_]"), -1).otherwise(1),
        F.when(digits.rlike(r"^([0-9])\1*$") if kind else value.rlike("(?i)no-?reply"), -1).otherwise(0),
    ]


def _shape(s: Column) -> Column:
    """Length class of a span."""
    n = F.length(s["value"])
    return F.when(n <= 10, 0).when(n <= 16, 1).when(n <= 24, 2).otherwise(3)


def candidates(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: array of (kind, start, end, base, code), where code holds votes and shape in a mixed base.

    Wide spans that overlap a base span of any kind or an earlier wide pattern's span are no candidates.
    """
    body, digit = F.coalesce(F.col(text), F.lit("")), "__digit"
    step = docs.withColumn("__body", body).withColumn(digit, F.col("__body").rlike("[0-9]"))
    b = F.col("__body")
    guards = [b.contains("@"), F.col(digit), F.col(digit), b.contains("+") & F.col(digit),
              b.contains("(at)") | b.contains("[at]") | b.contains("(AT)") | b.contains("[AT]"), b.contains(":") & F.col(digit), F.col(digit), F.col(digit)]
    none = F.expr("CAST(array() AS array<string>)")
    patterns = [*BASE_PATTERNS, *WIDE_PATTERNS]
    step = step.withColumns({f"__m{i}": F.when(g, F.regexp_extract_all("__body", F.lit(p), F.lit(0))).otherwise(none) for i, (g, p) in enumerate(zip(guards, patterns))})
    step = step.withColumns({f"__p{i}": F.when(F.size(f"__m{i}") > 0, F.split("__body", p, -1)).otherwise(none) for i, p in enumerate(patterns)})
    step = step.withColumns({f"__s{i}": _spans(F.col(f"__p{i}"), F.col(f"__m{i}")) for i in range(len(patterns))})

    def typed(kind: int, base: bool, spans: Column) -> Column:
        def one(s: Column) -> Column:
            code = reduce(lambda acc, v: acc * 3 + (v + 1), _votes(kind, base, s), F.lit(0)) * _SHAPES + _shape(s)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), code.cast("int").alias("code"))

        return F.transform(spans, one)

    step = step.withColumns({f"__b{k}": _kept(f"__s{k}", k) for k in range(4)})
    step = step.withColumn("__base", F.concat(*(typed(k, True, F.col(f"__b{k}")) for k in range(4))))
    taken = F.col("__base")
    wide = []
    for k in range(4):
        free = F.filter(f"__s{k + 4}", lambda s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))
        valid = F.filter(free, lambda s: _luhn(s["value"])) if k == 2 else free
        wide.append(typed(k, False, valid))
    step = step.withColumn(out, F.concat("__base", *wide))
    return step.drop("__body", digit, "__base", *(f"__{x}{i}" for x in "mps" for i in range(8)), *(f"__b{k}" for k in range(4)))


@dataclass
class SpanModel:
    """Reliabilities of the labellers, and the classifier's weights: kind, votes (3 per labeller) and shape."""

    reliability: dict[str, float]
    bias: list[float]
    vote_weights: list[list[float]]
    shape_weights: list[float]

    def score(self, kind: Column, code: Column) -> Column:
        total = F.element_at(F.array(*map(F.lit, self.bias)), kind + 1) + F.element_at(F.array(*map(F.lit, self.shape_weights)), F.pmod(code, F.lit(_SHAPES)) + 1)
        n = len(LABELLERS)
        for j, weights in enumerate(self.vote_weights):
            digit = F.pmod(F.floor(code / (_SHAPES * 3 ** (n - 1 - j))), F.lit(3)).cast("int")
            total = total + F.element_at(F.array(*map(F.lit, weights)), digit + 1)
        return total


def _decode(code: int) -> tuple[list[int], int]:
    shape, rest, votes = code % _SHAPES, code // _SHAPES, []
    for _ in LABELLERS:
        votes.append(rest % 3)
        rest //= 3
    return votes[::-1], shape


def fit_counts(rows: list[tuple[int, int, int]], rounds: int = 100, steps: int = 200) -> SpanModel:
    """Models from (kind, code, n): expectation-maximisation over votes with one share per kind, then logistic regression on the posteriors.

    The share of true spans starts at a half, a vote starts out right three times of four, and every estimate has a pseudo-count, so that
    few or no spans give the starting model.
    """
    n = len(LABELLERS)
    share = [0.5] * 4
    good = [[0.1, 0.4, 0.5] for _ in range(n)]
    bad = [[0.5, 0.4, 0.1] for _ in range(n)]
    decoded = [(kind, *_decode(code), count) for kind, code, count in rows]

    def posterior(kind: int, votes: list[int]) -> float:
        odds = math.log(share[kind] / (1 - share[kind])) + sum(math.log(good[j][v] / bad[j][v]) for j, v in enumerate(votes))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))

    for _ in range(rounds):
        g = [[1.0, 4.0, 5.0] for _ in range(n)]
        b = [[5.0, 4.0, 1.0] for _ in range(n)]
        hits = [[1.0, 1.0] for _ in range(4)]
        for kind, votes, _, count in decoded:
            p = posterior(kind, votes)
            hits[kind][0] += count * p
            hits[kind][1] += count * (1 - p)
            for j, v in enumerate(votes):
                g[j][v] += count * p
                b[j][v] += count * (1 - p)
        share = [h[0] / sum(h) for h in hits]
        good = [[x / sum(row) for x in row] for row in g]
        bad = [[x / sum(row) for x in row] for row in b]
    bias, weights, shapes = [0.0] * 4, [[0.0] * 3 for _ in range(n)], [0.0] * _SHAPES
    total = sum(r[-1] for r in decoded) or 1
    labelled = [(kind, votes, shape, count / total, posterior(kind, votes)) for kind, votes, shape, count in decoded]
    for _ in range(steps):
        gb, gw, gs = [0.0] * 4, [[0.0] * 3 for _ in range(n)], [0.0] * _SHAPES
        for kind, votes, shape, weight, label in labelled:
            z = bias[kind] + shapes[shape] + sum(weights[j][v] for j, v in enumerate(votes))
            off = weight * (1 / (1 + math.exp(-max(-60.0, min(60.0, z)))) - label)
            gb[kind] += off
            gs[shape] += off
            for j, v in enumerate(votes):
                gw[j][v] += off
        bias = [x - 2 * d for x, d in zip(bias, gb)]
        shapes = [x - 2 * d for x, d in zip(shapes, gs)]
        weights = [[x - 2 * d for x, d in zip(row, drow)] for row, drow in zip(weights, gw)]
    right = {name: (good[j][2] + bad[j][0]) / (good[j][2] + bad[j][0] + good[j][0] + bad[j][2]) for j, name in enumerate(LABELLERS)}
    return SpanModel(right, bias, weights, shapes)


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """Counts the combinations of kind, votes and shape over all documents and fits the models on them.

    The outer form of explode keeps Spark from testing the size of the array in a filter of its own, which would copy the whole
    expression into it.
    """
    spans = candidates(docs.select(text), text, "__found").select(F.explode_outer("__found").alias("s")).where(F.col("s").isNotNull())
    counted = spans.groupBy(F.col("s.kind").alias("kind"), F.col("s.code").alias("code")).agg(F.count("*").alias("n")).orderBy("kind", "code")
    return fit_counts([(r["kind"], r["code"], r["n"]) for r in counted.collect()])


def _accepted(model: SpanModel, found: str) -> Column:
    return F.filter(found, lambda s: s["base"] | (model.score(s["kind"], s["code"]) >= 0))


def _listed(spans: Column) -> Column:
    """kind:start:end of spans, by kind and start, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): base counts and digest, and all spans, of every document.

    Null and empty texts have no spans. Positions are code points, the end exclusive. Repeated rows give equal rows; other columns are
    not read; an empty table gives an empty result.
    """
    model = fit(docs, text)
    found = candidates(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__text", "__found").drop("__text")
    found = found.withColumn("__all", _accepted(model, "__found"))
    base = F.filter("__all", lambda s: s["base"])
    counts = [_base_count("__all", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        F.col("__key").alias(key), *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("__all")).alias("spans"),
        F.size(F.filter("__all", lambda s: ~s["base"])).cast("long").alias("n_added"))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in brackets, such as [EMAIL]; overlapping spans become one.

    Columns, their order and the number of rows stay; `length`, where the table has it, becomes the new text's code points for changed
    texts. Texts without spans, null among them, stay as they are. Columns may have any names.
    """
    model = fit(docs, text)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    # The whole row is one column, so that no name of the table meets a working name.
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{text}`").alias("__text"))
    found = candidates(given, "__text", "__found").withColumn("__all", F.array_sort(F.transform(
        _accepted(model, "__found"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    body, changed = F.col("__text"), F.size("__all") > 0
    # Texts with spans are cut into pieces of PIECE code points once; a gap is taken from the pieces it touches.
    found = found.withColumn("__cut", F.when(changed, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def gap(begin: Column, end: Column) -> Column:
        first = F.floor(begin / PIECE).cast("int")
        near = F.array_join(F.slice("__cut", first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
        return F.when(end > begin, F.substring(near, begin - first * PIECE + 1, end - begin)).otherwise(F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        part = F.when(fresh, F.concat(gap(acc["pos"], s["start"]), F.element_at(names, s["kind"] + 1))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], F.array(part)).alias("out"))

    parts = F.aggregate("__all", F.struct(F.lit(0).alias("pos"), F.expr("CAST(array() AS array<string>)").alias("out")), step,
                        lambda acc: F.concat(F.array_join(acc["out"], ""), gap(acc["pos"], F.length(body))))
    out = found.withColumn("__new", F.when(changed, parts).otherwise(body))
    columns = []
    for c in docs.columns:
        own = F.col("__row").getField(c)
        if c == text:
            columns.append(F.col("__new").alias(text))
        elif length and c == length:
            columns.append(F.when(changed, F.length("__new")).otherwise(own).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(own.alias(c))
    return out.select(*columns)
