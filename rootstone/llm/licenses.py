"""License scans: ordered signature rules, gated by keywords, with suppression of detections inside better ones.

All of it is DataFrame expressions, and every pattern is a literal that is compiled once. A text passes the literal of a group of rules, then each
rule's own keyword, then the rule. A detection is suppressed if another one's interval contains its own and that one has a higher priority, or
the same and is longer, or is of the same interval and an earlier rule. Places and suppression of n matches take n * sqrt(n) steps, so texts of any
length end: sums and maxima of blocks of sqrt(n) matches stand for the blocks before a match.

Semantics. Texts are whole and lower-cased in A-Z. Words are runs of digits, letters a-z and non-ASCII characters. Base places are
where a phrase's words stand consecutively. Null and empty texts: 0 words, no labels, score 0. Rows that repeat an id are
scanned each by itself; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .license_rules import GATES, PRIORITIES, rules, stem

WORDS, BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_CONFIDENCE = 0.4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(words: Column) -> Column:
    """Per phrase and place: its label and the number of its first word."""

    def of(phrase: str, label: str) -> Column:
        parts = phrase.split()
        at = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + j) == w for j, w in enumerate(parts)])
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(words)), at), lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))

    return F.concat(*[of(p, label) for p, label in PHRASES.items()])


def _quoted(raw: str) -> str:
    return "'" + raw.replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(maxsize=1)
def _hits_sql() -> str:
    """Of a column low, the rules that match, with the texts of and between their matches."""
    groups: dict[str, list[str]] = {}
    for i, r in enumerate(rules()):
        pattern = _quoted(r.pattern)
        found = f"named_struct('rule', {i}, 'between', split(low, {pattern}, -1), 'matches', regexp_extract_all(low, {pattern}, 0))"
        groups.setdefault(stem(r.keyword), []).append(f"IF(contains(low, {_quoted(r.keyword)}) AND rlike(low, {pattern}), {found}, NULL)")
    gate = lambda s: f"rlike(low, {_quoted(GATES[s])})" if s in GATES else f"contains(low, {_quoted(s)})"
    parts = [f"IF({gate(s)}, filter(array({', '.join(own)}), x -> x IS NOT NULL), NULL)" for s, own in groups.items()]
    return f"flatten(filter(array({', '.join(parts)}), x -> x IS NOT NULL))"


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda n, x: n + x)


def _block(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("int")


def _by_block(items: Column, c: Column, of: Callable[[Column], Column]) -> Column:
    """of every block of c items."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / c).cast("int"))), lambda b: of(F.slice(items, b * c + 1, c)))


def _before(items: Column, blocks: Column, i: Column, c: Column) -> tuple[Column, Column]:
    """The blocks before item i, and the items of its own block before it."""
    whole = F.floor(i / c).cast("int")
    return F.slice(blocks, F.lit(1), whole), F.slice(items, whole * c + 1, i - whole * c)


def _spans(hit: Column, labels: Column, priorities: Column) -> Column:
    """All places of a rule: the lengths of what lies between and of the matches add up to the starts."""
    between, matches, rule = hit["between"], hit["matches"], hit["rule"]
    c = _block(F.size(matches))

    def of(steps: Column, blocks: Column) -> Column:
        def one(match: Column, i: Column) -> Column:
            whole, own = _before(steps, blocks, i, c)
            start = _total(whole) + _total(own) + F.length(F.get(between, i))
            return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), F.get(labels, rule).alias("label"), F.get(priorities, rule).alias("priority"), rule.alias("rule"))

        return F.transform(matches, one)

    steps = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(between, i)))
    return _let(steps, lambda s: _let(_by_block(s, c, _total), lambda b: of(s, b)))


def _kept(spans: Column) -> Column:
    """Detections that no better one contains. By start, then longest, then of the highest priority, then earliest rule, the better of two that contain
    each other comes first: so one goes if one before it ends no earlier and has no lower priority."""
    placed = F.transform(spans, lambda d: F.struct(d["start"], -d["end"], -d["priority"], d["rule"], d["end"], d["label"], d["priority"]))
    levels = F.array(*[F.lit(p) for p in PRIORITIES])

    def highest(block: Column) -> Column:
        """By priority, the last end of detections of no lower one."""
        return F.transform(levels, lambda p: F.coalesce(F.array_max(F.transform(F.filter(block, lambda e: e["priority"] >= p), lambda e: e["end"])), F.lit(-1)))

    def of(items: Column, blocks: Column, c: Column) -> Column:
        def stays(d: Column, i: Column) -> Column:
            whole, own = _before(items, blocks, i, c)
            level = F.array_position(levels, d["priority"]).cast("int")
            return ~F.exists(whole, lambda t: F.element_at(t, level) >= d["end"]) & ~F.exists(own, lambda e: (e["end"] >= d["end"]) & (e["priority"] >= d["priority"]))

        return F.transform(F.filter(items, stays), lambda d: F.struct(d["start"], d["end"], d["label"], d["priority"], d["rule"]))

    return _let(F.array_sort(placed), lambda s: _let(_by_block(s, _block(F.size(s)), highest), lambda b: of(s, b, _block(F.size(s)))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, places (label, start), detections (start, end, label, priority, rule) that stay, labels and score."""
    low = docs.select(docs[id_col].alias("id"), ascii_lower(F.coalesce(docs[text_col], F.lit(""))).alias("low"))
    base = F.col("low").contains("license") | F.col("low").rlike(f"cc{BETWEEN}by")
    no_places = F.array().cast("array<struct<label:string,start:bigint>>")
    no_spans = F.array().cast("array<struct<start:int,end:int,label:string,priority:int,rule:int>>")
    of_rules = [F.array(*[F.lit(x) for x in column]) for column in zip(*[(r.label, r.priority) for r in rules()], strict=True)]
    low = low.select("*", F.expr(_hits_sql()).alias("hits"))
    spans = F.flatten(F.transform("hits", lambda h: _spans(h, *of_rules)))
    found = low.select(
        "id",
        F.regexp_count("low", F.lit(WORDS)).cast("long").alias("n_words"),
        F.when(base, _let(F.regexp_extract_all("low", F.lit(WORDS), F.lit(0)), _places)).otherwise(no_places).alias("places"),
        F.when(F.size("hits") > 0, _kept(spans)).otherwise(no_spans).alias("detections"),
    )
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]), F.transform("detections", lambda d: d["label"]))))
    sure = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])) / F.lit(100.0), F.lit(0.0))
    score = F.greatest(sure, F.when(F.size("places") > 0, F.lit(BASE_CONFIDENCE)).otherwise(0.0))
    return found.select(F.col("id").alias(id_col), "n_words", "places", "detections", labels.alias("labels"), score.alias("score"))
