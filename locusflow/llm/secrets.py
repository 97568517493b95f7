"""Operator 2, secret scans: an inverted index of trigrams picks the documents that each rule can match.

From each rule's regular expression follows a Boolean query over lower-case trigrams that any match
must hold. Postings (trigram, document) are built for the queries' trigrams alone, intersected per
document, and only the candidates of a rule are verified by its expression. A rule without a
mandatory trigram scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty, without

#: Up to so many candidate ids are sent to every task (some 16 MB); more are joined by shuffle.
BROADCAST_CANDIDATES = 500_000
#: Strings that a part of an expression may stand for before it counts as open.
ENUMERATED = 64


@dataclass(frozen=True)
class Rule:
    """``kind`` names the rule; of its matches, those whose ``group`` has ``least`` characters count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: A run of 32 is asked for in the third expression itself: a run is matched whole, so shorter ones would be dropped anyway.
RULES = (
    Rule("assign", "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", "[0-9a-f]{32,}", 0, 32, True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def _strings(node: tuple) -> set[str] | None:
    """The lower-case strings that a parsed node can stand for, or None if there are too many."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        out: set[str] = set()
        for kind, value in arg:
            if str(kind) != "LITERAL":
                return None
            out.add(chr(value).lower())
        return out
    if op == "SUBPATTERN":
        return _joined(list(arg[-1]))
    if op == "BRANCH":
        parts = [_joined(list(x)) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op == "MAX_REPEAT" and arg[:2] == (0, 1):
        inner = _joined(list(arg[2]))
        return None if inner is None else inner | {""}
    return None


def _joined(nodes: list) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > ENUMERATED:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """A conjunction of disjunctions of trigram sets: a match needs, of each member, one set whole. Empty: anything may match.

    Adjacent parts that stand for few strings are spelled out together; where an open part ends
    such a run of at least three characters throughout, the run's trigrams become a member.
    """
    query, run = [], {""}

    def flush() -> None:
        if min(map(len, run)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            query.append(frozenset(s for s in sets if not any(t < s for t in sets)))
        run.clear()
        run.add("")

    for node in re._parser.parse(pattern):
        more = _strings(node)
        if more is not None and len(run) * len(more) <= ENUMERATED:
            spelled = {a + b for a, b in product(run, more)}
            run.clear()
            run.update(spelled)
            continue
        flush()
        if more is not None:
            run.clear()
            run.update(more)
    flush()
    return query


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, document) for each of ``trigrams`` that a text holds, whatever its case."""
    lowered = docs.select(F.col(id_col).alias("doc"), F.lower(text_or_empty(text_col)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    return lowered.select("doc", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[frozenset[str]]]]) -> DataFrame:
    """(doc, rules): documents whose postings satisfy some query, with the names of those that they satisfy."""
    held = index.groupBy("doc").agg(F.collect_set("trigram").alias("held"))

    def met(query: list[frozenset[frozenset[str]]]) -> Column:
        out = F.lit(True)
        for member in query:
            some = F.lit(False)
            for needed in sorted(map(sorted, member)):
                some = some | (F.size(F.array_intersect("held", F.array(*map(F.lit, needed)))) == len(needed))
            out = out & some
        return out

    rules = F.array_compact(F.array(*[F.when(met(q), F.lit(k)) for k, q in queries.items()]))
    return held.select("doc", rules.alias("rules")).filter(F.size("rules") > 0)


def spans(text: Column, rule: Rule, number: int) -> Column:
    """(start, number, end, kind) of the rule's matches, leftmost and non-overlapping, in code points.

    A match starts after all text between earlier matches and those matches, whose lengths add up.
    """
    between = F.split(text, rule.pattern, -1)
    whole, group = (F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(n)) for n in (1, rule.group + 1))
    steps = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("m"), group.alias("g"))
    empty = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")

    def step(at: Column, x: Column) -> Column:
        start = at["end"] + F.length(x["b"])
        end = start + F.length(x["m"])
        found = F.array(F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("end"), F.when(F.length(x["g"]) >= rule.least, F.concat(at["out"], found)).otherwise(at["out"]).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("end"), empty.alias("out")), step)["out"]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of (start, number, end, kind) by start, then by the rules' order.

    A null text is empty and has none. Rows that share an id, or have none, share their candidate
    rules, of which each row is then verified on its own text; so every row is kept once. An empty
    table gives no rows. A column of ``docs`` named ``secrets`` gives way.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    trigrams = sorted({t for q in indexed.values() for member in q for needed in member for t in needed})
    docs = without(docs, "secrets", "_rules", "_doc")
    found = checkpointed(candidates(postings(docs, trigrams, id_col, text_col), indexed)) if indexed else None
    if found is None:
        joined = docs.withColumn("_rules", F.array().cast("array<string>"))
    else:
        found = found.select(F.col("doc").alias("_doc"), F.col("rules").alias("_rules"))
        found = F.broadcast(found) if found.count() <= BROADCAST_CANDIDATES else found
        joined = docs.join(found, F.col(id_col).eqNullSafe(F.col("_doc")), "left")
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    text = text_or_empty(text_col)
    each = [F.when(F.array_contains("_rules", r.kind), spans(text, r, i)).otherwise(none) if queries[r.kind] else F.when(text.rlike(r.pattern), spans(text, r, i)).otherwise(none) for i, r in enumerate(rules)]
    return joined.withColumn("secrets", F.array_sort(F.concat(*each))).drop("_rules", "_doc")
