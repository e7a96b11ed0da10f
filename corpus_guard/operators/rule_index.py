"""C1 for many rules: an inverted index from literals to rules, and lines that find their rules by equality of grams.

Every match of most patterns holds one of a few literals (``required``); keywords and keys of mappings are literals
themselves. Literals are rows (ord, literal), indexed by a gram (``substrings``). A line meets only the rules of which it
holds a literal, and only their patterns are tried; the cost grows with the lines and with such meetings, not with the
number of rules. Rules without a literal (sets of code points, patterns such as ``\\d+``) are tried on all lines, as a narrow projection.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_guard.functions.scalars import nfkc_lower
from corpus_guard.operators.rules import Rule, gate, required, rule_matches
from corpus_guard.operators.substrings import join_substrings

#: Rules from which on a scan uses the index.
INDEXED_FROM = 200
#: A literal shorter than this is in too many lines to be worth an entry.
SHORTEST = 3
_SCHEMA = "ord int, literal string, nth int, kind string, pattern string, unless string, exts array<string>"


def literals(rule: Rule) -> tuple[str, ...]:
    """Lower-cased literals of which every line that the rule matches holds one; empty when there are none."""
    if rule.kind == "regex":
        found = required(rule.pattern)
    elif rule.kind == "keyword":
        found = tuple(dict.fromkeys(unicodedata.normalize("NFKC", v).lower() for v in rule.values))
    elif rule.kind == "mapping":
        found = tuple(dict.fromkeys(v for v in rule.values))
    else:
        found = ()
    return found if found and all(len(x) >= SHORTEST for x in found) else ()


def index_rows(spark: SparkSession, rules) -> tuple[DataFrame, list[tuple[int, Rule]]]:
    """The index (one row for each literal of a rule), and the rules that it cannot hold."""
    rows, rest = [], []
    for i, r in enumerate(rules):
        found = literals(r)
        if not found:
            rest.append((i, r))
        for nth, x in enumerate(found):
            rows.append((i, x, nth, r.kind, r.pattern, r.unless, list(r.ext)))
    return spark.createDataFrame(rows, _SCHEMA), rest


def indexed_hits(lines: DataFrame, rules) -> DataFrame:
    """``lines`` once for each rule that matches, with its number ``ord``."""
    index, rest = index_rows(lines.sparkSession, rules)
    columns, text = lines.columns, F.col("text")
    # a text is what a rule's kind reads: as it is for mappings, lower-cased for patterns, normalised for keywords
    forms = {"regex": F.lower("text"), "keyword": nfkc_lower("text"), "mapping": text}
    out = None
    for kind, form in forms.items():
        if not any(r.kind == kind and literals(r) for r in rules):
            continue
        mine = index.where(F.col("kind") == kind).drop("kind")
        met = join_substrings(lines.withColumn("_form", form), "_form", mine, "literal", sizes=tuple(sorted({6 if len(x) >= 6 else 3 for r in rules if r.kind == kind for x in literals(r)})))
        met = met.where((F.size("exts") == 0) | F.array_contains("exts", F.col("ext")))
        hit = F.expr("unless is null or not text rlike unless")
        if kind == "regex":
            hit = F.expr("text rlike pattern") & hit
        found = met.where(hit)
        many = [i for i, r in enumerate(rules) if r.kind == kind and len(literals(r)) > 1]
        if many:
            # a line that holds several literals of a rule counts once, for the first of them
            every = lines.sparkSession.createDataFrame([(i, list(literals(rules[i]))) for i in many], "ord int, literals array<string>")
            found = found.join(F.broadcast(every), "ord", "left")
            first = F.get(F.filter(F.coalesce("literals", F.array("literal")), lambda x: F.contains(F.col("_form"), x)), F.lit(0))
            found = found.where(F.col("literal") == first)
        found = found.select(*columns, "ord")
        out = found if out is None else out.unionByName(found)
    if rest:
        hits = F.filter(F.array(*[F.when(gate(r) & rule_matches(text, r), F.lit(i)) for i, r in rest]), lambda x: x.isNotNull())
        found = lines.withColumn("ord", F.explode(hits)).select(*columns, "ord")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else lines.withColumn("ord", F.lit(0)).limit(0)
