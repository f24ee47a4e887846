"""Licence scans by ordered signature rules, in DataFrame operations only.

A text's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; words count from 0.  The rules
(see license_rules) are regular expressions over the words.

1. Each text is reduced to its words, each between two blanks of its own, so that matches next to each other share
   no blank and only whole words match.
2. Keyword prefilter: a rule runs only on texts that hold one of its gate words.
3. What lies between a rule's matches is split off, and the words of these pieces, summed up, give the places.
   Only narrow rows (place, length, rule) of texts with matches are shuffled; texts never are.
4. Priority and containment: a detection inside another's interval goes if the other's priority is higher, or
   as high and its interval longer (or the same, and its rule earlier).  One running maximum per priority over
   the detections of a text, by start, decides this.  Detections of the base phrases always stay, and suppress as the
   rules of lowest priority they are.

A text's score is how sure its surest detection is.  Null and empty texts have no words and no detections, and
score 0.  Repeated rows are rows each; doc_id may be null or repeated; extra columns are ignored; an empty table
gives an empty result.  A text of any length is scanned whole.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.license_rules import BASE, RULES, SURE, Rule, over_words

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def spaced_words(text: Column) -> Column:
    """The words, each with a blank before and after; empty without words."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    # lower() folds other letters too, so it is right for pure ASCII only; there it is far cheaper.
    folded = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    inner = F.trim(F.regexp_replace(folded, SEPARATORS, "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _count(piece: Column) -> Column:
    """Words in a piece of spaced words: two blanks each."""
    return F.floor((F.length(piece) - F.length(F.replace(piece, F.lit(" ")))) / 2)


def detections(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(_rid, doc_id, n_words, rule, start, length, kept): one row a match, kept or suppressed; a text without has one of nulls."""
    gates: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        for word in rule.gates:
            gates.setdefault(word, []).append(k)
    patterns = _table([over_words(r.pattern) for r in rules], "array<string>")
    priorities = _table([r.priority for r in rules], "array<int>")
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(spaced_words(F.col("text")))).alias("words"))
    found = F.array_intersect(F.split("words", " +"), F.array(*[F.lit(g) for g in gates]))
    # array_position counts from 1.
    wanted = F.transform(found, lambda g: F.get(_table(list(gates.values()), "array<array<int>>"), (F.array_position(F.array(*[F.lit(g) for g in gates]), g) - 1).cast("int")))
    runs = rows.select("*", _count(F.col("words")).alias("n_words"), F.array_distinct(F.flatten(wanted)).alias("rules"))
    each = runs.select("_rid", "doc_id", "n_words", "words", F.explode_outer("rules").alias("rule"))
    matched = each.select("*", F.explode_outer(F.array(F.regexp_extract_all("words", F.get(patterns, "rule"), F.lit(0)))).alias("texts"))
    between = F.when(F.size("texts") > 0, F.split("words", F.get(patterns, "rule")))
    sizes = matched.select("_rid", "doc_id", "n_words", "rule", F.transform("texts", _count).alias("long"), F.transform(between, _count).alias("gap"))
    pieces = F.when(F.size("long") > 0, F.arrays_zip("gap", "long"))
    flat = sizes.select("_rid", "doc_id", "n_words", "rule", F.posexplode_outer(pieces).alias("i", "p")).select("*", "p.gap", "p.long").where("long IS NOT NULL OR i IS NULL")
    upto = Window.partitionBy("_rid", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(F.col("long").isNotNull(), F.coalesce(F.sum(F.col("gap") + F.col("long")).over(upto), F.lit(0)) + F.col("gap"))
    placed = flat.repartition("_rid").select("_rid", "doc_id", "n_words", F.when(F.col("long").isNotNull(), F.col("rule")).alias("rule"), start.alias("start"), F.col("long").alias("length"))
    ranked = placed.withColumns({"_end": F.col("start") + F.col("length"), "_priority": F.get(priorities, "rule")})
    before = Window.partitionBy("_rid").orderBy("start", F.desc("_end"), "_priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in rules})
    # The farthest end of an earlier start, per priority; a detection is contained if one at least as high reaches its end.
    reach = {f"_reach{p}": F.max(F.when(F.col("_priority") == p, F.col("_end"))).over(before) for p in levels}
    contained = F.lit(False)
    for p in levels:
        contained = contained | ((F.col("_priority") >= p) & F.coalesce(F.col(f"_reach{p}") >= F.col("_end"), F.lit(False)))
    out = ranked.withColumns(reach).withColumn("kept", F.when(F.col("rule").isNotNull(), (F.col("_priority") == BASE) | ~contained))
    return out.select("_rid", "doc_id", "n_words", "rule", "start", "length", "kept")


def license_scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of (doc_id, text)."""
    label = F.get(_table([r.label for r in rules], "array<string>"), "rule")
    sure = F.get(_table([SURE[r.priority] for r in rules], "array<double>"), "rule")
    base = F.coalesce(F.get(_table([r.priority == BASE for r in rules], "array<boolean>"), "rule"), F.lit(False))
    kept = F.coalesce(F.col("kept"), F.lit(False))

    def joined(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, label))), ",")

    return (
        detections(docs, rules)
        .groupBy("_rid")
        .agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"), joined(base).alias("base_labels"), joined(kept).alias("labels"), F.coalesce(F.max(F.when(kept, sure)), F.lit(0.0)).alias("score"),
        )
        .drop("_rid")
    )
