"""Benchmark decontamination by templates, in DataFrame operations only.

Numbers, units after numbers, and names (capitalised words inside a sentence) become typed placeholders; what
is left is lower-cased and cut at anything that is no letter or digit.  The steps:

1. ``benchmark_templates``: an item has one template at the start of a sentence and, if it starts with a
   capitalised word, one inside a sentence.  Items with the same template whose slots repeat in the same places are one class,
   named by its smallest item_id, so a template with many variants is matched once.
2. Every ``size``-token window of a class is joined by hash with every ``stride``-th window of each document.
   ``size + stride - 1`` is the shortest run that counts, so no such run is missed.  The windows of the
   benchmark are broadcast only if there are at most ``BROADCAST_WINDOWS`` (24 MB); else both sides shuffle.
3. Hits become (row, class, offset) and are checked on the rows' whole texts: every long run of equal
   template tokens at that offset, its literal tokens, and slot consistency (equal values in the item must be
   equal values in the document), which tells a re-parameterised question from a chance likeness.
4. In runs without that consistency, ``RUN`` tokens that any item of the class holds word for word count, by
   hash (``run`` is then ``RUN``).

A row is contaminated by a class if a run covers ``RUN`` tokens (or the whole item, if that is shorter) and
has at least ``LITERALS`` literal tokens.  Items with fewer literals can't be told from chance by their template:
they match where all their words and numbers stand one after the other, found by hash and compared.  Apart from
templates, ``RUN`` words of an item one after the other (or all, if it has from ``LITERALS`` to ``RUN``) count in any letter case, which
decides what templates take for names: the same windows over lower-case words, compared word by word.  The
characters U+E001 to U+E004, which stand for placeholders, are read as separators.  Null and empty texts match nothing; repeated rows are judged each for itself; extra columns
of either table are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import with_row_id
from tickloom.session import cut

RUN = 13
LITERALS = 5
SIZE = 6
BROADCAST_WINDOWS = 1_000_000
NUMBER, NAME, UNIT, END = "\ue001", "\ue002", "\ue003", "\ue004"  # private-use characters
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|miles?|meters?|metres?|feet|inch(?:es)?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|liters?|litres?|ml"
_CLOSE = r"(?![\p{L}\p{N}])"
_NUMBER = rf"\d(?<![\p{{L}}\p{{N}}]\d)\d*+(?:[.,]\d++)*+(?:(?= ?(?:{UNITS}){_CLOSE})|{_CLOSE})"
_WORD = r"\p{Lu}[\p{L}'’-]*+"
_NAME = rf"{_WORD[:6]}(?<=[\p{{L}}\p{{N}},;\x{{e001}}-\x{{e004}}] {{1,2}}\p{{Lu}})[\p{{L}}'’-]++(?: {_WORD})*+{_CLOSE}"


def _marked(text: Column, keep: bool) -> Column:
    """The text with placeholders; with ``keep`` each holds its value, up to END."""
    put = (lambda kind: f" {kind}$0{END} ") if keep else (lambda kind: f" {kind} ")
    free = F.translate(text, NUMBER + NAME + UNIT + END, "    ")
    numbered = F.regexp_replace(free, _NUMBER, put(NUMBER))
    unit = F.regexp_replace(numbered, rf"(?<=[{END if keep else NUMBER}] {{1,2}})(?:{UNITS}){_CLOSE}", put(UNIT))
    united = F.when(numbered.contains(NUMBER), unit).otherwise(numbered)
    return F.lower(F.regexp_replace(united, _NAME, put(NAME)))


def template_tokens(text: Column) -> Column:
    """Literal tokens and placeholders in order."""
    return F.filter(F.split(_marked(text, False), rf"[^\p{{L}}\p{{N}}{NUMBER}-{UNIT}]+"), lambda t: t != "")


def valued_tokens(text: Column) -> Column:
    """The same tokens; a placeholder is followed by the value it stands for."""
    return F.regexp_extract_all(_marked(text, True), F.lit(rf"[{NUMBER}-{UNIT}][^{END}]*{END}|[\p{{L}}\p{{N}}]+"), F.lit(0))


def plain_tokens(text: Column) -> Column:
    """Lower-case words and numbers, whatever stands around them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{N}+(?:[.,]\p{N}++)*+(?![\p{L}\p{N}])|[\p{L}\p{N}]+"), F.lit(0))


def _kind(token: Column) -> Column:
    first = F.substring(token, 1, 1)
    return F.when(first.isin(NUMBER, NAME, UNIT), first).otherwise(token)


def _literals(tokens: str | Column) -> Column:
    return F.size(F.filter(tokens, lambda t: ~F.substring(t, 1, 1).isin(NUMBER, NAME, UNIT)))


def _stretches(rows: DataFrame, first: Column) -> DataFrame:
    """``rows`` once per ``RUN`` of their values with ``LITERALS`` literals: at (its place), h and literals."""
    starts = F.when(F.size("values") >= RUN, F.sequence(F.lit(1), F.size("values") - RUN + 1))
    part = F.transform(starts, lambda i: F.struct((first + i - 1).alias("at"), F.xxhash64(F.slice("values", i, RUN)).alias("h"), _literals(F.slice("values", i, RUN)).alias("literals")))
    return rows.withColumn("s", F.explode(part)).where(F.col("s.literals") >= LITERALS).select(*(c for c in rows.columns if c not in ("values", "first")), "s.*")


def _item_forms(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, forms): each item's values where it starts a sentence, and inside one.

    Inside a sentence its leading capitalised words are a name.
    """
    text = F.col("text").cast("string")
    inside = valued_tokens(F.concat(F.lit("x "), text))
    forms = F.array_distinct(F.array(valued_tokens(text), F.slice(inside, F.lit(2), F.size(inside))))
    return cut(benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"), forms.alias("forms")).where("size(forms[0]) > 0"))


def _typed_items(forms: DataFrame) -> DataFrame:
    """(item_id, values, tokens, class); items with the same template and slot pattern have the same class."""
    typed = forms.select("item_id", F.explode("forms").alias("values")).withColumn("tokens", F.transform("values", _kind))
    # Where each token's value stands first: the same for any choice of values.
    pattern = F.transform("values", lambda v: F.array_position("values", v))
    return typed.withColumn("class", F.xxhash64("tokens", pattern)).where(_literals("tokens") >= LITERALS)


def _exact_items(forms: DataFrame) -> DataFrame:
    """(words, m, w, h, item_id, b): items with too few literals for a template; h names their first w words."""
    few = forms.where(F.exists("forms", lambda v: _literals(v) < LITERALS))
    form = F.col("forms")[0]
    b = F.struct(F.size(form).alias("run"), F.lit(True).alias("verbatim"), (F.size(form) - _literals(form)).alias("slots"))
    one = few.groupBy(plain_tokens(F.col("text")).alias("words")).agg(F.min(F.struct("item_id", b.alias("b"))).alias("one"))
    sized = one.select("words", F.size("words").alias("m"), F.least(F.lit(SIZE), F.size("words")).alias("w"), "one.*")
    return sized.withColumn("h", F.xxhash64(F.slice("words", F.lit(1), F.col("w"))))


def _exact_matches(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(_rid, doc_id, item_id, b): the rows that hold all words of an item, one after the other."""
    sizes = [r["w"] for r in items.select("w").distinct().collect()]  # at most SIZE
    small = items.count() <= BROADCAST_WINDOWS
    words = rows.select("_rid", "doc_id", F.explode(F.array(plain_tokens(F.col("text").cast("string")))).alias("dw"))

    def heads(w: int) -> Column:
        starts = F.when(F.size("dw") >= w, F.sequence(F.lit(1), F.size("dw") - w + 1))
        return F.coalesce(F.transform(starts, lambda i: F.struct(F.lit(w).alias("w"), i.alias("at"), F.xxhash64(F.slice("dw", i, w)).alias("h"))), F.array())

    first = words.select("_rid", F.explode(F.concat(*map(heads, sizes)) if sizes else F.array().cast("array<struct<w:int,at:int,h:bigint>>")).alias("s")).select("_rid", "s.*")
    known = items.select("w", "h", "m", "item_id")
    # An item of few words is its own head, wherever it stands.
    hits = first.join(F.broadcast(known) if small else known, ["w", "h"]).select("_rid", "item_id", F.when(F.col("m") > F.col("w"), F.col("at")).alias("at")).distinct()
    found = cut(hits).groupBy("_rid").agg(F.collect_set(F.struct("item_id", "at")).alias("hits"))
    both = words.join(found.hint("merge"), "_rid").select("_rid", "doc_id", "dw", F.explode("hits").alias("hit")).select("_rid", "doc_id", "dw", "hit.*")
    whole = both.join(items.select("item_id", "words", "m", "b"), "item_id")
    return whole.where(F.col("at").isNull() | (F.slice("dw", F.coalesce("at", F.lit(1)), F.col("m")) == F.col("words"))).select("_rid", "doc_id", "item_id", "b")


def benchmark_templates(typed: DataFrame) -> DataFrame:
    """(class, tokens, item_id, values, m, need): one row per class of items."""
    classes = typed.groupBy("class", "tokens").agg(F.min("item_id").alias("item_id"), F.min("values").alias("values"))
    return classes.withColumn("m", F.size("tokens")).withColumn("need", F.least(F.lit(RUN), F.col("m")))


def _plain_items(forms: DataFrame, variants: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, named, words, m, need): items by their words alone; named is the item that names their class."""
    named = variants.select("class", F.col("item_id").alias("_i")).join(items.select("class", "item_id"), "class").groupBy("_i").agg(F.min("item_id").alias("named"))
    words = forms.groupBy(plain_tokens(F.col("text")).alias("words")).agg(F.min("item_id").alias("item_id"))
    words = words.join(named.withColumnRenamed("_i", "item_id"), "item_id", "left").withColumn("named", F.coalesce("named", "item_id"))
    return words.withColumn("m", F.size("words")).where(F.col("m") >= LITERALS).withColumn("need", F.least(F.lit(RUN), F.col("m")))


def _windows(items: DataFrame, tokens: str, name: str, size: int) -> DataFrame:
    """(name, m, at, h): every window of the items' tokens."""
    starts = F.sequence(F.lit(1), F.col("m") - size + 1)
    return items.select(name, "m", F.posexplode(F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, size)))).alias("at", "h"))


def _lined_up(tokens: DataFrame, items: DataFrame, held: str, name: str) -> DataFrame:
    """(_rid, name, m, offset): where every ``stride``-th window of a row's tokens meets a window of an item."""
    shortest = items.agg(F.min("need")).first()[0] or RUN
    size = min(SIZE, shortest)
    stride = shortest - size + 1
    windows = cut(_windows(items, held, name, size))
    small = windows.count() <= BROADCAST_WINDOWS
    starts = F.when(F.size("tokens") >= size, F.sequence(F.lit(1), F.size("tokens") - size + 1, F.lit(stride)))
    strided = tokens.select("_rid", F.posexplode_outer(F.transform(starts, lambda i: F.xxhash64(F.slice("tokens", i, size)))).alias("k", "h"))
    return strided.join(F.broadcast(windows) if small else windows, "h").select("_rid", name, "m", (F.col("k") * stride - F.col("at")).alias("offset")).distinct()


def _runs_of(z: Column, equal, need: Column) -> Column:
    """(end, run) of every run of at least ``need`` equal elements of the array ``z``."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("cur"), F.array().cast("array<struct<end:int,run:int>>").alias("runs"))

    def ended(s: Column) -> Column:
        """The runs so far, with the one that ends here if it is long enough."""
        return F.when(s["cur"] >= need, F.concat(s["runs"], F.array(F.struct(s["at"].alias("end"), s["cur"].alias("run"))))).otherwise(s["runs"])

    def step(s: Column, e: Column) -> Column:
        return F.struct((s["at"] + 1).alias("at"), F.when(equal(e), s["cur"] + 1).otherwise(0).alias("cur"), F.when(equal(e), s["runs"]).otherwise(ended(s)).alias("runs"))

    return F.aggregate(z, start, step, ended)


def _case_blind(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(_rid, doc_id, item_id, b): rows of (text, plain hits) that hold a run of an item's words in any letter case."""
    words = texts.where("size(plain) > 0").select("_rid", "doc_id", "plain", F.explode(F.array(plain_tokens(F.col("text")))).alias("dw"))
    hit = words.select("_rid", "doc_id", "dw", F.explode("plain").alias("hit"))
    low = F.greatest(F.lit(0), F.col("hit.offset"))
    part = hit.select("_rid", "doc_id", "hit.item_id", "hit.offset", F.slice("dw", low + 1, F.col("hit.m")).alias("dw")).join(items.select("item_id", "named", "words", "need"), "item_id")
    against = F.slice("words", F.greatest(F.lit(0), -F.col("offset")) + 1, F.greatest(F.size("dw"), F.lit(1)))
    zipped = part.withColumn("z", F.zip_with("dw", against, lambda d, i: F.coalesce(d == i, F.lit(False))))
    runs = zipped.select("_rid", "doc_id", F.col("named").alias("item_id"), F.explode(_runs_of(F.col("z"), lambda e: e, F.col("need"))).alias("r"))
    return runs.select("_rid", "doc_id", "item_id", F.struct(F.col("r.run").alias("run"), F.lit(True).alias("verbatim"), F.lit(0).alias("slots")).alias("b"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_rid, doc_id, item_id, run, slots, verbatim): the rows of a stored table that hold a benchmark item."""
    rows = with_row_id(docs)
    forms = _item_forms(benchmark)
    variants = cut(_typed_items(forms))
    items = cut(benchmark_templates(variants))
    # The tokens pass through a one-element array, and empty arrays are left to the join: so the regular
    # expressions are evaluated once a row and not again in filters that Spark would derive.
    tokens = rows.select("_rid", F.explode(F.array(template_tokens(F.col("text").cast("string")))).alias("tokens"))
    words = rows.select("_rid", F.explode(F.array(plain_tokens(F.col("text").cast("string")))).alias("tokens"))
    wordy = cut(_plain_items(forms, variants, items))
    none = F.lit(None).cast("struct<item_id:bigint,m:int,offset:int>")
    by_template = _lined_up(tokens, items, "tokens", "class").select("_rid", F.struct("class", "m", "offset").alias("hit"), none.alias("plain"))
    by_words = _lined_up(words, wordy, "words", "item_id").select("_rid", F.lit(None).cast("struct<class:bigint,m:int,offset:int>").alias("hit"), F.struct("item_id", "m", "offset").alias("plain"))
    # Always one shuffle of the texts: whether the hits could be broadcast depends on the corpus.
    grouped = cut(by_template.union(by_words)).groupBy("_rid").agg(F.collect_set("hit").alias("hits"), F.collect_set("plain").alias("plain"))
    texts = rows.select("_rid", F.col("doc_id"), F.col("text").cast("string").alias("text")).join(grouped.hint("merge"), "_rid")
    seen = texts.where("size(hits) > 0").select("_rid", "doc_id", "hits", F.explode(F.array(valued_tokens(F.col("text")))).alias("dv"))
    # Only the stretch of the document that lies against the item goes on.
    low = F.greatest(F.lit(0), F.col("hit.offset"))
    pairs = seen.select("_rid", "doc_id", "dv", F.explode("hits").alias("hit")).select("_rid", "doc_id", "hit.class", "hit.offset", F.slice("dv", low + 1, F.col("hit.m")).alias("dv"))
    wanted = items.select("class", "item_id", "m", "need", F.col("values").alias("iv"))
    part = pairs.join(wanted, "class").withColumn("first", F.greatest(F.lit(0), F.col("offset")) - F.col("offset"))
    part = part.select("_rid", "doc_id", "item_id", "class", "need", "first", "dv", F.slice("iv", F.col("first") + 1, F.col("m")).alias("iv"))
    zipped = part.withColumn("z", F.zip_with("dv", "iv", lambda d, i: F.struct(d.alias("d"), i.alias("i"), F.coalesce(_kind(d) == _kind(i), F.lit(False)).alias("eq"))))
    runs = zipped.withColumn("r", F.explode(_runs_of(F.col("z"), lambda e: e["eq"], F.col("need"))))
    stretch = runs.select("_rid", "doc_id", "item_id", "class", (F.col("first") + F.col("r.end") - F.col("r.run")).alias("first"), F.col("r.run").alias("run"), F.slice("z", F.col("r.end") - F.col("r.run") + 1, F.col("r.run")).alias("z"))
    slots = F.filter("z", lambda z: F.substring(z["i"], 1, 1).isin(NUMBER, NAME, UNIT))
    held = stretch.withColumn("slots", slots).where((F.col("run") - F.size("slots")) >= LITERALS)
    distinct = F.size(F.array_distinct(F.transform("slots", lambda z: F.struct(z["i"], z["d"]))))
    held = cut(held.withColumn("consistent", distinct == F.size(F.array_distinct(F.transform("slots", lambda z: z["i"])))))
    verbatim = ~F.exists("slots", lambda z: z["i"] != z["d"])
    best = held.where("consistent").select("_rid", "doc_id", "item_id", F.struct("run", verbatim.alias("verbatim"), F.size("slots").alias("slots")).alias("b"))
    # A run whose slots disagree may still hold a stretch of any item of the class word for word.
    torn = held.where("NOT consistent").select("_rid", "doc_id", "item_id", "class", "first", F.transform("z", lambda z: z["d"]).alias("values"))
    stretches = _stretches(torn, F.col("first")).join(_stretches(variants, F.lit(0)).select("class", "at", "h").distinct().hint("merge"), ["class", "at", "h"])
    best = best.union(stretches.select("_rid", "doc_id", "item_id", F.struct(F.lit(RUN).alias("run"), F.lit(True).alias("verbatim"), (RUN - F.col("literals")).alias("slots")).alias("b")))
    best = best.union(_case_blind(texts, wordy))
    few = cut(_exact_items(forms))
    if not few.isEmpty():
        best = best.union(_exact_matches(rows, few))
    return best.groupBy("_rid", "doc_id", "item_id").agg(F.max("b").alias("b")).select("_rid", "doc_id", "item_id", "b.run", "b.slots", "b.verbatim")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    docs = with_row_id(docs)
    found = cut(contaminated(docs, benchmark).select("_rid").distinct())
    return docs.join(found.hint("merge"), "_rid", "left_anti").drop("_rid")
