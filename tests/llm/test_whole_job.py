"""Cases in which operators once did less than their whole job."""

import itertools
import random
from collections import Counter

import pytest
from brute_llm import contaminated
from conftest import DOCS
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import decontaminate, language, lines, mixing, ngram_join, substring, topk, warc
from tickloom.llm.words import with_row_id


def test_short_lines_repeat(stored):
    rows = [
        (1, "All rights reserved.\none two three four five six\nHome"), (2, "Home\n\nAll  rights\treserved.\n \nall rights reserved."), (3, "All rights\nrights reserved.\nreserved."),
        (3, "Home\nAll rights reserved. one two\none two three four"), (None, "one two three four\none two three four five six"), (4, ""), (5, None),
    ]
    docs = stored([(i, t, "en", "a", 0, "x", "k") for i, t in rows], DOCS)
    text = {r._rid: (r.doc_id, r.text) for r in lines.with_row_id(docs).collect()}
    got = sorted((text[r._rid][0] or 0, text[r._rid][1].split("\n")[r.no].split()) for r in lines.removed_lines(docs).collect())
    assert got == [(0, ["one", "two", "three", "four"]), (0, ["one", "two", "three", "four", "five", "six"]), (2, ["All", "rights", "reserved."]), (2, ["Home"]), (3, ["Home"])]


def found(stored, rows, items):
    docs, bench = stored(rows, "doc_id long, text string"), stored(items, "item_id long, text string")
    return {(r.doc_id, r.item_id, r.verbatim) for r in decontaminate.contaminated(docs, bench).collect()}


def test_every_run_of_an_item_is_judged(stored):
    w = [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    number = [*w[:10], "17", *w[10:40], "17", *w[40:]]
    other = [*w[:10], "23", *w[10:40], "23", *w[40:]]  # the same class
    sums = [*w[:20], "stop", *"1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24".split(), "end", "of", "it"]
    items = [(1, " ".join(number)), (2, " ".join(other)), (3, " ".join(sums).replace("va", "sa"))]
    rows = [
        (1, " ".join(number).replace("17", "18", 1)), (2, " ".join(other).replace("23", "18", 1)), (3, items[2][1].replace("stop", "go")), (4, " ".join([*w[:6], "17", *w[7:13]])),
        (5, " ".join(f"{a} {b}" for a, b in zip(w, "12345678901234567890"))),
    ]
    assert found(stored, rows, items) == {(1, 1, True), (2, 1, True), (3, 3, True)}


def test_items_with_few_literals_match_exactly(stored):
    items = [(1, "What is 37 times 49?"), (2, "日本の首都はどこですか"), (3, "1 2 3 4 5 6 7.5 8"), (4, "What is 37 times 49"), (5, "?!")]
    rows = [
        (1, "Tell me: what is 37 times 49, please"), (2, "What is 38 times 49?"), (3, "問。日本の首都はどこですか。"), (4, "0 1 2 3 4 5 6 7.5 8 9"), (5, "1 2 3 4 5 6 7 5 8"),
        (6, "What is 37 times 49.5?"), (7, "He asked What is 37 times 49? " * 3), (8, None), (9, "?!"),
    ]
    assert found(stored, rows, items) == {(1, 1, True), (3, 2, True), (4, 3, True), (7, 1, True)}
    assert found(stored, rows, items[1:2]) == {(3, 2, True)}


def test_short_items_inside_a_sentence(stored):
    items = [
        (1, "What is the capital city of the largest country in Europe"), (2, "New York is older than the next town up the river by ten or so"), (3, "Name the colour of a ripe lemon"),
        (4, "Which of these is not round"),
    ]
    rows = [
        (1, "see What is the capital city of the largest country in Europe"), (2, "we know, New York is older than the next town up the river by ten or so, they say"), (3, "please Name the colour of a ripe lemon"),
        (4, "so: Which of these is not round? And Which of these is not round?"), (5, "see What is the capital city of the smallest country in Europe"), (6, "New York is older than the next town"), (7, items[1][1]),
    ]
    assert found(stored, rows, items) == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (7, 2, True)}


def test_top_k_with_mixed_lengths(stored):
    rows = [(i, [float((i * j) % 7 - 3) for j in range(1, 5)]) for i in range(30)] + [(30, [1.0, 2.0, 3.0, 4.0, 5.0]), (31, [2.0]), (32, [1.0] * 9)]
    whole = {i: [int(64 * c) for c in v] for i, v in rows}
    want = set()
    for q in range(0, 33, 5):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:4]
        want |= {(q, k + 1, i, -score) for k, (score, i) in enumerate(best)}
    vectors = stored(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 5 == 0, 4).collect()} == want


def test_a_rare_cell_does_not_set_the_size(stored):
    rows = [(i, "w " * (1 + i % 20), "en" if i % 3 else "de", "ab"[i % 2]) for i in range(4000)] + [(9999, "w w", "es", "c")]
    docs = stored(rows, "doc_id long, text string, lang string, source string")
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    for budget in (1.0, 0.5):
        out = mixing.mixed(docs, dims, budget=budget).collect()
        total, drawn = sum(r._tokens for r in out), sum(r._tokens * r._copies for r in out)
        assert len(out) == 4001 and drawn / total == pytest.approx(budget, abs=0.03)
        assert next(r._copies for r in out if r.doc_id == 9999) >= int(budget * next(r._weight for r in out if r.doc_id == 9999))
        for dim in ("lang", "source"):
            for name in {r[dim] for r in out}:
                share = sum(r._weight * r._tokens for r in out if r[dim] == name) / total
                assert sum(r._tokens * r._copies for r in out if r[dim] == name) / drawn == pytest.approx(share, abs=0.02)


def test_items_in_other_letter_case(stored):
    item = "In Paris, Anna Maria and Old Tom saw New York City, the Eiffel Tower and Big Ben with Uncle Bob in May before they all went home"
    short = "Who Wrote The Old Man And The Sea?"
    rows = [(1, item), (2, item.lower()), (3, item.title()), (4, f"{item.upper()}!"), (5, "x " + short.upper()), (6, short.lower()), (7, "who wrote the old man and the lake"), (8, "" + item.lower() + " ")]
    got = {r[0] for r in found(stored, rows, [(1, item), (2, short)])}
    assert got == {1, 2, 3, 4, 5, 6, 8}


def test_decontamination_against_plain_python(stored):
    rng = random.Random(4)
    names, units, base = ["Anna", "Old Tom", "Bob", "Zoe"], ["km", "dollars", "hours"], [f"v{chr(97 + i % 26)}{chr(97 + i // 7)}" for i in range(60)]

    def sentence(n):
        return [rng.choice(names) if rng.random() < 0.15 else f"{rng.randint(2, 40)} {rng.choice(units)}" if rng.random() < 0.15 else str(rng.randint(1, 9)) if rng.random() < 0.1 else rng.choice(base) for _ in range(n)]

    items = [" ".join(sentence(rng.randint(2, 30))) for _ in range(14)] + ["What is 37 times 49?", "Name three rivers"]
    rows = []
    for i in range(160):
        words = rng.choice(items).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            at = rng.randrange(len(words))
            words[at] = rng.choice([str(rng.randint(1, 40)), rng.choice(names), rng.choice(base), words[at].upper()])
        words = words[rng.randint(0, 3) :] if rng.random() < 0.3 else words
        text = " ".join([*sentence(rng.randint(0, 8)), *words, *sentence(rng.randint(0, 8))])
        rows.append((i, rng.choice([str.lower, str, str, str])(text)))
    want = {i for i, text in rows if contaminated(text, items)}
    assert 20 < len(want) < 150
    assert {r[0] for r in found(stored, rows, list(enumerate(items)))} == want


def test_row_ids_do_not_depend_on_how_a_scan_is_cut(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/a b%20+"
    passage = " ".join(f"p{i}" for i in range(40))
    spark.range(1200).selectExpr("id AS doc_id", f"concat('text ', id, if(id % 5 = 0, ' {passage}', ''), ' end ', id) AS text").repartition(12).write.parquet(path)
    ids = {}
    parallelism = itertools.cycle(["4", "3", "1", "9"])
    cut = substring.cut

    def cut_then_change(df):
        out = cut(df)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", next(parallelism))
        return out

    monkeypatch.setattr(substring, "cut", cut_then_change)
    try:
        for n in ("1", "4", "7"):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
            ids[n] = {r._rid: r.doc_id for r in with_row_id(spark.read.parquet(path)).collect()}
        assert len(ids["1"]) == 1200 and ids["1"] == ids["4"] == ids["7"]
        out = substring.without_repeats(spark.read.parquet(path)).collect()
        assert Counter((r.doc_id, r.n_removed) for r in out) == Counter((i, 41 if i % 5 == 0 else 0) for i in range(1200))  # the passage and the word after it
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    # What isn't a stored table is stored first.
    made = spark.createDataFrame([(i, f"row {i} {passage}") for i in range(5)], "doc_id long, text string")
    assert {r.n_removed for r in substring.without_repeats(made).collect()} == {40}


def test_many_short_texts_in_one_batch(spark, tmp_path):
    path = f"{tmp_path}/short"
    spark.range(100_000).selectExpr("id AS doc_id", "concat('w', id % 50000) AS text").coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        out = ngram_join.ngram_components(spark.read.parquet(path))
        assert out.where("n_shingles <> 1 OR component_id <> doc_id % 50000").count() == 0 and out.count() == 100_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_archives_are_read_in_many_tasks(spark, stored, tmp_path):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('u', id) AS url", "concat('page ', id) AS html").repartition(2)
    folder = str(tmp_path / "archives")
    files = warc.write_archives(warc.with_revisits(pages), folder, most=4000)
    out = warc.read_archives(files, folder).withColumn("task", F.spark_partition_id())
    assert files.count() >= 40 and out.select("task").distinct().count() == files.count() and out.count() == 3000


def test_language_model_travels_without_the_package(stored):
    model = language.fit_languages(stored([(1, "ein wort", "de", "a"), (2, "a word", "en", "a")], "doc_id long, text string, lang string, source string"))
    sent = []

    class Frame:
        class sparkSession:  # noqa: N801
            class sparkContext:  # noqa: N801
                broadcast = staticmethod(lambda value: sent.append(value) or value)

    language.language_column(model, Frame)
    assert all("tickloom" not in type(part).__module__ for part in [*sent, *sent[0]])


def test_stages_without_rows_or_labels(spark, tmp_path):
    """An empty table gives empty stages; without any label no language is learned, and every row goes."""
    rows = [(i, f"some text {i}", None, None, 9) for i in range(20)]
    for data in ([], rows):
        path = str(tmp_path / f"sf{len(data)}")
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        assert corpus_pipeline.run(spark, path).count() == 0
        for _, stage in corpus_pipeline.STAGES[1:]:
            assert stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path).count() <= len(data)


def test_mixing_without_repeats(stored):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 20), "en" if i % 4 else "de", "ab"[i % 7 == 0]) for i in range(6000)] + [(9999, "w w", "es", "c"), (9998, None, "es", "d")]
    docs = stored(rows, "doc_id long, text string, lang string, source string")
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    for budget in (0.5, 0.9, 1.0):
        out = mixing.mixed(docs, dims, budget=budget, repeats=False).collect()
        total = sum(r._tokens for r in out)
        assert max(r._copies for r in out) == 1 and sum(r._tokens * r._probability for r in out) == pytest.approx(budget * total, rel=1e-6)
        assert next(r._probability for r in out if r.doc_id == 9999) > 0.5 or budget == 0.5
    # With room everywhere the marginals are the targets.
    out = mixing.mixed(docs.where("doc_id < 9000"), dims, {"source": {"a": 0.8, "b": 0.2}, "lang": {"en": 0.6, "de": 0.4}}, budget=0.4, repeats=False).collect()
    drawn = sum(r._tokens * r._probability for r in out)
    for dim, name, share in (("source", "b", 0.2), ("lang", "de", 0.4)):
        assert sum(r._tokens * r._probability for r in out if r[dim] == name) / drawn == pytest.approx(share, abs=1e-6)


def test_only_lines_that_can_match_are_compared(stored):
    rng = random.Random(5)
    rows, like = [], set()
    for k in range(120):
        w = [f"v{rng.randrange(10_000)}" for _ in range(rng.choice((1, 3, 5, 6, 9, 30, 80)))]
        rows.append((k, " ".join(w)))
        if k % 3 == 0:
            rows.append((1000 + k, " ".join([*w, "tail"]) if k % 2 else " \t".join(w)))
            if k % 2 and len(w) >= 9:  # the tail adds a token; a shorter line has too few to stay like it
                like |= {k, 1000 + k}
    docs = stored([(i, t, "en", "a", 0, "x", "k") for i, t in rows], DOCS)
    signed = lines.signed(with_row_id(docs), lines.WIDTH)
    groups = signed.select("sid", "sid2", "doc_id", lines._need().alias("need")).groupBy("sid", "sid2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("need").alias("need"))
    numbered = groups.withColumn("id", lines._kept_bits(F.col("sid"), lines.ID_BITS))
    got = {r.doc_id for r in lines.candidates(lines.prefixes(signed, lines.WIDTH, 48), numbered).collect()}
    assert like <= got and len(got) <= len(like) + 20
    assert {r.doc_id for r in lines.removed_lines(docs).collect()} == {i for i in like if i >= 1000} | {1000 + k for k in range(0, 120, 6)}
