import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture
def stored(spark, tmp_path):
    """Write rows as a stored table, as the operators want them."""

    def make(rows, schema):
        path = str(tmp_path / uuid.uuid4().hex)
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long, sid string, key string"


@pytest.fixture
def odd_docs():
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing extra columns."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    long = " ".join(f"w{i % 701}x{i % 13}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [
        (1, base + " one", "en", "a"), (2, base + " two", "en", "a"), (2, base + " two", "en", "a"), (3, None, None, None), (4, "", "en", "b"),
        (None, base + " one", "en", "a"), (5, "short text", "de", "b"), (6, "short text", "de", None), (7, long, "fr", "a"), (8, long + " tail", None, "a"),
        (9, f"before {passage} after", "es", "c"), (10, f"other words {passage}\nthen {passage} end", "es", "c"), (11, "a " * 120, "en", "c"), (12, " \t\n", "en", "c"),
        (13, "한국어 日本 \U0001f600 été " * 9, "fr", "c"), (14, base + "\n" + base + " three\nlast line is short", "en", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "x", None) for i, t, lang, s in rows]
