from __future__ import annotations

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) tuples, in two partitions."""

    def make(rows, parts=2):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0) for r in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(parts)

    return make


@pytest.fixture
def odd(docs, spark):
    """Rows no operator may stumble over: nulls, empty texts, repeats and foreign columns."""
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (4, "one"),
        (None, "a text without an id, of more than five words"),
        (5, "日本語 🎉 naïve ÅNGSTRÖM İ"),
        (6, "word " * 20_000),
        (7, "x" * 50_000),
    ]
    table = docs(rows)
    for name in ("node", "key", "bucket", "hash", "n", "row", "group", "u", "v", "drops", "_text", "page"):
        table = table.withColumn(name, table["n_chars"])
    return table
