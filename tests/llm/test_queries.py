"""Registered queries against their SQL, and the pipeline against plain Python."""

from __future__ import annotations

import html
import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, connect
from pricetide.llm.language_id import has_letter
from pricetide.llm.queries import ORACLE, QUERIES
from pricetide.session import ARROW_ROWS, MOST_ARROW_ROWS, bound_batches
from test_similarity import brute_components, word_set
from test_texts import brute_lines
from test_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == ""


def test_pages_have_the_article_s_blocks(spark):
    rows = QUERIES["op8_html_extract"](spark, SF).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for row in rows:
        article = re.search(r"<article>(.*?)</article>", pages[row["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", article)
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in blocks)
        assert row["text"] == "\n".join(p for p in parts if p)
        assert row["n_chars"] == len(row["text"])


def test_pipeline_is_what_plain_python_gives(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs if has_letter(r["text"] or "")]
    rows = [(doc, text) for doc, text, *_ in brute_lines(rows)]
    first = {doc for doc, _, component in brute_components(rows) if doc == component}
    rows = [r for r in rows if r[0] in first]
    items = [word_set(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [
        r for r in rows if not any(100 * len(w & word_set(r[1])) >= 80 * len(w) for w in items if w)
    ]
    assert 0 < len(clean) < len(rows) < len(docs)
    pieces = corpus_pipeline.run(spark, SF).collect()
    total = sum(p["length"] for p in pieces)
    assert check_packing(pieces, clean, 1024) <= -(-total // 1024) * 1.03 + 2


def test_stages_give_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.keep_known_languages(spark, docs, SF)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    out = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    assert out.dtypes == docs.dtypes
    assert Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"


def test_stages_go_by_rows_not_by_ids(spark, docs, tmp_path):
    """Nulls, repeats and ties through the stages that compare documents."""
    item = "one two three four five six seven eight nine ten"
    items = [(1, item), (None, "alpha beta gamma delta epsilon zeta"), (1, ""), (None, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = " ".join(f"w{i}" for i in range(80))
    near = text.replace("w7 ", "")
    rows = [
        (5, text), (5, text), (4, near), (None, text), (None, "alone without any id at all"),
        (6, "another text of one id"), (6, f"before {item} after"), (None, f"x {items[1][1]} y"),
        (7, None), (8, ""), (9, "short"), (10, "short"),
    ]
    table = docs(rows, 3)
    for name in ("row", "group", "kept", "node"):
        table = table.withColumn(name, F.lit(1))
    kept = corpus_pipeline.keep_one_of_each_group(spark, table, str(tmp_path))
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    gone = [(5, text), (5, text), (None, text), (10, "short")]
    assert left == sorted(set(rows) - set(gone), key=str)
    clean = corpus_pipeline.drop_contaminated(spark, kept, str(tmp_path))
    contaminated = {(6, f"before {item} after"), (None, f"x {items[1][1]} y")}
    assert {(r["doc_id"], r["text"]) for r in clean.collect()} == set(left) - contaminated
    assert corpus_pipeline.keep_one_of_each_group(spark, table.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.drop_contaminated(spark, table.limit(0), str(tmp_path)).count() == 0


def test_odd_rows_through_all_stages(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, "word word word"), (1, None)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Without a letter: 1, 2, 3. Items are compared by their words in a row, and the one of
    # three words is a whole sequence, which no longer text has.
    assert {r["doc_id"] for r in pieces} == {4, 5, 6, 7, None}
    assert sum(r["doc_id"] == 4 for r in pieces) == 1


def test_every_stage_bounds_its_batches(spark, docs, tmp_path):
    table = docs([(i, f"text number {i} of some words") for i in range(3)])
    spark.createDataFrame([(1, "some item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = spark.conf.get(ARROW_ROWS)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    try:
        for _, function in corpus_pipeline.STAGES:
            for unbounded in ("10000", "0"):
                spark.conf.set(ARROW_ROWS, unbounded)
                function(spark, table, str(tmp_path))
                most = spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
                assert most == MOST_ARROW_ROWS
        spark.conf.set(ARROW_ROWS, "7")
        bound_batches(spark)
        assert spark.conf.get(ARROW_ROWS) == "7"
    finally:
        spark.conf.set(ARROW_ROWS, before)
