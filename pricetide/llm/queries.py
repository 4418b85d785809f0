"""Registered queries of the numbered operators, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricetide.llm.decontamination import find_items
from pricetide.llm.html_extract import extract_pages
from pricetide.llm.jaccard_join import jaccard_components
from pricetide.llm.language_id import identify_languages
from pricetide.llm.license_scan import scan_licenses
from pricetide.llm.line_dedup import dedup_lines
from pricetide.llm.lz_fingerprint import fingerprint_documents
from pricetide.llm.lexical_search import search_items
from pricetide.llm.packing import pack_documents
from pricetide.llm.substring_dedup import dedup_passages
from pricetide.llm.token_binary import token_round_trip
from pricetide.llm.token_counts import count_tokens
from pricetide.llm.vector_codes import code_vectors

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).drop("text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_vectors(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents")).drop("text", "removed")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_token_binary,
        op3_decontamination,
        op4_lz_fingerprint,
        op5_language_id,
        op6_line_dedup,
        op7_license_scan,
        op8_html_extract,
        op9_jaccard_join,
        op10_packing,
        op11_vector_codes,
        op12_lexical_search,
        op13_substring_dedup,
    )
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _shingles(table: str, key: str) -> str:
    """Rows of ``table``'s key and distinct shingles; none for texts without words."""
    words = "regexp_extract_all(" + _LOWER.format("text") + r", '[^\x20\x09-\x0D]+')"
    return f"""
    SELECT DISTINCT {key}, unnest(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
    FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL)"""


def _codes(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """The rounds of Lloyd's method one after another, every distance computed."""
    assign = """
a{r} AS (SELECT vec_id, part, v, k, dist FROM (
    SELECT p.vec_id, p.part, p.v, c.k, d AS dist,
           row_number() OVER (PARTITION BY p.vec_id, p.part ORDER BY d, c.k) AS place
    FROM p JOIN c{r} c USING (part),
         LATERAL (SELECT sum((x - y) * (x - y))::BIGINT AS d FROM (SELECT unnest(p.v) AS x, unnest(c.v) AS y)))
    WHERE place = 1)"""
    update = """
c{s} AS (SELECT part, k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT part, k, list(floor(total / n)::BIGINT ORDER BY pos) AS v FROM (
        SELECT part, k, pos, sum(x) AS total, count(*) AS n FROM (
            SELECT part, k, unnest(v) AS x, unnest(range(len(v))) AS pos FROM a{r})
        GROUP BY part, k, pos) GROUP BY part, k) m USING (part, k))"""
    steps = [assign.format(r=r) + "," + update.format(r=r, s=r + 1) for r in range(rounds)]
    return f"""
WITH e AS (SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT vec_id, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v
    FROM e, range({parts}) t(part)),
c0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS k, v FROM p
    WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {entries})),
{",".join(steps)},{assign.format(r=rounds)},
r AS (SELECT vec_id, string_agg(format('{{:02x}}', k), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error
    FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, k)) FROM c{rounds}) AS codebooks_sha256
FROM r JOIN e USING (vec_id)"""


ORACLE: dict[str, str] = {
    "op11_vector_codes": _codes(),
    "op12_lexical_search": f"""
WITH t AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
    FROM documents),
d AS (SELECT doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, sum(n)::HUGEINT AS words FROM d),
i AS (SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark) GROUP BY item_id, term),
f AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d)
    WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term, n),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM f GROUP BY term), total),
s AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM (SELECT f.*, (100 - 75 + ((75 * n * docs) // words))::BIGINT AS m FROM f, total) f
    JOIN i USING (term) JOIN weight USING (term) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10""",
    "op13_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, unnest(range(len(w) - 19)) AS pos, unnest([array_to_string(w[i:i + 19], ' ') FOR i IN range(1, len(w) - 18)]) AS s
    FROM d WHERE len(w) >= 20),
later AS (SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS place FROM w) WHERE place > 1),
word AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d),
marked AS (SELECT doc_id, pos, word, max(l.pos IS NOT NULL) OVER (
        PARTITION BY doc_id ORDER BY word.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
    FROM word LEFT JOIN later l USING (doc_id, pos)),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
        string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_decontamination": f"""
WITH d AS ({_shingles("documents", "doc_id")}),
b AS ({_shingles("benchmark", "item_id")}),
size AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM hit JOIN size USING (item_id) WHERE n_shared * 100 >= n_item * 80""",
    "op6_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, f.key IS NULL OR doc_id = keeper AS stays FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op9_jaccard_join": f"""
WITH RECURSIVE d AS ({_shingles("documents", "doc_id")}),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM d a JOIN d b USING (s)
      WHERE a.doc_id < b.doc_id GROUP BY x, y),
link AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
         WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents
          UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON e.x = r.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN n USING (doc_id)""",
}
