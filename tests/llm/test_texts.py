from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import HashingTF

from pricetide.llm import language_id, license_scan
from pricetide.llm.html_extract import extract_pages, main_text
from pricetide.llm.language_id import grams, identify_languages, is_held_out, ranked
from pricetide.llm.license_scan import (
    FEATURES,
    TEMPLATES,
    scan_licenses,
    scored,
    template_table,
    train,
    training_rows,
)
from pricetide.llm.line_dedup import dedup_lines
from pricetide.llm.lz_fingerprint import (
    HASHES,
    Parsed,
    fingerprint,
    fingerprint_documents,
    parse,
    phrase_hashes,
    range_of,
)

SF = "/root/testdata/sf0.001"


# Fingerprints


@given(st.text(alphabet="ab c", max_size=80), st.text(alphabet="ab c", max_size=80))
@settings(max_examples=100, deadline=None)
def test_an_edited_text_has_the_fingerprint_of_its_whole(text, following):
    edited, marks = Parsed(text).edited(following)
    half = len(text) // 2
    assert edited == text[: len(text) - half] + following[:half]
    assert marks.tobytes().hex() == fingerprint(edited)


def test_phrases_are_the_shortest_new_ones():
    phrases: set[str] = set()
    assert parse("abababab", phrases) == "b" and phrases == {"a", "b", "ab", "aba"}


def brute_fingerprints(rows):
    order = sorted(
        ((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1])
    )
    out = []
    for i, (doc, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(text), fingerprint(edited)))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_bucket", [1, 3, 1000])
def test_neighbours_across_ranges(docs, per_bucket):
    rng = random.Random(per_bucket)
    rows = [(i * 3, "".join(rng.choice("abcd ") for _ in range(rng.randrange(40)))) for i in range(25)]
    found = fingerprint_documents(docs(rows, 3), rows_per_bucket=per_bucket)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=str) == brute_fingerprints(rows)


def test_fingerprints_of_odd_rows(odd, docs):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    for size in (2, 100):
        found = fingerprint_documents(odd, rows_per_bucket=size).collect()
        assert sorted((tuple(r[n] for n in names) for r in found), key=str) == brute_fingerprints(rows)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert fingerprint_documents(docs([])).count() == 0
    assert fingerprint_documents(docs([(1, "alone")])).first()["near_next"] == 1.0


def test_edited_texts_are_nearer_than_other_texts(spark):
    found = fingerprint_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in found if r["n_chars"] > 200]) > 0.95


# Languages


def test_the_profile_is_in_the_order_of_counts():
    keys, counts = grams("aab aab b")
    top = ranked(keys, counts)
    assert chr(int(top[0])) in "ab" and len(set(top.tolist())) == len(top)


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = identify_languages(docs, train=spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.93
    assert all(r["held_out"] == is_held_out(r["doc_id"]) for r in rows)


def brute_ranks(texts, size=300):
    counts: dict[str, int] = {}
    for text in texts:
        letters = "".join(c if c.isalpha() or c == "'" else " " for c in text.lower())
        padded = f" {' '.join(letters.split())} " if letters.split() else " "
        for n in (1, 2, 3):
            for at in range(len(padded) - n + 1):
                gram = padded[at : at + n]
                if gram != " ":
                    counts[gram] = counts.get(gram, 0) + 1
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:size]


def brute_languages(rows):
    learnt: dict[str, list] = {}
    for doc, text, lang in rows:
        if text is not None and lang is not None and not is_held_out(doc) and any(map(str.isalpha, text)):
            learnt.setdefault(lang, []).append(text)
    profiles = {lang: {g: r for r, g in enumerate(brute_ranks(texts))} for lang, texts in learnt.items()}
    out = []
    for doc, text, _ in rows:
        if not any(map(str.isalpha, text or "")):
            out.append((doc, "und", 0.0))
            continue
        own = brute_ranks([text])
        apart = sorted(
            (sum(abs(p[g] - r) if g in p else 300 for r, g in enumerate(own)) / (300 * len(own)), lang)
            for lang, p in profiles.items()
        )
        out.append((doc, apart[0][1], (apart[1][0] - apart[0][0]) / apart[1][0] if apart[1][0] else 0.0))
    return out


def test_languages_and_scores_are_those_of_all_distances(docs):
    rng = random.Random(8)
    sounds = {"aa": ["ba", "na", "lo", "é"], "bb": ["kri", "zu", "'t", "ba"], "cc": ["日", "本", "na", "Ö"]}
    rows = []
    for i in range(90):
        lang = rng.choice(list(sounds))
        words = ["".join(rng.choice(sounds[lang]) for _ in range(rng.choice([1, 2, 5]))) for _ in range(rng.choice([1, 4, 50]))]
        rows.append((i, rng.choice([" ", ", ", "\n 7 "]).join(words), lang))
    rows += [(200, "12 !?", "aa"), (201, None, "aa"), (202, "banana", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_languages(docs(rows)).collect()}
    for doc, lang, score in brute_languages(rows):
        assert got[doc][0] == lang and got[doc][1] == pytest.approx(score, abs=1e-12)


def test_held_out_labels_teach_nothing(docs):
    rows = [(i, "zzz yyy xxx" if is_held_out(i) else "abc abd abe", "aa" if is_held_out(i) else "bb") for i in range(60)]
    found = identify_languages(docs(rows)).collect()
    assert {r["lang_pred"] for r in found} == {"bb"}


def test_languages_of_odd_rows(odd, docs, spark):
    found = {r["doc_id"]: r for r in identify_languages(odd, columns=("source", "n")).collect()}
    assert {found[i]["lang_pred"] for i in (1, 2, 3)} == {"und"} and found[1]["score"] == 0.0
    assert found[1]["source"] == "s" and not found[None]["held_out"]
    assert identify_languages(docs([])).count() == 0
    nothing = docs([(1, "some text", None), (2, None, "en")])
    assert {r["lang_pred"] for r in identify_languages(nothing).collect()} == {"und"}


def test_a_carried_text_goes_to_python_once(odd, monkeypatch):
    sent = []
    real = language_id.map_arrow
    monkeypatch.setattr(language_id, "map_arrow", lambda df, *rest: sent.append(df) or real(df, *rest))
    names = ("n_chars", "text", "source")
    found = identify_languages(odd, columns=names)
    assert [f.name for f in sent[-1].schema.fields if f.dataType.typeName() == "string"] == ["_text", "_c1"]
    assert found.columns == [*names, "doc_id", "held_out", "lang_pred", "score"]
    want = sorted(map(tuple, odd.select(*names).collect()), key=str)
    assert sorted((tuple(r)[:3] for r in found.collect()), key=str) == want


def test_the_training_bound_holds_for_each_language(docs):
    rows = [(i, f"abc {i}", "aa") for i in range(400)] + [(1000 + i, "xyz xyz", "bb") for i in range(3)]
    found = identify_languages(docs(rows), train_docs=5).collect()
    assert all(r["lang_pred"] == ("aa" if r["doc_id"] < 1000 else "bb") for r in found)


# Lines


def brute_lines(rows, min_chars=20, min_docs=3):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    holders: dict[str, set] = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x
            for x in lines
            if doc is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == doc
        ]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LINES = ["short", "A line of twenty chars!", "  a LINE of twenty chars!\t", "ÄÖÜ ÄÖÜ ÄÖÜ ÄÖÜ ÄÖÜ", "äöü äöü äöü äöü äöü", "", "another line that is long enough", "x" * 19 + " "]


@pytest.mark.parametrize("seed", range(3))
def test_lines_of_many_documents_go(docs, seed):
    rng = random.Random(seed)
    rows = [(i % 9, "\n".join(rng.choice(LINES) for _ in range(rng.randrange(6)))) for i in range(12)]
    found = dedup_lines(docs(rows)).collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == brute_lines(rows)
    assert all(r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in found)


def test_lines_of_odd_rows(odd, docs):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = dedup_lines(odd, columns=("key", "drops")).collect()
    assert sorted((tuple(r)[2:6] for r in found), key=str) == brute_lines(rows)
    assert dedup_lines(docs([])).count() == 0


# Licences


def test_stated_licences_are_found_and_other_lines_are_not(spark, docs):
    plain = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150").collect()
    fixed = [(f, t) for f, t in TEMPLATES]
    rows = [(1000 + i, f"Some words.\n{t}\nOf other things.") for i, (_, t) in enumerate(fixed)]
    rows += [(r["doc_id"], r["text"]) for r in plain]
    found = scan_licenses(docs(rows)).collect()
    planted = {(r["doc_id"], r["paragraph"], r["family"]) for r in found if r["doc_id"] >= 1000}
    assert planted == {(1000 + i, 1, f) for i, (f, _) in enumerate(fixed)}
    texts = {r["doc_id"]: r["text"].split("\n") for r in plain}
    stated = {t.lower() for _, t in fixed}
    assert all(texts[r["doc_id"]][r["paragraph"]].lower() in stated for r in found if r["doc_id"] < 1000)


def test_licences_of_odd_rows(odd, docs):
    assert scan_licenses(odd).count() == 0
    assert scan_licenses(docs([])).count() == 0


def test_licences_in_other_words_and_across_lines(spark, docs):
    plain = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150").collect()
    words = " ".join(r["text"].replace("\n", " ") for r in plain[:3]).split()
    other = {
        1000: ("Licensed under the GNU General Public License, version 3.", "gpl"),
        1001: ("Distributed under the MIT License.", "mit"),
        1002: ("Licensed under CC BY-NC 3.0.", "cc-by-nc"),
    }
    wrapped = "A file.\n\nThis program is free software: you can\nredistribute it and/or modify it under\nthe terms of the GNU General Public\nLicense as published by the Free\nSoftware Foundation\n\nMore of it."
    two = "Licensed under the MIT License. Licensed under the Apache License, Version 2.0."
    long = " ".join([*words[:500], "Released under the ISC License.", *words[500:900]])
    rows = [(i, f"Some words.\n\n{t}\n\nOf other things.") for i, (t, _) in other.items()]
    rows += [(2000, wrapped), (2001, two), (2002, long)] + [(r["doc_id"], r["text"]) for r in plain]
    found = {}
    for r in scan_licenses(docs(rows)).filter("doc_id >= 1000").collect():
        found.setdefault(r["doc_id"], []).append((r["paragraph"], r["family"], r["confirmed"]))
    for i, (_, family) in other.items():
        assert found[i] == [(2, family, False)]
    assert found[2000] == [(2, "gpl", True)]
    assert sorted(found[2001]) == [(0, "apache-2.0", True), (0, "mit", True)]
    assert found[2002] == [(0, "isc", True)]


# Pages


PAGE = "<html><head><title>T</title></head><body>{0}</body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two<p>three</article><footer>f</footer>", "A & B\none two\nthree"),
        ("<div class='post'><p>x</p> tail<div id=comments><p>no</p></div><form>f</form></div>", "x\ntail"),
        ("<p>un<i>closed", "unclosed"),
        ("<p>a &lt; b<script>if (a<b) {'</p>'}</script>c</p>", "a < bc"),
        ("<main>in<aside>no</aside></main>out", "in"),
        ("a<br>b<!-- no --><div hidden>no</div>", "a\nb"),
        ("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", "one\ntwo\nx\ny"),
        ("<div class='cookie-notice'>no</div><div class='shadow'>yes</div>", "yes"),
        ("", ""),
    ],
)
def test_main_text(body, want):
    assert main_text(PAGE.format(body)) == want


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article>Own.<article class='comment'>Nice!</article></article>", "Own."),
        ("<article>Own.</article><article class='teaser-card'>Other</article>", "Own."),
        ("<header>Site name</header><div>Text.</div>", "Text."),
        ("<article><header><h1>Title</h1></header>Text.</article>", "Title\nText."),
        ("<p title=it's>Hello</p><p title='a > b'>you</p>", "Hello\nyou"),
        ("<article><section class='notices-of-intent'>Kept.</section><div class='legal'>And this.</div></article>", "Kept.\nAnd this."),
        ("<article><p class='byline'>By A</p><p class=tags>x</p><p class='copyright'>C</p></article>", "By A\nx\nC"),
        ("<article><div class='comment-list'>Nice!</div><aside>x</aside><div id=related-posts>More</div>Own.</article>", "Own."),
        ("<article>Let <math><mi>x</mi></math> be.</article>", "Let x be."),
        ("<div id=topnav>Home</div><div id='mainMenu'>A</div>Text.", "Text."),
        ("<p title='the hidden gem'>Seen</p><p hidden>not</p><p style='color:red;display: none'>not</p>", "Seen"),
        ("Text.<!-- never closed <p>gone</p>", "Text."),
        ("Text.<a href='never closed>gone</a>", "Text."),
        ("1 < 2 &lt; 3 <3", "1 < 2 < 3 <3"),
        ("<script>if (a</b>) {}</script>Text<style>p{}</style>.", "Text."),
    ],
)
def test_what_markup_says(body, want):
    assert main_text(f"<html><head><title>T</title></head><body>{body}</body></html>") == want


@pytest.mark.parametrize("unit", ["<a ", "<a b='", "<a b=", "<!--", "<div><p>", "</", "<p class=a b>", "&", "<a\n/"])
def test_a_megabyte_of_any_markup(unit):
    start = time.process_time()
    main_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - start < 20
    start = time.process_time()
    main_text(unit * (100_000 // len(unit)))
    assert time.process_time() - start < 2


def test_joined_templates_are_those_that_are_sent(spark):
    rows = []
    for i in range(30):
        notice = "<p>Read our terms of use.</p><div class='legal'>All rights.</div>" if i % 3 else ""
        body = f"<div><span>Site</span></div><article><h1>T {i}</h1><p>Text {i} itself.</p>{notice}</article>"
        rows.append((i % 20, f"https://a{i % 2}.example/{i}", PAGE.format(body)))
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    sent, joined = (extract_pages(table, most_templates=n).collect() for n in (1000, 0))
    assert sorted(sent) == sorted(joined)
    assert {r["text"].split("\n", 1)[1] for r in sent} == {f"Text {i} itself." for i in range(30)}


def test_what_a_host_repeats_goes(spark):
    rows = []
    for i in range(12):
        body = f"<div><span>Site of things</span><em>always</em></div><div><p>Text {i} itself.</p></div>"
        rows.append((i, f"https://a.example/{i}", PAGE.format(body)))
        rows.append((100 + i, f"https://b{i}.example/", PAGE.format(body)))
    rows += [(200 + i, f"https://c.example/{i}", PAGE.format("<div>The same page</div>")) for i in range(5)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in extract_pages(table).collect()}
    for i in range(12):
        assert got[i] == f"Text {i} itself."
        assert got[100 + i] == f"Site of thingsalways\nText {i} itself."
    assert {got[200 + i] for i in range(5)} == {"The same page"}


def test_copies_of_an_article_stay(spark):
    body = "<article><h1>H</h1><p>Same words.</p></article><div>{0}</div>"
    rows = [(i, f"https://a.example/{i}", PAGE.format(body.format(i))) for i in range(9)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in extract_pages(table).collect()} == {"H\nSame words."}


def test_what_only_host_counts_can_remove(spark):
    rows = []
    for i in range(12):
        notice = "<p>Read our terms of use.</p>"
        body = f"<article><h1>Title {i}</h1><p>Text {i} of the article itself.</p>{notice}</article>"
        rows.append((i, f"https://a.example/{i}", PAGE.format(body)))
        rows.append((100 + i, f"https://b{i}.example/", PAGE.format(body)))
        near = f"<article><h1>Day {i}</h1><p>The same long words of one article.</p></article>"
        rows.append((200 + i, f"https://n.example/{i}", PAGE.format(near)))
        cells = f"<table><tr><td>yes</td><td>{i}</td></tr></table>"
        rows.append((300 + i, f"https://t.example/{i}", PAGE.format(cells)))
    for i in range(400):
        rare = "<div><span>Seen seldom</span></div>" if i < 6 else ""
        rows.append((1000 + i, f"https://l.example/{i}", PAGE.format(f"{rare}<div><p>Text {i} itself.</p></div>")))
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in extract_pages(table, many_pages=5).collect()}
    for i in range(12):
        text = f"Title {i}\nText {i} of the article itself."
        assert got[i] == text and got[100 + i] == f"{text}\nRead our terms of use."
        assert got[200 + i] == f"Day {i}\nThe same long words of one article."
        assert got[300 + i] == f"yes\n{i}"
    assert all(got[1000 + i] == f"Text {i} itself." for i in range(400))


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (2, "", "<p>x"), (None, "not a url", "<p>y"), (3, "http://", "<" * 500), (4, "http://h", "<div>" * 3000 + "deep")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "hash", "template", "page", "text"):
        table = table.withColumn(name, table["page_id"])
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in extract_pages(table).collect()), key=str)
    assert got == sorted(
        [(1, "", 0), (2, "", 0), (2, "x", 1), (None, "y", 1), (3, "<" * 500, 500), (4, "deep", 4)], key=str
    )
    assert extract_pages(table.limit(0)).count() == 0


def brute_marks(text):
    """The smallest hash of each range, found one by one."""
    phrases: set[str] = set()
    rest = parse(text, phrases)
    hashes = sorted(phrase_hashes(phrases | ({rest} if rest else set())).tolist())
    if not hashes:
        return [0xFFFF] * HASHES
    shift, out = 64 - (HASHES.bit_length() - 1), []
    for place in range(HASHES):
        for away in range(HASHES):
            own = [h for h in hashes if h >> shift == (place + away) % HASHES]
            if own:
                mixed = (((own[0] << 8) + away) % 2**64 * 0x9E3779B97F4A7C15) % 2**64
                out.append(mixed >> 48)
                break
    return out


def test_likeness_is_that_of_all_marks(docs):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60, 200])))) for i in range(25)] + [(99, ""), (98, None)]
    got = {r["doc_id"]: r for r in fingerprint_documents(docs(rows, 3), rows_per_bucket=4).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    for (doc, text), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, other, following = (brute_marks(t) for t in (text, edited, after))
        assert got[doc]["near_edited"] == sum(a == b for a, b in zip(own, other, strict=True)) / HASHES
        assert got[doc]["near_next"] == sum(a == b for a, b in zip(own, following, strict=True)) / HASHES
        assert got[doc]["fingerprint"] == "".join(f"{m:04x}" for m in own)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 1000])
def test_ranges_of_ids(spark, n):
    cuts = [3 * i - 50 for i in range(n)]
    numbers = [-(1 << 63), -51, -50, -49, 0, 1, 2, 3, 2945, 2946, 2947, 2948, (1 << 63) - 1]
    df = spark.createDataFrame([(x,) for x in numbers], "x long")
    found = {r["x"]: r["n"] for r in df.select("x", range_of(df["x"], cuts).alias("n")).collect()}
    assert found == {x: sum(c <= x for c in cuts) for x in numbers}


def test_the_believed_score_counts_every_paragraph_not_trained_on(spark, docs, monkeypatch):
    seen = []
    known = license_scan.threshold

    def noted(likely, templates, n_held):
        seen.append(n_held)
        return known(likely, templates, n_held)

    monkeypatch.setattr(license_scan, "threshold", noted)
    # Eight documents of 30 paragraphs; at most one of each is drawn, and every fourth is not trained on.
    texts = [(i, "\n\n".join(f"word{i} thing{j} other{j % 7} stuff" for j in range(30))) for i in range(8)]
    assert scan_licenses(docs(texts)).count() == 0
    assert len(seen) == 1 and seen[0] >= 2 * 30 and seen[0] % 30 == 0


def test_at_most_the_false_rate_of_paragraphs_is_above_the_believed_score(spark):
    cases = [(True, 0.6 + i / 1000, "a few plain words") for i in range(40)]
    stated = [(True, 0.99, "licensed under the mit license") for _ in range(50)]
    taught = [(False, 0.98, "a few plain words") for _ in range(50)]
    likely = spark.createDataFrame([(h, s, t.split()) for h, s, t in cases + stated + taught], "held boolean, score double, words array<string>")
    templates = template_table(spark)
    for n_held, above in ((10_050, 10), (1_049, 0), (39_050, 39)):
        believed = license_scan.threshold(likely, templates, n_held)
        assert sum(s > believed for _, s, _ in cases) == above
    assert license_scan.threshold(likely, templates, 41_050) == license_scan.LIKELIER
    assert license_scan.threshold(likely.limit(0), templates, 0) == license_scan.LIKELIER


def test_licence_scores_are_those_of_the_weights(spark):
    """Every score once more from the fitted weights, feature by feature."""
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = train(training_rows(documents, template_table(spark), 300))
    weights, start = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    hashing = HashingTF(numFeatures=FEATURES)
    samples = [t.lower().split() for _, t in TEMPLATES[:12]] + [["the"], ["the", "the", "of"], ["licensed", "under", "nothing"]]
    samples += [r["text"].lower().split()[:40] for r in documents.filter("text != ''").limit(10).collect()]
    samples = [w for w in samples if w]
    table = spark.createDataFrame([(i, w) for i, w in enumerate(samples)], "i int, words array<string>")
    got = {r["i"]: (r["score"], r["label"]) for r in scored(model, table).collect()}
    for i, words in enumerate(samples):
        grams = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}
        z = start + weights[:, sorted({hashing.indexOf(g) for g in grams})].sum(axis=1)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = int(p[1:].argmax())
        assert got[i][0] == pytest.approx(1 - p[0], abs=1e-9)
        assert got[i][1] == (best + 1 if p[1 + best] > (1 - p[0]) / 2 else 0)
