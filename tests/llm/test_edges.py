"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib

import pytest

from tests.llm.helpers import documents, edge_rows, prose
from textmine.llm import (
    chat_format, decontaminate, ngram_join, piece_codec, quality_classifier, quality_rules, secret_scan,
    substring_dedup, url_filter, warc)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, edge_rows())


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def ids(df):
    return sorted(df.select("doc_id").collect(), key=lambda r: (r[0] is None, r[0] or 0))


def same_ids(a, b):
    return [r[0] for r in ids(a)] == [r[0] for r in ids(b)]


def test_quality_rules(docs, none):
    out = quality_rules.apply_rules(docs)
    assert same_ids(out, docs)
    by = {r.doc_id: r for r in out.collect()}
    for i in (1, 2, 3):
        assert (by[i].n_words, by[i].word_chars, by[i].n_repeat_words, by[i].base_failed, by[i].kept) == (0, 0, 0, True, False)
    assert by[10].n_dup_lines == 2 and by[10].n_words == 3 and by[10].n_repeat_words == 0
    assert by[9].word_chars == 7 and by[7].n_words == 20_000
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and good.filter("doc_id = 5").count() == 2
    assert quality_rules.apply_rules(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_secret_scan(docs, none):
    ledger = secret_scan.scan_unseen(docs)
    assert ledger.count() == docs.selectExpr("coalesce(text, '') t").distinct().count()
    found = secret_scan.digest(secret_scan.findings(docs, ledger))
    assert same_ids(found, docs)
    assert {(r.n_assign, r.spans, r.base_sha256) for r in found.collect()} == {(0, "", hashlib.sha256(b"").hexdigest())}
    assert secret_scan.redact(docs, ledger).exceptAll(docs).count() == 0
    assert secret_scan.findings(none, secret_scan.scan_unseen(none)).count() == 0


def test_piece_codec(docs, none):
    out = piece_codec.encode(docs, chunk=256)
    assert same_ids(out, docs)
    by = {r.doc_id: r for r in out.collect() if r.doc_id}
    assert by[1].ids is None and by[1].n_tokens == 0 and by[2].ids == [] and by[2].n_tokens == 0
    back = {r.doc_id: r.text for r in piece_codec.decode(out).collect() if r.doc_id}
    want = dict(edge_rows())
    assert all(back[i] == want[i] for i in back if i != 9) and back[9] == "é ß 日本 😀  x"
    assert piece_codec.encode(none).count() == 0


def test_ngram_join(docs, none):
    out = ngram_join.join(docs)
    assert same_ids(out, docs)
    rows = out.collect()
    by = {r.doc_id: r for r in rows}
    assert all((r.class_id, r.n_links) == (None, 0) for r in rows if r.doc_id is None)
    assert all((by[i].class_id, by[i].n_links) == (i, 0) for i in (1, 2, 3, 4, 7, 9, 10))
    assert {(by[i].class_id, by[i].n_links) for i in (5, 6, 8)} == {(5, 2)}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert [r[0] for r in ids(kept)] == [1, 2, 3, 4, 5, 7, 9, 10, None, None]
    assert ngram_join.join(none).count() == 0 and ngram_join.keep_one(none).count() == 0


def test_substring_dedup(docs, none):
    out = substring_dedup.dedup(docs)
    assert same_ids(out, docs)
    rows = out.collect()
    assert all(r.n_removed == 0 for r in rows if r.doc_id in (None, 1, 2, 3, 4, 5, 7, 9, 10))
    by = {r.doc_id: r for r in rows}
    assert (by[6].n_removed, by[6].kept) == (60, "") and by[6].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert (by[8].n_removed, by[8].kept) == (60, "tail")
    assert substring_dedup.dedup(none).count() == 0


def test_decontaminate(spark, docs, none):
    item = dict(edge_rows())[5]
    bench = spark.createDataFrame([(0, item, "x"), (1, None, "x"), (2, "", "x"), (None, "one two", "x")],
                                  "item_id long, text string, doc_id string")
    out = decontaminate.search(docs, bench)
    assert sorted({(r.doc_id or -1, r.item_id) for r in out.collect()}, key=str) == sorted(
        {(4, None), (5, 0), (6, 0), (8, 0), (-1, 0)}, key=str)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and [r[0] for r in ids(clean)] == [1, 2, 3, 7, 9, 10, None]
    assert decontaminate.search(none, bench).count() == 0
    assert decontaminate.search(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_quality_classifier(spark, docs, none):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    rows, sizes = quality_classifier.sample(docs, labels, "doc_id", "text", 10, 100)
    model = quality_classifier.fit(rows, sizes)
    out = quality_classifier.score(docs, model)
    assert same_ids(out, docs) and all(0 <= r.score <= 1 for r in out.collect())
    assert quality_classifier.score(none, quality_classifier.fit([])).count() == 0


def test_warc(spark, tmp_path):
    body = "x" * 200
    rows = [(1, "u1", body), (2, None, body), (2, "u2", body), (3, "u\r\n3", "tiny"), (4, "u4", "tiny"), (5, "u5", None),
            (None, "u6", body), (6, "u7", "é" * 60), (1, "u1", body)]
    pages = spark.createDataFrame([(*r, "d", "p") for r in rows], "page_id long, url string, html string, digest string, payload string")
    path = f"{tmp_path}/a"
    warc.write_archive(pages, path)
    out = warc.read_records(spark, path).collect()
    want = {(1, 200, "response", None), (2, 200, "revisit", 1), (3, 4, "response", None), (4, 4, "response", None),
            (5, 0, "response", None), (None, 200, "response", None), (6, 120, "response", None)}
    assert {(r.key, r.payload_bytes, r.record_type, r.refers_to) for r in out} == want and len(out) == len(rows)
    empty = f"{tmp_path}/b"
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_records(spark, empty).count() == 0


def test_url_filter(spark):
    urls = [(1, "http://A.Example.com/en/1?x#y"), (2, None), (3, "no scheme"), (4, "ftp://X.NET"), (5, "http://net/es/"),
            (6, "http://www.example.com/en/2"), (7, "http://example.com:80/en/"), (None, "http://É.ORG/Ab/?q"), (1, "http://A.Example.com/en/1?x#y")]
    pages = spark.createDataFrame([(*u, "h", "p") for u in urls], "page_id long, url string, host string, path string")
    labels = spark.createDataFrame([], "label_id long, good int")
    out = url_filter.judge(pages, labels).collect()
    assert len(out) == len(urls)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert got == {
        1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("x.net", "", None, "allow"), 5: ("net", "/es/", "net/es/", "block"),
        6: ("www.example.com", "/en/2", "www.example.com/en/", "allow"),
        7: ("example.com:80", "/en/", None, "allow"), None: ("É.org", "/Ab/", None, "allow")}
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_chat_format(spark):
    rows = [(1, 0, "user", "hi?"), (1, 1, "assistant", "a\nb"), (1, 1, "assistant", "a\nb"), (2, None, None, None), (None, 3, "User ", ""),
            (3, 0, "robot", "Assistant: x"), (4, 0, "system", "s" * 5000)]
    chats = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, block string")
    out = {(r.conv_id, r.turn, r.role, r.rendered) for r in chat_format.format_chats(chats).collect()}
    assert (1, 0, "user", "<|user|>\nhi?<|end|>") in out and (1, 1, "assistant", "<|assistant|>\na\nb<|end|>") in out
    assert (3, 0, "assistant", "<|assistant|>\nx<|end|>") in out and (None, 3, "user", "<|user|>\n<|end|>") in out
    assert any(c == 2 for c, *_ in out)
    assert chat_format.format_chats(chats.limit(0)).count() == 0


def test_very_long_text(spark):
    import random

    text = prose(random.Random(9), 150_000)
    df = documents(spark, [(1, text), (2, "pre " + text)])
    assert quality_rules.counts(df).select("n_words").distinct().count() == 2
    cut = {r.doc_id: r.n_removed for r in substring_dedup.dedup(df).collect()}
    assert cut == {1: 0, 2: 150_000}
    assert {r.class_id for r in ngram_join.join(df).collect()} == {1}
