"""Edge cases and brute-force versions that the other files of this folder do not hold."""

import base64
import gzip
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, crf, decontam, jaccard, langid, ogg, packing, queries, sst, urlgbt, warc
from tests.llm.test_documents import brute_classes, got_classes, near_copies
from tests.llm.test_html_visibility import _Plain

# WARC -----------------------------------------------------------------------------------


def http(head, body):
    return warc.record("response", [("WARC-Record-ID", "<urn:uuid:1>")], b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body)


PAGE = b"<p>caf\xc3\xa9 &amp; more</p>"
CHUNKED = b"4;x=1\r\n<p>h\r\n2\r\ni!\r\n0\r\n\r\n"
RAW = zlib.compressobj(wbits=-15)
RAW = RAW.compress(PAGE) + RAW.flush()


@pytest.mark.parametrize(
    ("head", "body", "text"),
    [
        (b"Content-Type: text/html", PAGE, "café & more"),
        (b"Content-Type: text/html\r\nContent-Encoding: gzip", gzip.compress(PAGE), "café & more"),
        (b"Content-Type: text/html\r\nContent-Encoding: x-gzip", gzip.compress(PAGE[:5]) + gzip.compress(PAGE[5:]), "café & more"),
        (b"Content-Type: text/html\r\nContent-Encoding: deflate", zlib.compress(PAGE), "café & more"),
        (b"Content-Type: text/html\r\nContent-Encoding: deflate", RAW, "café & more"),
        (b"Transfer-Encoding: chunked", CHUNKED, "hi!"),
        (b"Transfer-Encoding: gzip, chunked", b"%x\r\n" % len(gzip.compress(PAGE, mtime=0)) + gzip.compress(PAGE, mtime=0) + b"\r\n0\r\n\r\n", "café & more"),
        (b"Content-Type: text/plain; charset=latin-1", b"caf\xe9", "café"),
        (b"Content-Type: application/xhtml+xml", b"<p>x</p>", "x"),
    ],
)
def test_codings_are_undone(head, body, text):
    meta, conv = warc.derive(http(head, body))
    assert warc.parse(conv["record"])[1].decode() == text and meta["error"] is None


@pytest.mark.parametrize(
    ("head", "body"),
    [
        (b"Content-Type: image/png", b"\x89PNG"),
        (b"Content-Type: text/html\r\nContent-Encoding: br", b"x"),
        (b"Content-Type: text/html\r\nContent-Encoding: gzip", gzip.compress(PAGE)[:-4]),
        (b"Content-Type: text/html\r\nContent-Encoding: gzip", PAGE),
        (b"Transfer-Encoding: chunked", b"zz\r\nx\r\n"),
        (b"Transfer-Encoding: chunked", b"5\r\nabc"),
        (b"Content-Type: text/html; charset=no-such", b"x"),
    ],
)
def test_what_is_no_text_has_an_error(head, body):
    out = warc.derive(http(head, body))
    assert [d["record_type"] for d in out] == ["metadata"] and out[0]["error"]
    assert b"error: " in out[0]["record"]


def test_urls_cannot_break_records_and_bodies_differ():
    raw = warc.response("http://a/x\r\nEvil: y\x00", "b", "1", "2024-01-01T00:00:00Z")
    meta, conv = warc.derive(raw)
    assert meta["target_uri"] == "http://a/x%0D%0AEvil:%20y%00" and warc.parse(conv["record"])[1] == b"b"
    other = warc.derive(warc.response("http://a/x", "c", "1", "2024-01-01T00:00:00Z"))
    assert other[0]["record_id"] != warc.derive(warc.response("http://a/x", "b", "1", "2024-01-01T00:00:00Z"))[0]["record_id"]


def test_derivatives_of_whole_pages(spark, sf_dir):
    """Digests, lengths and links from the bytes, and the letters of an independent parser."""
    pages = {p.page_id: p for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for d in queries.op1_warc_derivatives(spark, sf_dir).collect():
        head, _, rest = bytes(d.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        assert rest == block + b"\r\n\r\n" and fields["WARC-Type"] == d.record_type and fields["WARC-Refers-To"] == d.refers_to
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        body = (pages[d.page_id].html or "").encode()
        assert d.source_payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        if d.record_type == "conversion":
            plain = _Plain()
            plain.feed(body.decode())
            plain.close()
            marks = r"\s+|(?m:^\s*(?:-|\d+\.) )|\|"  # blanks, list marks and cell borders are layout
            assert re.sub(marks, "", block.decode()) == re.sub(marks, "", "".join(plain.words))


@pytest.mark.parametrize("unit", ["<", "<a ", "<!--", "</p", "<script ", "&", "<td"])
def test_plain_text_of_pathological_pages(unit):
    import time

    began = time.process_time()
    warc.plain_text(unit * 200_000)
    assert time.process_time() - began < 5


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('A <a title="a > b">link</a>', "A link"),
        ("<p hidden>no</p><p style='display:none'>no</p><style>.x p{display:none}</style><div class=x><p>no</p></div>yes", "yes"),
        ("<svg><text>label</text></svg> <math><mi>x</mi></math>", "label x"),
        ("<table><tr><td>a<td>b<tr><td>cc<td>d</table><ol><li>one<li>two</ol>", "a  | b\ncc | d\n\n1. one\n2. two"),
        ("<pre>a\n  b</pre>", "a\n  b"),
    ],
)
def test_conversion_shows_what_a_reader_sees(html, text):
    _, conv = warc.derive(warc.response("http://a/x", html, "1", "2024-01-01T00:00:00Z"))
    assert warc.parse(conv["record"])[1].decode() == text


def test_conversion_of_plain_text_keeps_it():
    _, conv = warc.derive(http(b"Content-Type: text/plain", b"a <b> c\n  d"))
    assert warc.parse(conv["record"])[1] == b"a <b> c\n  d"


def test_warc_extra_column(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x", b"other", "e")], "page_id long, url string, html string, record binary, error string")
    assert [r.error for r in warc.build_derivatives(warc.pages_to_responses(df)).collect()] == [None, None]


# URLs -----------------------------------------------------------------------------------


def walk(tree, row, node=0):
    """A tree's value for one row, by recursion."""
    if 2 * node + 1 >= len(tree.feature):
        return tree.value[node]
    return walk(tree, row, 2 * node + (2 if row[tree.feature[node]] > tree.cut[node] else 1))


def test_trees_rank_unseen_hosts(spark, sf_dir):
    urls = sorted({r.url for r in spark.read.parquet(f"{sf_dir}/../sf0.1/pages.parquet").select("url").collect()})
    blocked, weights = urlgbt.policy_labels(urls)
    assert urlgbt.held_out_auc(urls, blocked, weights) > 0.9
    model = urlgbt.fit(urls, blocked, weights)
    x = np.array([urlgbt.lexical(u, *urlgbt.split_url(u), model.stats) for u in urls[:200]])
    z = [model.base + model.rate * sum(walk(t, row) for t in model.trees) for row in x]
    assert np.allclose(model.blocked(x), 1 / (1 + np.exp(-np.array(z))))


def test_labels_of_the_caller(spark):
    rows = [(f"http://h{k}-{k}.example.com/" if k % 3 == 0 else f"http://word{k}.example.com/", k % 3 == 0) for k in range(300)] + [("http://odd.example.org/", None), (None, True)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    model = urlgbt.train(labelled, labelled=labelled)
    pages = spark.createDataFrame([(1, "http://x7-9.example.com/"), (2, "http://other.example.com/")], "page_id long, url string")
    assert [r.verdict for r in urlgbt.judge(pages, model).orderBy("page_id").collect()] == ["block", "allow"]


def test_auc_by_counting_pairs():
    rng = np.random.default_rng(3)
    s, y, w = rng.integers(0, 5, 40) / 5, rng.random(40) < 0.4, rng.random(40)
    pairs = [(w[i] * w[j], (s[i] > s[j]) + (s[i] == s[j]) / 2) for i in range(40) for j in range(40) if y[i] and not y[j]]
    assert np.isclose(urlgbt.auc(s, y, w), sum(a * b for a, b in pairs) / sum(a for a, _ in pairs))


def test_long_url(spark):
    url = "http://a.example.com/" + "x/" * 500_000 + "?" + "a=1&" * 100_000
    df = spark.createDataFrame([(1, url, "p", "v")], "page_id long, url string, path string, verdict string")
    assert urlgbt.judge(df, urlgbt.train(df)).collect()[0].path == "/" + "x/" * 500_000


# Decontamination ------------------------------------------------------------------------


def find(spark, docs, items, **o):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.find(d, b, **o).collect()}


def test_short_items_stand_alone(spark):
    items = [(1, "Is it raining?"), (2, "yes"), (3, "What is 17 + 25 + 36 + 40 ?"), (4, "What is 17 + 25 + 36 + 40 + 51 ?")]
    docs = [
        (1, "It was late. Is it raining? Nobody knew."),
        (2, "he asked if is it raining there, or not"),
        (3, "first line\nis it raining\nlast line"),
        (4, "She said yes to it. And yes, again."),
        (5, "Well. Yes! And so on."),
        (6, "Sums: What is 17 + 25 + 36 + 40 ? and others, or What is 17 + 25 + 36 + 40 + 51 ? too"),
        (7, "is it raining"),
    ]
    for broadcast in (500_000, 0):
        assert find(spark, docs, items, short_alone=True, broadcast_windows=broadcast) >= {(1, 1), (3, 1), (5, 2), (7, 1), (6, 3), (6, 4)}
        assert not find(spark, docs, items, short_alone=True, broadcast_windows=broadcast) & {(2, 1), (4, 2)}
    assert not find(spark, docs, items) & {(1, 1), (3, 1), (5, 2), (7, 1)}


def test_consistency_goes_both_ways(spark):
    item = "Anyone can see that adding {} to the number {} in a list gives a sum for the whole of the class."
    docs = [(1, "x. " + item.format(5, 8)), (2, "x. " + item.format(6, 6)), (3, "x. " + item.format(12, 30))]
    assert find(spark, docs, [(1, item.format(12, 30))]) == {(1, 1), (3, 1)}


def test_scripts_without_blanks(spark):
    item = "请问这座城市有多少人口呢"
    docs = [(1, "开头是这样的" + item + "然后结束了"), (2, "这里没有任何相同的内容可以找到")]
    assert find(spark, docs, [(1, item)]) == {(1, 1)}


def plain_words(text):
    return re.sub(r"[^a-z ]+", " ", (text or "").lower()).split()


def test_brute_force_over_plain_words(spark, sf_dir):
    """Without numbers and capitals, an item is found where three in ten of its five-word windows, and two at least, occur."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    texts = [(d.doc_id, " ".join(plain_words(d.text))) for d in docs]
    items = [(b.item_id, " ".join(plain_words(b.text))) for b in bench]
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)}
    want = set()
    held = [(i, grams(t)) for i, t in texts]
    for j, t in items:
        w = t.split()
        own = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for i, g in held:
            n = sum(x in g for x in own)
            if own and n / len(own) >= 0.3 and n >= min(2, len(own)):
                want.add((i, j))
    assert want and find(spark, texts, items) == want and find(spark, texts, items, broadcast_windows=0) == want


def test_decontamination_columns_and_long_text(spark):
    text = "many plain words fill this line up " * 20_000
    item = "an item of more than ten plain words that is to be found in it"
    docs = spark.createDataFrame([(1, text + item, 1.0, "h"), (2, text, 2.0, "h")], "doc_id long, text string, coverage double, hash string")
    bench = spark.createDataFrame([(1, item, "x")], "item_id long, text string, slots string")
    assert [(r.doc_id, r.coverage) for r in decontam.find(docs, bench).collect()] == [(1, 1.0)]


# Training -------------------------------------------------------------------------------


def test_training_gives_the_drivers_memory_back(spark, sf_dir, monkeypatch):
    docs, labels, trimmed = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), []
    monkeypatch.setattr(crf, "trim", lambda: trimmed.append("crf"), raising=False)
    monkeypatch.setattr(langid, "trim", lambda: trimmed.append("langid"), raising=False)
    crf.train(docs, labels, sample_rows=50)
    langid.train(docs, sample_rows=50)
    assert trimmed == ["crf", "langid"]


# N-gram join ----------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{"hot_rows": 2}, {"hot_rows": 2, "rounds": 0, "pivots": 1, "block_pairs": 40, "cross_factor": 0}, {"hot_rows": 1, "rounds": 0, "hot_share": 0.1, "hot_least": 2, "slice_bytes": 3000}])
def test_jaccard_dealt_shingles_and_blocks(spark, options):
    passage = " ".join(f"shared{k}" for k in range(55))
    data = near_copies() + [(i, f"{passage} " + " ".join(f"own{i}_{k}" for k in range(i % 25))) for i in range(50)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert got_classes(df, **options) == brute_classes(data)


def test_jaccard_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op5_ngram_jaccard"]).fetchall())
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op5_ngram_jaccard(spark, sf_dir).collect()) == want


def test_partial_overlaps_sum_to_the_overlap(spark):
    lists = spark.createDataFrame([(1, [[1, 2], [], [7], [9]]), (2, [[2, 3], [5], [7], [9, 10]]), (3, [[4], [], [], []])], "doc long, parts array<array<long>>")
    pairs = spark.createDataFrame([(1, 2, 4, 6), (1, 3, 4, 1)], "x long, y long, mx int, my int")
    assert [(r.x, r.y, r.overlap) for r in jaccard.overlaps(pairs, jaccard.cells(lists)).collect()] == [(1, 2, 3)]


def test_keep_one_of_equal_identifiers(spark):
    df = spark.createDataFrame([(1, "b b"), (1, "a a"), (2, "c"), (None, "d"), (None, "e")], "doc_id long, text string")
    got = jaccard.keep_one(df, jaccard.join(df)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "d"), (0, "e"), (1, "a a"), (2, "c")]


# The others -----------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "letter"), [(None, False), ("", False), ("12 ½ ² _", False), ("½ x", True), ("日", True), ("Ⅷ", False)])
def test_letters(text, letter):
    assert langid.has_letter(text) == letter == any(c.isalpha() for c in text or "")


def test_number_characters_are_no_language():
    model = langid.fit(["the cat and the dog sat here", "der hund und die katze waren da"] * 20, ["en", "de"] * 20, buckets=1 << 12)
    assert model.predict(["½", "² 3"])[0] == ["und", "und"]


def test_repeated_rows_spread_over_buckets(spark):
    df = spark.createDataFrame([(1, "one and the same text")] * 400, "doc_id long, text string")
    pieces = packing._cut(df, queries.TOKENIZER, "doc_id", "text", 1024)
    buckets = pieces.select(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "deal"), F.lit(8)).alias("b")).groupBy("b").count().collect()
    assert len(buckets) == 8 and max(r["count"] for r in buckets) < 120
    got = packing.pack_documents(df, queries.TOKENIZER, bucket_pieces=50).collect()
    assert len(got) == 400 and {c for r in got for c in r.asDict()} >= {"doc_id", "sequence_id", "offset"}


def test_samples_are_bounded_by_bytes(spark):
    rows = spark.createDataFrame([(k, "x" * 100) for k in range(50)] + [(99, "y" * 10_000)], "id long, text string")
    assert len(common.bounded_sample(rows, 20, 20_000)) == 20
    got = common.bounded_sample(rows, 50, 1000)
    assert len(got) == 10 and sum(len(r["text"]) for r in got) <= 1000
    assert common.bounded_sample(rows.where("false"), 5, 5) == []


def test_scratch_is_dropped(spark, tmp_path):
    mark = common.Scratch.mark()
    one = common.Scratch(spark, "kept")
    one.put(spark.range(3), "a")
    import os

    at = one.root.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(at)
    common.Scratch.drop_since(mark)
    assert not os.path.isdir(at)


@pytest.mark.parametrize("operator", ["ogg", "sst", "crf", "langid", "packing"])
def test_clashing_columns(spark, operator):
    df = spark.createDataFrame([(1, "a text of words", "m", "f", 1, 2, "s")], "doc_id long, text string, media string, feature string, start int, n_tokens int, score string")
    out = {
        "ogg": lambda: ogg.decode_media(ogg.encode_texts(df)),
        "sst": lambda: sst.export(df, queries.TOKENIZER),
        "crf": lambda: crf.score(df, crf.fit(["good words", "BAD"] * 5, [1, 0] * 5)),
        "langid": lambda: langid.predict(df, langid.fit(["some words"] * 5, ["en"] * 5, buckets=1 << 8)),
        "packing": lambda: packing.pack_documents(df, queries.TOKENIZER),
    }[operator]()
    assert [r.doc_id for r in out.collect()] == [1]


def test_pipeline_takes_columns_of_any_name(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("a.b", F.lit(1)).withColumn("component_id", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
