import pytest
from pyspark.sql import functions as F

from tessera.sources import files, stores
from tessera.streaming import ingest


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("héllo\x00".encode())
    (tmp_path / "sub/b.md").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.exe").write_bytes(b"MZ")
    return tmp_path


def test_reading(spark, folder):
    assert files.listing(spark, str(folder)).count() == 3
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.encoding) for r in files.read_texts(spark, str(folder)).collect()}
    assert got["a.txt"] == ("héllo", "utf-8") and got["b.md"] == ("café", "latin-1")
    named = files.listing(spark, str(folder)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    refused = {r.name for r in files.check_uploads(named).where("size(errors) > 0").collect()}
    assert refused == {"c.exe"}
    parts = files.route(files.listing(spark, str(folder)))
    assert {k: v.count() for k, v in parts.items()} == {"text": 2, "document": 0, "other": 1}


def test_routing(spark):
    df = spark.createDataFrame([(0, True), (3, True), (10, True), (11, True), (1, False)], "images int, has_text boolean")
    assert [len(r[0]) for r in df.select(files.parsers_for(F.col("images"), F.col("has_text"))).collect()] == [1, 2, 2, 1, 2]
    a = spark.createDataFrame([(1, "t", 0.9), (2, "u", 0.5)], "doc_id int, text string, confidence double")
    b = spark.createDataFrame([(1, "v", 0.4)], "doc_id int, text string, confidence double")
    got = {r.doc_id: (r.text, r.confidence) for r in files.merge_parses(a, b).collect()}
    assert got[1][1] == 0.75 and got[1][0].endswith("v") and got[2] == ("u", 0.5)
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc_id int, page int, text string")
    assert files.page_text(pages).first().text == "\n--- Page 1 ---\na\n--- Page 2 ---\nb"
    ranges = files.page_ranges(spark.createDataFrame([(1, 120), (2, 30)], "doc_id int, pages int")).orderBy("doc_id", "first_page").collect()
    assert [(r.first_page, r.last_page) for r in ranges] == [(1, 50), (51, 100), (101, 120), (1, 30)]
    with pytest.raises(KeyError):
        files.get_parser("none")


def test_chunk_sink_replaces_documents(spark, tmp_path):
    path = str(tmp_path / "chunks")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, chunk_index int, chunk_text string")
    stores.write_chunks(make([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]), path, n=2)
    stores.write_chunks(make([(1, 0, "new")]), path, n=2)
    got = sorted((r.doc_id, r.chunk_index, r.chunk_text) for r in spark.read.parquet(path).collect())
    assert got == [(1, 0, "new"), (2, 0, "c")]


def test_vector_store(spark, tmp_path):
    store = stores.get_store("parquet", spark=spark, path=str(tmp_path / "v"), dim=2)
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, version long")
    store.index(make([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)]))
    store.index(make([(1, [0.0, 1.0], 2)]))
    store.delete(spark.createDataFrame([(2,)], "vec_id long"), 3)
    assert store.count() == 1
    q = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, vector array<float>")
    assert [(r.vec_id, r.similarity) for r in store.search(q).collect()] == [(1, 1.0)]
    with pytest.raises(ValueError, match="finite"):
        store.index(make([(3, [1.0], 1)]))
    with pytest.raises(KeyError):
        stores.get_store("none")


def test_storing_documents(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'w' AS workspace, 'a.txt' AS name, binary('x') AS content, timestamp'2024-02-03' AS at UNION ALL SELECT 1L, 'w', 'a.txt', binary('y'), timestamp'2024-02-03'")
    old = spark.sql("SELECT sha2(binary('y'), 256) AS checksum, 'elsewhere' AS storage_path")
    got = sorted((r.storage_path, r.is_duplicate) for r in stores.store_documents(df, old).collect())
    assert [p for p, _ in got] == ["w/2024/02/1/a.txt", "w/2024/02/1/a_1.txt"] and sorted(d for _, d in got) == [False, True]


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sql("SELECT 1L AS doc_id, repeat('Words stand here. ', 20) AS text, timestamp'2024-01-01' AS at").write.parquet(src)
    stream = ingest.documents(spark, src)
    for _ in range(2):  # a second run finds nothing new
        q = ingest.chunk_stream(stream, out, str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert spark.read.parquet(out).where("doc_id = 1").count() == 1
    day = ingest.upload_trend(stream).writeStream.format("memory").queryName("trend").outputMode("complete").trigger(availableNow=True).start()
    day.awaitTermination(120)
    assert [r.uploads for r in spark.sql("SELECT * FROM trend").collect()] == [1]


def test_chunk_buckets_follow_the_size(spark, tmp_path):
    make = lambda ids: spark.createDataFrame([(i, 0, f"text {i}") for i in ids], "doc_id long, chunk_index int, chunk_text string")
    path = f"{tmp_path}/chunks"
    stores.write_chunks(make(range(100)), path, bucket_rows=10)
    assert len({p for p in (tmp_path / "chunks").iterdir() if p.name.startswith("bucket=")}) == 10
    stores.write_chunks(make(range(90, 130)), path, bucket_rows=1000)  # the noted number holds
    got = spark.read.parquet(path)
    assert got.count() == 130 and got.select("bucket").distinct().count() == 10
