"""Record lines (S2, S3, trap 10)."""

from bitdex.sources import corpus as cs


def test_parse_records_first_two_tabs(spark, tmp_path):
    p = tmp_path / "rec.tsv"
    p.write_bytes(b"1\tA title\tbody one\twith tab\n2\tno body\n3\tT\tcr kept\r\n"
                  b"only\n4\t\tlast line")
    got = [tuple(r) for r in cs.read_records(spark, str(p)).collect()]
    assert got == [("1", "A title", "body one\twith tab"), ("3", "T", "cr kept\r"),
                   ("4", "", "last line")]


def test_record_lines_clean_title(spark):
    df = spark.createDataFrame([(7, "a\tb\nc", "body")], "id long, title string, body string")
    assert cs.record_lines(df).first()[0] == "7\ta b c\tbody"


def test_write_and_read_records(spark, sf001, tmp_path):
    docs = cs.documents_corpus(spark, sf001).selectExpr("id", "title", "replace(text, '\\n', ' ') AS body")
    cs.write_records(docs, str(tmp_path / "r"))
    got = sorted((int(r.id), r.title, r.text) for r in cs.read_records(spark, str(tmp_path / "r")).collect())
    assert got == sorted((r.id, r.title.replace("\t", " "), r.body) for r in docs.collect())


def test_read_corpus_prunes(spark, sf001):
    df = cs.read_corpus(spark, f"{sf001}/documents.parquet", id="doc_id", title="source")
    assert df.columns == ["id", "title", "text"] and df.count() == 200
