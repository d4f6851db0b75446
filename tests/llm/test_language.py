from pyspark.sql import functions as F

from screenlab.llm.language import declared_language, domain_of, identify, suffix_of, text_model, visible
from screenlab.llm.op04 import query


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("true"))
    found = query(spark, sf).cache()
    held = found.join(docs, "doc_id").filter("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1")
    assert held.agg(F.avg((F.col("lang") == F.col("true")).cast("int"))).first()[0] > 0.98
    pages = found.filter("page_id IS NOT NULL")
    assert pages.agg(F.avg((F.col("lang") == F.col("declared")).cast("int"))).first()[0] > 0.97
    assert found.count() == docs.count() + spark.read.parquet(f"{sf}/pages.parquet").count()


def test_evidence_decides_where_texts_do_not(spark):
    docs = [(k, "the cat and the dog " * 5, "en") for k in range(20)]
    docs += [(100 + k, "der hund und die katze " * 5, "de") for k in range(20)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    page = '<html lang="{}"><style>x</style><body>{}</body></html>'
    rows = [(k, "a.de", page.format("de", "der hund und die katze")) for k in range(30)]
    rows += [(50 + k, "b.com", page.format("en", "the cat and the dog")) for k in range(30)]
    rows += [(90, "a.de", page.format("de", "")), (91, "b.com", page.format("en", "")), (92, "a.de", None), (93, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, host string, text string")
    none = docs.limit(0).select("doc_id", F.lit(None).cast("long").alias("page_id"), F.lit("s").alias("host"), "text")
    marked = pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", "host", "text")
    got = {r["page_id"]: r["lang"] for r in identify(none, marked, text_model(docs)).collect()}
    assert len(got) == len(rows) and got[90] == "de" and got[91] == "en" and got[92] == "de"
    assert got[0] == "de" and got[55] == "en" and got[93] in ("de", "en")


def test_without_labels_there_is_no_language(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    texts = spark.createDataFrame([(1, 1, "h", "x")], "doc_id long, page_id long, host string, text string")
    rows = identify(texts, texts.limit(0), text_model(docs)).collect()
    assert [r["lang"] for r in rows] == [None]


def test_parts_of_pages_and_hosts(spark):
    html = "<!DOCTYPE html>\n<HTML class=x LANG='de-AT'><script>var a='<b>'</script><p>a&amp;b<br>c</p><!-- d --></HTML>"
    df = spark.createDataFrame([(html, "www.a.co.uk:80"), (None, None), ("<p>", "local")], "h string, u string")
    got = df.select(declared_language(F.col("h")), suffix_of(F.col("u")), domain_of(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("de", "uk", "co.uk:80"), ("", "", ""), ("", "", "")]
    assert visible(html).split() == ["a&b", "c"]


def test_declaration_stands_anywhere_in_the_page(spark):
    tag = "<html class=x lang='de'><body lang=fr>x</body></html>"
    pages = [
        "<!-- " + "x" * 10000 + " -->" + tag,
        "\n" * 9000 + tag,
        " " * 4080 + tag,
        "<!-- <html lang=fr> -->" + tag,
        "<!--[if gt IE 8]><!-->" + tag + "<!--<![endif]-->",
        "<html><p>&lt;</p><script>var a='<html lang=fr>'</script></html>",
        "<!-- " + "<!-- " * 20000 + "<html lang=fr>",
    ]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(pages)], "k long, h string")
    got = [r[0] for r in df.orderBy("k").select(declared_language(F.col("h"))).collect()]
    assert got == ["de"] * 5 + ["", ""]
