import zlib

from pyspark.sql import functions as F
from strandline.llm import queries
from strandline.llm import warc


def pages(spark, n, change=None):
    data = [(k, f"http://h/{k}", f"<p>{k}</p>" + ("!" if change and k in change else "")) for k in range(n)] + [(n, None, None), (n + 1, "http://x/\r\n", "é"), (n + 1, "http://x/\r\n", "é")]
    return spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"file": F.lit("f"), "status": F.lit("s")})


def test_intact_damaged_missing(spark):
    ours = warc.as_records(pages(spark, 300), files=3)
    same = warc.fixity_report(ours, warc.as_records(pages(spark, 300), files=3))
    assert {r.status for r in same.collect()} == {"intact"} and same.count() == 303
    theirs = warc.as_records(pages(spark, 300), files=3)
    hurt = theirs.withColumn("digest", F.when(F.col("page_id").isin(7, 250), F.lit("0")).otherwise(F.col("digest")))
    got = {r.page_id: r.status for r in warc.fixity_report(ours, hurt).collect() if r.status != "intact"}
    assert got == {7: "damaged", 250: "damaged"}
    last = theirs.groupBy("file").agg(F.max("seq").alias("seq"))
    short = theirs.join(last, ["file", "seq"], "left_anti")
    got = [r.status for r in warc.fixity_report(ours, short).collect() if r.status != "intact"]
    assert got == ["missing"] * 3
    back = [r.status for r in warc.fixity_report(short, ours).collect() if r.status != "intact"]
    assert back == ["unexpected"] * 3


def test_offsets_and_empty(spark):
    got = warc.as_records(pages(spark, 20), files=1).orderBy("seq").collect()
    at = 0
    for r in got:
        assert r.offset == at
        at += r.length
    empty = warc.as_records(pages(spark, 5).where("false"))
    assert warc.fixity_report(empty, empty).count() == 0
    ours = warc.as_records(pages(spark, 5), files=1)
    assert {r.status for r in warc.fixity_report(ours, ours.where("false")).collect()} == {"missing"}


def test_replica_keeps_the_places_of_the_manifest(spark):
    data = pages(spark, 300)
    ours = warc.as_records(data, files=3)
    harmed = data.withColumn("html", F.when(F.col("page_id") == 7, F.lit("")).otherwise(F.col("html"))).where("page_id <> 120")
    harmed = harmed.unionByName(data.where("page_id = 9").withColumn("page_id", F.lit(-5).cast("long")))
    theirs = warc.as_replica(harmed, ours)
    got = sorted((r.page_id, r.status) for r in warc.fixity_report(ours, theirs).collect() if r.status != "intact")
    assert got == [(-5, "unexpected"), (7, "damaged"), (120, "missing")]


def test_replica_of_repeated_pages(spark):
    def copies(*texts):
        return spark.createDataFrame([(1, None, x) for x in texts], "page_id long, url string, html string")

    ours = warc.as_records(copies("a", "b", "b", "c"), files=1)
    for texts, want in ((("c", "b", "a", "b"), []), (("c", "x", "a", "b"), ["damaged"]), (("b", "b", "c"), ["missing"]), (("b", "a", "c", "b", "b"), ["unexpected"])):
        report = warc.fixity_report(ours, warc.as_replica(copies(*texts), ours)).collect()
        assert [r.status for r in report if r.status != "intact"] == want


def test_op10_finds_the_harmed_pages(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect():
        harm = zlib.crc32(str(r.page_id).encode())
        want[r.page_id] = "damaged" if harm % 53 == 0 and r.html else "missing" if harm % 97 == 0 and harm % 53 else "intact"
    got = queries.op10_warc_fixity(spark, sf).collect()
    assert {r.page_id: r.status for r in got} == want and len(got) == len(want)
