"""WARC fixity: Merkle trees over the records of archive files, and an audit of replicas.

Pages become WARC records; records are dealt to files and have an offset and a length in their
file. A record's digest is a leaf; a node of the next level is the digest of ``FANOUT`` successive
ranges with their offsets, lengths and digests, up to one root for each file. File, place and
offset are those of one manifest, our records; a replica's digests are joined to it by record.
Two replicas are compared from the roots down: only children of nodes that differ are joined, so an audit of
intact files reads one digest for each file, and a damaged record is found in as many steps as
its tree has levels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

FANOUT = 16
RECORDS_PER_FILE = 1000


def warc_record(page_id: Column, url: Column, html: Column, date: str = "1970-01-01T00:00:00Z") -> Column:
    """A WARC/1.1 resource record as text; nulls are empty. Content-Length counts UTF-8 bytes; pages that do not say when they were fetched have one fixed ``date``."""
    body = F.coalesce(html, F.lit(""))
    lines = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " "),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    ]
    return F.concat(*lines)


def _leaves(pages: DataFrame, files: int) -> DataFrame:
    """page_id, url, file, length and digest of each row's record."""
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    raw = pages.select("page_id", url.alias("url"), F.encode(warc_record(F.col("page_id"), url, html), "UTF-8").alias("record"))
    raw = raw.withColumn("file", F.pmod(F.xxhash64("page_id", "url"), F.lit(files)).cast("int"))
    return raw.select("page_id", "url", "file", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))


def _numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with seq (place in the file) and offset."""
    order = Window.partitionBy("file").orderBy("page_id", "url", "digest")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return leaves.withColumns({"seq": (F.row_number().over(order) - 1).cast("long"), "offset": F.coalesce(before, F.lit(0)).cast("long")})


def as_records(pages: DataFrame, files: int | None = None) -> DataFrame:
    """page_id, url, file, length, digest, seq (place in the file) and offset of each row's record.

    Files hold about RECORDS_PER_FILE records, dealt by a hash of the page's id and URL; in a
    file, records are ordered by page_id, then URL, then digest. Nulls sort first. Only lengths
    are shuffled to number the records, not their content.
    """
    return _numbered(_leaves(pages, files or max(1, math.ceil(pages.count() / RECORDS_PER_FILE))))


def as_replica(pages: DataFrame, manifest: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Records of a replica's ``pages``, with file, seq and offset of the record of ``manifest`` that each should be.

    A record that changed its length or is gone thus moves no other. Records are told by page_id
    and URL (nulls are equal). Where these repeat, records of equal digests are paired first, and
    those left over by their order. What ``manifest`` (the columns of ``as_records``) does not
    list is put behind the end of its file.
    """
    scratch = scratch or Scratch(pages.sparkSession, "replica")
    files = (manifest.agg(F.max("file")).first()[0] or 0) + 1
    ours = manifest.select("page_id", "url", "file", "length", "digest", "seq", "offset", F.lit(False).alias("theirs"))
    theirs = _leaves(pages, files).withColumns({"seq": F.lit(None).cast("long"), "offset": F.lit(None).cast("long"), "theirs": F.lit(True)})
    both = ours.unionByName(theirs).repartition("page_id", "url")
    both = both.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "url", "digest", "theirs").orderBy("seq")))
    both = both.withColumn("paired", F.count("*").over(Window.partitionBy("page_id", "url", "digest", "n")) == 2)
    both = both.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "url", "theirs", "paired").orderBy("digest", "n")))
    own = lambda c, side: F.max(F.when(F.col("theirs") == side, F.col(c))).alias(c)
    placed = both.groupBy("page_id", "url", "paired", "k").agg(
        F.coalesce(own("file", False), F.max("file")).alias("file"), own("length", True), own("digest", True), own("seq", False), own("offset", False)
    )
    placed = scratch.keep(placed.where("digest is not null").drop("paired", "k"), "placed")
    ends = manifest.groupBy("file").agg((F.max("seq") + 1).alias("last"), F.max(F.col("offset") + F.col("length")).alias("end"))
    more = _numbered(placed.where("seq is null").drop("seq", "offset")).join(ends, "file", "left")
    more = more.withColumns({"seq": F.col("seq") + F.coalesce("last", F.lit(0)), "offset": F.col("offset") + F.coalesce("end", F.lit(0))}).drop("last", "end")
    return placed.where("seq is not null").unionByName(more)


def merkle_tree(leaves: DataFrame, scratch: Scratch, fanout: int = FANOUT, label: str = "tree") -> tuple[DataFrame, int]:
    """Nodes (file, level, node, digest) over leaves (file, seq, offset, length, digest), and the level of the roots.

    Level 0 holds the records. Each level is one aggregation of at most ``fanout`` children a node.
    """
    largest = leaves.agg(F.max("seq")).first()[0]
    top = 0 if largest is None else max(1, math.ceil(math.log(largest + 1, fanout) - 1e-9))
    own = F.sha2(F.concat_ws("|", F.lit("leaf"), "offset", "length", "digest"), 256)
    level = leaves.select("file", F.col("seq").alias("node"), own.alias("digest"))
    nodes = scratch.keep(level.select("file", F.lit(0).alias("level"), "node", "digest"), label)
    for k in range(1, top + 1):
        parent = F.floor(F.col("node") / fanout).cast("long")
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        level = nodes.where(F.col("level") == k - 1).groupBy("file", parent.alias("parent")).agg(children.alias("children"))
        text = F.array_join(F.transform("children", lambda c: c["digest"]), "|")
        level = level.select("file", F.lit(k).alias("level"), F.col("parent").alias("node"), F.sha2(F.concat(F.lit("node|"), text), 256).alias("digest"))
        nodes = nodes.unionByName(scratch.keep(level, label))
    return nodes, top


def audit(ours: DataFrame, theirs: DataFrame, scratch: Scratch, fanout: int = FANOUT) -> DataFrame:
    """Leaves (file, seq) on which two replicas' leaf tables differ, with status: damaged, missing or unexpected.

    Roots are compared first; then, level by level, only the children of nodes that differ.
    """
    mine, top = merkle_tree(ours, scratch, fanout, "ours")
    other, top2 = merkle_tree(theirs, scratch, fanout, "theirs")
    height = max(top, top2)
    # A tree of fewer levels than the other's differs from its root on; all its files are then descended from that level.
    suspects = None
    for k in range(height, -1, -1):
        a = mine.where(F.col("level") == k).select("file", "node", F.col("digest").alias("a"))
        b = other.where(F.col("level") == k).select("file", "node", F.col("digest").alias("b"))
        if suspects is not None:
            a, b = (t.withColumn("parent", F.floor(F.col("node") / fanout).cast("long")).join(suspects, ["file", "parent"], "left_semi").drop("parent") for t in (a, b))
        differ = a.join(b, ["file", "node"], "full").where("not (a <=> b)")
        found = scratch.keep(differ.select("file", F.col("node").alias("parent"), F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").otherwise("damaged").alias("status")), "differ")
        suspects = found.select("file", "parent")
        if k and found.isEmpty():
            return found.select("file", F.col("parent").alias("seq"), "status")
    return found.select("file", F.col("parent").alias("seq"), "status")


def fixity_report(records: DataFrame, replica: DataFrame, scratch: Scratch | None = None, fanout: int = FANOUT) -> DataFrame:
    """Every record of ``records`` with status: intact, damaged or missing; and ``unexpected`` records of the replica.

    Both have the columns of ``as_records``; ``as_replica`` gives a replica the places of ``records``. Defined cases: an empty replica makes all records
    missing; equal tables make all intact; null URLs and texts are empty in their records.
    """
    scratch = scratch or Scratch(records.sparkSession, "fixity")
    records, replica = scratch.keep(records, "records"), scratch.keep(replica, "replica")
    found = audit(records, replica, scratch, fanout)
    out = records.join(found.where("status <> 'unexpected'"), ["file", "seq"], "left").withColumn("status", F.coalesce("status", F.lit("intact")))
    more = replica.join(found.where("status = 'unexpected'"), ["file", "seq"])
    return out.unionByName(more)
