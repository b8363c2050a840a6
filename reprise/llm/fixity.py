"""Merkle fixity audit of archived records: records and ordered offset ranges are hashed into trees, replica roots are
compared, and only branches that differ are descended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reprise.llm.common import staged

#: Ids in one archive file.
ARCHIVE_IDS = 4096
#: Bytes of offsets under a lowest range, and ranges under a higher one. A record's head alone has over 100 bytes, so a
#: lowest range holds at most 655 records.
RANGE_BYTES, FAN_OUT = 1 << 16, 16


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC record of a page (null: empty)."""
    empty = F.lit("")
    html = F.coalesce(html, empty)
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), empty), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, empty),
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame, **more: Column) -> DataFrame:
    """archive, offset, length, digest, page_id, url of each page's record, in archives of ``ARCHIVE_IDS`` ids.

    Records lie in order of page_id, url and digest. ``more``: further columns over page_id, url and html, worked out
    where the page is read; the running sum sees lengths and digests, never the pages. Pages without an id form archive
    -1; repeated rows are records of their own; an empty table gives no rows; other columns are not read.
    """
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    whole = record(F.col("page_id"), F.col("url"), F.col("html"))
    p = p.select("page_id", "url", F.coalesce(F.floor(F.col("page_id") / ARCHIVE_IDS), F.lit(-1)).cast("bigint").alias("archive"), F.octet_length(whole).cast("bigint").alias("length"), F.sha2(whole, 256).alias("digest"),
                 *[c.alias(k) for k, c in more.items()])
    before = Window.partitionBy("archive").orderBy("page_id", "url", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))


def levels(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Tree levels from the records up: (archive, node, hash). Level 0 has a node for each offset, level k one for each
    range of RANGE_BYTES * FAN_OUT^(k-1) bytes; a node's hash is that of its children's numbers and hashes in order."""
    out = [staged(leaves.groupBy("archive", F.col("offset").alias("node")).agg(F.concat_ws(",", F.array_sort(F.collect_list("digest"))).alias("hash")))]
    for k in range(1, height + 1):
        up = F.floor(F.col("node") / (RANGE_BYTES if k == 1 else FAN_OUT)).cast("bigint")
        child = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["hash"]))
        out.append(staged(out[-1].groupBy("archive", up.alias("up")).agg(F.sha2(F.concat_ws(";", child), 256).alias("hash")).withColumnRenamed("up", "node")))
    return out


def audit(expected: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ: archive, offset, kind (changed, missing, extra), expected and found digest.

    Both tables have archive, offset, digest. The height follows the largest offset. Roots are joined by archive; from
    there each level joins only the children of nodes that differ, so equal branches are never read again.
    """
    top = [df.agg(F.max("offset")).first()[0] or 0 for df in (expected, replica)]
    height, span = 1, RANGE_BYTES
    while span <= max(top):
        height, span = height + 1, span * FAN_OUT
    left, right = levels(expected, height), levels(replica, height)
    bad: DataFrame | None = None
    for k in range(height, -1, -1):
        a, b = left[k], right[k]
        if bad is not None:
            up = F.floor(F.col("node") / (RANGE_BYTES if k == 0 else FAN_OUT)).cast("bigint")
            parents = bad.select("archive", F.col("node").alias("up"))
            a, b = (x.withColumn("up", up).join(parents, ["archive", "up"], "left_semi").drop("up") for x in (a, b))
        both = a.withColumnRenamed("hash", "expected").join(b.withColumnRenamed("hash", "found"), ["archive", "node"], "full_outer")
        bad = staged(both.where(~F.col("expected").eqNullSafe(F.col("found"))))
    return bad.select("archive", F.col("node").alias("offset"), F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed").alias("kind"), "expected", "found")
