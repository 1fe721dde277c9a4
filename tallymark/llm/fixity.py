"""WARC files of web pages and a Merkle fixity audit of two replicas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: Records of one file, and children of a tree node.
RECORDS, FAN = 1024, 16
#: Files among which rows without page_id are dealt by a hash.
NAMELESS = 1 << 20
#: Date of capture where none is given (pages have none).
DATE = "1970-01-01T00:00:00Z"


def warc_records(pages: DataFrame, records: int = RECORDS, date: str = DATE) -> DataFrame:
    """page_id, file and record (bytes) of each row of pages.

    A file holds the pages of one range of page_id; rows with null page_id go to files of their own (-1 and down, by a
    hash). The record is a WARC/1.0 resource with all mandatory fields: a header block, a blank line, the html, two line
    ends. Its id is a UUID by MD5 of page_id, url and html, so wholly equal rows are one record stored twice. Null html
    is empty; a null or blank url becomes urn:page: and the id; blanks and line ends in a url are escaped. Other columns
    are ignored, an empty table gives none.
    """
    key, html = F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("html", F.lit(""))
    url = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("urn:page:"), key))
    for char, code in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(char), F.lit(code))
    uuid = F.regexp_replace(F.md5(F.concat_ws("|", key, url, html)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url, F.lit("\r\nX-Page-ID: "), key,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    file = F.coalesce(F.floor(F.col("page_id") / records), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(NAMELESS)))
    return pages.select("page_id", file.cast("long").alias("file"), F.concat(head, html, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC files, one folder file=N with one file for each, in order of page_id and hash."""
    rows = records.select("file", "page_id", F.sha2("record", 256).alias("hash"), F.expr("substring(record, 1, octet_length(record) - 2)").alias("record")).withColumn("record", F.decode("record", "utf-8"))
    ordered = rows.repartition("file").sortWithinPartitions("file", "page_id", "hash")
    ordered.select("file", F.col("record").alias("value")).write.partitionBy("file").option("lineSep", "\r\n").text(path)


def _parse(raw: bytes) -> Iterator[tuple[int, bytes, int | None]]:
    """(start, record, page_id) of each record of a file; what can't be read up to the next record's start is one record."""
    at = 0
    while at < len(raw):
        head = raw.find(b"\r\n\r\n", at)
        fields = dict(x.split(b": ", 1) for x in raw[at : max(head, at)].split(b"\r\n")[1:] if b": " in x) if raw.startswith(b"WARC/1.0\r\n", at) and head > 0 else {}
        size = fields.get(b"Content-Length", b"")
        end = head + 4 + int(size) if size.isdigit() else -1
        key = fields.get(b"X-Page-ID", b"")
        if end < 0 or raw[end : end + 4] != b"\r\n\r\n":
            nxt = raw.find(b"\r\n\r\nWARC/1.0\r\n", at)
            end = nxt if nxt >= 0 else len(raw) - 4
        end = min(end + 4, len(raw)) if end + 4 > at else len(raw)
        yield at, raw[at:end], int(key) if key.lstrip(b"-").isdigit() else None
        at = end


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = list(_parse(content.as_py()))
            for i in range(0, len(found), 256):
                part = found[i : i + 256]
                cols = [pa.array([k for _, _, k in part], pa.int64()), pa.array([file] * len(part), pa.int64()), pa.array([s for s, _, _ in part], pa.int64()), pa.array([r for _, r, _ in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "file", "start", "record"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, file, start and record of every record of the WARC files that write_warc() made; a file is read in one task."""
    files = spark.read.format("binaryFile").load(path).select(F.col("file").cast("long").alias("file"), "content")
    return files.mapInArrow(_parse_files, "page_id long, file long, start long, record binary")


def stored_leaves(records: DataFrame) -> DataFrame:
    """leaves() of records as they stand in files (page_id, file, start, record): their own offsets count."""
    order = Window.partitionBy("file").orderBy("start")
    hashed = records.select("page_id", "file", "start", F.octet_length("record").cast("long").alias("size"), F.sha2("record", 256).alias("hash"))
    return hashed.select("page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "start", "size", "hash")


def leaves(records: DataFrame) -> DataFrame:
    """page_id, file, ordinal, start, size and hash of each record; a file's records stand in order of page_id and hash.

    Records are hashed before they are put in order, so that only hashes and sizes are shuffled.
    """
    hashed = records.select("page_id", "file", F.octet_length("record").cast("long").alias("size"), F.sha2("record", 256).alias("hash"))
    order = Window.partitionBy("file").orderBy("page_id", "hash")
    start = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return hashed.select("page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), start.alias("start"), "size", "hash")


def slots(leaf: DataFrame, records: int = RECORDS) -> DataFrame:
    """The trees' lowest level: file, ordinal (page_id's place in the file's range, 0 for null), start, size, hash.

    A lost record leaves its place empty. Most places have one record; repeats of a page_id share one, by stretches of
    1,024 and then by these stretches' hashes.
    """
    place = F.coalesce(F.pmod("page_id", F.lit(records)), F.lit(0)).cast("long")
    child = F.struct(F.col("start").alias("s"), F.col("size").alias("z"), F.col("hash").alias("h"))
    some = leaf.groupBy("file", place.alias("place"), F.floor(F.col("ordinal") / 1024).alias("stretch")).agg(F.sort_array(F.collect_list(child)).alias("c"))
    some = some.select("file", "place", *_range("c"), _digest("c", lambda x: F.concat_ws(":", x["z"], x["h"])))
    up = some.groupBy("file", F.col("place").alias("ordinal")).agg(F.sort_array(F.collect_list(child)).alias("c"))
    return up.select("file", "ordinal", *_range("c"), F.when(F.size("c") == 1, F.col("c")[0]["h"]).otherwise(_digest("c", lambda x: x["h"])).alias("hash"))


def _range(c: str) -> tuple[F.Column, F.Column]:
    return F.col(c)[0]["s"].alias("start"), F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["z"]).alias("size")


def _digest(c: str, text) -> F.Column:
    return F.sha2(F.array_join(F.transform(c, text), "|"), 256).alias("hash")


def grow(nodes: DataFrame) -> DataFrame:
    """The level above: file, ordinal, hash of the children's places, sizes and hashes, and their common range.

    The hash holds no start, so that a node that only moved keeps it.
    """
    child = F.struct(F.col("ordinal").alias("o"), F.col("start").alias("s"), F.col("size").alias("z"), F.col("hash").alias("h"))
    up = nodes.groupBy("file", F.floor(F.col("ordinal") / FAN).cast("long").alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"))  # FAN children
    return up.select("file", F.col("up").alias("ordinal"), *_range("c"), _digest("c", lambda x: F.concat_ws(":", x["o"], x["z"], x["h"])))


def tree(leaf: DataFrame, levels: int, records: int = RECORDS) -> list[DataFrame]:
    """Levels from the places to the roots, each written once, since the audit reads them from the top."""
    out = [materialize(slots(leaf, records))]
    for _ in range(levels):
        out.append(materialize(grow(out[-1])))
    return out


def audit(ours: DataFrame, theirs: DataFrame, records: int = RECORDS) -> DataFrame:
    """One row per leaf of either replica: file, ordinal (in ours, or theirs for extra), page_id, start, size, hash, status.

    status: ok, moved (the same bytes at another start), corrupt, missing (not in theirs) or extra (only there). Roots are
    compared first; below a root or node whose hash differs only its children are looked at, level by level, down to the
    places; what stands under an equal hash is ok, or moved if the start differs, without a look. Within a place, equal
    records belong together first (repeats of a page_id), what is left in order of hash. Takes leaves(); a file has at most
    records places, so that trees have a fixed height. Empty replicas give none or only missing or extra.
    """
    levels = 0
    while FAN**levels < records:
        levels += 1
    a, b = tree(ours, levels, records), tree(theirs, levels, records)
    paths, moved = None, []
    for level in range(levels, -1, -1):
        x = a[level].select("file", "ordinal", F.struct("start", "size", "hash").alias("x"))
        y = b[level].select("file", "ordinal", F.struct("start", "size", "hash").alias("y"))
        if paths is not None:
            keep = paths.where(~F.col("x.hash").eqNullSafe(F.col("y.hash"))).select("file", F.col("ordinal").alias("up"))
            x, y = (z.withColumn("up", F.floor(F.col("ordinal") / FAN).cast("long")).join(keep, ["file", "up"], "left_semi").drop("up") for z in (x, y))
        paths = materialize(x.join(y, ["file", "ordinal"], "full").where(~F.col("x").eqNullSafe(F.col("y"))))  # read by the next level and the end
        wide = FAN**level
        below = F.explode(F.sequence(F.col("ordinal") * wide, F.col("ordinal") * wide + (wide - 1)))  # places of a file at most
        moved.append(paths.where(F.col("x.hash") == F.col("y.hash")).select("file", below.alias("place")))
    bad = paths.where(~F.col("x.hash").eqNullSafe(F.col("y.hash"))).select("file", F.col("ordinal").alias("place"), F.lit(True).alias("_bad"))
    shift = moved[0]
    for m in moved[1:]:
        shift = shift.unionByName(m)
    place = F.coalesce(F.pmod("page_id", F.lit(records)), F.lit(0)).cast("long").alias("place")
    look = shift.withColumn("_bad", F.lit(False)).unionByName(bad)
    mine = ours.select("*", place).join(look, ["file", "place"], "left")
    sound = mine.where("_bad IS NULL OR NOT _bad").withColumn("status", F.when(F.col("_bad").isNull(), "ok").otherwise("moved"))
    other = theirs.select("*", place).join(bad, ["file", "place"], "left_semi")
    return sound.drop("place", "_bad").unionByName(_pairs(mine.where("_bad").drop("_bad"), other).drop("place"))


def _pairs(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Leaves of either side with their status, paired within their place: equal hashes first, then the rest in order."""
    same = Window.partitionBy("file", "place", "page_id", "hash").orderBy("start")
    nth = ["file", "place", "page_id", "hash", "n"]
    x, y = (z.withColumn("n", F.row_number().over(same)) for z in (ours, theirs))
    key = lambda cols: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]
    left = x.alias("a").join(y.alias("b"), key(nth), "left").select("a.*", F.col("b.start").alias("there"))
    equal = left.where("there IS NOT NULL").withColumn("status", F.when(F.col("there") == F.col("start"), "ok").otherwise("moved"))
    rest = Window.partitionBy("file", "place", "page_id").orderBy("start")
    x = left.where("there IS NULL").withColumn("n", F.row_number().over(rest))
    y = y.alias("a").join(ours.withColumn("n", F.row_number().over(same)).alias("b"), key(nth), "left_anti").withColumn("n", F.row_number().over(rest))
    nth.remove("hash")
    mine = x.alias("a").join(y.alias("b"), key(nth), "left").select("a.*", F.when(F.col("b.hash").isNull(), "missing").otherwise("corrupt").alias("status"))
    extra = y.alias("a").join(x.alias("b"), key(nth), "left_anti").withColumn("status", F.lit("extra"))
    return equal.drop("n", "there").unionByName(mine.drop("n", "there")).unionByName(extra.drop("n"))


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica with planted damage all over the files: a byte of the payload or two more in the address
    changed, records lost, and records added beside another of the same page_id."""
    k = F.pmod(F.col("page_id") * 7919, F.lit(1009))
    kinds = F.when(k % 101 == 50, "lost").when(k % 97 == 5, "payload").when(k == 7, "address").when(k % 89 == 20, "added").otherwise("")
    rows = pages.select("page_id", "url", "html", F.coalesce(kinds, F.lit("")).alias("kind")).where("kind <> 'lost'")
    html = F.when(F.col("kind") == "payload", F.concat(F.lit("~"), F.substring("html", 2, 2147483647))).otherwise(F.col("html"))
    url = F.when(F.col("kind") == "address", F.concat(F.col("url"), F.lit("##"))).otherwise(F.col("url"))
    copies = F.explode(F.when(F.col("kind") == "added", F.array(F.lit(""), F.lit("?copy"))).otherwise(F.array(F.lit(""))))
    return rows.select("page_id", url.alias("url"), html.alias("html"), copies.alias("more")).select("page_id", F.concat("url", "more").alias("url"), "html")


def op10_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    """The pages' WARC files against a replica with planted damage: every record, its range, hash and status."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    ours, theirs = (materialize(leaves(warc_records(p))) for p in (pages, damaged(pages)))
    return audit(ours, theirs).select("page_id", "file", "ordinal", "start", "size", "hash", "status")


_CRLF = "chr(13) || chr(10)"
_MD5 = "md5(concat_ws('|', page_id, url, html))"
_UUID = " || '-' || ".join(f"substr({_MD5}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
_FIELDS = (
    "'WARC/1.0'", "'WARC-Type: resource'", f"'WARC-Record-ID: <urn:uuid:' || {_UUID} || '>'", f"'WARC-Date: {DATE}'", "'WARC-Target-URI: ' || url", "'X-Page-ID: ' || page_id",
    "'Content-Type: text/html'", "'Content-Length: ' || strlen(html)", "''", "html", "''", "''",
)
_RECORD = f" || {_CRLF} || ".join(_FIELDS)


def _leaf_sql(rows: str) -> str:
    return f"""SELECT page_id, extra, file, row_number() OVER v - 1 AS ordinal, CAST(sum(size) OVER v - size AS BIGINT) AS start, size, hash
  FROM (SELECT page_id, extra, CAST(floor(page_id / {RECORDS}) AS BIGINT) AS file, strlen(record) AS size, sha256(record) AS hash
        FROM (SELECT page_id, extra, {_RECORD} AS record FROM ({rows})))
  WINDOW v AS (PARTITION BY file ORDER BY page_id, hash ROWS UNBOUNDED PRECEDING)"""


ORACLES = {
    "op10_merkle_fixity": f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, page_id * 7919 % 1009 AS k FROM pages
), kinds AS (
  SELECT *, CASE WHEN k % 101 = 50 THEN 'lost' WHEN k % 97 = 5 THEN 'payload' WHEN k = 7 THEN 'address' WHEN k % 89 = 20 THEN 'added' ELSE '' END AS kind FROM p
), bad AS (
  SELECT page_id, CASE WHEN kind = 'address' THEN url || '##' ELSE url END AS url, CASE WHEN kind = 'payload' THEN '~' || substr(html, 2) ELSE html END AS html, false AS extra FROM kinds WHERE kind <> 'lost'
  UNION ALL SELECT page_id, url || '?copy', html, true FROM kinds WHERE kind = 'added'
), a AS ({_leaf_sql("SELECT page_id, url, html, false AS extra FROM p")}
), b AS ({_leaf_sql("SELECT * FROM bad")}
)
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.file, b.file) AS file, coalesce(a.ordinal, b.ordinal) AS ordinal, coalesce(a.start, b.start) AS start,
       coalesce(a.size, b.size) AS size, coalesce(a.hash, b.hash) AS hash,
       CASE WHEN b.file IS NULL THEN 'missing' WHEN a.file IS NULL THEN 'extra' WHEN a.hash <> b.hash THEN 'corrupt' WHEN a.start <> b.start THEN 'moved' ELSE 'ok' END AS status
FROM a FULL JOIN b ON a.page_id = b.page_id AND a.extra = b.extra"""
}
QUERIES = {"op10_merkle_fixity": op10_merkle_fixity}
