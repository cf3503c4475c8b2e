"""Merkle fixity audit of WARC archives: replicas are compared from the roots down, only into branches that differ."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swathe.llm.words import slices
from swathe.plans.durable import durable

#: Ids of one archive file, and children of a node of the trees: powers of two, so that places are shifts.
FILE_SHIFT, FANOUT_SHIFT = 8, 4
FILE_IDS, FANOUT = 1 << FILE_SHIFT, 1 << FANOUT_SHIFT
CRLF = "\r\n"
#: Bytes of a gzip member that are unpacked at a time.
BLOCK = 1 << 16


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record as text; the length it declares is that of the body in UTF-8. Nulls count as empty."""
    body, line = F.coalesce(html, F.lit("")), F.lit(CRLF)
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{CRLF}Content-Length: "), F.octet_length(body).cast("string"),
        line, line, body, line, line,
    )


def leaves(records: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """(id, file, n_bytes, sha256, copies): one leaf per id; ``file`` is the id's block of FILE_IDS ids.

    Rows that repeat an id are one leaf over all of them (number, least and greatest digest, exclusive-or of their hashes),
    combined in the map tasks, so that a hot id costs one row a task. Null ids are one leaf of file null.
    """
    rows = records.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{record_col}`").alias("record"))
    rows = rows.select("id", F.octet_length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("sha"))
    one = rows.groupBy("id").agg(F.count("*").alias("copies"), F.sum("n_bytes").alias("n_bytes"), F.min("sha").alias("lo"), F.max("sha").alias("hi"), F.bit_xor(F.xxhash64("sha")).alias("x"))
    many = F.sha2(F.concat_ws(":", F.col("copies").cast("string"), "lo", "hi", F.col("x").cast("string")), 256)
    return one.select("id", F.shiftright("id", FILE_SHIFT).alias("file"), "n_bytes", F.when(F.col("copies") == 1, F.col("lo")).otherwise(many).alias("sha256"), "copies")


def with_offsets(leaf: DataFrame) -> DataFrame:
    """Adds first_byte: where the record starts in its file, records in order of id (at most FILE_IDS in a file)."""
    before = Window.partitionBy("file").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.withColumn("first_byte", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)))


def slots(ids: DataFrame) -> DataFrame:
    """(id, slot): the rank from 0 of each distinct id, null first. Ranges of ids are sorted in their partitions; how many
    come before a partition is a table with a row for each."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ids.distinct().repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    rows = durable(rows.select("id", F.monotonically_increasing_id().alias("m")))
    sizes = rows.groupBy(F.shiftright("m", 33).alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = F.broadcast(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    slot = F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(sizes, F.shiftright("m", 33) == F.col("part")).select("id", slot.alias("slot"))


def _roll(level: DataFrame) -> DataFrame:
    """The next level of a tree: the hash over up to FANOUT children's nodes, byte counts and hashes, in order."""
    children = F.array_sort(F.collect_list(F.struct("node", "n_bytes", "hash")))
    text = F.concat_ws(",", F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["n_bytes"].cast("string"), c["hash"])))
    return level.groupBy(F.shiftright("node", FANOUT_SHIFT).alias("node")).agg(F.sum("n_bytes").alias("n_bytes"), F.sha2(text, 256).alias("hash"))


def tree(leaf: DataFrame, size: int) -> list[DataFrame]:
    """Levels (node, n_bytes, hash) from the records to a root over ``size`` slots; a node covers an ordered range of
    records, so of offsets.

    A group has at most FANOUT rows, as a slot is one record's. Levels shrink by FANOUT, however far apart the ids lie.
    """
    levels = [durable(leaf.select(F.col("slot").alias("node"), "n_bytes", F.col("sha256").alias("hash")))]
    while size > 1:
        levels.append(durable(_roll(levels[-1])))
        size = -(-size // FANOUT)
    return levels


def compare(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(node, hash, other_hash) of the records at which two trees over the same slots differ; null where a replica lacks
    the record. Starts at the roots and reads, level by level, only the children of nodes that differ."""
    differing = None
    for x, y in zip(a[::-1], b[::-1]):
        if differing is not None:
            near = differing.select(F.col("node").alias("parent"))
            x, y = (t.join(near, F.shiftright(t["node"], FANOUT_SHIFT) == near["parent"], "left_semi") for t in (x, y))
        y = y.select("node", F.col("hash").alias("other_hash"))
        differing = durable(x.select("node", "hash").join(y, "node", "full").where(~F.col("hash").eqNullSafe(F.col("other_hash"))))
        if differing.isEmpty():
            break
    return differing


def audit(records: DataFrame, replica: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """One row per id of either archive: id, file, first_byte, n_bytes, sha256, replica_sha256, status.

    Status is ok, corrupt, missing (in the replica) or extra (only there; then place and digest are the replica's).
    Digests are compared by two Merkle trees over the ranks of all ids of both replicas, so that a missing record moves
    none of the others to another branch; where the branches agree the replica's digest is the record's own. Tables
    may be empty, ids null (one leaf) or repeated (one leaf of all their rows); record text null is an empty digest.
    """
    own, other = durable(with_offsets(leaves(records, id_col, record_col))), durable(with_offsets(leaves(replica, id_col, record_col)))
    place = durable(slots(own.select("id").unionAll(other.select("id"))))
    own, other = (durable(t.join(place.withColumnRenamed("id", "pid"), F.col("id").eqNullSafe(F.col("pid"))).drop("pid")) for t in (own, other))
    size = place.count()
    found = compare(tree(own, size), tree(other, size))
    marked = own.join(found.where("hash is not null"), own["slot"] == found["node"], "left")
    status = F.when(F.col("hash").isNull(), "ok").when(F.col("other_hash").isNull(), "missing").otherwise("corrupt")
    digest = F.when(F.col("hash").isNull(), F.col("sha256")).otherwise(F.col("other_hash"))
    here = marked.select("id", "file", "first_byte", "n_bytes", "sha256", digest.alias("replica_sha256"), status.alias("status"))
    extra = other.join(found.where("hash is null"), other["slot"] == found["node"], "left_semi")
    extra = extra.select("id", "file", "first_byte", "n_bytes", F.lit(None).cast("string").alias("sha256"), F.col("sha256").alias("replica_sha256"), F.lit("extra").alias("status"))
    return here.unionByName(extra).withColumnRenamed("id", id_col)


def parse_records(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, first_byte, n_bytes, kind, uri, record_id, body, error): the records of WARC files, plain or with each record
    (or several) in a gzip member; places and sizes are then those of the member in the file.

    A record or member that is cut off, or has no length, ends its file with a row that tells so; null and empty files have
    no rows.
    """
    names = ["path", "first_byte", "n_bytes", "kind", "uri", "record_id", "body", "error"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def members(path: str, data: bytes) -> Iterator[tuple]:
        at = 0
        while at < len(data):
            if data[at : at + 2] != b"\x1f\x8b":
                yield from walk(path, data[at:]) if at == 0 else [(path, at, len(data) - at, None, None, None, None, "broken member")]
                return
            tool, parts, end = zlib.decompressobj(31), [], at
            try:
                while not tool.eof and end < len(data):
                    parts.append(tool.decompress(data[end : end + BLOCK]))
                    end = min(end + BLOCK, len(data))
            except zlib.error:
                pass
            if not tool.eof:
                yield path, at, len(data) - at, None, None, None, None, "broken member"
                return
            end -= len(tool.unused_data)
            for _, _, _, *rest in walk(path, b"".join(parts)):
                yield path, at, end - at, *rest
            at = end

    def walk(path: str, data: bytes) -> Iterator[tuple]:
        at = 0
        while at < len(data):
            stop = data.find(b"\r\n\r\n", at)
            fields = dict(x.split(b": ", 1) for x in data[at:stop].split(b"\r\n")[1:] if b": " in x) if stop >= 0 else {}
            fields = {k.lower(): v.decode("utf-8", "replace") for k, v in fields.items()}
            length = fields.get(b"content-length", "")
            if not data[at:].startswith(b"WARC/") or not length.isdigit() or stop + 8 + int(length) > len(data):
                yield path, at, len(data) - at, None, None, None, None, "broken record"
                return
            end = stop + 4 + int(length)
            yield path, at, end + 4 - at, fields.get(b"warc-type"), fields.get(b"warc-target-uri"), fields.get(b"warc-record-id"), data[stop + 4 : end], None
            at = end + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for contents, paths in slices(batches, "content", "path"):
            if rows := [r for data, path in zip(contents, paths) for r in members(path, data)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    cols = files.select(F.col(f"`{path_col}`").cast("string").alias("path"), F.col(f"`{content_col}`").alias("content"))
    return cols.mapInArrow(run, "path string, first_byte long, n_bytes long, kind string, uri string, record_id string, body binary, error string")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage: every 97th page has an altered body, every 389th is gone, 1 in 501 is there twice as
    a page of its own with a negative id."""
    bad = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.substring(F.col("html"), 2, 1 << 30))).otherwise(F.col("html"))
    kept = pages.where(F.col("page_id").isNull() | (F.col("page_id") % 389 != 11)).withColumn("html", bad)
    return kept.unionByName(pages.where(F.col("page_id") % 501 == 3).withColumn("page_id", -F.col("page_id") - 1))


def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    both = [p.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")) for p in (pages, damaged(pages))]
    return audit(*both)


_LEAF = r"""SELECT page_id, CAST(floor(page_id / 256.0) AS BIGINT) AS file, CAST(octet_length(encode(record)) AS BIGINT) AS n_bytes, sha256(record) AS sha256
    FROM (SELECT page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', CAST(page_id AS VARCHAR), '>', chr(13), chr(10),
    'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Length: ', CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR), chr(13), chr(10), chr(13), chr(10),
    coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record FROM {0})"""
OP9_SQL = f"""
WITH r AS (SELECT page_id, url, CASE WHEN page_id % 97 = 5 THEN '#' || substr(html, 2) ELSE html END AS html FROM pages WHERE page_id % 389 <> 11
    UNION ALL SELECT -page_id - 1, url, html FROM pages WHERE page_id % 501 = 3),
a AS ({_LEAF.format("pages")}), b AS ({_LEAF.format("r")}),
x AS (SELECT *, CAST(coalesce(sum(n_bytes) OVER w, 0) AS BIGINT) AS first_byte FROM a WINDOW w AS (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, CAST(coalesce(sum(n_bytes) OVER w, 0) AS BIGINT) AS first_byte FROM b WINDOW w AS (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT coalesce(x.page_id, y.page_id) AS page_id, coalesce(x.file, y.file) AS file, coalesce(x.first_byte, y.first_byte) AS first_byte,
    coalesce(x.n_bytes, y.n_bytes) AS n_bytes, x.sha256 AS sha256, y.sha256 AS replica_sha256,
    CASE WHEN y.page_id IS NULL THEN 'missing' WHEN x.page_id IS NULL THEN 'extra' WHEN x.sha256 = y.sha256 THEN 'ok' ELSE 'corrupt' END AS status
FROM x FULL JOIN y ON x.page_id = y.page_id
"""
