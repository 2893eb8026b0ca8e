"""WARC records and a Merkle fixity audit of their replicas.

Records are laid out in archives of bounded size; a record's place is its
archive and its offset there. Its digest is hashed with its offset range into
the node of the stretch of places it starts in, nodes are hashed in order into
wider nodes, sixteen to one, up to one root per replica. The audit compares
roots and goes down only into nodes that differ. Records in them are matched by
record id and digest, wherever they lie: a replica has a layout of its own, and
one lost or longer record moves all that follow it.

Where only damage is asked for and not what moved, leaves are runs of records
that a record's own digest begins, with offsets counted from the run's start,
and a wider node begins at a child whose hash says so. Then a lost, longer or
new record changes the leaf it lies in and perhaps the next one; all others keep
their hash wherever they have moved, and the audit does not go into them.

Defined cases: null url or html count as empty; null ids are kept; repeated
rows are records of their own; an empty table has no records and nothing to
report. A file whose next bytes are no record with a header and a
Content-Length (or no gzip member) ends in one record of all bytes that are
left, without url and id; a record cut off by the file's end is as long as what
is there. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presencia.llm.tables import new_path, written


@dataclass(frozen=True)
class WarcParams:
    """``archive_records``: records an archive has on average; ``leaf_bits``:
    leaves by place cover two to this many bytes; ``leaf_records``: records a
    leaf by content has on average; ``fan_bits``: nodes have two to this many
    children, on average where they are cut by content."""

    archive_records: int = 1_000
    leaf_bits: int = 16
    leaf_records: int = 8
    fan_bits: int = 4
    date: str = "2024-01-01T00:00:00Z"


def record_text(page_id: Column, url: Column, html: Column, date: str) -> Column:
    """A response record, without the blank lines that end it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.coalesce(html, F.lit("")))
    url = F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x20]", "")
    name = F.md5(F.concat_ws(" ", page_id.cast("string"), url, F.md5(http)))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"),
        F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(http).cast("string"), F.lit("\r\n\r\n"), http,
    )


def _records(pages: DataFrame, params: WarcParams, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, key, archive, record, length; archives by a hash of the row."""
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "page_id"), (url_col, "url"), (html_col, "html"))])
    archives = max(1, -(-rows.count() // params.archive_records))
    record = record_text(F.col("page_id"), F.col("url"), F.col("html"), params.date)
    rows = rows.select("page_id", F.xxhash64("page_id", "url", "html").alias("key"), record.alias("record"))
    return rows.withColumn("archive", F.pmod("key", F.lit(archives))).withColumn("length", F.octet_length("record").cast("long") + 4)


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with the offset in their archive, in order of id."""
    before = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_first(), "key").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("key")


def lay_out(pages: DataFrame, params: WarcParams = WarcParams(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, record, archive, offset, length: a row per page."""
    return _placed(_records(pages, params, id_col, url_col, html_col)).select("page_id", "record", "archive", "offset", "length")


def write_warc(records: DataFrame, path: str, order: tuple[str, ...] = ("offset",), compression: str = "none") -> None:
    """One file per archive, below ``path``/archive=N; blank lines end records.
    ``compression`` ``gzip`` makes each file one member."""
    dealt = records.repartition("archive").sortWithinPartitions("archive", *order)
    dealt.select("archive", "record").write.partitionBy("archive").option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _member(data: memoryview, at: int):
    """Plain pieces of the gzip member at a place, and at last the place after
    it; a broken member gives its bytes as they are, up to the file's end."""
    import zlib

    member, start = zlib.decompressobj(31), at
    try:
        while not member.eof and at < len(data):
            piece = data[at : at + 65_536]
            plain = member.decompress(piece)
            at += len(piece)
            if plain:
                yield plain
        yield at - len(member.unused_data)
    except zlib.error:
        yield bytes(data[start:])
        yield len(data)


def _plain(data: memoryview, zipped: bool):
    """The bytes of a file in pieces, members inflated one after the other."""
    at = 0
    while at < len(data):
        if not zipped:
            yield bytes(data[at : at + 1_000_000])
            at += 1_000_000
            continue
        for piece in _member(data, at):
            if isinstance(piece, int):
                at = piece
            else:
                yield piece


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}


def _named(fields: dict[bytes, bytes]) -> tuple[str, str]:
    return tuple(fields.get(k, b"").decode("utf-8", "replace") for k in (b"warc-target-uri", b"warc-record-id"))


def _in_stream(pieces):
    """Records of a stream; no more than one and a piece are held."""
    pieces, held, at = iter(pieces), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while held or more():
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                break
        fields = _fields(bytes(held[: max(end, 0)]))
        length = fields.get(b"content-length", b"")
        if end < 0 or not length.isdigit():
            while more():
                pass
            yield at, len(held), "", "", bytes(held)
            return
        size = end + 4 + int(length) + 4
        while len(held) < size and more():
            pass
        plain = bytes(held[:size])
        yield at, len(plain), *_named(fields), plain
        at += len(plain)
        del held[:size]


def records_of(data: memoryview, plain: bool = False):
    """(offset, length, url, record id, bytes with their end) of the records
    of one file, which is gone through once. Offsets count the file's bytes, in
    which a gzip member is a record, or with ``plain`` the inflated ones."""
    zipped = bytes(data[:2]) == b"\x1f\x8b"
    if plain or not zipped:
        yield from _in_stream(_plain(data, zipped))
        return
    at = 0
    while at < len(data):
        *parts, after = _member(data, at)
        body = b"".join(parts)
        yield at, after - at, *_named(_fields(body.partition(b"\r\n\r\n")[0])), body
        at = after


def read_warc(spark: SparkSession, path: str, plain: bool = False) -> DataFrame:
    """file, archive (of a path with archive=N, else null), offset, length, url,
    record_id, record (bytes with their end) of every record of the files below
    ``path``; plain or gzip members. A file is a row, so archives should be of the
    usual size, at most two GB; it is gone through without a second copy."""

    def split(batches):
        names = ["file", "offset", "length", "url", "record_id", "record"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for file, body in zip(batch.column("path").to_pylist(), batch.column("content")):
                out, held = [[] for _ in names], 0
                for at, length, url, name, record in records_of(memoryview(body.as_buffer()), plain):
                    for c, v in zip(out, (file, at, length, url, name, record)):
                        c.append(v)
                    held += len(record)
                    if held > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                        out, held = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.select("path", "content").mapInArrow(split, "file string, offset long, length long, url string, record_id string, record binary")
    archive = F.regexp_extract("file", "/archive=([0-9]+)/", 1).try_cast("long")
    return found.select("file", archive.alias("archive"), "offset", "length", "url", "record_id", "record")


def digests(records: DataFrame, *more: str) -> DataFrame:
    """page_id, record_id, archive, offset, length, digest (SHA-256 of the record)."""
    name = F.regexp_extract("record", "WARC-Record-ID: (<[^>]*>)", 1)
    return records.select("page_id", name.alias("record_id"), "archive", "offset", "length", F.unhex(F.sha2("record", 256)).alias("digest"), *more)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``digests`` but page_id, out of the files of a replica,
    compressed or not; places are those of the plain bytes. A file whose path
    names no archive is one of its own, by a hash of the path."""
    body = F.expr("substring(record, 1, length(record) - 4)")
    own = F.lit(1 << 30) + F.pmod(F.xxhash64("file"), F.lit(1 << 30))
    return read_warc(spark, path, plain=True).select("record_id", F.coalesce("archive", own).alias("archive"), "offset", "length", F.unhex(F.sha2(body, 256)).alias("digest"))


def merkle_levels(both: DataFrame, params: WarcParams) -> list[DataFrame]:
    """Nodes of all replicas, lowest level first: (replica, node, hash).

    ``both``: replica, place and the columns of ``digests``. A node gathers
    the records that start in one stretch, or its sixteen children.
    """
    top = both.agg(F.max("place")).first()[0]
    shift = params.leaf_bits
    leaf = F.concat(F.unhex(F.lpad(F.hex("offset"), 16, "0")), F.unhex(F.lpad(F.hex("length"), 16, "0")), F.col("digest"))
    nodes = both.groupBy("replica", F.shiftright("place", shift).alias("node")).agg(F.array_sort(F.collect_list(F.struct("place", leaf.alias("part")))).alias("parts"))
    levels = []
    while True:
        levels.append(written(nodes.select("replica", "node", _node_hash("parts").alias("hash")), f"merkle-{len(levels)}"))
        if top is None or top >> shift == 0:
            return levels
        shift += params.fan_bits
        nodes = levels[-1].groupBy("replica", F.shiftright("node", params.fan_bits).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", F.col("hash").alias("part")))).alias("parts")).withColumnRenamed("up", "node")


def _differing(rows: DataFrame, keys: list[str]) -> DataFrame:
    sides = [F.max(F.when(F.col("replica") == r, F.col("hash"))).alias(r) for r in ("primary", "copy")]
    return rows.groupBy(*keys).agg(*sides).where(~F.col("primary").eqNullSafe(F.col("copy")))


def _matched(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the primary beside the copy's of equal keys, one to one, in the
    order of their places; null where a side has none left."""
    nth = F.row_number().over(Window.partitionBy("replica", *keys).orderBy("archive", "offset"))
    here = F.struct("page_id", "record_id", "archive", "offset", "length", "digest")
    sides = [F.max(F.when(F.col("replica") == r, here)).alias(r) for r in ("primary", "copy")]
    return rows.withColumn("nth", nth).groupBy(*keys, "nth").agg(*sides).select("primary", "copy")


def _node_hash(parts: str) -> Column:
    return F.unhex(F.sha2(F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x["part"])), 256))


def _begins(digest: str, one_of: int) -> Column:
    """One digest in ``one_of`` begins a node."""
    return (F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long") % one_of == 0).cast("int")


def _in_runs(both: DataFrame, params: WarcParams) -> DataFrame:
    """``both`` with ``run``, the number of its leaf in its archive."""
    so_far = Window.partitionBy("replica", "archive").orderBy("offset", "digest")
    return both.withColumn("run", F.sum(_begins("digest", params.leaf_records)).over(so_far))


def content_levels(runs: DataFrame, params: WarcParams) -> list[DataFrame]:
    """Nodes of all replicas, lowest level first: (replica, archive, node, up,
    hash). Runs of records, runs of these, archives, then archives in groups."""
    fan, of_archive = 1 << params.fan_bits, ["replica", "archive"]
    leaves = runs.groupBy(*of_archive, F.col("run").alias("node")).agg(F.array_sort(F.collect_list(F.struct("offset", "length", "digest"))).alias("parts"))
    first = F.col("parts")[0]["offset"]
    parts = F.transform("parts", lambda x: F.struct(_offset_part(x, first).alias("part")))
    leaves = leaves.select(*of_archive, "node", parts.alias("parts")).select(*of_archive, "node", _node_hash("parts").alias("hash"))
    so_far = Window.partitionBy(*of_archive).orderBy("node")
    levels = [written(leaves.withColumn("up", F.sum(_begins("hash", fan)).over(so_far)), "merkle-0")]

    def above(name: str, keys: list[Column], up: Column) -> None:
        nodes = levels[-1].groupBy("replica", *keys).agg(F.array_sort(F.collect_list(F.struct("archive", "node", F.col("hash").alias("part")))).alias("parts"))
        levels.append(written(nodes.select("replica", "archive", "node", up.alias("up"), _node_hash("parts").alias("hash")), name))

    above("merkle-1", [F.col("archive"), F.col("up").alias("node")], F.lit(0).cast("long"))
    top = levels[0].agg(F.max("archive")).first()[0] or 0
    above("merkle-2", [F.col("archive"), F.lit(0).cast("long").alias("node")], F.lit(0).cast("long"))
    while top:
        top >>= params.fan_bits
        above(f"merkle-{len(levels)}", [F.shiftright("archive", params.fan_bits).alias("archive"), F.col("up").alias("node")], F.lit(0).cast("long"))
    return levels


def _offset_part(x: Column, first: Column) -> Column:
    words = [F.unhex(F.lpad(F.hex(v), 16, "0")) for v in (x["offset"] - first, x["length"])]
    return F.concat(*words, x["digest"])


def _uneven(nodes: DataFrame) -> DataFrame:
    """Nodes whose hash one replica holds more often than the other."""
    by_hash = nodes.groupBy("hash").agg(F.sum(F.when(F.col("replica") == "primary", 1).otherwise(-1)).alias("more"))
    return nodes.join(by_hash.where("more <> 0"), "hash", "left_semi").drop("hash")


def damaged_leaves(levels: list[DataFrame], params: WarcParams) -> DataFrame:
    """replica, archive, run of the leaves that the descent ends in. A node
    meets the other replica's by its hash, wherever that lies; what is under
    nodes that both hold equally often is intact and not read."""
    found = _uneven(levels[-1])
    for at in range(len(levels) - 2, -1, -1):
        # a node's parent: its own archive's up to archives, the group's above
        archive = F.shiftright("archive", params.fan_bits) if at >= 2 else F.col("archive")
        parents = found.select("replica", F.col("archive").alias("_archive"), F.col("node").alias("_node"))
        below = levels[at].withColumns({"_archive": archive, "_node": F.col("up")})
        found = _uneven(below.join(parents, ["replica", "_archive", "_node"], "left_semi").drop("_archive", "_node"))
    return found.select("replica", "archive", F.col("node").alias("run"))


def audit(primary: DataFrame, copy: DataFrame, params: WarcParams = WarcParams(), shifted: bool = True) -> DataFrame:
    """page_id, archive, offset, length, status, copy_archive, copy_offset of
    the records that differ; the place is the primary's where it has one.

    ``primary`` is a table as ``digests`` gives it, ``copy`` one as ``digests``
    or ``read_digests`` does. Status: changed, missing (not in the copy), extra
    (only there) or, unless ``shifted`` is false, shifted (intact at another
    place). An extra record of files has no page_id. Without the shifted the
    leaves are cut by content, and only those with damage are gone into.
    """
    rows = primary.withColumn("replica", F.lit("primary")).unionByName(copy.withColumn("replica", F.lit("copy")), allowMissingColumns=True)
    if shifted:
        rows = written(rows, "warc-digests")
        inside = _by_place(rows, params)
    else:
        rows = written(_in_runs(rows, params), "warc-digests")
        inside = rows.join(damaged_leaves(content_levels(rows, params), params), ["replica", "archive", "run"], "left_semi")
    # what lies where it did goes first: of repeated records the moved one is to be named
    exact = ["record_id", "archive", "offset", "length", "digest"]
    both = F.collect_set("replica").over(Window.partitionBy(*exact))
    inside = written(inside.withColumn("sides", F.size(both)).where("sides = 1").select("replica", "page_id", *exact), "warc-suspects")
    intact = written(_matched(inside, ["record_id", "digest"]), "warc-matched")
    one_sided = [intact.where(F.col(o).isNull()).select(F.lit(r).alias("replica"), f"{r}.*") for r, o in (("primary", "copy"), ("copy", "primary"))]
    found = _matched(one_sided[0].unionByName(one_sided[1]), ["record_id"])
    status = F.when(F.col("copy").isNull(), "missing").when(F.col("primary").isNull(), "extra").otherwise("changed")
    found = found.withColumn("status", status)
    if shifted:
        found = intact.where("primary IS NOT NULL AND copy IS NOT NULL").withColumn("status", F.lit("shifted")).unionByName(found)
    found = found.withColumn("at", F.coalesce("primary", "copy"))
    return found.select("at.page_id", "at.archive", "at.offset", "at.length", "status", F.col("copy.archive").alias("copy_archive"), F.col("copy.offset").alias("copy_offset"))


def _by_place(rows: DataFrame, params: WarcParams) -> DataFrame:
    """The records in leaves by place that differ."""
    end = rows.agg(F.max(F.col("offset") + F.col("length"))).first()[0] or 1
    span = max(params.leaf_bits, int(end).bit_length())
    placed = rows.withColumn("place", F.shiftleft("archive", span) + F.col("offset"))
    levels = merkle_levels(placed, params)
    suspects = _differing(levels[-1], ["node"]).select("node")
    for level in reversed(levels[:-1]):
        children = level.withColumn("up", F.shiftright("node", params.fan_bits)).join(suspects.withColumnRenamed("node", "up"), "up", "left_semi")
        suspects = _differing(children, ["node"]).select("node")
    return placed.withColumn("up", F.shiftright("place", params.leaf_bits)).join(suspects.withColumnRenamed("node", "up"), "up", "left_semi")


def _hurt(record: Column, page_id: Column) -> Column:
    """Known damage: in one record of 97 the last byte is another one."""
    last = F.substring(record, -1, 1)
    other = F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.when(last == "#", "%").otherwise("#"))
    return F.when(F.coalesce(page_id % 97 == 5, F.lit(False)) & (F.octet_length(last) == 1), other).otherwise(record)


def fixity_report(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Lay out ``pages``, write a damaged replica (one record of 97 changed, one
    of 193 lost), read it from its files, and report the damage that the audit
    locates, by leaves cut by content."""
    spark = pages.sparkSession
    rows = _records(pages, params, "page_id", "url", "html")
    # the primary's records are hashed where they are read; the replica's move into files
    hashed = digests(rows.withColumn("offset", F.lit(None).cast("long")), "key").drop("offset")
    laid = written(_placed(hashed), "warc-layout")
    lost = F.coalesce(F.col("page_id") % 193 == 7, F.lit(False))
    copied = rows.where(~lost).withColumn("record", _hurt(F.col("record"), F.col("page_id")))
    path = new_path(spark, "warc-replica")
    write_warc(copied, path, ("page_id", "key"), "gzip")
    found = audit(laid, read_digests(spark, path), params, shifted=False)
    return found.select("page_id", "archive", "offset", "length", "status")
