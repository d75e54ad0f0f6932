"""WARC archives: written with revisits for equal payloads, read back by boundary-chain verification.

Reading splits files at the magic ``WARC/1.0``, wherever it stands, also inside payloads. Each task turns a candidate into
(offset, successor offset) from its header's Content-Length. Pointer jumping from offset 0 of each file keeps the
candidates that the chain of records reaches; the magic in a payload is never reached. A record whose bytes end where the
next candidate starts is complete in its row; one with the magic in its payload is put together from its pieces.

Records go through Spark's text writer with the record separator as line end, and come back through its text reader
with the magic as line end: any store that Spark reaches will do, and no task needs a whole file in memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import column, limit_batches, small_side, text_or_empty, written

MAGIC, END = b"WARC/1.0\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Bytes of the buckets in which pieces meet the records that they belong to.
BUCKET = 1 << 16
_FIELD = re.compile(rb"^([!#-'*+.0-9A-Z^-z|~-]+):[ \t]*(.*?)[ \t]*$", re.MULTILINE)


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base32: five hex digits make four letters."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(df: DataFrame, id_col: str, text_col: str, min_bytes: int = 0) -> DataFrame:
    """``df`` with __digest, __bytes and __refers (the id of the response that a revisit points to, else null).

    Of rows with equal payloads of at least ``min_bytes`` bytes the smallest id is the response. Groups are formed on slim
    rows (digest, length, a second hash) with map-side combine; only revisits are joined back, by id, so that a hot group of
    copies is spread evenly. Rows that repeat the response's id and payload are responses too; a null id is larger than all.
    """
    payload = F.encode(text_or_empty(text_col), "UTF-8")
    keys = {"__digest": base32_sha1(payload), "__bytes": F.length(payload).cast("long"), "__check": F.xxhash64(payload)}
    keyed = df.withColumns(keys)
    slim = written(keyed.select(F.col(id_col).alias("id"), *keys), "payloads")
    groups = slim.filter(F.col("__bytes") >= min_bytes).groupBy(*keys).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    revisits = slim.join(groups, list(keys)).filter(F.coalesce(F.col("id") > F.col("first"), F.lit(True)))
    revisits = written(revisits.select("id", "__digest", "__check", F.col("first").alias("__refers")).distinct(), "revisits")
    side = small_side(revisits.withColumnsRenamed({"id": "__id", "__digest": "__d", "__check": "__c"}))
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__d")) & (F.col("__check") == F.col("__c"))
    return keyed.join(side, on, "left").drop("__id", "__d", "__c", "__check")


def _urn(col: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(col).cast("string"), F.lit("null")), F.lit(">"))


def write_warc(df: DataFrame, target: str, id_col: str, text_col: str, uri_col: str | None = None, min_bytes: int = 0, compression: str = "gzip", date: str = "2024-01-01T00:00:00Z") -> None:
    """One record a row, one file a task. Null texts are empty payloads; line ends in URIs become spaces.

    Rows that repeat id and payload are written as often as they come; of equal payloads the smallest id is the response (see
    :func:`plan_records`). An empty table gives an archive without records. Other columns are ignored, whatever their names.
    """
    address = F.regexp_replace(F.coalesce(column(uri_col), F.lit("")), "[\\r\\n]+", " ") if uri_col else F.lit("")
    slim = df.select(column(id_col).alias("id"), column(text_col).alias("text"), address.alias("uri"))
    planned, uri, id_col, text_col = plan_records(slim, "id", "text", min_bytes), F.col("uri"), "id", "text"
    revisit = F.col("__refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("__bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("__bytes"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(id_col), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("__digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn("__refers"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head, http, F.when(revisit, "").otherwise(text_or_empty(text_col)))
    planned.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(target)


FIELDS = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long"


def _parse(content: bytes) -> tuple | None:
    """(bytes from the magic to the block, block bytes, FIELDS' values but the last) of a candidate, or None."""
    end = content.find(END)
    if end < 0:
        return None
    fields = {k.lower(): v.strip().decode("utf-8", "replace") for k, v in _FIELD.findall(content[: end + 2])}
    length = fields.get(b"content-length", "")
    if not length.isascii() or not length.isdigit() or len(length) > 18 or b"warc-type" not in fields:
        return None
    digest = fields.get(b"warc-payload-digest")
    return (
        len(MAGIC) + end + len(END), int(length), fields.get(b"warc-record-id"), fields[b"warc-type"],
        fields.get(b"warc-target-uri"), digest.removeprefix("sha1:") if digest else None, fields.get(b"warc-refers-to"),
    )


def _payload(block: bytes) -> tuple[int | None, bytes]:
    """Content-Length as the HTTP header gives it, and what follows that header; a block without one is all payload."""
    end = block.find(END)
    if not block.startswith(b"HTTP/") or end < 0:
        return len(block), block
    told = {k.lower(): v.strip() for k, v in _FIELD.findall(block[: end + 2])}.get(b"content-length", b"")
    return int(told) if told.isdigit() else None, block[end + len(END) :]


def _pieces(spark: SparkSession, target: str) -> DataFrame:
    limit_batches(spark, 500)
    lines = spark.read.option("lineSep", MAGIC.decode()).text(target)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _scan(pieces: DataFrame, what: str) -> DataFrame:
    """What tasks see in their splits, each in order: "headers" of candidates, "payloads" of complete records, or "raw" pieces.

    ``at`` is the offset in the split of a piece's magic; the split's own offset comes from the sizes of those before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at = None, 0
        for batch in batches:
            out = []
            for value, file, block in zip(batch.column(0), batch.column(1), batch.column(2)):
                value, here = value.as_py(), (file.as_py(), block.as_py())
                if here != place:
                    place, at = here, -len(MAGIC)
                if what == "raw":
                    out.append((*here, at, len(value), value))
                else:
                    parsed = _parse(value) if here[1] or at >= 0 else None
                    whole = bool(parsed) and parsed[0] + parsed[1] + len(END) == len(MAGIC) + len(value) and value.endswith(END)
                    head, length, *fields = parsed or (None, None, None, None, None, None, None)
                    if what == "headers":
                        out.append((*here, at, len(value), head, length, whole, *fields))
                    elif whole:
                        told, payload = _payload(value[head - len(MAGIC) : len(value) - len(END)])
                        out.append((*here, at, *fields, told, payload))
                at += len(MAGIC) + len(value)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    place = [("file", pa.string()), ("block", pa.int64()), ("at", pa.int64())]
    fields = [(x.split()[0], pa.string()) for x in FIELDS.split(", ")[:-1]]
    schema = pa.schema(
        {
            "raw": [*place, ("size", pa.int64()), ("value", pa.binary())],
            "headers": [*place, ("size", pa.int64()), ("head", pa.int64()), ("length", pa.int64()), ("whole", pa.bool_()), *fields],
            "payloads": [*place, *fields, ("payload_bytes", pa.int64()), ("payload", pa.binary())],
        }[what]
    )
    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return pieces.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def reachable(nodes: DataFrame) -> DataFrame:
    """(file, offset) of the candidates (file, offset, succ) that the chain from offset 0 reaches, by pointer jumping.

    After r rounds the first 2^r records of every file are known and pointers span 2^r records: the rounds are the
    logarithm of the longest chain. Successors are larger than offsets, so a chain cannot circle.
    """
    known = nodes.select("file", F.col("offset").alias("succ"))
    jumps = written(nodes.select("file", "offset", "succ").join(known, ["file", "succ"], "left_semi").select("file", "offset", "succ"), "jumps")
    last = written(nodes.filter("offset = 0").select("file", "offset"), "reached")
    reached = last
    while True:
        new = written(reached.join(jumps, ["file", "offset"]).select("file", F.col("succ").alias("offset")), "reached")
        if not new.limit(1).count():
            return reached
        reached = reached.unionByName(new)
        onward = jumps.select("file", F.col("offset").alias("succ"), F.col("succ").alias("end"))
        jumps = written(jumps.join(onward, ["file", "succ"]).select("file", "offset", F.col("end").alias("succ")), "jumps")


def read_warc(spark: SparkSession, target: str) -> DataFrame:
    """file, offset, FIELDS and payload of every record that the chain of its file reaches.

    payload_bytes is what the HTTP header declares (the full payload's for a revisit, whose own payload is empty).
    Reading stops in a file where its chain breaks; a record that its file cuts short is left out. Records that repeat come back
    as often as they were written; an archive without records gives no rows.
    """
    pieces = _pieces(spark, target)
    headers = written(_scan(pieces, "headers"), "headers")
    sizes = headers.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block")
    splits = sizes.select(
        F.col("file").alias("f"), F.col("block").alias("b"),
        F.coalesce(F.sum("bytes").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        (F.sum("bytes").over(Window.partitionBy("file")) - len(MAGIC)).alias("file_bytes"),
    )
    splits = small_side(written(splits, "splits"))

    def placed(rows: DataFrame) -> DataFrame:
        # the first split's pieces count from the file's start, later splits' from their first magic
        return rows.join(splits, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).withColumn("offset", F.col("base") + F.col("at")).drop("f", "b", "base")

    succ = F.col("offset") + F.col("head") + F.col("length") + len(END)
    nodes = placed(headers.filter("head is not null").drop("size")).withColumn("succ", succ).filter(F.col("succ") <= F.col("file_bytes"))
    nodes = written(nodes, "candidates")
    reached = written(reachable(nodes), "reachable")
    wanted = nodes.join(reached, ["file", "offset"], "left_semi")
    false_ones = written(nodes.filter("whole").join(reached, ["file", "offset"], "left_anti").select("file", "offset"), "rejected")
    cut = written(wanted.filter("not whole"), "cut")
    names = [x.split()[0] for x in FIELDS.split(", ")]
    whole = placed(_scan(pieces, "payloads"))
    if false_ones.limit(1).count():
        whole = whole.join(small_side(false_ones), ["file", "offset"], "left_anti")
    out = whole.select("file", "offset", *names, "payload")
    if cut.limit(1).count():
        out = out.unionByName(_joined(placed(_scan(pieces, "raw")), cut).select("file", "offset", *names, "payload"))
    return out


def _joined(raw: DataFrame, cut: DataFrame) -> DataFrame:
    """Records put together from the pieces between their offset and successor: a range join over buckets of bytes."""
    spans = cut.select("file", F.col("offset").alias("start"), "succ", F.explode(F.sequence(F.floor(F.col("offset") / BUCKET), F.floor((F.col("succ") - 1) / BUCKET))).alias("bucket"))
    raw = raw.withColumn("bucket", F.floor(F.col("offset") / BUCKET)).drop("file_bytes")
    owned = raw.join(spans, ["file", "bucket"]).filter((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("succ")))
    parts = owned.groupBy("file", "start", "succ").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                content = MAGIC.join(p["value"] for p in r["parts"])[: r["succ"] - r["start"] - len(MAGIC)]
                head, length, *fields = _parse(content)
                told, payload = _payload(content[head - len(MAGIC) : head - len(MAGIC) + length])
                if content.endswith(END):
                    out.append(dict(zip(schema.names, (r["file"], r["start"], *fields, told, payload))))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    fields = [(x.split()[0], pa.string()) for x in FIELDS.split(", ")[:-1]]
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), *fields, ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    return parts.mapInArrow(run, f"file string, offset long, {FIELDS}, payload binary")
