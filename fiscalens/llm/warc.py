"""WARC archives: written by Spark's text writer, read in byte ranges, with boundary-chain verification of their records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_folder, written

# Fixed values of the WARC 1.1 format.
MAGIC = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def mark_revisits(pages: DataFrame, key: str, html: str, least_bytes: int = 100, broadcast_rows: int = 100_000) -> DataFrame:
    """pages with payload_bytes, payload_digest and refers_to (the smallest key of equal payloads, null if that is the row's own key).

    Digests are counted with map-side combine; one row for each digest that occurs twice joins back by digest, so that no row is ever
    doubled, however often its key occurs. Up to ``broadcast_rows`` such digests (a few megabytes) are broadcast and no payload moves;
    beyond, rows are joined by a shuffle in which Spark splits a hot digest. A null payload is an empty one; a row with a null key
    refers to none and is referred to by none.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    marked = pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("payload_digest", F.sha2(payload, 256))
    large = marked.select(F.col(key).alias("_key"), "payload_bytes", F.unhex("payload_digest").alias("_digest")).where((F.col("payload_bytes") >= least_bytes) & F.col("_key").isNotNull())
    first = large.groupBy("_digest").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest", "_first")
    first = written(first, "warc-repeated")
    few = first.count() <= broadcast_rows
    joined = marked.join(F.broadcast(first) if few else first, F.unhex("payload_digest") == F.col("_digest"), "left")
    return joined.withColumn("refers_to", F.when((F.col("payload_bytes") >= least_bytes) & (F.col(key) > F.col("_first")), F.col("_first"))).drop("_digest", "_first")


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))


def to_records(marked: DataFrame, key: str, url: str, html: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One record a row, in the column value, without the two line ends that close it: the writer adds these.

    A response holds an HTTP head and the payload; a revisit holds the head alone. Control characters and spaces of an address are escaped.
    """
    revisit = F.col("refers_to").isNotNull()
    payload = F.coalesce(F.col(html), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    address = F.regexp_replace(F.regexp_replace(F.col(url), "[\\x00-\\x1F\\x7F]", "%00"), " ", "%20")
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col(key).cast("string"), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", address),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        _line("X-Payload-Length", F.col("payload_bytes")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes").cast("int"))),
        F.lit("\r\n"),
    )
    return marked.select(F.concat(head, http, F.when(revisit, F.lit("")).otherwise(payload)).alias("value"))


def write_archives(records: DataFrame, path: str, records_per_file: int = 50_000) -> None:
    """Uncompressed archives, so that any byte range can be read by itself."""
    records.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file).text(path)


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Within one byte range: where the chain from each candidate leaves the range. Work is linear in the range's candidates."""
    pdf = pdf.sort_values("offset", ignore_index=True)
    at, to = pdf["offset"].to_numpy(), pdf["next"].to_numpy().copy()
    place = np.searchsorted(at, to)
    inside = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == to)
    for i in np.flatnonzero(inside)[::-1]:  # a successor lies behind its record, so its own exit is known
        to[i] = to[place[i]]
    pdf["exit"] = to
    return pdf


def _kept(pdf: pd.DataFrame) -> pd.DataFrame:
    """Within one byte range: the candidates on the chain from its entry."""
    pdf = pdf.sort_values("offset", ignore_index=True)
    at, to = pdf["offset"].to_numpy(), pdf["next"].to_numpy()
    place = dict(zip(at.tolist(), range(len(at)), strict=True))
    keep, i = np.zeros(len(at), bool), place.get(int(pdf["entry"].iloc[0]))
    while i is not None:
        keep[i] = True
        i = place.get(int(to[i]))
    return pdf[keep]


def reachable(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Of links (file, part, offset, next), those that the chain from offset 0 of their file reaches.

    First each part (a byte range) jumps through its own links; then pointers double between parts, so the number of rounds is the
    logarithm of a file's parts, not of its records. Offsets that no candidate has end a chain.
    """
    links = written(links, "warc-links")
    part = "file string, part long, offset long, next long, exit long"
    nodes = written(links.groupBy("file", "part").applyInPandas(_exits, part), "warc-exits")
    jumps = nodes.select("file", "offset", F.col("exit").alias("to"))
    reached = nodes.where("offset = 0").select("file", "offset")
    count = -1
    for _ in range(most_rounds):
        further = reached.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reached = written(further.union(reached).distinct().join(nodes.select("file", "offset"), ["file", "offset"], "left_semi"), "warc-reached")
        now = reached.count()
        if now == count:
            break
        count = now
        after = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("then"))
        jumps = written(jumps.join(after, ["file", "to"]).select("file", "offset", F.col("then").alias("to")), "warc-jumps")
    entries = nodes.join(reached, ["file", "offset"], "left_semi").select("file", "part", F.col("offset").alias("entry"))
    known = links.join(entries, ["file", "part"])
    return known.groupBy("file", "part").applyInPandas(_kept, "file string, part long, offset long, next long, entry long").select("file", "part", "offset", "next")


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("_head"), f"(?i)(?:^|\\r\\n){name}: *([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def _slice(start: Column, size: Column) -> Column:
    """Bytes of value."""
    return F.substring(F.col("value").cast("binary"), (start + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of all archives between two occurrences of the magic line, each with its file, part and byte offset.

    Hadoop's line reader deals byte ranges to tasks and finds the magic across their borders. A range's pieces are adjacent, so
    their offsets are running sums of lengths, on top of the lengths of the file's ranges before; sums hold lengths alone.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("_row"), F.col("value"))
    return raw.withColumn("size", F.octet_length("value").cast("long") + len(MAGIC))


def _offsets(pieces: DataFrame) -> DataFrame:
    """pieces with offset: where in the file the magic before the piece begins; -10 for what stands before a file's first magic."""
    order = Window.partitionBy("file", "part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    totals = pieces.groupBy("file", "part").agg(F.sum("size").alias("_all"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    bases = totals.select("file", "part", (F.sum("_all").over(before) - F.col("_all")).alias("_base"))
    local = pieces.withColumn("_local", F.sum("size").over(order) - F.col("size"))
    return local.join(bases, ["file", "part"]).withColumn("offset", F.col("_base") + F.col("_local") - len(MAGIC)).drop("_base", "_local")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives that the chain of their lengths reaches: file, offset, record_type, record_id, url, refers_to,
    digest (as declared), payload_length (as declared), payload_bytes and payload_digest (as read; of a revisit, as declared).

    A magic line inside a payload begins a candidate, but no chain reaches it; the payload is then put together again from its
    pieces, by a join on megabytes of the file. A record whose declared length runs beyond the file ends the chain.
    """
    piece = segments(spark, path).withColumn("_head", F.when(F.instr("value", RECORD_END) > 0, F.substring_index("value", RECORD_END, 1)))
    length = F.expr("try_cast(nullif(regexp_extract(_head, '(?i)(?:^|\\\\r\\\\n)Content-Length: *([0-9]+)', 1), '') as bigint)")
    piece = piece.withColumn("_length", length).withColumn("_head_bytes", F.octet_length("_head").cast("long"))
    piece = piece.withColumn("_start", F.octet_length(F.substring_index("value", RECORD_END, 2)).cast("long") + 4)  # behind the HTTP head
    piece = piece.withColumn("_rest", F.col("_head_bytes") + 4 + F.col("_length") - F.col("_start"))
    piece = piece.select(
        "file", "part", "_row", "size", "_length", "_head_bytes", "_rest",
        _field("WARC-Type").alias("record_type"), _field("WARC-Record-ID").alias("record_id"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Refers-To").alias("refers_to"), _field("WARC-Payload-Digest").alias("digest"), _field("X-Payload-Length").alias("payload_length"),
        F.sha2(_slice(F.col("_start"), F.col("_rest")), 256).alias("_digest"))
    piece = written(_offsets(piece), "warc-pieces")
    spot = piece.where((F.col("offset") >= 0) & F.col("_length").isNotNull()).withColumn("next", F.col("offset") + len(MAGIC) + F.col("_head_bytes") + 4 + F.col("_length") + 4)
    chain = reachable(spot.select("file", "part", "offset", "next"))
    records = spot.join(chain.select("file", "part", "offset"), ["file", "part", "offset"], "left_semi")
    whole = F.col("next") == F.col("offset") + F.col("size")
    broken = records.where(~F.coalesce(whole, F.lit(False)) & (F.col("record_type") == "response")).select("file", "offset", "next")
    mended = _mend(spark, path, piece, broken)
    revisit = F.col("record_type") == "revisit"
    declared = F.regexp_replace(F.col("digest"), "^sha256:", "")
    return records.join(mended, ["file", "offset"], "left").select(
        "file", "offset", "record_type", "record_id", "url", "refers_to", "digest", F.col("payload_length").cast("long").alias("payload_length"),
        F.when(revisit, F.col("payload_length").cast("long")).otherwise(F.coalesce("_mended_bytes", "_rest")).alias("payload_bytes"),
        F.when(revisit, declared).otherwise(F.coalesce("_mended_digest", "_digest")).alias("payload_digest"))


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (file, part, size, value) in reading order, with local: the sizes of the pieces before in the same byte range."""
    at, total = None, 0
    for batch in batches:
        file, part, size = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        local = []
        for own, n in zip(zip(file, part, strict=True), size, strict=True):
            at, total = own, total if own == at else 0
            local.append(total)
            total += n
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(local, pa.int64()), batch.column(3)], names=["file", "part", "local", "value"])


def _mend(spark: SparkSession, path: str, piece: DataFrame, broken: DataFrame, step: int = 1 << 20, broadcast_rows: int = 100_000) -> DataFrame:
    """Payloads of the records that the magic line cuts: file, offset, _mended_bytes, _mended_digest.

    Their files are read again and each piece is found by its byte offset, however the second reading splits the files. Up to
    ``broadcast_rows`` sought pieces are broadcast, so that of the text only what matches moves; beyond, the join shuffles, after the
    pieces' offsets are known.
    """
    broken = written(broken, "warc-cut")
    span = broken.select("file", F.col("offset").alias("_owner"), "next", F.explode(F.sequence(F.floor(F.col("offset") / step), F.floor((F.col("next") - 1) / step))).alias("_mb"))
    parts = piece.select("file", "offset", F.floor(F.col("offset") / step).alias("_mb")).join(span, ["file", "_mb"]).where("offset >= _owner and offset < next")
    parts = written(parts.select("file", "offset", "_owner"), "warc-cut-pieces")
    few = parts.count() <= broadcast_rows
    sought = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    raw = segments(spark, path).select("file", "part", "size", "value")
    if few:  # many files are not sorted out here: sizes are summed in reading order, which a shuffle would not keep
        raw = raw.join(F.broadcast(broken.select("file").distinct()), "file", "left_semi")
    totals = raw.groupBy("file", "part").agg(F.sum("size").alias("_all"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    bases = written(totals.select("file", "part", (F.sum("_all").over(before) - F.col("_all") - len(MAGIC)).alias("_base")), "warc-cut-bases")
    local = raw.mapInArrow(_located, "file string, part long, local long, value string").join(sought(bases), ["file", "part"])
    text = local.select("file", (F.col("_base") + F.col("local")).alias("offset"), "value").join(sought(parts), ["file", "offset"])
    joined = text.groupBy("file", "_owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    joined = joined.withColumn("_start", F.octet_length(F.substring_index("value", RECORD_END, 2)).cast("long") + 4)
    joined = joined.withColumn("_rest", F.octet_length("value").cast("long") - 4 - F.col("_start"))
    return joined.select("file", F.col("_owner").alias("offset"), F.col("_rest").alias("_mended_bytes"), F.sha2(_slice(F.col("_start"), F.col("_rest")), 256).alias("_mended_digest"))


def op6(pages: DataFrame) -> DataFrame:
    """Pages written as WARC and read back, a row for each row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null ids make records without a number, which read back as null and are always responses. Rows with equal ids each have their own
    record: equal payloads refer to the smallest id that has the payload, unless it is their own. A null html is an empty payload.
    Other columns of pages are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(to_records(mark_revisits(pages.select("page_id", "url", "html"), "page_id", "html"), "page_id", "url", "html"), path)
    number = lambda c: F.regexp_extract(F.col(c), "^<urn:page:(-?[0-9]+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return read_archives(spark, path).select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))
