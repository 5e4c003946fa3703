r"""WARC archives with boundary-chain verification.

Writing: a record per page, in Spark's text sink with the record end \r\n\r\n as line separator, so
any Hadoop file system serves. Pages with equal payloads: the smallest page_id is the response,
the others are revisits without a body.

Reading: the text source splits the files at the magic `WARC/1.1\r\n` in byte ranges. Each task
parses its candidates and emits record-to-successor offsets, first shortened within its own range
to the first offset beyond it; pointer jumping over ranges from offset 0 then finds where the
true chain enters each range. Candidates off the chain (magic inside payloads) are parts of the record
before them.

Null html: payload of no bytes. Null page_id: kept, written without an id, sorts last. Equal page_id and
payload: all of them responses. Empty table: no archives and an empty result. Extra columns
are ignored. Records of several pages with equal page_id are told apart by their offset.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload) -> F.Column:
    """Upper-case base32 of SHA-1: 8 groups of 20 bits."""
    digits = F.sha1(payload)
    part = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, http: bool = True) -> None:
    """Archives in the folder `path`: response or revisit records, one for each row of pages."""
    spark = pages.sparkSession
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), (pages["url"].cast("string") if "url" in pages.columns else F.lit(None).cast("string")).alias("url"), payload.alias("payload")).withColumns({"digest": base32_sha1("payload"), "n": F.octet_length("payload").cast("long")})
    small = F.col("page_id").isNotNull() & (F.col("n") >= min_bytes)
    ids = base.where(small).select("page_id", "digest", "n")
    first = ids.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    first = common.materialize(first, "first")
    out = base.join(common.small(first), ["digest", "n"], "left")
    again = small & F.col("refers_to").isNotNull() & (F.col("refers_to") != F.col("page_id"))
    has_id = F.col("page_id").isNotNull()
    http_bytes = len(HTTP) if http else 0
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        F.when(has_id, line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", ""))).otherwise(F.lit("")),
        F.when(again, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Length", F.when(again, F.lit(http_bytes)).otherwise(F.col("n") + http_bytes).cast("string")),
        F.lit("\r\n" + (HTTP if http else "")),
    )
    body = F.when(again, F.lit(b"")).otherwise(F.col("payload"))
    out.select(F.concat(head.cast("binary"), body).cast("string").alias("value")).write.option("lineSep", END).text(path)


def parse(piece: bytes) -> tuple[int, int, dict[str, str]] | None:
    """(header bytes after the magic, content length, fields) of what follows a magic."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for x in piece[:end].split(b"\r\n"):
        k, sep, v = x.partition(b":")
        if not sep:
            return None
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not (n := fields.get("content-length", "")).isascii() or not n.isdigit():
        return None
    return end + 4, int(n), fields


SCAN = "file string, block bigint, rel bigint, size bigint, head int, content bigint, kind string, page_id bigint, refers_to bigint, x_length bigint, x_digest string, payload_bytes bigint, digest string"


def _page(x: str | None) -> int | None:
    return int(x[10:-1]) if x and x.startswith("<urn:page:") and x[10:-1].lstrip("-").isdigit() else None


def _payload(content: bytes) -> bytes:
    if content.startswith(b"HTTP/"):
        return content[content.find(b"\r\n\r\n") + 4 :]
    return content


def _digest(content: bytes) -> tuple[int, str]:
    p = _payload(content)
    return len(p), base64.b32encode(hashlib.sha1(p).digest()).decode()


def _pieces(spark, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC.decode()).option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _scan(batches):
    """Candidates of each range with offsets relative to the range's first piece."""
    key, at = None, 0
    for b in batches:
        out = []
        for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if key != (file, block):
                key, at = (file, block), 0
            got = parse(value)
            row = [file, block, at, len(value), None, None, None, None, None, None, None, None, None]
            if got:
                head, n, f = got
                row[4:11] = head, n, f.get("warc-type"), _page(f.get("warc-record-id")), _page(f.get("warc-refers-to")), int(f["x-payload-length"]) if f.get("x-payload-length", "").isdigit() else None, f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                if head + n + 4 == len(value):
                    row[11:] = _digest(value[head : head + n])
            out.append(row)
            at += len(value) + len(MAGIC)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SCAN_TYPES, strict=True)] if out else [pa.array([], t) for t in SCAN_TYPES], SCAN_NAMES)


SCAN_NAMES = [x.split()[0] for x in SCAN.split(", ")]
SCAN_TYPES = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in SCAN.split(", ")]


def _shorten(pdf):
    """For each candidate of a range, the first offset beyond the range that its chain reaches;
    null where the chain breaks."""
    pdf = pdf.sort_values("at", kind="stable")
    at, nxt = pdf["at"].to_numpy(), pdf["next"].to_numpy(dtype="float64", na_value=np.nan)
    out = np.full(len(at), -1, dtype=np.int64)
    where = {int(a): i for i, a in enumerate(at)}
    last = int(at[-1])
    for i in range(len(at) - 1, -1, -1):
        if np.isnan(nxt[i]):
            continue
        n = int(nxt[i])
        if n > last:
            out[i] = n
        elif n in where:
            out[i] = out[where[n]]
    pdf = pdf[["file", "block", "at"]].copy()
    pdf["leave"] = out
    return pdf


def _walk(pdf):
    """The candidates on the chain, from the range's entry; the others with the record they are in."""
    pdf = pdf.sort_values("at", kind="stable")
    at, nxt = pdf["at"].to_numpy(), pdf["next"].to_numpy(dtype="float64", na_value=np.nan)
    entry = pdf["entry"].iloc[0]
    where, own = {int(a): i for i, a in enumerate(at)}, np.zeros(len(at), dtype=bool)
    i = where.get(int(entry)) if entry == entry and entry is not None else None
    while i is not None:
        own[i] = True
        i = where.get(int(nxt[i])) if not np.isnan(nxt[i]) else None
    owner, held = np.full(len(at), -1, dtype=np.int64), -1
    for k in range(len(at)):
        held = int(at[k]) if own[k] else held
        owner[k] = held
    pdf = pdf[["file", "block", "at"]].copy()
    pdf["real"], pdf["owner"] = own, owner
    return pdf


def read_archives(spark, path: str) -> DataFrame:
    """file, at (offset), kind, page_id, refers_to, payload_bytes, payload_digest of each record on
    the chain. Lengths and digests are those of the stored payload; for revisits those that their header
    names."""
    common.tune(spark)
    found = common.materialize(_pieces(spark, path).mapInArrow(_scan, SCAN), "scan")
    tail = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(tail), F.lit(0)))
    # a file's first piece is what stands before its first magic: nothing, if it begins with a record
    cand = found.join(base.select("file", "block", "base"), ["file", "block"])
    cand = cand.withColumn("at", F.col("base") + F.col("rel") - len(MAGIC)).where("at >= 0")
    cand = cand.withColumn("next", F.col("at") + len(MAGIC) + F.col("head") + F.col("content") + 4)
    cand = common.materialize(cand.drop("base", "rel"), "candidates")
    links = cand.select("file", "block", "at", "next")
    jump = links.groupBy("file", "block").applyInPandas(_shorten, "file string, block bigint, at bigint, leave bigint")
    # only what some range leaves to, and the file's start, can enter a range
    jump = common.materialize(jump, "jump")
    doors = jump.where("leave >= 0").select("file", F.col("leave").alias("at")).union(jump.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    step = common.materialize(jump.join(doors, ["file", "at"], "left_semi").select("file", "at", "leave"), "step")
    deepest = links.select("file", "block").distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 0
    reach = step.where("at = 0").select("file", "at")
    for _ in range(max(0, int(deepest) - 1).bit_length()):
        reach = reach.union(reach.join(step, ["file", "at"]).where("leave >= 0").select("file", F.col("leave").alias("at"))).distinct()
        twice = step.select("file", F.col("at").alias("leave"), F.col("leave").alias("far"))
        step = step.join(twice, ["file", "leave"], "left").select("file", "at", F.coalesce("far", F.lit(-1)).alias("leave"))
        reach, step = common.materialize(reach, "reach"), common.materialize(step, "step")
    entry = reach.join(links.select("file", "at", "block"), ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"))
    real = links.join(entry, ["file", "block"], "left").groupBy("file", "block").applyInPandas(_walk, "file string, block bigint, at bigint, real boolean, owner bigint")
    real = common.materialize(real, "real")
    # a row for each record: its file's name packs well, so that Spark would take the table for a small one
    out = cand.join(real.where("real").select("file", "at").hint("merge"), ["file", "at"])
    whole = F.col("digest").isNotNull()
    done = out.where(whole).select("file", "at", "kind", "page_id", "refers_to", "x_length", "x_digest", "payload_bytes", "digest")
    parts = real.join(out.where(~whole).select("file", "at"), ["file", "at"], "left_semi").select("file", "at", F.col("at").alias("owner")).union(real.where("not real").select("file", "at", "owner"))
    if not parts.isEmpty():
        done = done.unionByName(_assembled(spark, path, out.where(~whole), real, parts))
    stored = F.col("kind") != "revisit"
    return done.select("file", "at", "kind", "page_id", "refers_to", F.when(stored, F.col("payload_bytes")).otherwise(F.col("x_length")).alias("payload_bytes"), F.when(stored, F.col("digest")).otherwise(F.col("x_digest")).alias("payload_digest"))


def _assembled(spark, path: str, out: DataFrame, real: DataFrame, parts: DataFrame) -> DataFrame:
    """Records with magic in their content: their pieces are read again and put together."""
    prior = real.groupBy("file", "block").agg(F.max(F.when(F.col("real"), F.col("at"))).alias("last"))
    held = prior.withColumn("held", F.last("last", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("file", "block", "held")
    wanted = parts.join(real.select("file", "at", "block"), ["file", "at"]).join(held, ["file", "block"], "left")
    wanted = common.materialize(wanted.select("file", "at", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("held")).alias("owner")), "parts")

    def locate(batches):
        key, rel = None, 0
        for b in batches:
            rels = []
            for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != (file, block):
                    key, rel = (file, block), 0
                rels.append(rel)
                rel += len(value) + len(MAGIC)
            yield pa.record_batch([*b.columns, pa.array(rels, pa.int64())], ["file", "block", "value", "rel"])

    pieces = _pieces(spark, path).mapInArrow(locate, "file string, block bigint, value binary, rel bigint")
    tail = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.groupBy("file", "block").agg(F.sum(F.octet_length("value") + len(MAGIC)).alias("n")).select("file", "block", F.coalesce(F.sum("n").over(tail), F.lit(0)).alias("base"))
    pieces = pieces.join(base, ["file", "block"]).withColumn("at", F.col("base") + F.col("rel") - len(MAGIC)).join(common.small(wanted), ["file", "at"]).select("file", "owner", "at", "value")

    def join(pdf):
        pdf = pdf.sort_values("at", kind="stable")
        whole = MAGIC.join(pdf["value"])
        head, n, _ = parse(whole)
        size, digest = _digest(whole[head : head + n])
        return pdf.iloc[:1][["file"]].assign(at=pdf["owner"].iloc[0], payload_bytes=size, digest=digest)

    got = pieces.groupBy("file", "owner").applyInPandas(join, "file string, at bigint, payload_bytes bigint, digest string")
    return out.drop("payload_bytes", "digest").join(got, ["file", "at"]).select("file", "at", "kind", "page_id", "refers_to", "x_length", "x_digest", "payload_bytes", "digest")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: writes the archives of all pages, reads them back."""
    path = common.new_path(spark, "archives")
    write_archives(common.read_table(spark, sf_dir, "pages"), path)
    out = read_archives(spark, path)
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
