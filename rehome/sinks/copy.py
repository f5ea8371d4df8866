"""Copy objects between stores, file by file inside Spark tasks, with an audit row for each."""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime, timezone

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rehome.functions.names import move_path
from rehome.functions.text import clock_text, elapsed_seconds
from rehome.lineage import cut
from rehome.operators.picks import first_rows, union_frames
from rehome.sinks.swap import discard, put_in_place
from rehome.sources.objects import FAILURES, leaf_files, open_path, width

INCOMING = "__incoming"
CHUNK = 8 << 20
BYTES_EACH = 1 << 30  # bytes of one copying task, about

FILE_SCHEMA = (
    "src_path STRING, dst_path STRING, inside STRING, bytes LONG, digest STRING, start_time TIMESTAMP,"
    " end_time TIMESTAMP, error STRING"
)
SWAP_SCHEMA = (
    "src_path STRING, dst_path STRING, files LONG, bytes LONG, copied_files LONG, copied_bytes LONG, digest STRING,"
    " start_time TIMESTAMP, end_time TIMESTAMP, status STRING, error STRING"
)


def copy_plan(objects: DataFrame, recovery: DataFrame, **rename) -> DataFrame:
    """Objects (item_id, schema, name, type, src_path) with the path they go to.

    ``rename`` is handed to ``move_path``: by id, or by name with a suffix.
    """
    stores = recovery.select(
        F.col("primary_id").alias("item_id"),
        "primary_id",
        "primary_ws_id",
        "primary_ws_name",
        "primary_name",
        "secondary_ws_id",
        "secondary_ws_name",
        "secondary_id",
        "secondary_name",
    )
    by_name = rename.get("by") == "name"
    ends = ("ws_name", "name") if by_name else ("ws_id", "id")
    target = move_path(
        "src_path",
        *[f"{side}_{ends[0]}" for side in ("primary", "secondary")],
        *[f"{side}_{ends[1]}" for side in ("primary", "secondary")],
        **rename,
    )
    return objects.join(stores, "item_id").select(
        "item_id",
        "schema",
        "name",
        "type",
        "src_path",
        target.alias("dst_path"),
        "secondary_ws_id",
        "secondary_id",
    )


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _rows(columns: str, found: list) -> pd.DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]
    return pd.DataFrame(found, columns=names, dtype=object)


class _Digest:
    """The digest of a file: SHA-256 of the digests of its chunks, one after the other, as hex."""

    def __init__(self):
        self.chunks, self.size = hashlib.sha256(), 0

    def add(self, chunk: bytes) -> None:
        self.chunks.update(hashlib.sha256(chunk).hexdigest().encode())
        self.size += len(chunk)

    def text(self) -> str:
        return self.chunks.hexdigest()


def _chunks(stream):
    """Pieces of exactly CHUNK bytes, but for the last: a store may hand out less than it is asked for."""
    held = b""
    while piece := stream.read(CHUNK - len(held)):
        held += piece
        if len(held) == CHUNK:
            yield held
            held = b""
    if held:
        yield held


def _digest_of(system, path: str) -> _Digest:
    found = _Digest()
    with system.open_input_stream(path) as stream:
        for chunk in _chunks(stream):
            found.add(chunk)
    return found


def _stream(source: str, target: str, partials: str) -> _Digest:
    """One file, in chunks, in the folder for partial files until it is whole and has been read again.

    A file that this run has copied before, in an attempt that was lost, stays.
    """
    reader, inside = open_path(source)
    writer, place = open_path(target)
    there, given = writer.get_file_info(place), reader.get_file_info(inside)
    if there.type == fs.FileType.File and there.size == given.size:
        found = _digest_of(reader, inside)
        if _digest_of(writer, place).text() == found.text():
            return found
    folder = open_path(partials)[1]
    for path in (place.rsplit("/", 1)[0], folder):
        writer.create_dir(path, recursive=True)
    partial, found = f"{folder}/{uuid.uuid4().hex}", _Digest()
    with reader.open_input_stream(inside) as incoming, writer.open_output_stream(partial) as outgoing:
        for chunk in _chunks(incoming):
            outgoing.write(chunk)
            found.add(chunk)
    if _digest_of(writer, partial).text() != found.text():
        raise OSError(f"{target} does not hold what was read from {source}")
    writer.move(partial, place)
    return found


def _copy_batches(batches):
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            start, size, digest, error = _now(), 0, None, row.error
            try:
                if error is None:
                    found = _stream(row.path, row.target, row.partials)
                    size, digest = found.size, found.text()
            except FAILURES as problem:
                error = str(problem)
            yield _rows(FILE_SCHEMA, [(row.src_path, row.dst_path, row.inside, size, digest, start, _now(), error)])


def _compare_batches(batches):
    """Whether two files of one size have the same content; one that cannot be read is another."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            try:
                digest = _digest_of(*open_path(row.path)).text()
                same = digest == _digest_of(*open_path(row.there)).text()
            except FAILURES:
                digest, same = None, False
            out.append((row.dst_path, row.inside, digest, same))
        yield _rows("dst_path, inside, digest, same", out)


def _swap_batches(batches):
    for pdf in batches:
        pdf = pdf.astype(object).where(pdf.notna(), None)
        out = []
        for row in pdf.itertuples(index=False):
            start = row.start_time or _now()
            try:
                status, error = _exchange(row)
            except FAILURES as problem:
                status, error = "failed", str(problem)
            out.append((row.src_path, row.dst_path, row.files, row.bytes, row.copied_files, row.copied_bytes, row.digest, start, _now(), status, error))
        yield _rows(SWAP_SCHEMA, out)


def _exchange(row) -> tuple[str, str | None]:
    system, place = open_path(row.dst_path)
    staging, partials = open_path(row.staging)[1], open_path(row.partials)[1]
    try:
        if row.error is not None:
            discard(system, staging)
            return "failed", row.error
        if row.files == 0:
            source, inside = open_path(row.src_path)
            if source.get_file_info(inside).type == fs.FileType.NotFound:
                return "missing", "no such source"
            system.create_dir(staging, recursive=True)
        removed = None if row.removed is None else list(row.removed)
        error = put_in_place(system, staging, place, row.run, row.files, row.bytes, removed)
        return ("failed", error) if error else ("copied", None)
    finally:
        discard(system, partials)


def object_digest(inside: Column | str = "inside", size: Column | str = "bytes", digest: Column | str = "digest") -> Column:
    """One digest for the files of an object, whatever their order: the SHA-256 of a sum over the files.

    Each file counts with the first 15 hex digits of the SHA-256 of ``name:size:digest``.
    """
    one = F.sha2(F.concat_ws(":", inside, size, digest).cast("binary"), 256)
    return F.sha2(F.sum(F.conv(F.left(one, F.lit(15)), 16, 10).cast("decimal(38,0)")).cast("string").cast("binary"), 256)


def _below(whole: str, root: str) -> Column:
    return F.substring(F.col(whole), F.length(root) + F.lit(1), F.length(whole))


def copy_objects(
    plan: DataFrame,
    *,
    parallelism: int | None = None,
    inventory: DataFrame | None = None,
    bytes_each: int = BYTES_EACH,
    changes_only: bool = False,
) -> DataFrame:
    """Carry out a plan (src_path, dst_path): one audit row for each object.

    Files are listed and streamed in tasks of their own, as many as the bytes ask for, so one
    object with most of the files is copied by all of them. ``inventory`` (src_path, path, size) is a
    file table to copy by, in place of listing. Files gather under a name of this run beside the
    target, each is read again and compared with what was sent, and an object is put in place when all of
    them have arrived. The old target is set aside, and deleted when the new one is whole in its place; a
    failure brings it back (``rehome.sinks.swap``). Where several sources have one target, the
    first by path is copied, and the others are reported as ``collision``. Both steps are written
    out, so reading the audit copies nothing.

    With ``changes_only`` the target is listed too. Files of equal name, size and content stay where they
    are, others are copied over them, and files that the source has no more are removed; an object
    without a difference is ``unchanged``. ``files``, ``bytes`` and ``digest`` (``object_digest``) are those of the whole
    object, ``copied_files`` and ``copied_bytes`` what was moved.
    """
    spark = plan.sparkSession
    run = uuid.uuid4().hex[:12]
    ends = [F.when(F.rtrim(c, F.lit("/")) == "", F.left(c, F.lit(1))).otherwise(F.rtrim(c, F.lit("/"))).alias(c) for c in ("src_path", "dst_path")]
    plan = cut(plan.select(*ends).distinct())
    single = first_rows(plan, ["dst_path"], ["src_path"])
    n = parallelism or width(spark)
    if inventory is None:
        files = leaf_files(single.withColumn("path", F.col("src_path")))
    else:
        listed = inventory.select(F.rtrim("src_path", F.lit("/")).alias("src_path"), "path", "size", F.lit(None).cast("string").alias("error"))
        files = listed.join(single, "src_path")
    work = files.select("src_path", "dst_path", "path", _below("path", "src_path").alias("inside"), "size", "error")
    kept, removed = None, None
    if changes_only:
        work = cut(work)
        kept, removed = _differences(work, single, n, bytes_each)
        work = work.join(kept.select("dst_path", "inside"), ["dst_path", "inside"], "left_anti")
    if inventory is not None or changes_only:
        work = cut(work)
    incoming = F.concat("dst_path", F.lit(f"{INCOMING}_{run}"))
    sent = work.select("src_path", "dst_path", "inside", "path", F.concat(incoming, "inside").alias("target"),
                       F.concat(incoming, F.lit(".partial")).alias("partials"), "size", "error")
    shares = parallelism or max(n, -(-(work.agg(F.sum("size")).first()[0] or 0) // bytes_each))
    copied = cut(sent.drop("size").repartition(shares, "path").mapInPandas(_copy_batches, FILE_SCHEMA))
    parts = copied.withColumn("moved", F.lit(1))
    if kept is not None:
        parts = union_frames(parts, kept.join(single, "dst_path").withColumn("moved", F.lit(0)))
    objects = parts.groupBy("src_path", "dst_path").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("bytes").alias("bytes"),
        F.sum("moved").alias("copied_files"),
        F.sum(F.col("bytes") * F.col("moved")).alias("copied_bytes"),
        object_digest().alias("digest"),
        F.min("start_time").alias("start_time"),
        F.max("error").alias("error"),
    )
    filled = single.join(objects, ["src_path", "dst_path"], "left").fillna(0, ["files", "bytes", "copied_files", "copied_bytes"])
    filled = filled.withColumns({"run": F.lit(run), "staging": incoming, "partials": F.concat(incoming, F.lit(".partial"))})
    none = F.lit(None).cast("array<string>")
    if removed is None:
        filled, same = filled.withColumn("removed", none), None
    else:
        filled = cut(filled.join(removed, "dst_path", "left").withColumn("removed", F.when(F.col("files") > 0, F.coalesce("removed", F.array().cast("array<string>")))))
        untouched = (F.col("copied_files") == 0) & (F.size("removed") == 0) & F.col("error").isNull() & (F.col("files") > 0)
        same = filled.filter(untouched).select("src_path", "dst_path", "files", "bytes", "copied_files", "copied_bytes", "digest", F.lit("unchanged").alias("status"))
        filled = filled.filter(~F.coalesce(untouched, F.lit(False)))
    done = cut(filled.repartition(n, "dst_path").mapInPandas(_swap_batches, SWAP_SCHEMA))
    rivals = plan.join(single, ["src_path", "dst_path"], "left_anti").select(
        "src_path", "dst_path", F.lit("collision").alias("status")
    )
    return copy_audit(union_frames(done, rivals) if same is None else union_frames(done, same, rivals))


def _differences(work: DataFrame, single: DataFrame, n: int, bytes_each: int) -> tuple[DataFrame, DataFrame]:
    """(files that the target holds as they are, the names it holds beyond the source's, by object)."""
    listed = leaf_files(single.select("dst_path", F.col("dst_path").alias("path"))).filter("error IS NULL")
    there = cut(listed.select("dst_path", _below("path", "dst_path").alias("inside"), F.col("path").alias("there"), "size"))
    mine = work.filter("error IS NULL")
    pairs = cut(mine.join(there, ["dst_path", "inside", "size"]).select("dst_path", "inside", "path", "there", "size"))
    shares = max(n, -(-(pairs.agg(F.sum("size")).first()[0] or 0) // bytes_each))
    compared = pairs.select("dst_path", "inside", "path", "there").repartition(shares, "path").mapInPandas(
        _compare_batches, "dst_path STRING, inside STRING, digest STRING, same BOOLEAN")
    kept = cut(compared.filter("same").drop("same").join(pairs.select("dst_path", "inside", F.col("size").alias("bytes")), ["dst_path", "inside"]))
    gone = there.join(mine.select("dst_path", "inside"), ["dst_path", "inside"], "left_anti")
    return kept, gone.groupBy("dst_path").agg(F.collect_list("inside").alias("removed"))


def verify_objects(plan: DataFrame, *, parallelism: int | None = None, bytes_each: int = BYTES_EACH) -> DataFrame:
    """Compare each object of a plan (src_path, dst_path) with its copy, content and all; nothing is written.

    A row each: files, same, differing, missing (in the target), extra, and ``equal`` or ``different``.
    """
    n = parallelism or width(plan.sparkSession)
    single = cut(plan.select(*[F.rtrim(c, F.lit("/")).alias(c) for c in ("src_path", "dst_path")]).distinct())
    files = cut(leaf_files(single.withColumn("path", F.col("src_path"))).select(
        "src_path", "dst_path", "path", _below("path", "src_path").alias("inside"), "size", "error"))
    kept, removed = _differences(files, single.select("dst_path").distinct(), n, bytes_each)
    there = leaf_files(single.select("dst_path").distinct().withColumn("path", F.col("dst_path"))).select(
        "dst_path", _below("path", "dst_path").alias("inside"), F.lit(True).alias("found"))
    told = (files.join(kept.select("dst_path", "inside", F.lit(True).alias("same")), ["dst_path", "inside"], "left")
            .join(there, ["dst_path", "inside"], "left").groupBy("src_path", "dst_path").agg(
                F.count(F.lit(1)).alias("files"), F.count("same").alias("same"),
                F.count_if(F.col("found").isNotNull() & F.col("same").isNull()).alias("differing"), F.count_if(F.col("found").isNull()).alias("missing")))
    counted = single.join(told, ["src_path", "dst_path"], "left").join(removed, "dst_path", "left")
    extra = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed"))
    return counted.fillna(0, ["files", "same", "differing", "missing"]).withColumn("extra", extra).drop("removed").withColumn(
        "status", F.when((F.col("files") == F.col("same")) & (F.col("extra") == 0), "equal").otherwise("different"))


def copy_audit(timed: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Timed rows with readable clock times and elapsed seconds."""
    return timed.withColumns(
        {
            "start_text": clock_text(start),
            "end_text": clock_text(end),
            "elapsed_seconds": elapsed_seconds(start, end),
        }
    )
