"""Removal of repeated passages: every byte of a string of `length` bytes that also starts earlier in the corpus goes.

Texts are UTF-8 bytes; matches never cross texts. Earlier means a smaller doc_id, or the same text and an earlier start; null ids come
last, and rows of equal id are in the order in which they were read. Null and empty texts, and texts shorter than `length`, keep all.
An empty table gives no rows.

1. Texts are written as compressed blocks. Minimizers cut the starts of each text into short runs, so that equal strings are in runs
   with equal anchors.
2. Anchors are counted over all blocks, once for each block; only runs whose anchor recurs go on.
3. Equal runs that meet in a task are one segment, at its earliest place; the later ones are repeats as a whole.
4. Segments meet by anchor; equal ones of several tasks are collapsed as in step 3. An anchor that has one segment left, or only
   different ones of `length` bytes, has no more repeats. Among the others a Burrows-Wheeler transform and threshold-bounded interval
   expansion find all strings of `length` bytes that start more than once, and all but the earliest start are repeats. Anchors with
   very many occurrences are taken apart into single strings first, so that no task gets an unbounded group.
5. The repeats of each block are joined to spans and cut out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.anchors import CHUNK, anchors
from tidemark.llm.bwt import END, later_copies
from tidemark.llm.common import stretches, table, written

#: Longer texts are cut into overlapping parts when anchors are sought.
PART = 4 * CHUNK
#: Texts of a block, at most; an id of a text is its block's id << 16 | its place in the block.
TEXTS = 1 << 15
LAST = np.iinfo(np.int64).max
_BLOCKS = "block long, n_bytes long, doc_ids array<long>, sizes array<long>, data binary"
_SEGMENT = np.dtype([("doc", "<i8"), ("uid", "<i8"), ("start", "<i8"), ("size", "<i8")])
_SPAN = np.dtype([("place", "<i4"), ("low", "<i8"), ("high", "<i8")])


def blocks(docs: DataFrame, text: str = "text", carry: str | None = None) -> DataFrame:
    """The corpus as blocks of about CHUNK bytes (a longer text is a block of its own), compressed. carry: a struct column that goes
    along with each text."""

    def cut(batches):
        import zstandard
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 24, 0
        pack = zstandard.ZstdCompressor(level=3)
        ids: list = []
        more: list[pa.Array] = []
        held: list[bytes] = []
        size = 0

        def row():
            nonlocal n, ids, more, held, size
            along = pa.concat_arrays(more) if carry else None
            out = pa.RecordBatch.from_arrays([pa.array([base | n], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, held))], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(held))], pa.binary()), *([pa.ListArray.from_arrays(pa.array([0, len(along)], pa.int32()), along)] if carry else [])], names)
            n, ids, more, held, size = n + 1, [], [], [], 0
            return out

        for batch in batches:
            texts = batch.column(1)
            for a, z in stretches(texts, CHUNK, TEXTS):
                begin = a
                for at, (doc, t) in enumerate(zip(batch.column(0).slice(a, z - a).to_pylist(), texts.slice(a, z - a).cast(pa.binary()).to_pylist(), strict=True), a):
                    t = t or b""
                    if held and (size + len(t) > CHUNK or len(held) == TEXTS):
                        if carry and at > begin:
                            more.append(batch.column(2).slice(begin, at - begin))
                        begin = at
                        yield row()
                    ids.append(doc)
                    held.append(t)
                    size += len(t)
                if carry and z > begin:
                    more.append(batch.column(2).slice(begin, z - begin))
        if held:
            yield row()

    names = ["block", "n_bytes", "doc_ids", "sizes", "data", *(["carry"] if carry else [])]
    schema = _BLOCKS + (f", carry array<{docs.schema[carry].dataType.simpleString()}>" if carry else "")
    return written(docs.select(F.col("doc_id").cast("long"), F.col(text), *([carry] if carry else [])).mapInArrow(cut, schema), "blocks")


def _each(batches, *columns: str):
    """These columns of each row, made one row at a time: a row is a block, and a batch can hold very many."""
    for batch in batches:
        at = [batch.column(c) for c in columns]
        for i in range(batch.num_rows):
            yield batch, i, *(c[i].as_py() for c in at)


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def block_anchors(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """anchors() of a block; long texts go in overlapping parts."""
    if len(data) <= PART:
        return anchors(data, sizes, length)
    out, begin = [], 0
    for i, n in enumerate(sizes.tolist()):
        for at in range(0, max(1, n - length + 1), PART - length + 1):
            part = data[begin + at : begin + min(n, at + PART)]
            t, s, r, h = anchors(part, np.array([len(part)]), length)
            out.append((t + i, s + at, r, h))
        begin += n
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """An order of distinct hashes by bucket, the buckets that have any, and where each one's begin in that order (with the end)."""
    of = (hashes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(of, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(of[by]) != 0]) if len(by) else by
    return by, of[by][at], [*at.tolist(), len(by)]


def _recurring(table_: DataFrame, length: int, buckets: int, hot: int) -> DataFrame:
    """block, found: for each block, (bucket, bits) of the anchors that go on: two bits for each of the block's distinct hashes in the
    bucket, in order: other blocks have it; it is hot. A block sends its hashes and, compressed, how often each occurs in it."""

    def named(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for _, _, block, sizes, data in _each(batches, "block", "sizes", "data"):
            h = block_anchors(_unpacked(data), np.array(sizes, np.int64), length)[3]
            if not len(h):
                continue
            h, count = np.unique(h, return_counts=True)
            by, own, at = _by_bucket(h, buckets)
            count = np.minimum(count, 2**31 - 1).astype("<u4")
            ends = list(zip(at, at[1:], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), block)), pa.array([h[by[a:z]].tobytes() for a, z in ends], pa.binary()), pa.array([pack.compress(count[by[a:z]].tobytes()) for a, z in ends], pa.binary())], ["bucket", "block", "hashes", "counts"])

    def met(f: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        parts = [np.frombuffer(x, "<i8") for x in f["hashes"]]
        counts = np.concatenate([np.frombuffer(unpack.decompress(x), "<u4") for x in f["counts"]])
        _, inverse, blocks_with = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        total = np.bincount(inverse, weights=counts)
        is_hot = total[inverse] > hot
        go = (blocks_with[inverse] > 1) | is_hot
        ends = np.cumsum([len(p) for p in parts]).tolist()
        out = [np.packbits(np.r_[go[z - len(p) : z], is_hot[z - len(p) : z]]).tobytes() for p, z in zip(parts, ends, strict=True)]
        return pd.DataFrame({"block": f["block"], "bucket": f["bucket"], "bits": out})

    rows = table_.select("block", "sizes", "data").mapInArrow(named, "bucket long, block long, hashes binary, counts binary")
    return rows.groupBy("bucket").applyInPandas(met, "block long, bucket long, bits binary").groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("found"))


def _segments(joined: DataFrame, length: int, buckets: int, spread: int, flush: int = 48 << 20) -> DataFrame:
    """Rows of two kinds: with a bucket, segments that have to meet; without one, repeats of a block. buckets: of _recurring; spread: of
    what has to meet. Texts and records are compressed."""

    def gathered(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        held: dict[bytes, tuple] = {}
        repeats: dict[int, list] = {}
        size = 0

        def rows():
            nonlocal held, repeats, size
            by: dict[int, list] = {}
            for key, (of, rec) in held.items():
                by.setdefault(of, []).append((rec, key))
            out = [(b, None, pack.compress(np.array([r for r, _ in x], _SEGMENT).tobytes()), pack.compress(b"".join([k for _, k in x]))) for b, x in by.items()]
            out += [(None, block, np.array(x, _SPAN).tobytes(), b"") for block, x in repeats.items()]
            held, repeats, size = {}, {}, 0
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "records", "data"])

        def put(key: bytes, of: int, rec: tuple) -> None:
            nonlocal size
            old = held.get(key)
            if old is None:
                size += len(key) + 200
                held[key] = of, rec
                return
            if rec < old[1]:
                held[key], rec = (of, rec), old[1]
            repeats.setdefault(rec[1] >> 16, []).append((rec[1] & 0xFFFF, rec[2], rec[2] + rec[3]))
            size += 60

        for _, _, block, ids, sizes, data, found in _each(batches, "block", "doc_ids", "sizes", "data", "found"):
            data, sizes = _unpacked(data), np.array(sizes, np.int64)
            text, start, run, h = block_anchors(data, sizes, length)
            if not len(h):
                continue
            hashes, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            go, hot = count[inverse] > 1, np.zeros(len(hashes), bool)
            met_by = {x["bucket"]: x["bits"] for x in found or ()}
            by, own, ends = _by_bucket(hashes, buckets)
            again = np.zeros(len(hashes), bool)
            for bucket, a, z in zip(own.tolist(), ends, ends[1:], strict=False):
                bits = np.unpackbits(np.frombuffer(met_by[bucket], np.uint8), count=2 * (z - a)).astype(bool)
                again[by[a:z]], hot[by[a:z]] = bits[: z - a], bits[z - a :]
            go |= again[inverse]
            hot = hot[inverse]
            begins = np.cumsum(sizes) - sizes
            raw = data.tobytes()
            of = ((h.view(np.uint64) >> np.uint64(20)) % np.uint64(spread)).astype(np.int64)
            at = np.flatnonzero(go)
            for t, s, r, b, p, x in zip(text[at].tolist(), start[at].tolist(), run[at].tolist(), of[at].tolist(), begins[text[at]].tolist(), hot[at].tolist(), strict=True):
                doc = LAST if ids[t] is None else ids[t]
                uid = block << 16 | t
                if x:
                    for k in range(s, s + r):
                        key = raw[p + k : p + k + length]
                        put(key, zlib.crc32(key) % spread, (doc, uid, k, length))
                else:
                    put(raw[p + s : p + s + r + length - 1], b, (doc, uid, s, r + length - 1))
                if size > flush:
                    yield rows()
        if held or repeats:
            yield rows()

    return joined.select("block", "doc_ids", "sizes", "data", "found").mapInArrow(gathered, "bucket long, block long, records binary, data binary")


def _met(length: int, most: int = 1 << 20):
    """The repeats among the segments of a bucket. Groups of an anchor go to the transform together, about `most` bytes at once."""

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        rec = np.concatenate([np.frombuffer(unpack.decompress(x), _SEGMENT) for x in f["records"]])
        raw = b"".join([unpack.decompress(x) for x in f["data"]])
        ends = np.cumsum(rec["size"]).tolist()
        keys = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        # equal segments of several tasks: the earliest stays, the others are repeats as a whole
        order = np.lexsort((rec["start"], rec["uid"], rec["doc"]))
        first: dict[bytes, int] = {}
        # in order, from here on
        own = np.array([i for i in order.tolist() if first.setdefault(keys[i], i) == i], np.int64)
        del first, raw
        whole = np.ones(len(rec), bool)
        whole[own] = False
        again = rec[whole]
        spans = [(again["uid"], again["start"], again["start"] + again["size"])]
        # the others share strings only with others of their anchor, and those of `length` bytes alone with longer ones
        at = [0, *(own_ends := np.cumsum(rec["size"][own])).tolist()]
        hashes = np.empty(len(own), np.int64)
        i = 0
        while i < len(own):
            z = max(i + 1, int(np.searchsorted(own_ends, at[i] + CHUNK, "right")))
            # all starts of a segment have one anchor
            hashes[i:z] = anchors(np.frombuffer(b"".join([keys[j] for j in own[i:z].tolist()]), np.uint8), rec["size"][own[i:z]], length)[3]
            i = z
        _, group, n = np.unique(hashes, return_inverse=True, return_counts=True)
        longest = np.zeros(len(n), np.int64)
        np.maximum.at(longest, group, rec["size"][own])
        go = np.flatnonzero((n[group] > 1) & (longest[group] > length))
        go = go[np.argsort(group[go], kind="stable")]
        total = np.cumsum(rec["size"][own[go]])
        cuts = np.flatnonzero(np.r_[True, np.diff(group[go]) != 0]) if len(go) else go
        while len(cuts):
            a = int(cuts[0])
            cuts = cuts[np.searchsorted(total[cuts] - total[a], most, "right") :]
            z = int(cuts[0]) if len(cuts) else len(go)
            some = own[np.sort(go[a:z])]
            spans.append(transformed(rec[some], [keys[j] for j in some.tolist()]))
        uid, low, high = (np.concatenate(x) for x in zip(*spans, strict=True))
        span = np.empty(len(uid), _SPAN)
        span["place"], span["low"], span["high"] = uid & 0xFFFF, low, high
        block = uid >> 16
        by = np.argsort(block, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(block[by]) != 0]) if len(by) else by
        return pd.DataFrame({"block": block[by][cut], "records": [p.tobytes() for p in np.split(span[by], cut[1:])] if len(cut) else []})

    def transformed(rec: np.ndarray, keys: list[bytes]) -> tuple[np.ndarray, ...]:
        """uid, low and high of the later copies in segments, which are given in order."""
        data = np.frombuffer(b"".join(keys), np.uint8)
        size = rec["size"]
        ends = np.cumsum(size)
        ended = np.full(len(data) + len(rec), END, np.uint8)
        seg = np.repeat(np.arange(len(rec)), size)
        ended[np.arange(len(data)) + seg] = data
        begins = ends - size + np.arange(len(rec))
        runs = size - length + 1
        of = np.repeat(np.arange(len(rec)), runs)
        owned = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs) + begins[of]
        later = later_copies(ended, owned, of, length)
        of = np.searchsorted(begins, later, "right") - 1
        at = np.flatnonzero(np.r_[True, (later[1:] != later[:-1] + 1) | (of[1:] != of[:-1])]) if len(later) else np.zeros(0, np.int64)
        last = np.r_[at[1:], len(later)] - 1 if len(later) else at
        seg = of[at]
        return rec["uid"][seg], rec["start"][seg] + later[at] - begins[seg], rec["start"][seg] + later[last] - begins[seg] + length

    return meet


def spans_of(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans, as maximal runs in order."""
    by = np.argsort(low, kind="stable")
    low, top = low[by], np.maximum.accumulate(high[by])
    new = np.flatnonzero(np.r_[True, low[1:] > top[:-1]])
    return low[new], top[np.r_[new[1:], len(low)] - 1]


def cleaned(docs: DataFrame, text: str = "text", length: int = 100, bytes_per_task: int = 32 << 20, hot: int = 30_000, outputs: str = "digest", carry: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with outputs="text", kept (string; bytes of a character that
    was cut apart are left out) and spans (array of low, high) in place of the digest; and the struct column `carry`, if named."""
    held = blocks(docs, text, carry)
    total = held.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // bytes_per_task))
    found = _recurring(held, length, buckets, hot)
    rows = written(_segments(held.join(found, "block", "left"), length, buckets, 4 * buckets), "segments")
    met = rows.filter("bucket is not null").select("bucket", "records", "data").groupBy("bucket").applyInPandas(_met(length), "block long, records binary")
    repeats = met.unionByName(rows.filter("block is not null").select("block", "records")).groupBy("block").agg(F.collect_list("records").alias("records"))

    def cut(batches):
        for batch, row_at, ids, sizes, data, records in _each(batches, "doc_ids", "sizes", "data", "records"):
            raw = _unpacked(data).tobytes()
            spans = np.concatenate([np.frombuffer(x, _SPAN) for x in records]) if records else np.zeros(0, _SPAN)
            spans = spans[np.argsort(spans["place"], kind="stable")]
            at = np.searchsorted(spans["place"], np.arange(len(ids) + 1)).tolist()
            out, begin = [], 0
            for i, n in enumerate(sizes):
                own = spans[at[i] : at[i + 1]]
                mine = raw[begin : begin + n]
                begin += n
                low = high = np.zeros(0, np.int64)
                if len(own):
                    low, high = spans_of(own["low"], own["high"])
                parts = [mine[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), n], strict=True)]
                kept = b"".join(parts)
                row = (ids[i], n, n - len(kept), len(low))
                out.append((*row, hashlib.sha256(kept).hexdigest()) if outputs == "digest" else (*row, kept.decode("utf-8", "ignore"), [{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)]))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *([batch.column("carry").slice(row_at, 1).flatten()] if carry else [])], names)

    names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans"], [pa.int64()] * 4
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, "
    if outputs == "digest":
        names, kinds, schema = [*names, "kept_sha256"], [*kinds, pa.string()], schema + "kept_sha256 string"
    else:
        names, kinds, schema = [*names, "kept", "spans"], [*kinds, pa.string(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))], schema + "kept string, spans array<struct<low:long,high:long>>"
    if carry:
        names, schema = [*names, carry], f"{schema}, `{carry}` {docs.schema[carry].dataType.simpleString()}"
    return held.join(repeats, "block", "left").select("doc_ids", "sizes", "data", "records", *(["carry"] if carry else [])).mapInArrow(cut, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents", "doc_id", "text"))


OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
cut AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM later),
grp AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM cut),
span AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM grp GROUP BY doc_id, g),
part AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM span),
gone AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
    string_agg(substring(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head
  FROM part JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
