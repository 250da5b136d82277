"""Best-fit packing of token pieces into sequences: hierarchical residual packing.

Each task packs its pieces best-fit, largest first, and emits the sequences that are nearly full. Those that are not are opened again,
and their pieces are items of the next round: a tree merges the residual items of several tasks, packs them best-fit, emits what is
nearly full, and so on, until one round holds the last ones. (Closed bins would hardly merge: no two underfull bins of a task fit
together, and two halves that do not fit may have fitted halves of another task.)

Items of one length are alike, so a round needs only how many there are of each: a task of the tree gets counts by length, at most
`fan_in` times `size` rows whatever the number of items, and returns which of them, by rank, go where. The items follow by a join. No item
is left out of a round, and no task ever holds the residual items themselves.

A document's ids and one end id make its pieces; only documents longer than a sequence are cut. Null texts count as empty and are packed
as their end id alone. Rows are packed as they are: repeated rows and rows with a null id are pieces of their own. A very long text gives
as many pieces as it needs. Other columns of the input are left alone, whatever their names. An empty table gives no rows. Which sequence
a piece is in may differ between runs with other partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Cache, stretches, table, written
from tidemark.llm.vocab import WordCoder


class _Ids:
    """The ids of whole texts as little-endian unsigned 32-bit bytes, through a bounded cache of chunks."""

    def __init__(self, path: str, cache: int = 100_000):
        self.coder, self.cache = WordCoder(path), Cache(cache)

    def batch(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        split = [self.coder.chunks(t) for t in texts]
        new = cache.missing({c for s in split for c in s})
        cache.young.update(zip(new, self.coder.ids_of_chunks(new), strict=True))
        get = cache.young.__getitem__
        out = [b"".join(map(get, s)) for s in split]
        cache.turn()
        return out


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def pieces(docs: DataFrame, path: str, text: str = "text", size: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: what is packed."""

    def cut(batches):
        coder, end = _ids(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a, z in stretches(batch.column(1)):
                rows: list[tuple] = []
                ids, texts = (batch.column(i).slice(a, z - a).to_pylist() for i in (0, 1))
                for doc, raw in zip(ids, coder.batch([t or "" for t in texts]), strict=True):
                    raw += end
                    for k, start in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[start : start + 4 * size]
                        rows.append((doc, k, start // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], counts: list[int], size: int) -> list[tuple[int, tuple[tuple[int, int], ...], int]]:
    """Bins by kind, as (how many, ((length, items), ...), total): what one gets by putting items, largest first, each into the fullest bin
    that it fits in, else into a new one. Items of one length are dealt together."""
    held: dict[int, list] = {}
    rooms: list[int] = []
    done = []

    def put(bins: int, items: tuple, room: int) -> None:
        if not room:
            done.append((bins, items, size))
        elif room in held:
            held[room].append((bins, items))
        else:
            held[room] = [(bins, items)]
            insort(rooms, room)

    for n, c in sorted(zip(lengths, counts, strict=True), reverse=True):
        if not 0 < n <= size:
            raise ValueError(f"an item of {n} places does not go into {size}")
        while c:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                bins, items = held[room].pop()
                if not held[room]:
                    del held[room], rooms[at]
            else:
                room, bins, items = size, -(-c // (size // n)), ()
            each = room // n  # a bin that takes one stays the fullest that the next fits in, until it has no room
            full = min(bins, c // each)
            if full:
                put(full, (*items, (n, each)), room - each * n)
                c -= full * each
                bins -= full
            if bins and c:  # c < each
                put(1, (*items, (n, c)), room - c * n)
                bins, c = bins - 1, 0
            if bins:
                put(bins, items, room)
    return done + [(bins, items, size - room) for room in rooms for bins, items in held[room]]


def _dealt(lengths: list[int], counts: list[int], size: int, slack: int, last: bool) -> dict[int, list[tuple]]:
    """Of each length, rows (low, high, each, sequence, offset) by rank: the items low .. high - 1 go, `each` to a sequence, to sequences
    numbered from `sequence`, from `offset` on. Ranks beyond the last row go on to the next round."""
    out: dict[int, list[tuple]] = {n: [] for n in lengths}
    taken = dict.fromkeys(lengths, 0)
    number = 0
    for bins, items, total in best_fit(lengths, counts, size):
        if total < size - slack and not last:
            continue
        offset = 0
        for n, each in items:
            out[n].append((taken[n], taken[n] + bins * each, each, number, offset))
            taken[n] += bins * each
            offset += each * n
        number += bins
    return out


def _first(size: int, slack: int, items_per_task: int):
    """Packs the pieces of a task, at most about items_per_task at a time."""

    def pack(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held, n, number, ranks = [], 0, task << 36, {}

        def packed_now() -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            length = rows.column(3).to_numpy()
            kinds, of, counts = np.unique(length, return_inverse=True, return_counts=True)
            order = np.argsort(of, kind="stable")
            begins = np.cumsum(counts) - counts
            rank = np.empty(len(of), np.int64)
            rank[order] = np.arange(len(of)) - np.repeat(begins, counts)
            sequence, offset = np.full(len(of), -1, np.int64), np.zeros(len(of), np.int64)
            most = number
            for k, (n_places, moves) in enumerate(_dealt(kinds.tolist(), counts.tolist(), size, slack, False).items()):
                own = order[begins[k] : begins[k] + counts[k]]
                for low, high, each, first, shift in moves:
                    i = np.arange(high - low)
                    sequence[own[low:high]] = number + first + i // each
                    offset[own[low:high]] = shift + i % each * n_places
                    most = max(most, number + first + (high - low) // each)
                end = moves[-1][1] if moves else 0  # the ranks of what goes on are counted over the whole task
                rank[own[end:]] += ranks.get(n_places, 0) - end
                ranks[n_places] = ranks.get(n_places, 0) + len(own) - end
            number = most
            more = [pa.array(sequence, mask=sequence < 0), pa.array(offset), pa.array(np.full(len(of), task)), pa.array(rank)]
            held.clear()
            return pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "sequence_id", "offset", "node", "rank"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= items_per_task:
                yield packed_now()
                n = 0
        if n:
            yield packed_now()

    return pack


#: Of a child's items of a length, by rank in the child: where ranks low .. high - 1 go. each 0: on to the next round, at rank + phase.
_MOVES = "node long, length long, low long, high long, phase long, each long, sequence long, start_ long"


def _round(size: int, slack: int, last: bool, base: int, bits: int, fan_in: int):
    """A round of one task of the tree: rows (node, length, n) of its children to _MOVES. Its sequences are numbered base | parent << bits
    onwards."""

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        parent = int(f["node"].iloc[0]) // fan_in
        total = f.groupby("length")["n"].sum()
        dealt = _dealt(total.index.tolist(), total.tolist(), size, slack, last)
        out = []
        for length, own in f.sort_values("node").groupby("length"):
            begin, moves, at = 0, dealt[int(length)], 0
            end_of_all = moves[-1][1] if moves else 0
            for node, n in zip(own["node"].tolist(), own["n"].tolist(), strict=True):
                while at < len(moves) and moves[at][1] <= begin:
                    at += 1
                k = at
                while k < len(moves) and moves[k][0] < begin + n:
                    low, high, each, first, shift = moves[k]
                    out.append((node, length, max(low, begin) - begin, min(high, begin + n) - begin, begin - low, each, (base | parent << bits) + first, shift))
                    k += 1
                if begin + n > end_of_all:
                    out.append((node, length, max(0, end_of_all - begin), n, begin - end_of_all, 0, 0, 0))
                begin += n
        return pd.DataFrame(out, columns=["node", "length", "low", "high", "phase", "each", "sequence", "start_"])

    return merge


def packed(items: DataFrame, size: int = 4096, slack: int = 8, fan_in: int = 16, items_per_task: int = 200_000) -> DataFrame:
    """pieces() with sequence_id and offset. A sequence with at most `slack` places left is emitted; the residual items of fan_in tasks
    meet in a task of the next round."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = [*names, "sequence_id", "offset"]
    # tokens are made once, and in a stage of their own: a task runs one Python worker at a time
    held = written(items.select(*names), "pieces")
    now = written(held.mapInArrow(_first(size, slack, items_per_task), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, node long, rank long"), "packing-0")
    done, level = now.filter("sequence_id is not null").select(*out), 0
    rest = now.filter("sequence_id is null").drop("sequence_id", "offset")
    left = rest.agg(F.max("node")).first()[0]
    while left is not None:
        level += 1
        nodes = left // fan_in + 1
        last = nodes == 1
        counts = rest.groupBy("node", "length").agg(F.count("*").alias("n"))
        again = _round(size, slack, last, level << 60, 60 - nodes.bit_length(), fan_in)
        moves = counts.groupBy(F.floor(F.col("node") / fan_in)).applyInPandas(again, _MOVES)
        went = rest.join(moves, ["node", "length"]).filter("rank >= low and rank < high").withColumn("rank", F.col("rank") + F.col("phase"))
        placed = F.col("each") > 0
        now = written(went.select(*names, F.when(placed, F.col("sequence") + F.floor(F.col("rank") / F.col("each"))).alias("sequence_id"), F.when(placed, F.col("start_") + F.pmod("rank", F.greatest(F.col("each"), F.lit(1))) * F.col("length")).alias("offset"), F.floor(F.col("node") / fan_in).alias("node"), "rank"), f"packing-{level}")
        done = done.unionByName(now.filter("sequence_id is not null").select(*out))
        rest = now.filter("sequence_id is null").drop("sequence_id", "offset")
        left = None if last else rest.agg(F.max("node")).first()[0]
    return done


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(pieces(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))
