"""Token counts of a byte-level BPE vocabulary by heap-and-linked-list merging; no ids are made.

Null texts count as empty and have no tokens. Special strings inside texts are one token each, as the library's default has it. Rows
are independent: repeated rows and null ids change nothing.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Cache, table
from tidemark.llm.vocab import BYTE_PIECES, ODD, library, vocabulary


class Counter:
    """Counts tokens of texts; the count of each unit between single spaces is held in a bounded cache."""

    def __init__(self, path: str, cache: int = 250_000):
        self.vocab, self.path = vocabulary(path), path
        self.byte_id = self.vocab.byte_id.tolist()
        self.merged = self.vocab.merged.tolist()
        self.cache = Cache(cache)
        self.pieces: dict[bytes, int] = {}

    def of_piece(self, piece: bytes) -> int:
        """Initial symbols minus merges: the lowest-ranked adjacent pair, leftmost first, is popped from the heap again and again.

        An entry is rank << 40 | left position; it is stale if the pair now at its place has another rank.
        """
        ranks, byte_id, merged = self.vocab.pair_rank, self.byte_id, self.merged
        sym = [byte_id[b] for b in piece]
        n = left = len(sym)
        heap = []
        a = sym[0]
        for i in range(1, n):
            b = sym[i]
            rank = ranks.get(a << 17 | b)
            if rank is not None:
                heap.append(rank << 40 | i - 1)
            a = b
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            a = sym[i]
            if j >= n or a < 0 or ranks.get(a << 17 | sym[j]) != top >> 40:
                continue
            sym[i] = a = merged[top >> 40]
            sym[j] = -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(a << 17 | sym[k])
                if rank is not None:
                    heappush(heap, rank << 40 | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(sym[h] << 17 | a)
                if rank is not None:
                    heappush(heap, rank << 40 | h)
        return left

    def of_text(self, text: str) -> int:
        """Any text without special strings. The library splits texts with characters whose classes depend on a Unicode version."""
        if ODD.search(text):
            letters = self.letters()
            pieces = [bytes(map(letters.__getitem__, p)) for p, _ in library(self.path).pre_tokenizer.pre_tokenize_str(text)]
        else:
            pieces = [p.encode() for p in BYTE_PIECES.findall(text)]
        out, held = 0, self.pieces
        for p in pieces:
            n = held.get(p)
            if n is None:
                n = held[p] = self.of_piece(p)
            out += n
        return out

    @lru_cache(maxsize=1)  # noqa: B019
    def letters(self) -> dict[str, int]:
        from tidemark.llm.vocab import byte_letters

        return {c: b for b, c in enumerate(byte_letters())}

    def of_unit(self, unit: str) -> int | None:
        """The count of a space and what follows it up to the next space; None if it begins with white space or ends the text with
        it: there, runs of white space join units."""
        if len(unit) == 1 or unit[1].isspace():
            return -1
        return self.of_text(unit)

    def count_batch(self, texts: list[str]) -> list[int]:
        cache, out, todo = self.cache, [], []
        for i, text in enumerate(texts):
            if not text:
                out.append(0)
            elif "<|" in text and any(s in text for s in self.vocab.specials):
                out.append(self._with_specials(text))
            else:
                out.append(-1)
                todo.append(i)
        split = [texts[i].split(" ") for i in todo]
        for u in cache.missing({u for s in split for u in s[1:]}):
            cache.young[u] = self.of_unit(" " + u)
        get = cache.young.__getitem__
        for i, s in zip(todo, split, strict=True):
            counts = list(map(get, s[1:]))
            out[i] = self.of_text(texts[i]) if -1 in counts else sum(counts) + (self.of_text(s[0]) if s[0] else 0)
        cache.turn()
        if len(self.pieces) > 2 * cache.size:
            self.pieces.clear()
        return out

    def _with_specials(self, text: str) -> int:
        import re

        parts = re.split("|".join(map(re.escape, sorted(self.vocab.specials, key=len, reverse=True))), text)
        return len(parts) - 1 + sum(self.of_text(p) for p in parts if p)


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def counted(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """The kept columns, n_bytes (UTF-8), n_tokens, and over_limit: n_tokens > limit."""

    def count(batches):
        counter = _counter(path)
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            size = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
            n: list[int] = []
            for at in range(0, len(col), 256):
                n += counter.count_batch([t or "" for t in col.slice(at, 256).to_pylist()])
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], size, n, pc.greater(n, limit)], names)

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    names = schema.names
    return docs.select(*keep, F.col(text)).mapInArrow(count, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
