"""BPE encoding and decoding: frequent words come from a minimal acyclic transducer, all others are merged exactly.

Null texts count as empty, empty texts have no ids; rows are independent, so repeated rows, ties and null ids of documents change
nothing, and other columns of the input are left alone.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Cache, dropped, table, written
from tidemark.llm.lexicon import Lexicon, compiled
from tidemark.llm.vocab import WordCoder

#: Distinct words counted in memory before a task hands its counts on.
COUNTED = 200_000


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """piece, n: how often each piece of all texts occurs. Tasks add up what they read before anything is shuffled."""

    def count(batches):
        from collections import Counter

        coder = WordCoder(path)

        def out(chunks: Counter) -> pa.RecordBatch:
            held: Counter = Counter()
            for c, n in chunks.items():
                for p in coder.pieces(c):
                    held[p] += n
            return pa.RecordBatch.from_arrays([pa.array([p.decode() for p in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["piece", "n"])

        chunks: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                chunks.update(coder.chunks(t or ""))
                if len(chunks) > COUNTED:
                    yield out(chunks)
                    chunks = Counter()
        yield out(chunks)

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def lexicon_block(docs: DataFrame, path: str, text: str = "text", size: int = 65_536) -> bytes:
    """The compiled lexicon of the most frequent pieces over all texts, at most `size` (of equally frequent ones all or none). `size` bounds
    it to a few MB."""
    counts = written(word_counts(docs, path, text).filter(F.length("piece") <= 64), "pieces")
    # the least count that at most `size` pieces have or exceed: a histogram of counts is small, whatever the number of pieces
    least, total = None, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("pieces")).orderBy(F.desc("n")).toLocalIterator():
        total += r["pieces"]
        if total > size:
            break
        least = r["n"]
    words = [] if least is None else [r[0].encode() for r in counts.filter(F.col("n") >= least).select("piece").collect()]
    dropped(counts)
    if not words:
        return compiled([], [])
    ids, at = WordCoder(path).vocab.merge_all(words)
    return compiled(words, [ids[at[i] : at[i + 1]].astype("<u4").tobytes() for i in range(len(words))])


class Codec:
    """Encodes texts to ids and decodes ids as the tokenizers library does for a vocabulary without decoder."""

    def __init__(self, path: str, block: bytes | None = None, cache: int = 150_000):
        self.coder = WordCoder(path, Lexicon(block) if block else None)
        self.texts = self.coder.vocab.texts
        self.numbers = [str(i) for i in range(len(self.texts))]
        self.cache = Cache(cache)

    def decode(self, ids) -> str:
        """Tokens joined by one space: the vocabulary names no decoder."""
        return " ".join([self.texts[i] for i in ids])

    def encode_batch(self, texts: list[str]):
        """For each text, the parts (n, ids joined by spaces, decoded) of its chunks in order; parts of a chunk are made once."""
        cache = self.cache
        split = [self.coder.chunks(t) for t in texts]
        new = cache.missing({c for s in split for c in s})
        for c, raw in zip(new, self.coder.ids_of_chunks(new), strict=True):
            cache.young[c] = self._part(np.frombuffer(raw, "<u4").tolist())
        for s in split:
            yield list(filter(None, map(cache.young.__getitem__, s)))
        cache.turn()

    def _part(self, ids: list[int]) -> tuple:
        return () if not ids else (len(ids), " ".join([self.numbers[i] for i in ids]), self.decode(ids))


@lru_cache(maxsize=2)
def _codec(path: str, key: str, held) -> Codec:
    return Codec(path, held.value)


def encoded(docs: DataFrame, path: str, text: str = "text", block: bytes | None = None, keep: tuple[str, ...] = ("doc_id",), digests: bool = True) -> DataFrame:
    """The kept columns, n_tokens, and ids and decoded text of every text: as SHA-256 digests, or as array<int> and string."""
    block = lexicon_block(docs, path, text) if block is None else block
    held = docs.sparkSession.sparkContext.broadcast(block)
    key = hashlib.sha256(block).hexdigest()

    def encode(batches):
        codec = _codec(path, key, held)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for at in range(0, len(texts), 512):
                part = [t or "" for t in texts[at : at + 512]]
                n, ids, out = [], [], []
                for parts in codec.encode_batch(part):
                    sizes, a, b = zip(*parts, strict=True) if parts else ((), (), ())
                    n.append(sum(sizes))
                    a, b = " ".join(a), " ".join(b)
                    if digests:
                        a, b = hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(b.encode()).hexdigest()
                    else:
                        a = [int(i) for i in a.split()]
                    ids.append(a)
                    out.append(b)
                kept = [batch.column(i).slice(at, len(part)) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(out, pa.string())], names)

    fields = [docs.schema[c] for c in keep]
    more = [T.StructField("n_tokens", T.LongType()), *([T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])]
    schema = T.StructType([*fields, *more])
    names = schema.names
    return docs.select(*keep, F.col(text)).mapInArrow(encode, schema)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
