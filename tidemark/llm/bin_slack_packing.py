"""Best-fit packing (operator 10): minimum bin slack over the histogram of lengths.

A document becomes token ids plus an end id and, if longer than the sequence, is cut into
full-length pieces and a rest.  Pieces of equal length are interchangeable, so the packing
is planned on the histogram of lengths, which has at most ``max_len`` rows at any input
size (the only thing that reaches the driver).  Per bin the longest length left is placed
and a bitset subset-sum dynamic program over the lengths still available finds the fullest
feasible combination for the rest of the bin; the combination is removed as often as the
counts allow.  The plan gives runs of pieces per length; Spark ranks the pieces of each
length and joins them to their run.

Null text counts as empty (only the end id).  Repeated rows are packed once per row; ties in
id and piece are ranked by checksum.  Texts of any length are cut into pieces whole.  Only the
two named columns are read, so others may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import INTERNER_LIMIT, Interner, claim, map_arrow, materialize, raw_texts, slices, table

MAX_LEN = 4096
END_ID = 1
#: Pieces per ranking bucket: bounds one window partition whatever the input size.
BUCKET_ROWS = 50_000

# A run of plain Latin letters and the ASCII punctuation behind it: pieces whose ids can be
# looked up apart, because the vocabulary's pre-tokenizer never joins letters and symbols.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class ChunkEncoder:
    """Token ids (little-endian uint32 bytes) of chunks without ASCII white space.

    The tokenizer drops white space and no token crosses it, so the ids of a text are the
    ids of its chunks in a row; words repeat, so each distinct chunk is encoded once."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.reset()

    def reset(self) -> None:
        self.index, self.ids, self.plain = Interner(), [], {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_plain(self, words: list[str]) -> None:
        for k in range(0, len(words), 4096):
            part = words[k:k + 4096]
            enc = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, owner = np.array(enc.ids, "<u4").tobytes(), np.array(enc.word_ids)
            cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
            for w, a, b in zip(part, cuts[:-1], cuts[1:], strict=True):
                self.plain[w] = ids[4 * a:4 * b]

    def _learn(self) -> None:
        todo, self.index.todo = self.index.todo, []
        parts, new = [], {}
        for chunk in todo:
            text = chunk.decode("utf-8", "replace")
            m = _PLAIN.fullmatch(text)
            part = (text,) if m is None else (m[1].lower(), m[2]) if m[2] else (m[1].lower(),)
            parts.append((m is None, part))
            if m is not None:
                new.update((p, None) for p in part if p not in self.plain)
        self._learn_plain(list(new))
        for whole, part in parts:
            self.ids.append(self._ids(part[0]) if whole else b"".join(self.plain[p] for p in part))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self.index) > INTERNER_LIMIT:
            self.reset()
        look, rows = self.index.__getitem__, []
        for t in texts:
            rows.append(list(map(look, t.split())) if t else [])
        self._learn()
        return [b"".join(map(self.ids.__getitem__, r)) for r in rows]


def pieces(docs: DataFrame, vocabulary: str, max_len: int = MAX_LEN, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    end, step = np.array([end_id], "<u4").tobytes(), 4 * max_len

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = claim(("packing", vocabulary), lambda: ChunkEncoder(vocabulary))
        for batch in batches:
            texts = raw_texts(batch.column(1))
            for a, b in slices(texts):
                row, piece, length, crc = [], [], [], []
                for i, ids in enumerate(encoder.encode(texts[a:b]), a):
                    ids += end
                    for k in range(0, len(ids), step):
                        part = ids[k:k + step]
                        row.append(i)
                        piece.append(k // step)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                number = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number.astype(np.int32)),
                     pa.array(number * max_len), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).transform(map_arrow, cut, schema)


def fullest(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``capacity``.

    Subset-sum by bitsets: bit s of a stage is set if the lengths so far can fill s.
    Lengths go from long to short, copies in doubling packets; the search ends as soon as
    the capacity itself is reached."""
    mask = (1 << (capacity + 1)) - 1
    reach, stages = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, packet = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            take = min(packet, left)
            stages.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, packet = left - take, packet * 2
        if reach >> capacity & 1:
            break
    fill, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(stages):
        if not before >> fill & 1:
            used[length] = used.get(length, 0) + take
            fill -= length * take
    return used


def plan_bins(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, last rank + 1, pieces per bin, first bin, offset).

    The pieces of a length with ranks in a run fill consecutive bins from ``first bin`` on,
    ``pieces per bin`` each, side by side from ``offset``."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    given: dict[int, int] = dict.fromkeys(counts, 0)
    runs, first_bin = [], 0
    for longest in sorted(counts, reverse=True):
        while counts.get(longest, 0):
            counts[longest] -= 1
            used = fullest(max_len - longest, {k: v for k, v in counts.items() if v}) if longest < max_len else {}
            counts[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            times = min(counts[k] // n for k, n in used.items())
            offset = 0
            for length in sorted(used, reverse=True):
                n = used[length]
                runs.append((length, given[length], given[length] + n * times, n, first_bin, offset))
                given[length] += n * times
                counts[length] -= n * times
                offset += n * length
            first_bin += times
        counts.pop(longest, None)
    return runs


def pack(parts: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Add (sequence_id, offset) to a table with a ``length`` column of 1..max_len."""
    spark = parts.sparkSession
    rows = parts.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    salt = [c for c in ("doc_id", "piece", "ids_crc32") if c in parts.columns]  # the checksum spreads a repeated or null id
    tagged = parts.withColumn("pk_bucket", F.pmod(F.xxhash64(*salt), F.lit(buckets)).cast("int"))
    per = tagged.groupBy("length", "pk_bucket").agg(F.count("*").alias("pk_n"))
    # at most max_len rows, whatever the input: the whole plan rests on them
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("pk_n").alias("n")).collect()}
    runs = plan_bins(histogram, max_len)
    plan = spark.createDataFrame(runs, "pk_length bigint, pk_from bigint, pk_to bigint, pk_each bigint, "
                                       "pk_bin bigint, pk_offset bigint")
    before = Window.partitionBy("length").orderBy("pk_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "pk_bucket", F.coalesce(F.sum("pk_n").over(before), F.lit(0)).alias("pk_base"))
    ranked = (tagged.join(base, ["length", "pk_bucket"])
              .withColumn("pk_rank", F.col("pk_base") - 1 + F.row_number().over(
                  Window.partitionBy("length", "pk_bucket").orderBy(*salt))))
    within = F.col("pk_rank") - F.col("pk_from")
    # the runs are a function of the histogram (max_len rows), so the broadcast is bounded
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("pk_length")) & (F.col("pk_rank") >= F.col("pk_from"))
                         & (F.col("pk_rank") < F.col("pk_to")))
    return placed.select(*[placed[c] for c in parts.columns],
                         (F.col("pk_bin") + F.floor(within / F.col("pk_each"))).cast("bigint").alias("sequence_id"),
                         (F.col("pk_offset") + (within % F.col("pk_each")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return pack(materialize(pieces(docs, vocabulary, max_len)), max_len)


def op10_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_bin_slack_packing": op10_bin_slack_packing}
ORACLE: dict[str, str] = {}
