"""Token counts of whole texts, huge texts in overlapping chunks.

A chunk is encoded together with an overlap on both sides. Neighbouring chunks are spliced at the first position at
or after the nominal cut where both have a token border that no piece of the vocabulary can ever cross: the two
characters around it are adjacent in no piece, so no merge joins them, whatever stands elsewhere. Such a border is
the same in the encoding of the whole text. Where an overlap holds none, the text is read again with wider
overlaps, in the end as one chunk.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null id, repeated ids and repeated rows give one
result row for each input row; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import id_text, query, slices, table
from formline.session import stored

MODEL = "piece_bpe_32k.model"
SCHEMA = "rid long, doc_id long, n_bytes long, failed boolean, n_tokens long"


@functools.cache
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def joined_pairs(path: str) -> frozenset[str]:
    """All pairs of characters that are adjacent inside some piece."""
    sp = processor(path)
    pairs = set()
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)):
            piece = sp.id_to_piece(i)
            pairs.update(piece[j:j + 2] for j in range(len(piece) - 1))
    return frozenset(pairs)


def stable_border(text: str, start: int, end: int, pairs: frozenset[str]) -> int:
    """First position in [start, end) that no piece can cross; -1 if there is none."""
    text = text[start - 1:end].replace(" ", "▁")
    return next((start + i - 1 for i in range(1, len(text)) if text[i - 1:i + 1] not in pairs), -1)


def count_between(path: str, text: str, left: int, right: int, overlap: int) -> int | None:
    """Tokens of the whole text that this chunk answers for; None if a splice fails.

    ``left`` and ``right`` are the nominal cuts inside the chunk, 0 and len(text) at the ends of the document.
    """
    pairs = joined_pairs(path)
    a = 0 if left == 0 else stable_border(text, left, min(left + overlap, len(text)), pairs)
    b = len(text) if right == len(text) else stable_border(text, right, min(right + overlap, len(text)), pairs)
    if a < 0 or b < 0:
        return None
    size = len(text.encode())
    a, b = len(text[:a].encode()), len(text[:b].encode())
    begins = [p.begin for p in processor(path).encode(text, return_type="proto").pieces]  # in bytes
    found = set(begins)
    if (a and a not in found) or (b < size and b not in found):
        return None
    return sum(a <= x < b for x in begins)


def token_counts(docs: DataFrame, path: str, chunk: int = 32768, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of ``docs`` (columns doc_id, text)."""
    def one(size: int, margin: int, rows: DataFrame) -> DataFrame:
        return _counted(rows, path, size, margin)

    done = stored(one(chunk, overlap, docs), "token-counts")
    parts = []
    while True:
        again = done.filter("failed").select(F.col("doc_id").alias("_again")).distinct()
        parts.append(done.join(again, F.col("doc_id").eqNullSafe(F.col("_again")), "left_anti"))
        if done.filter("failed").isEmpty():
            break
        chunk, overlap = chunk * 8, overlap * 8
        rest = docs.select("doc_id", "text").join(again, F.col("doc_id").eqNullSafe(F.col("_again")), "left_semi")
        done = stored(one(chunk, overlap, rest), "token-counts")
    return functools.reduce(DataFrame.unionByName, parts).select("doc_id", "n_bytes", "n_tokens")


def _counted(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for batch in slices(batches, 1 << 21, "piece"):
            texts, cuts = batch.column("piece").to_pylist(), zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())
            counts = [None] * len(texts)
            whole = []
            for i, (text, (left, right)) in enumerate(zip(texts, cuts)):
                if left is None:
                    whole.append(i)
                else:
                    counts[i] = count_between(path, text, left, len(text) if right is None else right, overlap)
            for i, ids in zip(whole, sp.encode([texts[i] for i in whole], num_threads=1)):
                counts[i] = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("n_bytes"), pa.array([c is None for c in counts]), pa.array(counts, pa.int64())],
                names=["rid", "doc_id", "n_bytes", "failed", "n_tokens"])

    base = id_text(docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"),
                                F.length("text").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / chunk) - 1, F.lit(0)).cast("int")
    cut = base.select("rid", "doc_id", "n_bytes", "text", "n", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("k"))
    begin = F.greatest(F.col("k") * chunk - overlap, F.lit(0))
    end = F.least((F.col("k") + 1) * chunk + overlap, F.col("n"))
    cut = cut.select("rid", "doc_id", F.when(F.col("k") == 0, F.col("n_bytes")).otherwise(0).alias("n_bytes"),
                     F.when(F.col("last") == 0, F.col("text")).otherwise(F.substring("text", begin + 1, end - begin)).alias("piece"),
                     F.when(F.col("last") > 0, F.col("k") * chunk - begin).alias("left"),
                     F.when(F.col("k") < F.col("last"), (F.col("k") + 1) * chunk - begin).alias("right"))
    counted = cut.mapInArrow(count, SCHEMA)
    return counted.groupBy("rid", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.max("failed").alias("failed"), F.sum("n_tokens").alias("n_tokens"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path(MODEL)))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)
