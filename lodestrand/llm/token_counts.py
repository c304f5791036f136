"""Token counts of whole texts: each distinct pre-token is encoded once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import as_bytes, cut, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
#: Distinct pre-tokens a task counts before it hands them on.
HELD = 300_000
#: Text read before the distinct words so far are sent on: they hold no more bytes than it.
HELD_BYTES = 1 << 26
#: Pre-tokens whose counts every task gets: the most frequent, at most this many (some 20 MB).
FREQUENT = 1 << 18
#: A longer pre-token is never broadcast, so that the table is bounded by bytes: at most FREQUENT times so many.
WORD_BYTES = 64


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pre_tokens(text: bytes) -> list[bytes]:
    """Blank-separated words, in lower case as the tokenizer has them.

    The tokenizer normalises, lowers, drops blanks and never merges across one, so the tokens of a
    text are those of its words. Only its special strings are told apart before lower case.
    """
    return (text if b"<|" in text else text.lower()).split()


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        seen.clear()
        return out

    size = 0
    for batch in batches:
        for text in batch.column(0):
            if b := text.as_py():
                seen.update(pre_tokens(b))
                size += len(b)
                if len(seen) >= HELD or size >= HELD_BYTES:
                    yield flush()
                    size = 0
    if seen:
        yield flush()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            sizes = [len(e) for i in range(0, len(words), 1000) for e in t.encode_batch_fast(words[i : i + 1000], add_special_tokens=False)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int32())], ["word", "n", "size"])

    return run


def _frequencies(frequent):
    """Per document: tokens of its frequent pre-tokens, and the frequencies of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = frequent.value.get
        for batch in batches:
            ids, keys, sums, rest = [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                b = text.as_py() or b""
                total, rare = 0, []
                for word, n in Counter(pre_tokens(b)).items():
                    size = sizes(word)
                    if size is None:
                        rare.append((word, n))
                    else:
                        total += n * size
                ids.append(doc_id.as_py()), keys.append(xxhash.xxh3_128_digest(b)), sums.append((len(b), total)), rest.append(rare)
            words = pa.array(rest, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])))
            yield pa.record_batch(
                [pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.binary()), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64()), words],
                ["doc_id", "tkey", "n_bytes", "n_tokens", "rare"],
            )

    return run


def token_counts(docs: DataFrame, tokenizer: str | None = None, context: int = 2048, frequent: int = FREQUENT, word_bytes: int = WORD_BYTES) -> DataFrame:
    """Tokens of every whole text: ``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input row.

    Pre-tokens are counted over the corpus (in bounded counters, summed by Spark), and each
    distinct one is encoded once; token ids are never kept. Per-document pre-token frequencies
    then meet these sizes in a join: the ``frequent`` most frequent pre-tokens, of a bounded
    number and of at most ``word_bytes`` bytes each, as a broadcast table; all the others in a shuffle
    join. Sums go back to the rows.

    ``tokenizer`` is the path of a tokenizer file that drops blanks and never merges across one
    (default: the public word BPE of 49k). Nothing is added, truncated or padded; special strings
    in a text are single tokens, as is the library's default.

    Defined cases: null counts as empty (0 bytes, 0 tokens); a null doc_id stays null; equal rows
    get a row each; an empty table gives no rows; other columns are ignored. ``over_limit``:
    more than ``context`` tokens.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", as_bytes().alias("text"))
    counted = rows.select("text").mapInArrow(_vocabulary, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sizes = cut(counted.mapInArrow(_encode(path), "word binary, n long, size int"), "sizes")
    # eighths of powers of two: a few hundred classes of counts, whatever the corpus
    step = F.floor(8 * F.log2(F.col("n"))).cast("int")
    steps = sorted(((r["step"], r["words"]) for r in sizes.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, held = 1 << 30, 0
    for at, words in steps:
        if held + words > frequent:
            break
        least, held = at, held + words
    told = (step >= least) & (F.octet_length("word") <= word_bytes)
    top = sizes.where(told).select("word", "size").toArrow()  # at most ``frequent`` rows of ``word_bytes`` bytes
    table = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    counts = cut(
        rows.mapInArrow(
            _frequencies(table), f"doc_id {kind}, tkey binary, n_bytes long, n_tokens long, rare array<struct<word:binary,n:int>>"
        ),
        "frequencies",
    )
    # equal texts need their rare words counted once
    rare = (
        counts.where("size(rare) > 0").select("tkey", "rare").dropDuplicates(["tkey"])
        .select("tkey", F.explode("rare").alias("r")).select("tkey", "r.word", "r.n")
        .join(sizes.where(~told).select("word", "size"), "word")
        .groupBy("tkey").agg(F.sum(F.col("n") * F.col("size")).alias("more"))
    )
    total = F.col("n_tokens") + F.coalesce("more", F.lit(0).cast("long"))
    return counts.drop("rare").join(rare, "tkey", "left").select(
        "doc_id", "n_bytes", total.alias("n_tokens"), (total > context).alias("over_limit")
    )
