"""Token counts without a pre-token shuffle (operator 3).

Tier 1 is a compact table of the lengths of frequent pre-tokens, broadcast to every worker (at most
``FREQUENT`` entries, each key at most ``KEY_CHARS`` letters: a proven bound of a few MB). Tier 2
is each worker's bounded cache; what neither has is encoded once. The frequent words come from all
texts: every partition sends only the summary of its own words (at most ``PER_PARTITION`` rows).
The table decides speed alone; a count never depends on it. Texts with code points that the
library's Unicode tables treat otherwise than Python's are split by the library's classes.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows each give their row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from seriesforge.llm.bpe import BYTE_PATTERN, Generations, byte_letters, exact_pattern, unlike_bytes

FREQUENT = 1 << 16
PER_PARTITION = 1 << 14
KEY_CHARS = 32


def frequent_words(df: DataFrame, text: str, most: int) -> list[str]:
    """The most frequent white-space words of all texts, each partition counting its own."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                counts.update((t.as_py() or "").split())
                if len(counts) > 500_000:  # words seen once give way; their later sightings count anew
                    counts = Counter({w: n for w, n in counts.items() if n > 1})
                    if len(counts) > 250_000:
                        counts = Counter(dict(counts.most_common(125_000)))
        top = [(w, n) for w, n in counts.most_common(PER_PARTITION) if n > 1 and len(w) < KEY_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    words = df.select(F.col(text)).mapInArrow(summary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in words.orderBy(F.desc("n"), "word").limit(most).collect()]


class TokenCounter:
    """Counts with the broadcast table first, the worker's cache second."""

    def __init__(self, path: str, frequent: dict[str, int], odd: dict[str, str] | None = None, cache_entries: int = 400_000):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        specials = [t.content for t in whole.get_added_tokens_decoder().values()]
        self.model, self.pattern = whole.model, regex.compile(BYTE_PATTERN)
        odd = unlike_bytes(path) if odd is None else odd
        self.odd, self.exact = frozenset(odd), regex.compile(exact_pattern(odd, BYTE_PATTERN), regex.V1)
        self.specials = specials
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")")
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.rare = Generations(self.length, cache_entries)
        rare = self.rare

        class Frequent(dict):
            def __missing__(self, key):
                return rare[key]

        self.frequent = Frequent(frequent)

    def length(self, pre_token: str) -> int:
        return len(self.model.tokenize(pre_token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)))

    def count(self, text: str) -> int:
        pieces = self.special_split.split(text) if any(s in text for s in self.specials) else [text]
        pattern = self.pattern if text.isascii() or self.odd.isdisjoint(text) else self.exact
        n = 0
        for piece in pieces:
            n += 1 if piece in self.specials else sum(map(self.frequent.__getitem__, pattern.findall(piece)))
        self.rare.turn()
        return n


#: The counter that this worker made last, by the run it belongs to.
_ready: dict[str, TokenCounter] = {}


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", n_tokens: str = "n_tokens", frequent: int = FREQUENT) -> DataFrame:
    """Adds the number of tokens of every whole text, special strings counted as their token."""
    spark = df.sparkSession
    odd = unlike_bytes(vocabulary)
    counter = TokenCounter(vocabulary, {}, odd)
    table = {}
    for w in frequent_words(df, text, frequent):
        for p in counter.pattern.findall(" " + w):
            if p not in table:
                table[p] = min(counter.length(p), 255)
    keys, run = list(table), uuid4().hex
    packed = spark.sparkContext.broadcast((b"\n".join(k.encode() for k in keys), bytes(table[k] for k in keys)))

    @F.arrow_udf(T.LongType())
    def counted(texts: pa.Array) -> pa.Array:
        if (c := _ready.get(run)) is None:
            names, lengths = packed.value
            c = TokenCounter(vocabulary, dict(zip(names.decode().split("\n"), lengths)) if lengths else {}, odd)
            _ready.clear()
            _ready[run] = c
        return pa.array([c.count(t.as_py() or "") for t in texts], pa.int64())

    return df.withColumn(n_tokens, counted(F.col(text)))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text of ``documents``, and whether they pass 512 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
