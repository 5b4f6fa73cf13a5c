"""Quality of documents by hierarchical empirical Bayes (operator 8).

Document level: two logistic regressions (low quality, toxic) on hashed words and a few shape
features, fitted on the labelled documents, at most ``TRAIN_ROWS`` of them (the bound of the
sample; those with the smallest hash of their id). Host and path level: over all documents, the
mean predicted risk of a host is shrunk toward that of the corpus, and a path's toward its host's,
by the weight of their evidence; how strongly follows from how much hosts (paths) really differ.
The final odds are the document's odds moved by what its path's posterior, of all other documents,
adds to the corpus's.

Every document is scored. The groups' evidence is one grouped aggregation (partial sums before the
shuffle, so a host with a third of all rows is a few rows), joined back by Spark's own choice.

Defined results: a null or empty text has neutral features; a null host or path is a group of its
own; without labels of both classes a risk is the share of its class; repeated rows each get their
row; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seriesforge.llm.common import small_batches, written
from seriesforge.llm.words import PIECE, word_hashes

TRAIN_ROWS = 8_000
BUCKETS = 1 << 18
LEAST_DOCS, LEAST_Z = 8, 5.0
#: Steps of a text's shape: signs, capitals and digits a byte, distinct words, bars and exclamation marks a word.
STEPS = ((0.05, 0.1, 0.15, 0.2, 0.3), (0.1, 0.2, 0.4, 0.6), (0.05, 0.1, 0.2, 0.4), (0.1, 0.2, 0.3, 0.5, 0.7), (0.1, 0.3, 0.6), (0.1, 0.3, 0.6, 1.2))
#: Bytes that part words: ASCII without letters and digits.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Printable signs among them.
SIGNS = np.flatnonzero(BETWEEN & (np.arange(256) > 32) & (np.arange(256) < 127))
RISKS = ("low", "toxic")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the buckets of its distinct words (text after text), how many, its shape."""
    buckets, counts, shapes = [], [], []
    texts = texts.fill_null("").cast(pa.large_string())
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :]
    for i, bounds, h, _, _ in word_hashes(texts, lower=True, space=BETWEEN):
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            own = np.unique((h[a:b] >> np.uint64(16)) % np.uint64(BUCKETS)).astype(np.int32)
            buckets.append(own)
            counts.append(len(own))
            kinds = np.zeros(256, np.int64)
            for c in range(at[i + k], at[i + k + 1], PIECE):
                kinds += np.bincount(data[c : min(c + PIECE, at[i + k + 1])], minlength=256)
            n, words = max(int(kinds.sum()), 1), max(b - a, 1)
            shapes.append([kinds[SIGNS].sum() / n, kinds[65:91].sum() / n, kinds[48:58].sum() / n, len(own) / words, kinds[ord("|")] / words, kinds[ord("!")] / words])
    return np.concatenate(buckets) if buckets else np.zeros(0, np.int32), np.array(counts, np.int64), stepped(np.array(shapes).reshape(-1, len(STEPS)))


def stepped(shapes: np.ndarray) -> np.ndarray:
    """One column for each step that a value passes, and a constant."""
    passed = [(shapes[:, k] > at).astype(float) for k, steps in enumerate(STEPS) for at in steps]
    return np.stack([*passed, np.ones(len(shapes))], 1)


def evidence(buckets: np.ndarray, counts: np.ndarray, shapes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of each text under ``weights`` (words, then shape)."""
    sums = np.zeros(len(buckets) + 1)
    np.cumsum(weights[buckets], out=sums[1:])
    ends = np.cumsum(counts)
    return (sums[ends] - sums[ends - counts]) + shapes @ weights[BUCKETS:]


def telling(buckets: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which buckets of words occur in at least ``LEAST_DOCS`` texts and differ between the classes
    by ``LEAST_Z`` standard deviations; all others would only be learnt by heart."""
    owner = np.repeat(np.arange(len(counts)), counts)
    n, k, p = np.bincount(buckets, minlength=BUCKETS), np.bincount(buckets, wanted[owner], BUCKETS), wanted.mean()
    return (n >= LEAST_DOCS) & (np.abs(k - n * p) >= LEAST_Z * np.sqrt(np.maximum(n, 1) * p * (1 - p)))


def logistic(buckets, counts, shapes, wanted, steps: int = 300, ridge: float = 2e-5) -> np.ndarray:
    """Ridge logistic regression by full-batch gradient steps with adaptive sizes, on the words
    that tell the classes apart and the shape."""
    owner, use = np.repeat(np.arange(len(counts)), counts), telling(buckets, counts, wanted)[buckets]
    buckets, owner = buckets[use], owner[use]
    counts = np.bincount(owner, minlength=len(counts))
    weights, m, v = (np.zeros(BUCKETS + shapes.shape[1]) for _ in range(3))
    for step in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(evidence(buckets, counts, shapes, weights), -30, 30))) - wanted) / len(wanted)
        slope = np.concatenate([np.bincount(buckets, error[owner], BUCKETS), shapes.T @ error]) + ridge * weights
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        weights -= 0.2 / (1 + step / 60) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return weights


def fitted(docs: DataFrame, labels: DataFrame, id: str, text: str) -> dict:
    """For each risk its weights, or the share of its class where the labels have but one. The sample, which is
    bounded, is fitted in a task: the driver gets the weights that aren't zero."""
    wanted = labels.where(F.col(id).isNotNull()).groupBy(id).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    wanted = wanted.orderBy(F.xxhash64(id), id).limit(TRAIN_ROWS)
    wanted = wanted.select(id, (F.coalesce("quality", F.lit(1)) == 0).cast("int").alias("low"), (F.coalesce("toxic", F.lit(0)) == 1).cast("int").alias("toxic"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts, shapes = features(batch.column(0))
            ends = np.cumsum(counts)
            words = [buckets[e - n : e].tobytes() for e, n in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(shapes.tolist(), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["words", "shape", *RISKS])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes, classes = [], [], []
        for batch in batches:
            words += [np.frombuffer(w, np.int32) for w in batch.column(0).to_pylist()]
            shapes += batch.column(1).to_pylist()
            classes.append(np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], 1).astype(float))
        if not shapes:
            return
        sample = np.concatenate(words), np.array([len(w) for w in words]), np.array(shapes)
        for risk, is_so in zip(RISKS, np.concatenate(classes).T):
            share = float(is_so.mean())
            weights = logistic(*sample, is_so) if 0 < share < 1 else np.zeros(0)
            at = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array([risk]), pa.array([share]), pa.array([len(weights)]), pa.array([at.tobytes()], pa.binary()), pa.array([weights[at].tobytes()], pa.binary())], ["risk", "share", "size", "at", "weights"])

    rows = docs.select(id, text).join(F.broadcast(wanted), id).select(text, *RISKS)
    rows = rows.mapInArrow(read, "words binary, shape array<double>, low int, toxic int").orderBy(F.xxhash64("words"), *RISKS).limit(TRAIN_ROWS).coalesce(1)
    found: dict = dict.fromkeys(RISKS, 0.0)
    for r in rows.mapInArrow(fit, "risk string, share double, size long, at binary, weights binary").collect():
        found[r.risk] = r.share
        if r["size"]:
            found[r.risk] = np.zeros(r["size"])
            found[r.risk][np.frombuffer(r.at, np.int64)] = np.frombuffer(r.weights)
    return found


def risks(docs: DataFrame, models: dict, text: str) -> DataFrame:
    """Adds the document-level probability of each risk, ``__p_<risk>``."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf(T.StructType([T.StructField(f"__p_{r}", T.DoubleType()) for r in RISKS]))
    def scored(texts: pa.Array) -> pa.Array:
        found = features(texts)
        columns = []
        for r in RISKS:
            w = held.value[r]
            columns.append(np.full(len(texts), w) if isinstance(w, float) else 1 / (1 + np.exp(-np.clip(evidence(*found, w), -30, 30))))
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], [f"__p_{r}" for r in RISKS])

    made = docs.withColumn("__risk", scored(F.col(text)))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns], "__risk.*")


def posteriors(scored: DataFrame, host: str, path: str) -> DataFrame:
    """(host, path, and for each risk the corpus mean and the path's posterior mean): beta-binomial
    shrinkage with strengths from the method of moments."""
    sums = [F.sum(f"__p_{r}").alias(f"s_{r}") for r in RISKS]
    paths = written(scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), *sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"s_{r}").alias(f"h_{r}") for r in RISKS])
    total = hosts.agg(F.sum("hn").alias("n"), *[F.sum(f"h_{r}").alias(r) for r in RISKS]).first()
    out = paths.join(hosts.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host"))).drop("__host")

    def strength(rows: DataFrame, n: str, mean: Column, center: Column | float, center_value: Column | float) -> float:
        """How many documents the prior counts for: large where the groups hardly differ."""
        within = center_value * (1 - center_value)
        got = rows.agg(
            F.sum(F.col(n) * F.pow(mean - center, 2)).alias("q"), F.sum(within * 1.0).alias("e"), F.sum(F.col(n) * within).alias("w"), F.count("*").alias("g")
        ).first()
        spread = max((got.q or 0) - (got.e or 0), 0.0)
        return min(max((got.w or 0) / spread, 1.0), 1e6) if spread > 0 else 1e6

    columns = []
    for r in RISKS:
        corpus = F.lit((total[r] or 0.0) / total.n if total.n else 0.0)
        k_host = strength(hosts, "hn", F.col(f"h_{r}") / F.col("hn"), corpus, corpus)
        host_mean = (F.col(f"h_{r}") + k_host * corpus) / (F.col("hn") + k_host)
        k_path = strength(out, "n", F.col(f"s_{r}") / F.col("n"), F.col(f"h_{r}") / F.col("hn"), F.col(f"h_{r}") / F.col("hn"))
        columns += [corpus.alias(f"corpus_{r}"), ((F.col(f"s_{r}") + k_path * host_mean) / (F.col("n") + k_path)).alias(f"path_{r}")]
        columns += [F.col(f"s_{r}"), F.col(f"h_{r}"), F.lit(k_host).alias(f"k_host_{r}"), F.lit(k_path).alias(f"k_path_{r}")]
    return out.select("host", "path", "n", "hn", *columns)


def path_of_others(r: str) -> Column:
    """A document's path's posterior mean without the document itself, whose evidence counts once."""
    g = F.col("__g")
    p, k_host, k_path = F.col(f"__p_{r}"), g[f"k_host_{r}"], g[f"k_path_{r}"]
    host_mean = (g[f"h_{r}"] - p + k_host * g[f"corpus_{r}"]) / (g["hn"] - 1 + k_host)
    return (g[f"s_{r}"] - p + k_path * host_mean) / (g["n"] - 1 + k_path)


def odds(p: Column) -> Column:
    """Log odds, held within about 14 either way."""
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", reject_at: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``risk_low``, ``risk_toxic`` (probabilities after the host and path evidence)
    and ``kept``: neither reaches ``reject_at``. ``carry`` names the columns of the result (all, if
    not given): texts are read once, and what is carried is written with their scores."""
    small_batches(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    needed = [c for c in docs.columns if c in {*carry, host, path}]
    scored = risks(docs, fitted(docs, labels, id, text), text)
    scored = written(scored.select(*[F.col(f"`{c}`") for c in needed], *[f"__p_{r}" for r in RISKS]), "scored")
    groups = posteriors(scored.select(host, path, *[f"__p_{r}" for r in RISKS]), host, path)
    groups = groups.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.struct(*groups.columns[2:]).alias("__g"))
    both = scored.join(written(groups, "groups"), F.col(host).eqNullSafe(F.col("__host")) & F.col(path).eqNullSafe(F.col("__path")), "left")
    for r in RISKS:
        raw = odds(F.col(f"__p_{r}")) + odds(path_of_others(r)) - odds(F.col(f"__g.corpus_{r}"))
        both = both.withColumn(f"__risk_{r}", 1 / (1 + F.exp(-raw)))
    kept = (F.col("__risk_low") < reject_at) & (F.col("__risk_toxic") < reject_at)
    results = ("risk_low", "risk_toxic", "kept")
    return both.select(*[F.col(f"`{c}`") for c in carry if c not in results], F.col("__risk_low").alias("risk_low"), F.col("__risk_toxic").alias("risk_toxic"), F.coalesce(kept, F.lit(True)).alias("kept"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` scored and judged."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, carry=["doc_id", "source", "lang"]).select("doc_id", "source", "lang", "risk_low", "risk_toxic", "kept")
