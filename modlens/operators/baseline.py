"""A multi-label baseline: logistic regressions of all labels on TF-IDF of exact words, fitted together.

Words are joined as words, so no two share a weight.  Rows are scaled to length one; the
loss with its ridge term is minimised by accelerated gradient steps of the size that the
length allows, until a step changes no loss by more than the tolerance.  A step sends the weights of
all labels to the blocks of texts once and adds up all their gradients in one aggregate; the
driver sees one loss and one intercept gradient per label.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens import constants as C
from modlens.functions.numbers import sigmoid
from modlens.operators.bags import bag_blocks, block_words, blocks_in, doubles, with_vectors
from modlens.session import cut_lineage

_OUT = "kind int, block string, word string, v array<double>, state binary"
_ENTRIES = 1 << 16


class Baseline(NamedTuple):
    words: DataFrame                 # word, idf, w: one weight per label
    intercepts: list[float]
    losses: list[float]              # mean loss of all labels before each step

    def score(self, df: DataFrame, text: str = "comment_text") -> DataFrame:
        """``df`` with ``logit`` and ``score`` arrays; words that the fit did not see say nothing."""
        rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
        bags = rows.select("_row", F.explode(tokens_of(F.col(text))).alias("word")).groupBy("_row", "word").agg(F.count("*").alias("n"))
        k = len(self.intercepts)
        x = F.col("n") * F.col("idf")
        sums = bags.join(self.words, "word").groupBy("_row").agg(
            F.sqrt(F.sum(x * x)).alias("_size"), *[F.sum(x * F.col("w")[i]).alias(f"_m{i}") for i in range(k)])
        logit = F.array(*[
            F.lit(b) + F.when(F.col("_size") > 0, F.col(f"_m{i}") / F.col("_size")).otherwise(0.0) for i, b in enumerate(self.intercepts)])
        out = rows.join(sums, "_row", "left").withColumn("logit", logit)
        return out.select(*df.columns, "logit", F.transform("logit", sigmoid).alias("score"))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"{C.ALPHA}+"), F.lit(0)), F.array().cast("array<string>"))


def _step(joined: DataFrame, k: int, intercepts: np.ndarray | None) -> DataFrame:
    """Gradient of every word and of the intercepts, and the losses; without intercepts the length of each row,
    which is kept as the last column of the block's state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_in(batches, k):
            n = len(b.sizes)
            if intercepts is None:
                x = b.counts * b.vectors[b.codes, 0]
                size = np.sqrt(np.bincount(b.of, x * x, n))
                state = np.column_stack([b.state, size]).astype("<f8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0], pa.int32()), pa.array([b.name]), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.float64())), pa.array([state], pa.binary())],
                    names=[c.split()[0] for c in _OUT.split(", ")])
                continue
            y, size = b.state[:, :k], b.state[:, k]
            scale = np.divide(1.0, size, out=np.zeros(n), where=size > 0)
            margin = np.zeros((n, k))
            for a in range(0, len(b.codes), _ENTRIES):
                part = slice(a, a + _ENTRIES)
                x = b.vectors[b.codes[part]] * b.counts[part, None]
                for j in range(k):
                    margin[:, j] += np.bincount(b.of[part], x[:, j], n)
            margin = margin * scale[:, None] + intercepts
            off = 1.0 / (1.0 + np.exp(-margin)) - y
            loss = (np.logaddexp(0.0, margin) - y * margin).sum(axis=0)
            grad = np.zeros(b.vectors.shape)
            for a in range(0, len(b.codes), _ENTRIES):
                part = slice(a, a + _ENTRIES)
                x = (off * scale[:, None])[b.of[part]] * b.counts[part, None]
                for j in range(k):
                    grad[:, j] += np.bincount(b.codes[part], x[:, j], len(grad))
            m = len(b.words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * m + [2, 3], pa.int32()), pa.nulls(m + 2, pa.string()), pa.concat_arrays([b.words, pa.nulls(2, pa.string())]),
                 doubles(np.vstack([grad, off.sum(axis=0), loss])), pa.nulls(m + 2, pa.binary())],
                names=[c.split()[0] for c in _OUT.split(", ")])

    return joined.mapInArrow(run, _OUT)


def fit_baseline(
    df: DataFrame, text: str = "comment_text", labels: Sequence[str] = C.LABELS, ridge: float = 1e-3, tolerance: float = 3e-3,
    max_steps: int = 20, block_texts: int = 16_384,
) -> Baseline:
    """Fit on the rows of ``df``, copies included; a null label counts as 0."""
    k = len(labels)
    given = F.array(*[F.coalesce(F.col(l).cast("double"), F.lit(0.0)) for l in labels])
    texts = df.select(F.lit(None).cast("string").alias("key"), tokens_of(F.col(text)).alias("tokens"), given.alias("given"))
    blocks = bag_blocks(texts, k, lambda y, _: y, block_texts)
    n = blocks.agg(F.sum(F.size("keys"))).first()[0] or 0
    if not n:
        raise ValueError("no rows to fit")
    pairs = cut_lineage(block_words(blocks), "pairs")
    idf = F.log((F.lit(float(n)) + 1) / (F.sum("holders") + 1))
    zero = F.array(*[F.lit(0.0)] * k)
    words = cut_lineage(pairs.groupBy("word").agg(idf.alias("idf")).select("word", "idf", zero.alias("w"), zero.alias("z")), "words")
    fixed = blocks.drop("keys", "totals", "holders")
    sized = _step(with_vectors(fixed, pairs, words.withColumn("v", F.array("idf", *[F.lit(0.0)] * (k - 1))), "v"), k, None)
    fixed = fixed.drop("state").join(cut_lineage(sized.select("block", "state"), "lengths", batch=1), "block")
    b, at, losses, momentum = np.zeros(k), np.zeros(k), [], 1.0
    rate = 1.0 / (0.5 + ridge)                                    # rows of length one and the intercept: curvature of at most 1/2
    for _ in range(max_steps):
        sent = with_vectors(fixed, pairs, words.withColumn("v", F.transform("z", lambda x: x * F.col("idf"))), "v")
        done = cut_lineage(_step(sent, k, at), "step", batch=1)         # a row is a whole block
        sums = {r["kind"]: np.array(r["v"]) for r in done.where("kind > 1").groupBy("kind").agg(
            F.array(*[F.sum(F.col("v")[i]) for i in range(k)]).alias("v")).collect()}         # two rows
        slope, loss = sums.get(2, np.zeros(k)), sums.get(3, np.zeros(k))
        norm = words.agg(*[F.sum(F.col("z")[i] * F.col("z")[i]) for i in range(k)]).first()
        losses.append(float((loss / n + ridge / 2 * np.array([x or 0.0 for x in norm])).mean()))
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        push = (momentum - 1) / following
        grads = done.where("kind = 1").groupBy("word").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(k)]).alias("g"))
        new = lambda i: F.col("z")[i] - rate * (F.col("g")[i] * F.col("idf") / float(n) + ridge * F.col("z")[i])
        moved = words.join(grads, "word").select("word", "idf", "w", F.array(*[new(i) for i in range(k)]).alias("n"))
        words = cut_lineage(moved.select("word", "idf", F.col("n").alias("w"), F.array(*[F.col("n")[i] + float(push) * (F.col("n")[i] - F.col("w")[i]) for i in range(k)]).alias("z")), "words")
        new_b = at - rate * slope / n
        at, b, momentum = new_b + push * (new_b - b), new_b, following
        if len(losses) > 1 and abs(losses[-2] - losses[-1]) <= tolerance * losses[-1]:
            break
    return Baseline(words.select("word", "idf", "w"), [float(x) for x in b], losses)
