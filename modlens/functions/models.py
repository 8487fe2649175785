"""Plug-in points for models, each with a deterministic default.

A scorer is ``scorer(df, text) -> df`` and adds one double column per label.  The
defaults are plain column expressions.  Real models go through ``batch_scorer``
(Arrow batches, one model load per Python worker) and ``chain_translator``.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from modlens import constants as C
from modlens.functions import text as T
from modlens.functions.numbers import softmax
from modlens.operators.weaklabel import with_candidates
from modlens.session import STAYS, cut_lineage, forget_passing

# --- language -----------------------------------------------------------------------


_LATIN = "[A-Za-zÀ-ÿ]"


def _one_of(words: Sequence[str]) -> str:
    """Pattern of whole words in lower case."""
    return f"(?<![a-zà-ÿ])(?:{'|'.join(words)})(?![a-zà-ÿ])"


def _more_french(block: Column) -> Column:
    """More French than English function words and accents."""
    count = lambda words: F.regexp_count(F.lower(block), F.lit(_one_of(words)))
    accents = F.length(block) - F.length(F.regexp_replace(block, f"[{C.FRENCH_ACCENTS}]", ""))
    return count(C.FRENCH_WORDS) + accents > count(C.ENGLISH_WORDS)


def block_language(block: Column) -> Column:
    """Default detector: script for Indic blocks, function words and accents for Latin.

    Null for a block without letters.
    """
    out = F.when(block.rlike(_LATIN), F.when(_more_french(block), "fr").otherwise("en"))
    for lang, chars in C.SCRIPT_RANGES.items():
        out = F.when(block.rlike(f"[{chars}]"), lang).otherwise(out)
    return out


def block_languages(text: Column, detect: Callable[[Column], Column] = block_language) -> Column:
    """Distinct languages over the 20-character blocks of a text."""
    return F.array_distinct(F.filter(F.transform(T.blocks(text), detect), lambda l: l.isNotNull()))


def _all_english(text: Column) -> Column:
    """``block_languages`` is English alone by the default detector, told from the whole text where that tells it:
    no letter of another script, Latin ones, and blocks only where any holds a French word or accent."""

    def told(t: Column) -> Column:
        marked = F.lower(F.regexp_replace(t, f"(?s).{{{C.WORD_BLOCK}}}", "$0\n"))     # words end where blocks do
        french = f"[{C.FRENCH_ACCENTS}]|{_one_of(C.FRENCH_WORDS)}"
        other = F.when(F.length(t) < F.octet_length(t), t.rlike("[" + "".join(C.SCRIPT_RANGES.values()) + "]")).otherwise(False)
        return t.rlike(_LATIN) & ~other & ~(marked.rlike(french) & F.exists(T.blocks(t), lambda b: b.rlike(_LATIN) & _more_french(b)))

    return T.bind(text, told)


def is_english(text: Column, detect: Callable[[Column], Column] = block_language) -> Column:
    """True where the blocks show exactly one language and it is English."""
    told = _all_english(text) if detect is block_language else block_languages(text, detect) == F.array(F.lit("en"))
    return F.coalesce(told, F.lit(False))


# --- toxicity -----------------------------------------------------------------------


def lexicon_scorer(lexicon: Mapping[str, Sequence[str]] = C.LEXICON):
    """Default scorer: h / (h + 0.5) for h lexicon words of a label in the text."""

    def scorer(df: DataFrame, text: str) -> DataFrame:
        tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"{C.ALPHA}+"), 0)
        counted = df.withColumn("_tok", tokens)
        for label in C.LABELS:
            h = F.size(F.filter("_tok", lambda w: w.isin(list(lexicon[label])))).cast("double")
            counted = counted.withColumn(label, h / (h + 0.5))
        return counted.drop("_tok")

    return scorer


def token_overlap(text: Column, label: Column) -> Column:
    """Default zero-shot score: share of the candidate's distinct words in the text."""
    want = F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit(f"{C.ALPHA}+"), 0))
    have = F.regexp_extract_all(F.lower(text), F.lit(f"{C.ALPHA}+"), 0)
    return F.size(F.array_intersect(want, have)) / F.size(want).cast("double")


def score_candidates(df: DataFrame, text: str, score: Callable[[Column, Column], Column]) -> DataFrame:
    """Score (text, label) pairs with a plug-in column function."""
    return df.withColumn("score", score(F.col(text), F.col("label")))


def zero_shot(df: DataFrame, text: str, candidates: Sequence[tuple[str, str]], score=None) -> DataFrame:
    """Texts with every (topic, sentence) and its score.

    The default score is ``token_overlap``, arranged so that a text is split into words
    once before it meets the sentences, whose words are constants of the plan.
    """
    if score is not None:
        return score_candidates(with_candidates(df, candidates), text, score)
    have = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"{C.ALPHA}+"), 0))

    def item(topic: str, sentence: str) -> Column:
        want = F.array_distinct(F.regexp_extract_all(F.lower(F.lit(sentence)), F.lit(f"{C.ALPHA}+"), 0))
        return F.struct(F.lit(topic).alias("topic"), F.lit(sentence).alias("label"), want.alias("want"))

    pairs = df.withColumn("_have", have).select("*", F.explode(F.array(*[item(t, s) for t, s in candidates])).alias("_c"))
    hits = F.size(F.array_intersect("_c.want", "_have"))
    return pairs.select(*df.columns, "_c.topic", "_c.label", (hits / F.size("_c.want").cast("double")).alias("score"))


def score_map(long: DataFrame, key: str) -> DataFrame:
    """One map label -> score per key (labels per key are a short fixed list)."""
    entries = F.sort_array(F.collect_list(F.struct("label", "score")))
    return long.groupBy(key).agg(F.map_from_entries(entries).alias("scores"))


def aspect_sentiment(text: Column, aspect: Column) -> Column:
    """Default aspect model: softmax over three logits from word counts.

    Negative counts lexicon words, positive counts aspect words, neutral is flat.
    """
    bad = [w for ws in C.LEXICON.values() for w in ws]
    tokens = F.regexp_extract_all(F.lower(text), F.lit(f"{C.ALPHA}+"), 0)
    neg = F.size(F.filter(tokens, lambda w: w.isin(bad))).cast("double")
    pos = token_overlap(text, aspect)
    return softmax(F.array(neg, F.lit(0.5), pos))


# --- batch models -------------------------------------------------------------------


def batch_scorer(make_predict: Callable[[], Callable], batch_size: int = 1024) -> Callable[[Column], Column]:
    """A column function text -> ARRAY<DOUBLE> around a batch model.

    ``make_predict()`` runs once per Python worker and returns
    ``predict(texts: np.ndarray) -> np.ndarray`` of shape (n, labels).
    """
    return predict_batch_udf(make_predict, return_type=ty.ArrayType(ty.DoubleType()), batch_size=batch_size)


def letter_model():
    """A small fixed model for trying the batch path: logits linear in letter shares."""
    def predict(texts: np.ndarray) -> np.ndarray:
        shares = np.zeros((len(texts), 26))
        for i, t in enumerate(texts):
            codes = np.frombuffer(str(t).lower().encode("ascii", "ignore"), dtype=np.uint8)
            codes = codes[(codes >= 97) & (codes <= 122)] - 97
            if len(codes):
                shares[i] = np.bincount(codes, minlength=26) / len(codes)
        weights = np.cos(np.outer(np.arange(1, 27), np.arange(1, len(C.LABELS) + 1)))
        return 1.0 / (1.0 + np.exp(-(shares @ weights * 4.0 - 1.0)))

    return predict


_TEXT_BYTES = 4 << 20


def _runs(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of some megabytes of text, so that a task's memory does not follow the batch size."""
    size = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _TEXT_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def chain_translator(translate: Callable[[list[str], str, str], list[str]]):
    """Back-translation in Arrow batches: ``translate(texts, source, target)`` per hop.

    Rows are grouped by hop inside a run of some megabytes, so a run needs few model calls.
    """

    def run(df: DataFrame, text: str = "comment_text") -> DataFrame:
        schema = ty.StructType([*df.schema.fields, ty.StructField("new_text", ty.StringType())])

        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in itertools.chain.from_iterable(_runs(batch, text) for batch in rows):
                new, paths = part.column(text).to_pylist(), part.column("path").to_pylist()
                for hop in range(max((len(p) for p in paths), default=1) - 1):
                    todo: dict[tuple[str, str], list[int]] = {}
                    for i, p in enumerate(paths):
                        if hop + 1 < len(p):
                            todo.setdefault((p[hop], p[hop + 1]), []).append(i)
                    for (src, dst), at in todo.items():
                        for i, t in zip(at, translate([new[i] for i in at], src, dst)):
                            new[i] = t
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(new, pa.string())], names=schema.names)

        return df.mapInArrow(batches, schema)

    return run


def hop_translator(translate: Callable[[list[str], str, str], list[str]], max_hops: int = len(C.TRANSLATION_NODES) + 1, batch: int = 64):
    """Back-translation hop by hop, each distinct text once per hop and pair of languages.

    A hop is a stage: texts are dealt by language pair and a hash of the text, so a task sees few
    pairs and needs few models, and equal texts stand together and are translated once.  A text
    travels with the paths that wait for it, at most one row for each next language, and its rows
    stay where they are: they are known by the hash of their first text and their path, and
    meet the last text of that path at the end.  Rows whose path has ended are not moved again.
    """

    def translated(pending: DataFrame) -> DataFrame:
        schema = ty.StructType([*pending.schema.fields, ty.StructField("_new", ty.StringType())])

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, known = None, None                              # equal texts follow each other, also from batch to batch
            for whole in rows:
                for at in range(0, whole.num_rows, batch):
                    part = whole.slice(at, batch)
                    keys = list(zip(*(part.column(c).to_pylist() for c in ("_src", "_dst", "_now"))))
                    todo: dict[tuple[str, str], list[tuple]] = {}
                    for key in dict.fromkeys(keys):
                        if key != last:
                            todo.setdefault(key[:2], []).append(key)
                    new = {last: known}
                    for (src, dst), ask in todo.items():                          # a hop without a language leaves the text
                        new |= zip(ask, translate([k[2] for k in ask], src, dst) if src and dst else [None] * len(ask))
                    last, known = keys[-1], new[keys[-1]]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([new[k] for k in keys], pa.string())], names=schema.names)

        dealt = pending.withColumn("_hash", F.xxhash64("_now"))
        dealt = dealt.repartition("_src", "_dst", F.pmod("_hash", F.lit(64))).sortWithinPartitions("_src", "_dst", "_hash", "_now").drop("_hash")
        return dealt.mapInArrow(run, schema)

    def step(now: Column, paths: Column, hop: int) -> Column:
        """One row for each language that the paths go to at a hop, with the paths that go there."""
        to = F.array_distinct(F.transform(F.filter(paths, lambda p: F.size(p) > hop + 1), lambda p: F.get(p, F.lit(hop + 1))))
        return F.inline(F.transform(to, lambda d: F.struct(
            d.alias("_dst"), now.alias("_now"), F.filter(paths, lambda p: (F.size(p) > hop + 1) & F.get(p, F.lit(hop + 1)).eqNullSafe(d)).alias("_paths"))))

    def moved(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows with a path to go and the hash of their text, what came of each text and path, and the other rows."""
        on = (F.size("path") > 1) & F.col(text).isNotNull()
        keyed = df.withColumn("_from", F.when(on, F.sha2(F.col(text).cast("binary"), 256)))
        moving = keyed.where("_from is not null")
        texts = moving.select("_from", F.col(text).alias("_now")).distinct()
        paths = moving.groupBy("_from").agg(F.collect_set("path").alias("_paths"))       # as many as there are paths
        waiting, ended = texts.join(paths, "_from"), []
        for hop in range(max_hops):
            src = F.get(F.get("_paths", F.lit(0)), F.lit(hop)).alias("_src")             # paths that wait together came together
            pending = waiting.select("_from", step(F.col("_now"), F.col("_paths"), hop)).select("_from", src, "_dst", "_now", "_paths")
            at = hop + 2
            over = F.filter("_paths", lambda p: F.size(p) == at if at <= max_hops else F.size(p) >= at)  # noqa: B023  called at once
            done = translated(pending).select("_from", "_paths", F.coalesce("_new", "_now").alias("_now"), (F.size(over) > 0).alias(STAYS))
            done = cut_lineage(done, "hop")
            if hop:
                forget_passing(waiting)                                                  # texts of the hop before that have gone on
            if done.isEmpty():
                break
            ended.append(done.where(STAYS).select("_from", F.explode(over).alias("path"), "_now"))
            waiting = done
        still = df.where(~F.coalesce(on, F.lit(False))).withColumn("new_text", F.col(text))
        last = functools.reduce(DataFrame.unionByName, ended) if ended else moving.select("_from", "path", F.col(text).alias("_now"))
        return moving, last.withColumnRenamed("_now", "new_text"), still

    def run(df: DataFrame, text: str = "comment_text") -> DataFrame:
        moving, last, still = moved(df, text)
        return moving.join(last, ["_from", "path"]).select(*df.columns, "new_text").unionByName(still)

    def first(df: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
        """The first row (by ``order``) of every new text, without ``text``: found by hashes of the new texts, so that
        these are moved once, to the rows that are left."""
        moving, last, still = moved(df, text)
        rest, name = [c for c in df.columns if c != text], F.sha2(F.col("new_text").cast("binary"), 256).alias("_name")
        named = moving.join(last.select("_from", "path", name), ["_from", "path"]).select(*rest, "_name", "_from", F.lit(None).cast("string").alias("_still"))
        named = named.unionByName(still.select(*rest, name, F.lit(None).cast("string").alias("_from"), F.col("new_text").alias("_still")))
        kept = named.groupBy("_name").agg(F.min_by(F.struct(*rest, "_from", "_still"), F.struct(*order)).alias("_r")).select("_r.*")
        kept = cut_lineage(kept, "kept")
        return kept.where("_from is not null").join(last, ["_from", "path"]).select(*rest, "new_text").unionByName(
            kept.where("_from is null").select(*rest, F.col("_still").alias("new_text")))

    run.first = first
    return run
