"""Quality rules by distribution divergence, in DataFrame operations only.

Each text becomes two histograms: its characters by class, and the common words of its
language (the rest in one bin).  They are compared with the language's own histograms over
the whole corpus by the Jensen-Shannon distance (square root of the divergence to base 2).
In those every document counts alike, whatever its length: its shares are averaged per
source, and each bin is the median of the sources, weighted by the root of their documents,
so that a source of a third of the rows neither sets a bin nor pulls it along.  Documents
without a source count as one source.
A text that lies too far off in either is rejected.  How far is too far in common words follows
from the corpus, by language and length: short texts scatter more (see ``word_limits``).  Texts under the minimum lengths, and
texts in a language without a word list, are not judged by the method: a short histogram is
mostly noise.

The base rules count words, symbols, repeated lines and words in repeated 5-word windows.

Plan: one pass makes a narrow table of counts (a few hundred bytes per document), which is
written; sums of shares per language and source (one partial row per task and pair) give one
row a source and bin, sorted within language and bin for the medians; these come back by a
broadcast of one row per listed language.  No text is shuffled and no key is hot.

Edge cases: a null or empty text has no words and fails the base rules; a null language is
one without a word list; a null id is kept; repeated rows are judged each for itself; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modlens.functions.text import bind
from modlens.llm.base import LOWER, UPPER, written

SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: one class each; what is left of a text are lower-case letters a-z
CLASSES = (r"[A-Z]", r"[0-9]", r"[\x00-\x20\x7F]", r"[.,;:!?'\x22()-]", r"[#-&*+/<-@\x5B-\x60{-~]", r"[^\x00-\x7F]")
# fixed values: frequent function words
COMMON = {
    "en": "the of and to a in is it that for was on are as with be".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht".split(),
    "fr": "de la le et les des en un du une que est pour qui dans au".split(),
    "es": "de la que el en y los se del las un por con no una su".split(),
}
WINDOW = 5


def _repeat_words(words: Column) -> Column:
    """Words covered by 5-word windows that the text holds at least twice.

    Windows are hashed to 64 bits.  Most texts repeat none, which a distinct count shows;
    the others sort (hash, position), keep the positions whose hash has an equal
    neighbour, and add up the gaps between them, a window's length at most."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            starts = F.array_sort(F.transform(again, lambda x: x["i"]))
            return bind(starts, lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.coalesce(F.least(x - F.get(p, k - 1), F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("long"), lambda a, x: a + x))

        return bind(pairs, of)

    counted = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(counted)


def _counts_of(words: Column, common: list[str]) -> Column:
    """Count of each of ``common`` (A-Z lower-cased), then of all other words."""
    hits = F.filter(F.transform(words, lambda w: F.translate(w, UPPER, LOWER)), lambda w: w.isin(common))
    return bind(hits, lambda h: F.concat(
        F.transform(F.array(*map(F.lit, common)), lambda w: F.size(F.filter(h, lambda x: x == w)).cast("long")),
        F.array((F.size(words) - F.size(h)).cast("long"))))


def _word_counts(words: Column, lang: Column) -> Column:
    """Histogram of the common words of the text's language; null without a list."""
    out = F.lit(None).cast("array<long>")
    for code, common in COMMON.items():
        out = F.when(lang == code, _counts_of(words, common)).otherwise(out)
    return out


def measure(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """The counts of each document, one narrow row per row of ``docs``; a missing source column is null."""
    has_source = source_col.lower() in (c.lower() for c in docs.columns)
    source = F.col(f"`{source_col}`") if has_source else F.lit(None)
    split = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
        source.cast("string").alias("source"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("words", F.array_remove(F.split("text", SPLIT), ""))
    words, text = F.col("words"), F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    classes = [F.regexp_count(text, F.lit(c)).cast("long") for c in CLASSES]
    counted = split.select(
        "doc_id", "lang", "source", F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        F.length(text).cast("long").alias("n_chars"), F.array(*classes).alias("others"),
        _word_counts(words, F.col("lang")).alias("word_counts"),
    )
    lower = F.col("n_chars") - sum((F.col("others")[i] for i in range(len(CLASSES))), F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars",
        failed.alias("base_failed"), F.concat(F.array(lower), "others").alias("char_counts"), "word_counts")


def references(measured: DataFrame, min_words: int) -> DataFrame:
    """Histogram of each listed language over all documents the method may judge: one row a language."""
    fit = measured.where(F.col("lang").isin(*COMMON) & ~F.col("base_failed") & (F.col("n_words") >= min_words))
    bins = {"char_counts": len(CLASSES) + 1, "word_counts": len(next(iter(COMMON.values()))) + 1}
    names = [f"{c}_{i}" for c, n in bins.items() for i in range(n)]
    shares = fit.select("lang", "source", *[
        (F.col(c)[i] / F.col({"char_counts": "n_chars", "word_counts": "n_words"}[c])).alias(f"{c}_{i}") for c, n in bins.items() for i in range(n)])
    per_source = shares.groupBy("lang", "source").agg(F.round(100 * F.sqrt(F.count("*"))).cast("long").alias("votes"), *[F.avg(c).alias(c) for c in names])
    each = per_source.select("lang", "source", "votes", F.posexplode(F.array(*names)).alias("bin", "share"))
    along = W.partitionBy("lang", "bin").orderBy("share", "source")
    counted = each.select(
        "lang", "bin", "share", F.sum("votes").over(along.rowsBetween(W.unboundedPreceding, 0)).alias("upto"),
        F.sum("votes").over(W.partitionBy("lang", "bin")).alias("all"))
    middle = counted.where(2 * F.col("upto") >= F.col("all")).groupBy("lang", "bin").agg(F.min("share").alias("share"))
    listed = middle.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "share"))), lambda x: x["share"]).alias("all"))  # all bins
    n = bins["char_counts"]
    return listed.select("lang", F.slice("all", 1, n).alias("all_char_counts"), F.slice("all", n + 1, bins["word_counts"]).alias("all_word_counts"))


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts or shares, between 0 and 1."""
    def shares(c: Column) -> Column:
        return bind(F.aggregate(c, F.lit(0.0), lambda a, x: a + x),
                    lambda n: F.transform(c, lambda x: x.cast("double") / n))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / ((p + q) / 2))).otherwise(F.lit(0.0))

    terms = F.zip_with(shares(counts), shares(reference), lambda p, q: (part(p, q) + part(q, p)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def word_limits(scored: DataFrame, most: float, spread: float, noise: float, enough: int) -> DataFrame:
    """lang, size class (power of two of the words), limit: how far a text of that size may lie off.

    The middle distance of the class plus ``spread`` times the middle deviation from it, at least
    ``noise`` / sqrt(words) and at most ``most``; a class of fewer than ``enough`` texts has ``most``.
    Distances are counted in steps of a thousandth, and a source weighs by the root of its texts."""
    seen = scored.where(F.col("word_distance").isNotNull()).groupBy("lang", "size", "source", F.floor(1000 * F.col("word_distance")).cast("int").alias("step")).agg(
        F.count("*").alias("n"))
    of_source = seen.groupBy("lang", "size", "source").agg(F.sum("n").alias("texts"))
    weighed = seen.alias("a").join(of_source.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.size") == F.col("b.size")) & F.col("a.source").eqNullSafe(F.col("b.source")))
    votes = F.sum(F.round(1000 * F.col("n") / F.sqrt("texts")).cast("long"))
    steps = weighed.groupBy("a.lang", "a.size", "step").agg(votes.alias("votes"), F.sum("n").alias("n"))

    def middle(df: DataFrame, value: str) -> DataFrame:
        """Weighted median of a value, at most a thousand of them a class."""
        per = df.groupBy("lang", "size", value).agg(F.sum("votes").alias("votes"))
        w = W.partitionBy("lang", "size")
        upto = per.select("lang", "size", value, F.sum("votes").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("votes").over(w).alias("all"))
        return upto.where(2 * F.col("upto") >= F.col("all")).groupBy("lang", "size").agg(F.min(value).alias("middle"))

    steps = written(steps, "steps")
    centre = written(middle(steps, "step"), "centre")
    off = middle(steps.join(centre, ["lang", "size"]).withColumn("off", F.abs(F.col("step") - F.col("middle"))), "off").withColumnRenamed("middle", "mad")
    known = steps.groupBy("lang", "size").agg(F.sum("n").alias("texts")).join(centre, ["lang", "size"]).join(off, ["lang", "size"])
    own = F.greatest((F.col("middle") + 0.5 + spread * F.col("mad")) / 1000, noise / F.sqrt(F.pow(F.lit(2.0), F.col("size"))))
    return known.select("lang", "size", F.when(F.col("texts") < enough, F.lit(most)).otherwise(F.least(own, F.lit(most))).alias("word_limit"))


def judge(
    docs: DataFrame, max_char_distance: float = 0.28, max_word_distance: float = 0.32,
    min_chars: int = 200, min_words: int = 80, spread: float = 5.0, noise: float = 2.2, enough: int = 30, **columns: str,
) -> DataFrame:
    """Counts, both distances (null where the guards stop the method), the word limit and ``kept``."""
    measured = written(measure(docs, **columns), "quality")
    # one row per listed language at most: a fixed bound
    joined = measured.join(F.broadcast(references(measured, min_words)), "lang", "left")
    judged = (F.col("n_words") >= min_words) & (F.col("n_chars") >= min_chars) & F.col("all_word_counts").isNotNull()
    scored = written(joined.select(
        *measured.columns, (F.length(F.bin("n_words")) - 1).alias("size"),
        F.when(judged, js_distance(F.col("char_counts"), F.col("all_char_counts"))).alias("char_distance"),
        F.when(judged, js_distance(F.col("word_counts"), F.col("all_word_counts"))).alias("word_distance")), "distances")
    # at most one row per listed language and power of two
    limited = scored.join(F.broadcast(word_limits(scored, max_word_distance, spread, noise, enough)), ["lang", "size"], "left")
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | F.coalesce(F.col("word_distance") > F.col("word_limit"), F.lit(False))
    return limited.select(*measured.columns, "char_distance", "word_distance", "word_limit", (~F.col("base_failed") & ~far).alias("kept"))
