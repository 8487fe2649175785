"""Personal data, and information-theoretic sanitisation of what gives it away.

Base rules find e-mail addresses, IP addresses, card and phone numbers.  Each distinct value
is a protected entity.  Terms in the same document can reveal it even when the value itself is
gone.  Following C-sanitisation (Sanchez, Batet, JASIST 67(1), 2016), with probabilities
estimated from document counts over the whole corpus, a term t discloses of entity c the share

    PMI(c; t) / IC(c) = log(p(c | t) / p(c)) / -log p(c)

of its information, 1 if t occurs with c only.  In documents that name c, terms that disclose
``remove_at`` or more are removed, those from ``generalise_at`` are generalised to a placeholder,
wherever in the document they stand.  Pairs in fewer than ``min_documents`` documents say nothing
and are left alone: a term that is unique would disclose any entity that is.

DataFrame operations only.  Positions come from the pieces between matches, so a text is
never searched twice for a match.  Patterns are the contract's, written with possessive
repeats and anchored starts, so that long runs neither backtrack nor recurse.

Plan: documents with entities are few, those with an entity of several documents fewer.  Only
their terms are looked up among the counts of all terms of all documents, and only terms rare
enough to disclose anything meet the entities.  Counts are aggregates with map-side combine;
joins are plain joins on written tables, so AQE can split a frequent key.  The text itself is
shuffled only for documents with an entity.

Edge cases: a null or empty text has no spans; a null id is kept; repeated rows are treated
each for itself (and count each for itself); an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.functions.text import bind
from modlens.llm.base import LOWER, UPPER, id_text, written

KINDS = ("email", "ip", "card", "phone", "general", "remove")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: cheap tests without which a pattern cannot match validly
_MAY = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
TERM = r"\p{L}{4,}+"
_TOKEN = "|".join([*(PATTERNS[k] for k in ("email", "phone", "ip", "card")), TERM])
_MASKS = {"email": "[E]", "ip": "[I]", "card": "[C]", "phone": "[P]"}


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def is_valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.length(digits).between(12, 19) & F.coalesce(F.when(F.length(digits).between(12, 19), _luhn(digits)), F.lit(False))


def _matches(text: Column, pattern: str) -> Column:
    """Matches and the pieces around them, one more."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("s"))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")


def _spans(found: Column, wanted) -> Column:
    """Spans of the matches for which ``wanted`` gives a kind, by one walk along the text."""
    zipped = F.zip_with(found["s"], found["m"], lambda s, m: F.struct(F.length(s).alias("gap"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])

        def add(kind: Column) -> Column:
            rank = (F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1).cast("int")
            span = F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), kind.alias("kind"))
            return F.when(kind.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span)))

        return F.struct(end.alias("at"), bind(wanted(x["m"]), add).alias("out"))

    walked = F.aggregate(
        F.filter(zipped, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), _no_spans().alias("out")), step)
    return walked["out"]


def base_spans(text: Column, kind: str) -> Column:
    def of(m: Column) -> Column:
        return F.when(is_valid(kind, m), F.lit(kind))

    return F.when(_MAY[kind](text), bind(_matches(text, PATTERNS[kind]), lambda f: _spans(f, of))).otherwise(_no_spans())


def _entity(token: Column) -> Column:
    """The protected value of a token, null for a term and for a value that fails its rule."""
    kind = (F.when(token.contains("@"), F.lit("email")).when(token.startswith("+"), F.lit("phone"))
            .when(token.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.lit("ip")).when(token.rlike("^[0-9]"), F.lit("card")))
    out = F.lit(None).cast("string")
    for k in BASE:
        out = F.when((kind == k) & is_valid(k, token), F.concat(F.lit(k + ":"), F.translate(token, UPPER, LOWER))).otherwise(out)
    return out


def _may_hold(text: Column) -> Column:
    out = F.lit(False)
    for test in _MAY.values():
        out = out | test(text)
    return out


def _is_term(token: Column) -> Column:
    return token.rlike(rf"^{TERM}$")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def entities_of(texts: DataFrame) -> DataFrame:
    """k1, k2, entity, rows: each entity a document names, once, and how many rows repeat the document."""
    named = lambda t: F.array_distinct(F.filter(F.transform(t, lambda x: F.when(~_is_term(x), _entity(x))), lambda e: e.isNotNull()))
    each = texts.where(_may_hold(F.col("text"))).select("k1", "k2", F.explode(bind(_tokens(F.col("text")), named)).alias("entity"))
    return each.groupBy("k1", "k2", "entity").agg(F.count("*").alias("rows"))


def terms_of(texts: DataFrame) -> DataFrame:
    """k1, k2, term: each term of a document, once."""
    terms = F.array_distinct(F.transform(F.filter(_tokens(F.col("text")), _is_term), lambda t: F.lower(t)))
    return texts.select("k1", "k2", F.explode(terms).alias("term")).distinct()


def disclosures(texts: DataFrame, min_documents: int, generalise_at: float, remove_at: float) -> DataFrame:
    """k1, k2, term, kind: what becomes of which term in which document.

    A term too frequent to disclose ``generalise_at`` of an entity, even if it were in all its
    documents, is left out before terms meet entities."""
    n = max(texts.count(), 1)
    held = written(entities_of(texts), "entities")
    shared = held.groupBy("entity").agg(F.sum("rows").alias("n_entity")).where((F.col("n_entity") >= min_documents) & (F.col("n_entity") < n))
    live = written(held.join(shared, "entity"), "shared")
    docs = live.select("k1", "k2").distinct()
    own = written(terms_of(texts.where(_may_hold(F.col("text"))).join(docs, ["k1", "k2"], "left_semi")), "terms")
    counts = texts.select(F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))).alias("term")).groupBy("term").agg(
            F.count("*").alias("n_term"))
    wanted = own.select("term").distinct()
    counted = written(own.join(counts.join(wanted, "term", "left_semi"), "term"), "counted")
    most = F.col("n_entity") * F.pow(F.lit(float(n)) / F.col("n_entity"), F.lit(1.0 - generalise_at)) * (1 + 1e-9)
    pairs = live.join(counted, ["k1", "k2"]).where(F.col("n_term") <= most)
    together = pairs.groupBy("entity", "term").agg(
        F.sum("rows").alias("both"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term")).where(F.col("both") >= min_documents)
    information = -F.log2(F.col("n_entity") / F.lit(float(n)))
    given = F.log2(F.least(F.col("both") / F.col("n_term"), F.lit(1.0)))
    share = (given + information) / information
    kind = F.when(share >= remove_at, F.lit("remove")).when(share >= generalise_at, F.lit("general"))
    told = written(together.select("entity", "term", kind.alias("kind")).where("kind is not null"), "disclosures")
    of_docs = live.select("k1", "k2", "entity").join(told, "entity")
    return of_docs.join(own, ["k1", "k2", "term"], "left_semi").select("k1", "k2", "term", "kind")


def sanitise(
    docs: DataFrame, min_documents: int = 2, generalise_at: float = 0.6, remove_at: float = 0.85,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, number of spans of each base kind, base spans and all spans as text, and the sanitised text."""
    texts = id_text(docs, id_col, text_col).withColumns({
        "k1": F.xxhash64("doc_id", "text"), "k2": F.hash("text", "doc_id")})
    told = disclosures(texts, min_documents, generalise_at, remove_at)
    per = told.groupBy("k1", "k2").agg(
        F.collect_set(F.when(F.col("kind") == "remove", F.col("term"))).alias("remove"),
        F.collect_set(F.when(F.col("kind") == "general", F.col("term"))).alias("general"))
    some = texts.where(_may_hold(F.col("text"))).join(per, ["k1", "k2"]).dropDuplicates(["k1", "k2"])

    def of_term(m: Column) -> Column:
        low = F.lower(m)
        return F.when(F.array_contains("remove", low), F.lit("remove")).when(F.array_contains("general", low), F.lit("general"))

    added = some.select("k1", "k2", "remove", "general", bind(_matches(F.col("text"), _TOKEN), lambda f: _spans(f, of_term)).alias("added"))
    kinds = {k: base_spans(F.col("text"), k) for k in BASE}
    based = texts.select("doc_id", "text", "k1", "k2", *[s.alias(k) for k, s in kinds.items()])
    joined = based.join(added, ["k1", "k2"], "left")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.concat(*BASE)
    clean = F.col("text")
    for k in BASE:
        clean = _masked(clean, k)
    return joined.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], listed(base).alias("base_spans"),
        listed(F.concat(base, F.coalesce("added", _no_spans()))).alias("spans"), _replaced(clean).alias("sanitised"))


def _masked(text: Column, kind: str) -> Column:
    """The text with every valid match of a kind replaced by its mask."""

    def of(f: Column) -> Column:
        return F.array_join(F.flatten(F.zip_with(f["s"], f["m"], lambda s, m: F.array(
            s, F.when(m.isNull(), F.lit("")).when(is_valid(kind, m), F.lit(_MASKS[kind])).otherwise(m)))), "")

    return bind(text, lambda t: F.when(_MAY[kind](t), bind(_matches(t, PATTERNS[kind]), of)).otherwise(t))


def _replaced(text: Column) -> Column:
    """Terms to remove are dropped, terms to generalise become a placeholder."""

    def of(f: Column) -> Column:
        return F.array_join(F.flatten(F.zip_with(f["s"], f["m"], lambda s, m: F.array(
            s, F.when(m.isNull() | F.array_contains("remove", F.lower(m)), F.lit("")).when(
                F.array_contains("general", F.lower(m)), F.lit("[T]")).otherwise(m)))), "")

    return F.when(F.col("remove").isNull(), text).otherwise(bind(_matches(text, TERM), of))
