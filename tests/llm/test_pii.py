import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from modlens.llm import pii
from modlens.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    digits = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    """The contract's rules by its own patterns."""
    out = [(m.start(), pii.KINDS.index(k), m.end(), k) for k, p in PLAIN.items() for m in re.finditer(p, text) if valid(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def tokens(text):
    parts = "|".join(f"(?P<{k}>{PLAIN[k]})" for k in ("email", "phone", "ip", "card")) + r"|(?P<term>[^\W\d_]{4,})"
    return [(m.lastgroup if m.lastgroup else next(k for k, v in m.groupdict().items() if v), m) for m in re.finditer(parts, text)]


def added(texts, least=2, general=0.6, remove=0.85):
    """Method spans of all texts by plain counting."""
    both, n_entity, n_term, held = {}, {}, {}, []
    for t in texts:
        ts = [(next(k for k, v in m.groupdict().items() if v), m) for _, m in tokens(t)]
        ents = [(i, f"{k}:{m[0].lower()}") for i, (k, m) in enumerate(ts) if k != "term" and valid(k, m[0])]
        near = {(e, w) for e in {e for _, e in ents} for w in {m[0].lower() for k, m in ts if k == "term"}}
        held.append((ts, near))
        for p in near:
            both[p] = both.get(p, 0) + 1
        for e in {e for _, e in ents}:
            n_entity[e] = n_entity.get(e, 0) + 1
        for w in {m.lower() for m in re.findall(r"[^\W\d_]{4,}", t)}:
            n_term[w] = n_term.get(w, 0) + 1
    out = []
    for ts, near in held:
        act = {}
        for e, w in near:
            info = -math.log2(n_entity[e] / len(texts))
            if both[e, w] >= least and info > 0:
                share = (math.log2(min(1, both[e, w] / n_term[w])) + info) / info
                if share >= general:
                    act[w] = max(act.get(w, "general"), "remove" if share >= remove else "general")
        out.append([f"{act[m[0].lower()]}:{m.start()}:{m.end()}" for k, m in ts if k == "term" and m[0].lower() in act])
    return out


def merged(a, b):
    return ",".join(sorted(a + b, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0]))))


HARD = [
    "a@b.c_d@e.f x@y", ".foo@x.com été.bar@x-1.co.uk, a@b..c a@.b.c", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111", "+1 (988) 555-2485. +12 345 +1-2 ++49 30 1234567-", "4" * 5000, "a@" + "b." * 4000 + "c",
    "x" * 50_000 + "@", "1." * 5000, "+" * 1000 + "1" + " " * 5000, "", None, "é😀 me@mail.example.com 😀 10.0.0.1", "@@@ a@b.c@d.e", "%_@a.b",
]


def test_base_rules_match_the_plain_patterns(spark):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab1239@@..-+ ()_é") for _ in range(120)) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.sanitise(d).collect():
        want = base(texts[r.doc_id] or "")
        assert r.base_spans == ",".join(want), texts[r.doc_id][:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in pii.BASE]
        assert set(want) <= set(r.spans.split(",")) | {""}


def made():
    rng = random.Random(5)
    words = ["people", "house", "water", "school", "market"]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [filler(30) for _ in range(60)]
    texts += [f"{filler(15)} write to Quillon the beekeeper at jo@mail.org or 10.1.2.3 {filler(15)}" for _ in range(4)]
    texts += [f"{filler(12)} beekeeper {filler(12)}" for _ in range(2)] + [f"{filler(9)} kim@mail.org once {filler(9)} Quillon"]
    return texts + ["", "no one"]


def test_terms_match_brute_force(spark):
    texts = made()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("k1", F.lit("clash")).withColumn("term", F.lit(1))
    got = {r.doc_id: r for r in pii.sanitise(d).collect()}
    for i, extra in enumerate(added(texts)):
        assert got[i].spans == merged(base(texts[i]), extra)
    r = got[61]
    kinds = {s.split(":")[0] for s in r.spans.split(",")}
    assert {"email", "ip", "remove"} <= kinds and "Quillon" not in r.sanitised and "jo@mail.org" not in r.sanitised and "[E]" in r.sanitised
    assert "house" in "".join(g.sanitised for g in got.values()) and got[0].sanitised == texts[0]


def test_repeated_null_and_empty(spark):
    t = made()[61]
    rows = [(1, t), (1, t), (None, t), (2, None)] + [(10 + i, x) for i, x in enumerate(made()[:20])]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and len({r.spans for r in got if r.n_email}) == 1
    assert pii.sanitise(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r.text or "" for r in rows]
    got = {r.doc_id: r for r in QUERIES["op3_information_sanitisation"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r, extra in zip(rows, added(texts)):
        want = base(r.text or "")
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[r.doc_id].spans == merged(want, extra)


def test_term_far_from_its_entity(spark):
    """A disclosing word at the other end of the document goes, in documents that name the entity alone."""
    far = "people house water school market " * 40
    texts = [f"zorblat {far} jo@mail.org"] * 3 + [f"{far} {i}" for i in range(40)] + [f"zorblat {far} nobody named"]
    got = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.spans == merged(base(texts[r.doc_id]), e) for r, e in ((r, added(texts)[r.doc_id]) for r in got))
    assert all(("zorblat" in r.sanitised) == (r.doc_id >= 3) for r in got if r.doc_id < 3 or r.doc_id == 43)


def test_shares_at_the_limits(spark):
    """64 documents, an entity of four: a share of one half and of exactly the limit, as counts give them."""
    texts = [f"a@b.c {'halfway ' if i < 4 else ''}" for i in range(4)] + ["halfway word"] * 12 + ["word"] * 48
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for at, kind in ((0.5, "general"), (0.5000001, None)):
        got = {r.doc_id: r.spans for r in pii.sanitise(d, generalise_at=at, remove_at=0.9).collect()}
        assert ("general" in got[0]) == (kind == "general") and "remove" not in got[0]
    assert "remove" in {r.doc_id: r.spans for r in pii.sanitise(d, generalise_at=0.4, remove_at=0.5).collect()}[0]
