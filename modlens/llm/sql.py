"""DuckDB statements of the registered queries, for the comparison with Spark."""

from __future__ import annotations

from modlens.llm import quality

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits(pattern: str) -> str:
    return f"length(regexp_extract_all(t, {_quote(pattern)}))"


def _js(counts: str, ref: str, n: int) -> str:
    def part(p: str, q: str) -> str:
        return f"case when {p} > 0 then {p} * log2({p} / (({p} + {q}) / 2)) else 0 end"

    terms = []
    for i in range(1, n + 1):
        p, q = f"({counts}[{i}]::double / list_sum({counts}))", f"({ref}[{i}]::double / list_sum({ref}))"
        terms.append(f"({part(p, q)} + {part(q, p)}) / 2")
    return f"sqrt(greatest({' + '.join(terms)}, 0))"


def quality_sql(
    max_char: float = 0.28, max_word: float = 0.32, min_chars: int = 200, min_words: int = 80, spread: float = 5.0, noise: float = 2.2, enough: int = 30,
) -> str:
    lists = " ".join(f"when {_quote(k)} then [{', '.join(map(_quote, v))}]" for k, v in quality.COMMON.items())
    n_classes, n_common = len(quality.CLASSES), len(quality.COMMON["en"])
    return rf"""
    with a as (select doc_id, lang, source, coalesce(text, '') as t, {WORDS} as w from documents),
    b as (select *, len(w) as n_words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
        case lang {lists} end as common, list_transform(w, lambda x: translate(x, {AZ})) as lw,
        [{', '.join(map(_hits, quality.CLASSES))}] as others from a),
    wins as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as win from b, unnest(range(1, n_words - 3)) as r(i)),
    again as (select doc_id, i from wins qualify count(*) over (partition by doc_id, win) > 1),
    cover as (select doc_id, count(distinct j) as n from again, unnest(range(i, i + 5)) as r(j) group by doc_id),
    c as (select b.doc_id, lang, source, n_words, length(array_to_string(w, '')) as word_chars, length(t) as n_chars,
        {_hits(quality.SYMBOLS)} as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(cover.n, 0) as n_repeat_words,
        list_concat([length(t) - list_sum(others)], others) as chars,
        list_concat(list_transform(common, lambda x: len(list_filter(lw, lambda y: y = x))), [len(list_filter(lw, lambda y: not list_contains(common, y)))]) as hist,
        common is not null as listed
        from b left join cover using (doc_id)),
    d as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c),
    fit as (select lang, source, list_concat(list_transform(chars, lambda x: x / n_chars), list_transform(hist, lambda x: x / n_words)) as shares
        from d where listed and not base_failed and n_words >= {min_words}),
    bins as (select lang, source, bin, avg(shares[bin]) as share, round(100 * sqrt(count(*)))::bigint as votes
        from fit, unnest(range(1, {n_classes + n_common + 3})) as r(bin) group by lang, source, bin),
    upto as (select *, sum(votes) over (partition by lang, bin order by share, source rows unbounded preceding) as n_upto,
        sum(votes) over (partition by lang, bin) as n_all from bins),
    middle as (select lang, bin, min(share) as share from upto where 2 * n_upto >= n_all group by lang, bin),
    refs as (select lang, (list(share order by bin))[1:{n_classes + 1}] as all_chars, (list(share order by bin))[{n_classes + 2}:] as all_hist from middle group by lang),
    e0 as (select d.*, all_chars, all_hist, n_words >= {min_words} and n_chars >= {min_chars} and all_hist is not null as judged
        from d left join refs using (lang)),
    e as (select *, length(bin(n_words)) - 1 as size, case when judged then {_js('chars', 'all_chars', n_classes + 1)} end as char_d,
        case when judged then {_js('hist', 'all_hist', n_common + 1)} end as word_d from e0),
    seen as (select lang, size, source, floor(1000 * word_d)::int as step, count(*) as n from e where word_d is not null group by all),
    votes as (select lang, size, step, n, round(1000 * n / sqrt(sum(n) over (partition by lang, size, source)))::bigint as v from seen),
    steps as (select lang, size, step, sum(v) as v, sum(n) as n from votes group by all),
    centre as (select lang, size, min(step) as mid from (select *, sum(v) over (partition by lang, size order by step) as u, sum(v) over (partition by lang, size) as t from steps)
        where 2 * u >= t group by all),
    offs as (select lang, size, abs(step - mid) as off, sum(v) as v from steps join centre using (lang, size) group by all),
    mads as (select lang, size, min(off) as mad from (select *, sum(v) over (partition by lang, size order by off) as u, sum(v) over (partition by lang, size) as t from offs)
        where 2 * u >= t group by all),
    limits as (select lang, size, case when sum(n) < {enough} then {max_word}::double else least({max_word}::double,
        greatest((any_value(mid) + 0.5::double + {spread}::double * any_value(mad)) / 1000, {noise}::double / sqrt(pow(2.0::double, size)))) end as lim
        from steps join centre using (lang, size) join mads using (lang, size) group by lang, size)
    select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
        n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
        not base_failed and not (coalesce(char_d > {max_char}, false) or coalesce(word_d > lim, false)) as kept
    from e left join limits using (lang, size)"""


WARC = """
    with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
    h as (select *, case when n >= 1000 then max(page_id) over (partition by html) end as holder from p)
    select page_id, n::bigint as payload_bytes, sha1(html) as payload_digest,
        case when page_id < holder then 'revisit' else 'response' end as record_type,
        case when page_id < holder then holder end as refers_to
    from h"""

REPEATS = rf"""
    with a as (select doc_id, {WORDS} as w from documents),
    wins as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as win from a, unnest(range(1, len(w) - 48)) as r(i)),
    least as (select win, min(doc_id) as first_doc from wins group by win),
    covered as (select distinct doc_id, j from wins join least using (win), unnest(range(i, i + 50)) as r(j) where doc_id > first_doc),
    gone as (select doc_id, list(j) as js from covered group by doc_id),
    k as (select a.doc_id, len(w) as n, case when js is null then w else list_filter(w, lambda x, i: not list_contains(js, i)) end as kept
        from a left join gone using (doc_id))
    select doc_id, n::bigint as n_words, (n - len(kept))::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256
    from k"""

NEAR = rf"""
    with recursive a as (select doc_id, list_transform({WORDS}, lambda x: translate(x, {AZ})) as w from documents),
    s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as sh from a),
    e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
    links as (select x.doc_id as a, y.doc_id as b from e x join e y on x.g = y.g and x.doc_id <> y.doc_id
        group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
    reach as (select doc_id as a, doc_id as b from s union select reach.a, links.b from reach join links on reach.b = links.a)
    select doc_id, len(sh)::bigint as n_shingles, min(b) as component_id, doc_id = min(b) as kept
    from s join reach on reach.a = doc_id group by doc_id, sh"""

# CRC-32 by its table, which follows from the polynomial; a list of bytes runs through it
_CRC_TABLE = """list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"""


def _crc32(bytes_: str) -> str:
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::bigint], {bytes_}),
        lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"""


def _latin_bytes(s: str) -> str:
    """UTF-8 bytes of a text whose characters are below U+0100."""
    return f"""flatten(list_transform(string_split({s}, ''), lambda x:
        case when x = '' then [] when unicode(x) < 128 then [unicode(x)::bigint]
        else [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]::bigint[] end))"""


SPELLING = rf"""
    with recursive t as (select {_CRC_TABLE}::bigint[] as crc_table),
    runs as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as raw from documents),
    each as (select coalesce(doc_id::varchar, '') as id, translate(raw, {AZ}) as w, count(*) as n from runs
        where length(raw) >= 7 group by all),
    hashed as (select w, n, {_crc32(_latin_bytes("id || ':' || w"))} as h from each, t),
    put as (select case when h % 31 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n from hashed),
    v as materialized (select word, sum(n)::bigint as n from put where length(word) >= 7 group by word having sum(n) >= 2),
    gaps as (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b from v, unnest(range(1, length(word) + 1)) as r(i)),
    pairs as (select x.word, y.word as other, y.n as other_n from gaps x join gaps y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
        union select g.word, v.word, v.n from gaps g join v on g.a || g.b = v.word
        union select v.word, g.word, g.n from gaps g join v on g.a || g.b = v.word),
    near as (select word, count(*) as n_near, min({{'m': -other_n, 'w': other}}) as best from pairs group by word),
    f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when -best.m >= 10 * v.n then best.w end as form,
        case when -best.m >= 10 * v.n then -best.m end as form_n from v left join near using (word)),
    way as (select word, word as at from f union select way.word, f.form from way join f on way.at = f.word where f.form is not null),
    ends as (select way.word, way.at as root from way join f on way.at = f.word where f.form is null)
    select f.word, form, root, n::bigint as n, n_near::bigint as n_near, form_n::bigint as form_n from f join ends using (word)"""

PERIODIC = rf"""
    with t as (select {_CRC_TABLE}::bigint[] as crc_table),
    a as (select doc_id, {WORDS} as w, {_crc32(_latin_bytes("doc_id::varchar"))} as h from documents, t),
    b as (select *, len(w) as n, h // 10 as g from a),
    c as (select *, case when h % 10 = 0 and n > 0 then g % n end as s from b),
    d as (select doc_id, n, case when s is null then w else list_transform(range(n), lambda i:
        case when i < s then w[i + 1] else w[s + (i - s) % (1 + (n - s) // (3 + g % 8)) + 1] end) end as w from c),
    e as (select doc_id, n, i, w[i + 1] as x from d, unnest(range(n)) as r(i)),
    eq as (select p.doc_id, r.i - p.i as q, p.i from e p join e r on p.doc_id = r.doc_id and p.x = r.x and r.i > p.i and 4 * (r.i - p.i) <= p.n),
    isl as (select doc_id, q, min(i) as s, count(*) + q as len from (
        select *, i - row_number() over (partition by doc_id, q order by i) as k from eq) group by doc_id, q, k
        having count(*) + q >= greatest(6, 4 * q)),
    runs as (select x.* from isl x where not exists (select 1 from isl y
        where y.doc_id = x.doc_id and y.q < x.q and y.s <= x.s and y.s + y.len >= x.s + x.len)),
    gone as (select doc_id, list(distinct j) as js from runs, unnest(range(s + q, s + len)) as r(j) group by doc_id),
    told as (select doc_id, count(*) as n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as lines,
        arg_min({{'s': s, 'len': len, 'q': q}}, {{'e': -(len::double / q), 's': s, 'q': q}}) as best from runs group by doc_id)
    select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.len::bigint as length, best.q::bigint as period,
        (1000 * best.len // best.q)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
        sha256(array_to_string(case when js is null then w else list_filter(w, lambda x, i: not list_contains(js, i - 1)) end, ' ')) as collapsed_sha256
    from d left join gone using (doc_id) left join told using (doc_id)"""
