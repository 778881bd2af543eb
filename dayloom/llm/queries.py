"""The operators of this package as queries over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dayloom.llm import (
    decontaminate, jaccard_join, line_crf, lm_scores, pii, prefix_trie, quality_rules, ranked_search, secret_scan,
    sentencepiece_viterbi, simhash_dedup, token_counts, url_filter,
)
from dayloom.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


@_query("op1_secret_scan")
def op1(spark, sf_dir):
    return secret_scan.secret_spans(documents(spark, sf_dir))


@_query("op2_sentencepiece")
def op2(spark, sf_dir):
    return sentencepiece_viterbi.encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@_query(
    "op3_ngram_jaccard_join",
    rf"""
with recursive listed as (
    select doc_id as id,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
),
placed as (
    select id, array_to_string(w[first:first + 4], ' ') as s
    from (select id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as first from listed where len(w) > 0)
),
shingles as (select distinct id, s from placed),
sizes as (select id, count(*) as n from shingles group by id),
common as (
    select a.id as a, b.id as b, count(*) as n
    from shingles a join shingles b on a.s = b.s and a.id <> b.id group by a.id, b.id
),
links as (
    select c.a, c.b from common c join sizes x on c.a = x.id join sizes y on c.b = y.id
    where c.n / (x.n + y.n - c.n) >= 0.8
),
reach as (select id as a, id as b from listed union select r.a, l.b from reach r join links l on r.b = l.a),
lowest as (select a, min(b) as class_id from reach group by a),
counted as (select a, count(*) as n from links group by a)
select l.id as doc_id, m.class_id, coalesce(c.n, 0) as n_links
from listed l join lowest m on l.id = m.a left join counted c on l.id = c.a
""",
)
def op3(spark, sf_dir):
    return jaccard_join.join(documents(spark, sf_dir))


@_query("op4_token_counts")
def op4(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048)


# The rules of the contract, fixed values.
URL_RULES = [
    url_filter.Rule(True, "org", "/"),
    url_filter.Rule(False, "example.org", "/es/"),
    url_filter.Rule(False, "example.org", "/en/1"),
    url_filter.Rule(True, "com", "/fr/"),
    url_filter.Rule(False, "com", "/de/"),
]


@_query("op5_url_filter")
def op5(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


@_query("op6_lm_scores")
def op6(spark, sf_dir):
    return lm_scores.scored(documents(spark, sf_dir))[0]


# The patterns of the contract and of the further kinds, and which matches count, in SQL.
_LUHN = """length(d) between 12 and 19 and list_sum(list_transform(range(1, length(d) + 1),
    lambda i: substr(reverse(d), i, 1)::int * (2 - i % 2)
        - case when substr(reverse(d), i, 1)::int * (2 - i % 2) > 9 then 9 else 0 end)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(v, 1, 4), ''),
    lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)),
    lambda acc, x: (acc * case when x > 9 then 100 else 10 end + x) % 97) = 1"""
_PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 80, "e-?mail|contact|write to|correo|courriel"),
    (
        "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 and coalesce(try_cast(ltrim(p, '0') as int), 0) <= 255))", 60,
        "(?:^|[^a-z])ip(?:[^a-z]|$)|address|host|server",
    ),
    ("card", r"[0-9]([\x20-]?[0-9])+", _LUHN, 90, "card|visa|mastercard|karte|carte|tarjeta"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 9 and 15", 70, "phone|call|(?:^|[^a-z])tel|mobile|fax|appel|llama"),
    (
        "iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", _MOD97, 90,
        "iban|account|konto|compte|cuenta",
    ),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "true", 30, "(?:^|[^a-z])ssn(?:[^a-z]|$)|social security"),
    ("local_phone", r"\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}", "true", 30, "phone|call|(?:^|[^a-z])tel|mobile|fax"),
)
_SPANS = ",\n".join(
    f"""m{k} as (
    select id, t, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as g
    from texts where regexp_matches(t, '{pattern}')
),
p{k} as (
    select id, t, m[i] as v, regexp_replace(m[i], '[^0-9]', '', 'g') as d,
        list_sum(list_transform(g[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as s
    from (select *, unnest(range(1, len(m) + 1)) as i from m{k})
),
s{k} as (
    select id, s::bigint as s, {k} as kind, '{name}' as name, (s + length(v))::bigint as e,
        least(100, {score} + case when regexp_matches(
            lower(substr(t, greatest(s - 40, 0)::bigint + 1, least(s, 40)::bigint) || ' ' || substr(t, (s + length(v))::bigint + 1, 20)),
            '{context}') then 30 else 0 end) as score
    from p{k} where {check}
)"""
    for k, (name, pattern, check, score, context) in enumerate(_PERSONAL)
)


@_query(
    "op7_personal_data",
    f"""
with texts as (select doc_id as id, coalesce(text, '') as t from documents),
{_SPANS},
base as (select * from s0 union all select * from s1 union all select * from s2 union all select * from s3),
added as (
    select * from (select * from s4 union all select * from s5 union all select * from s6) a
    where score >= 50 and not exists (select 1 from base b where b.id = a.id and b.s <= a.s and a.e <= b.e)
),
spans as (select * from base union all select * from added),
counts as (
    select id, count(*) filter (kind = 0) as n_email, count(*) filter (kind = 1) as n_ip,
        count(*) filter (kind = 2) as n_card, count(*) filter (kind = 3) as n_phone,
        string_agg(name || ':' || s || ':' || e, ',' order by s, kind) filter (kind < 4) as base,
        string_agg(name || ':' || s || ':' || e, ',' order by s, kind) as spans,
        string_agg(score::int::varchar, ',' order by s, kind) as scores
    from spans group by id
)
select t.id as doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card,
    coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
    coalesce(scores, '') as scores
from texts t left join counts c on t.id = c.id
""",
)
def op7(spark, sf_dir):
    return pii.personal_data(documents(spark, sf_dir))


@_query("op8_quality_rules")
def op8(spark, sf_dir):
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_rules.judged(documents(spark, sf_dir), labels)


@_query(
    "op9_decontamination",
    rf"""
with fold as (
    select doc_id as id, 0 as kind, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents
    union all
    select item_id, 1, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') from benchmark
),
listed as (select id, kind, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from fold),
windows as (
    select id as item, least(len(w), 10) as size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as first, w
    from listed where kind = 1 and len(w) > 0
),
wanted as (select distinct item, size, array_to_string(w[first:first + size - 1], ' ') as words from windows),
placed as (
    select id, w, size, unnest(range(1, len(w) - size + 2)) as first
    from listed, (select distinct size from wanted) where kind = 0 and len(w) >= size
),
hits as (
    select id, first, p.size, item
    from placed p join wanted q on p.size = q.size and q.words = array_to_string(w[first:first + p.size - 1], ' ')
),
covered as (select id, count(distinct pos) as n from (select id, unnest(range(first, first + size)) as pos from hits) group by id),
found as (
    select id, count(*) as n, string_agg(item, ',' order by item) as items
    from (select distinct id, item::varchar as item from hits) group by id
)
select l.id as doc_id, len(w) as n_words, coalesce(c.n, 0) as n_hit, coalesce(f.n, 0) as n_items,
    sha256(coalesce(f.items, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from listed l left join covered c on l.id = c.id left join found f on l.id = f.id where kind = 0
""",
)
def op9(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.contamination(documents(spark, sf_dir), items).drop("items")


@_query("op10_quality_classifier")
def op10(spark, sf_dir):
    return line_crf.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "quality"))


# crc32 of the ASCII digits of c, bit by bit; the constant is the reversed polynomial.
_CRC = """xor(list_reduce(list_transform(string_split(c::varchar, ''), lambda d: ascii(d)::ubigint),
    lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda i: 0::ubigint)),
        lambda b, i: xor(b >> 1, (b & 1) * 3988292384::ubigint)), 4294967295::ubigint), 4294967295::ubigint)"""


@_query(
    "op11_prefix_trie",
    rf"""
with turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos
    from conversations where conv_id is not null
),
convs as (select c, c - c % 20 as family, {_CRC} % 4 as h from (select distinct conv_id as c from turns)),
rebuilt as (
    select c, 0 as part, pos, role, text from convs join turns on conv_id = family and pos < h
    union all
    select c, 1, pos, role, text from convs join turns on conv_id = c and pos >= h
),
steps as (
    select c, row_number() over w as depth, md5(length(role) || ':' || role || text) as turn,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
    from rebuilt window w as (partition by c order by part, pos)
),
paths as (
    select c, depth, words, string_agg(turn, '') over (partition by c order by depth) as path from steps
    union all
    select c, 0, 0, '' from convs
),
deepest as (select c, max(depth) as depth from paths group by c),
nodes as (
    select path, p.depth, min(p.c) as low, count(*) as n, any_value(words) as words,
        string_agg(p.c::varchar, ',' order by p.c) filter (p.depth = d.depth) as ends
    from paths p join deepest d on p.c = d.c group by path, p.depth
),
kids as (select left(path, -32) as path, count(*) as n from nodes where depth > 0 group by all),
known as (select n.*, coalesce(k.n, 0) as kids from nodes n left join kids k using (path)),
sums as (
    select left(path, 32 * up) as path, count(*) filter (kids = 0) as leaves, sum((n - 1) * words) as saved
    from (select path, kids, n, words, unnest(range(0, depth + 1)) as up from known) group by all
)
select n.low as conv_id, n.depth::bigint as depth, p.low as parent_conv_id, n.n as n_convs, n.kids as n_children,
    s.leaves as n_leaves, s.saved::bigint as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from known n join sums s on n.path = s.path left join known p on n.depth > 0 and p.path = left(n.path, -32)
""",
)
def op11(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@_query(
    "op12_ranked_search",
    rf"""
with fold as (
    select doc_id as id, 0 as kind, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents
    union all
    select item_id, 1, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') from benchmark
),
words as (select id, kind, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from fold),
counted as (select id, kind, term, count(*) as n from words group by id, kind, term),
lengths as (select id, sum(n)::bigint as n from counted where kind = 0 group by id),
corpus as (select count(*) as documents, sum(n)::bigint as terms from lengths),
weights as (
    select term, floor(1000 * ln((2 * documents + 2) / (2 * holding + 1)))::bigint as w
    from (select term, count(*) as holding from counted where kind = 0 group by term), corpus
),
scores as (
    select q.id as item_id, d.id as doc_id,
        sum(q.n * w * ((1000000000 * d.n) // (1000 * d.n + 8 * (25 + (75 * l.n * documents) // terms))))::bigint as score
    from counted q join weights using (term) join counted d using (term) join lengths l on l.id = d.id, corpus
    where q.kind = 1 and d.kind = 0 group by q.id, d.id
),
ranked as (
    select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scores where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
""",
)
def op12(spark, sf_dir):
    return ranked_search.best(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))


@_query("op13_simhash_dedup")
def op13(spark, sf_dir):
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))
