"""The queries of this package: one for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.rans import read_digests, write_ids

    return read_digests(write_ids(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontam import digests, matches

    return digests(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import digests, score, train

    docs = table(spark, sf_dir, "documents")
    return digests(score(docs, train(docs, table(spark, sf_dir, "labels")), passages=False))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.secret_scan import digests

    return digests(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.chat import recovered

    return recovered(table(spark, sf_dir, "conversations"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.html_blocks import main_text

    return main_text(table(spark, sf_dir, "pages")).drop("blocks")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.media import features, media_table

    return features(media_table(table(spark, sf_dir, "documents"))).drop("peaks")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.warc import read_archive, write_archive

    return read_archive(write_archive(table(spark, sf_dir, "pages"))).drop("url")


QUERIES = {f.__name__: f for f in (op1_rans, op2_decontamination, op3_toxicity, op4_secrets, op5_chat, op6_html, op7_near_duplicates, op8_packing, op9_media, op10_warc)}
_PAGES = "select page_id, encode(coalesce(html, '')) as payload from pages"
_BITS = "list_aggregate(list_transform(string_split(d, ''), lambda c: lpad(format('{:b}', instr('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '')"
_BASE32 = "list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + list_sum(list_transform(range(0, 5), lambda k: cast(substr(bits, i * 5 + k + 1, 1) as integer) * (16 >> k))) as bigint), 1)), 'string_agg', '')"
_WORD_RULE = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _matches(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Places of the matches of a pattern: what stands between them, and they, in turn."""
    return f"""
        select r, {rank} as rank, '{kind}' as kind, before as start, before + length(m) as stop from (
            select *, sum(length(gap)) over w + coalesce(sum(length(m)) over (partition by r order by i rows between unbounded preceding and 1 preceding), 0) as before from (
                select r, unnest(range(1, len(ms) + 1)) as i, unnest(gaps[1:len(ms)]) as gap, unnest(ms) as m, unnest(parts) as part from (
                    select r, string_split_regex(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}', 0) as ms, regexp_extract_all(t, '{pattern}', {group}) as parts
                    from docs where regexp_matches(t, '{pattern}')))
            window w as (partition by r order by i rows between unbounded preceding and current row)) where length(part) >= {least}"""


_ASSIGN = """(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KNOWN = "(?i)[A-Z0-9+]*(?:example|placeholder|changeme|dummy|abcdefgh|01234567|12345678)[A-Z0-9+]*"
ORACLE_SQL: dict[str, str] = {
    "op4_secrets": f"""
        with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
        base as ({_matches("assign", 0, _ASSIGN, 2, 12)} union all {_matches("access", 1, "AKIA[A-Z0-9]+", 0, 18)} union all {_matches("hex", 2, "[0-9a-f]+", 0, 16)}),
        known as ({_matches("known", 3, _KNOWN, 0, 1)}),
        letters as (select r, unnest(range(0, length(t))) as at_char, unnest(regexp_extract_all(t, '(?s).')) as c from docs where regexp_matches(t, '[A-Za-z0-9+/_=-]{{20,}}')),
        cut as (select distinct r, unnest(range(cast(start as bigint), cast(stop as bigint))) as at_char from (select * from base union all select * from known)),
        kept as (select *, at_char - row_number() over (partition by r order by at_char) as run from letters anti join cut using (r, at_char) where regexp_matches(c, '[A-Za-z0-9+/_=-]')),
        runs as (select r, min(at_char) as start, string_agg(c, '' order by at_char) as v from kept group by r, run having count(*) >= 20),
        fit as (select *, case when regexp_full_match(v, '[0-9a-fA-F]+') then 2.9 when regexp_full_match(v, '[A-Za-z0-9]+') then 3.6 else 3.75 end as least from runs
                where regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') and not regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9-]+')
                and not regexp_full_match(v, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}')),
        windows as (select r, start, i, least, substr(v, i + 1, 20) as w from (select *, unnest(range(0, length(v) - 19)) as i from fit)),
        scored as (select *, list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: -(20 - length(replace(w, c, ''))) / 20.0 * log2((20 - length(replace(w, c, ''))) / 20.0))) as bits,
                   case when regexp_matches(w, '[+/_=-]') then 3.75 when regexp_matches(w, '[G-Zg-z]') then 3.6 else 2.9 end as own, regexp_matches(w, '[0-9]') and regexp_matches(w, '[A-Za-z]') as mixed from windows),
        entropy as (select r, 3 as rank, 'entropy' as kind, start + min(i) as start, start + max(i) + 20 as stop from scored where bits >= case when mixed then least(least, own) else least end group by r, start),
        told as (select r, rank, start, kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint) as span from (select * from base union all select * from entropy)),
        sums as (select r, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
                 string_agg(span, ',' order by start, rank) filter (rank < 3) as b, string_agg(span, ',' order by start, rank) as spans from told group by r)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans
        from docs left join sums using (r)""",
    "op2_decontamination": f"""
        with docs as (select row_number() over () as r, doc_id, regexp_extract_all({_SMALL}, '{_WORD_RULE}') as w from documents),
        items as (select cast(item_id as varchar) as item_id, regexp_extract_all({_SMALL}, '{_WORD_RULE}') as w from benchmark),
        sized as (select distinct item_id, w, least(len(w), 10) as k from items where len(w) > 0),
        windows as (select distinct item_id, k, list_slice(w, i, i + k - 1) as run from (select *, unnest(generate_series(1, len(w) - k + 1)) as i from sized)),
        places as (select r, k, i, list_slice(w, i, i + k - 1) as run from (select *, unnest(generate_series(1, len(w) - k + 1)) as i from docs, (select distinct k from sized) where len(w) >= k)),
        met as (select p.r, p.i, p.k, x.item_id from places p join windows x using (k, run)),
        hits as (select r, count(distinct place) as n_hit from (select r, unnest(generate_series(i, i + k - 1)) as place from met) group by r),
        named as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from met where item_id is not null) group by r)
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from docs left join hits using (r) left join named using (r)""",
    "op7_near_duplicates": f"""
        with recursive docs as (select doc_id, regexp_extract_all({_SMALL}, '[^\\x20\\x09-\\x0D]+') as w from documents),
        sets as (select doc_id, list_sort(list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) else w end)) as s from docs),
        reps as (select s, min(doc_id) as rep from sets where len(s) > 0 group by s),
        parts as (select rep, len(s) as n, unnest(s) as part from reps),
        pairs as (select x.rep as u, y.rep as v from parts x join parts y on x.part = y.part and x.rep < y.rep
                  group by x.rep, y.rep, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        links as (select u, v from pairs union all select v, u from pairs),
        reach as (select rep as u, rep as v from reps union select r.u, l.v from reach r join links l on r.v = l.u),
        joined as (select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(c.component, s.doc_id) as component_id
                   from sets s left join reps p on s.s = p.s left join (select u, min(v) as component from reach group by u) c on c.u = p.rep)
        select doc_id, n_shingles, component_id, doc_id = component_id as kept from joined""",
    "op10_warc": f"""
        with rows as (select page_id, octet_length(payload) as n, sha1(payload) as d from ({_PAGES})),
        told as (select *, max(page_id) over (partition by d) as w, {_BITS} as bits from rows)
        select page_id, cast(n as bigint) as payload_bytes, {_BASE32} as payload_digest,
               case when page_id = w then 'response' else 'revisit' end as record_type, case when page_id = w then null else w end as refers_to
        from told""",
}
