"""The queries of this subpackage, over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.frames import table


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import digests

    return digests(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.byte_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), added=True)


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.hnsw import nearest

    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding")
    return nearest(vectors, vectors.where("id % 100 = 0"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fingerprints import digests

    return digests(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring_dedup import digests

    return digests(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op11_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_pack": op4_pack,
    "op5_hnsw": op5_hnsw,
    "op6_fingerprints": op6_fingerprints,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_contextual_pii": op11_contextual_pii,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE: dict[str, str] = {
    "op2_suffix_dedup": """
        with d as (select doc_id, encode(coalesce(text, '')) as raw from documents),
        w as (select doc_id, i, md5(hex(raw[i:i + 99])) as h from d, unnest(range(1, octet_length(raw) - 98)) as r(i)),
        later as (select doc_id, i from (select *, row_number() over (partition by h order by doc_id, i) as nth from w) where nth > 1),
        jumps as (select *, coalesce(max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) + 100 < i, true) as fresh from later),
        numbered as (select *, sum(fresh::int) over (partition by doc_id order by i) as run from jumps),
        runs as (select doc_id, run, min(i) as low, max(i) + 100 as high from numbered group by all),
        gaps as (
            select doc_id, high as low, lead(low) over (partition by doc_id order by low) as high from runs
            union all select doc_id, 1, min(low) from runs group by all
        ),
        kept as (select g.doc_id, string_agg(hex(raw[g.low:coalesce(g.high - 1, octet_length(raw))]), '' order by g.low) as h from gaps g join d using (doc_id) where coalesce(g.high - 1, octet_length(raw)) >= g.low group by all),
        sums as (select doc_id, sum(high - low) as n, count(*) as spans from runs group by all)
        select d.doc_id, octet_length(raw) as n_bytes, cast(coalesce(s.n, 0) as bigint) as n_removed, cast(coalesce(s.spans, 0) as bigint) as n_spans,
               sha256(case when s.doc_id is null then raw else unhex(coalesce(k.h, '')) end) as kept_sha256
        from d left join sums s using (doc_id) left join kept k using (doc_id)
    """,
    "op8_substring_dedup": """
        with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
        w as (select doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) as h from d, unnest(range(1, len(words) - 33)) as r(i)),
        again as (select doc_id, i from (select *, count(*) over (partition by h) as n from w) where n > 1),
        gone as (select distinct doc_id, i + o as i from again, unnest(range(35)) as r(o)),
        each as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from d),
        kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by i) as text from each anti join gone using (doc_id, i) group by all)
        select d.doc_id, len(words) as n_words, len(words) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256 from d left join kept k using (doc_id)
    """,
    "op7_warc": """
        with p as (
            select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes, coalesce(url, '') as url,
                   strftime(timestamp '2024-01-01' + to_seconds(page_id % 1000000000), '%Y%m%d%H%M%S') as timestamp
            from pages
        ),
        parts as (
            select page_id, list_reverse(string_split(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1), '.')) as labels,
                   regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*[?]([^#]+)', 1) as query
            from p
        ),
        keys as (
            select page_id, lower(array_to_string(labels, ',') || ')' || if(path = '', '/', path) || if(query = '', '', '?' || query)) as url_key from parts
        ),
        f as (select html, min(page_id) as first from p where payload_bytes >= 100 group by html)
        select page_id, payload_bytes, sha256(p.html) as payload_digest,
               case when f.first <> page_id then 'revisit' else 'response' end as record_type,
               case when f.first <> page_id then f.first end as refers_to, url_key, timestamp,
               row_number() over (partition by url_key order by timestamp, page_id) as capture
        from p join keys using (page_id) left join f on p.html = f.html and p.payload_bytes >= 100
    """,
    "op12_collocations": """
        with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
        w as (select row_number() over () as id, lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as words from p),
        e as (select id, lang, unnest(words) as one, unnest(range(len(words))) as i from w),
        n3 as (select lang, one, lead(one) over v as two, lead(one, 2) over v as three from e window v as (partition by id order by i)),
        g as (
            select lang, 1 as k, one as phrase from n3 union all select lang, 2, one || ' ' || two from n3 where two is not null
            union all select lang, 3, one || ' ' || two || ' ' || three from n3 where three is not null
        ),
        f as (select lang, k, phrase, count(*) as f from g group by all),
        c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as words from f where k > 1 and f >= 10),
        inner_ as (select lang, array_to_string(words[i:i + 1], ' ') as phrase, max(a) as most from c, unnest(range(1, 3)) as r(i) where k = 3 group by all),
        kept as (select c.* from c left join inner_ i on c.k = 2 and i.lang = c.lang and i.phrase = c.phrase where i.most is null or 100 * i.most < 50 * c.a),
        parts as (select lang || chr(10) || phrase as id, f from f where f >= 10),
        cuts as (select lang, phrase, k, a, cut, array_to_string(words[1:cut], ' ') as one, array_to_string(words[cut + 1:], ' ') as two from kept, unnest(range(1, k)) as r(cut)),
        scored as (
            select u.lang, u.phrase, u.a, u.cut, x.f as l, y.f as r, cast(1000000::hugeint * u.a * u.a // (x.f::hugeint * y.f) as bigint) as score
            from cuts u join parts x on x.id = u.lang || chr(10) || u.one join parts y on y.id = u.lang || chr(10) || u.two
        ),
        weakest as (select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as nth from scored) where nth = 1),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from weakest),
        n as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by all)
        select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
    """,
    "op13_filter_audit": """
        with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
        w as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from d),
        b as (
            select doc_id, part, (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::int
                + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as bits from w
        ),
        m as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by all),
        c as (select part, bits, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from b left join m using (doc_id) group by all),
        x as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as v),
        orders as (
            select a.f || b.f || c.f || d.f || e.f as filter_order, [a.v, b.v, c.v, d.v, e.v] as v from x a, x b, x c, x d, x e
            where a.v + b.v + c.v + d.v + e.v = 31 and len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5
        ),
        steps as (select filter_order, cast(step as integer) as step, v[step] as own, cast(coalesce(list_sum(v[1:step - 1]), 0) as integer) as earlier from orders, unnest(range(1, 6)) as s(step))
        select part, filter_order, step,
               cast(coalesce(sum(n) filter (bits & (own | earlier) = 0), 0) as bigint) as kept, cast(coalesce(sum(n) filter (bits & own <> 0 and bits & earlier = 0), 0) as bigint) as removed,
               cast(coalesce(sum(n) filter (bits & own <> 0 and bits & earlier <> 0), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (bits = own), 0) as bigint) as unique_fails,
               cast(coalesce(sum(good) filter (bits & own <> 0 and bits & earlier = 0), 0) as bigint) as good_lost, cast(coalesce(sum(toxic) filter (bits & own <> 0 and bits & earlier = 0), 0) as bigint) as toxic_lost,
               cast(coalesce(sum(n * 120 // greatest(bit_count(bits), 1)) filter (bits & own <> 0), 0) as bigint) as shapley
        from c, steps group by all
    """,
}
