"""One query per operator, over the whole ``documents`` table, and their check SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from peakloom.llm import (
    bpe, exact_dedup, filter_audit, line_rules, line_spread, near_dedup, packing, periodic_runs, pii, quality, repeats, secret_links, warc,
)
from peakloom.llm.common import NOT_SPACE, documents, let, whole_text, words_of


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade 0 to 2 of the labelled documents: one point for good quality, one for not being toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade")
    )


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(documents(spark, sf_dir), ratings(spark, sf_dir))
    return judged.select("doc_id", "expected_grade", "tail", F.col("accepted").alias("kept"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), token_pattern(), with_ids=False)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), token_pattern()).drop("ids")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["order"] < len(secret_links.BASE))

    def count(number: int, kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["order"] == number)).cast("long").alias(f"n_{kind}")

    counts = [count(n, kind) for n, (kind, *_) in enumerate(secret_links.BASE)]
    return secret_links.scan(documents(spark, sf_dir)).select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge(documents(spark, sf_dir))
    return judged.withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_spread.remove_spread_lines(documents(spark, sf_dir))
    return cleaned.select(
        "doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def with_planted_runs(df: DataFrame) -> DataFrame:
    """Texts of a tenth of the documents, chosen by the checksum of doc_id, turned into one block of words over and over.

    With h the checksum, g = h // 10 and n words: from word a = g % n on, word i becomes word a + (i - a) % p, where
    p = 1 + (n - a) // (3 + g % 8). A row without doc_id keeps its text.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " "))

    text = F.when((F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(NOT_SPACE), let(words_of(whole_text()), planted)).otherwise(F.col("text"))
    return df.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(documents(spark, sf_dir)))
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), greatest.alias("best"), F.array_join(lines, "").alias("lines"))
    return best.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(-F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_packages(archives, with_payload=False).select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


QUERIES = {
    "op1_pii": op1_pii,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_packing": op5_packing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_links": op7_secret_links,
    "op8_line_rules": op8_line_rules,
    "op9_repeats": op9_repeats,
    "op10_line_spread": op10_line_spread,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_warc": op13_warc,
}

WS = r"[\x20\x09-\x0D]"

CHECKS = {
    "op2_near_dedup": rf"""
        with recursive d as (
            select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> '') as w, row_number() over () as rid from documents
        ), n as (
            select *, array_to_string(w, ' ') as body, len(w) as size from d
        ), t as (
            select body, any_value(w) as w, any_value(size) as size, min(rid) as node from n where size > 0 group by body
        ), s as (
            select node, unnest(case when size < 5 then [body]
                else list_transform(range(size - 4), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' ')) end) as shingle from t
        ), c as (
            -- a shingle that occurs k times is k cells
            select node, shingle, row_number() over (partition by node, shingle) as k from s
        ), z as (
            select node, count(*) as size from c group by node
        ), l as (
            select a.node as a, b.node as b from c a join c b on a.shingle = b.shingle and a.k = b.k and a.node < b.node
            join z x on x.node = a.node join z y on y.node = b.node
            where 10 * x.size >= 8 * y.size and 10 * y.size >= 8 * x.size
            group by a.node, b.node, x.size, y.size having 10 * count(*) >= 8 * (x.size + y.size - count(*))
        ), e as (
            select a, b from l union all select b, a from l
        ), r(node, root) as (
            select node, node from t union select e.b, r.root from r join e on e.a = r.node
        ), m as (
            select node, min(root) as comp from r group by node
        ), f as (
            select doc_id, coalesce('c' || comp, 'd' || doc_id) as comp from n left join t on t.body = n.body and n.size > 0 left join m on m.node = t.node
        )
        select doc_id, min(doc_id) over (partition by comp) as class_id, count(*) over (partition by comp) as class_size from f
    """,
    "op8_line_rules": rf"""
        with d as (
            select row_number() over () as rid, doc_id, coalesce(source, '') as host, coalesce(text, '') as t,
                list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> '') as w from documents
        ), b as (
            select *, len(w) as n_words, length(regexp_replace(t, '{WS}', '', 'g')) as word_chars,
                length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols from d
        ), p as (
            select rid, doc_id, host, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as pos from d
        ), q as (
            select *, trim(regexp_replace(line, '{WS}+', ' ', 'g')) as norm,
                len(list_filter(regexp_split_to_array(line, '{WS}+'), lambda w: w <> '')) as words from p
        ), u as (
            select rid, count(*) - count(distinct line) as n_dup_lines from q where words > 0 group by rid
        ), h as (
            select host, greatest(20, count(distinct doc_id) * 0.01) as most from d group by host
        ), k as (
            select q.host, norm from q join h on h.host = q.host where words > 0 group by q.host, norm, most having count(distinct doc_id) > most
        ), g as (
            select q.*, k.norm is not null as gone from q left join k on k.host = q.host and k.norm = q.norm and q.words > 0
        ), a as (
            select rid, coalesce(sum(words) filter (where gone), 0) as removed, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text from g group by rid
        ), x as (
            select rid, unnest(range(len(w) - 7)) as i, w from d where len(w) > 7
        ), y as (
            select rid, i, md5(array_to_string(list_slice(w, i + 1, i + 8), ' ')) as gram from x
        ), v as (
            select rid, i from y qualify count(*) over (partition by rid, gram) > 1
        ), o as (
            select rid, sum(least(8, coalesce(nxt - i, 8))) as n_repeat_words from (select *, lead(i) over (partition by rid order by i) as nxt from v) j group by rid
        ), f as (
            select b.*, coalesce(n_dup_lines, 0) as dup, coalesce(n_repeat_words, 0) as rep, removed, text from b
            left join u using (rid) left join o using (rid) left join a using (rid)
        ), j as (
            select *, n_words < 20 or 100 * rep > 30 * n_words as failed, removed > 0 and n_words - removed < n_words * 0.3 as empty from f
        )
        select doc_id, n_words, word_chars, n_symbols, dup as n_dup_lines, rep::bigint as n_repeat_words, failed as base_failed,
            removed::bigint as n_removed_words, empty as depleted, not failed and not empty as kept, sha256(text) as kept_sha256 from j
    """,
    "op9_repeats": """
        with d as (
            select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
        ), p as (
            select rid, h, unnest(range(n - 199)) as i from d where n >= 200
        ), s as (
            select rid, i, md5(substr(h, 2 * i + 1, 400)) as string from p
        ), r as (
            select rid, i from s qualify count(*) over (partition by string) > 1
        ), o as (
            select *, coalesce(i - lag(i) over (partition by rid order by i) > 200, true) as new from r
        ), k as (
            select *, sum(new::int) over (partition by rid order by i) as span from o
        ), g as (
            select rid, span, min(i) as start, max(i) + 200 as stop from k group by rid, span
        ), c as (
            -- what lies before each span, and what is left after the last one
            select rid, start, substr(h, 2 * coalesce(lag(stop) over (partition by rid order by start), 0) + 1,
                2 * (start - coalesce(lag(stop) over (partition by rid order by start), 0))) as piece from g join d using (rid)
            union all
            select rid, max(stop), substr(any_value(h), 2 * max(stop) + 1) from g join d using (rid) group by rid
        ), t as (
            select rid, string_agg(piece, '' order by start) as kept from c group by rid
        ), x as (
            select rid, sum(stop - start) as n_removed, count(*) as n_spans from g group by rid
        )
        select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
            sha256(unhex(coalesce(kept, h))) as kept_sha256
        from d left join x using (rid) left join t using (rid)
    """,
    "op6_exact_dedup": rf"""
        with d as (
            select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '{WS}', '', 'g') as body from documents
        ), r as (
            select *, row_number() over (partition by body order by length(t) desc, doc_id) as place,
                first_value(doc_id) over (partition by body order by length(t) desc, doc_id) as keep_id,
                count(*) over (partition by body) as group_size
            from d
        )
        select doc_id, keep_id, group_size, place = 1 as kept, sha256(body) as text_sha256 from r
    """,
    "op10_line_spread": rf"""
        with d as (select doc_id, coalesce(source, '') as site, coalesce(text, '') as t from documents),
        p as (select doc_id, site, string_split(t, chr(10)) as parts from d),
        l as (
            select doc_id, site, unnest(parts) as line, unnest(range(1, len(parts) + 1)) as pos from p
        ), n as (
            select *, trim(regexp_replace(line, '{WS}+', ' ', 'g')) as norm from l
        ), s as (
            select norm, min(doc_id) as first_doc from n where norm <> '' group by norm having count(distinct site) >= 10
        ), m as (
            select n.*, s.norm is not null and n.doc_id is distinct from s.first_doc as gone from n left join s using (norm)
        )
        select doc_id, count(*) filter (where norm <> '') as n_lines, count(*) filter (where gone) as n_removed_lines,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
        from m group by doc_id
    """,
    "op11_periodic_runs": rf"""
        with d as (
            select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> '') as w,
                -- the checksum, bit by bit
                xor(4294967295, list_reduce(
                    [4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
                    lambda crc, byte: list_reduce([xor(crc, byte)] || repeat([0::bigint], 8), lambda c, b: xor(c >> 1, 3988292384 * (c & 1)))
                )) as h
            from documents
        ), m as (
            select doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as planted, h // 10 as g, case when len(w) > 0 then (h // 10) % len(w) end as a from d
        ), t as (
            select doc_id, n, case when planted
                then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end])
                else w end as w
            from m
        ), x as (
            select doc_id, n, unnest(range(n)) as pos, unnest(w) as word from t
        ), f as (
            -- a run goes on for five words at least after its first period
            select *, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o as gram
            from x window o as (partition by doc_id order by pos)
        ), p as (
            select b.doc_id, b.pos, b.pos - a.pos as lag from f a join f b on a.doc_id is not distinct from b.doc_id and a.gram = b.gram and a.pos < b.pos
            where 4 * (b.pos - a.pos) <= b.n
        ), i as (
            select *, pos - row_number() over (partition by doc_id, lag order by pos) as island from p
        ), s as (
            select doc_id, min(pos) - lag as start, count(*) + 4 + lag as length, lag from i group by doc_id, lag, island
        ), r as (
            select doc_id, start, length, min(lag) as period from s where length >= greatest(6, 4 * lag) group by doc_id, start, length
        ), c as (
            select x.doc_id, coalesce(string_agg(word, ' ' order by pos), '') as kept from x
            where not exists (select 1 from r where r.doc_id is not distinct from x.doc_id and pos >= start + period and pos < start + length)
            group by x.doc_id
        ), q as (
            select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as text,
                arg_min({{'start': start, 'length': length, 'period': period}}, [-length, start, period]) as best
            from r group by doc_id
        )
        select d.doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period,
            1000 * best.length // best.period as exponent_milli,
            sha256(coalesce(q.text, '')) as runs_sha256, sha256(coalesce(c.kept, '')) as collapsed_sha256
        from d left join q on d.doc_id is not distinct from q.doc_id left join c on d.doc_id is not distinct from c.doc_id
    """,
    "op12_filter_audit": rf"""
        with d as (
            select coalesce(source, '') as part, doc_id, coalesce(text, '') as t,
                list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> '') as words
            from documents
        ), l as (
            select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id
        ), f as (
            select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
                [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
                 coalesce(doc_id > min(doc_id) over (partition by t), false)] as fails
            from d left join l using (doc_id)
        ), s as (
            select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from f group by part, fails
        ), letters as (
            select unnest(range(1, 6)) as x
        ), orders as (
            select [a.x, b.x, c.x, d.x, e.x] as o from letters a, letters b, letters c, letters d, letters e
            where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps as (
            select o, x as step, o[x] as own, list_slice(o, 1, x - 1) as earlier from orders, letters
        ), e as (
            select part, o, step, own, n, good, toxic, fails[own] as here,
                len(list_filter(earlier, lambda i: fails[i])) > 0 as before, len(list_filter(fails, lambda x: x)) as all_fails
            from s, steps
        ), r as (
            select part, o, step, any_value(own) as own,
                sum(case when not before and not here then n else 0 end) as kept,
                sum(case when here and not before then n else 0 end) as removed,
                sum(case when here and before then n else 0 end) as redundant,
                sum(case when here and all_fails = 1 then n else 0 end) as unique_fails,
                sum(case when here and not before then good else 0 end) as good_lost,
                sum(case when here and not before then toxic else 0 end) as toxic_lost
            from e group by part, o, step
        )
        select part, array_to_string(list_transform(o, lambda i: chr(64 + i::int)), '') as filter_order, step::int as step,
            kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
            good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
            (sum(removed) over (partition by part, own))::bigint as shapley
        from r
    """,
    "op13_warc": """
        with p as (select page_id, coalesce(html, '') as t from pages),
        g as (
            select page_id, octet_length(encode(t)) as size, sha1(t) as digest, max(page_id) over (partition by t) as top from p
        ), r as (
            select *, size >= 1000 and top is not null and (page_id is null or page_id < top) as again from g
        )
        select page_id, size::bigint as payload_bytes, digest as payload_digest,
            case when again then 'revisit' else 'response' end as record_type, case when again then top end as refers_to
        from r
    """,
}
