"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, filteraudit, fingerprint, langid, linededup, periodicity, quality, simhash, suffixtable, tokencount, tokenfile, urlfilter
from docloom.llm.common import scratch, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_files(spark, sf_dir):
    path = scratch(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return tokenfile.digests(tokenfile.read(spark, path))


def op3_line_dedup(spark, sf_dir):
    return linededup.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op4_bpe(spark, sf_dir):
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE))


def op5_decontaminate(spark, sf_dir):
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "last_word")


#: (pattern, action, date) of the list that the query of the URL filters applies.
URL_LIST = (
    ("example.net", "add", "2024-02-01"), ("example.net", "remove", "2024-04-15"), ("example.net", "add", "2024-11-01"),
    ("example.org", "add", "2024-06-01"), ("example.org", "remove", "2024-09-01"),
    ("tionsh.example.net", "add", "2024-03-01"), ("tionsh.example.net", "remove", "2024-08-01"),
    ("tionsh.example.net/de", "add", "2024-01-10"), ("ththre.example.com/en", "add", "2024-05-05"),
    ("ththre.example.com", "add", "2024-10-01"), ("ththon.example.com", "add", "2024-01-01"), ("ththon.example.com", "remove", "2024-12-01"),
)


def op6_url_filters(spark, sf_dir):
    """`pages` has no fetch times: page_id picks a day of 2024."""
    entries = spark.createDataFrame(URL_LIST, "pattern string, action string, day string").select("pattern", "action", F.to_timestamp("day").alias("at"))
    pages = table(spark, sf_dir, "pages")
    fetched = F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(pages.page_id, F.lit(366)).cast("int")))
    found = urlfilter.filtered(pages, entries, fetched)
    return found.select("page_id", "host", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched"), F.col("blocked").cast("int").alias("blocked"), "pattern", F.date_format("listed_at", "yyyy-MM-dd").alias("listed"), "n_patterns")


def op7_token_counts(spark, sf_dir):
    scores = tokencount.zipf_scores(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tokencount.token_counts(table(spark, sf_dir, "documents"), scores, public_tokenizers.PATTERN)


def op8_quality(spark, sf_dir):
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_scores(spark, sf_dir):
    return suffixtable.scores(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark, sf_dir):
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_language_id(spark, sf_dir):
    return langid.predicted(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    return periodicity.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


def op13_filter_audit(spark, sf_dir):
    return filteraudit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_token_files": op2_token_files,
        "op3_line_dedup": op3_line_dedup,
        "op4_bpe": op4_bpe,
        "op5_decontaminate": op5_decontaminate,
        "op6_url_filters": op6_url_filters,
        "op7_token_counts": op7_token_counts,
        "op8_quality": op8_quality,
        "op9_lm_scores": op9_lm_scores,
        "op10_fingerprints": op10_fingerprints,
        "op11_language_id": op11_language_id,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_filter_audit": op13_filter_audit,
    }


def _values() -> str:
    return ", ".join(f"('{p}', '{a}', date '{d}')" for p, a, d in URL_LIST)


def oracle_sql() -> dict[str, str]:
    words = """list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"""
    return {
        # a stretch of 15 words with 3 changed ones has an unchanged run of 3 words, so those give all diagonals
        "op5_decontaminate": f"""
            with d as (select doc_id, {words} as w from documents), b as (select item_id, {words} as w from benchmark),
            dw as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) - 1 as p from d),
            bw as (select item_id, unnest(w) as w, generate_subscripts(w, 1) - 1 as q from b),
            d3 as (select doc_id, p, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as t from dw window o as (partition by doc_id order by p)),
            b3 as (select item_id, q, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as t from bw window o as (partition by item_id order by q)),
            diagonals as (select distinct doc_id, item_id, p - q as shift from d3 join b3 using (t)),
            compared as (
                select g.doc_id, g.item_id, g.shift, bw.q, (dw.w = bw.w)::int as same
                from diagonals g join bw on bw.item_id = g.item_id join dw on dw.doc_id = g.doc_id and dw.p = bw.q + g.shift),
            stretches as (
                select *, sum(same) over o as good, count(*) over o as n from compared
                window o as (partition by doc_id, item_id, shift order by q rows between 14 preceding and current row))
            select doc_id, item_id, min(q + shift - 14) as first_word, max(q + shift) as last_word
            from stretches where n = 15 and good >= 12 group by doc_id, item_id""",
        "op6_url_filters": f"""
            with e(pattern, action, day) as (values {_values()}),
            changes as (select *, lag(action, 1, 'remove') over (partition by pattern order by day) as before from e),
            spans as (select pattern, action, day as since, lead(day) over (partition by pattern order by day) as until from changes where action <> before),
            c as (
                select page_id, regexp_extract(lower(url), '://([^/?#:]+)', 1) as host, date '2024-01-01' + (page_id % 366)::int as fetched,
                    rtrim(regexp_extract(url, '://[^/?#]*/+([^?#]*)', 1), '/') as path
                from pages),
            m as (
                select c.*, s.pattern, s.since from c left join spans s
                on s.action = 'add' and s.since <= c.fetched and (s.until is null or c.fetched < s.until) and (
                    case when s.pattern like '%/%' then host || '/' || path = s.pattern or starts_with(host || '/' || path, s.pattern || '/')
                    else host = s.pattern or ends_with(host, '.' || s.pattern) end))
            select page_id, any_value(host) as host, strftime(any_value(fetched), '%Y-%m-%d') as fetched, (count(pattern) > 0)::int as blocked,
                arg_max(pattern, length(pattern)) as pattern, strftime(arg_max(since, length(pattern)), '%Y-%m-%d') as listed, count(pattern) as n_patterns
            from m group by page_id""",
        "op13_filter_audit": """
            with recursive orders(o) as (
                select '' union all select o || f from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) t(f) where not contains(o, f)),
            l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
            d as (
                select d.doc_id, coalesce(source, '') as part, coalesce(text, '') as t, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
                    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
                from documents d left join l on l.doc_id = d.doc_id),
            m as (
                select part, good, toxic, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::int
                    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask
                from d),
            cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
            steps as (
                select o, s::int as step, 1 << (ascii(o[s]) - 65) as bit, coalesce(list_sum(list_transform(range(1, s), lambda k: 1 << (ascii(o[k]) - 65))), 0)::bigint as seen
                from orders, range(1, 6) r(s) where length(o) = 5),
            counted as (
                select part, o, step, bit, sum(n) filter (mask & (seen | bit) = 0) as kept, sum(n) filter (mask & bit > 0 and mask & seen = 0) as removed, sum(n) filter (mask & bit > 0 and mask & seen > 0) as redundant,
                    sum(n) filter (mask = bit) as alone, sum(good) filter (mask & bit > 0 and mask & seen = 0) as good, sum(toxic) filter (mask & bit > 0 and mask & seen = 0) as toxic
                from cells, steps group by part, o, step, bit)
            select part, o as filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(alone, 0)::bigint as unique_fails,
                coalesce(good, 0)::bigint as good_lost, coalesce(toxic, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley
            from counted""",
    }
