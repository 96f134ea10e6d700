"""The queries op1_... to op10_... and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, exact_dedup, mixing, quality, simhash, suffix_dedup, token_counts, toxicity, url_rules
from .base import table

#: (host, path, verdict), as the contract of op6 gives them.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def crc_is(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves that remainder."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder


def rules(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(map(str, RULES)) + " as t(host, path, verdict)")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, quality.label_grades(table(spark, sf_dir, "labels")), grades=3))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The snapshot: the rows with an even hash; the others come in as a new batch.
    return exact_dedup.exact_groups(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels, held_out=crc_is("doc_id", 4, 2))
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(crc_is("doc_id", 4, 2), F.lit(False)))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"), held_out=crc_is("doc_id", 5, 1))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.apply_rules(table(spark, sf_dir, "pages"), rules(spark))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The positions of all passes stay with the operator and the pipeline; here their number and the last.
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumns({"places": F.size("positions").cast("long"), "last_position": F.try_element_at("positions", F.lit(-1))}).drop("positions")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256)).drop("item_ids")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_quality": op1,
    "op2_exact_dedup": op2,
    "op3_simhash_near_dedup": op3,
    "op4_toxicity_neighbours": op4,
    "op5_context_tree_scores": op5,
    "op6_url_rules": op6,
    "op7_suffix_dedup": op7,
    "op8_curriculum_mix": op8,
    "op9_decontaminate": op9,
    "op10_token_counts": op10,
}


ORACLE: dict[str, str] = {
    "op2_exact_dedup": """
        with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256, coalesce(text, '') as text from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
        from d window w as (partition by text)""",
    "op6_url_rules": r"""
        with u as (
            select page_id, case when instr(coalesce(url, ''), '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest from pages
        ), p as (
            select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
        ), r as (
            select * from (values RULES) as t(rhost, rpath, rverdict)
        ), m as (
            select page_id, max_by(struct_pack(rule := rhost || rpath, verdict := rverdict), length(rhost || rpath)) as best
            from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id
        )
        select p.page_id, p.host, p.path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from p left join m using (page_id)""".replace("RULES", ", ".join(map(str, RULES))),
    "op8_curriculum_mix": r"""
        with recursive d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(doc_id::varchar) as okey from documents
        ), s as (
            select source, row_number() over (order by source is null, source) as rank, sum(size)::bigint as source_size from d group by source
        ), g as (
            select source, rank, source_size, ((rank - 1) % 3 + 1)::double as w, 3 * source_size as cap, (rank % 3 - 1) * 0.5::double as slope from s
        ), fill as (  -- shares the words out again until no source is above its cap
            select 0 as round, []::bigint[] as full_ranks, (select sum(source_size) from g)::double / (select sum(w) from g) as level
            union all
            select round + 1, now.ranks, ((select sum(source_size) from g) - coalesce((select sum(cap) from g where list_contains(now.ranks, g.rank)), 0))::double
                   / nullif((select sum(w) from g where not list_contains(now.ranks, g.rank)), 0)
            from fill, lateral (select coalesce(list(g.rank order by g.rank), []::bigint[]) as ranks from g where g.w * fill.level > g.cap or list_contains(fill.full_ranks, g.rank)) as now
            where len(now.ranks) > len(full_ranks)
        ), t as (
            select g.*, case when list_contains(f.full_ranks, g.rank) then cap::double else least(w * f.level, cap::double) end as target
            from g, (select * from fill order by round desc limit 1) as f
        ), x as (
            select d.doc_id, d.source, d.size, t.source_size, t.target, t.slope,
                   coalesce(sum(d.size) over (partition by d.source order by d.okey, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before,
                   case when t.source_size > 0 then least(floor(t.target / t.source_size), 3)::bigint else 0 end as passes
            from d join t on d.source is not distinct from t.source
        ), y as (
            select *, least(passes * size + greatest(0, least(size, round(target)::bigint - passes * source_size - before)), 3 * size)::bigint as taken from x
        ), z as (
            select *, case when taken > 0 then ceil(taken / size)::bigint else 0 end as places from y
        )
        select doc_id, source, size, source_size, target, taken, places,
               case when taken > 0 then case when slope = 0 then before / target
                    else abs((slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * (before / target))) / (2 * slope)) end end as position,
               case when taken > 0 then case when slope = 0 then (before + (places - 1) * source_size) / target
                    else abs((slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * ((before + (places - 1) * source_size) / target))) / (2 * slope)) end end as last_position
        from z""",
    "op9_decontaminate": r"""
        with d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
        ), b as (
            select item_id::varchar as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
        ), bw as (
            select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') as win
            from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0)
        ), lens as (
            select distinct n from bw
        ), dw as (
            select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as win
            from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, lens where len(ws) >= n)
        ), h as (
            select doc_id, i, n, item_id from dw join bw using (n, win)
        ), hit as (
            select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from (select distinct doc_id, i, n from h)) group by doc_id
        ), its as (
            select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256 from (select distinct doc_id, item_id from h) group by doc_id
        )
        select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
        from d left join hit using (doc_id) left join its using (doc_id)""",
}
