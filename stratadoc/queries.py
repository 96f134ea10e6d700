"""The queries over document structure, each with the same question in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import counters, mathml, text
from .operators import cascade, edits, fingerprint, ordered, rules, search, tables, validate
from .sources import blocks, corpus, docx, package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


def rows(spark: SparkSession, values: str) -> DataFrame:
    return spark.sql(f"select * from {values}")


# Small tables that the data don't have, the same for both engines.
STYLES = """(values
  ('Normal', 'Normal', cast(null as varchar(99)), 'Calibri', 22, cast(null as boolean), cast(null as varchar(9)), cast(null as varchar(9))),
  ('Heading1', 'heading 1', 'Normal', null, 32, true, '2F5496', null),
  ('Heading2', 'heading 2', 'Heading1', null, 26, null, null, null),
  ('Plain', 'Plain', 'Heading2', null, null, false, null, 'center'),
  ('system', 'system', 'Heading1', null, null, null, null, null),
  ('user', 'user', 'Normal', null, null, null, null, 'both'),
  ('assistant', 'assistant', 'user', 'Arial', null, null, 'auto', null),
  ('LoopA', 'LoopA', 'LoopB', null, 20, null, null, null),
  ('LoopB', 'LoopB', 'LoopA', 'Courier', null, null, null, 'left'),
  ('Unused', 'Unused', 'Normal', null, 18, null, null, null)
) as t(id, name, based_on, font, size, bold, color, align)"""
FIELDS = ["font", "size", "bold", "color", "align"]
_CHAIN = f"""chain as (
  select id as style, id as ancestor, based_on as next, 0 as depth, [id]::varchar[] as path from {STYLES}
  union all
  select c.style, s.id, s.based_on, c.depth + 1, list_append(c.path, s.id) from chain c join {STYLES.replace('as t(', 'as s(')} on s.id = c.next where not list_contains(c.path, s.id)
)"""
_RESOLVED = "resolved as (select style as id, " + ", ".join(f"arg_min({f}, depth) filter (where {f} is not null) as {f}" for f in FIELDS) + f" from (select c.style, c.depth, s.* from chain c join {STYLES.replace('as t(', 'as s(')} on s.id = c.ancestor) group by style)"


def styles(spark: SparkSession) -> DataFrame:
    return rows(spark, STYLES)


@query(f"with recursive {_CHAIN}, {_RESOLVED} select * from resolved")
def style_cascade(spark, sf_dir):
    return cascade.resolve(styles(spark), FIELDS)


@query(f"with recursive {_CHAIN} select style, max(depth)::bigint as depth from chain group by style")
def style_chain_depth(spark, sf_dir):
    return cascade.closure(styles(spark)).groupBy("style").agg(F.max("depth").cast("long").alias("depth"))


@query(f"with recursive {_CHAIN} select style, ancestor from chain where next is not null and list_contains(path, next)")
def style_cycle_guard(spark, sf_dir):
    return cascade.closure(styles(spark)).where("cyclic").select("style", "ancestor")


@query(f"""with u as (select case when s.id is null then 'Normal' else s.id end as id, count(*) as n from conversations c left join {STYLES.replace('as t(', 'as s(')} on s.id = c.role group by 1)
  select s.id, s.name, coalesce(u.n, 0)::bigint as usage_count from {STYLES.replace('as t(', 'as s(')} left join u using (id)""")
def style_usage(spark, sf_dir):
    return cascade.usage(styles(spark), corpus.conversations(spark, sf_dir), "Normal")


@query(f"select s.id, s.name from {STYLES.replace('as t(', 'as s(')} where s.id <> 'Normal' and s.id not in (select role from conversations where role is not null)")
def unused_styles(spark, sf_dir):
    return cascade.usage(styles(spark), corpus.conversations(spark, sf_dir), "Normal").where("usage_count = 0 and id <> 'Normal'").select("id", "name")


ALIASES = "(values " + ", ".join(f"('{alias}', '{en}')" for en, zh in text.STYLE_NAMES for alias in (en, zh)) + ") as a(alias, canonical)"
DECLARED = "(values ('H1x', '标题 1'), ('Normal', '正文'), ('Body', 'NORMAL'), ('Two', '标题 2'), ('New', 'New'), ('NoName', cast(null as varchar(9)))) as t(id, name)"


@query(f"""with d as (select id, lower(coalesce(canonical, name)) as name from {DECLARED} left join {ALIASES} on alias = name where name is not null),
  e as (select id, lower(coalesce(canonical, name)) as name from {STYLES} left join {ALIASES} on alias = name where name is not null)
  select d.id as declared_id, e.id as existing_id, d.name from d join e using (name) where d.id <> e.id""")
def style_name_collisions(spark, sf_dir):
    return cascade.collisions(rows(spark, DECLARED), styles(spark).select("id", "name"), rows(spark, ALIASES))


SLOTS = {"minorHAnsi": "Calibri", "majorHAnsi": "Cambria", "minorEastAsia": "SimSun"}
THEMED = "(values (1, 'minorHAnsi', 'Arial'), (2, cast(null as varchar(20)), 'Arial'), (3, 'nowhere', 'Times'), (4, 'majorHAnsi', cast(null as varchar(9)))) as t(id, theme, font)"


@query(f"select id, case theme when 'minorHAnsi' then 'Calibri' when 'majorHAnsi' then 'Cambria' when 'minorEastAsia' then 'SimSun' else font end as font from {THEMED}")
def theme_font_resolution(spark, sf_dir):
    return rows(spark, THEMED).select("id", cascade.theme_value(F.col("theme"), F.col("font"), SLOTS).alias("font"))


AFTER = "(values ('Heading1', 28, true, '2F5496'), ('Plain', 22, true, 'FF0000'), ('Fresh', 20, cast(null as boolean), cast(null as varchar(9)))) as t(id, size, bold, color)"


@query(f"""with recursive {_CHAIN}, {_RESOLVED}, a as (select * from {AFTER}),
  x as (select a.id, 'size' as field, r.size::varchar as old, a.size::varchar as new from a left join resolved r using (id)
  union all select a.id, 'bold', r.bold::varchar, a.bold::varchar from a left join resolved r using (id)
  union all select a.id, 'color', r.color, a.color from a left join resolved r using (id)) select * from x where old is distinct from new""")
def style_delta(spark, sf_dir):
    return cascade.delta(cascade.resolve(styles(spark), FIELDS), rows(spark, AFTER), ["size", "bold", "color"])


DIRECT = "(values ('Plain', 1, '22', '000000'), ('Plain', 2, '24', cast(null as varchar(9))), ('Plain', 3, '22.0000001', 'FF0000'), ('Other', 4, '1', '2')) as t(style_id, para_seq, size, color)"
WANT = "(values ('Plain', '22', 'FF0000')) as t(style_id, size, color)"


@query(f"""with x as (select style_id, para_seq, 'size' as field, size as own from {DIRECT} union all select style_id, para_seq, 'color', color from {DIRECT}),
  w as (select style_id, 'size' as field, size as want from {WANT} union all select style_id, 'color', color from {WANT}),
  j as (select *, coalesce(abs(try_cast(own as double) - try_cast(want as double)) < 1e-6, own = want) as same from x join w using (style_id, field) where own is not null)
  select style_id, field, count(*) filter (where not same) as overridden, count(*) filter (where same) as redundant, arg_min(own, para_seq) filter (where not same) as first_override from j group by all""")
def vs_direct(spark, sf_dir):
    return cascade.versus_direct(rows(spark, WANT), rows(spark, DIRECT), ["size", "color"])


def _formatted(spark, sf_dir):
    """Turns as paragraphs, formatted by their roles' styles."""
    look = cascade.resolve(styles(spark), FIELDS)
    p = corpus.conversations(spark, sf_dir).join(look, F.col("style_id") == F.col("id"), "left")
    empty = F.lit(None).cast("string")
    p = p.select("doc_id", "para_seq", "style_id", "text", F.col("font").alias("font_ascii"), empty.alias("font_h_ansi"), empty.alias("font_east_asia"), "size", "bold", F.lit(None).cast("boolean").alias("italic"), empty.alias("underline"), F.lit(None).cast("boolean").alias("caps"), "color", F.col("align").alias("alignment"), F.lit(0).alias("first_line_indent"), F.when(F.startswith(F.col("text"), F.lit("A")), "1").alias("num_id"))
    return p.withColumn("raw_fp", fingerprint.raw(p))


_RAW = """coalesce(r.font, '?') || '|' || coalesce(r.size::varchar, '?') || '|' || case when r.bold then 'B' else '' end || '|' || case when r.color <> 'auto' then r.color else '' end || '|' || coalesce(r.align, '') || '||' || case when starts_with(c.text, 'A') then 'L' else '' end"""


@query(f"""with recursive {_CHAIN}, {_RESOLVED}, p as (select c.conv_id as doc_id, c.turn as para_seq, c.role as style_id, c.text, {_RAW} as raw_fp from conversations c left join resolved r on r.id = c.role),
  s as (select raw_fp, style_id, count(*) as n, min(row(doc_id, para_seq)) as first from p group by all),
  b as (select raw_fp, arg_max(style_id, n) as style_id, max(n) as n from (select * from s order by first desc) group by raw_fp),
  g as (select raw_fp, count(*) as n, min(doc_id) as first_doc, arg_min(para_seq, row(doc_id, para_seq)) as first_seq, floor(sum(length(trim(text))) / count(*) + 0.5)::bigint as avg_len from p group by raw_fp)
  select g.raw_fp, chr((64 + row_number() over (order by g.n desc, g.raw_fp))::int) as label, substr(sha256(g.raw_fp), 1, 6) as fp_hash, g.n, first_doc, first_seq, avg_len, case when b.n >= 0.8 * g.n and b.style_id <> 'Normal' then b.style_id end as dominant_style from g join b using (raw_fp)""")
def fingerprint_summary(spark, sf_dir):
    return fingerprint.summary(_formatted(spark, sf_dir))


RUN_ROWS = """(values (1, 1, 0, 'ab', 'Arial', 20), (1, 1, 1, 'cd', 'Times', 20), (1, 1, 2, '', 'Times', 20), (1, 2, 0, 'longest', 'Arial', cast(null as int)),
  (2, 1, 0, 'x', 'Arial', 22), (2, 1, 1, 'yy', 'Arial', 22)) as t(doc_id, para_seq, run_idx, text, font, size)"""


@query(f"select doc_id, para_seq, arg_max(run_idx, length(text) * 1000 + run_idx) as run_idx from {RUN_ROWS} group by all")
def run_dominant(spark, sf_dir):
    return fingerprint.dominant_run(rows(spark, RUN_ROWS))


@query(f"""select doc_id, field, count(distinct value) as values, case when count(distinct value) > 1 then 'mixed' else 'uniform' end as verdict from
  (select doc_id, 'font' as field, coalesce(font, '<absent>') as value from {RUN_ROWS} union all select doc_id, 'size', coalesce(size::varchar, '<absent>') from {RUN_ROWS}) group by doc_id, field""")
def run_diversity(spark, sf_dir):
    return fingerprint.diversity(rows(spark, RUN_ROWS), ["font", "size"])


def _numbered(spark, sf_dir):
    p = corpus.conversations(spark, sf_dir)
    level = F.when(F.col("style_id") == "system", 0).when(F.col("style_id") == "user", 1).otherwise(2)
    return p.select("doc_id", "para_seq", F.lit("1").alias("num_id"), level.alias("level"), F.lit(1).alias("start_0"), F.lit(1).alias("start_1"), F.lit(3).alias("start_2"))


_COUNTED = """p as (select conv_id as doc_id, turn as para_seq, case role when 'system' then 0 when 'user' then 1 else 2 end as level from conversations),
  e as (select *, count(*) filter (where level < 1) over w as e1, count(*) filter (where level < 2) over w as e2, count(*) filter (where level = 0) over w as c0, count(*) filter (where level <= 1) over w as r1, count(*) filter (where level <= 2) over w as r2
        from p window w as (partition by doc_id order by para_seq)),
  n as (select doc_id, para_seq, level, case when c0 > 0 then c0 end as value_0,
          case when r1 > 0 then count(*) filter (where level = 1) over (partition by doc_id, e1 order by para_seq) end as value_1,
          case when r2 > 0 then 2 + count(*) filter (where level = 2) over (partition by doc_id, e2 order by para_seq) end as value_2 from e)"""


@query(f"with {_COUNTED} select doc_id, para_seq, level, value_0, value_1, value_2 from n")
def numbering_counters(spark, sf_dir):
    return ordered.numbering_counters(_numbered(spark, sf_dir)).select("doc_id", "para_seq", "level", "value_0", "value_1", "value_2")


@query(f"""with {_COUNTED} select doc_id, para_seq, case level when 0 then 'Part ' || coalesce(value_0::varchar, '') when 1 then coalesce(value_0::varchar, '') || '.' || coalesce(value_1::varchar, '')
  else coalesce(value_0::varchar, '') || '-' || coalesce(value_1::varchar, '') || case when value_2 < 10 then ' (0' || value_2 || ')' else ' (' || value_2 || ')' end end as label from n""")
def numbering_labels(spark, sf_dir):
    n = ordered.numbering_counters(_numbered(spark, sf_dir))
    pattern = F.when(F.col("level") == 0, "Part %1").when(F.col("level") == 1, "%1.%2").otherwise("%1-%2 (%3)")
    return n.select("doc_id", "para_seq", ordered.level_text(pattern, [F.lit("decimal"), F.lit("decimal"), F.lit("decimalZero")], F.lit(False)).alias("label"))


@query(f"with {_COUNTED} select doc_id, para_seq, level from n where value_0 is null or (level = 2 and value_1 = 0)")
def numbering_skipped_levels(spark, sf_dir):
    return ordered.numbering_counters(_numbered(spark, sf_dir)).where("value_0 is null or (level = 2 and value_1 = 0)").select("doc_id", "para_seq", "level")


_ALPHA = "case when n < 27 then chr((64 + n)::int) else chr((64 + (n - 1) // 26)::int) || chr((65 + (n - 1) % 26)::int) end"
_ROMAN = "repeat('C', (n // 100)::int) || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][(n // 10) % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1]"


def _cjk(digits: str, over: str) -> str:
    return f"case when n < 10 then substr('{digits}', n + 1, 1) when n < 20 then '十' || case when n = 10 then '' else substr('{digits}', n - 9, 1) end when n < 100 then substr('{digits}', n // 10 + 1, 1) || '十' || case when n % 10 = 0 then '' else substr('{digits}', n % 10 + 1, 1) end else {over} end"


_DIGITS = "translate(n::varchar, '0123456789', '〇一二三四五六七八九')"
_FORMATS = ["decimal", "decimalZero", "upperLetter", "lowerLetter", "upperRoman", "lowerRoman", "chineseCounting", "ideographTraditional", "bullet", "hex"]


@query(f"""select n, f as fmt, case f when 'decimalZero' then case when n < 10 then '0' || n else n::varchar end when 'upperLetter' then {_ALPHA} when 'lowerLetter' then lower({_ALPHA}) when 'upperRoman' then {_ROMAN} when 'lowerRoman' then lower({_ROMAN})
  when 'chineseCounting' then {_cjk('〇一二三四五六七八九', _DIGITS)} when 'ideographTraditional' then substr('甲乙丙丁戊己庚辛壬癸', (n - 1) % 10 + 1, 1) when 'bullet' then '' else n::varchar end as shown
  from (select unnest(range(1, 121)) as n), (select unnest({_FORMATS}) as f)""")
def numfmt_render(spark, sf_dir):
    n = spark.range(1, 121).select(F.col("id").alias("n"), F.explode(F.array(*map(F.lit, _FORMATS))).alias("fmt"))
    return n.select("n", "fmt", counters.numbering(F.col("fmt"), F.col("n")).alias("shown"))


_CAPTIONS = ["arabic", "alphabetic", "ALPHABETIC", "roman", "ROMAN", "chinese", "chinese-formal"]


@query(f"""select n, f as fmt, case f when 'alphabetic' then lower({_ALPHA}) when 'ALPHABETIC' then {_ALPHA} when 'roman' then lower({_ROMAN}) when 'ROMAN' then {_ROMAN} when 'chinese' then {_cjk('零一二三四五六七八九', 'n::varchar')}
  when 'chinese-formal' then {_cjk('零壹贰叁肆伍陆柒捌玖', 'n::varchar')} else n::varchar end as shown from (select unnest(range(1, 121)) as n), (select unnest({_CAPTIONS}) as f)""")
def caption_format_render(spark, sf_dir):
    n = spark.range(1, 121).select(F.col("id").alias("n"), F.explode(F.array(*map(F.lit, _CAPTIONS))).alias("fmt"))
    return n.select("n", "fmt", counters.caption(F.col("fmt"), F.col("n")).alias("shown"))


LEVELS = """(values (1, '1', 0, 'decimal', '%1.'), (1, '1', 1, 'lowerLetter', '%2)'), (1, '2', 0, 'decimal', '%1.'), (1, '2', 1, 'lowerLetter', '%2)'), (1, '3', 0, 'bullet', '•')) as t(doc_id, num_id, level, fmt, lvl_text)"""


@query(f"select signature, count(*) as schemes, min(num_id) as first_num from (select doc_id, num_id, string_agg(level || ':' || fmt || '|' || lvl_text, ';;' order by level) as signature from {LEVELS} group by doc_id, num_id) group by signature")
def numbering_clusters(spark, sf_dir):
    of_num = rows(spark, LEVELS).groupBy("doc_id", "num_id").agg(F.array_sort(F.collect_list(F.struct("level", F.concat_ws("|", F.concat_ws(":", "level", "fmt"), "lvl_text").alias("s")))).alias("l"))
    return of_num.groupBy(F.array_join(F.transform("l", lambda x: x["s"]), ";;").alias("signature")).agg(F.count("*").alias("schemes"), F.min("num_id").alias("first_num"))


_RUNS = "select doc_id, para_seq, dense_rank() over (partition by doc_id order by e) as run_no from (select conv_id as doc_id, turn as para_seq, role, count(*) filter (where {}) over (partition by conv_id order by turn) as e from conversations) where role = '{}'"


@query(_RUNS.format("role <> 'assistant' or role is null", "assistant"))
def restart_per_instance(spark, sf_dir):
    return ordered.restarts(corpus.conversations(spark, sf_dir), "assistant", "perInstance")


@query(_RUNS.format("role = 'system'", "user"))
def restart_by_heading(spark, sf_dir):
    return ordered.restarts(corpus.conversations(spark, sf_dir), "user", "byHeading", "system")


@query(_RUNS.format("role = 'user'", "assistant"))
def restart_at_style_change(spark, sf_dir):
    return ordered.restarts(corpus.conversations(spark, sf_dir), "assistant", "atStyleChange", "user")


@query("""with c as (select conv_id as doc_id, turn as para_seq, role, case when turn % 3 = 0 then '9' end as num_id from conversations),
  e as (select *, count(*) filter (where role = 'system' or role = 'user' and num_id is not null) over (partition by doc_id order by para_seq) as e from c)
  select doc_id, para_seq, dense_rank() over (partition by doc_id order by e) as run_no from e where role = 'user' and num_id is null""")
def restart_with_overrides(spark, sf_dir):
    c = corpus.conversations(spark, sf_dir).withColumn("num_id", F.expr("case when para_seq % 3 = 0 then '9' end"))
    return ordered.restarts(c, "user", "byHeading", "system", others=["assistant"], base_num="1")


@query("""with c as (select conv_id as doc_id, turn as para_seq, role from conversations), e as (select *, count(*) filter (where role is null or role not in ('assistant', 'system')) over (partition by doc_id order by para_seq) as e from c)
  select doc_id, para_seq, dense_rank() over (partition by doc_id order by e) as run_no from e where role = 'assistant'""")
def restart_beside_other_lists(spark, sf_dir):
    return ordered.restarts(corpus.conversations(spark, sf_dir), "assistant", "perInstance", others=["system"])


@query(f"select doc_id, run_no, 7 + run_no as num_id from (select distinct doc_id, run_no from ({_RUNS.format(chr(114) + 'ole = ' + repr('system'), 'user')}))")
def restart_forks(spark, sf_dir):
    runs = ordered.restarts(corpus.conversations(spark, sf_dir), "user", "byHeading", "system")
    return ordered.fork_ids(runs, runs.select("doc_id", F.lit(7).cast("long").alias("max_num")).distinct())


CAPTION_ROWS = """(values (1,'Figure',1,'caption',cast(null as varchar(9)),cast(null as int)), (1,'Figure',2,'caption','start',null), (1,'Figure',3,'caption','continue',null), (1,'Figure',4,'caption','continue',null), (1,'Figure',5,'reset',null,10),
  (1,'Figure',6,'caption',null,null), (1,'Figure',7,'caption','start',null), (1,'Figure',8,'caption','continue',null), (1,'Table',9,'caption',null,null), (1,'Figure',10,'reset',null,null), (1,'Figure',11,'caption',null,null), (2,'Figure',1,'caption','start',null)) as t(doc_id, ident, para_seq, kind, sub_group, new_value)"""


@query("select * from (values (1,'Figure',1,null,1,0),(1,'Figure',2,'start',2,1),(1,'Figure',3,'continue',2,2),(1,'Figure',4,'continue',2,3),(1,'Figure',6,null,10,0),(1,'Figure',7,'start',11,1),(1,'Figure',8,'continue',11,2),(1,'Table',9,null,1,0),(1,'Figure',11,null,1,0),(2,'Figure',1,'start',1,1)) as t(doc_id, ident, para_seq, sub_group, parent, sub)")
def caption_subgroups(spark, sf_dir):
    return ordered.caption_counters(rows(spark, CAPTION_ROWS))


@query("""with e as (select conv_id as doc_id, turn as para_seq, role, count(*) filter (where role = 'system') over (partition by conv_id order by turn) as epoch from conversations)
  select doc_id, 'Figure' as ident, para_seq, null::varchar as sub_group, row_number() over (partition by doc_id, epoch order by para_seq) as parent, 0::bigint as sub from e where role = 'assistant'""")
def caption_counters(spark, sf_dir):
    p = corpus.conversations(spark, sf_dir).where("style_id in ('system', 'assistant')")
    kind = F.when(F.col("style_id") == "system", "reset").otherwise("caption")
    return ordered.caption_counters(p.select("doc_id", F.lit("Figure").alias("ident"), "para_seq", kind.alias("kind"), F.lit(None).cast("string").alias("sub_group"), F.lit(1).alias("new_value")))


@query("""select conv_id as doc_id, turn as para_seq, last_value(case when role = 'user' then turn end ignore nulls) over w as heading_seq, count(*) filter (where role = 'user') over w as heading_no from conversations window w as (partition by conv_id order by turn)""")
def chapter_prefix(spark, sf_dir):
    return ordered.nearest_heading(corpus.conversations(spark, sf_dir), "user").select("doc_id", "para_seq", "heading_seq", "heading_no")


FIELD_ROWS = """(values (1,1,'SEQ','Figure','a1'), (1,2,'SEQ','Figure','a2'), (1,3,'SEQ','Table','a3'), (1,4,'REF','a1',cast(null as varchar(9))), (1,5,'REF','a1',null), (1,6,'REF','gone',null), (2,1,'SEQ','Figure','a1')) as t(doc_id, para_seq, kind, name, anchor)"""


@query(f"select doc_id, name as identifier, count(*) as occurrences, min(para_seq) as first_seq from {FIELD_ROWS} where kind = 'SEQ' group by doc_id, name")
def caption_inventory(spark, sf_dir):
    return rows(spark, FIELD_ROWS).where("kind = 'SEQ'").groupBy("doc_id", F.col("name").alias("identifier")).agg(F.count("*").alias("occurrences"), F.min("para_seq").alias("first_seq"))


@query(f"select s.doc_id, s.anchor, count(r.name) as citations from {FIELD_ROWS.replace('as t(', 'as s(')} left join {FIELD_ROWS.replace('as t(', 'as r(')} on r.doc_id = s.doc_id and r.kind = 'REF' and r.name = s.anchor where s.kind = 'SEQ' group by s.doc_id, s.anchor")
def caption_citations(spark, sf_dir):
    f = rows(spark, FIELD_ROWS)
    refs = f.where("kind = 'REF'").groupBy("doc_id", F.col("name").alias("anchor")).agg(F.count("*").alias("n"))
    return f.where("kind = 'SEQ'").join(refs, ["doc_id", "anchor"], "left").select("doc_id", "anchor", F.coalesce("n", F.lit(0)).alias("citations"))


_EVENTS = """e as (select conv_id as doc_id, turn as para_seq, row_number() over (partition by conv_id order by turn, k) as event_seq, case when k = 0 then 'p' else ['begin', 'end', 'ins', 'sdt', 'begin', 'end', 'none'][(length(coalesce(text, '')) + k) % 7 + 1] end as kind
    from conversations, range(0, 3) as t(k)),
  d as (select *, greatest(0, case kind when 'begin' then 1 else 0 end)::bigint as depth, 0::bigint as before from e where event_seq = 1
    union all select e.*, greatest(0, d.depth + case e.kind when 'begin' then 1 when 'end' then -1 else 0 end), d.depth from d join e on e.doc_id = d.doc_id and e.event_seq = d.event_seq + 1),
  b as (select doc_id, para_seq, event_seq, case when kind in ('ins', 'del') then 'tracked-change' when kind = 'sdt' then 'sdt' when kind = 'begin' or kind = 'p' and before > 0 then 'field' end as reason from d),
  f as (select doc_id, para_seq, arg_min(reason, event_seq) as reason from b where reason is not null group by all)"""


def _events(spark, sf_dir):
    """Each turn as a paragraph with two marks, which the length of its text names."""
    c = corpus.conversations(spark, sf_dir)
    kinds = F.array(*[F.lit(k) for k in ("begin", "end", "ins", "sdt", "begin", "end", "none")])
    each = c.select("doc_id", "para_seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    kind = F.when(F.col("k") == 0, "p").otherwise(F.element_at(kinds, ((F.col("n") + F.col("k")) % 7 + 1).cast("int")))
    return each.select("doc_id", "para_seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("para_seq", "k")).alias("event_seq"), kind.alias("kind"))


@query(f"with recursive {_EVENTS} select doc_id, event_seq, depth from d")
def field_depth(spark, sf_dir):
    return ordered.field_depth(_events(spark, sf_dir)).select("doc_id", "event_seq", "depth")


@query(f"with recursive {_EVENTS} select doc_id, para_seq, reason from f")
def blocker_reasons(spark, sf_dir):
    return ordered.blockers(_events(spark, sf_dir))


@query(f"with recursive {_EVENTS} select reason, count(*) as n from f group by reason")
def blocker_tally(spark, sf_dir):
    return ordered.blockers(_events(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


_LINES = "lines as (select doc_id, lang as style_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as para_seq from documents)"


@query(f"with {_LINES} select doc_id, para_seq, text from lines where regexp_matches(text, '(?i)license') qualify row_number() over (partition by doc_id order by para_seq) <= 50")
def find_paragraphs_regex(spark, sf_dir):
    return search.find_paragraphs(corpus.document_lines(spark, sf_dir), "(?i)license").select("doc_id", "para_seq", "text")


@query(f"""with {_LINES}, s as (select doc_id, para_seq, text, string_split(text, 'tion') as ps from lines where contains(text, 'tion')),
  h as (select doc_id, para_seq, text, unnest(range(1, len(ps))) as i, ps from s),
  a as (select doc_id, para_seq, text, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * 4)::bigint as ch from h)
  select doc_id, para_seq, ch, 4::bigint as len, 'tion' as matched, case when ch > 25 then '…' else '' end || substr(text, greatest(ch - 25, 0) + 1, least(ch + 29, length(text)) - greatest(ch - 25, 0)) || case when ch + 29 < length(text) then '…' else '' end as context from a""")
def find_text_literal(spark, sf_dir):
    return search.find_literal(corpus.document_lines(spark, sf_dir), "tion")


@query(f"""with {_LINES}, m as (select doc_id, para_seq, regexp_extract_all(text, '[A-Z][a-z]+ing\\b') as ms from lines) select doc_id, para_seq, unnest(range(1, len(ms) + 1)) as nth, unnest(ms) as matched from m where len(ms) > 0""")
def find_text_regex(spark, sf_dir):
    return search.find_regex(corpus.document_lines(spark, sf_dir), r"[A-Z][a-z]+ing\b")


HITS = "(values (1,1,0,3), (1,1,4,2), (1,1,8,4), (1,2,0,1)) as h(doc_id, para_seq, ch, len)"
SEGMENTS = "(values (1,1,0,0,5,'body'), (1,1,1,5,9,'link'), (1,1,2,9,20,'body'), (1,2,0,0,1,'body')) as s(doc_id, para_seq, run_index, start, \"end\", region)"


@query(f"""select h.doc_id, h.para_seq, h.ch, min(s.run_index) as first_run, max(s.run_index) as last_run, arg_min(s.region, s.start) as region, min(s.run_index) < max(s.run_index) as cross_run
  from {HITS} join {SEGMENTS} on h.doc_id = s.doc_id and h.para_seq = s.para_seq and s.start < h.ch + h.len and s."end" > h.ch group by all""")
def segment_overlap(spark, sf_dir):
    return search.overlaps(rows(spark, HITS), rows(spark, SEGMENTS.replace('"end"', "`end`")))


@query("select conv_id as doc_id, turn as para_seq, list(length(text)) over (partition by conv_id order by turn rows between 4 preceding and 4 following) as around from conversations")
def neighbors_radius(spark, sf_dir):
    return ordered.neighbours(corpus.conversations(spark, sf_dir)).select("doc_id", "para_seq", "around")


ITEMS = "(values (1,1,true,false),(1,2,true,false),(1,3,false,true),(1,4,true,false),(1,5,false,false),(1,6,true,false),(2,1,true,false),(2,2,false,false)) as t(doc_id, item_seq, is_empty, in_layout)"


@query(f"select doc_id, min(item_seq) as first_seq, max(item_seq) as last_seq, count(*) as n from (select *, count(*) filter (where not is_empty) over (partition by doc_id order by item_seq) as i from {ITEMS} where not in_layout) where is_empty group by doc_id, i")
def empty_run_compression(spark, sf_dir):
    return ordered.empty_runs(rows(spark, ITEMS))


_CELLS = "select l_orderkey as doc_id, l_partkey % 2 as table_idx, l_linenumber % 3 as r, 1 + l_suppkey % 2 as span, cast(l_quantity / 8 as bigint) as paras, l_tax > 0.07 as outline from lineitem"


@query(f"""with r as (select doc_id, table_idx, r, count(*) as tcs, sum(span) as cols, sum(paras) as paras, max(paras) as most, bool_or(outline) as outline from ({_CELLS.replace('cast(l_quantity / 8 as bigint)', 'floor(l_quantity / 8)::bigint')}) group by all),
  t as (select doc_id, table_idx, count(*) as rows, max(cols)::bigint as cols, sum(paras) as paras, max(most) as most, max(tcs) as tcs, bool_or(outline) as outline from r group by all),
  k as (select *, case when rows = 1 and cols = 1 then '1x1' when tcs = 1 and paras > 3 then 'singleTcStack' when outline then 'outlineLvl' when most > {tables.BULK_CELL} then 'bulkCell' when rows > 1 and cols > 1 then 'multiColData' else 'fallback' end as reason from t)
  select doc_id, table_idx, rows, cols, case when reason in ('multiColData', 'fallback') then 'data' else 'layout' end as classification, reason from k""")
def table_classification(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return tables.classify(spark.sql(_CELLS))


@query("select conv_id as doc_id, turn as para_seq, 1 + coalesce(count(*) filter (where role = 'assistant') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as section_index from conversations")
def section_assignment(spark, sf_dir):
    p = corpus.conversations(spark, sf_dir).withColumn("has_sect", F.coalesce(F.col("style_id") == "assistant", F.lit(False)))
    return ordered.sections(p).select("doc_id", "para_seq", "section_index")


SECTIONS = "(values (1,1,11906,16838,1440,1440), (1,2,16838,11906,1440,720), (1,3,16838,11906,1440,720), (2,1,12250,15800,100,20000), (2,2,5000,5000,0,0)) as t(doc_id, section_index, width, height, margin_left, margin_right)"


@query(f"""select doc_id, section_index, case when abs(width - 11906) < 50 and abs(height - 16838) < 50 or abs(width - 16838) < 50 and abs(height - 11906) < 50 then 'A4' when abs(width - 12240) < 50 and abs(height - 15840) < 50 then 'Letter' else 'Custom' end as paper,
  greatest(0, width - margin_left - margin_right)::bigint as usable_width from {SECTIONS}""")
def paper_match(spark, sf_dir):
    return tables.paper(rows(spark, SECTIONS)).select("doc_id", "section_index", "paper", "usable_width")


@query(f"""with l as (select doc_id, section_index, lag(width) over w as ow, width, lag(margin_right) over w as om, margin_right, row_number() over w as n from {SECTIONS} window w as (partition by doc_id order by section_index))
  select doc_id, section_index, 'width' as field, ow::varchar as old, width::varchar as new from l where n > 1 and ow is distinct from width union all select doc_id, section_index, 'margin_right', om::varchar, margin_right::varchar from l where n > 1 and om is distinct from margin_right""")
def section_diff(spark, sf_dir):
    return ordered.section_changes(rows(spark, SECTIONS), ["width", "margin_right"])


SELECTED = "(values ('2-3', 0, 2000, cast(null as int)), ('1', 1, 1441, 5), ('3', 2, 1, 1440)) as t(selector, ord, margin_left, margin_right)"


@query("select * from (values (1,1,1441,5,true),(1,2,2000,720,true),(1,3,2000,1440,true),(2,1,1441,5,true),(2,2,2000,0,true)) as t(doc_id, section_index, margin_left, margin_right, changed)")
def page_setup_layering(spark, sf_dir):
    return tables.layered(rows(spark, SECTIONS), rows(spark, SELECTED), ["margin_left", "margin_right"], {})


@query(f"select '{{\"width\":' || width || ',\"height\":' || height || '}}' as config, count(*) as sections from {SECTIONS} group by width, height")
def hf_groups(spark, sf_dir):
    return tables.same_configs(rows(spark, SECTIONS), ["width", "height"])


RULES = [rules.Pattern("[A-Z]+!!", "Shout", True), rules.Pattern("The ", "Article"), rules.Pattern("Licen[sc]ed", "License")]


def _routed(spark, sf_dir):
    p = corpus.document_lines(spark, sf_dir).withColumn("raw_fp", F.concat_ws("|", "style_id", F.floor(F.length("text") / 200).cast("string")))
    key = p.select("doc_id", "para_seq")
    return rules.route(p, RULES, exclude=key.where("para_seq = 1 and doc_id % 10 = 0"), assign=key.where("para_seq = 2 and doc_id % 7 = 0").withColumn("style", F.lit("Second")), bulk={"fr|0": "Bref", "de|1": "Mittel"})


_ROUTED = f"""{_LINES}, k as (select *, coalesce(style_id || '|', '') || (length(text) // 200) as raw_fp, case when regexp_matches(text, '^[A-Z]+!!') then 0 when regexp_matches(text, '^The ') then 1 when regexp_matches(text, '^Licen[sc]ed') then 2 end as p from lines),
  routed as (select doc_id, para_seq, style_id, text, raw_fp, r as route, case when r = 'pattern' then p end as rule,
    case r when 'assignment' then 'Second' when 'pattern' then ['Shout', 'Article', 'License'][p + 1] when 'bulk' then case raw_fp when 'fr|0' then 'Bref' else 'Mittel' end when 'exclude' then null else style_id end as new_style,
    case when r = 'pattern' and p = 0 then regexp_replace(text, '^[A-Z]+!!', '') else text end as new_text
    from (select *, case when para_seq = 1 and doc_id % 10 = 0 then 'exclude' when para_seq = 2 and doc_id % 7 = 0 then 'assignment' when p is not null then 'pattern' when raw_fp in ('fr|0', 'de|1') then 'bulk' else 'keep' end as r from k))"""


@query(f"with {_ROUTED} select doc_id, para_seq, route, rule, new_style, length(new_text) as new_length from routed")
def rule_routing(spark, sf_dir):
    return _routed(spark, sf_dir).select("doc_id", "para_seq", "route", "rule", "new_style", F.length("new_text").cast("long").alias("new_length"))


@query(f"with {_ROUTED} select rule, count(*) as matched, count(*) filter (where length(new_text) < length(text)) as stripped from routed where rule is not null group by rule")
def strip_stats(spark, sf_dir):
    return rules.strip_stats(_routed(spark, sf_dir))


@query(f"with {_ROUTED} select raw_fp, count(*) filter (where trim(text) = '') as empty, count(*) filter (where trim(text) <> '') as non_empty from routed where route = 'keep' group by raw_fp")
def implicit_keep(spark, sf_dir):
    return rules.kept(_routed(spark, sf_dir), "raw_fp")


@query(f"with {_ROUTED} select new_style, doc_id, para_seq, row_number() over (partition by new_style order by doc_id, para_seq) as nth from routed where route <> 'keep' qualify nth <= 5")
def restyle_samples(spark, sf_dir):
    return rules.samples(_routed(spark, sf_dir).where("route <> 'keep'"), "new_style").select("new_style", "doc_id", "para_seq", "nth")


KINDS = {"upper": "^[A-Z][a-z]+ ", "shout": "^[A-Z]+!!", "pipe": r"^\w+ \|"}


@query(f"with {_LINES}, k as (select style_id, case when regexp_matches(text, '^[A-Z][a-z]+ ') then 'upper' when regexp_matches(text, '^[A-Z]+!!') then 'shout' when regexp_matches(text, '^\\w+ \\|') then 'pipe' end as k from lines) select style_id, count(*) as n, count(distinct k) as kinds, count(distinct k) >= 2 as mixed from k where k is not null group by style_id")
def mixed_numbering(spark, sf_dir):
    return rules.mixed_prefixes(corpus.document_lines(spark, sf_dir), KINDS)


_DIRECT = "select distinct l_orderkey as doc_id, l_orderkey % 3 as para_seq, case l_orderkey % 2 when 0 then 'A' else 'B' end as style_id, l_linenumber % 2 as run_idx, case l_partkey % 3 when 0 then 'sz' when 1 then 'b' else 'color' end as prop, cast(l_suppkey % 2 as varchar(9)) as value from lineitem"
PROVIDED = "(values ('A','sz'),('A','color'),('B','b')) as t(style_id, prop)"


@query(f"""with d as ({_DIRECT}), n as (select doc_id, para_seq, count(distinct run_idx) as runs from d group by all),
  g as (select doc_id, para_seq, style_id, prop, count(distinct value) as v, count(distinct run_idx) as k from d group by all)
  select doc_id, para_seq, prop from g join n using (doc_id, para_seq) join {PROVIDED} using (style_id, prop) where v = 1 and k = runs""")
def selective_strip(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return rules.strippable(spark.sql(_DIRECT), rows(spark, PROVIDED))


_OPS = "(values (0,'insert-before',1,1,'first'),(1,'insert-after',1,1,'after a'),(2,'insert-after',1,1,'after b'),(3,'delete',2,3,cast(null as varchar(9))),(4,'replace',4,4,'instead'),(5,'insert-before',2,2,'gone anchor'),(6,'replace',3,4,'late')) as o(ord, op, lo, hi, text)"


def _edits(spark, sf_dir):
    docs = corpus.conversations(spark, sf_dir).groupBy("doc_id").agg(F.max("para_seq").alias("last")).where("last >= 4")
    return docs.select("doc_id", F.explode(F.expr("array(" + ", ".join(f"named_struct('ord', {o}, 'op', '{k}', 'lo', cast({a} as bigint), 'hi', cast({b} as bigint), 'text', {'cast(null as string)' if t is None else repr(t)})" for o, k, a, b, t in OPS) + ")")).alias("e")).select("doc_id", "e.*")


OPS = [(0, "insert-before", 1, 1, "first"), (1, "insert-after", 1, 1, "after a"), (2, "insert-after", 1, 1, "after b"), (3, "delete", 2, 3, None), (4, "replace", 4, 4, "instead"), (5, "insert-before", 2, 2, "gone anchor"), (6, "replace", 3, 4, "late")]
_EDITS = f"docs as (select conv_id as doc_id from conversations group by conv_id having max(turn) >= 4), ed as (select doc_id, o.* from docs, {_OPS}), tg as (select doc_id, ord, op, unnest(range(lo, hi + 1)) as para_seq from ed)"


@query(f"""with {_EDITS}, r as (
  select conv_id as doc_id, turn as k1, 0 as k2, 0 as k3, text from conversations c where not exists (select 1 from tg where tg.doc_id = c.conv_id and tg.para_seq = c.turn and op in ('delete', 'replace'))
  union all select doc_id, lo, -1, ord, text from ed where op in ('insert-before', 'replace') union all select doc_id, hi, 1, -ord, text from ed where op = 'insert-after')
  select doc_id, row_number() over (partition by doc_id order by k1, k2, k3) as new_seq, text from r""")
def edit_apply_order(spark, sf_dir):
    return edits.apply(corpus.conversations(spark, sf_dir), _edits(spark, sf_dir))


@query(f"with {_EDITS}, g as (select doc_id, para_seq, min(ord) as gone from tg where op in ('delete', 'replace') group by all) select tg.doc_id, ord, para_seq from tg join g using (doc_id, para_seq) where ord > gone")
def stale_conflicts(spark, sf_dir):
    return edits.stale(_edits(spark, sf_dir))


@query(f"with {_EDITS} select op, count(distinct (tg.doc_id, ord)) as edits, count(*) as paragraphs, coalesce(sum(length(c.text)), 0)::bigint as chars from tg left join conversations c on c.conv_id = tg.doc_id and c.turn = tg.para_seq group by op")
def edit_preview(spark, sf_dir):
    return edits.preview(_edits(spark, sf_dir), corpus.conversations(spark, sf_dir))


@query(f"""with {_EDITS}, d as (select doc_id, case when op = 'insert-before' then lo else hi + 1 end as p, sum(case op when 'delete' then -(hi - lo + 1) when 'replace' then 1 - (hi - lo + 1) else 1 end) as delta from ed group by all)
  select doc_id, p::bigint as from_index, shift from (select *, (sum(delta) over (partition by doc_id order by p))::bigint as shift from d) where delta <> 0""")
def index_drift(spark, sf_dir):
    return ordered.drift(edits.deltas(_edits(spark, sf_dir)))


ERRORS_OUT = "(values (1,'doc.xml','bad at line 3'),(1,'doc.xml','bad at line 9'),(1,'doc.xml','bad at line 12'),(1,'num.xml','paragraph #4 wrong '),(1,'doc.xml','/tmp/a.docx unreadable')) as t(doc_id, part, message)"
ERRORS_OLD = "(values (1,'doc.xml','bad at line 7'),(1,'num.xml','paragraph #1 wrong'),(1,'old.xml','was bad')) as t(doc_id, part, message)"
_KEY = "part || '||' || trim(regexp_replace(regexp_replace(regexp_replace(message, '/[^\\s\"'']+\\.docx', '<docx>', 'g'), '\\bline \\d+\\b', 'line N', 'g'), '\\bparagraph #\\d+\\b', 'paragraph #N', 'g'))"


@query(f"select doc_id, {_KEY} as key from {ERRORS_OUT} except all select doc_id, {_KEY} from {ERRORS_OLD}")
def new_validation_errors(spark, sf_dir):
    return validate.new_errors(rows(spark, ERRORS_OUT), rows(spark, ERRORS_OLD))


USES = "(values (1,'document','rId1'),(1,'document','rId9'),(1,'header1','rId1')) as u(doc_id, part, rid)"
RELS = "(values (1,'document','rId1'),(1,'document','rId2'),(1,'document','rId2')) as r(doc_id, part, rid)"


@query(f"select * from {USES} anti join {RELS} using (doc_id, part, rid)")
def dangling_refs(spark, sf_dir):
    return validate.dangling(rows(spark, USES), rows(spark, RELS))


@query(f"select doc_id, part, rid, count(*) as n from {RELS} group by all having count(*) > 1")
def duplicate_rids(spark, sf_dir):
    return validate.duplicate_ids(rows(spark, RELS))


PARTS = "(values (1,'word/document.xml'),(1,'word/media/a.PNG'),(1,'word/media/b.gif')) as p(doc_id, path)"
OVERRIDES = "(values (1,'word/document.xml'),(1,'word/gone.xml')) as o(doc_id, path)"
DEFAULTS = "(values (1,'png'),(1,'rels')) as d(doc_id, ext)"


@query(f"""select doc_id, path, 'no content type' as problem from {PARTS} where path not in (select path from {OVERRIDES}) and lower(string_split(path, '.')[-1]) not in (select ext from {DEFAULTS})
  union all select doc_id, path, 'no such part' from {OVERRIDES} where path not in (select path from {PARTS})""")
def content_type_gaps(spark, sf_dir):
    return validate.content_gaps(rows(spark, PARTS), rows(spark, OVERRIDES), rows(spark, DEFAULTS))


ABSTRACT = "(values (1,1,0,cast(null as varchar(20))),(1,1,1,null),(1,2,0,null),(1,3,0,'multilevel'),(1,3,1,'multilevel'),(2,1,0,null)) as a(doc_id, abstract_id, level, multi_level_type)"


@query(f"select doc_id, abstract_id from {ABSTRACT} group by all having count(*) > 1 and max(multi_level_type) is null")
def numbering_without_type(spark, sf_dir):
    return validate.levels_without_type(rows(spark, ABSTRACT))


NUM_USES = "(values (1,4,'1'),(1,5,'9'),(1,6,cast(null as varchar(9))),(2,1,'7'),(3,1,'2')) as u(doc_id, para_seq, num_id)"
NUMS = "(values (1,'1',1),(1,'4',2),(3,'1',1)) as n(doc_id, num_id, abstract_id)"


@query(f"select u.doc_id, u.para_seq, u.num_id from {NUM_USES} where num_id is not null and doc_id in (select doc_id from {NUMS}) and not exists (select 1 from {NUMS} where n.doc_id = u.doc_id and n.num_id = u.num_id)")
def unknown_numbering(spark, sf_dir):
    return validate.unknown_references(rows(spark, NUM_USES).where("num_id is not null"), rows(spark, NUMS).select("doc_id", "num_id"), "num_id").select("doc_id", "para_seq", "num_id")


PATTERNS = "(values ('%1.'), ('%1. '), ('%1.  '), (' %1'), ('')) as t(lvl_text)"


@query(f"select lvl_text, case length(lvl_text) - length(rtrim(lvl_text, ' ')) when 0 then 'nothing' when 1 then 'space' else 'tab' end as suff, rtrim(lvl_text, ' ') as effective from {PATTERNS}")
def numbering_gap(spark, sf_dir):
    return rows(spark, PATTERNS).select("lvl_text", counters.gap(F.col("lvl_text")).alias("suff"), F.rtrim("lvl_text").alias("effective"))


@query("""with h as (select conv_id as doc_id, turn as para_seq, (length(text) % 4 + 1)::bigint as level from conversations where text is not null),
  l as (select *, coalesce(lag(level) over (partition by doc_id order by para_seq), 0) as before from h) select doc_id, para_seq, level, before from l where level > before + 1""")
def audit_skipped_levels(spark, sf_dir):
    c = corpus.conversations(spark, sf_dir).where("text is not null")
    return ordered.skipped_levels(c.select("doc_id", "para_seq", (F.length("text") % 4 + 1).cast("long").alias("level")))


@query(rf"""with b as (select page_id, unnest(string_split(regexp_replace(html, '{corpus.BLOCK_EDGE}', chr(1) || '<\1', 'g'), chr(1))) as b from pages),
  t as (select regexp_extract(b, '{corpus.BLOCK}', 1) as tag, regexp_replace(b, '<[^>]*>', '', 'g') as text from b where regexp_matches(b, '{corpus.BLOCK}'))
  select tag as look, count(distinct s) as styles, count(*) as n, sum(length(text))::bigint as chars from (select tag, text, case tag when 'h1' then 'Heading1' when 'li' then 'List' else 'Body' end || case when length(text) > 200 then '+' else '' end as s from t) group by tag""")
def audit_role_style_mismatch(spark, sf_dir):
    p = corpus.page_blocks(spark, sf_dir)
    look = F.when(F.col("style_id") == "Heading1", "h1").when(F.col("style_id") == "List", "li").otherwise("p")
    return p.groupBy(look.alias("look")).agg(F.count_distinct("style_id", F.length("text") > 200).alias("styles"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


CJK = """(values (1,1,'List','图 3 说明'),(1,2,'List','Figure 2.1 shows'),(1,3,'Body','(12) x'),(1,4,'List','1.2 题'),(1,5,'Body','第三章 结论'),(1,6,'Body','中文 abc 中文'),(1,7,'List','一、首先'),(1,8,'Body','plain'),(1,9,'List','CHAPTER 4'),(1,10,'Body','用 Spark 3 做')) as t(doc_id, para_seq, style_id, text)"""


_CJK_LINES = f"(select 0 as part, doc_id, para_seq, style_id, text from {CJK} union all select 1, doc_id, n, lang, line from (select doc_id, lang, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents))"


def _cjk_lines(spark, sf_dir):
    """The literal rows and all lines of the documents; a document's key says which."""
    lines = corpus.document_lines(spark, sf_dir)
    both = rows(spark, CJK).withColumn("part", F.lit(0)).unionByName(lines.withColumn("part", F.lit(1)))
    return both.withColumn("doc_id", F.concat("part", F.lit("/"), F.col("doc_id").cast("string")))


def _first(cases: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when regexp_matches(text, '{p}') then {x}" for p, x in cases) + " end"


_SHAPE = _first([(p, f"'{i}'") for p, i in search.CAPTION_SHAPES])
_SHAPE_TEXT = _first([(p, f"regexp_extract(text, '{p}')") for p, _ in search.CAPTION_SHAPES])


@query(f"select part || '/' || doc_id as doc_id, para_seq, {_SHAPE} as identifier, {_SHAPE_TEXT} as prefix from {_CJK_LINES} where {_SHAPE} is not null")
def migrate_caption_candidates(spark, sf_dir):
    return search.caption_candidates(_cjk_lines(spark, sf_dir))


@query(f"select style_id, case when style_id = 'List' then 'bound' else 'unbound' end as kind, count(*) as n from {_CJK_LINES} where {' or '.join(f"regexp_matches(text, '{p}')" for p in search.TYPED_PREFIXES)} group by style_id")
def typed_prefix_lint(spark, sf_dir):
    return search.typed_prefixes(_cjk_lines(spark, sf_dir), rows(spark, "(values ('List')) as t(style_id)"))


@query(f"""select part || '/' || doc_id as doc_id, para_seq, nth::bigint as nth, hit from (select part, doc_id, para_seq, unnest(h[1:5]) as hit, generate_subscripts(h[1:5], 1) as nth from
  (select *, list_concat(regexp_extract_all(text, '[㐀-䶿一-鿿] +[A-Za-z0-9]'), regexp_extract_all(text, '[A-Za-z0-9] +[㐀-䶿一-鿿]')) as h from {_CJK_LINES}))""")
def pangu_lint(spark, sf_dir):
    return search.cjk_spacing(_cjk_lines(spark, sf_dir))


LENGTHS = "(values ('12'), ('12pt'), ('2.54cm'), ('25.4 mm'), ('1in'), ('x'), ('-3pt')) as t(length)"


@query(f"""with x as (select length, try_cast(regexp_extract(length, '^\\s*(-?[0-9.]+)\\s*(pt|cm|mm|in)?\\s*$', 1) as double) as n, regexp_extract(length, '^\\s*(-?[0-9.]+)\\s*(pt|cm|mm|in)?\\s*$', 2) as u from {LENGTHS})
  select length, round(n * case u when 'cm' then 28.3464566929 when 'mm' then 2.83464566929 when 'in' then 72.0 else 1.0 end * 20)::bigint as twips from x""")
def length_units(spark, sf_dir):
    return rows(spark, LENGTHS).select("length", F.round(counters.points(F.col("length")) * 20).cast("long").alias("twips"))


@query()
def docx_roundtrip(spark, sf_dir):
    """Each conversation written as a package and read back."""
    p = corpus.conversations(spark, sf_dir).where("text is not null")
    return docx.paragraphs(docx.runs(docx.parts(docx.assemble(p))))


FORMULAS = ["<math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mi>y</mi></mfrac></math>", "<math><munderover><mo>∑</mo><mi>i</mi><mi>n</mi></munderover><msup><mi>i</mi><mn>2</mn></msup><mo>=</mo><mi>s</mi></math>", "<math><menclose notation='updiagonalstrike'><mi>x</mi></menclose></math>"]


@query()
def mathml_to_omml(spark, sf_dir):
    out = mathml.omml(F.col("source"))
    return spark.createDataFrame([(s,) for s in FORMULAS], "source string").withColumn("x", out).select("source", "x.omml", "x.error")


def _shredded(spark, sf_dir):
    """Conversations as packages: turns by role (system turns in a style outside the index), then a table and a caption, with a link to the first turn."""
    c = corpus.conversations(spark, sf_dir).where("text is not null")
    style = F.when(F.col("style_id") == "system", "_system").otherwise(F.col("style_id"))
    turn = c.select("doc_id", F.col("para_seq").alias("ord"), F.to_json(F.struct(F.lit("paragraph").alias("type"), style.alias("styleId"), F.col("text").alias("content"))).alias("block"))
    last = c.groupBy("doc_id").agg(F.max("para_seq").alias("ord"))
    tail = [
        {"type": "table", "rows": [["a", "b"], [{"content": "c", "colspan": 2}]]},
        {"type": "caption", "captionId": "Talk", "text": "end", "anchor": "end"},
        {"type": "paragraph", "content": [{"text": "see "}, {"link": "#end", "text": "the end"}, {"refTo": {"type": "anchor", "name": "end"}, "display": "number"}]},
    ]
    more = last.select("doc_id", F.posexplode(F.array(*[F.lit(json.dumps(b)) for b in tail])).alias("i", "block"), "ord").select("doc_id", (F.col("ord") + 1 + F.col("i")).alias("ord"), "block")
    return docx.parts(blocks.write(turn.unionByName(more), {"Talk": {"prefix": "Talk "}}).where("content is not null"))


# The paragraphs that a package holds: its turns, three cells, the caption, the paragraph with the link.
_PACKED = """c as (select conv_id, row_number() over (partition by conv_id order by turn) as k, role, text from conversations where text is not null),
  n as (select conv_id, max(k) as n from c group by conv_id),
  p as (select conv_id::varchar as doc_id, k as para_seq, case role when 'system' then '_system' else role end as style_id, length(text) as chars, false as cell from c
    union all select conv_id::varchar, n + i, null, case i when 4 then 10 when 5 then 4 else 1 end, i <= 3 from n, range(1, 6) as t(i))"""


@query(f"""with {_PACKED} select doc_id, para_seq::int as para_seq, style_id, case when not cell and coalesce(style_id, '') <> '_system' then
  (sum((not cell and coalesce(style_id, '') <> '_system')::int) over (partition by doc_id order by para_seq))::int end as para_index from p""")
def package_paragraph_index(spark, sf_dir):
    return package.indexed(package.blocks(_shredded(spark, sf_dir))).select("doc_id", "para_seq", "style_id", "para_index")


@query("select conv_id::varchar as doc_id, 1 as table_idx, 2::bigint as rows, 2::bigint as cols, 'data' as classification, 'multiColData' as reason from conversations where text is not null group by conv_id")
def package_tables(spark, sf_dir):
    return package.table_kinds(package.blocks(_shredded(spark, sf_dir)))


@query(f"""with {_PACKED} select doc_id, max(para_seq)::int - 1 as para_seq, 'SEQ' as field_type, 'Talk' as target, false as number_only, '1' as result from p group by doc_id
  union all select doc_id, max(para_seq)::int, 'REF', 'end', true, '' from p group by doc_id""")
def package_fields(spark, sf_dir):
    return package.field_details(package.fields(_shredded(spark, sf_dir))).select("doc_id", "para_seq", "field_type", "target", "number_only", "result")


@query(f"""with {_PACKED} select doc_id, count(distinct para_seq) as paragraphs, sum(chars)::bigint + 7 as chars, 7::bigint as linked_chars from p where chars > 0 group by doc_id""")
def package_segments(spark, sf_dir):
    size = F.col("stop") - F.col("start")
    return package.segments(_shredded(spark, sf_dir)).where(size > 0).groupBy("doc_id").agg(F.count_distinct("para_seq").alias("paragraphs"), F.sum(size).alias("chars"), F.coalesce(F.sum(F.when(F.col("region") == "hyperlink", size)), F.lit(0)).alias("linked_chars"))


@query(f"with {_PACKED} select doc_id, (max(para_seq) - i)::int as para_seq, 'field' as reason from p, range(0, 2) as t(i) group by doc_id, i")
def package_blockers(spark, sf_dir):
    return ordered.blockers(package.events(_shredded(spark, sf_dir)))


@query("select conv_id::varchar as doc_id, 0::bigint as problems from conversations where false")
def package_problems(spark, sf_dir):
    """Per package what its checks find; packages without a problem have no row, and those written here have none."""
    p = _shredded(spark, sf_dir)
    rels = package.relationships(p)
    types = package.content_types(p)
    kind = lambda k, name: types.where(f"kind = '{k}'").select("doc_id", F.col("key").alias(name))
    names = p.where("path <> '[Content_Types].xml'").select("doc_id", "path")
    found = [validate.dangling(package.relationship_uses(p), rels), validate.duplicate_ids(rels), validate.content_gaps(names, kind("override", "path"), kind("default", "ext")), package.broken(p)]
    one = lambda d: d.select("doc_id")
    return one(found[0]).unionByName(one(found[1])).unionByName(one(found[2])).unionByName(one(found[3])).groupBy("doc_id").agg(F.count("*").alias("problems"))
