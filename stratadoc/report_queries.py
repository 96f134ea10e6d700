"""Queries of what reports are made of, each with the same question in SQL. They join those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import report, rules, search
from .queries import FIELDS, _CHAIN, _EVENTS, _RESOLVED, STYLES, _events, query, rows, styles
from .sources import corpus

_BLANKS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def _lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


@query("select distinct (l_quantity * 100)::bigint as twips, round((l_quantity * 100)::bigint / 56.6929, 1) as mm from lineitem")
def twips_to_mm(spark, sf_dir):
    t = _lines(spark, sf_dir).select((F.col("l_quantity") * 100).cast("long").alias("twips")).distinct()
    return t.select("twips", T.millimetres(F.col("twips")).alias("mm"))


@query(f"""with c as (select conv_id as doc_id, turn as para_seq, trim(regexp_replace(text, '{_BLANKS}', ' ', 'g')) as t from conversations where text is not null)
  select doc_id, para_seq, case when length(para_seq::varchar) < 3 then lpad(para_seq::varchar, 3, '0') else para_seq::varchar end as shown, case when length(t) <= 20 then t else left(t, 20) || '…' end as preview from c""")
def paragraph_previews(spark, sf_dir):
    c = corpus.conversations(spark, sf_dir).where("text is not null")
    return c.select("doc_id", "para_seq", T.pad3(F.col("para_seq")).alias("shown"), T.truncate(F.col("text"), 20).alias("preview"))


_RULE = "case l_returnflag when 'A' then 'exact' when 'R' then 'atLeast' end"


@query(f"""with x as (select distinct (l_quantity * 9)::bigint as line, {_RULE} as rule from lineitem)
  select line, rule, regexp_replace(printf('%.4f', case when rule is null then floor(line / 240 * 100 + 0.5) / 100 else line / 20 end), '\\.?0+$', '') || case rule when 'exact' then 'pt fixed' when 'atLeast' then 'pt atLeast' else '×' end as shown from x""")
def line_spacing_text(spark, sf_dir):
    x = _lines(spark, sf_dir).select((F.col("l_quantity") * 9).cast("long").alias("line"), F.expr(_RULE).alias("rule")).distinct()
    return x.withColumn("shown", T.line_spacing(F.col("line"), F.col("rule")))


@query("""with x as (select distinct l_quantity::bigint as q, l_linenumber % 3 as k from lineitem)
  select q, k::bigint as k, case k when 0 then 'auto:' || (q * 240) when 1 then 'exact:' || (q * 20) else 'atLeast:' || (q * 20) end as mode_value from x""")
def line_spacing_keys(spark, sf_dir):
    x = _lines(spark, sf_dir).select(F.col("l_quantity").cast("long").alias("q"), (F.col("l_linenumber") % 3).cast("long").alias("k")).distinct()
    given = lambda k: F.when(F.col("k") == k, F.col("q"))
    return x.withColumn("mode_value", T.line_spacing_key(given(0), given(1), given(2)))


@query("""with d as (select doc_id, octet_length(encode(coalesce(text, ''))) * (doc_id % 400 + 1) as n from documents)
  select doc_id, n::bigint as n, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', floor(n / 1024 * 10 + 0.5) / 10) else printf('%.2f MB', floor(n / 1048576 * 100 + 0.5) / 100) end as size from d""")
def file_sizes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = (F.octet_length(F.coalesce("text", F.lit(""))) * (F.col("doc_id") % 400 + 1)).cast("long")
    return d.select("doc_id", n.alias("n")).withColumn("size", T.file_size(F.col("n")))


_NAMES = "(values " + ", ".join(f"('{en}', '{zh}')" for en, zh in T.STYLE_NAMES) + ") as t(en, zh)"


@query(f"""with b as (select * from {_NAMES}), n as (select zh as name from b union all select en from b union all select distinct role from conversations)
  select name, coalesce(b.en, name) as canonical from n left join b on b.zh = n.name""")
def canonical_style_names(spark, sf_dir):
    b = rows(spark, _NAMES)
    n = b.select(F.col("zh").alias("name")).union(b.select("en")).union(corpus.conversations(spark, sf_dir).select("style_id").distinct())
    return n.select("name", T.canonical_style_name(F.col("name")).alias("canonical"))


_SIZES = "(values ('小四'), ('初号'), ('五号'), ('三号'), ('none')) as t(name)"


@query("select * from (values ('小四', 12.0::double), ('初号', 42.0), ('五号', 10.5), ('三号', 16.0), ('none', null)) as t(name, pt)")
def chinese_font_sizes(spark, sf_dir):
    return rows(spark, _SIZES).select("name", T.font_size(F.col("name")).alias("pt"))


@query(f"""with recursive {_CHAIN}, {_RESOLVED}, p as (select c.conv_id as doc_id, c.turn as para_seq, r.*, case when c.turn % 4 = 1 then (c.turn % 9)::int end as lvl, starts_with(c.text, 'A') as list from conversations c left join resolved r on r.id = c.role)
  select doc_id, para_seq, coalesce(nullif(concat_ws(' ', font, case when size is not null then regexp_replace(printf('%.4f', size / 2), '\\.?0+$', '') || 'pt' end, case when bold then 'Bold' end, case when color <> 'auto' then '#' || color end,
    upper(align[1]) || align[2:], coalesce('Heading-' || (lvl + 1), case when list then 'List' end)), ''), '(no formatting)') as look from p""")
def look_descriptions(spark, sf_dir):
    from .queries import _formatted

    f = _formatted(spark, sf_dir).withColumn("outline_level", F.when(F.col("para_seq") % 4 == 1, (F.col("para_seq") % 9).cast("int")))
    return f.select("doc_id", "para_seq", T.description({c: F.col(c) for c in f.columns}).alias("look"))


@query(f"""with recursive {_CHAIN}, {_RESOLVED} select id, concat_ws(', ', 'font: "' || font || '"', 'size: ' || regexp_replace(printf('%.4f', size / 2), '\\.?0+$', '') || 'pt', 'bold: ' || bold::varchar, 'color: ' || color) as formats,
    concat_ws(', ', 'font: "' || font || '"', 'size: ' || regexp_replace(printf('%.4f', size / 2), '\\.?0+$', '') || 'pt', case when bold then 'bold: true' end, 'color: ' || color) as on_only from resolved""")
def style_formats_text(spark, sf_dir):
    from .operators import cascade

    r = cascade.resolve(styles(spark), FIELDS)
    none = F.lit(None).cast("boolean")
    f = {"font_ascii": F.col("font"), "font_h_ansi": F.lit(None).cast("string"), "font_east_asia": F.col("font"), "size": F.col("size"), "bold": F.col("bold"), "italic": none, "color": F.col("color")}
    return r.select("id", T.run_properties(f).alias("formats"), T.run_properties(f, on_only=True).alias("on_only"))


_FOOTERS = "(values (1, ' PAGE  \\* ROMAN ', cast(null as varchar(9))), (2, 'page', null), (3, 'DATE', null), (4, 'PAGE', 'lowerRoman'), (5, '', 'decimal')) as t(section, instr, fmt)"


@query("select * from (values (1, 'ROMAN'), (2, 'decimal'), (3, null), (4, 'lowerRoman'), (5, 'decimal')) as t(section, shown)")
def footer_page_formats(spark, sf_dir):
    return rows(spark, _FOOTERS.replace("\\*", "\\\\*")).select("section", T.footer_format(F.col("instr"), F.col("fmt")).alias("shown"))


@query("""with u as (select role as id, count(*) as usage_count from conversations where role is not null group by role)
  select id, usage_count, row_number() over (order by usage_count desc, id) as ord from u""")
def style_order(spark, sf_dir):
    c = corpus.conversations(spark, sf_dir).where("style_id is not null")
    return report.style_order(c.groupBy(F.col("style_id").alias("id")).agg(F.count("*").alias("usage_count")))


_ROUTE = [rules.Pattern("A", "Alpha", True), rules.Pattern(r"[A-Z][a-z]+ed\b", "Past")]


def _routed(spark, sf_dir):
    return rules.route(corpus.conversations(spark, sf_dir).where("text is not null and style_id is not null"), _ROUTE)


@query(r"""with k as (select role as style_id, conv_id, turn from conversations where text is not null and role is not null and not starts_with(text, 'A') and not regexp_matches(text, '^[A-Z][a-z]+ed\b') and trim(text) <> ''),
  g as (select style_id, count(*) as non_empty, min(row(conv_id, turn)) as first, min(conv_id) as first_doc, arg_min(turn, row(conv_id, turn)) as first_seq from k group by style_id)
  select style_id, non_empty, first_doc, first_seq, row_number() over (order by non_empty desc, first_doc, first_seq) as ord from g""")
def keep_order(spark, sf_dir):
    first = F.min(F.struct("doc_id", "para_seq"))
    k = _routed(spark, sf_dir).where("route = 'keep' and trim(text) <> ''").groupBy("style_id").agg(F.count("*").alias("non_empty"), first.alias("f"))
    return report.keep_order(k.select("style_id", "non_empty", F.col("f.doc_id").alias("first_doc"), F.col("f.para_seq").alias("first_seq")))


@query(r"""with r as (select conv_id as doc_id, turn as para_seq, text from conversations where text is not null and role is not null and not starts_with(text, 'A') and regexp_matches(text, '^[A-Z][a-z]+ed\b')),
  o as (select *, row_number() over (order by doc_id, para_seq) as n from r)
  select 'Past' as new_style, count(*) as n, string_agg(case when n <= 3 then text end, '¦' order by n) as samples from o having count(*) > 0""")
def unstripped_by_style(spark, sf_dir):
    return report.unstripped(_routed(spark, sf_dir)).withColumn("samples", F.array_join("samples", "¦"))


_KINDS = {"upper": r"^[A-M]", "rest": r"^[N-Z]", "digit": r"^\d"}


@query(r"""with k as (select lang as style_id, case when regexp_matches(line, '^[A-M]') then 'upper' when regexp_matches(line, '^[N-Z]') then 'rest' when regexp_matches(line, '^\d') then 'digit' end as kind
    from (select lang, unnest(string_split(text, chr(10))) as line from documents)),
  n as (select style_id, kind, count(*) as n from k where kind is not null group by all)
  select style_id, string_agg(kind || ' ' || n, ', ' order by n desc, kind) as breakdown from n group by style_id""")
def scheme_breakdown(spark, sf_dir):
    return report.scheme_breakdown(corpus.document_lines(spark, sf_dir), _KINDS)


@query("""with s as (select conv_id, turn, text, unnest(range(1, length(text) + 1)) as i from conversations where text is not null),
  h as (select conv_id, turn, i - 1 as ch from s where substr(text, i, 2) = 'th')
  select count(*) as hits, count(*) filter (ch // 16 <> (ch + 1) // 16) as cross_run, count(distinct row(conv_id, turn)) as paragraphs, count(distinct (ch // 16) % 3) as regions from h""")
def search_summary(spark, sf_dir):
    """Hits over runs of 16 characters each, in three kinds of places by turns."""
    hits = search.find_literal(corpus.conversations(spark, sf_dir), "th")
    run = F.floor(F.col("ch") / 16)
    return report.search_summary(hits.withColumns({"cross_run": run != F.floor((F.col("ch") + 1) / 16), "region": run % 3}))


@query("""select l_orderkey % 50 as k, case when count(l_n) = 0 then null when count(distinct l_n) > 1 or count(*) > count(l_n) then 'mixed' else min(l_n) end as num_id
  from (select *, case when l_discount > 0.05 and l_orderkey % 50 < 30 then (l_orderkey % 50 % 2 * (l_linenumber % 2))::bigint::varchar when l_orderkey % 50 > 45 then 'x' end as l_n from lineitem) group by all""")
def numbering_consistency(spark, sf_dir):
    k = F.col("l_orderkey") % 50
    num = F.when((F.col("l_discount") > 0.05) & (k < 30), (k % 2 * (F.col("l_linenumber") % 2)).cast("long").cast("string")).when(k > 45, "x")
    return report.one_number(_lines(spark, sf_dir).select(k.alias("k"), num.alias("num_id")), "k")


@query("""with p as (select l_returnflag || l_linestatus as raw_fp, l_orderkey as doc_id, l_linenumber as para_seq, case when l_quantity > 10 then 1 end as bold, case when l_discount > 0.05 then 1 end as color, case when l_tax < 0.05 then 1 end as align from lineitem),
  f as (select raw_fp, arg_min(struct_pack(b := bold, c := color, a := align), row(doc_id, para_seq)) as s from p group by raw_fp)
  select raw_fp, concat_ws(',', case when s.a is not null then 'align' end, case when s.b is not null then 'bold' end, case when s.c is not null then 'color' end) as direct from f""")
def direct_format_presence(spark, sf_dir):
    p = _lines(spark, sf_dir).select(F.concat("l_returnflag", "l_linestatus").alias("raw_fp"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("para_seq"), F.expr("case when l_quantity > 10 then 1 end").alias("bold"), F.expr("case when l_discount > 0.05 then 1 end").alias("color"), F.expr("case when l_tax < 0.05 then 1 end").alias("align"))
    return report.direct_presence(p, ["bold", "color", "align"])


_LEVELS = "(values ('1',0,'%1.',cast(null as varchar(9))),('1',1,'',null),('1',2,'','H2'),('2',0,'',null),('2',1,'',null),('3',4,'x',null)) as t(num_id, level, lvl_text, p_style)"


@query(f"with l as (select * from {_LEVELS}), s as (select * from l where lvl_text <> '' or p_style is not null) select * from s union all select * from l where num_id not in (select num_id from s) and level = (select min(level) from l x where x.num_id = l.num_id)")
def shown_levels(spark, sf_dir):
    return report.shown_levels(rows(spark, _LEVELS))


@query(r"""select doc_id, n::bigint as n, w as text from (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as n from (select doc_id, string_split(text, ' ') as ws from documents where text is not null))
  where regexp_matches(w, '^[\d一二三四五六七八九十百千零０-９.()（）【】［］〔〕\[\]•·○●◆◇■□★☆※\-、，,\s]+$')""")
def number_prefix_runs(spark, sf_dir):
    """Words of a text as its runs."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    runs = d.select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("n", "text"))
    return report.number_runs(runs).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "text")


_WANT = "(values ('user','Figure'),('assistant','Table'),('tool','Table')) as w(style_id, want)"


@query(f"""select c.conv_id as doc_id, c.turn as para_seq, c.role as style_id, case when c.turn % 2 = 0 then 'Figure' else 'Table' end as identifier, want from conversations c join {_WANT} on w.style_id = c.role
  where want <> case when c.turn % 2 = 0 then 'Figure' else 'Table' end""")
def caption_style_mismatch(spark, sf_dir):
    c = corpus.conversations(spark, sf_dir).select("doc_id", "para_seq", "style_id", F.when(F.col("para_seq") % 2 == 0, "Figure").otherwise("Table").alias("identifier"))
    return report.caption_mismatch(c, rows(spark, _WANT)).select("doc_id", "para_seq", "style_id", "identifier", "want")


_CHAPTERS = "(values ('Heading1'),('user'),('Missing'),('Heading2')) as w(style_id)"
_OUTLINE = f"(select id, case when id like 'Heading%' then cast(substr(id, 8) as int) - 1 end as outline_level from {STYLES})"


@query(f"select w.style_id, case when o.id is null then 'unknown' else 'no outline level' end as problem from {_CHAPTERS} left join {_OUTLINE} as o on o.id = w.style_id where outline_level is null")
def chapter_prefix_problems(spark, sf_dir):
    return report.chapter_prefixes(rows(spark, _CHAPTERS), rows(spark, _OUTLINE))


_TARGET = "(values ('Normal'),('user')) as t(id)"


@query(f"""with recursive {_CHAIN}, w as (select * from (values ('Heading2'), ('assistant')) as v(id)), n as (select ancestor as id, bool_or(depth = 0) as asked from chain where style in (select id from w) group by ancestor)
  select * from n where asked or id not in (select id from {_TARGET})""")
def template_closure(spark, sf_dir):
    return report.template_styles(styles(spark), rows(spark, "(values ('Heading2'), ('assistant')) as v(id)"), rows(spark, _TARGET))


@query(f"select role as id from conversations where role is not null union select id from {STYLES}")
def known_styles(spark, sf_dir):
    return report.known_styles(corpus.conversations(spark, sf_dir).where("style_id is not null").select(F.col("style_id").alias("id")), styles(spark))


@query("select distinct l_orderkey as doc_id, l_linenumber as num_id from lineitem except select l_orderkey, l_linenumber from lineitem where l_returnflag = 'N'")
def imported_numbers(spark, sf_dir):
    n = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("num_id"), "l_returnflag")
    return report.imported_numbers(n, n.where("l_returnflag = 'N'"))


@query("select conv_id as doc_id, turn as para_seq from conversations where turn >= 2 except select conv_id, min(turn) from conversations where turn >= 2 group by conv_id")
def merged_away(spark, sf_dir):
    c = corpus.conversations(spark, sf_dir).where("para_seq >= 2")
    return report.merged_away(c, c.groupBy("doc_id").agg(F.min("para_seq").alias("para_seq")))


@query("""with b as (select conv_id as doc_id, turn, case when turn % 3 > 0 then turn end as para_index, case when turn % 3 = 0 then 10 - turn % 7 end as table_idx, turn % 2 as t_row, turn as t_col, 1 as t_para from conversations)
  select doc_id, turn, row_number() over (partition by doc_id order by para_index nulls last, table_idx, t_row, t_col) as ord from b""")
def blocker_order(spark, sf_dir):
    c = corpus.conversations(spark, sf_dir).withColumnRenamed("para_seq", "turn")
    b = c.select("doc_id", "turn", F.expr("case when turn % 3 > 0 then turn end").alias("para_index"), F.expr("case when turn % 3 = 0 then 10 - turn % 7 end").alias("table_idx"), (F.col("turn") % 2).alias("t_row"), F.col("turn").alias("t_col"), F.lit(1).alias("t_para"))
    return report.blocker_order(b).select("doc_id", "turn", "ord")


@query("""with s as (select role as id, min(row(conv_id, turn)) as f, row_number() over (order by min(row(conv_id, turn))) as was from conversations where role is not null group by role)
  select id, was, row_number() over (order by case id when 'system' then 2 when 'assistant' then 1 end nulls last, was) as ord from s""")
def touched_styles_first(spark, sf_dir):
    s = corpus.conversations(spark, sf_dir).where("style_id is not null").groupBy(F.col("style_id").alias("id")).agg(F.min(F.struct("doc_id", "para_seq")).alias("f"))
    return report.touched_first(report.ranked(s, [F.col("f")]).drop("f"), rows(spark, "(values ('assistant', 1), ('system', 2)) as t(id, decl_ord)"))


@query("""with p as (select conv_id as doc_id, turn, text, chr(65 + (length(text) % 5)::int) as raw_fp from conversations where text is not null), l as (select doc_id, raw_fp, min(turn) as label from p where turn % 2 = 1 group by all)
  select doc_id, turn, raw_fp, label from p join l using (doc_id, raw_fp) where turn % 2 = 0""")
def cells_of_a_look(spark, sf_dir):
    """Even turns as data cells, odd ones as body paragraphs; a look is the length of a text by fives."""
    p = corpus.conversations(spark, sf_dir).where("text is not null").select("doc_id", F.col("para_seq").alias("turn"), F.chr(65 + F.length("text") % 5).alias("raw_fp"))
    looks = p.where("turn % 2 = 1").groupBy("doc_id", "raw_fp").agg(F.min("turn").alias("label"))
    return report.same_look(p.where("turn % 2 = 0"), looks).select("doc_id", "turn", "raw_fp", "label")


@query("""with u as (select role as id, count(*) as n from conversations where role is not null group by role), s as (select count(*) as paragraphs, count(distinct conv_id) as documents from conversations)
  select 'styles' as section, row_number() over (order by n desc, id) as ord, id || ': ' || n as line from u
  union all select 'totals', 1, 'documents: ' || documents from s union all select 'totals', 2, 'paragraphs: ' || paragraphs from s""")
def corpus_report(spark, sf_dir):
    c = corpus.conversations(spark, sf_dir)
    used = report.style_order(c.where("style_id is not null").groupBy(F.col("style_id").alias("id")).agg(F.count("*").alias("usage_count")))
    total = c.agg(F.count("*").alias("paragraphs"), F.count_distinct("doc_id").alias("documents"))
    lines = total.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.concat(F.lit(f"{k}: "), F.col(k).cast("string")).alias("line")) for i, k in ((1, "documents"), (2, "paragraphs"))])).alias("x")).select("x.ord", "x.line")
    return report.report([("styles", used.select("ord", F.concat("id", F.lit(": "), F.col("usage_count").cast("string")).alias("line"))), ("totals", lines)])


@query(f"""with recursive {_EVENTS}, t as (select d.*, left(c.text, 3) || event_seq as text from d join conversations c on c.conv_id = d.doc_id and c.turn = d.para_seq)
  select doc_id, para_seq, string_agg(text, '' order by event_seq) as text from t where depth = 0 and text is not null group by all""")
def text_outside_fields(spark, sf_dir):
    c = corpus.conversations(spark, sf_dir).select("doc_id", "para_seq", F.substring("text", 1, 3).alias("t"))
    e = _events(spark, sf_dir).join(c, ["doc_id", "para_seq"])
    return report.outside_fields(e.withColumn("text", F.concat("t", F.col("event_seq").cast("string"))))


@query(f"""with recursive {_CHAIN}, {_RESOLVED} select id, font as "fontLatin", null::varchar as "fontCJK", size / 2 as size, case when bold then true end as bold, null::boolean as italic, nullif(color, 'auto') as color, align as alignment from resolved""")
def style_entries(spark, sf_dir):
    from .operators import cascade

    r = cascade.resolve(styles(spark), FIELDS)
    no = lambda kind: F.lit(None).cast(kind)
    f = {"font_ascii": F.col("font"), "font_h_ansi": no("string"), "font_east_asia": no("string"), "size": F.col("size"), "bold": F.col("bold"), "italic": no("boolean"), "color": F.col("color"), "alignment": F.col("align")}
    return r.select("id", *report.style_entry(f))
