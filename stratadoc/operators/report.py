"""What reports are made of: orders, tallies, sets and checks over paragraphs and styles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import cascade, ordered


def ranked(rows: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "ord") -> DataFrame:
    """Rows with their place, from 1, in an order whose last key is unique; by: one order for each of these keys."""
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)  # without `by`: a report's few rows
    return rows.withColumn(name, F.row_number().over(w).cast("long"))


def style_order(usage: DataFrame) -> DataFrame:
    """Styles (id, usage_count) by falling use, then id."""
    return ranked(usage, [F.desc("usage_count"), F.col("id")])


def keep_order(kept: DataFrame) -> DataFrame:
    """Kept groups (style_id, non_empty, first_doc, first_seq) by falling number, then first place."""
    return ranked(kept, [F.desc("non_empty"), F.col("first_doc"), F.col("first_seq")])


def blocker_order(blockers: DataFrame) -> DataFrame:
    """Blocked paragraphs of each document: those with an index by it, then those of cells by their place."""
    return ranked(blockers, [F.col("para_index").asc_nulls_last(), *[F.col(c) for c in ("table_idx", "t_row", "t_col", "t_para")]], ["doc_id"])


def touched_first(styles: DataFrame, declared: DataFrame) -> DataFrame:
    """Styles (id, ord) with the declared (id, decl_ord) in front, in the order of their declaration; the rest as they were."""
    r = styles.join(declared, "id", "left")
    return ranked(r.withColumnRenamed("ord", "was"), [F.col("decl_ord").asc_nulls_last(), F.col("was")]).drop("decl_ord")


def scheme_breakdown(paragraphs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(style_id, breakdown): the kinds of typed numbers of a style with their counts, the most frequent first."""
    kind = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in kinds.items()])
    n = paragraphs.select("style_id", kind.alias("kind")).where("kind is not null").groupBy("style_id", "kind").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind")))
    return n.groupBy("style_id").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["kind"], F.lit(" "), (-x["n"]).cast("string"))), ", ").alias("breakdown"))


def unstripped(routed: DataFrame, most: int = 3) -> DataFrame:
    """(new_style, n, samples): paragraphs that a pattern took and left as they were, with the first few texts. Samples are cut in each task before they meet."""
    r = routed.where("rule is not null and new_text = text")
    n = r.groupBy("new_style").agg(F.count("*").alias("n"))
    first = ranked(r.select("new_style", "doc_id", "para_seq", "text"), [F.col("doc_id"), F.col("para_seq")], ["new_style"]).where(F.col("ord") <= most)
    return n.join(first.groupBy("new_style").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("samples")), "new_style")


def search_summary(hits: DataFrame) -> DataFrame:
    """(hits, cross_run, paragraphs, regions) of hits (doc_id, para_seq, cross_run, region)."""
    return hits.agg(F.count("*").alias("hits"), F.count_if("cross_run").alias("cross_run"), F.count_distinct("doc_id", "para_seq").alias("paragraphs"), F.count_distinct("region").alias("regions"))


def one_number(rows: DataFrame, by: str) -> DataFrame:
    """(by, num_id): the numbering id that all have; mixed where they differ or some have none; null where none has."""
    many = F.min("num_id") != F.max("num_id")
    unset = F.count_if(F.col("num_id").isNull()) > 0
    return rows.groupBy(by).agg(F.when(F.min("num_id").isNull(), F.lit(None)).when(many | unset, "mixed").otherwise(F.min("num_id")).alias("num_id"))


def direct_presence(paragraphs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(raw_fp, direct): the direct formats of each look's first paragraph, by name."""
    first = F.min_by(F.struct(*fields), F.struct("doc_id", "para_seq"))
    named = F.array_compact(F.array(*[F.when(F.col(f"first.{f}").isNotNull(), F.lit(f)) for f in fields]))
    return paragraphs.groupBy("raw_fp").agg(first.alias("first")).select("raw_fp", F.array_join(F.array_sort(named), ",").alias("direct"))


def same_look(cells: DataFrame, looks: DataFrame) -> DataFrame:
    """Data cells (doc_id, raw_fp) with the label of the look that body paragraphs of their document have."""
    return cells.join(looks.select("doc_id", "raw_fp", "label"), ["doc_id", "raw_fp"])


def caption_mismatch(captions: DataFrame, declared: DataFrame) -> DataFrame:
    """Captions (style_id, identifier) whose style is declared (style_id, want) for another identifier."""
    return captions.join(declared, "style_id").where("identifier <> want")


def chapter_prefixes(wanted: DataFrame, styles: DataFrame) -> DataFrame:
    """(style_id, problem): chapter styles that are unknown, or have no outline level and would show 0."""
    r = wanted.join(styles.select(F.col("id").alias("style_id"), F.lit(True).alias("known"), "outline_level"), "style_id", "left")
    return r.select("style_id", F.when(F.col("known").isNull(), "unknown").when(F.col("outline_level").isNull(), "no outline level").alias("problem")).where("problem is not null")


def template_styles(template: DataFrame, wanted: DataFrame, target: DataFrame) -> DataFrame:
    """(id, asked): styles to bring from a template: those wanted (id), and all their ancestors that the target (id) lacks."""
    chain = cascade.closure(template).join(wanted.select(F.col("id").alias("style")), "style").select(F.col("ancestor").alias("id"), (F.col("depth") == 0).alias("asked"))
    need = chain.groupBy("id").agg(F.max("asked").alias("asked"))
    return need.where("asked").unionByName(need.where("not asked").join(target.select("id"), "id", "left_anti"))


def known_styles(declared: DataFrame, existing: DataFrame) -> DataFrame:
    return declared.select("id").union(existing.select("id")).distinct()


def imported_numbers(now: DataFrame, before: DataFrame) -> DataFrame:
    """(doc_id, num_id): numbering ids that were not there before."""
    return now.select("doc_id", "num_id").distinct().join(before.select("doc_id", "num_id"), ["doc_id", "num_id"], "left_anti")


def merged_away(touched: DataFrame, survivors: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, para_seq) that a merge takes up into others."""
    return touched.select("doc_id", "para_seq").distinct().join(survivors.select("doc_id", "para_seq"), ["doc_id", "para_seq"], "left_anti")


def shown_levels(levels: DataFrame) -> DataFrame:
    """Levels (num_id, level, lvl_text, p_style) that say something; the first alone where none does."""
    says = (F.col("lvl_text") != "") | F.col("p_style").isNotNull()
    r = levels.withColumns({"says": says, "any": F.max(says).over(Window.partitionBy("num_id")), "first": F.min("level").over(Window.partitionBy("num_id"))})
    return r.where("says or (not any and level = first)").drop("says", "any", "first")


def number_runs(runs: DataFrame) -> DataFrame:
    """Runs whose text is a typed number or bullet and nothing else."""
    return runs.where(F.col("text").rlike(T.NUMBER_RUN))


def report(sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """(section, ord, line): the lines (ord, line) of a report's sections, in one table."""
    parts = [d.select(F.lit(name).alias("section"), F.col("ord").cast("long").alias("ord"), "line") for name, d in sections]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def outside_fields(events: DataFrame) -> DataFrame:
    """(doc_id, para_seq, text): each paragraph's text without what stands inside its fields, from events (doc_id, event_seq, para_seq, kind, text)."""
    open_ = ordered.field_depth(events).where((F.col("depth") == 0) & F.col("text").isNotNull())
    parts = F.array_sort(F.collect_list(F.struct("event_seq", "text")))
    return open_.groupBy("doc_id", "para_seq").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def style_entry(f: dict[str, Column]) -> list[Column]:
    """A style's formats as the fields of a configuration entry: points, one Latin font, and marks only where they are on."""
    return [
        F.coalesce(f["font_ascii"], f["font_h_ansi"]).alias("fontLatin"),
        f["font_east_asia"].alias("fontCJK"),
        (f["size"] / 2).alias("size"),
        *[F.when(f[k], F.lit(True)).alias(k) for k in ("bold", "italic")],
        F.when(f["color"] != "auto", f["color"]).alias("color"),
        f["alignment"].alias("alignment"),
    ]
