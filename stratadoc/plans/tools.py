"""The questions that are asked of packages, as views over their scanned tables.

Each is lazy: only the parts that a view needs are read. `parts` should be a written table
when many views are asked of it, so that packages are unzipped once.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cascade, fingerprint, ordered, search, tables, validate
from ..sources import package

LEVELS = 9
#: The formats that a style can give to a paragraph.
FORMATS = [c for c in package.LOOK if not c.endswith("_theme") and c != "color_theme"]


class Packages:
    """The tables of a corpus of packages (doc_id, path, content)."""

    def __init__(self, parts: DataFrame):
        self.parts = parts

    @cached_property
    def paragraphs(self) -> DataFrame:
        return ordered.sections(package.indexed(package.blocks(self.parts)))

    @cached_property
    def runs(self) -> DataFrame:
        return package.segments(self.parts)

    @cached_property
    def styles(self) -> DataFrame:
        return package.with_theme(package.styles(self.parts), package.theme(self.parts))

    @cached_property
    def resolved_styles(self) -> DataFrame:
        """(doc_id, id, formats): each style through its ancestors, then the document's defaults."""
        own = cascade.resolve(self.styles, FORMATS, by=["doc_id"])
        base = self.styles.where("id is null").select("doc_id", *[F.col(f).alias(f"_{f}") for f in FORMATS])
        return own.join(base, "doc_id", "left").select("doc_id", "id", *[F.coalesce(f, f"_{f}").alias(f) for f in FORMATS])

    @cached_property
    def default_styles(self) -> DataFrame:
        """(doc_id, default_style): the default paragraph style, else Normal where there is one."""
        p = self.styles.where("type = 'paragraph' and id is not null")
        return p.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("is_default"), F.col("id"))), F.max(F.when(F.col("id") == "Normal", F.col("id")))).alias("default_style"))

    @cached_property
    def numbering(self) -> DataFrame:
        """(doc_id, num_id, level, num_fmt, lvl_text, start, is_lgl, p_style): the levels of each numbering id; its own start beats the shared one, 1 without either."""
        ids, levels = package.numbering_ids(self.parts), package.numbering_levels(self.parts)
        start = F.coalesce(F.col("overrides")[F.col("level")], F.col("start"), F.lit(1))
        return ids.join(levels, ["doc_id", "abstract_id"]).select("doc_id", "num_id", "level", "num_fmt", "lvl_text", start.alias("start"), "is_lgl", "p_style", "suff")

    def looks(self) -> DataFrame:
        """Indexed paragraphs that are not empty, with the formats they end up with (direct ones, those of the run with most text, its character style's, then the paragraph style's) and raw_fp."""
        longest = self.runs.where("region = 'body'").groupBy("doc_id", "para_seq").agg(F.max_by(F.struct("run_style", *[f for f in FORMATS if f in dict(self.runs.dtypes)]), F.struct(F.length("text"), F.col("run_idx"))).alias("run"))
        p = self.paragraphs.where("para_index is not null and trim(text) <> ''").join(self.default_styles, "doc_id", "left")
        known = self.styles.where("id is not null").select("doc_id", F.col("id").alias("style_id"), F.lit(True).alias("known")).distinct()
        p = p.join(known, ["doc_id", "style_id"], "left").withColumn("look_id", F.when(F.col("known"), F.col("style_id")).otherwise(F.col("default_style")))
        style = self.resolved_styles.select("doc_id", F.col("id").alias("look_id"), F.struct(*FORMATS).alias("style"))
        of_run = dict(self.runs.dtypes)
        own = [f for f in FORMATS if f in of_run]
        # a character style without the document's defaults, which the paragraph's style comes before
        char = cascade.resolve(self.styles.where("type = 'character' and id is not null"), own, by=["doc_id"]).select("doc_id", F.col("id").alias("run_style"), F.struct(*own).alias("char"))
        r = p.join(longest, ["doc_id", "para_seq"], "left").withColumn("run_style", F.col("run.run_style")).join(char, ["doc_id", "run_style"], "left").join(style, ["doc_id", "look_id"], "left")
        r = r.select("doc_id", "para_seq", "para_index", F.col("look_id").alias("style_id"), "text", "section_index", *[F.coalesce(*([F.col(f"run.{f}"), F.col(f"char.{f}")] if f in of_run else [F.col(f)]), F.col(f"style.{f}")).alias(f) for f in FORMATS])
        return r.withColumn("raw_fp", fingerprint.raw(r))

    def fingerprints(self) -> DataFrame:
        """A row per document and look, with its label."""
        return fingerprint.summary(self.looks(), by=["doc_id"])

    def bindings(self) -> DataFrame:
        """(doc_id, para_seq, num_id, level): direct numbering, else that of the named style; none for id 0."""
        style = self.resolved_styles.select("doc_id", F.col("id").alias("style_id"), F.col("num_id").alias("s_num"), F.col("num_level").alias("s_level"))
        r = self.paragraphs.join(style, ["doc_id", "style_id"], "left")
        level = F.when(F.col("num_id").isNotNull(), F.col("num_level")).otherwise(F.coalesce("s_level", F.lit(0)))
        return r.select("doc_id", "para_seq", F.coalesce("num_id", "s_num").alias("num_id"), level.alias("level")).where("num_id is not null and num_id <> '0'")

    def labels(self) -> DataFrame:
        """(doc_id, para_seq, num_id, level, label): the numbers that paragraphs show."""
        by_level = [F.max(F.when(F.col("level") == k, F.struct("num_fmt", "start", "lvl_text", "is_lgl"))).alias(f"l{k}") for k in range(LEVELS)]
        wide = self.numbering.groupBy("doc_id", "num_id").agg(*by_level)
        r = self.bindings().join(wide, ["doc_id", "num_id"])
        here = lambda f: F.coalesce(*[F.when(F.col("level") == k, F.col(f"l{k}.{f}")) for k in range(LEVELS)])
        r = r.withColumns({f"start_{k}": F.coalesce(F.col(f"l{k}.start"), F.lit(1)) for k in range(LEVELS)} | {"pattern": here("lvl_text"), "legal": here("is_lgl"), "fmt": here("num_fmt")})
        r = ordered.numbering_counters(r.where("pattern is not null"), LEVELS)
        formats = [F.coalesce(F.col(f"l{k}.num_fmt"), F.lit("decimal")) for k in range(LEVELS)]
        shown = ordered.level_text(F.col("pattern"), formats, F.col("legal"), LEVELS)
        return r.select("doc_id", "para_seq", "num_id", "level", F.when(F.col("fmt").isin("bullet", "none"), F.col("pattern")).otherwise(shown).alias("label"))

    def captions(self) -> DataFrame:
        """(doc_id, para_seq, identifier, seq_format, number, text, cited): paragraphs with a sequence field, and how many references point at their bookmarks."""
        f = package.field_details(package.fields(self.parts))
        cited = f.where("field_type = 'REF'").groupBy("doc_id", F.col("target").alias("name")).agg(F.count("*").alias("refs"))
        marks = package.bookmarks(self.parts).join(cited, ["doc_id", "name"]).groupBy("doc_id", "para_seq").agg(F.sum("refs").alias("refs"))
        seq = f.where("field_type = 'SEQ' and reset_to is null").select("doc_id", "para_seq", F.col("target").alias("identifier"), "seq_format", F.col("result").alias("number"))
        return seq.join(self.paragraphs.select("doc_id", "para_seq", "text"), ["doc_id", "para_seq"]).join(marks, ["doc_id", "para_seq"], "left").select("doc_id", "para_seq", "identifier", "seq_format", "number", "text", F.coalesce("refs", F.lit(0)).alias("cited"))

    def overview(self) -> DataFrame:
        """One row per document: counts of its paragraphs, tables, sections, styles in use, looks, captions and numbered paragraphs."""
        p = self.paragraphs.groupBy("doc_id").agg(
            F.count("*").alias("paragraphs"), F.count("para_index").alias("indexed"), F.count_distinct("table_idx").alias("tables"), F.max("section_index").alias("sections"),
            F.count_distinct("style_id").alias("styles_used"), F.count_if("has_drawing").alias("with_drawing"), F.count_if("has_math").alias("with_math"), F.count_if(F.trim("full_text") == "").alias("empty"),
        )
        more = {"looks": self.fingerprints(), "captions": self.captions(), "numbered": self.labels(), "blocked": self.blockers()}
        for name, d in more.items():
            p = p.join(d.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
        return p.fillna(0, list(more))

    def unused_styles(self) -> DataFrame:
        """(doc_id, id, name): paragraph styles that no paragraph names, the default one left out."""
        used = self.paragraphs.select("doc_id", F.col("style_id").alias("id")).distinct()
        return self.styles.where("id is not null and type = 'paragraph' and not is_default").join(used, ["doc_id", "id"], "left_anti").select("doc_id", "id", "name")

    def in_range(self, first: int, last: int) -> DataFrame:
        return self.paragraphs.where(F.col("para_index").between(first, last))

    def around(self, index: int, radius: int = 4) -> DataFrame:
        """The paragraphs up to `radius` places from the one with that index, those without an index too."""
        at = self.paragraphs.where(F.col("para_index") == index).select("doc_id", F.col("para_seq").alias("_at"))
        return self.paragraphs.join(at, "doc_id").where(F.abs(F.col("para_seq") - F.col("_at")) <= radius).drop("_at")

    def cell(self, table: int, row: int, col: int) -> DataFrame:
        return self.paragraphs.where((F.col("table_idx") == table) & (F.col("t_row") == row) & (F.col("t_col") == col))

    def tables(self) -> DataFrame:
        return package.table_kinds(self.paragraphs)

    def sections(self) -> DataFrame:
        return tables.paper(package.sections(self.parts))

    def section_changes(self) -> DataFrame:
        return ordered.section_changes(package.sections(self.parts), ["width", "height", "orientation", "margin_top", "margin_bottom", "margin_left", "margin_right", "number_format", "title_page"])

    def style_definitions(self) -> DataFrame:
        """(doc_id, id, name, based_on, formats, numbered_by): resolved styles; the numbering is their own, else the first level that names them."""
        linked = self.numbering.where("p_style is not null").groupBy("doc_id", F.col("p_style").alias("id")).agg(F.min(F.struct(F.col("num_id").cast("int"), "num_id")).alias("x")).select("doc_id", "id", F.col("x.num_id").alias("linked"))
        names = self.styles.where("id is not null").select("doc_id", "id", "name", "type", "based_on")
        return names.join(self.resolved_styles, ["doc_id", "id"]).join(linked, ["doc_id", "id"], "left").withColumn("numbered_by", F.coalesce("num_id", "linked")).drop("linked")

    def run_diversity(self) -> DataFrame:
        return fingerprint.diversity(self.runs, ["font_ascii", "font_east_asia", "size", "bold", "italic", "underline", "color", "highlight"])

    def blockers(self) -> DataFrame:
        return ordered.blockers(package.events(self.parts))

    def find_paragraphs(self, pattern: str, limit: int | None = 50) -> DataFrame:
        return search.find_paragraphs(self.paragraphs.where("para_index is not null"), pattern, limit)

    def find_text(self, needle: str, context: int = 25) -> DataFrame:
        """(doc_id, para_seq, ch, len, matched, context, first_run, last_run, cross_run, region) in the full texts."""
        hits = search.find_literal(self.paragraphs.select("doc_id", "para_seq", F.col("full_text").alias("text")), needle, context)
        segs = self.runs.select("doc_id", "para_seq", F.col("run_idx").alias("run_index"), "start", F.col("stop").alias("end"), "region")
        return hits.join(search.overlaps(hits, segs), ["doc_id", "para_seq", "ch"])

    def migrate_captions(self) -> DataFrame:
        """Typed captions that have no sequence field yet."""
        return search.caption_candidates(self.paragraphs.join(self.captions().select("doc_id", "para_seq"), ["doc_id", "para_seq"], "left_anti"))

    def heading_skips(self) -> DataFrame:
        """Headings more than one level under the one before, by the outline levels that paragraphs end up with."""
        style = self.resolved_styles.select("doc_id", F.col("id").alias("style_id"), F.col("outline_level").alias("s_level"))
        r = self.paragraphs.join(style, ["doc_id", "style_id"], "left").select("doc_id", "para_seq", (F.coalesce("outline_level", "s_level") + 1).alias("level"))
        return ordered.skipped_levels(r.where("level between 1 and 9"))

    def validate(self) -> DataFrame:
        """(doc_id, part, message): all that the package checks find."""
        rels, types = package.relationships(self.parts), package.content_types(self.parts)
        names = self.parts.select(F.col("doc_id").cast("string").alias("doc_id"), "path")
        kind = lambda k, name: types.where(F.col("kind") == k).select("doc_id", F.col("key").alias(name))
        say = lambda d, part, *words: d.select("doc_id", part.alias("part"), F.concat(*words).alias("message"))
        lit, col = F.lit, F.col
        numbers = self.bindings().select("doc_id", "num_id").distinct()
        found: list[tuple[DataFrame, Column, list[Column]]] = [
            (validate.dangling(package.relationship_uses(self.parts), rels), col("part"), [lit("no relationship "), col("rid")]),
            (validate.duplicate_ids(rels), col("part"), [lit("relationship "), col("rid"), lit(" more than once")]),
            (rels.where("not external").select("doc_id", "part", col("target").alias("path")).join(names, ["doc_id", "path"], "left_anti"), col("part"), [lit("no such part: "), col("path")]),
            (validate.content_gaps(names.where("path <> '[Content_Types].xml'"), kind("override", "path"), kind("default", "ext")), col("path"), [col("problem")]),
            (validate.levels_without_type(package.numbering_levels(self.parts)), lit(package.NUMBERING), [lit("abstract numbering "), col("abstract_id"), lit(" has levels and no type")]),
            (validate.unknown_references(numbers, package.numbering_ids(self.parts).select("doc_id", "num_id").distinct(), "num_id"), lit(package.DOCUMENT), [lit("no numbering "), col("num_id")]),
        ]
        return reduce(DataFrame.unionByName, [package.broken(self.parts), *[say(d, part, *words) for d, part, words in found]])
