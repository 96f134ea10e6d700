"""Benchmark decontamination by winnowing. DataFrame functions only.

Fingerprints are the least hashes of `gram`-word grams in each run of
span - gram + 1 grams, so two texts that share any `span` words share a fingerprint.
Documents with a fingerprint of the test items (a broadcast join where the counted
fingerprints are few, else a shuffled one) are extended: their windows of words are
joined with the items' on the words themselves. Items of fewer than `span` words are
one window each; their lengths, at most span - 1, get grams of that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ascii_lower, checkpoint, maybe_broadcast

#: What separates words, once A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a side that may be broadcast: a fingerprint or id of 8 bytes each.
MOST_BROADCAST = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def fingerprints(span: int, gram: int, short: list[int], column: str = "words") -> Column:
    """Array of the winnowed fingerprints of a column of words, with all grams of the lengths in `short`.

    The hashes are bound to lambda variables, as Catalyst would else compute them anew for each position.
    """
    at = lambda v, n: ", ".join(f"{v}[i - 1 + {j}]" for j in range(n))
    run = span - gram + 1
    least = at("g", run) if run == 1 else f"least({at('g', run)})"
    grams = f"transform(sequence(1, size(h) - {gram - 1}), i -> xxhash64({at('h', gram)}))"
    parts = [f"if(size(h) < {span}, cast(array() as array<bigint>), transform(array({grams}), g -> transform(sequence(1, size(g) - {run - 1}), i -> {least if run > 1 else 'g[i - 1]'}))[0])"]
    for n in short:
        parts.append(f"if(size(h) < {n}, cast(array() as array<bigint>), transform(sequence(1, size(h) - {n - 1}), i -> xxhash64({n}, {at('h', n)})))")
    return F.expr(f"transform(array(transform({column}, w -> xxhash64(w))), h -> array_distinct(concat({', '.join(parts)})))[0]")


def windows(lengths: list[int], column: str = "words") -> Column:
    """Array of (n, at, words) for every window of each length."""
    parts = [f"if(size(ws) < {n}, null, transform(sequence(1, size(ws) - {n - 1}), i -> struct({n} as n, i as at, array_join(slice(ws, i, {n}), ' ') as win)))" for n in lengths]
    return F.expr(f"transform(array({column}), ws -> flatten(filter(array({', '.join(parts)}), x -> x is not null)))[0]")


def contaminated(docs: DataFrame, items: DataFrame, span: int = 10, gram: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, contaminated) per row of docs (doc_id, text); items: item_id, text.

    n_hit: words inside any occurrence of a window: `span` consecutive words of an
    item, or all its words if it has fewer, but some. item_ids: those with a window
    that occurs, sorted as strings. Null and empty texts have no words and hit nothing;
    repeated items share their windows; repeated rows of docs stay. Empty tables: no
    item, no hit. Other columns are ignored.
    """
    bench = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where("size(words) > 0")
    short = sorted(x[0] for x in bench.where(F.size("words") < span).select(F.size("words")).distinct().collect())  # under span values
    item_win = (
        bench.withColumn("w", F.explode(windows([*short, span])))
        .where(F.col("w.n") == F.least(F.size("words"), F.lit(span)))
        .select("item_id", "w.n", "w.win")
        .distinct()
    )
    prints = checkpoint(bench.where(F.size("words") >= span).select(F.explode(fingerprints(span, gram, [])).alias("fp")).unionByName(bench.where(F.size("words") < span).select(F.explode(fingerprints(span, gram, short)).alias("fp"))).distinct())
    d = docs.select("doc_id", words(F.col("text")).alias("words"))
    found = checkpoint(
        d.select("doc_id", F.explode(fingerprints(span, gram, short)).alias("fp"))
        .join(maybe_broadcast(prints, prints.count(), MOST_BROADCAST), "fp", "left_semi")
        .select("doc_id")
        .distinct()
    )
    near = docs.select("doc_id", "text").join(maybe_broadcast(found, found.count(), MOST_BROADCAST), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("words"))
    wins = checkpoint(item_win)
    distinct_wins = wins.select("n", "win").distinct()
    hits = checkpoint(
        near.select("doc_id", F.explode(windows([*short, span])).alias("w"))
        .select("doc_id", "w.n", "w.at", "w.win")
        .join(maybe_broadcast(distinct_wins, wins.count(), MOST_BROADCAST // 8), ["n", "win"])
        .distinct()
    )
    covered = hits.select("doc_id", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    of_items = hits.select("doc_id", "n", "win").distinct().join(wins, ["n", "win"]).select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    none = F.expr("cast(array() as array<string>)")
    return (
        d.select("doc_id", F.size("words").cast("long").alias("n_words"))
        .join(covered, "doc_id", "left")
        .join(of_items, "doc_id", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
            F.coalesce("item_ids", none).alias("item_ids"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )
