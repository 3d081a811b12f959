"""Breadth-first walk over category edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folioscope.operators.stats import first_of
from folioscope.storage import saved

SUBCATEGORY, PAGE = 14, 0
#: Levels that are walked one by one before chains of categories get shortcuts.
SHALLOW = 12
NODE = ["source", "category"]


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written, and its number of rows, told by the same job."""
    seen = Observation()
    out = saved(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def shortcuts(step: DataFrame) -> DataFrame:
    """(source, category, next, hops) beside ``step`` (source, category, next): where the only way out of a category leads in 2, 4, 8, ... hops.

    A category has one shortcut of each length at most, so they are few; lengths double until chains end or, where they
    are rings, until no way without a ring is longer.
    """
    only, n = counted(step.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("next")).where("n = 1").drop("n"), "chains")
    out, jump, hops = step.withColumn("hops", F.lit(1)), only, 1
    while hops < n:
        onwards = jump.select("source", F.col("category").alias("next"), F.col("next").alias("far"))
        jump, left = counted(jump.join(onwards, ["source", "next"]).select("source", "category", F.col("far").alias("next")), "shortcuts")
        hops *= 2
        if not left:
            break
        out = out.unionByName(jump.withColumn("hops", F.lit(hops)))
    return out


def category_levels(roots: DataFrame, step: DataFrame, max_depth: int | None = None, shallow: int = SHALLOW) -> DataFrame:
    """(source, category, level): the fewest steps (source, category, next) from ``roots`` (source, category) to each category in reach.

    A round takes the categories whose level has just fallen one step further, and is one written table. The first ``shallow`` rounds walk
    level by level; a graph that goes on has chains, and is walked on by shortcuts over them: a chain of n levels takes
    some 2 log n rounds in all, and levels that a shortcut found too high are put right by later rounds.
    """
    front, n = counted(roots.select(*NODE).distinct().withColumn("level", F.lit(0)), "categories")
    seen, ways, done = front, step.select(*NODE, "next").distinct().withColumn("hops", F.lit(1)), 0
    while n:
        if done == shallow:
            ways = saved(shortcuts(saved(ways.drop("hops"), "steps")), "ways")
        met = front.join(ways, NODE).select("source", F.col("next").alias("category"), (F.col("level") + F.col("hops")).alias("level"))
        met = met.where(F.col("level") <= max_depth) if max_depth is not None else met
        met = met.groupBy(*NODE).agg(F.min("level").alias("level"))
        best = seen.groupBy(*NODE).agg(F.min("level").alias("old"))
        front, n = counted(met.join(best, NODE, "left").where("old is null or level < old").drop("old"), "categories")
        seen, done = seen.unionByName(front), done + 1
        if done % 20 == 0:  # many rounds are one table again
            seen = saved(seen.groupBy(*NODE).agg(F.min("level").alias("level")), "categories")
    return seen.groupBy(*NODE).agg(F.min("level").alias("level"))


def category_pages(roots: DataFrame, edges: DataFrame, max_pages: int | None = None, max_depth: int | None = None, shallow: int = SHALLOW) -> DataFrame:
    """(source, pageid, title, level, category): pages reachable from ``roots`` (source, category), each once.

    ``edges`` is (source, parent, ns, child, pageid): 14 marks a sub-category, 0 a page. A page
    belongs to the level that reaches it first and there to the first category by name. Levels are those of
    ``category_levels``, at most ``max_depth`` if given.
    """
    step = edges.where((F.col("ns") == SUBCATEGORY) & (F.col("child") != "")).select("source", F.col("parent").alias("category"), F.col("child").alias("next"))
    seen = category_levels(roots, step, max_depth, shallow)
    pages = edges.where((F.col("ns") == PAGE) & F.col("pageid").isNotNull()).select("source", F.col("parent").alias("category"), "pageid", F.col("child").alias("title"))
    out = first_of(seen.join(pages, ["source", "category"]), ["source", "pageid"], [F.col("level"), F.col("category"), F.col("title")])
    out = out.select("source", "pageid", "title", "level", "category")
    return out.orderBy("level", "source", "category", "pageid").limit(max_pages) if max_pages is not None else out
