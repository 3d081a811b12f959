"""Ranked search over an index: one predicate over term flags, one sum of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.index import Index
from folioscope.plans.query import Both, Node, Not, Term, all_terms, holds_without_terms, predicate, scoring_terms, tree


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def search(index: Index, query: str, limit: int | None = None) -> DataFrame:
    """(docid, score) of the hits, best first and then by docid.

    Postings are read once, for the query's terms alone. Each document gets a flag for each term and the
    sum of tf * idf of the terms that score; the query is a filter over the flags. Documents
    without any of the terms are looked at only for queries that they can satisfy.
    """
    node = tree(query)
    terms, scoring = all_terms(node), scoring_terms(node)
    hits = index.postings.where(F.col("term").isin(terms) if terms else F.lit(False)).select("term", "docid", "tf")
    # As many rows as the query has terms.
    df = F.broadcast(index.vocab.where(F.col("term").isin(terms) if terms else F.lit(False)).select("term", "df"))
    n_docs = F.broadcast(index.docs.agg(F.count(F.lit(1)).alias("n")))
    weighed = hits.join(df, "term").join(n_docs)
    weight = F.when(F.col("term").isin(scoring) if scoring else F.lit(False), F.col("tf") * idf(F.col("n"), F.col("df")))
    flags = [F.max(F.col("term") == t).alias(f"f{i}") for i, t in enumerate(terms)]
    found = weighed.groupBy("docid").agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("score"), *flags)
    if holds_without_terms(node):
        found = index.docs.select("docid").join(found, "docid", "left")
    flag = lambda t: F.coalesce(F.col(f"f{terms.index(t)}"), F.lit(False))
    out = found.where(predicate(node, flag)).select("docid", F.coalesce("score", F.lit(0.0)).alias("score"))
    ranked = out.orderBy(F.desc("score"), "docid")
    return ranked.limit(limit) if limit is not None else ranked


def search_path(spark: SparkSession, path: str, query: str, limit: int | None = None) -> DataFrame:
    """``search`` over the index written at ``path``, of which only the files with the query's terms are opened."""
    return search(Index.read_terms(spark, path, all_terms(tree(query))), query, limit)


def as_lines(found: DataFrame) -> DataFrame:
    """(line) of a result: docid, tab, and the score with six decimals."""
    return found.select(F.format_string("%d\t%.6f", "docid", "score").alias("line"))


def docs_with(index: Index, term: str) -> DataFrame:
    """(docid) of the documents with a term."""
    return index.postings.where(F.col("term") == term).select("docid")


def hits_by_sets(index: Index, node: Node) -> DataFrame:
    """(docid) of a tree's hits by unions, intersections and differences of sets; for tests of ``search``."""
    if isinstance(node, Term):
        return docs_with(index, node.text).distinct()
    if isinstance(node, Not):
        return index.docs.select("docid").subtract(hits_by_sets(index, node.of))
    left, right = hits_by_sets(index, node.left), hits_by_sets(index, node.right)
    return left.intersect(right) if isinstance(node, Both) else left.union(right).distinct()
