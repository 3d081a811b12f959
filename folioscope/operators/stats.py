"""Word frequencies, corpus totals, Zipf's law and table statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.stem import stem_column
from folioscope.functions.text import frequency_tokens, human_size
from folioscope.operators.numbering import dense_ids
from folioscope.storage import saved


def frequency_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, term) of every frequency token of documents with a text."""
    return docs.where("text is not null and text <> ''").select("doc_id", F.explode(frequency_tokens(F.col("text"), **options)).alias("term"))


def term_freqs(docs: DataFrame, **options) -> DataFrame:
    """(term, cnt) over all documents."""
    return frequency_words(docs, **options).groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


def stem_lines(lines: DataFrame) -> DataFrame:
    """(line, stem) of lines that hold a word each, less a carriage return at the end; an empty line has an empty stem."""
    return lines.select("line", stem_column(F.regexp_replace("line", "\r$", "")).alias("stem"))


def mapped_freqs(freqs: DataFrame, normal_form: Column) -> DataFrame:
    """(stem, cnt) from (term, cnt): ``normal_form`` is taken of distinct terms, not of every token."""
    return freqs.select(normal_form.alias("stem"), "cnt").groupBy("stem").agg(F.sum("cnt").alias("cnt"))


def stem_freqs(docs: DataFrame, **options) -> DataFrame:
    """(stem, cnt); words without Russian letters stay as they are."""
    russian = F.col("term").rlike("[а-яё]")
    return mapped_freqs(term_freqs(docs, **options), F.when(russian, stem_column("term")).otherwise(F.col("term")))


def corpus_stats(docs: DataFrame, **options) -> DataFrame:
    """One row: n_docs, n_bytes, n_kb, n_tokens and avg_len, 0 without tokens. Tokens are summed in their row."""
    found = frequency_tokens(F.col("text"), **options)
    per = docs.where("text is not null and text <> ''").select(
        F.octet_length("text").alias("b"),
        F.size(found).alias("n"),
        F.aggregate(found, F.lit(0).cast("long"), lambda a, t: a + F.length(t)).alias("chars"),
    )
    sums = per.agg(F.count(F.lit(1)).alias("n_docs"), *[F.coalesce(F.sum(a), F.lit(0)).cast("long").alias(b) for a, b in (("b", "n_bytes"), ("n", "n_tokens"), ("chars", "chars"))])
    average = F.when(F.col("n_tokens") > 0, F.col("chars") / F.col("n_tokens")).otherwise(F.lit(0.0))
    return sums.select("n_docs", "n_bytes", (F.col("n_bytes") / 1024).alias("n_kb"), "n_tokens", average.alias("avg_len"))


def per_second(amount: Column, seconds: float) -> Column:
    """An amount a second, 0 where no time passed: the rate of a run that its caller has timed."""
    return amount / F.lit(float(seconds)) if seconds > 0 else F.lit(0.0)


def ranked_freqs(freqs: DataFrame) -> DataFrame:
    """(term, cnt, rank), written once: 1, 2, ... by count downwards and then by term."""
    return dense_ids(saved(freqs.select("term", "cnt"), "freqs"), [F.col("cnt").desc(), F.col("term")], "rank")


def zipf_fit(ranked: DataFrame, top: int = 1000) -> DataFrame:
    """One row: log_c and s of log(cnt) = log_c - s * log(rank) over the first ``top`` ranks, by least squares.

    Where all ranks are the same, s is 1 and log_c what fits it; without rows log_c is 0.
    """
    x, y = F.ln("rank"), F.ln("cnt")
    points = ranked.where((F.col("rank") <= top) & (F.col("cnt") > 0)).select(x.alias("x"), y.alias("y"))
    fit = points.agg(F.count(F.lit(1)).alias("m"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    return fit.select(
        F.coalesce("a", (F.col("sy") + F.col("sx")) / F.col("m"), F.lit(0.0)).alias("log_c"), (-F.coalesce("b", F.lit(-1.0))).alias("s"), F.col("m").alias("fit_points")
    )


def zipf_curve(ranked: DataFrame, top: int = 1000) -> DataFrame:
    """(rank, term, cnt, log_r, log_f, zipf): the points and the fitted line at every rank."""
    fit = F.broadcast(zipf_fit(ranked, top).select("log_c", "s"))  # one row
    return ranked.join(fit).select("rank", "term", "cnt", F.ln("rank").alias("log_r"), F.ln("cnt").alias("log_f"), (F.col("log_c") - F.col("s") * F.ln("rank")).alias("zipf"))


def sample_freqs(docs: DataFrame, max_docs: int) -> DataFrame:
    """(term, cnt) over the first ``max_docs`` documents with a text, by id."""
    first = docs.where("text is not null and text <> ''").orderBy("doc_id").limit(max_docs)
    return term_freqs(first)


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, n_bytes, size) of each table: rows, bytes of text columns, and those for reading."""
    out = None
    for name, df in sorted(tables.items()):
        text = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in df.schema if f.dataType.simpleString() == "string"]
        size = sum(text[1:], text[0]) if text else F.lit(0)
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_bytes")).select(F.lit(name).alias("name"), "n_rows", "n_bytes", human_size(F.col("n_bytes")).alias("size"))
        out = row if out is None else out.unionByName(row)
    return out


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group of ``keys``."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
