"""The registered queries over the standard tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import stem
from folioscope.functions.text import LOWER, SEARCH, UPPER, Tokenizer, date_of, frequency_tokens, vbyte_length
from folioscope.functions.urls import normalize_url, seed_url
from folioscope.operators import corpus, crawl, graph, index, lemmas, search, stats
from folioscope.plans.query import all_terms, tree
from folioscope.sources import download, footers, store
from folioscope.sources.files import parse_freqs
from folioscope.storage import saved, spread, work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW, INTERVAL = 1_700_000_000, 604_800


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text"))


def lines_of(spark: SparkSession, d: str) -> DataFrame:
    return corpus.corpus_lines(corpus.prepare_corpus(documents(spark, d)))


def numbered_of(spark: SparkSession, d: str) -> DataFrame:
    return corpus.numbered_lines(lines_of(spark, d))


def postings_of(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(numbered_of(spark, d))


CHARS = "0-9A-Za-z\\x{0400}-\\x{052F}"
TOK, TOK_NOJOIN = f"[{CHARS}]+(?:[-_][{CHARS}]+)*", f"[{CHARS}]+"
FREQ = "[A-Za-zА-Яа-яЁё0-9]+(?:-[A-Za-zА-Яа-яЁё0-9]+)*"
FOLDED = f"translate(line, '{UPPER}ё', '{LOWER[:-1]}ее')"
LINES = r"""
WITH prep AS (SELECT doc_id, replace(text, chr(10), ' ') AS line FROM documents WHERE text IS NOT NULL AND text <> ''),
li AS (SELECT doc_id, replace(line, chr(13), '') AS line FROM prep WHERE trim(replace(line, chr(13), ''), ' ' || chr(9)) <> ''),
ln AS (SELECT row_number() OVER (ORDER BY doc_id) AS docid, doc_id, line FROM li)"""
BASE = f"""{LINES},
arr AS (SELECT docid, regexp_extract_all({FOLDED}, '{TOK}') AS a FROM ln),
tk AS (SELECT docid, unnest(a) AS term, generate_subscripts(a, 1) - 1 AS pos FROM arr),
po AS (SELECT term, docid, count(*) AS tf FROM tk GROUP BY term, docid),
vo AS (SELECT term, count(*) AS df FROM po GROUP BY term),
nn AS (SELECT count(*) AS n FROM ln)"""
FREQS = f"""
WITH fq AS (SELECT doc_id, unnest(regexp_extract_all(text, '{FREQ}')) AS t FROM documents WHERE text IS NOT NULL AND text <> ''),
ft AS (SELECT doc_id, unnest(string_split(replace(lower(t), 'ё', 'е'), '-')) AS term FROM fq),
fr AS (SELECT term, count(*) AS cnt FROM ft GROUP BY term),
rk AS (SELECT term, cnt, row_number() OVER (ORDER BY cnt DESC, term) AS rank FROM fr)"""
VBYTE = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"


# --- corpus ---------------------------------------------------------------------------------


@query("corpus_scan", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''")
def corpus_scan(spark, d):
    return read(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", "text")


@query("prepare_corpus", LINES + " SELECT doc_id, line FROM prep")
def prepare_corpus(spark, d):
    return corpus.prepare_corpus(read(spark, d, "documents"))


@query("corpus_lines", LINES + " SELECT docid, line FROM ln")
def corpus_lines(spark, d):
    return numbered_of(spark, d).select("docid", "line")


@query("min_text_filter", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) >= 300")
def min_text_filter(spark, d):
    return corpus.min_text(read(spark, d, "documents")).select("doc_id", F.length("text").cast("long").alias("n"))


TITLE_SQL = (
    LINES
    + r""",
t1 AS (SELECT docid, ltrim(line, ' ' || chr(9)) AS s FROM ln),
t2 AS (SELECT docid, starts_with(s, '=') AS m, CASE WHEN starts_with(s, '=') THEN ltrim(ltrim(s, '='), ' ') ELSE s END AS r FROM t1),
t3 AS (SELECT docid, r, m AND strpos(r, '=') > 1 AS c FROM t2),
t4 AS (SELECT docid, c, hex(encode(CASE WHEN c THEN split_part(r, '=', 1) ELSE split_part(r, '==', 1) END)) AS h FROM t3)
SELECT docid, CASE WHEN c OR length(h) >= 6 THEN substr(h, 1, 240) ELSE hex(encode('doc_' || docid)) END AS title, '' AS url FROM t4"""
)


@query("docs_table", TITLE_SQL)
def docs_table(spark, d):
    return corpus.docs_table(numbered_of(spark, d)).select("docid", F.hex("title").alias("title"), "url")


@query("docs_count", LINES + " SELECT count(*) AS n FROM ln")
def docs_count(spark, d):
    return lines_of(spark, d).agg(F.count(F.lit(1)).alias("n"))


# --- tokens and index -----------------------------------------------------------------------


@query("tokens", BASE + " SELECT docid, pos, term FROM tk")
def tokens(spark, d):
    return index.tokens(numbered_of(spark, d)).select("docid", F.col("pos").cast("long").alias("pos"), "term")


@query("tokens_nojoin", f"{LINES} SELECT docid, CAST(len(regexp_extract_all({FOLDED}, '{TOK_NOJOIN}')) AS BIGINT) AS n FROM ln")
def tokens_nojoin(spark, d):
    n = F.size(Tokenizer(keep_joiners=False).tokens(F.col("line"))).cast("long")
    return numbered_of(spark, d).select("docid", n.alias("n"))


@query("token_stream", BASE + " SELECT term FROM tk")
def token_stream(spark, d):
    return lines_of(spark, d).select(F.explode(SEARCH.tokens(F.col("line"))).alias("term"))


@query("postings", BASE + ", pp AS (SELECT term, docid, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM tk GROUP BY term, docid) SELECT * FROM pp")
def postings(spark, d):
    return postings_of(spark, d).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("vocab", BASE + " SELECT term, df FROM vo")
def vocab(spark, d):
    return index.lexicon(lines_of(spark, d))


@query("idf", BASE + " SELECT term, df, round(ln((n + 1) / (df + 1.0::DOUBLE)) + 1, 6) AS idf FROM vo, nn")
def idf(spark, d):
    lines = lines_of(spark, d)
    n = F.broadcast(lines.agg(F.count(F.lit(1)).alias("n")))  # one row
    return index.lexicon(lines).join(n).select("term", "df", F.round(search.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("posting_lookup", BASE + " SELECT term, docid, tf FROM po WHERE term IN ('the', 'between', 'der')")
def posting_lookup(spark, d):
    return index.Index.of_terms(lines_of(spark, d), ["the", "between", "der"]).postings.select("term", "docid", "tf")


@query("lexicon_lookup", BASE + ", q(term) AS (VALUES ('the'), ('der'), ('nosuchterm')) SELECT q.term, coalesce(df, 0) AS df FROM q LEFT JOIN vo USING (term)")
def lexicon_lookup(spark, d):
    terms = ["the", "der", "nosuchterm"]
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    found = index.lexicon(lines_of(spark, d), terms)
    return asked.join(found, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


GAPS = "docid - coalesce(lag(docid) OVER (PARTITION BY term ORDER BY docid), 0)"


@query("posting_gaps", f"{BASE} SELECT term, docid, {GAPS} AS gap FROM po")
def posting_gaps(spark, d):
    return index.line_gaps(numbered_of(spark, d))


@query("position_gaps", BASE + " SELECT term, docid, pos, pos - coalesce(lag(pos) OVER (PARTITION BY term, docid ORDER BY pos), 0) AS gap FROM tk")
def position_gaps(spark, d):
    return index.line_position_gaps(numbered_of(spark, d))


OFFSETS = f""",
pg AS (SELECT term, docid, pos - coalesce(lag(pos) OVER (PARTITION BY term, docid ORDER BY pos), 0) AS g FROM tk),
pb AS (SELECT term, docid, sum({VBYTE.format("g")}) AS b FROM pg GROUP BY term, docid),
dg AS (SELECT term, docid, tf, {GAPS} AS g FROM po),
tb AS (SELECT dg.term, count(*) AS df, sum(pb.b + {VBYTE.format("dg.g")} + {VBYTE.format("dg.tf")}) AS b FROM dg JOIN pb USING (term, docid) GROUP BY dg.term),
tt AS (SELECT term, df, CAST(b + {VBYTE.format("df")} AS BIGINT) AS bytes FROM tb)"""


@query("vocab_offsets", f"{BASE}{OFFSETS} SELECT term, df, bytes, CAST(coalesce(sum(bytes) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM tt")
def vocab_offsets(spark, d):
    return index.line_offsets(numbered_of(spark, d))


NUMBER = "(coalesce(n_chars, 0) << CAST(doc_id % 18 AS INT)) & 4294967295"


@query("vbyte_len", f"SELECT doc_id, {NUMBER} AS value, CAST({VBYTE.format(f'({NUMBER})')} AS BIGINT) AS nbytes FROM documents")
def vbyte_len(spark, d):
    """Numbers of all sizes up to 32 bits, made of the documents' lengths."""
    value = F.expr("shiftleft(coalesce(n_chars, 0), CAST(doc_id % 18 AS INT)) & 4294967295")
    return read(spark, d, "documents").select("doc_id", value.alias("value")).withColumn("nbytes", vbyte_length(F.col("value")))


@query("token_caps", BASE + " SELECT docid, pos, rtrim(substr(term, 1, 5), '-_') AS term FROM tk")
def token_caps(spark, d):
    """Tokens of five bytes at most."""
    return index.tokens(numbered_of(spark, d), Tokenizer(max_bytes=5)).select("docid", F.col("pos").cast("long").alias("pos"), "term")


@query("token_stems", BASE + " SELECT docid, pos, term AS stem FROM tk")
def token_stems(spark, d):
    """The tables have no Russian words, and others are their own stem; ``stem_golden`` has Russian letters."""
    return index.token_stems(numbered_of(spark, d)).select("docid", F.col("pos").cast("long").alias("pos"), "stem")


# --- search ---------------------------------------------------------------------------------


def found(text: str, limit: int | None = None) -> Query:
    def run(spark, d):
        lines = lines_of(spark, d)
        out = search.search(index.Index.of_terms(lines, all_terms(tree(text))), text, limit)
        return out.select("docid", F.round("score", 6).alias("score"))

    return run


def found_in(name: str, where: str, scoring: list[str]) -> tuple[str, str]:
    """The scores' table, and the rows found, of one search over the tables of ``BASE``."""
    terms = ", ".join(f"'{t}'" for t in scoring) or "NULL"
    has = "(SELECT docid FROM po WHERE term = '{}')"
    cond = where
    for t in ("the", "der", "of", "between", "nosuchterm"):
        cond = cond.replace(f"[{t}]", f"docid IN {has.format(t)}")
    scores = f"""{name} AS (SELECT docid, sum(tf * (ln((n + 1) / (df + 1.0::DOUBLE)) + 1)) AS score
FROM po JOIN vo USING (term), nn WHERE term IN ({terms}) GROUP BY docid)"""
    return scores, f"docid, round(coalesce(score, 0.0), 6) AS score FROM ln LEFT JOIN {name} USING (docid) WHERE {cond}"


def found_sql(where: str, scoring: list[str], extra: str = "") -> str:
    scores, rows = found_in("sc", where, scoring)
    return f"{BASE}, {scores} SELECT {rows} {extra}"


SEARCHES = {
    "bool_term": ("(the)", "[the]", ["the"]),
    "bool_and": ("the && of", "[the] AND [of]", ["the", "of"]),
    "bool_or": ("the || der", "[the] OR [der]", ["the", "der"]),
    "bool_not": ("!the", "NOT [the]", []),
    "bool_and_not": ("the && !of", "[the] AND NOT [of]", ["the"]),
    "bool_nested": ("between && (of || !the) || !!der", "([between] AND ([of] OR NOT [the])) OR [der]", ["between", "of", "der"]),
    "bool_trailing": ("the of && der", "[the]", ["the"]),
    "bool_lone": ("the & of", "[the]", ["the"]),
    "bool_raw_terms": ("der || the, && of", "[der] OR ([nosuchterm] AND [of])", ["der", "of"]),
    "bool_empty": ("the && nosuchterm", "[the] AND [nosuchterm]", ["the", "nosuchterm"]),
    "tfidf_free_text": ("The between, DER der", "[the] OR [between] OR [der]", ["the", "between", "der"]),
}

for _name, (_text, _where, _scoring) in SEARCHES.items():
    query(_name, found_sql(_where, _scoring))(found(_text))
query("tfidf_topk", found_sql("[the] OR [of]", ["the", "of"], "ORDER BY score DESC, docid LIMIT 10"))(found("the of", 10))


@query("set_union", BASE + " SELECT docid FROM po WHERE term = 'the' UNION SELECT docid FROM po WHERE term = 'der'")
def set_union(spark, d):
    at = index.Index.of_terms(lines_of(spark, d), ["the", "der"])
    return search.docs_with(at, "the").union(search.docs_with(at, "der")).distinct()


@query("set_intersect", BASE + " SELECT docid FROM po WHERE term = 'the' INTERSECT SELECT docid FROM po WHERE term = 'of'")
def set_intersect(spark, d):
    at = index.Index.of_terms(lines_of(spark, d), ["the", "of"])
    return search.docs_with(at, "the").intersect(search.docs_with(at, "of"))


@query("set_complement", BASE + " SELECT docid FROM ln EXCEPT SELECT docid FROM po WHERE term = 'the'")
def set_complement(spark, d):
    at = index.Index.of_terms(lines_of(spark, d), ["the"])
    return at.docs.select("docid").join(search.docs_with(at, "the"), "docid", "left_anti")


GOLDEN = {
    "between && (der || of)": ("[between] AND ([der] OR [of])", ["between", "der", "of"]),
    "!the": ("NOT [the]", []),
    "the, DER": ("[the] OR [der]", ["the", "der"]),
}
_PARTS = [(q, *found_in(f"s{i}", where, scoring)) for i, (q, (where, scoring)) in enumerate(GOLDEN.items())]


@query("golden_search", f"{BASE}, {', '.join(s for _, s, _ in _PARTS)} " + " UNION ALL ".join(f"SELECT '{q}' AS q, {rows}" for q, _, rows in _PARTS))
def golden_search(spark, d):
    """Several searches over one written index."""
    path = f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
    index.Index.build(lines_of(spark, d)).write(path)
    parts = [search.search_path(spark, path, q).select(F.lit(q).alias("q"), "docid", F.round("score", 6).alias("score")) for q in GOLDEN]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- frequencies ----------------------------------------------------------------------------


@query("term_freqs", FREQS + " SELECT term, cnt FROM fr WHERE length(term) >= 1")
def term_freqs(spark, d):
    return stats.term_freqs(documents(spark, d))


@query("freq_tokens", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{FREQ}')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL AND text <> ''")
def freq_tokens(spark, d):
    docs = documents(spark, d).where("text is not null and text <> ''")
    return docs.select("doc_id", F.size(frequency_tokens(F.col("text"), split_hyphen=False)).cast("long").alias("n"))


@query("freq_min_len", FREQS + " SELECT term, cnt FROM fr WHERE length(term) >= 4")
def freq_min_len(spark, d):
    return stats.term_freqs(documents(spark, d), min_len=4)


@query(
    "corpus_stats",
    FREQS
    + """, dd AS (SELECT count(*) AS n_docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL AND text <> '')
SELECT n_docs, n_bytes, round(n_bytes / 1024, 6) AS n_kb, (SELECT CAST(sum(cnt) AS BIGINT) FROM fr) AS n_tokens, round((SELECT avg(length(term)) FROM ft), 6) AS avg_len FROM dd""",
)
def corpus_stats(spark, d):
    return stats.corpus_stats(documents(spark, d)).withColumns({"n_kb": F.round("n_kb", 6), "avg_len": F.round("avg_len", 6)})


@query("lemma_sample", FREQS.replace("AND text <> ''", "AND text <> '' AND doc_id IN (SELECT doc_id FROM documents WHERE text <> '' ORDER BY doc_id LIMIT 500)") + " SELECT term, cnt FROM fr")
def lemma_sample(spark, d):
    return stats.sample_freqs(documents(spark, d), 500)


@query("stem_freqs", FREQS + " SELECT term AS stem, cnt FROM fr")
def stem_freqs(spark, d):
    return stats.stem_freqs(documents(spark, d))


RUSSIAN = ("abcdefghijklmnopqrstuvwxyz", "айцдещгяиьшлмнопюрстувыхыж")
V = stem.VOWELS


def cut_sql(word: str, *sets: tuple[list[str], bool], region: str = "region") -> str:
    """``word`` without the first ending of the sets that fits inside the region, or NULL."""
    cases = []
    for endings, after_a in sets:
        tail, kept = (f"substr({word}, {region})", r"\1") if after_a else (f"substr({word}, {region} + 1)", "")
        pattern = f"{'([ая])' if after_a else ''}({'|'.join(endings)})$"
        cases.append(f"WHEN regexp_matches({tail}, '{pattern}') THEN left({word}, {region}{' - 1' if after_a else ''}) || regexp_replace({tail}, '{pattern}', '{kept}')")
    return f"(CASE {' '.join(cases)} END)"


def or_same(word: str, endings: list[str], **options) -> str:
    return f"coalesce({cut_sql(word, (endings, False), **options)}, {word})"


STEM_SQL = f"""{FREQS},
s0 AS (SELECT term, cnt, translate(term, '{RUSSIAN[0]}', '{RUSSIAN[1]}') AS word FROM fr),
s1 AS (SELECT *, translate(lower(word), 'ё', 'е') AS f FROM s0),
s2 AS (SELECT *, CASE WHEN regexp_matches(f, '[{V}]') THEN length(regexp_extract(f, '^[^{V}]*[{V}]')) ELSE length(f) END AS region,
  length(regexp_extract(f, '^[^{V}]*[{V}]*[^{V}]*[{V}]*[^{V}]*')) AS second FROM s1),
s3 AS (SELECT *, {cut_sql("f", (stem.GERUND_FREE, False), (stem.GERUND_AFTER_A, True))} AS gerund, {or_same("f", ["ся"])} AS x FROM s2),
s4 AS (SELECT *, {or_same("x", ["сь"])} AS w4 FROM s3),
s5 AS (SELECT *, {cut_sql("w4", (stem.ADJECTIVE, False))} AS a5 FROM s4),
s6 AS (SELECT *, CASE WHEN gerund IS NOT NULL THEN gerund WHEN a5 IS NOT NULL THEN coalesce({cut_sql("a5", (stem.PARTICIPLE_FREE, False), (stem.PARTICIPLE_AFTER_A, True))}, a5)
  ELSE coalesce({cut_sql("w4", (stem.VERB_AFTER_A, True), (stem.VERB_FREE, False), (stem.NOUN, False))}, w4) END AS w6 FROM s5),
s7 AS (SELECT *, {or_same("w6", ["и"])} AS w7 FROM s6),
s8 AS (SELECT *, {or_same("w7", ["ость", "ост"], region="second")} AS w8 FROM s7),
s9 AS (SELECT *, {cut_sql("w8", (["ь"], False))} AS soft, {or_same("w8", ["ейше", "ейш"])} AS w9 FROM s8),
st AS (SELECT term, word, cnt, f, region, CASE WHEN soft IS NOT NULL THEN soft WHEN ends_with(w9, 'нн') AND length(w9) - 2 >= region THEN left(w9, length(w9) - 1) ELSE w9 END AS w FROM s9),
sn AS (SELECT term, word, cnt, CASE WHEN region >= length(f) OR length(w) < 3 THEN f ELSE w END AS stem FROM st)"""


def russian_words(spark, d) -> DataFrame:
    """(word, cnt): the documents' words in Russian letters, as the tables have none; the letters are such that endings of the stemmer's are among theirs."""
    return stats.term_freqs(documents(spark, d)).select(F.translate("term", *RUSSIAN).alias("word"), "cnt")


@query("stem_golden", STEM_SQL + " SELECT DISTINCT word, stem FROM sn")
def stem_golden(spark, d):
    words = russian_words(spark, d).select("word").distinct()
    return words.select("word", stem.stem_column("word").alias("stem"))


@query("stem_lines", STEM_SQL + " SELECT word || CASE WHEN cnt % 2 = 0 THEN chr(13) ELSE '' END AS line, stem FROM sn")
def stem_lines(spark, d):
    """A word a line, some with a carriage return."""
    return stats.stem_lines(russian_words(spark, d).select(F.concat("word", F.when(F.col("cnt") % 2 == 0, "\r").otherwise("")).alias("line")))


MORE = ("e", "s", "n", "en", "er", "es")
LEMMA_SQL = f"""{FREQS},
wd AS (SELECT term, cnt FROM fr WHERE length(term) >= 4),
pb AS (SELECT term AS word, cnt, left(term, length(term) - length(x)) AS lemma FROM wd, (SELECT unnest([{", ".join(f"'{x}'" for x in MORE)}]) AS x) WHERE ends_with(term, x)),
pa AS (SELECT word, lemma FROM pb JOIN wd l ON l.term = lemma AND l.cnt > pb.cnt),
pr AS (SELECT word, lemma FROM pa UNION ALL SELECT term, term FROM wd WHERE term NOT IN (SELECT word FROM pa)),
ch AS (SELECT word, length(word) - length(lemma) AS strip FROM pr),
vt AS (SELECT right(word, k) AS ending, k AS size, strip, count(*) AS n FROM (SELECT word, strip, unnest(range(strip, least(length(word), 6) + 1)) AS k FROM ch) GROUP BY ALL),
ru AS (SELECT ending, strip FROM vt QUALIFY row_number() OVER (PARTITION BY ending ORDER BY n DESC, strip) = 1 AND sum(n) OVER (PARTITION BY ending) >= 3),
en AS (SELECT term, cnt, unnest(range(0, least(length(term), 6) + 1)) AS k FROM fr WHERE regexp_matches(term, '[a-z]')),
le AS (SELECT term, strip FROM en JOIN ru ON ru.ending = right(term, k) WHERE length(term) > strip QUALIFY row_number() OVER (PARTITION BY term ORDER BY k DESC) = 1)"""


@query("lemma_rules", LEMMA_SQL + " SELECT ending, CAST(strip AS INTEGER) AS strip FROM ru")
def lemma_rules(spark, d):
    return rules_of(spark, d)[1].select("ending", "strip")


@query("lemma_freqs", LEMMA_SQL + " SELECT left(term, length(term) - coalesce(strip, 0)) AS lemma, CAST(sum(cnt) AS BIGINT) AS cnt FROM fr LEFT JOIN le USING (term) GROUP BY 1")
def lemma_freqs(spark, d):
    freqs, rules = rules_of(spark, d)
    return lemmas.lemma_freqs(freqs, rules, which="[a-z]", default=F.col)


def rules_of(spark, d) -> tuple[DataFrame, DataFrame]:
    """Word counts, and rules learned from the words themselves: a word with an ending more than a more frequent one is its form, others are their own."""
    freqs = saved(stats.term_freqs(documents(spark, d)), "freqs")
    words = freqs.where(F.length("term") >= 4)
    longer = words.select(F.col("term").alias("lemma"), F.col("cnt").alias("of"), F.explode(F.array(*(F.concat("term", F.lit(x)) for x in MORE))).alias("term"))
    forms = words.join(longer, "term").where(F.col("of") > F.col("cnt")).select(F.col("term").alias("word"), "lemma")
    own = words.select(F.col("term").alias("word")).join(forms, "word", "left_anti").withColumn("lemma", F.col("word"))
    return freqs, saved(lemmas.learn(forms.unionByName(own), least=3), "rules")


ZIPF = """,
ft2 AS (SELECT count(*) AS m, regr_slope(ln(cnt), ln(rank)) AS b, regr_intercept(ln(cnt), ln(rank)) AS a FROM rk WHERE rank <= 1000)"""


@query("zipf_fit", f"{FREQS}{ZIPF} SELECT round(a, 6) AS log_c, round(-b, 6) AS s, m AS fit_points FROM ft2")
def zipf_fit(spark, d):
    fit = stats.zipf_fit(stats.ranked_freqs(stats.term_freqs(documents(spark, d))))
    return fit.select(F.round("log_c", 6).alias("log_c"), F.round("s", 6).alias("s"), "fit_points")


@query("zipf_curve", f"{FREQS}{ZIPF} SELECT rank, term, cnt, round(ln(rank), 6) AS log_r, round(ln(cnt), 6) AS log_f, round(a + b * ln(rank), 5) AS zipf FROM rk, ft2")
def zipf_curve(spark, d):
    curve = stats.zipf_curve(stats.ranked_freqs(stats.term_freqs(documents(spark, d))))
    return curve.withColumns({"log_r": F.round("log_r", 6), "log_f": F.round("log_f", 6), "zipf": F.round("zipf", 5)})


@query("load_freqs", FREQS + " SELECT term, cnt FROM fr WHERE length(term) % 6 IN (0, 4)")
def load_freqs(spark, d):
    """The documents' frequency lines, four of six damaged by the length of their term."""
    n, tab = F.length("term") % 6, F.lit("\t")
    whole = F.concat("term", tab, F.col("cnt").cast("string"))
    damaged = F.when(n == 1, F.concat("term", F.lit("\t-"), "cnt")).when(n == 2, F.concat("term", F.lit(" "), "cnt")).when(n == 3, F.concat(whole, tab, "term"))
    line = damaged.when(n == 4, F.concat("term", F.lit("\t "), "cnt", F.lit(" \r"))).when(n == 5, F.concat("term", tab, "term")).otherwise(whole)
    return parse_freqs(stats.term_freqs(documents(spark, d)).select(line.alias("line")))


# --- crawl ----------------------------------------------------------------------------------

NORMAL = (
    "(CASE WHEN regexp_extract(url, '{0}', 1) = '' THEN 'http' ELSE lower(regexp_extract(url, '{0}', 1)) END || '://' || lower(regexp_extract(url, '{0}', 2)) || "
    "CASE WHEN regexp_replace(regexp_extract(url, '{0}', 3), ';[^/]*$', '') IN ('', '/') THEN '/' ELSE regexp_replace(regexp_replace(regexp_extract(url, '{0}', 3), ';[^/]*$', ''), '/$', '') END)"
).replace("{0}", r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)")
URLS = f"WITH np AS (SELECT page_id, url AS raw, html, {NORMAL} AS url FROM pages), one AS (SELECT url, min(page_id) AS page_id FROM np GROUP BY url), pg AS (SELECT np.page_id, np.url, np.html FROM np JOIN one ON np.page_id = one.page_id)"


@query("url_normalize", URLS + " SELECT page_id, url FROM np")
def url_normalize(spark, d):
    return read(spark, d, "pages").select("page_id", normalize_url(F.col("url")).alias("url"))


@query("url_dedup", URLS + " SELECT page_id, url FROM pg")
def url_dedup(spark, d):
    return crawl.distinct_pages(read(spark, d, "pages")).select("page_id", "url")


@query("content_hash", "SELECT page_id, sha256(coalesce(html, '')) AS content_hash FROM pages")
def content_hash(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("content_hash"))


@query("pages_sample", "SELECT page_id, url, CAST(length(coalesce(html, '')) AS BIGINT) AS html_length, (SELECT count(*) FROM pages) AS n FROM pages ORDER BY page_id LIMIT 5")
def pages_sample(spark, d):
    pages = read(spark, d, "pages")
    n = F.broadcast(pages.agg(F.count(F.lit(1)).alias("n")))  # one row
    return pages.orderBy("page_id").limit(5).join(n).select("page_id", "url", F.length(F.coalesce("html", F.lit(""))).cast("long").alias("html_length"), "n")


def state_of(pages: DataFrame) -> DataFrame:
    """A crawl state made up from pages by their number: new, fetched, due and failed ones."""
    i = F.col("page_id")
    done = i % 4 != 0
    return crawl.distinct_pages(pages).select(
        "page_id",
        "url",
        F.lit("web").alias("source"),
        F.when(done, F.col("html")).alias("html"),
        F.when(done, F.lit(NOW - 1000)).cast("long").alias("fetched_at"),
        F.when(done, F.concat(F.lit("E"), i)).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.when(done & (i % 8 != 1), F.sha2(F.coalesce("html", F.lit("")), 256)).alias("content_hash"),
        F.when(done, F.lit(NOW - 500) + i * 7).otherwise(0).cast("long").alias("next_crawl_at"),
        F.when(i % 4 == 0, F.lit("new")).when(i % 4 == 3, F.lit("error")).otherwise(F.lit("done")).alias("status"),
        F.when(i % 4 == 3, F.lit("HTTP 500")).alias("error"),
    )


STATE_SQL = f"""{URLS}, st AS (SELECT page_id, url, 'web' AS source, CASE WHEN page_id % 4 <> 0 THEN html END AS html,
CASE WHEN page_id % 4 <> 0 THEN {NOW - 1000}::BIGINT END AS fetched_at, CASE WHEN page_id % 4 <> 0 THEN 'E' || page_id END AS etag, NULL::VARCHAR AS last_modified,
CASE WHEN page_id % 4 <> 0 AND page_id % 8 <> 1 THEN sha256(coalesce(html, '')) END AS content_hash,
CASE WHEN page_id % 4 <> 0 THEN {NOW - 500} + page_id * 7 ELSE 0 END AS next_crawl_at,
CASE page_id % 4 WHEN 0 THEN 'new' WHEN 3 THEN 'error' ELSE 'done' END AS status, CASE WHEN page_id % 4 = 3 THEN 'HTTP 500' END AS error FROM pg)"""


@query("crawl_queue", f"{STATE_SQL} SELECT url, status, next_crawl_at FROM st WHERE status = 'new' OR (status = 'done' AND next_crawl_at <= {NOW}) ORDER BY next_crawl_at, url LIMIT 100")
def crawl_queue(spark, d):
    return crawl.queue(state_of(read(spark, d, "pages")), NOW, 100).select("url", "status", "next_crawl_at")


TRANSITION_SQL = f"""{STATE_SQL},
rs AS (SELECT *, CASE page_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 304 WHEN 2 THEN 500 WHEN 3 THEN 200 END AS code, CASE WHEN page_id % 10 = 4 THEN 'timeout' END AS failed FROM st),
fe AS (SELECT *, CASE WHEN failed IS NOT NULL THEN 'error' WHEN code = 304 THEN 'not_changed' WHEN code = 200 THEN 'ok' WHEN code IS NOT NULL THEN 'error' END AS fs,
  CASE WHEN failed IS NOT NULL THEN failed WHEN code = 500 THEN 'HTTP 500' END AS ferr,
  CASE WHEN page_id % 5 = 0 THEN html || 'x' ELSE html END AS fh FROM rs),
ch AS (SELECT *, fs IS NOT DISTINCT FROM 'ok' AND content_hash IS DISTINCT FROM sha256(coalesce(fh, '')) AS changed FROM fe)
SELECT url, source, sha256(coalesce(CASE WHEN changed THEN fh ELSE html END, '')) AS html_hash,
CASE WHEN fs IS NOT NULL THEN {NOW}::BIGINT ELSE fetched_at END AS fetched_at, CASE WHEN fs = 'ok' THEN 'N' || page_id ELSE etag END AS etag,
CASE WHEN fs = 'ok' THEN NULL ELSE last_modified END AS last_modified, CASE WHEN changed THEN sha256(coalesce(fh, '')) ELSE content_hash END AS content_hash,
CASE WHEN fs IS NOT NULL THEN {NOW + INTERVAL}::BIGINT ELSE next_crawl_at END AS next_crawl_at,
CASE WHEN fs = 'error' THEN 'error' WHEN fs IS NOT NULL THEN 'done' ELSE status END AS status, CASE WHEN fs = 'error' THEN ferr WHEN fs IS NOT NULL THEN NULL ELSE error END AS error FROM ch"""


@query("crawl_transition", TRANSITION_SQL)
def crawl_transition(spark, d):
    state = state_of(read(spark, d, "pages"))
    i = F.col("page_id")
    code = F.when(i % 5 == 1, F.lit(304)).when(i % 5 == 2, F.lit(500)).when(i % 5 != 4, F.lit(200))
    failed = F.when(i % 10 == 4, F.lit("timeout"))
    status, error = crawl.classify(code, failed)
    body = F.when(i % 5 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html"))
    asked = state.where((i % 5 != 4) | (i % 10 == 4))
    fetched = asked.select("url", status.alias("status"), body.alias("html"), F.concat(F.lit("N"), i).alias("etag"), F.lit(None).cast("string").alias("last_modified"), error.alias("error"))
    after = crawl.transition(state, fetched, NOW, INTERVAL)
    return after.withColumn("html_hash", F.sha2(F.coalesce("html", F.lit("")), 256)).drop("html")


@query("seed_upsert", STATE_SQL + ", sd AS (SELECT url FROM np WHERE page_id % 3 = 0 GROUP BY url) SELECT url, status FROM st WHERE page_id % 2 = 0 UNION ALL SELECT url, 'new' FROM sd WHERE url NOT IN (SELECT url FROM st WHERE page_id % 2 = 0)")
def seed_upsert(spark, d):
    pages = read(spark, d, "pages")
    seeded = crawl.new_state(pages.where("page_id % 3 = 0"), normalize_url(F.col("url")), F.lit("web"))
    return crawl.upsert_seeds(state_of(pages).where("page_id % 2 = 0"), seeded).select("url", "status")


WIKI = "https://en.wikipedia.org/wiki/"
SEED_SQL = f"""SELECT item_id, regexp_replace('{WIKI}' || replace(url_encode(translate(left(text, 40), ' ' || chr(10), '__')), '%2F', '/'), '/$', '') AS url FROM benchmark"""


@query("seed_urls", SEED_SQL)
def seed_urls(spark, d):
    """The pages of titles, which are the beginnings of the benchmark's texts."""
    title = F.translate(F.left("text", F.lit(40)), "\n", " ")
    return read(spark, d, "benchmark").select("item_id", seed_url(title, WIKI).alias("url"))


# A page stands in the folder of its path, on its host, in the host's domains.
EDGES_SQL = f"""{URLS.replace("WITH", "WITH RECURSIVE", 1)},
hs AS (SELECT page_id, url, regexp_extract(url, '://([^/]*)', 1) AS host, regexp_extract(url, '://[^/]*/([^/]*)/', 1) AS folder FROM pg),
ch AS (SELECT page_id, url, list_transform(range(len(string_split(host, '.')), 0, -1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))
  || CASE WHEN folder = '' THEN []::VARCHAR[] ELSE [host || '/' || folder] END AS c FROM hs),
ed AS (SELECT DISTINCT c[i] AS parent, c[i + 1] AS child FROM (SELECT c, unnest(range(1, len(c))) AS i FROM ch)),
wk(category, level) AS (SELECT unnest(['com', 'net']), 0 UNION SELECT child, level + 1 FROM wk JOIN ed ON parent = category),
lv AS (SELECT category, min(level) AS level FROM wk GROUP BY category)"""


def site_edges(pages: DataFrame) -> DataFrame:
    """(source, parent, ns, child, pageid) of the tree of domains, hosts, folders and pages."""
    own = crawl.distinct_pages(pages).select("page_id", "url", F.regexp_extract("url", "://([^/]*)", 1).alias("host"), F.regexp_extract("url", "://[^/]*/([^/]*)/", 1).alias("folder"))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.size(labels), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    chain = F.concat(domains, F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.array(F.concat_ws("/", "host", "folder"))))
    own = own.select("page_id", "url", chain.alias("c"))
    pairs = F.explode(F.transform(F.slice("c", 1, F.size("c") - 1), lambda p, i: F.struct(p.alias("parent"), F.get("c", i + 1).alias("child"))))
    folders = own.select(pairs.alias("p")).distinct().select(F.lit("web").alias("source"), "p.parent", F.lit(graph.SUBCATEGORY).alias("ns"), "p.child", F.lit(None).cast("long").alias("pageid"))
    return folders.unionByName(own.select(F.lit("web").alias("source"), F.element_at("c", -1).alias("parent"), F.lit(graph.PAGE).alias("ns"), F.col("url").alias("child"), F.col("page_id").alias("pageid")))


@query("category_bfs", EDGES_SQL + " SELECT 'web' AS source, page_id AS pageid, url AS title, level, c[-1] AS category FROM ch JOIN lv ON category = c[-1]")
def category_bfs(spark, d):
    roots = spark.createDataFrame([("web", "com"), ("web", "net")], "source string, category string")
    return graph.category_pages(roots, saved(site_edges(read(spark, d, "pages")), "edges"))


@query("page_dedup", "SELECT role AS source, conv_id AS pageid, min(turn) AS turn, arg_min(md5(coalesce(text, '')), turn) AS hash FROM conversations GROUP BY role, conv_id")
def page_dedup(spark, d):
    """Each role's first turn of a conversation."""
    turns = read(spark, d, "conversations").select(F.col("role").alias("source"), F.col("conv_id").alias("pageid"), "turn", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
    return stats.first_of(turns, ["source", "pageid"], [F.col("turn"), F.col("hash")])


@query("download_remaining", "SELECT doc_id AS pageid, source FROM documents WHERE doc_id % 3 <> 0")
def download_remaining(spark, d):
    """What a download of the documents' pages has left to do, after a third was stored and a third failed."""
    path = f"{work_dir(spark)}/download-{uuid.uuid4().hex}"
    pages = read(spark, d, "documents").select(F.col("doc_id").alias("pageid"), "source")
    outcome = F.when(F.col("pageid") % 6 == 0, "kept").when(F.col("pageid") % 6 == 3, "short").when(F.col("pageid") % 3 == 1, "failed")
    log = pages.select("source", "pageid", outcome.alias("outcome"), F.lit("batch-0").alias("file")).where("outcome is not null")
    log.write.json(f"{path}/progress")
    return download.remaining(pages, path).select("pageid", "source")


@query("fetch_dates", f"{STATE_SQL} SELECT url, strftime(make_timestamp(next_crawl_at * 1000000), '%Y-%m-%d %H:%M:%S') AS due_at, strftime(make_timestamp(fetched_at * 1000000), '%Y-%m-%d %H:%M:%S') AS fetched FROM st")
def fetch_dates(spark, d):
    utc = lambda c: F.date_format(F.to_utc_timestamp(F.timestamp_seconds(c), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    state = state_of(read(spark, d, "pages"))
    same = F.date_format(F.timestamp_seconds("fetched_at"), "yyyy-MM-dd HH:mm:ss").eqNullSafe(date_of(F.col("fetched_at")))
    return state.where(same).select("url", utc("next_crawl_at").alias("due_at"), utc("fetched_at").alias("fetched"))


STORE_SQL = f"""{STATE_SQL}, nw AS (SELECT url, CASE WHEN page_id % 6 = 0 THEN 'done' ELSE status END AS status, CASE WHEN page_id % 6 = 0 THEN {NOW - 100} + page_id ELSE next_crawl_at END AS next_crawl_at FROM st)
SELECT url, status, next_crawl_at FROM nw WHERE status = 'new' OR (status = 'done' AND next_crawl_at <= {NOW}) ORDER BY next_crawl_at, url LIMIT 100"""


@query("store_queue", STORE_SQL)
def store_queue(spark, d):
    """The queue of a document store in its second version."""
    path = f"{work_dir(spark)}/store-{uuid.uuid4().hex}"
    state = saved(state_of(read(spark, d, "pages")), "state")
    store.upsert(state, path, buckets=16)
    later = {"status": F.lit("done"), "next_crawl_at": F.lit(NOW - 100) + F.col("page_id"), "fetched_at": F.lit(NOW).cast("long")}
    store.upsert(state.where("page_id % 6 = 0").withColumns(later), path)
    return crawl.queue(store.read_store(spark, path, columns=["url", "status", "next_crawl_at"]), NOW, 100)


HUMAN = "CASE WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) ELSE printf('%.1f GB', b / 1073741824.0::DOUBLE) END"
TEXT_COLUMNS = {
    "benchmark": "text", "conversations": "role text", "documents": "text lang source", "pages": "url html", "labels": "", "embeddings": "",
}


@query(
    "table_stats",
    "WITH s AS ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS n_rows, CAST(coalesce(sum({' + '.join(f'coalesce(octet_length(encode({c})), 0)' for c in cols.split()) or '0'}), 0) AS BIGINT) AS b FROM {t}"
        for t, cols in TEXT_COLUMNS.items()
    )
    + f") SELECT name, n_rows, b AS n_bytes, {HUMAN} AS size FROM s",
)
def table_stats(spark, d):
    return stats.table_stats({t: read(spark, d, t) for t in TEXT_COLUMNS})


@query("storage_stats")
def storage_stats(spark, d):
    return footers.storage_stats({t: read(spark, d, t) for t in TEXT_COLUMNS})


@query("storage_rows", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TEXT_COLUMNS))
def storage_rows(spark, d):
    """The rows of tables by their footers alone."""
    return storage_stats(spark, d).select("name", "n_rows")
