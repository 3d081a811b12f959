import pytest
from pyspark.sql import functions as F

from folioscope.functions.stem import stem
from folioscope.functions.text import Tokenizer, frequency_tokens, human_size, title_bytes, vbyte_length
from folioscope.functions.urls import normalize_url, seed_url
from folioscope.operators.corpus import corpus_lines, prepare_corpus

GOLDEN = [
    ("Hello, WORLD!", Tokenizer(False), "hello world"),
    ("ЭсМинЕц конвой", Tokenizer(False), "эсминец конвой"),
    ("самолёт самолет ЁЖИК ежик", Tokenizer(), "самолет самолет ежик ежик"),
    ("самолёт самолет", Tokenizer(False), "самолёт самолет"),
    ("Ан-12 CH-53 F-19 a_b _lead -trail a__b", Tokenizer(False), "ан-12 ch-53 f-19 a_b lead trail a b"),
    ("Ан-12 CH-53 a_b", Tokenizer(False, False), "ан 12 ch 53 a b"),
    ("a b a", Tokenizer(False), "a b a"),
    ("a" * 100, Tokenizer(False, True, 16), "a" * 16),
    ("a" * 15 + "яb", Tokenizer(False, True, 16), "a" * 15 + "b"),
    ("Ѐ І", Tokenizer(), "Ѐ І"),
    ("a\u212aB \u0130X ÉTÉ Ёж", Tokenizer(), "a b x t еж"),  # a Kelvin sign and a dotted I are no letters, though their lower case is
    ("Я" * 10, Tokenizer(False, True, 16), "я" * 8),
    ("", Tokenizer(), ""),
    (None, Tokenizer(), ""),
]


@pytest.mark.parametrize(("text", "tokenizer", "expected"), GOLDEN)
def test_tokens(spark, text, tokenizer, expected):
    df = spark.createDataFrame([(text,)], "line string")
    assert df.select(tokenizer.tokens(F.col("line"))).first()[0] == expected.split()


def test_lines_are_cleaned_and_blank_ones_go(spark):
    texts = ["a\r\nb", " \t\r\n", "\r", "", None, "\u00a0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = corpus_lines(prepare_corpus(docs)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, "a b"), (5, "\u00a0")]


def test_invalid_bytes_part_tokens(spark):
    df = spark.createDataFrame([(bytes([0x61, 0xFF, 0x62]),)], "b binary")
    text = F.make_valid_utf8(F.col("b").cast("string"))
    assert df.select(Tokenizer().tokens(text)).first()[0] == ["a", "b"]


def test_frequency_tokens(spark):
    df = spark.createDataFrame([("Ёлка-Ель a_b x",)], "t string")
    get = lambda **o: df.select(frequency_tokens(F.col("t"), **o)).first()[0]
    assert get() == ["елка", "ель", "a", "b", "x"]
    assert get(split_hyphen=False) == ["елка-ель", "a", "b", "x"]
    assert get(normalize_yo=False, min_len=3) == ["ёлка", "ель"]


STEMS = (
    "СТОЛЫ→стол Стола→стол столом→стол столе→стол столах→стол столами→стол книги→книг книгой→книг машины→машин машиной→машин рыба→рыб "
    "рыбы→рыб красивый→красив красивого→красив синий→син синего→син ёлка→елк елка→елк test→test 12345→12345 зая→зая"
)


@pytest.mark.parametrize("pair", STEMS.split())
def test_stem(pair):
    word, expected = pair.split("→")
    assert stem(word) == expected


def test_stem_null_and_case():
    assert stem(None) is None
    assert stem("TEST") == "TEST"
    assert stem("") == ""


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("= Title = text", "Title "),
        ("== T ==", "T "),
        ("plain == rest", "plain "),
        ("ab", "doc_7"),
        ("  \tword here", "word here"),
        ("x" * 200, "x" * 120),
        ("=", "doc_7"),
    ],
)
def test_title(spark, line, expected):
    df = spark.createDataFrame([(line,)], "line string")
    assert bytes(df.select(title_bytes(F.col("line"), F.lit(7))).first()[0]).decode() == expected


def test_vbyte_length(spark):
    values = [0, 1, 2, 10, 127, 128, 129, 255, 16383, 16384, 16385, 2097151, 2097152, 268435455, 268435456, 4294967295]
    df = spark.createDataFrame([(v,) for v in values], "v long").select(vbyte_length(F.col("v")))
    assert [r[0] for r in df.collect()] == [1] * 5 + [2] * 4 + [3] * 3 + [4] * 2 + [5] * 2


def test_human_size(spark):
    df = spark.createDataFrame([(None,), (0,), (1023,), (1536,), (1 << 50,)], "n long").select(human_size(F.col("n")))
    assert [r[0] for r in df.collect()] == ["N/A", "0.0 B", "1023.0 B", "1.5 KB", "1.0 PB"]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTP://Ex.COM", "http://ex.com/"),
        ("https://a.b/c/", "https://a.b/c"),
        ("https://a.b/c//", "https://a.b/c/"),
        ("https://a.b/c;p?q=1#f", "https://a.b/c"),
        ("//a.b/c", "http://a.b/c"),
        ("https://a.b/;x", "https://a.b/"),
    ],
)
def test_normalize_url(spark, url, expected):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(normalize_url(F.col("u"))).first()[0] == expected


def test_seed_url(spark):
    df = spark.createDataFrame([("Самолёт а/б",)], "title string")
    assert df.select(seed_url(F.col("title"), "https://ru.x/wiki/")).first()[0] == "https://ru.x/wiki/%D0%A1%D0%B0%D0%BC%D0%BE%D0%BB%D1%91%D1%82_%D0%B0/%D0%B1"
