import ast
import uuid

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column).first()[0]


LITERALS = [
    "['a','b']", "", None, "nope", "{}", "[]", "[ ]", "['a', None, 'b',]", "[None]", "['it\\'s', \"it's\"]", r"['\x41\u00e9\n\\', 'a\tb']", "['a' 'b'", "['a'", "[1, 2.5, -3, True]", "('a',)",
    "['a', ['b']]", "['a', nope]", "  ['x']  ", "['a\nb']", "['" + "y" * 20_000 + "']", "[" + "'z', " * 3000 + "]", "['[', ',', ']']", "[,]", "['é東']",
]


def literal(raw):
    """What Python makes of a list literal; strings over several lines and lists in lists aside."""
    try:
        value = ast.literal_eval((raw or "").strip().replace("\n", "\\n"))
    except (ValueError, SyntaxError):
        return []
    if not isinstance(value, list) or any(isinstance(x, list) for x in value):
        return []
    return [x if x is None or isinstance(x, str) else str(x) for x in value]


@pytest.mark.parametrize("raw", LITERALS)
def test_parse_list(spark, raw):
    row = spark.createDataFrame([(raw,)], "r string").select(text.parse_list(F.col("r")).alias("x"), text.is_list(F.col("r")).alias("ok")).first()
    assert row.x == literal(raw)
    assert row.ok or not row.x


@pytest.mark.parametrize(("n", "want"), [(10, [0, 3, 6]), (5, [0, 3]), (8, [0, 3, 6]), (4, [0]), (1, [0])])
def test_chunk_starts(spark, n, want):
    assert spark.range(1).select(text.chunk_starts(F.lit(n), 4, 1)).first()[0] == want
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([("d", "  ".join(words)), (None, "x"), ("e", ""), ("f", None)], "i string, t string")
    got = [(r.id, r.chunk_id, r.num_chunks, r.text) for r in text.chunks(df, "i", "t", size=4, overlap=1).orderBy("id", "chunk_index").collect()]
    body = [" ".join(words[a : a + 4]) for a in want] if n > 4 else ["  ".join(words)]
    assert got == [*(("d", f"d_c{i}", len(want), b) for i, b in enumerate(body)), ("unknown", "unknown_c0", 1, "x")]


def test_ids(spark):
    assert one(spark, text.uuid5(F.col("n")), n="abc_c0") == "23ef2da2-1213-51b2-b850-c61f3e4ff4d8"
    for name in ("", "é", "x" * 99):
        assert one(spark, text.uuid5(F.col("n")), n=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, text.point_id(F.lit(""), F.lit("abc"), F.lit(0))) == "23ef2da2-1213-51b2-b850-c61f3e4ff4d8"


def test_small_ones(spark):
    assert one(spark, text.truncate_tokens(F.lit("a  b\tc  d"), 3)) == "a b c"
    assert one(spark, text.year_of_ms(F.lit(1_000_000_000_000).cast("long"))) == 2001
    assert one(spark, text.year_of_ms(F.lit(None).cast("long"))) == 0
    assert one(spark, text.language_guess(F.lit("Le chat est la"))) == "fr"
    assert one(spark, text.language_guess(F.lit("nothing"))) == "de"
    assert one(spark, text.language_guess(F.lit("il con della"))) == "it"
    assert one(spark, text.label(F.lit(""), F.lit("0123456789"))) == "01234567"
    assert one(spark, text.payload_int(F.lit("x"), 1)) == 1 and one(spark, text.payload_int(F.lit(" 7 "))) == 7


DATE = 1_332_892_800_000  # 2012-03-28


@pytest.mark.parametrize(
    ("number", "date", "court", "source", "want"),
    [
        ("9X_5/2003", DATE, "CH_BGer", "", "https://www.bger.ch/ext/eurospider/live/de/php/aza/http/index.php?lang=de&type=show_document&highlight_docid=aza%3A%2F%2F28-03-2012-9X_5-2003"),
        ("7Q.22/88", DATE, "CH_BGer", "", "https://www.bger.ch/ext/eurospider/live/de/php/aza/http/index.php?lang=de&type=show_document&highlight_docid=aza%3A%2F%2F28-03-2012-7Q-22-1988"),
        ("9X_5/2003", 0, "CH_BGer", "", "https://entscheidsuche.ch/?text=9X_5/2003"),
        ("BGE 77 IV 9", None, "CH_BGE", "", "https://www.bger.ch/ext/eurospider/live/de/php/clir/http/index.php?lang=de&type=show_document&highlight_docid=atf%3A%2F%2F77-IV-9%3Ade"),
        ("BGE_64_Ib_5", None, "CH_BGE", "", "https://www.bger.ch/ext/eurospider/live/de/php/clir/http/index.php?lang=de&type=show_document&highlight_docid=atf%3A%2F%2F64-Ib-5%3Ade"),
        ("55.7 x", None, "ch", "swiss_legislation_chunked", "https://www.fedlex.admin.ch/de/search?text=55.7%20x"),
        (None, DATE, "CH_BGer", "", None),
    ],
)
def test_source_links(spark, number, date, court, source, want):
    df = spark.createDataFrame([(number, date, court, source, "xx")], "n string, d long, c string, s string, l string")
    assert df.select(text.source_link(*map(F.col, "ndcsl"))).first()[0] == want
