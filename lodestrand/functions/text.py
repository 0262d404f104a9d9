"""Column functions on texts, identifiers, dates and links; all are built-in expressions, none a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The chunker's window and step over, the token limit of a query, the reranker's text limit.
CHUNK_SIZE, CHUNK_OVERLAP, QUERY_TOKENS, RERANK_CHARS = 2048, 128, 4096, 4000

#: The words that are counted for each language; ties go to the earlier language.
STOP_WORDS = {
    "de": ("der", "die", "und", "mit", "ist", "vom"),
    "fr": ("le", "la", "et", "avec", "est", "du"),
    "it": ("il", "la", "e", "con", "del", "della"),
}

#: Fixed value: the name space of UUIDs made from URLs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


#: A string, number or constant in a list literal, and a whole list of them.
_ITEM = r"""(?:'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|None|True|False|[+-]?\d+(?:\.\d+)?)"""
_LIST = rf"(?s)^\s*+\[\s*+(?:{_ITEM}\s*+(?:,\s*+{_ITEM}\s*+)*+(?:,\s*+)?)?+\]\s*+$"
#: What a letter behind a backslash stands for.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\x0b", "a": "\x07", "0": "\0", "\n": ""}


def is_list(raw: Column) -> Column:
    """Whether a text is a list literal of strings, numbers and constants; null is none."""
    return F.coalesce(raw.rlike(_LIST), F.lit(False))


def _unescaped(body: Column) -> Column:
    """A string literal's text: escapes of one letter, of two (x) and of four (u) hexadecimal digits."""

    def one(piece: Column) -> Column:
        kind, code = F.substring(piece, 2, 1), F.substr(piece, F.lit(3))
        plain = kind
        for letter, meaning in _ESCAPES.items():
            plain = F.when(kind == letter, F.lit(meaning)).otherwise(plain)
        coded = F.decode(F.unhex(F.lpad(code, 4, "0")), "UTF-16BE")
        return F.when(~F.startswith(piece, F.lit("\\")), piece).when(F.length(piece) > 2, coded).otherwise(plain)

    pieces = F.regexp_extract_all(body, F.lit(r"(?s)(\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\]++)"), F.lit(1))
    return F.when(F.contains(body, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(body)


def parse_list(raw: Column) -> Column:
    """Elements of a list literal as strings, None as null; anything else (null, empty, malformed, no list) is an empty list."""

    def one(item: Column) -> Column:
        quoted_ = F.substring(item, 1, 1).isin("'", '"')
        return F.when(quoted_, _unescaped(F.substr(item, F.lit(2), F.length(item) - 2))).when(item != "None", item)

    items = F.transform(F.regexp_extract_all(raw, F.lit(f"(?s)({_ITEM})"), F.lit(1)), one)
    return F.when(is_list(raw), items).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Words between white space of any script."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def truncate_tokens(text: Column, limit: int = QUERY_TOKENS) -> Column:
    return F.array_join(F.slice(tokens(text), 1, limit), " ")


def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """First token (from 0) of every window over ``n`` tokens; the last window is the first that reaches the end."""
    step = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)) * step).cast("int")
    return F.sequence(F.lit(0), last, F.lit(step))


def chunks(docs: DataFrame, id_col: str, text_col: str, *keep: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """A row for each chunk of every text that isn't empty: id, chunk_id, chunk_index, num_chunks, text and ``keep``.

    A text of up to ``size`` tokens is one chunk, verbatim; an id that is null is called unknown.
    """
    known = F.coalesce(F.col(id_col).cast("string"), F.lit("unknown"))
    split = docs.where(F.coalesce(F.col(text_col), F.lit("")) != "").select(
        known.alias("id"), F.col(text_col).alias("whole"), tokens(F.col(text_col)).alias("tokens"), *keep
    )
    # The starts go through explode and not through a lambda, in which the split would be made anew for each chunk.
    n = F.size("tokens")
    placed = split.select("*", F.posexplode_outer(chunk_starts(n, size, overlap)).alias("chunk_index", "at"))
    last = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(size - overlap)) + 1).cast("int")
    part = F.when(n <= size, F.col("whole")).otherwise(F.array_join(F.slice("tokens", F.col("at") + 1, F.lit(size)), " "))
    return placed.select("id", F.concat_ws("_c", "id", "chunk_index").alias("chunk_id"), "chunk_index", last.alias("num_chunks"), part.alias("text"), *keep)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def point_id(chunk_id: Column, decision_id: Column, chunk_index: Column) -> Column:
    """Key of a stored vector; a chunk without an id of its own is named after its place."""
    given = F.when(F.coalesce(chunk_id, F.lit("")) != "", chunk_id)
    return uuid5(F.coalesce(given, F.concat_ws("_c", decision_id, chunk_index)))


def year_of_ms(ms: Column) -> Column:
    return F.coalesce(F.year(F.timestamp_millis(ms)), F.lit(0))


def language_guess(text: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    score = {k: sum((F.regexp_count(padded, F.lit(f" {w} ")) for w in words), F.lit(0)) for k, words in STOP_WORDS.items()}
    return (
        F.when((score["de"] >= score["fr"]) & (score["de"] >= score["it"]), "de")
        .when(score["fr"] >= score["it"], "fr")
        .otherwise("it")
    )


def quoted(text: Column, keep_slash: bool = False) -> Column:
    """Percent encoding with %20 for spaces and ~ as it is; ``keep_slash`` leaves slashes."""
    out = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


#: Public addresses of rulings, laws and searches, and how a collected ruling is cited.
COURT_SITE, LAW_SITE, SEARCH_SITE = "https://www.bger.ch/ext/eurospider/live/", "https://www.fedlex.admin.ch/", "https://entscheidsuche.ch/?text="
BOOK_CITATION = r"^BGE[\s_]+(\d+)[\s_]+([IVX]+[ab]?)[\s_]+(\d+)$"


def source_link(file_number: Column, date_ms: Column, court: Column, source: Column, lang: Column) -> Column:
    """Best public address of a ruling or law, null without a file number."""
    tongue = F.when(lang.isin("de", "fr", "it"), lang).otherwise("de")
    base = F.concat(F.lit(COURT_SITE), tongue)
    when = F.timestamp_millis(F.when(date_ms != 0, date_ms))
    chamber = F.regexp_extract(file_number, r"(?s)^(.+)/[^/]*$", 1)
    short = F.regexp_extract(file_number, r"(?s)/([^/]*)$", 1)
    guess = F.floor(F.year(when) / 100) * 100 + F.try_to_number(short, F.lit("99")).cast("int")
    full = F.lpad(F.when(guess > F.year(when), guess - 100).otherwise(guess).cast("string"), 4, "0")
    year = F.when(F.length(short) == 2, full).otherwise(short)
    case = F.concat(F.lit("aza://"), F.date_format(when, "dd-MM-yyyy"), F.lit("-"), F.replace(chamber, F.lit("."), F.lit("-")), F.lit("-"), year)
    part = [F.regexp_extract(F.trim(file_number), BOOK_CITATION, i) for i in (1, 2, 3)]
    volume = F.concat(F.lit("atf://"), F.concat_ws("-", *part), F.lit(":"), tongue)
    page = lambda kind, doc: F.concat(base, F.lit(f"/php/{kind}/http/index.php?lang="), tongue, F.lit("&type=show_document&highlight_docid="), quoted(doc))
    there = F.coalesce(file_number, F.lit("")) != ""
    return (
        F.when(there & (court == "CH_BGer") & when.isNotNull() & (chamber != "") & short.rlike(r"^\d+$"), page("aza", case))
        .when(there & (court == "CH_BGE") & F.trim(file_number).rlike(BOOK_CITATION), page("clir", volume))
        .when(there & (source == "swiss_legislation_chunked"), F.concat(F.lit(LAW_SITE), tongue, F.lit("/search?text="), quoted(file_number, True)))
        .when(there, F.concat(F.lit(SEARCH_SITE), quoted(file_number, True)))
    )


def dataset_link(dataset: str, decision_id: Column, splits=("train", "validation", "test")) -> Column:
    """Address of a dataset viewer with a query for one id over all splits."""
    parts = [F.concat(F.lit(f"SELECT '{s}' AS split, * FROM {s} WHERE decision_id = '"), decision_id, F.lit("'")) for s in splits]
    query = F.concat_ws(" UNION ALL ", *parts)
    return F.concat(F.lit(f"https://huggingface.co/datasets/{dataset}/viewer/default/{splits[0]}?sql_console=true&sql="), quoted(query))


def excerpt(text: Column, n: int = 600) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def label(file_number: Column, decision_id: Column) -> Column:
    return F.when(F.coalesce(file_number, F.lit("")) != "", file_number).otherwise(F.substring(decision_id, 1, 8))


def payload_int(value: Column, default: int | None = None) -> Column:
    """Lenient whole number: null, empty and malformed give ``default``."""
    got = value.try_cast("int")
    return got if default is None else F.coalesce(got, F.lit(default))


def payload(rows: DataFrame) -> DataFrame:
    """A stored point's payload from a chunk's fields: null texts empty, numbers lenient, num_chunks 1 where unknown, date_ms from the date.

    ``rows`` has the chunk's columns, as texts or numbers; a date that is no whole number gives null.
    """
    plain = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("decision_id", "chunk_id", "text", "file_number", "language", "court")}
    numbers = {"chunk_index": payload_int(F.col("chunk_index"), 0), "num_chunks": payload_int(F.col("num_chunks"), 1), "date_ms": F.col("date").try_cast("long")}
    return rows.withColumns(plain | numbers).withColumn("date", F.coalesce(F.col("date").cast("string"), F.lit("")))


def chunk_counts(docs: DataFrame, chunked: DataFrame, text_col: str) -> DataFrame:
    """One row: n_docs, n_empty (texts that are left out), n_chunks, n_split (texts of several chunks)."""
    empty = F.coalesce(F.col(text_col), F.lit("")) == ""
    texts = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(empty).alias("n_empty"))
    return texts.crossJoin(chunked.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if((F.col("chunk_index") == 0) & (F.col("num_chunks") > 1)).alias("n_split")))  # a row each


def run_estimate(n_queries: Column, seconds: int = 18) -> tuple[Column, Column]:
    """(hours for all queries, queries for each of three languages)."""
    return n_queries * seconds / F.lit(3600.0), F.floor(n_queries / 3)


def shade(value: Column, top: Column) -> Column:
    """0 to 1 on a linear scale that ends at ``top``; 0 where there is no top."""
    return F.when(top > 0, F.least(F.lit(1.0), value / top)).otherwise(F.lit(0.0))
