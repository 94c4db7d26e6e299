"""Quality rules, line first: clean each line, then reject documents that lose too much text. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corrolla.llm.common import read_documents, text_or_empty

#: Fixed values. Phrases that mark a line as boilerplate, in either case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "use cookies",
    "enable javascript",
    "javascript is disabled",
    "privacy policy",
    "terms of use",
    "terms of service",
    "sign up for our newsletter",
    "subscribe to our",
    "click here",
    "lorem ipsum",
    "share on facebook",
    "skip to content",
)
#: Fixed values. A line that ends in one of these is a finished sentence; closing quotes and brackets may follow.
TERMINAL = ".!?:;,\u2026\u3002\uff01\uff1f\u0964\u061f"
CLOSING = "\"'\u201d\u2019\u00bb)] \t\r\x0b\f"
#: Fixed values. What stands between the entries of a menu, a breadcrumb or a table row.
SEPARATORS = r"[|\x{00bb}\x{203a}\x{2022}\x{00b7}>]"
#: Fixed values. The symbols of the base counts.
SYMBOLS = r"[#*$%&|<>]"

_SPACE_CHARS = " \t\n\x0b\f\r"
_SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a sort key that hold a position; the rest holds the front of a window's hash.
_POSITION_BITS = 24


def repeated_words(df: DataFrame, words: str, n: str, out: str) -> DataFrame:
    """Add column out: words that lie in a 3-word window found twice or more. words: an array column, n: its size.

    A window is the shifted sum, without carries, of its words' 64-bit hashes. Where a text has a repeated hash, the windows are sorted by the
    front of the hash and the position, so that equal ones are neighbours; the positions found are put in order and
    each adds what the one before it doesn't cover. Should fronts agree where hashes don't, or positions not fit, the
    whole hash and the position are sorted instead.
    """
    bits, mask = _POSITION_BITS, (1 << _POSITION_BITS) - 1
    pair = "zip_with({}, {}, (a, b) -> a ^ shiftleft(b, {}))"
    window = pair.format(pair.format(f"slice(_g, 1, {n} - 2)", f"slice(_g, 2, {n} - 2)", 1), f"slice(_g, 3, {n} - 2)", 2)
    flagged = "filter({0}, (v, k) -> {1})"
    same = f"shiftright(v, {bits}) = shiftright(get(_k, k {{}} 1), {bits})"
    whole = "sort_array(transform(_h, (x, i) -> struct(x AS x, i AS i)))"
    covered = "aggregate(_p, struct(0 AS total, -3 AS last), (a, i) -> struct(a.total + least(3, i - a.last) AS total, i AS last), a -> a.total)"
    steps = [
        ("_g", f"transform({words}, x -> xxhash64(x))"),
        ("_h", f"CASE WHEN {n} < 4 THEN CAST(array() AS array<bigint>) ELSE {window} END"),
        ("_any", "size(array_distinct(_h)) < size(_h)"),
        ("_k", f"CASE WHEN _any AND size(_h) < {mask} THEN sort_array(transform(_h, (x, i) -> (x & ~{mask}L) | i)) END"),
        ("_d", "CASE WHEN _k IS NOT NULL THEN " + flagged.format("_k", f"{same.format('-')} OR {same.format('+')}") + " END"),
        (
            "_clash",
            f"CASE WHEN _k IS NOT NULL THEN exists(transform(_d, (v, j) -> j > 0 AND shiftright(v, {bits}) = shiftright(get(_d, j - 1), {bits}) "
            f"AND get(_h, CAST(v & {mask} AS int)) <> get(_h, CAST(get(_d, j - 1) & {mask} AS int))), x -> x) ELSE _any END",
        ),
        ("_s", f"CASE WHEN _clash THEN {whole} END"),
        (
            "_p",
            "CASE WHEN _clash THEN sort_array(transform(" + flagged.format("_s", "v.x = get(_s, k - 1).x OR v.x = get(_s, k + 1).x") + ", v -> v.i)) "
            f"WHEN _any THEN sort_array(transform(_d, v -> CAST(v & {mask} AS int))) ELSE CAST(array() AS array<int>) END",
        ),
    ]
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    return df.withColumn(out, F.expr(covered).cast("long")).drop(*[name for name, _ in steps])


def _boilerplate(text: Column) -> Column:
    return F.rlike(text, F.lit(rf"(?i)\b(?:{'|'.join(BOILERPLATE)})"))


def line_fails(line: Column, has: dict[str, Column], max_symbols: float, min_words: int, separator_share: float) -> Column:
    """True where a line with a word breaks a punctuation, a navigation or a boilerplate rule.

    Punctuation: fewer than min_words words and no closing mark; symbols above max_symbols of the characters;
    doubled exclamation marks after a third of the words. Navigation: separators after separator_share of the words.
    A line's words are its blanks and one. has: whether the whole text holds what a rule looks for, so that the lines
    of a plain text are not searched one by one.
    """
    length = F.char_length(line)
    without = lambda x: length - F.char_length(F.replace(line, F.lit(x), F.lit("")))
    count = lambda pattern: length - F.char_length(F.regexp_replace(line, pattern, ""))
    words = without(" ") + 1
    short = (words < min_words) & ~F.substring(F.rtrim(line, F.lit(CLOSING)), -1, 1).isin(*TERMINAL)
    symbols = has["symbols"] & (count(SYMBOLS) > max_symbols * length)
    shouting = has["shouting"] & (3 * without("!!") > 2 * words)
    navigation = has["separators"] & (count(SEPARATORS) > separator_share * words)
    return short | symbols | shouting | navigation | (has["boilerplate"] & _boilerplate(line))


def line_first_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    max_lost: float = 0.3,
    max_symbols: float = 0.1,
    min_line_words: int = 4,
    separator_share: float = 0.25,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """Counts, the cleaned text and a verdict for each row of docs.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean),
    lost_chars (long) and clean_text. A line that fails a rule leaves the text; a document that loses more than
    max_lost of the characters in its words' lines, or fails the base rules, is not kept.

    Null or empty text: all counts 0, base_failed, not kept, clean_text empty. Rows with a null or repeated id are
    treated each by itself. Further columns of docs play no part. Very long texts are held one at a time, as arrays.
    An empty table gives an empty result.
    """
    trimmed = F.trim(F.col("_text"), F.lit(_SPACE_CHARS))
    chars = lambda lines: F.char_length(F.array_join(lines, "")).cast("long")
    has = {"symbols": F.col("_symbols") > 0} | {x: F.col(f"_{x}") for x in ("separators", "shouting", "boilerplate")}
    split = (
        docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
        .withColumn("_trimmed", trimmed)
        .withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", _SPACE)))
        .withColumn("_n", F.size("_words"))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(_SPACE_CHARS)) != ""))
        .withColumn("_symbols", (F.char_length("_text") - F.char_length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long"))
        .withColumn("_separators", F.rlike("_text", F.lit(SEPARATORS)))
        .withColumn("_shouting", F.contains("_text", F.lit("!!")))
        .withColumn("_boilerplate", _boilerplate(F.col("_text")))
        .withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x, has, max_symbols, min_line_words, separator_share)))
    )
    measured = repeated_words(split, "_words", "_n", "n_repeat_words").select(
        F.col("_id").alias(id_col),
        F.col("_n").cast("long").alias("n_words"),
        chars("_words").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        chars("_lines").alias("_all"),
        (chars("_lines") - chars("_good")).alias("lost_chars"),
        F.array_join("_good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("_all"))
    ).drop("_all")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return line_first_quality(read_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


_MARKS_SQL = "(" + ", ".join(f"chr({ord(c)})" for c in TERMINAL) + ")"
_CLOSING_SQL = " || ".join(f"chr({ord(c)})" for c in CLOSING)
_SEPARATOR_SQL = "[|»›•·>]"
#: The same in SQL. Windows are compared by their words.
OP6_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d
), wc AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r
), g AS (
  SELECT r, i, word || ' ' || lead(word) OVER x || ' ' || lead(word, 2) OVER x AS gram FROM w WINDOW x AS (PARTITION BY r ORDER BY i)
), f AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g WHERE gram IS NOT NULL
), cov AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM f WHERE c > 1) GROUP BY r
), l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), lw AS (
  SELECT r, line, length(line) AS n, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), lf AS (
  SELECT *, (words < 4 AND right(rtrim(line, {_CLOSING_SQL}), 1) NOT IN {_MARKS_SQL})
    OR n - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > 0.1 * n
    OR 3 * (n - length(replace(line, '!!', ''))) > 2 * words
    OR n - length(regexp_replace(line, '{_SEPARATOR_SQL}', '', 'g')) > 0.25 * words
    OR regexp_matches(line, '(?i)\\b(?:{'|'.join(BOILERPLATE)})') AS fails FROM lw
), lc AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup, sum(n) AS chars, coalesce(sum(n) FILTER (fails), 0) AS lost FROM lf GROUP BY r
), m AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars, coalesce(chars, 0) AS chars
  FROM d LEFT JOIN wc USING (r) LEFT JOIN cov USING (r) LEFT JOIN lc USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.3 * chars AS kept
FROM m
"""
