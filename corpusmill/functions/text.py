"""Text functions as Column expressions: normalising, word n-grams, code and answer extraction, prompt parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that decide results.
WORD = "[a-z0-9]+"
EDGE_BLANKS = r"(?U)^\s+|\s+$"
EMPTY_REASONING = r"\A\s*(?:<think>\s*)?</think>"
SQL_FENCE = r"(?is)```\s*sql\s*\n?(.*?)```"
ANY_FENCE = r"(?s)```[a-zA-Z]*\s*\n?(.*?)```"
BARE_QUERY = r"(?is)\b(?:WITH|SELECT)\b.*"
SAMPLE_SUFFIX = "#s[0-9]+$"
DATABASE_NAME = "^[A-Za-z0-9_]+$"
REPORT_NAME = r"^[A-Za-z0-9.\-]+/\d{4}/page_\d+\.pdf$"
RETRY_CODES = (408, 429, 500, 502, 503, 504)
RETRY_WORDS = ("not yet ready", "scale-up", "temporarily unavailable")
#: Where a question and its evidence stand in a prompt, each up to a blank line, the next label or the end.
QUESTION_PART = r"(?s)^(?:.*\n)?(?:Question|Q): ?(.*?)(?:\n[ \t]*\n|\n[A-Z][A-Za-z ]{0,30}:|\s*\z)"
EVIDENCE_PART = r"(?s)^(?:.*\n)?(?:External knowledge|Evidence|Hint): ?(.*?)(?:\n[ \t]*\n|\n[A-Z][A-Za-z ]{0,30}:|\s*\z)"


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, EDGE_BLANKS, "")


def normalize_text(c: Column) -> Column:
    """Lower-case words of letters a-z and digits with single spaces; null stays null, a text without such words is ''."""
    return F.array_join(words(c), " ")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def word_ngrams(c: Column, n: int = 13) -> Column:
    """All runs of n words of a text; fewer words give an empty array.

    The words are bound by an outer lambda, so they are found once a text and not once an n-gram.
    """
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    each = F.transform(F.array(words(c)), lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.array().cast("array<string>")))
    return F.get(each, F.lit(0))


def digest128(*columns: Column) -> list[Column]:
    """128 bits over the columns, as two numbers. xxhash64 takes the hash of the columns before as its seed, so the second number starts
    with a literal: behind the columns it would be a function of the first number."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


def ngram_digests(c: Column, n: int = 13) -> Column:
    """The distinct n-grams of a text as 128-bit digests (two seeds of xxhash64), 16 bytes each in a shuffle."""
    return F.transform(F.array_distinct(word_ngrams(c, n)), lambda g: F.struct(*[h.alias(name) for h, name in zip(digest128(g), "ab", strict=True)]))


def after_reasoning(c: Column) -> Column:
    """The text behind the last closing think tag."""
    return F.substring_index(c, "</think>", -1)


def normalize_response(c: Column) -> Column:
    """Without an empty leading reasoning block and without leading blanks."""
    return F.regexp_replace(F.regexp_replace(c, EMPTY_REASONING, ""), r"(?U)\A\s+", "")


def has_reasoning_markup(c: Column) -> Column:
    return c.contains("<think>") | c.contains("</think>")


def _clean_sql(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), r"(?U)(?:\s*;)+$", ""))


def extract_sql(c: Column) -> Column:
    """The last non-empty sql block behind the reasoning, else the last non-empty block, else from the first SELECT or WITH to the end; null if there is none."""
    body = after_reasoning(c)
    last = lambda pattern: F.try_element_at(F.filter(F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), strip), lambda x: x != ""), F.lit(-1))
    bare = F.nullif(F.regexp_extract(body, BARE_QUERY, 0), F.lit(""))
    return _clean_sql(F.coalesce(last(SQL_FENCE), last(ANY_FENCE), bare))


def normalize_sql(c: Column) -> Column:
    """Lower case, single spaces, no trailing semicolons; also inside literals."""
    return F.regexp_replace(strip(F.lower(F.regexp_replace(c, r"(?U)\s+", " "))), r"(?:\s*;)+$", "")


def question_of(c: Column) -> Column:
    """The question of a user message: behind the last 'Question:' or 'Q:' at the start of a line, up to a blank line or the next label; '' if there is none."""
    return F.regexp_extract(c, QUESTION_PART, 1)


def evidence_of(c: Column) -> Column:
    """The evidence of a user message, as question_of; '' if there is none or it says 'none'."""
    found = F.regexp_extract(c, EVIDENCE_PART, 1)
    return F.when(F.lower(strip(found)) == "none", F.lit("")).otherwise(found)


def strip_sample(c: Column) -> Column:
    """A record id without its '#s<k>'."""
    return F.regexp_replace(c, SAMPLE_SUFFIX, "")


def failure_kind(error: Column) -> Column:
    """What stands before the first ':' of an error."""
    return F.substring_index(error, ":", 1)


def valid_database(c: Column) -> Column:
    return c.rlike(DATABASE_NAME)


def valid_report(c: Column) -> Column:
    return c.rlike(REPORT_NAME)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over parts joined by a NUL character."""
    return F.sha2(F.concat_ws(chr(0), *parts), 256)


def cell_text(c: Column, limit: int = 40) -> Column:
    """A table cell on one line: null as NULL, cut behind limit characters with '...'."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("NULL")), "\n", " ")
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def joined_lines(lines: Column, empty: str = "(none)") -> Column:
    """The non-blank lines of an array, stripped and joined; empty for none."""
    kept = F.filter(F.transform(lines, strip), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(kept, "\n"), F.lit("")), F.lit(empty))


def table_lines(rows: Column, empty: str = "(none)") -> Column:
    """Rows of cells as lines with ' | ' between stripped cells."""
    text = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, strip), " | ")), "\n")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(empty))


def merge_reasoning(content: Column, reasoning: Column, finish: Column) -> Column:
    """The raw completion of a response whose reasoning was split off; one cut off before its answer is reasoning only."""
    cut = (finish == "length") & (F.coalesce(content, F.lit("")) == "")
    return F.when(cut, F.coalesce(reasoning, F.lit(""))).otherwise(F.concat(F.coalesce(reasoning, F.lit("")), F.lit("</think>"), F.coalesce(content, F.lit(""))))


def json_object(c: Column) -> Column:
    """The JSON object of an answer as a map: a fence around it is dropped, else the first '{' to the last '}' is read; null if that is no object."""
    body = strip(after_reasoning(c))
    fenced = F.regexp_extract(body, r"(?s)^```[a-zA-Z]*\s*\n?(.*?)```\s*$", 1)
    inner = F.when(fenced != "", strip(fenced)).otherwise(body)
    braces = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    return F.from_json(F.nullif(braces, F.lit("")), "map<string,string>")


def retryable(code: Column, text: Column) -> Column:
    """Whether a failed call may be tried again."""
    return F.coalesce(code.isin(*RETRY_CODES), F.lit(False)) | F.coalesce(F.lower(text).rlike("|".join(RETRY_WORDS)), F.lit(False))
