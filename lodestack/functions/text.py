"""Text operators as columns: normalising, tokenising, identifiers, ids, labels, truncation."""

from __future__ import annotations

import functools
import os
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and lists that results depend on.
CONTROLS = r"[\x00-\x08\x0B-\x1F]"
HYPHEN_WRAP = r"(?U)(\w)-\n(\w)"
TRAILING_SPACE = r"[ \t]+\n"
MULTI_SPACE = r"[ \t]{2,}"
MULTI_BLANK = r"\n{3,}"
KEYWORD = r"(?U)[A-Za-z]+(?:\d+[A-Za-z]*)*|\d+"
IDENTIFIER = r"(?U)\b(?:[A-Za-z]{2,6}\d{2,}|\d{3,}|[a-z_]+_[a-z_]+)\b"
REQUIREMENT_ID = r"(?U:([A-Za-z]{1,6}\d[\w.-]*))"
AREA_HEADING = r"(?md)^\s*\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3}\s*$"
CODE_TYPES = ("function", "class", "raw_python")
#: Characters that compatibility composition changes neither alone nor beside each other: ASCII, Latin-1 but for its
#: compatibility characters, and common punctuation. None combines with a character before it. Found is a text with
#: another one: runs of ASCII and of the rest are passed over, as a search for a character outside asks all ranges of each.
_ASCII, _KEPT = r"[\x00-\x7F]", r"[\u00A1-\u00A7\u00A9\u00AB\u00AC\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u00FF\u2013\u2014\u2018\u2019\u201C\u201D\u2022\u20AC]"
COMPOSED = rf"(?s)\A{_ASCII}*+(?:{_KEPT}++{_ASCII}*+)*+."
TRUNCATION_MARK = "\n[... example truncated - shape only, not a complete artefact]"


def strip(col: Column) -> Column:
    """Without white space (any Unicode kind) at either end."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(col: Column) -> Column:
    """Compatibility composition. Only texts with a character that it may change are sent to Python; of all others it gets nulls."""
    return F.coalesce(_nfkc(F.when(col.rlike(COMPOSED), col)), col)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, though body names it often or inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_text(col: Column, compose: bool = True) -> Column:
    """Prose: NFKC, controls out (CR and FF too), one pass of de-hyphenation, spaces and blank lines collapsed, stripped."""
    col = nfkc(col) if compose else col
    col = F.regexp_replace(col, CONTROLS, "")
    col = F.regexp_replace(col, HYPHEN_WRAP, "$1$2")
    col = F.regexp_replace(col, TRAILING_SPACE, "\n")
    col = F.regexp_replace(col, MULTI_SPACE, " ")
    return strip(F.regexp_replace(col, MULTI_BLANK, "\n\n"))


def normalize_code(col: Column, compose: bool = True) -> Column:
    """Code: like prose, but hyphens, indentation and inner spaces stay; only newlines are stripped."""
    col = nfkc(col) if compose else col
    col = F.regexp_replace(col, CONTROLS, "")
    col = F.regexp_replace(col, TRAILING_SPACE, "\n")
    return F.btrim(F.regexp_replace(col, MULTI_BLANK, "\n\n"), F.lit("\n"))


def normalize_unit(text: Column, unit_type: Column, compose: bool = True) -> Column:
    return F.when(unit_type.isin(*CODE_TYPES), normalize_code(text, compose)).otherwise(normalize_text(text, compose))


def words(col: Column) -> Column:
    return F.filter(F.split(col, r"(?U)\s+"), lambda t: t != "")


def token_count(col: Column) -> Column:
    """White-space words; 0 for null."""
    return F.coalesce(F.size(words(col)), F.lit(0))


def model_token_count(col: Column, tokenizer: str) -> Column:
    """Tokens of a tokenizers file, special ones not added; white-space words where there is no such file, as for token_count."""
    if not os.path.isfile(tokenizer):
        return token_count(col)

    @F.pandas_udf("int")
    def counted(text: pd.Series) -> pd.Series:
        found = _tokenizer(tokenizer).encode_batch(text.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([len(x.ids) for x in found])

    return counted(col)


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer  # only where a model's tokens are counted

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def keywords(col: Column) -> Column:
    """Lower-cased runs of letters with digits inside, or of digits."""
    return F.transform(F.regexp_extract_all(col, F.lit(KEYWORD), F.lit(0)), F.lower)


def identifiers(col: Column) -> Column:
    """Distinct lower-cased identifiers, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col, F.lit(IDENTIFIER), F.lit(0)), F.lower))


def chunk_id(source_path: Column, locator_key: Column, index: Column, text: Column) -> Column:
    short = F.substring(F.sha2(text, 256), 1, 16)
    return F.substring(F.sha2(F.concat_ws("::", source_path, locator_key, index.cast("string"), short), 256), 1, 32)


def locator_key(pairs: dict[str, Column]) -> Column:
    """`k=v` of the non-null pairs, sorted by key, joined by `|`."""
    return F.concat_ws("|", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in sorted(pairs.items())))


def _nonzero(col: Column) -> Column:
    return F.nullif(col.cast("string"), F.lit(""))


def source_label(file: Column, page: Column, section: Column, test_case: Column, class_name: Column, method: Column, table_title: Column) -> Column:
    """file > p.N > section > what names the piece best; blanks and page 0 are left out."""
    member = F.when(_nonzero(method).isNotNull(), F.concat_ws(".", _nonzero(class_name), _nonzero(method)))
    paged = F.when(page != 0, F.concat(F.lit("p."), page.cast("string")))
    return F.concat_ws(" > ", _nonzero(file), paged, _nonzero(section), F.coalesce(_nonzero(test_case), member, _nonzero(table_title)))


def budgeted(col: Column, limit: Column) -> Column:
    """Stripped text cut to `limit` characters, at the last newline if that is past the half, with a mark; a limit <= 0 cuts nothing."""
    text = strip(col)
    cut = F.substr(text, F.lit(1), limit.cast("int"))
    newline = F.length(cut) - F.locate("\n", F.reverse(cut))  # 0-based place of the last one
    lined = F.when((F.locate("\n", cut) > 0) & (newline > F.floor(limit / 2)), F.substr(cut, F.lit(1), newline)).otherwise(cut)
    return F.when((limit <= 0) | (F.length(text) <= limit), text).otherwise(F.concat(F.regexp_replace(lined, r"(?U)\s+$", ""), F.lit(TRUNCATION_MARK)))


def clamp(col: Column) -> Column:
    return F.greatest(F.least(col, F.lit(1.0)), F.lit(0.0))


def round_half_even(col: Column, digits: int = 3) -> Column:
    return F.bround(col, digits)


def traffic_light(score: Column) -> Column:
    return F.when(score >= 0.75, "clear").when(score >= 0.5, "approach").otherwise("stop")


def choose(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The allowed value that equals the text ignoring case, else the first that contains it or is contained, else the default."""
    text = F.lower(strip(F.coalesce(value, F.lit(""))))
    options = F.array(*map(F.lit, allowed))
    exact = F.get(F.filter(options, lambda o: F.lower(o) == text), 0)
    partial = F.get(F.filter(options, lambda o: F.contains(F.lower(o), text) | F.contains(text, F.lower(o))), 0)
    return F.when(text == "", F.lit(default)).otherwise(F.coalesce(exact, partial, F.lit(default)))


def requirement_id(text: Column) -> Column:
    """The id that starts the stripped text, else the first that has a line of its own, else null."""
    body = strip(text)
    first = F.regexp_extract(body, rf"^{REQUIREMENT_ID}(?U:\b)", 1)
    own = F.regexp_extract(body, rf"(?md)^\s*(?:\d+[.)]\s+)?{REQUIREMENT_ID}\s*$", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(own, F.lit("")))


def requirement_query(text: Column, compose: bool = True) -> Column:
    """The normalised body: what follows an id at the start, or all of it."""
    body = strip(text)
    first = F.regexp_extract(body, rf"^{REQUIREMENT_ID}(?U:\b)", 0)
    rest = strip(F.substr(body, F.length(first) + 1, F.length(body)))
    return normalize_text(F.when((first != "") & (rest != ""), rest).otherwise(body), compose)


def functional_area(text: Column) -> Column:
    """Title of the shallowest numbered title-case heading, the first of equals; null without one."""
    headings = F.transform(F.regexp_extract_all(strip(text), F.lit(AREA_HEADING), F.lit(0)), strip)
    ranked = F.transform(headings, lambda h, i: F.struct((F.length(F.regexp_extract(h, r"^\S+", 0)) - F.length(F.replace(F.regexp_extract(h, r"^\S+", 0), F.lit("."), F.lit("")))).alias("depth"), i.alias("i"), F.regexp_replace(h, r"^\S+\s+", "").alias("title")))
    return F.array_min(ranked)["title"]


def strip_fence(raw: Column) -> Column:
    """Without a leading code fence line and the closing one."""
    text = strip(raw)
    return F.when(F.startswith(text, F.lit("```")), strip(F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))).otherwise(text)


def download_name(kind: Column, requirement: Column, stamp: Column, extension: str) -> Column:
    safe = F.regexp_replace(F.coalesce(requirement, F.lit("requirement")), r"[^A-Za-z0-9_.-]", "_")
    return F.concat(kind, F.lit("_"), safe, F.lit("_"), F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit(f".{extension}"))


def stable_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{k}") for k, p in enumerate(parts)))), 256)


def numbered_cases(descriptions: Column) -> Column:
    return F.array_join(F.transform(descriptions, lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d)), "\n")


def labelled_blocks(*blocks: tuple[str, Column]) -> Column:
    """`label:` and text of the blocks that have one, apart by blank lines."""
    return F.concat_ws("\n\n", *(F.when(strip(text) != "", F.concat(F.lit(f"{label}:\n"), strip(text))) for label, text in blocks))
