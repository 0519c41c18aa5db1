"""Text functions as JVM expressions; full HTML unescaping and accent folding as Arrow functions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: A word with inner hyphens or apostrophes, a row of dots, or any other single character.
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[-'][\p{L}\p{M}\p{N}_]+)*|\.{2,}|[^\s\p{L}\p{M}\p{N}_]"
EMOJI_TOKEN = r"[\x{10000}-\x{10ffff}\x{2600}-\x{27bf}]"
#: Tokens of the near-duplicate vectors: hyphenated words, numbers, tags, words, emoji, runs of marks.
DUPLICATE_TOKEN = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)+|[-+]?\p{N}+[.,]?\p{N}+|[#@]?[\p{L}\p{N}_]+|[\x{10000}-\x{10ffff}\x{2600}-\x{27bf}]|[.:(),;?!*\[\]]{2,4}"


def without_marks(text: Column) -> Column:
    """Without the word RT, mentions and number signs."""
    text = F.regexp_replace(text, r"(^|[^\p{L}\p{N}_])RT([^\p{L}\p{N}_]|$)", "$1$2")
    return F.replace(F.regexp_replace(text, r"@[\p{L}\p{N}_]+", ""), F.lit("#"), F.lit(""))


def without_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"https?://[^ ^\r\n]*", "")


def unescape_basic(text: Column) -> Column:
    """The XML entities and the no-break space, in the JVM."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def unescape_html(text: Column) -> Column:
    """Every HTML entity."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def split_camelcase(text: Column) -> Column:
    text = F.regexp_replace(text, r"([^\n])([A-Z]+[a-z]+(?:-[A-Z+a-z]+)*)", "$1 $2")
    return F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")


def split_marks(text: Column) -> Column:
    """Underscores and apostrophes become spaces."""
    return F.translate(text, "_'", "  ")


#: Every kind of white space.
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def clean_text(text: Column, lower: bool = True, full_entities: bool = False) -> Column:
    """Posts' text without marks and links, entities resolved, compounds split, spaces single. Null stays null."""
    text = without_urls(without_marks(text))
    text = unescape_html(text) if full_entities else unescape_basic(text)
    text = squeeze(split_marks(split_camelcase(text)))
    return F.lower(text) if lower else text


def tokenize(text: Column, remove_punctuation: bool = False, stop_words: Column | None = None) -> Column:
    """Tokens in order. Punctuation is one character each, so that it can be removed; rows of dots stay."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), 0)
    if remove_punctuation:
        tokens = F.filter(tokens, lambda t: ~t.rlike(f"^{PUNCTUATION}$"))
    return F.filter(tokens, lambda t: ~F.array_contains(stop_words, t)) if stop_words is not None else tokens


def ngrams(tokens: Column, least: int = 1, most: int = 3, without: str | None = None) -> Column:
    """Distinct runs of least to most tokens without any ASCII punctuation, nor what the pattern `without` finds.

    Tokens are judged once; a run that holds a banned one is null by its concatenation."""
    banned = f"{PUNCTUATION}|{without}" if without else PUNCTUATION

    def longer(runs: Column, able: Column, k: int) -> Column:
        n = F.size(able) - k + 1
        return F.when(n > 0, F.zip_with(F.slice(runs, F.lit(1), n), F.slice(able, F.lit(k), n), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))

    def all_runs(able: Column) -> Column:
        runs, kept = able, []
        for k in range(1, most + 1):
            runs = able if k == 1 else longer(runs, able, k)
            kept += [runs] if k >= least else []
        return F.array_distinct(F.array_compact(F.concat(*kept)))

    # The lambda's variable stands for the judged tokens, so that they are worked out once.
    able = F.transform(tokens, lambda t: F.when(~t.rlike(banned), t))
    return F.transform(F.array(able), all_runs)[0]


def without_digits(grams: Column) -> Column:
    return F.filter(grams, lambda g: ~g.rlike(r"\p{N}"))


def strip_tags(grams: Column, tags: Column) -> Column:
    """array<struct<gram, cut>>: of each n-gram the first tag it holds is cut out once. tags are tried in
    the order given; emptied n-grams are left out."""

    def one(g: Column) -> Column:
        tag = F.get(F.filter(tags, lambda t: F.contains(F.lower(g), t)), F.lit(0))
        at = F.instr(F.lower(g), tag)
        rest = F.concat(F.substring(g, F.lit(1), at - 1), F.substring(g, at + F.length(tag), F.length(g)))
        return F.struct(F.coalesce(F.replace(F.trim(rest), F.lit("  "), F.lit(" ")), g).alias("gram"), tag.isNotNull().alias("cut"))

    return F.filter(F.transform(grams, one), lambda s: s["gram"] != "")


def is_title(text: Column) -> Column:
    """Whether every word begins with its only capital."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"(^|[^\p{L}])\p{Ll}") & ~text.rlike(r"\p{L}\p{Lu}")


def starts_upper(text: Column) -> Column:
    return text.rlike(r"^\p{Lu}")


def all_parts_upper(text: Column) -> Column:
    return ~text.rlike(r"(^| )[^\p{Lu}]")


def sentence_first_words(text: Column) -> Column:
    """Lower-case first words of the text and of what follows a sentence mark."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|(?:[.!?:][ \t\r\n\f]))([\p{L}\p{M}\p{N}_]+)"), 1), F.lower))


def to_ascii(text: Column) -> Column:
    """Letters without their accents; what has no ASCII form is left out."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFD", t).encode("ascii", "ignore").decode(), na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def reduce_repeats(text: Column) -> Column:
    """Runs of a character shortened to two."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1")


def capitals_to_title(text: Column) -> Column:
    """Words all in capitals get one capital."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(w.rlike(r"^\p{Lu}{2,}$"), F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, F.lit(2), F.length(w))))).otherwise(w)), " ")


def single_punctuation(text: Column) -> Column:
    """Runs of one mark shortened to one."""
    return F.regexp_replace(text, r"([!?.,;:*_-])\1+", "$1")


def clean_end_marks(text: Column) -> Column:
    """Marks set apart by a space are joined to the last of them."""
    return F.regexp_replace(text, r"(?:[!?.;:,_-] ([!?.;:,_-]))+", "$1")
