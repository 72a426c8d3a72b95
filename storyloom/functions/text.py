"""Text functions, Column to Column. Nulls count as empty texts."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import DEFAULT, Settings
from .lexicon import ENTITY_GLUE, ENTITY_NOISE, STOPWORDS, TOPICS

_SPACES = r"(?U)\s+"


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def _folding() -> tuple[str, str]:
    """Letters below U+0250 that lose an accent, and what remains of each; smart quotes and dashes."""
    out = {}
    for code in range(0xA0, 0x250):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(code):
            out[chr(code)] = plain
    out |= {"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
    return "".join(out), "".join(out.values())


FOLD_FROM, FOLD_TO = _folding()
# Entities that unescape() decodes in the plan; `exact` decodes all that HTML5 names.
ENTITIES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


@F.pandas_udf(StringType())
def _unescape_exact(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _fold_exact(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


def fold(text: str) -> str:
    """The exact folding, in Python: NFKD without combining marks, plain quotes and dashes, lower case, single blanks."""
    if not text.isascii():
        text = _FOREIGN.sub(_unmarked, unicodedata.normalize("NFKD", text))
    return re.sub(r"\s+", " ", text.translate(_QUOTES)).strip().lower()


def _unmarked(run: re.Match) -> str:
    return "".join([x for x in run[0] if not unicodedata.combining(x)])


_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_QUOTES = str.maketrans("’‘“”–—", "''\"\"--")


def unescape(c: Column | str, exact: bool = False) -> Column:
    """Character references decoded: a closed set in the plan, or all of them by an Arrow function."""
    c = _text(c)
    if exact:
        return _unescape_exact(c)
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_html(c: Column | str, exact: bool = False) -> Column:
    """Text without scripts, styles and tags, references decoded, white space single blanks."""
    c = F.regexp_replace(_text(c), r"(?is)<(script|style)\b.*?</\1>", " ")
    return squeeze(unescape(F.regexp_replace(c, "<[^>]+>", " "), exact))


def normalise(c: Column | str, exact: bool = False) -> Column:
    """Accents and case folded, white space single blanks. The plan folds letters below U+0250; `exact`, all of them."""
    c = _text(c)
    return _fold_exact(c) if exact else F.lower(squeeze(F.translate(c, FOLD_FROM, FOLD_TO)))


def words(normalised: Column) -> Column:
    """All runs of a-z and 0-9 of a normalised text."""
    return F.regexp_extract_all(normalised, F.lit("[a-z0-9]+"), F.lit(0))


def content_words(all_words: Column) -> Column:
    """Words of at least two letters that aren't stop words."""
    return F.filter(all_words, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def shingles(tokens: Column, n: int = 3) -> Column:
    """Runs of n tokens joined by underscores; a shorter list is one shingle, an empty one has none."""
    many = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), "_"))
    few = F.when(F.size(tokens) > 0, F.array(F.array_join(tokens, "_"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(tokens) >= n, many).otherwise(few)


def content_hash(title: Column | str, body: Column | str, exact: bool = False) -> Column:
    """Identity of a document's content, whatever its markup, case and white space."""
    t, b = normalise(strip_html(title, exact), exact), normalise(strip_html(body, exact), exact)
    return F.substring(F.sha2(F.concat(t, F.lit(" "), F.substring(b, 1, 8000)), 256), 1, 40)


def topics(tokens: Column, limit: int = 2) -> Column:
    """Topics with two or more distinct lexicon words, most first; else the best with one; else 'general'."""
    scored = F.array(*[F.struct((-F.size(F.array_intersect(tokens, F.array(*map(F.lit, lexicon))))).alias("n"), F.lit(i).alias("i"), F.lit(name).alias("topic")) for i, (name, lexicon) in enumerate(TOPICS.items())])
    ranked = F.array_sort(scored)
    strong = F.filter(ranked, lambda s: s["n"] <= -2)
    names = F.transform(F.slice(strong, 1, limit), lambda s: s["topic"])
    first = F.element_at(ranked, 1)
    return F.when(F.size(strong) > 0, names).when(first["n"] < 0, F.array(first["topic"])).otherwise(F.array(F.lit("general")))


def language(all_words: Column) -> Column:
    """'en' where more than 6 % of the first 120 words are stop words, else 'und'."""
    head = F.slice(all_words, 1, 120)
    hits = F.size(F.filter(head, lambda t: t.isin(*STOPWORDS)))
    return F.when((F.size(head) > 0) & (hits / F.greatest(F.size(head), F.lit(1)) > 0.06), "en").otherwise("und")


# Patterns of names, acronyms and numbers.
_CAPS = r"\b[A-Z][a-zA-Z]{2,}(?:\s+(?:of|the|de|and|for|und)?\s*[A-Z][a-zA-Z]{2,}){0,3}\b"
_ACRONYM = r"\b[A-Z]{2,6}\b"
_NUMBER = r"\b\d+(?:[.,]\d+)?\b"


def entities(title: Column | str, body: Column | str, settings: Settings = DEFAULT) -> Column:
    """Sorted names, acronyms and numbers of the title and the head of the body: words of capitalised runs, whole runs
    joined by underscores, and '#'-numbers."""
    noise, stop, glue = (F.array(*map(F.lit, x)) for x in (ENTITY_NOISE, STOPWORDS, ENTITY_GLUE))

    def of(text: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + _CAPS), F.lit(0)), lambda m: F.filter(F.split(F.lower(m), _SPACES), lambda w: ~F.array_contains(glue, w)))
        single = F.filter(F.flatten(runs), lambda w: (F.length(w) > 2) & ~F.array_contains(noise, w) & ~F.array_contains(stop, w))
        whole = F.transform(F.filter(runs, lambda r: F.size(r) > 1), lambda r: F.array_join(r, "_"))
        short = F.filter(F.transform(F.regexp_extract_all(text, F.lit("(?U)" + _ACRONYM), F.lit(0)), F.lower), lambda w: ~F.array_contains(noise, w))
        numbers = F.filter(F.regexp_extract_all(text, F.lit("(?U)" + _NUMBER), F.lit(0)), lambda w: (F.length(w) > 1) | ~w.rlike("^[0-9]$"))
        return F.concat(single, whole, short, F.transform(numbers, lambda w: F.concat(F.lit("#"), F.replace(w, F.lit(","), F.lit(".")))))

    found = F.concat(of(_text(title)), of(F.substring(_text(body), 1, 2000)))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, settings.entity_limit)


def bucket(ts: Column | str, hours: int = DEFAULT.bucket_h) -> Column:
    """Number of the span of `hours` that a time without zone lies in, taken as UTC (the session's zone has to be)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / (3600 * hours))


def blocking_key(lang: Column, topic_list: Column, ts: Column) -> Column:
    first = F.coalesce(F.try_element_at(topic_list, F.lit(1)), F.lit("general"))
    return F.concat_ws(":", lang, first, bucket(ts).cast("string"))


def merge_group(key: Column) -> Column:
    """First and last part of a blocking key."""
    parts = F.split(key, ":")
    return F.when(F.size(parts) >= 2, F.concat_ws(":", F.element_at(parts, 1), F.element_at(parts, -1))).otherwise(key)


def hours_between(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(3.6e9)


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_time(s: Column) -> Column:
    """ISO 8601 text with or without zone to a time without zone, in UTC; other text to null."""
    return F.try_to_timestamp(s).cast("timestamp_ntz")
