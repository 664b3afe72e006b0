"""Text functions as Column -> Column; Arrow UDFs only where no built-in exists (NFKC, position logic)."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Language aliases of the three normalisers.
LANGUAGE_NAMES = {"en": "English", "eng": "English", "english": "English", "zh": "Chinese", "cn": "Chinese", "zh-cn": "Chinese", "chinese": "Chinese"}
LANGUAGE_CODES = {"english": "en", "en": "en", "eng": "en", "chinese": "zh", "zh": "zh", "cn": "zh", "zh-cn": "zh"}
VISUAL_WORDS = ["image", "diagram", "figure", "picture", "graph", "chart", "photo", "draw", "visual"]
HAN = r"[\x{4e00}-\x{9fff}]"


_EDGES = re.compile(r"^\s+|\s+$", re.ASCII)


def trim_ws(c: Column) -> Column:
    """Strip all white space, not spaces alone."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def nz(c: Column, kind: str = "string") -> Column:
    """Null where the value is falsy: empty string, zero or empty array."""
    empty = F.size(c) == 0 if kind == "array" else c == F.lit(0 if kind == "number" else "")
    return F.when(~empty, c)


def truthy(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*(nz(c) for c in cols))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def strip_numbering(c: Column) -> Column:
    """NFKC, then without a leading ``(n).`` or ``n、`` and white space."""
    return trim_ws(F.regexp_replace(nfkc(c), r"^\s*(\(\s*\d+\s*\)\s*\.?|\d+\s*[、.])\s*", ""))


def clean_question(c: Column) -> Column:
    """Cut at the first line that announces the answer choices."""
    return trim_ws(F.split(c, r"(?i)\n\s*answer\s*choices\s*:?")[0])


def normalize_text(c: Column) -> Column:
    """Strip, lower-case, straighten apostrophes, collapse white space, drop one final mark."""
    out = F.regexp_replace(F.replace(F.lower(trim_ws(c)), F.lit("’"), F.lit("'")), r"\s+", " ")
    return F.regexp_replace(out, r"[.!?]$", "")


def normalize_math(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(c), r"\s+", ""), "×·", "**")


def normalize_stem(c: Column) -> Column:
    return F.regexp_replace(trim_ws(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " ")


def normalize_term(c: Column) -> Column:
    """English vocabulary form: lower, ``_-`` to space, no punctuation, naive singular."""
    t = F.regexp_replace(F.translate(F.lower(c), "_-", "  "), r"[^\w\s]", "")
    t = trim_ws(F.regexp_replace(t, r"\s+", " "))
    return F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.regexp_replace(t, "s$", "")).otherwise(t)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def is_chinese(c: Column) -> Column:
    return c.rlike(HAN)


def words(c: Column) -> Column:
    """Unicode word tokens, lower-case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"((?U)\w+)"))


def ngrams(c: Column, n: int) -> Column:
    w = words(c)
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def han_windows(c: Column, low: int = 2, high: int = 6) -> Column:
    """All windows of 2 to 6 characters of each run of Han characters."""
    runs = F.regexp_extract_all(c, F.lit(f"({HAN}+)"))

    def of(run: Column) -> Column:
        sizes = F.sequence(F.lit(low), F.least(F.lit(high), F.length(run)))
        one = lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n))
        return F.when(F.length(run) >= low, F.flatten(F.transform(sizes, one))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(runs, of))


def token_set(c: Column) -> Column:
    """Distinct ASCII alphanumeric tokens; non-Latin stems have none."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")), "")


def bigrams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of character bigram sets."""
    x, y = bigrams(a), bigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def count_tokens(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def count_sentences(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "[.!?]+"), lambda x: trim_ws(x) != ""))


def family_of(c: Column) -> Column:
    return F.split_part(slugify(c), F.lit("_"), F.lit(1))


def mentions_visual(c: Column) -> Column:
    return c.rlike(r"(?i)\b(" + "|".join(VISUAL_WORDS) + r")\b")


def language_name(c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv))[F.lower(trim_ws(c))], c)


def language_lower(c: Column) -> Column:
    return F.lower(language_name(c))


def language_code(c: Column) -> Column:
    key = F.lower(trim_ws(c))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv))[key], key)


def strip_fences(c: Column) -> Column:
    """Text between code fences, the end of the string closing an open one; else the text."""
    inner = F.regexp_extract(c, r"(?s)```[a-zA-Z]*\s*(.*?)(?:```|\z)", 1)
    return trim_ws(F.when(c.contains("```"), inner).otherwise(c))


def prompt_text(c: Column, most: int = 50_000) -> Column:
    return F.left(F.replace(c, F.lit("\0"), F.lit("")), F.lit(most))


def svg_escape(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def strip_option(text: Column, letter: Column) -> Column:
    """Without a leading ``A.``, ``A:``, ``(A)`` or ``A)`` of its own letter."""
    return F.regexp_replace(text, F.concat(F.lit(r"^\s*\(?"), letter, F.lit(r"[.:)、]\s*")), F.lit(""))


def options_of_string(c: Column) -> Column:
    """``A. x; B: y`` as letters with contents."""
    letters = F.regexp_extract_all(c, F.lit(r"(?:^|[;；]\s*)([A-H])\s*[.:]"))
    contents = F.regexp_extract_all(c, F.lit(r"(?:^|[;；]\s*)[A-H]\s*[.:]\s*([^;；]*)"))
    return F.zip_with(letters, contents, lambda l, x: F.struct(l.alias("letter"), trim_ws(x).alias("content")))


def longest_first(c: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements in one pass, longest source first: each match is fenced off before the next."""
    for i, old in enumerate(sorted(pairs, key=len, reverse=True)):
        c = F.replace(c, F.lit(old), F.lit(chr(0xE000 + i)))
    for i, old in enumerate(sorted(pairs, key=len, reverse=True)):
        c = F.replace(c, F.lit(chr(0xE000 + i)), F.lit(pairs[old]))
    return c


def clean_terms_en(c: Column, forms: dict[str, str] | None = None, generic: list[str] | None = None) -> Column:
    """Trimmed, mapped to their base form, without generic terms and repeats (case does not tell terms apart), and
    without phrases that end in ``of`` or ``of the`` if a longer one of the list goes on where they stop.

    An Arrow UDF: with lambdas every term would lower-case the whole list again.
    """
    forms, generic = forms or {}, frozenset(generic or ())

    def one(terms: list[str] | None) -> list[str] | None:
        if terms is None:
            return None
        kept: dict[str, str] = {}
        for t in terms:
            t = _EDGES.sub("", t or "")
            t = forms.get(t.lower(), t)
            if t and t.lower() not in generic:
                kept.setdefault(t.lower(), t)
        low = sorted(kept)

        def goes_on(x: str) -> bool:
            k = bisect_right(low, x)
            while k < len(low) and low[k].startswith(x):
                if low[k][len(x) :].strip(" "):
                    return True
                k += 1
            return False

        return [t for x, t in kept.items() if not (x.endswith((" of", " of the")) and goes_on(x))]

    return F.pandas_udf(lambda s: s.map(one), "array<string>")(c)


def clean_terms_zh(c: Column, deny: list[str] | None = None) -> Column:
    """Distinct, without denied terms, short ones that end in a possessive particle, and terms that a longer one contains."""
    deny = frozenset(deny or ())

    def one(terms: list[str] | None) -> list[str] | None:
        if terms is None:
            return None
        stripped = (_EDGES.sub("", t or "") for t in terms)
        kept = dict.fromkeys(t for t in stripped if t and t not in deny and not (len(t) <= 3 and t.endswith("的")))
        return [t for t in kept if not any(len(u) > len(t) and t in u for u in kept)]

    return F.pandas_udf(lambda s: s.map(one), "array<string>")(c)


def clean_terms(dataset: Column, c: Column, zh: str = "_zh", **options) -> Column:
    """The cleaning of the dataset's language."""
    return F.when(dataset.endswith(zh), clean_terms_zh(c)).otherwise(clean_terms_en(c, **options))


# Prefixes of dataset keys and the dataset they belong to; prefixes of language names; frequent words of each language.
DATASETS = {"csbench": "csbench", "wemath": "wemath", "medxpertqa": "medxpertqa", "tomb": "tombench"}
LANGUAGE_PREFIXES = {"zh": "Chinese", "ch": "Chinese", "en": "English", "fr": "French", "de": "German", "ge": "German"}
FUNCTION_WORDS = {"English": ["the", "of", "and", "to", "is", "in"], "French": ["le", "la", "les", "des", "et", "est"], "German": ["der", "die", "das", "und", "ist", "nicht"], "Spanish": ["el", "los", "las", "que", "y", "por"]}


def canonical_dataset(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*(F.when(low.startswith(k), v) for k, v in DATASETS.items()), low)


def detect_language(explicit: Column, text: Column, fallback: str = "English") -> Column:
    """The stated language under its usual name; else Chinese where Han characters stand; else the language
    whose frequent words occur most, earlier names first; else the fallback."""
    said = nz(trim_ws(explicit))
    named = F.coalesce(*(F.when(F.lower(said).startswith(k), v) for k, v in LANGUAGE_PREFIXES.items()), said)
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"))
    among = lambda keys: F.size(F.filter(w, lambda x: x.isin(keys)))
    counts = [among(keys) for keys in FUNCTION_WORDS.values()]
    top = F.greatest(*counts)
    guess = F.coalesce(*(F.when((n == top) & (n > 0), name) for name, n in zip(FUNCTION_WORDS, counts, strict=True)), F.lit(fallback))
    return F.coalesce(named, F.when(is_chinese(text), "Chinese"), guess)


def flatten_options(options: Column) -> Column:
    """``A) x | B) y`` of structs of letter and content."""
    return F.coalesce(F.array_join(F.transform(options, lambda o: F.concat(o["letter"], F.lit(") "), o["content"])), " | "), F.lit(""))


def first_lines(c: Column, lines: int = 6, most: int = 800) -> Column:
    """The first lines, with an ellipsis where they are still too long."""
    head = F.array_join(F.slice(F.split(F.coalesce(c, F.lit("")), "\r\n|\r|\n"), 1, lines), "\n")
    return F.when(F.length(head) > most, F.concat(F.left(head, F.lit(most - 3)), F.lit("..."))).otherwise(head)


def ability_parts(c: Column, dimensions: list[str]) -> Column:
    """``dimension: label`` pairs of one cell, by the places of the dimensions' names."""

    @F.pandas_udf("array<struct<dimension:string,label:string>>")
    def parse(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[dict]:
            if not x:
                return []
            text = x.replace("：", ":")
            at = sorted((text.find(d), d) for d in dimensions if d in text)
            if not at:
                return [{"dimension": None, "label": text.split(":")[-1].strip()}]
            ends = [p for p, _ in at[1:]] + [len(text)]
            return [{"dimension": d, "label": text[p + len(d) : e].strip(" :;,，；\n\t")} for (p, d), e in zip(at, ends, strict=True)]

        return s.map(one)

    return parse(c)
