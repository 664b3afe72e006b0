"""JSON functions: tolerant parsing of model responses."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from evalloom.functions.text import strip_fences, trim_ws


def json_blob(c: Column) -> Column:
    """Variant of the text itself, of its fenced part, or of its first ``{...}``."""
    brace = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(strip_fences(c)), F.try_parse_json(brace))


def path(c: Column, dotted: str, kind: str = "string") -> Column:
    return F.try_variant_get(c, "$." + dotted, kind)


def text_blocks(c: Column) -> Column:
    """Text blocks of a provider's content array, one to a line."""
    return F.array_join(F.transform(F.filter(c, lambda x: x["type"] == "text"), lambda x: x["text"]), "\n")


def extraction(c: Column) -> Column:
    """Struct of a valid extraction response, null where a key is missing, a type is wrong or confidence is out of range."""
    v = F.try_parse_json(strip_fences(c))
    subs, terms, conf = path(v, "subdomains", "array<string>"), path(v, "terms", "array<string>"), path(v, "confidence", "double")
    ok = v.isNotNull() & subs.isNotNull() & terms.isNotNull() & conf.between(0.0, 1.0)
    tidy = lambda a, k: F.array_sort(F.slice(F.array_distinct(F.filter(F.transform(a, trim_ws), lambda x: x != "")), 1, k), lambda x, y: F.when(F.lower(x) < F.lower(y), -1).when(F.lower(x) > F.lower(y), 1).otherwise(0))
    return F.when(ok, F.struct(tidy(subs, 3).alias("subdomains"), tidy(terms, 12).alias("terms"), conf.alias("confidence")))


def visual_facts(c: Column) -> Column:
    """At most three facts of at most 120 characters."""
    facts = F.coalesce(path(json_blob(c), "visual_facts", "array<string>"), F.array().cast("array<string>"))
    return F.slice(F.transform(F.filter(facts, lambda x: trim_ws(x) != ""), lambda x: F.left(trim_ws(x), F.lit(120))), 1, 3)


def repair(text: str | None) -> str | None:
    """Escape raw newlines and stray backslashes inside strings, drop trailing commas, balance brackets."""
    if text is None:
        return None
    out, stack, inside, i = [], [], False, 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == "\\":
                nxt = text[i + 1 : i + 2]
                if nxt and nxt in '"\\/bfnrtu':
                    out.append(c + nxt)
                    i += 2
                    continue
                c = "\\\\"
            elif c == "\n":
                c = "\\n"
            elif c == "\r":
                c = "\\r"
            elif c == "\t":
                c = "\\t"
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}" and stack:
            stack.pop()
        out.append(c)
        i += 1
    fixed = "".join(out) + ('"' if inside else "") + "".join(reversed(stack))
    return re.sub(r",(\s*[\]}])", r"\1", fixed)


def objects(text: str | None) -> list[str]:
    """The complete objects of an array that may be cut off, each as JSON text."""
    if not text:
        return []
    body = re.sub(r"(?s)<think>.*?</think>", "", text)
    fence = re.search(r"(?s)```[a-zA-Z]*\s*(.*?)(?:```|\Z)", body)
    body = fence[1] if fence else body
    at = body.find("[")
    for candidate in (body[at:] if at >= 0 else body, repair(body[at:] if at >= 0 else body)):
        try:
            got = json.loads(candidate)
            got = got if isinstance(got, list) else [got]
            got = [json.loads(x) if isinstance(x, str) and x.lstrip().startswith("{") else x for x in got]
            return [json.dumps(x, ensure_ascii=False, sort_keys=True) for x in got if isinstance(x, dict)]
        except ValueError:
            continue
    out, decoder, at = [], json.JSONDecoder(strict=False), max(at, 0)
    while (at := body.find("{", at)) >= 0:
        try:
            got, end = decoder.raw_decode(body, at)
        except ValueError:
            break
        out.append(json.dumps(got, ensure_ascii=False, sort_keys=True))
        at = end
    return out


@F.pandas_udf(StringType())
def repaired(s: pd.Series) -> pd.Series:
    return s.map(repair)


@F.pandas_udf(ArrayType(StringType()))
def complete_objects(s: pd.Series) -> pd.Series:
    return s.map(objects)


def judge_verdict(c: Column) -> Column:
    """label and score of a judge's response, by JSON or else by words."""
    v = json_blob(c)
    label = F.lower(F.coalesce(path(v, "label"), path(v, "verdict"), F.regexp_extract(F.lower(c), r"\b(correct|incorrect|ambiguous|broken|clean)\b", 1)))
    score = F.coalesce(path(v, "score", "double"), F.try_to_number(F.nullif(F.regexp_extract(c, r"(?i)score\W+([01](?:\.\d+)?)", 1), F.lit("")), F.lit("9.99999")).cast("double"))
    return F.struct(F.nullif(label, F.lit("")).alias("label"), F.coalesce(score, F.when(label == "correct", 1.0).when(label == "incorrect", 0.0)).alias("score"))


def strings(c: Column) -> Column:
    """All string values of a JSON text, at any depth, in the order of the document; null where it is not JSON.

    In JSON a quotation mark that is not escaped begins or ends a string, so strings can be cut out in one pass;
    those before a colon are keys.  Escapes are hidden behind control characters, which JSON texts cannot hold.
    """
    hidden = F.replace(F.replace(c, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002"))
    cut = F.filter(F.regexp_extract_all(hidden, F.lit(r'("[^"]*"\s*:?)')), lambda t: ~t.endswith(":"))
    shown = F.replace(F.replace(F.concat(F.lit("["), F.array_join(cut, ","), F.lit("]")), F.lit("\u0002"), F.lit('\\"')), F.lit("\u0001"), F.lit("\\\\"))
    return F.when(F.try_parse_json(c).isNotNull(), F.from_json(shown, "array<string>"))


def context_lines(c: Column) -> Column:
    """The strings of nested context, trimmed, each after its label, in the order of the document; nothing else counts."""
    return F.coalesce(F.transform(strings(c), lambda t: F.concat(F.lit("Context: "), trim_ws(t))), F.array().cast("array<string>"))
