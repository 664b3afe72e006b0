"""Numbers: extraction, tolerance, scoring, allocation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions.arrays import choice, choices
from evalloom.functions.text import count_sentences, count_tokens, normalize_text, trim_ws

NUMBER = r"[-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?"
NUMERIC_TEXT = r"^[\s\d\.,eE+\-*/^()]+$"
# Tokens a model may spend on each type of question.
TOKEN_BUDGET = {"mcq_single": 512, "mcq_multi": 512, "open_ended": 1024, "structured": 2048, "cloze": 512, "judgment": 512, "default": 1024}


def extract_numeric(c: Column) -> Column:
    """First number in the text."""
    return F.nullif(F.regexp_extract(c, NUMBER, 0), F.lit("")).try_cast("double")


def close(pred: Column, gold: Column) -> Column:
    return F.abs(pred - gold) <= F.greatest(F.lit(1e-6), F.abs(gold) * F.lit(1e-4))


def pearson(x: str, y: str) -> Column:
    """Null for fewer than two points or a constant side; never a division error."""
    return F.when(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= 2, F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def scoring_profile(qtype: Column, gold: Column) -> Column:
    """How an answer is scored, by type and shape of the gold answer."""
    g = trim_ws(F.coalesce(gold.cast("string"), F.lit("")))
    free = F.lower(qtype).isin("open_ended", "structured", "cloze", "judgment")
    return (
        F.when(~free, "mcq_exact")
        .when(g.rlike(NUMERIC_TEXT), "numeric_exact")
        .when(count_tokens(g) <= 3, "symbolic_exact")
        .when((count_tokens(g) > 80) | (count_sentences(g) > 3), "skip_core")
        .otherwise("llm_judge")
    )


def score(qtype: Column, gold: Column, gold_set: Column, pred: Column, pred_set: Column) -> Column:
    """struct(is_correct, method, reason); null correctness where a judge must decide or the item is skipped.

    Sets of letters are compared as sets.
    """
    profile = scoring_profile(qtype, gold)
    multi = F.lower(qtype) == "mcq_multi"
    mk = lambda ok, method, reason: F.struct(ok.cast("boolean").alias("is_correct"), F.lit(method).alias("method"), reason.alias("reason"))
    yes = lambda ok, a, b: F.when(ok, a).otherwise(b)
    same_set = choices(pred_set) == choices(gold_set)
    p, g = extract_numeric(pred), extract_numeric(gold)
    sp, sg = normalize_text(pred), normalize_text(gold)
    return (
        F.when(multi & (F.size(choices(pred_set)) <= 0), mk(F.lit(False), "mcq_multi_set", F.lit("empty_pred")))
        .when(multi, mk(same_set, "mcq_multi_set", yes(same_set, "mcq_multi_set_match", "mcq_multi_set_mismatch")))
        .when(gold.isNull(), mk(F.lit(False), "none", F.lit("missing_gold")))
        .when((profile == "mcq_exact") & choice(pred).isNull(), mk(F.lit(False), "mcq_single_exact", F.lit("empty_pred")))
        .when(profile == "mcq_exact", mk(choice(pred) == choice(gold), "mcq_single_exact", yes(choice(pred) == choice(gold), "mcq_exact_match", "mcq_mismatch")))
        .when(F.coalesce(trim_ws(pred), F.lit("")) == "", mk(F.lit(False), "none", F.lit("empty_pred")))
        .when((profile == "numeric_exact") & (p.isNull() | g.isNull()), mk(F.lit(False), "numeric_exact", F.lit("numeric_parse_fail")))
        .when(profile == "numeric_exact", mk(close(p, g), "numeric_exact", yes(close(p, g), "numeric_exact", "numeric_mismatch")))
        .when(profile == "symbolic_exact", mk((sp == sg) & (sg != ""), "symbolic_exact", yes((sp == sg) & (sg != ""), "symbolic_exact", "symbolic_mismatch")))
        .when(profile == "skip_core", mk(F.lit(None), "skip_core", F.lit("skip_core")))
        .otherwise(mk(F.lit(None), "llm_judge", F.lit("judge_required")))
    )


def score_open_ended(pred: Column, gold: Column, aliases: dict[str, str] | None = None) -> Column:
    """Number, expression, term with aliases, or share of the definition's words."""

    def judge(x: Column) -> Column:
        p, g = x["p"], x["g"]
        np_, ng = extract_numeric(pred), extract_numeric(gold)
        named = F.lit(False)
        for a, b in (aliases or {"ram": "random access memory", "os": "operating system"}).items():
            named = named | ((p == a) & (g == b)) | ((p == b) & (g == a))
        long_words = F.array_distinct(F.filter(F.split(g, r"\W+"), lambda w: F.length(w) > 3))
        # Bound, so that the words are found once, and their share once a text.
        enough = F.transform(F.array(long_words), lambda ws: (F.size(ws) >= 3) & (F.coalesce(F.try_divide(F.size(F.filter(ws, lambda w: F.contains(p, w))), F.size(ws)), F.lit(0.0)) >= 0.6))[0]
        return F.when(g.rlike(NUMERIC_TEXT) & np_.isNotNull() & ng.isNotNull(), close(np_, ng)).when((p == g) | named, True).otherwise(enough)

    # Bound, so that texts are normalised once and not for each word.
    return F.transform(F.array(F.struct(normalize_text(pred).alias("p"), normalize_text(gold).alias("g"))), judge)[0]


def legacy_score(qtype: Column, method: Column, gold: Column, pred: Column) -> Column:
    """Correctness by the earlier rules: letters and sets as text, numbers within tolerance, free text by words; null where a judge must decide."""
    letters_ = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit("([A-H])"))))
    judged = method == "judge"
    return (
        F.when(gold.isNull() | pred.isNull(), F.when(judged, F.lit(None)).otherwise(False))
        .when(qtype == "mcq_single", F.upper(pred) == F.upper(gold))
        .when(qtype == "mcq_multi", letters_(pred) == letters_(gold))
        .when(method == "numeric", F.coalesce(close(extract_numeric(pred), extract_numeric(gold)), F.lit(False)))
        .when(judged, F.lit(None))
        .when(qtype == "open_ended", score_open_ended(pred, gold))
        .otherwise(normalize_text(pred) == normalize_text(gold))
    )


def soft_score(judge: Column, correct: Column, method: Column) -> Column:
    return F.when(method == "skip_core", F.lit(None)).otherwise(F.coalesce(judge, F.when(correct, 1.0).when(~correct, 0.0))).cast("double")


def token_budget(qtype: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in TOKEN_BUDGET.items() for x in kv))
    return F.coalesce(table[qtype], table["default"])


def short_hash(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def largest_remainder(shares: dict[str, float], total: int) -> dict[str, int]:
    """Whole parts of ``total`` by share; spare units go to the largest fractions, earlier keys first."""
    exact = {k: round(v * total, 9) for k, v in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: -(exact[k] - out[k]))[: max(0, total - sum(out.values()))]:
        out[k] += 1
    return out


def share_split(standard: int, adversarial: int, size: int) -> tuple[int, int]:
    """A batch's standard and adversarial parts, in proportion, rounded half to even and kept within both totals."""
    both = standard + adversarial
    if not both or not size:
        return 0, 0
    std = min(standard, round(size * standard / both))
    adv = min(adversarial, size - std)
    return min(standard, size - adv), adv
