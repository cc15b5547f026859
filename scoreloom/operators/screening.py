"""Questionnaire decoding, eligibility verdicts and their summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import tables as TB
from scoreloom.functions.scalars import norm_option
from scoreloom.functions.stats import wilson_ci
from scoreloom.operators.quantiles import upper_median

UNRECOGNISED = "__unrecognised__"


@dataclass(frozen=True)
class Criteria:
    """Eligibility rule: which answers are needed, which are acceptable, which are correct or fictitious."""

    required: Sequence[str] = ("q_hearing", "q_device", "q_prod", "q_prod_years", "q_know1", "q_know2", "q_know3", "s_bogus")
    hearing: Sequence[str] = ("normal",)
    device: Sequence[str] = ("over_ear", "in_ear", "tws")
    prod: Sequence[str] | None = ("lt1", "y1_2", "y2_3", "y3_5", "y5_10", "gt10")
    min_years: int = 0
    know: dict[str, str] = field(default_factory=lambda: {"q_know1": "ratio", "q_know2": "send", "q_know3": "lufs"})
    min_know: int = 2
    bogus: dict[str, str] = field(default_factory=lambda: {"q_know1": "harmonic_gate", "s_bogus": "fake_verrian"})
    multi: Sequence[str] = ("s_bogus",)
    attention: tuple[str, str] | None = None


def decode_choice(answers: DataFrame, question: str, options: DataFrame) -> DataFrame:
    """Code or label to code through a join on the normalised key; unknown non-empty values are kept apart.

    ``options`` (code, label) is the answer catalogue of one question.
    """
    keys = options.select(F.explode(F.array("code", "label")).alias("k"), "code").select(
        norm_option("k").alias("__k"), "code").where(F.col("__k") != "").distinct()
    text = F.nullif(F.trim(F.col(question).cast("string")), F.lit(""))
    out = answers.withColumns({"__t": text, "__k": norm_option(text)}).join(F.broadcast(keys), "__k", "left")
    return out.withColumn("unknown", F.when(F.col("code").isNull(), F.col("__t"))).drop("__k", "__t", question)


def _is_missing(q: str, multi: Sequence[str]) -> Column:
    return F.col(q).isNull() | ((F.size(F.col(q)) == 0) if q in multi else F.lit(False))


def _no(test: Column) -> Column:
    return ~F.coalesce(test, F.lit(False))


def years_inconsistent(band: str | Column, years: str | Column) -> Column:
    """Whole-number answer outside the range of the chosen band."""
    band = F.col(band) if isinstance(band, str) else band
    years = F.col(years) if isinstance(years, str) else years
    out = None
    for code, lo, hi in TB.YEAR_BANDS:
        test = ~((years >= lo) & (years < hi))
        out = F.when(band == code, test) if out is None else out.when(band == code, test)
    return F.coalesce(out, F.lit(False))


def classify_eligibility(answers: DataFrame, criteria: Criteria = Criteria()) -> DataFrame:
    """Add every failed criterion, the first reason, and the recorded flags to decoded answers."""
    c = criteria
    need = list(c.required) + ([c.attention[0]] if c.attention else [])
    missing = F.filter(F.array(*[F.when(_is_missing(q, c.multi), F.lit(q)) for q in need]), lambda q: q.isNotNull())
    know = sum((F.coalesce((F.col(q) == a).cast("int"), F.lit(0)) for q, a in c.know.items()), F.lit(0))
    hits = F.filter(F.array(*[
        F.when(F.array_contains(F.col(q), a) if q in c.multi else F.col(q) == a, F.lit(q))
        for q, a in c.bogus.items() if q in answers.columns]), lambda q: q.isNotNull())
    years_ok = F.coalesce(F.col("q_prod_years") >= c.min_years, F.lit(False))
    if c.prod is not None:
        years_ok = years_ok & F.coalesce(F.col("q_prod").isin(*c.prod), F.lit(False))
    out = answers.withColumns({"missing": missing, "n_know_correct": know, "bogus_hits": hits})
    tests = {
        "missing_data": F.size("missing") > 0,
        "fail_hearing": _no(F.col("q_hearing").isin(*c.hearing)),
        "fail_device": _no(F.col("q_device").isin(*c.device)),
        "fail_years": ~years_ok,
        "fail_knowledge": F.col("n_know_correct") < c.min_know,
        "fail_bogus": F.size("bogus_hits") > 0,
    }
    if c.attention:
        tests["fail_attention"] = _no(F.col(c.attention[0]) == c.attention[1])
    fails = F.filter(F.array(*[F.when(tests[r], F.lit(r)) for r in TB.REASON_ORDER if r in tests]), lambda r: r.isNotNull())
    out = out.withColumn("fails", fails)
    inconsistent = years_inconsistent("q_prod", "q_prod_years") if "q_prod" in answers.columns else F.lit(False)
    return out.withColumns({"reason": F.get("fails", F.lit(0)), "eligible": F.size("fails") == 0,
                            "inconsistent_years": inconsistent})


def app_eligibility(answers: DataFrame, options: dict[str, Sequence[tuple[str, str]]],
                    criteria: Criteria = Criteria()) -> DataFrame:
    """Verdict from raw in-app answers: no fictitious-item question, and an answer to a knowledge question that
    matches no option is wrong rather than missing."""
    from dataclasses import replace
    from scoreloom.functions.scalars import decode_single, parse_years
    decoded = answers
    for q in criteria.required:
        if q == "s_bogus":
            continue
        if q == "q_prod_years":
            decoded = decoded.withColumn(q, parse_years(q))
            continue
        d = decode_single(q, options[q])
        code = F.coalesce(d["code"], F.when(d["unknown"].isNotNull(), UNRECOGNISED)) if q in criteria.know else d["code"]
        decoded = decoded.withColumn(q, code)
    app = replace(criteria, required=[q for q in criteria.required if q != "s_bogus"],
                  bogus={q: a for q, a in criteria.bogus.items() if q != "s_bogus"}, attention=None)
    return classify_eligibility(decoded, app)


def answer_distribution(answers: DataFrame, question: str, multi: bool = False) -> DataFrame:
    """Counts per answer; multi-select answers are counted one by one, null as ``(missing)``."""
    rows = answers.select((F.explode_outer(question) if multi else F.col(question)).alias("answer"))
    return rows.groupBy(F.coalesce(F.col("answer").cast("string"), F.lit("(missing)")).alias("answer")).agg(F.count("*").alias("n"))


def missing_by_question(answers: DataFrame, questions: Sequence[str], multi: Sequence[str] = ()) -> DataFrame:
    def absent(q: str) -> Column:
        if q in multi:
            return _is_missing(q, multi)
        return F.coalesce(F.trim(F.col(q).cast("string")), F.lit("")) == ""
    one = answers.agg(*[F.count_if(absent(q)).alias(q) for q in questions])
    return one.unpivot([], list(questions), "question", "n_missing")


def fail_waterfall(verdicts: DataFrame) -> DataFrame:
    """Per reason: how often it came first and how often it applied at all."""
    rows = verdicts.select("reason", F.explode("fails").alias("fail"))
    return rows.groupBy(F.col("fail").alias("criterion")).agg(
        F.count_if(F.col("reason") == F.col("fail")).alias("n_first"), F.count("*").alias("n_any"))


def eligibility_summary(rows: DataFrame, verdicts: DataFrame, ident: str = "pid", years: str = "q_prod_years",
                        duration: str | None = None) -> DataFrame:
    """One row: row and id counts, eligible rate with Wilson interval, flags and years of the eligible.

    ``rows`` are the raw submissions, ``verdicts`` the classified first submission per id plus all blank ids.
    """
    blank = F.coalesce(F.trim(F.col(ident).cast("string")), F.lit("")) == ""
    raw = rows.agg(F.count("*").alias("n_rows"))
    y = F.when(F.col("eligible"), F.col(years))
    out = verdicts.agg(
        F.count("*").alias("n_unique"), F.count_if(blank).alias("n_blank_id"),
        F.count_if("eligible").alias("n_eligible"), F.count_if(F.col("eligible") & blank).alias("n_eligible_without_id"),
        F.count_if(F.size("bogus_hits") > 0).alias("n_bogus_any"), F.count_if("inconsistent_years").alias("n_inconsistent_years"),
        F.count(y).alias("years_n"), F.avg(y).alias("years_mean"),
        F.coalesce(F.stddev_samp(y), F.when(F.count(y) > 0, 0.0)).alias("years_sd"),
        F.min(y).alias("years_min"), F.max(y).alias("years_max"))
    out = raw.join(F.broadcast(out), F.lit(True))
    ci = wilson_ci("n_eligible", "n_unique")
    out = out.withColumns({
        "n_duplicate_ids": F.col("n_rows") - F.col("n_unique"),
        "eligible_rate": F.when(F.col("n_unique") > 0, F.col("n_eligible") / F.col("n_unique")).otherwise(0.0),
        "ci_lo": ci["lo"], "ci_hi": ci["hi"]})
    if duration:
        med = upper_median(verdicts, [], duration, "median_duration_sec")
        fast = verdicts.join(F.broadcast(med), F.lit(True)).agg(
            F.first("median_duration_sec").alias("median_duration_sec"),
            F.count_if(F.col(duration) < 0.4 * F.col("median_duration_sec")).alias("n_speeders"))
        out = out.join(F.broadcast(fast), F.lit(True))
    return out


def eligibility_audit(recheck: DataFrame, client: DataFrame, ident: str = "pid") -> DataFrame:
    """Cross-check of re-judged answers with the verdict the client saw, as counts."""
    r = recheck.select(ident, F.col("eligible").alias("__r"), F.lit(True).alias("__judged"))
    c = client.select(ident, F.col("client_eligible").alias("__c"), F.coalesce("provisional", F.lit(False)).alias("__p"),
                      F.lit(True).alias("__seen"))
    j = r.join(c, ident, "full_outer")
    judged = F.coalesce("__judged", F.lit(False))
    return j.agg(F.count_if(judged & F.col("__r").isNotNull()).alias("n_judged"),
                 F.count_if(~F.col("__r")).alias("n_ineligible_on_recheck"),
                 F.count_if(F.coalesce("__p", F.lit(False))).alias("n_provisional_pass"),
                 F.count_if(~F.col("__r") & F.col("__c")).alias("n_client_passed_but_ineligible"),
                 F.count_if(judged & F.col("__seen").isNull()).alias("n_no_elig_record"))
