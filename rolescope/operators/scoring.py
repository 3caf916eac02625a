"""Rule scores, tiers, and the comparison of rule and model scores."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.functions.words import contains_any, found, let, or_empty, unicode_regex
from rolescope.operators.filters import excluded_description
from rolescope.rules import Rules

# Tier names, weakest first.
WEAK, MATCH, STRONG = "Weak Match", "Match", "Strong Match"


def _total(parts) -> Column:
    return functools.reduce(operator.add, parts, F.lit(0))


def _points(test: Column, points: int) -> Column:
    return F.when(test, points).otherwise(0)


def keyword_score(low: Column, rules: Rules) -> Column:
    """Points of every pattern, word pair and role word found in a lower-cased description."""
    return _total(
        [_points(found(low, pattern), points) for pattern, points in rules.keywords]
        + [_points(low.contains(a) & low.contains(b), points) for (a, b), points in rules.combos]
        + [_points(found(low, pattern), points) for pattern, points in rules.role_words]
    )


def level_bonus(title: Column, rules: Rules) -> Column:
    low = F.lower(title)
    hit = low.rlike(unicode_regex(rules.level_pattern)) | contains_any(low, rules.level_words)
    return _points(hit, rules.level_points)


def company_bonus(company: Column, rules: Rules) -> Column:
    return _points(contains_any(F.lower(company), rules.top_companies), rules.company_points)


def tier(score: Column, rules: Rules) -> Column:
    """Null scores have no tier."""
    return (
        F.when(score >= rules.strong, STRONG).when(score >= rules.match, MATCH)
        .when(score.isNotNull(), WEAK)
    )


def read_description(df: DataFrame, rules: Rules, keep_text: bool = False) -> DataFrame:
    """Everything the rules want from the long text, as two narrow columns.

    Done right at the scan, this lets deduplication, joins and aggregates run without the text.
    """
    # The lower-cased text gets its own projection, so it is computed once for all patterns.
    low = df.withColumn("_low", F.lower(or_empty(F.col("description"))))
    read = low.withColumns({
        "text_score": keyword_score(F.col("_low"), rules),
        "text_excluded": contains_any(F.col("_low"), rules.exclude_descriptions),
    }).drop("_low")
    return read if keep_text else read.drop("description")


def scored(df: DataFrame, rules: Rules) -> DataFrame:
    """Add score and tier. Uses ``text_score`` when the text was read before, else the description."""
    if "text_score" not in df.columns:
        df = read_description(df, rules, keep_text=True)
    total = F.col("text_score") + level_bonus(F.col("title"), rules) + company_bonus(F.col("company"), rules)
    return df.withColumn("score", total).withColumn("tier", tier(F.col("score"), rules))


def text_passes(df: DataFrame, rules: Rules) -> Column:
    if "text_excluded" in df.columns:
        return ~F.col("text_excluded")
    return ~excluded_description(F.col("description"), rules)


def model_scale(fit: Column) -> Column:
    """Model fit 1-10 on the rule scale: 0, 2, 4, 6, 7, 9, 12, 13, 19, 24. Halves round to even."""
    return (
        F.when(fit >= 8, 13 + F.bround((fit - 8) * F.lit(5.5)))
        .when(fit >= 5, 7 + F.bround((fit - 5) * F.lit(2.5)))
        .when(fit.isNotNull(), F.greatest(F.lit(0), (fit - 1) * 2))
        .cast("int")
    )


def tier_rank(name: Column) -> Column:
    return F.when(name == STRONG, 2).when(name == WEAK, 0).otherwise(1)


def verdict(model_tier: Column, rule_tier: Column) -> Column:
    """agree, promoted or demoted; fallback where there is no model tier."""
    return (
        F.when(model_tier.isNull(), "fallback")
        .when(tier_rank(model_tier) == tier_rank(rule_tier), "agree")
        .when(tier_rank(model_tier) > tier_rank(rule_tier), "promoted")
        .otherwise("demoted")
    )
