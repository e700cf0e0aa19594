"""Audit results: the summary, and the promise that a gap belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round6

#: Statuses of features and verdicts of candidates, as counted.
STATUSES = ("IMPLEMENTED_DOCUMENTED", "IMPLEMENTED_UNDOCUMENTED", "DOCUMENTED_NOT_IMPLEMENTED", "PARTIALLY_IMPLEMENTED", "AMBIGUOUS")
VERDICTS = {"ready_for_delete_validation": "VALIDATION_REQUIRED", "validated_safe_to_delete": "VALIDATED_SAFE_TO_DELETE"}
#: Words that say nothing, and words that stand for others.
STOPWORDS = ("a", "an", "and", "are", "as", "be", "but", "by", "despite", "for", "from", "is", "it", "of", "or", "that", "the", "this", "to", "with")
SYNONYMS = {"customer": "client", "client": "customer", "vehicle": "car", "car": "vehicle", "financial": "income", "report": "statement"}
ABSENCE = r"(?i)\b(?:absent|missing|no|not|unimplemented|unsupported|without)\b"


def summary(features: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of counts over features (status) and dead-code candidates (verdict)."""
    by_status = features.agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES))
    by_verdict = candidates.agg(F.count(F.lit(1)).alias("dead_code_candidates"), *(F.count_if(F.col("verdict") == v).alias(n) for n, v in VERDICTS.items()))
    return by_status.join(by_verdict)  # one row beside one row


def claim_tokens(text: Column) -> Column:
    """Distinct stemmed tokens of three letters or more with their synonyms; none of null."""
    stems = F.transform(
        F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)),
        lambda t: (
            F.when((F.length(t) > 6) & t.endswith("ing"), F.regexp_replace(F.regexp_replace(t, "ing$", ""), "^pars$", "parse"))
            .when((F.length(t) > 5) & t.endswith("ed"), F.regexp_replace(t, "ed$", ""))
            .when((F.length(t) > 3) & t.endswith("s"), F.regexp_replace(t, "s$", ""))
            .otherwise(t)
        ),
    )
    kept = F.filter(stems, lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS))
    named = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    more = F.filter(F.transform(kept, lambda t: F.try_element_at(named, t)), lambda t: t.isNotNull())
    other = F.when(text.rlike(r"(?i)\bnon[-\s]"), F.array(F.lit("other"))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.array_distinct(F.concat(kept, more, other)), F.array().cast("array<string>"))


def best_promise(gaps: DataFrame, promises: DataFrame, least: int = 2, margin: float = 0.05) -> DataFrame:
    """(gap_id, promise_id, score, matched): for each gap (gap_id, text) the promise
    (promise_id, text) with the best score, of those that share ``least`` tokens:
    inverse document frequency, twice the covered share, and four for each token in the
    gap's last clause where that names an absence. No row where the second is within
    ``margin``. Callers filter gaps and promises that take no part beforehand."""
    clause = F.regexp_extract("text", r"(?s)^.*;(.*)$", 1)
    p = promises.select("promise_id", claim_tokens(F.col("text")).alias("tokens")).withColumn("size", F.size("tokens"))
    t = p.select("promise_id", "size", F.explode("tokens").alias("token"))
    n = promises.select(F.count(F.lit(1)).alias("n"))
    weight = t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("w"))
    g = gaps.select("gap_id", claim_tokens(F.col("text")).alias("tokens"), claim_tokens(F.when(clause.rlike(ABSENCE), clause).otherwise(F.col("text"))).alias("focus"))
    g = g.select("gap_id", "focus", F.explode("tokens").alias("token")).select("gap_id", "token", F.array_contains("focus", F.col("token")).cast("int").alias("focused"))
    hits = g.join(weight, "token").join(t, "token").groupBy("gap_id", "promise_id").agg(
        F.sum("w").alias("w"), F.count(F.lit(1)).alias("matched"), F.sum("focused").alias("focused"), F.first("size").alias("size")
    )
    scored = hits.filter(F.col("matched") >= least).withColumn("score", F.col("w") + F.col("matched") / F.col("size") * 2 + F.col("focused") * 4)
    ranked = Window.partitionBy("gap_id").orderBy(F.desc(round6(F.col("score"))), "promise_id")
    ranked_rows = scored.withColumn("rank", F.row_number().over(ranked)).withColumn("second", F.lead("score").over(ranked)).filter("rank = 1")
    return ranked_rows.filter(F.col("second").isNull() | (F.abs(F.col("score") - F.col("second")) >= margin)).select("gap_id", "promise_id", round6(F.col("score")).alias("score"), "matched")
