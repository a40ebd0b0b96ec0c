"""Pattern scans over texts: unsupported assertions clause by clause, and credential shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import count_where, strip
from ..functions.shapes import stacked

# Clause separators, assertion patterns, hedges and credential shapes.
CLAUSE_BREAK = r"(?i)[.;\n]|\b(?:but|however|yet)\b"
ASSERTIONS = (
    r"calibration (?:is |has been )?solved",
    r"(?:establishes|demonstrates|proves|identifies) (?:a |the )?causal (?:effect|macro|guarantee)",
    r"(?:strong|stable) transportability",
    r"(?:measures|measured|actual) (?:fiscal costs|public spending|tail risk)",
    r"(?:implements|is an implementation of) (?:IFRS 9|CECL)",
    r"calibration-invariant (?:differences|ratios)",
)
HEDGES = ("not", "no", "neither", "without", "cannot", "rather than", "future", "would", "require", "prohibited")
CREDENTIALS = {
    "code_host_token": r"gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}",
    "api_key": r"sk-(?:proj-)?[A-Za-z0-9_-]{30,}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}


def assertion_scan(texts: DataFrame, key: str, text: str, patterns: Sequence[str] = ASSERTIONS, hedges: Sequence[str] = HEDGES) -> DataFrame:
    """``(key, clause_no, pattern_no, clause)`` for every pattern in a clause without a hedge.

    Clauses are exploded from whole texts; a clause without any match is dropped in the same stage.
    """
    clauses = texts.select(key, F.posexplode(F.split(text, CLAUSE_BREAK)).alias("clause_no", "clause"))
    hedge = r"(?i)\b(?:" + "|".join(hedges) + r")\b"
    hits = F.array_compact(F.array(*[F.when(F.col("clause").rlike(f"(?i){p}"), F.lit(i)) for i, p in enumerate(patterns)]))
    bare = clauses.where(~F.col("clause").rlike(hedge)).withColumn("pattern_no", F.explode(hits))
    return bare.select(key, "clause_no", "pattern_no", strip(F.col("clause")).alias("clause"))


def credential_scan(texts: DataFrame, text: str, patterns: dict[str, str] = CREDENTIALS) -> DataFrame:
    """``(pattern, texts, hits)``; patterns that match nothing stay with zero."""
    counted = texts.select(*[F.regexp_count(text, F.lit(p)).alias(f"_h_{n}") for n, p in patterns.items()])
    wide = counted.agg(*[x for n in patterns for x in (
        count_where(F.col(f"_h_{n}") > 0).alias(f"t_{n}"), F.coalesce(F.sum(f"_h_{n}"), F.lit(0)).cast("long").alias(f"h_{n}"))])
    return stacked(wide, [], ["pattern", "texts", "hits"], [(n, F.col(f"t_{n}"), F.col(f"h_{n}")) for n in patterns])
