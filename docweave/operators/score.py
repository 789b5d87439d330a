"""Scores: findings by code, category scores with caps and escalation, and the total."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .governance import NON_SUPPRESSIBLE

# Points of each code by category; codes that aren't listed cost nothing.
PENALTIES = {
    "structural": {"Z101": 8.0, "Z102": 5.0, "Z103": 2.0, "Z104": 8.0, "Z105": 2.0, "Z107": 1.0, "Z108": 1.0, "Z109": 3.0, "Z113": 2.0, "Z121": 1.0, "Z124": 1.0, "Z410": 5.0, "Z411": 5.0},
    "navigation": {"Z301": 4.0, "Z302": 1.0, "Z303": 3.0, "Z401": 0.0, "Z402": 4.0},
    "content": {
        "Z120": 1.0, "Z122": 1.0, "Z403": 1.0, "Z501": 2.0, "Z502": 1.0, "Z503": 10.0, "Z505": 1.0, "Z506": 5.0, "Z510": 1.0, "Z511": 1.0,
        "Z512": 1.0, "Z513": 2.0, "Z514": 2.0, "Z515": 1.0, "Z516": 5.0, "Z517": 1.0, "Z518": 1.0, "Z519": 1.0, "Z520": 2.0,
    },
    "brand": {
        "Z404": 3.0, "Z405": 3.0, "Z406": 2.0, "Z601": 2.0, "Z603": 1.0, "Z610": 3.0, "Z611": 3.0, "Z612": 3.0, "Z613": 5.0,
        "Z614": 5.0, "Z615": 3.0, "Z616": 8.0, "Z617": 2.0, "Z618": 3.0, "Z619": 4.0, "Z620": 1.0,
    },
}
CAPS = {"structural": 30.0, "navigation": 25.0, "content": 20.0, "brand": 25.0}
#: Governance findings (Z6xx) beyond this many double the brand deduction every five.
ESCALATES_FROM, DOUBLES_EVERY = 10, 5.0
#: Most points while the brand bucket is empty.
GRAVITY_CAP = 70.0


def code_table(spark: SparkSession) -> DataFrame:
    """(code, category, penalty): a dimension of fixed size."""
    return spark.createDataFrame([(c, k, p) for k, codes in PENALTIES.items() for c, p in codes.items()], "code string, category string, penalty double")


def findings_by_code(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count("*").alias("n"))


def category_scores(counts: DataFrame) -> DataFrame:
    """(category, issues, deduction, category_score, contribution) of the four categories, from (code, n).

    The inputs are one row a code, so this is a handful of rows after the count.
    """
    spark = counts.sparkSession
    codes = F.broadcast(code_table(spark))
    per = counts.join(codes, "code").groupBy("category").agg(F.sum("n").alias("issues"), F.sum(F.col("n") * F.col("penalty")).alias("raw"))
    six = counts.agg(F.coalesce(F.sum(F.when(F.startswith("code", F.lit("Z6")), F.col("n"))), F.lit(0)).alias("governance"))
    caps = spark.createDataFrame(list(CAPS.items()), "category string, cap double")
    rows = caps.join(per, "category", "left").fillna(0, ["issues", "raw"]).crossJoin(F.broadcast(six))
    raised = F.when((F.col("category") == "brand") & (F.col("governance") > ESCALATES_FROM), F.col("raw") * F.pow(F.lit(2.0), F.least((F.col("governance") - ESCALATES_FROM) / DOUBLES_EVERY, F.lit(500.0)))).otherwise(F.col("raw"))
    rows = rows.withColumn("deduction", raised).withColumn("points", F.greatest(F.lit(0.0), F.col("cap") - F.col("deduction")))
    return rows.select("category", F.col("issues").cast("long").alias("issues"), "points", F.round(F.col("points") / F.col("cap"), 4).alias("category_score"), F.round(F.col("points") / 100, 4).alias("contribution"))


def total_score(counts: DataFrame, suppressions: int = 0) -> DataFrame:
    """One row (score, suppressions): banker's rounding; any security finding makes it 0, an empty brand bucket caps it."""
    scores = category_scores(counts).agg(F.sum("points").alias("total"), F.max(F.when(F.col("category") == "brand", F.col("category_score"))).alias("brand"))
    security = counts.agg(F.coalesce(F.max(F.col("code").isin(NON_SUPPRESSIBLE) & (F.col("n") > 0)), F.lit(False)).alias("security"))
    total = F.when(F.col("brand") == 0, F.least("total", F.lit(GRAVITY_CAP))).otherwise(F.col("total")) - suppressions
    score = F.when(F.col("security"), F.lit(0.0)).otherwise(F.bround(F.greatest(F.lit(0.0), total)))
    return scores.crossJoin(security).select(score.cast("int").alias("score"), F.lit(suppressions).alias("suppressions"))


def debt_status(n, cap: int = 30, usual: int = 30):
    """CLEAN without suppressions, CRITICAL beyond the cap, EXTENDED within a cap above the usual one, else MANAGED."""
    return F.when(n <= 0, "CLEAN").when(n > cap, "CRITICAL").otherwise(F.lit("EXTENDED" if cap > usual else "MANAGED"))


def suppression_hotspots(directives: DataFrame, top: int = 5) -> DataFrame:
    """The documents with the most directives; the limit is the feature (a top-k report)."""
    return directives.groupBy("doc_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_path").limit(top)


def severity_summary(findings: DataFrame) -> DataFrame:
    """One row of how many errors, warnings and notes."""
    return findings.agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("error", "warning", "note")])


def exit_code(findings: DataFrame, strict: bool = False) -> DataFrame:
    """One row: 3 for path incidents, else 2 for breaches, else 1 for errors (or warnings if strict), else 0."""
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    failing = F.col("severity").isin(["error", "warning"] if strict else ["error"])
    return findings.agg(F.when(has(F.col("code") == "Z203"), 3).when(has(F.col("code").isin(["Z201", "Z204"])), 2).when(has(failing), 1).otherwise(0).alias("exit_code"))


def score_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(category, score_now, score_before, delta) of two tables of category scores."""
    return now.select("category", F.col("category_score").alias("score_now")).join(before.select("category", F.col("category_score").alias("score_before")), "category", "left").withColumn(
        "delta", F.round(F.col("score_now") - F.coalesce("score_before", F.lit(0.0)), 4)
    )
