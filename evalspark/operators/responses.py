"""Response job (L11-L17): parse free-text answers back to aligned predictions.

Answer lines are extracted with ``regexp_extract_all`` (JVM regex, no Python), matched
against the unit's class list by a tiered join, and missing rows fall back to the
majority class; units with too many unparsed rows are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import JVM_ROW_PATTERN, PROB_PATTERN
from ..session import small_side

REQ = ["seed", "key", "model", "chunk"]
UNIT = ["seed", "key", "model"]


def answer_lines(responses: DataFrame, keys=REQ, text: str = "text", keep=()) -> DataFrame:
    """All ``(index, body)`` answer lines in order: (keys, keep, line_no, idx, body)."""
    keys = list(keys)
    z = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(JVM_ROW_PATTERN), 1).alias("i"),
                     F.regexp_extract_all(F.col(text), F.lit(JVM_ROW_PATTERN), 2).alias("b"))
    return (responses.select(*keys, *keep, F.posexplode(z).alias("line_no", "m"))
            .select(*keys, *keep, "line_no", F.col("m.i").try_cast("int").alias("idx"),
                    F.col("m.b").alias("body")))


def match_class(lines: DataFrame, classes: DataFrame, keys=REQ) -> DataFrame:
    """Tier 1 exact, 2 case-insensitive, 3 whole word (longest label first).

    ``classes``: (seed, key, token) — the prompt-space labels of the unit; the class list is
    small, so the candidate join is lines × classes of the same unit.
    """
    keys = list(keys)
    ck = [k for k in keys if k in classes.columns]
    j = lines.join(small_side(classes, "classes"), ck)
    # strip every kind of surrounding whitespace (Python's str.strip), not only spaces
    body, tok = F.regexp_replace(F.col("body"), r"^\s+|\s+$", ""), F.col("token")
    # a label that holds the end mark of a quotation is quoted in pieces around it
    quoted = F.replace(tok, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    word = F.concat(F.lit("(?i)\\b\\Q"), quoted, F.lit("\\E\\b"))
    tier = (F.when(body == tok, 1).when(F.lower(body) == F.lower(tok), 2)
            .when(F.regexp_like(F.col("body"), word), 3))
    c = j.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    w = Window.partitionBy(*keys, "line_no").orderBy("tier", F.length("token").desc(), "token")
    return c.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "tier")


def parse_answers(responses: DataFrame, classes: DataFrame, keys=REQ, n_col: str = "n_rows") -> DataFrame:
    """Lines with an index in 1..n whose body names a class; first line per index wins."""
    keys = list(keys)
    lines = answer_lines(responses, keys, keep=(n_col,)).filter((F.col("idx") >= 1) & (F.col("idx") <= F.col(n_col)))
    m = match_class(lines, classes, keys)
    w = Window.partitionBy(*keys, "idx").orderBy("line_no")
    return (m.withColumn("__r", F.row_number().over(w)).filter("__r = 1")
            .select(*keys, "idx", "token", "body"))


def parse_confidence(parsed: DataFrame) -> DataFrame:
    """Add ``p`` = the line's ``p=`` confidence in [0, 1], else NULL."""
    raw = F.regexp_extract(F.col("body"), PROB_PATTERN, 1)
    v = F.when(raw != "", raw).try_cast("double")
    return parsed.withColumn("p", F.when((v >= 0) & (v <= 1), v))


def fallback_majority(rows: DataFrame, parsed: DataFrame, majority: DataFrame, keys=REQ) -> DataFrame:
    """Every requested row gets its parsed class or the unit's majority token.

    ``rows``: (keys, row_in_chunk, row_id); ``majority``: (seed, key, majority token).
    """
    keys = list(keys)
    j = (rows.join(parsed.withColumnRenamed("idx", "row_in_chunk"), keys + ["row_in_chunk"], "left")
         .join(small_side(majority, "majority"), [k for k in keys if k in majority.columns]))
    return j.select(*keys, "row_in_chunk", "row_id", F.coalesce("token", "majority").alias("token"),
                    F.col("token").isNull().alias("unparsed"), "p")


def unit_stats(pred_rows: DataFrame, requests: DataFrame, keys=UNIT) -> DataFrame:
    """Per unit: calls, rows, unparsed rows and fraction."""
    keys = list(keys)
    calls = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("llm_api_calls"))
    u = pred_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"),
                                     F.count_if("unparsed").alias("llm_unparsed"))
    return (u.join(calls, keys)
            .withColumn("llm_unparsed_frac", F.round(F.col("llm_unparsed") / F.col("n_test"), 9)))


def unparsed_ceiling(stats: DataFrame, max_frac: float = 0.2) -> DataFrame:
    """Units whose unparsed fraction exceeds the ceiling become failed status rows."""
    return stats.filter(F.col("llm_unparsed") / F.col("n_test") > max_frac).select(
        *UNIT, F.lit("fail").alias("status"), F.lit("unparseable_responses").alias("reason"),
        F.format_string("%d/%d test rows had no parseable class label", F.col("llm_unparsed"),
                        F.col("n_test")).alias("error"))


def proba_long(pred_rows: DataFrame, codec: DataFrame, keys=REQ) -> DataFrame:
    """Per row and class: one-hot when p is NULL or k < 2; else the predicted class gets
    clamp(p, 1/k, 1) and the others share the rest uniformly."""
    keys = list(keys)
    k = codec.groupBy("seed", "key").agg(F.count(F.lit(1)).alias("k"))
    j = pred_rows.join(small_side(codec.select("seed", "key", F.col("token").alias("cls_token"), "cls").join(k, ["seed", "key"]), "codec"),
                       ["seed", "key"])
    hit = F.col("cls_token") == F.col("token")
    pc = F.least(F.greatest(F.col("p"), 1.0 / F.col("k")), F.lit(1.0))
    prob = (F.when(F.col("p").isNull() | (F.col("k") < 2), F.when(hit, 1.0).otherwise(0.0))
            .when(hit, pc).otherwise((1 - pc) / (F.col("k") - 1)))
    return j.select(*keys, "row_id", "cls", prob.alias("prob"))


def identity_check(answered: DataFrame, requested: str = "requested", returned: str = "returned") -> DataFrame:
    """A response is accepted when the returned model id is blank or either id contains
    the other (lowercased, provider prefix dropped from the requested id)."""
    req = F.lower(F.element_at(F.split(F.col(requested), "/"), -1))
    ret = F.lower(F.coalesce(F.col(returned), F.lit("")))
    return answered.withColumn("identity_ok", (ret == "") | (F.instr(ret, req) > 0)
                               | (F.instr(req, ret) > 0))
