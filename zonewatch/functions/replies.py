"""Scores from free-text model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Reply openings that count as a bare yes, and the inline marker.
YES_STARTS = ["yes", "true", "có rác", "co rac"]
INLINE_YES = '"litter": true'
# JSON tokens that count as false in the reply's `litter` field.
FALSY = ["false", "0", "0.0", "-0", "-0.0", '""', "null", "[]", "{}"]
# Fixed value: decoration skipped before a bare yes.
DECORATION = "*_# \n\t\"'"


def parse_replies(df: DataFrame, text: str, score: str = "score", note: str = "note") -> DataFrame:
    """Adds (score, note) of the replies in a column.

    The text from the first to the last brace is read as JSON: the truth of `litter`
    decides and `confidence` (clamped to 0..1; by default 1 for a hit, else 0) grades.
    Without usable JSON a reply that opens with a yes word scores 1, any other 0.
    """
    # each step is a column of its own, so that a reply is parsed once
    df = df.withColumn("_body", F.trim(text, F.lit(" \n\t\r")))
    df = df.withColumn("_doc", F.try_parse_json(F.nullif(F.regexp_extract("_body", r"(?s)\{.*\}", 0), F.lit(""))))
    token = lambda path: F.to_json(F.try_variant_get("_doc", path, "variant"))
    df = df.withColumns({"_litter": token("$.litter"), "_given": token("$.confidence"),
                         "_what": F.coalesce(F.try_variant_get("_doc", "$.what", "string"), F.lit(""))})
    given, hit = F.col("_given"), F.coalesce(~F.col("_litter").isin(FALSY), F.lit(False))
    value = (F.when(given == "true", 1.0).when(given == "false", 0.0)
             .otherwise(F.trim(given, F.lit('" ')).try_cast("double")))
    df = df.withColumns({"_hit": hit, "_conf": F.when(given.isNull(), F.when(hit, 1.0).otherwise(0.0)).otherwise(value),
                         "_low": F.ltrim(F.lower("_body"), F.lit(DECORATION))})
    yes = F.col("_low").contains(INLINE_YES)
    for word in YES_STARTS:
        yes = yes | F.col("_low").startswith(word)
    usable = F.col("_doc").isNotNull() & F.col("_conf").isNotNull()
    conf = F.least(F.greatest("_conf", F.lit(0.0)), F.lit(1.0))
    graded = F.when(usable & F.col("_hit"), conf).when(usable, 1.0 - conf).when(yes, 1.0).otherwise(0.0)
    said = (F.when(usable, F.substring("_what", 1, 40)).when(yes, F.lit("unparsed-yes"))
            .otherwise(F.concat(F.lit("unparsed: "), F.substring("_body", 1, 30))))
    return df.withColumns({score: graded, note: said}).drop("_body", "_doc", "_litter", "_given", "_what", "_hit", "_conf", "_low")
