"""Functions of the engine for SQL text: temporary SQL functions, and aggregates over groups.

The scalar ones are SQL expressions that the optimizer inlines, so they run like built-in ones.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FUNCTIONS = {
    "norm_chrom(x STRING) RETURNS STRING": "case when contains(upper(x), 'CHR') then substr(upper(x), 4) else upper(x) end",
    "reverse_complement(x STRING) RETURNS STRING": "translate(reverse(x), 'ACGTacgt', 'TGCAtgca')",
    "plain_read_name(x STRING) RETURNS STRING": r"case when length(x) > 2 then regexp_replace(x, '[/\\\\][12]\\z', '') else x end",
    "phred(p DOUBLE) RETURNS DOUBLE": "-10 * log10(p)",
    "phred_probability(q DOUBLE) RETURNS DOUBLE": "pow(10D, -q / 10)",
    "count_bases(x STRING, letters STRING) RETURNS INT": "length(x) - length(translate(upper(x), upper(letters), ''))",
    "reference_length(cigar ARRAY<STRUCT<len: INT, op: STRING>>) RETURNS INT": "aggregate(cigar, 0, (a, c) -> a + if(c.op in ('M', 'D', 'N', '=', 'X'), c.len, 0))",
    "flag_set(flag INT, bit INT) RETURNS BOOLEAN": "(flag & bit) <> 0",
}


@F.pandas_udf(T.StringType())
def majority_base(bases: pd.Series) -> str:
    """The base that most reads of a group have; the first in the alphabet on a tie, N without one."""
    known = bases[bases.isin(list("ACGT"))]
    return min(known.value_counts().items(), key=lambda x: (-x[1], x[0]))[0] if len(known) else "N"


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("majority_base", majority_base)
    return [head.partition("(")[0] for head in FUNCTIONS] + ["majority_base"]
