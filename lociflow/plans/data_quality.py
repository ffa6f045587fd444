"""Queries of problems 1 (rows that fail to parse) and 3 (keys that hold most rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociflow.operators import heavy_keys, malformed
from lociflow.session import table


def p1_found(spark, sf_dir):
    return malformed.rejected_lines(table(spark, sf_dir, "read_lines"))


def p1_reads(spark, sf_dir):
    return malformed.typed_reads(table(spark, sf_dir, "read_lines"))


def p1_report(spark, sf_dir):
    return malformed.reject_report(table(spark, sf_dir, "read_lines"))


def p1_edits(spark, sf_dir):
    parsed = malformed.parse_lines(table(spark, sf_dir, "read_lines"))
    return parsed.filter("reason in ('quoting', 'columns')").select("line_id", "reason", "quote_edits", "delimiter_edits", "edits")


def _known_mapq():
    """255 stands for a mapping quality that is not available."""
    return F.when(F.col("mapq") != 255, F.col("mapq"))


def p3_found(spark, sf_dir):
    records, placed = table(spark, sf_dir, "sam_records"), table(spark, sf_dir, "alignments")
    of = lambda df, key: heavy_keys.heavy_keys(df, key, _known_mapq()).select(
        F.lit(key).alias("field_name"), F.col("key").alias("key_value")
    )
    return of(records, "reference_id").unionByName(of(placed, "pos"))


def _stats(df, key):
    return heavy_keys.keyed_stats(df, key, _known_mapq()).select(
        F.lit(key).alias("field_name"),
        F.col("key").alias("key_value"),
        F.col("n").alias("n_rows"),
        F.col("n_value").alias("n_mapq"),
        F.round("mean_value", 6).alias("mean_mapq"),
        F.col("lowest").alias("min_mapq"),
        F.col("highest").alias("max_mapq"),
    )


def p3_reference_stats(spark, sf_dir):
    return _stats(table(spark, sf_dir, "sam_records"), "reference_id")


def p3_pos_stats(spark, sf_dir):
    return _stats(table(spark, sf_dir, "alignments"), "pos")


_CELL = r'(?:"(?:[^"]|"")*"|[^",]*)'
_LINE = f"(?s)^{_CELL}(?:,{_CELL})*$"
_SIX = f"(?s)^{_CELL}(?:,{_CELL}){{5}}$"
_GROUPS = "(?s)^" + ",".join(["(" + _CELL + ")"] * 6) + "$"

_EACH = ", ".join(f"regexp_extract(b, '{_GROUPS}', {i})" for i in range(1, 7))

_PARSED = rf"""
with body as (
  select line_id, file_id as delivery, case when raw_line like '%' || chr(13) then raw_line[:-2] else raw_line end as b from read_lines
), split as (
  select *, case when regexp_matches(b, '{_SIX}') then
    [case when x like '"%' then replace(x[2:-2], '""', '"') else x end for x in [{_EACH}]] end as c
  from body
), parsed as (
  select *, case
    when b is null or b = '' then 'columns'
    when not regexp_matches(b, '{_LINE}') then 'quoting'
    when c is null then 'columns'
    when not regexp_full_match(c[1], '[0-9]{{1,18}}') or regexp_full_match(c[1], '0+') or c[2] not in ('1', '2')
      or not regexp_full_match(c[3], '[0-9]{{1,18}}') or not regexp_full_match(c[4], '[!-~]{{1,254}}')
      or not regexp_full_match(c[5], '[ACGTNacgtn.]+') or not regexp_full_match(c[6], '[!-~]+') or length(c[5]) <> length(c[6]) then 'value'
    end as reason
  from split
)"""


def _stats_sql(name, key):
    return f"""select '{key}' as field_name, cast({key} as bigint) as key_value, count(*) as n_rows,
      count(case when mapq <> 255 then 1 end) as n_mapq, round(avg(case when mapq <> 255 then mapq end), 6) as mean_mapq,
      cast(min(case when mapq <> 255 then mapq end) as bigint) as min_mapq, cast(max(case when mapq <> 255 then mapq end) as bigint) as max_mapq
    from {name} group by {key}"""


def _found_sql(name, key):
    return f"""select '{key}' as field_name, cast({key} as bigint) as key_value from {name}
    where {key} is not null group by {key} having count(*) * 20 >= (select count(*) from {name})"""


QUERIES = {
    "p1_found": p1_found,
    "p1_reads": p1_reads,
    "p1_report": p1_report,
    "p1_edits": p1_edits,
    "p3_found": p3_found,
    "p3_reference_stats": p3_reference_stats,
    "p3_pos_stats": p3_pos_stats,
}

SQL = {
    "p1_found": f"{_PARSED} select line_id, reason from parsed where reason is not null",
    "p1_reads": f"""{_PARSED} select line_id, cast(c[1] as bigint) as file_id, cast(c[2] as tinyint) as mate, cast(c[3] as bigint) as read_idx,
      c[4] as name, c[5] as seq, c[6] as qual from parsed where reason is null""",
    "p1_report": f"""{_PARSED} select delivery as file_id, count(*) as lines, count(*) filter (reason is null) as loaded,
      count(*) filter (reason = 'quoting') as bad_quoting, count(*) filter (reason = 'columns') as bad_columns,
      count(*) filter (reason = 'value') as bad_value from parsed group by delivery""",
    "p3_found": _found_sql("sam_records", "reference_id") + " union all " + _found_sql("alignments", "pos"),
    "p3_reference_stats": _stats_sql("sam_records", "reference_id"),
    "p3_pos_stats": _stats_sql("alignments", "pos"),
}
