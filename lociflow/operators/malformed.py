"""Separating lines that cannot be read, with the reason (problem 1).

A line is parsed by a minimum-cost error parse.  The line is reduced to its
tokens (quote, delimiter, run of other characters).  A dynamic program over
``state x cells so far`` walks the tokens and may insert or delete quotes and
delimiters.  The cost is lexicographic: first the edits that repair quoting,
then the edits of delimiters at places where the quoting is sound.

* cost (0, 0): the line is well formed; its cells are then type-checked;
* first part > 0: no reading with sound quoting exists -> ``quoting``;
* only second part > 0: quoting is sound, the number of cells is not -> ``columns``.

Inserting a delimiter after a closing quote or in front of a stray quote would
hide broken quoting, so it counts as a quoting edit.  With that rule a first
part of 0 is possible exactly for lines with sound quoting: deleting or
inserting a delimiter elsewhere never makes an illegal token legal.

Lines without any quote and with the right number of delimiters have cost
(0, 0) by construction and stay in the JVM; only the others go through Arrow.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 6
QUOTING = 1 << 32
START, BARE, INSIDE, CLOSED = range(4)
TOKEN = re.compile(r'"|,|[^",]+')

PARSED = T.StructType(
    [
        T.StructField("cells", T.ArrayType(T.StringType())),
        T.StructField("quote_edits", T.IntegerType()),
        T.StructField("delimiter_edits", T.IntegerType()),
        T.StructField("edits", T.ArrayType(T.StringType())),
    ]
)


def split_sound(line: str) -> list[str] | None:
    """The cells along the zero-cost path, or None where quoting breaks."""
    cells, at, end = [], 0, len(line)
    while True:
        if at < end and line[at] == '"':
            part, at = [], at + 1
            while True:
                close = line.find('"', at)
                if close < 0:
                    return None
                part.append(line[at:close])
                at = close + 1
                if at < end and line[at] == '"':
                    part.append('"')
                    at += 1
                    continue
                break
            cells.append("".join(part))
        else:
            comma = line.find(",", at)
            stop = end if comma < 0 else comma
            cell = line[at:stop]
            if '"' in cell:
                return None
            cells.append(cell)
            at = stop
        if at == end:
            return cells
        if line[at] != ",":
            return None
        at += 1


def error_parse(line: str, cells: int = CELLS) -> tuple[int, int, list[str]]:
    """Least (quoting edits, delimiter edits) and the edits themselves.

    The table is ``4 states x cells`` wide and advances token by token, so time
    is linear in the number of tokens.
    """
    never = 1 << 62
    cost = [never] * (4 * cells + 4)  # of state s after n cells, at 4 * (n - 1) + s
    trail: list[tuple | None] = [None] * len(cost)
    cost[START] = 0

    def insertions(place: int, following: str) -> None:
        """Edits that consume nothing; they only lead on, so one pass over the cells is enough."""
        for at in range(0, 4 * cells, 4):
            for a, b in ((at + START, at + INSIDE), (at + INSIDE, at + CLOSED)):
                if cost[a] + QUOTING < cost[b]:
                    cost[b], trail[b] = cost[a] + QUOTING, (trail[a], "insert quote", place)
            if at + 4 == 4 * cells:
                break
            for state in (START, BARE, CLOSED):
                hides = (state == CLOSED and following == "x") or (state == BARE and following == '"')
                paid = cost[at + state] + (QUOTING if hides else 1)
                if paid < cost[at + 4]:
                    cost[at + 4], trail[at + 4] = paid, (trail[at + state], "insert delimiter", place)

    for token in TOKEN.finditer(line):
        kind, place = token.group()[0], token.start()
        kind = kind if kind in '",' else "x"
        insertions(place, kind)
        then, led = [never] * len(cost), [None] * len(cost)

        def step(a: int, b: int, paid: int, edit: str | None = None) -> None:
            if b < 4 * cells and cost[a] + paid < then[b]:  # noqa: B023
                then[b] = cost[a] + paid  # noqa: B023
                led[b] = (trail[a], edit, place) if edit else trail[a]  # noqa: B023

        for at in range(0, 4 * cells, 4):
            start, bare, inside, closed = range(at, at + 4)
            if kind == '"':
                step(start, inside, 0)
                step(closed, inside, 0)
                step(inside, closed, 0)
                for a in (start, bare, inside, closed):
                    step(a, a, QUOTING, "delete quote")
            elif kind == ",":
                step(inside, inside, 0)
                for a in (start, bare, closed):
                    step(a, at + 4, 0)
                    step(a, a, 1, "delete delimiter")
            else:
                step(inside, inside, 0)
                step(start, bare, 0)
                step(bare, bare, 0)
        cost, trail = then, led
    insertions(len(line), "")
    last = 4 * (cells - 1)
    end = min((last + s for s in (START, BARE, CLOSED)), key=lambda k: cost[k])
    edits, path = [], trail[end]
    while path:
        path, edit, place = path
        edits.append(f"{edit} at {place}")
    return cost[end] // QUOTING, cost[end] % QUOTING, edits[::-1]


def _parse(lines: pa.Array) -> pa.Array:
    cells, quotes, delimiters, edits = [], [], [], []
    for line in lines.to_pylist():
        own = split_sound(line) if line is not None else None
        if line is None:
            found = (None, None, None, None)
        elif own is not None and len(own) == CELLS:
            found = (own, 0, 0, None)
        else:
            found = (None, *error_parse(line))
        for column, x in zip((cells, quotes, delimiters, edits), found):
            column.append(x)
    texts = pa.list_(pa.string())
    columns = [pa.array(cells, texts), pa.array(quotes, pa.int32()), pa.array(delimiters, pa.int32()), pa.array(edits, texts)]
    return pa.StructArray.from_arrays(columns, names=PARSED.fieldNames())


#: Not deterministic in name only: a filter on the reason then stays above it, so a line is parsed once.
error_parse_udf = F.arrow_udf(_parse, PARSED).asNondeterministic()


def _value_ok(cells: Column) -> Column:
    file_id, mate, read_idx, name, seq, qual = (cells.getItem(i) for i in range(CELLS))
    return (
        file_id.rlike(r"\A[0-9]{1,18}\z")
        & ~file_id.rlike(r"\A0+\z")
        & mate.isin("1", "2")
        & read_idx.rlike(r"\A[0-9]{1,18}\z")
        & name.rlike(r"\A[!-~]{1,254}\z")
        & seq.rlike(r"\A[ACGTNacgtn.]+\z")
        & qual.rlike(r"\A[!-~]+\z")
        & (F.length(seq) == F.length(qual))
    )


def parse_lines(df: DataFrame, line: str = "raw_line", key: str = "line_id") -> DataFrame:
    """Every input row once, with its cells or the reason why it has none.

    Output: ``key, cells, quote_edits, delimiter_edits, edits, reason``; reason
    is null for valid rows and else ``quoting``, ``columns`` or ``value``, the
    first that applies.  A null or empty line is ``columns``.  One carriage
    return at the end is not part of the line; line breaks inside a line and
    very long lines are ordinary content.  Rows are kept as often as they come;
    an empty table gives an empty result; other columns are ignored.
    """
    text = F.col(line)
    body = F.when(text.endswith("\r"), F.expr(f"substr(`{line}`, 1, length(`{line}`) - 1)")).otherwise(text)
    plain = ~F.contains(F.col("_body"), F.lit('"')) & (F.size("_split") == CELLS)
    rows = df.select(F.col(key).alias(key), body.alias("_body")).withColumn("_split", F.split("_body", ",", -1))
    rows = rows.withColumn("_plain", F.coalesce(plain, F.lit(True)))
    rows = rows.withColumn("_parsed", error_parse_udf(F.when(~F.col("_plain"), F.col("_body"))))
    cells = F.when(F.col("_plain"), F.col("_split")).otherwise(F.col("_parsed.cells"))
    none = F.col("_body").isNull() | (F.col("_body") == "")
    rows = rows.select(
        key,
        F.when(~none, cells).alias("cells"),
        F.coalesce(F.col("_parsed.quote_edits"), F.lit(0)).alias("quote_edits"),
        F.when(none, CELLS - 1).otherwise(F.coalesce(F.col("_parsed.delimiter_edits"), F.lit(0))).alias("delimiter_edits"),
        F.coalesce(F.col("_parsed.edits"), F.array().cast("array<string>")).alias("edits"),
    )
    return rows.withColumn(
        "reason",
        F.when(F.col("quote_edits") > 0, "quoting")
        .when(F.col("delimiter_edits") > 0, "columns")
        .when(~F.coalesce(_value_ok(F.col("cells")), F.lit(False)), "value"),
    )


def rejected_lines(df: DataFrame, line: str = "raw_line", key: str = "line_id") -> DataFrame:
    """``key, reason`` of every line that is not valid."""
    return parse_lines(df, line, key).filter("reason is not null").select(key, "reason")


def typed_reads(df: DataFrame, line: str = "raw_line", key: str = "line_id") -> DataFrame:
    """The valid lines as typed reads."""
    cell = F.col("cells").getItem
    return (
        parse_lines(df, line, key)
        .filter("reason is null")
        .select(
            key,
            cell(0).cast("bigint").alias("file_id"),
            cell(1).cast("tinyint").alias("mate"),
            cell(2).cast("bigint").alias("read_idx"),
            cell(3).alias("name"),
            cell(4).alias("seq"),
            cell(5).alias("qual"),
        )
    )


def reject_report(df: DataFrame, by: str = "file_id", line: str = "raw_line", key: str = "line_id") -> DataFrame:
    """Rejected and loaded rows of each delivery; key is unique in df."""
    parsed = parse_lines(df.withColumn("_key", F.struct(F.col(key), F.col(by))), line, "_key")
    return parsed.groupBy(F.col(f"_key.{by}").alias(by)).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("reason").isNull()).alias("loaded"),
        F.count_if(F.col("reason") == "quoting").alias("bad_quoting"),
        F.count_if(F.col("reason") == "columns").alias("bad_columns"),
        F.count_if(F.col("reason") == "value").alias("bad_value"),
    )
