import itertools
import random

from lociflow.operators import malformed as M

OK = "7,1,3,r:1,ACGT,FFFF"


def rule_quoting(line):
    """The stated rule, character by character."""
    cells, at = 1, 0
    while True:
        if line[at : at + 1] == '"':
            at += 1
            while True:
                close = line.find('"', at)
                if close < 0:
                    return None
                if line[close + 1 : close + 2] == '"':
                    at = close + 2
                    continue
                at = close + 1
                break
        else:
            while at < len(line) and line[at] != ",":
                if line[at] == '"':
                    return None
                at += 1
        if at == len(line):
            return cells
        if line[at] != ",":
            return None
        at, cells = at + 1, cells + 1


def test_costs_agree_with_the_rule_on_all_short_lines():
    for n in range(7):
        for chars in itertools.product('",x', repeat=n):
            line = "".join(chars)
            sound = rule_quoting(line)
            quotes, delimiters, edits = M.error_parse(line, 3)
            assert (quotes == 0) == (sound is not None), line
            if sound is not None:
                assert delimiters == abs(sound - 3), line
            assert (M.split_sound(line) is None) == (sound is None), line
            assert bool(edits) == (quotes + delimiters > 0)


def test_costs_agree_on_random_lines():
    rng = random.Random(1)
    for _ in range(500):
        line = "".join(rng.choice('",,xx') for _ in range(rng.randint(0, 40)))
        sound = rule_quoting(line)
        quotes, delimiters, _ = M.error_parse(line)
        assert (quotes == 0) == (sound is not None)
        if sound is not None:
            assert delimiters == abs(sound - 6)


def test_reasons(spark):
    long_name = "n" * 254
    cases = {
        OK: None,
        OK + "\r": None,
        f"7,1,3,{long_name},ACGT,FFFF": None,
        '7,"1",3,r,AC.n,"F,""F"': None,
        None: "columns",
        "": "columns",
        "\r": "columns",
        OK + "\r\r": "value",
        OK + ",": "columns",
        "7,1,3,r:1,ACGT": "columns",
        '7,1,3,r"1,ACGT,FFFF': "quoting",
        '7,1,3,"r,ACGT,FFFF': "quoting",
        '7,1,3,"r"x,ACGT,FFFF,,': "quoting",
        '"': "quoting",
        "0,1,3,r,A,F": "value",
        "000,1,3,r,A,F": "value",
        "1,3,3,r,A,F": "value",
        "1,1,1234567890123456789,r,A,F": "value",
        f"1,1,3,{long_name}n,A,F": "value",
        "1,1,3,r r,A,F": "value",
        "1,1,3,r\n,A,F": "value",
        "1\n,1,3,r,A,F": "value",
        "1,1,3,r,AX,FF": "value",
        "1,1,3,r,A,FF": "value",
        "1,1,3,r,,": "value",
        "1,1, 3,r,A,F": "value",
        "1,1,3,r,A,é": "value",
        "١,1,3,r,A,F": "value",
        "1,1,3,r," + "A" * 100_000 + "," + "F" * 100_000: None,
        '1,1,3,r,A,"' + '""' * 20_000 + '"': "value",
        '1,1,3,r,A,"' + '"' * 5_000: "quoting" if len('"' + '"' * 5_000) % 2 else "value",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "line_id bigint, raw_line string")
    said = dict(M.parse_lines(df).select("line_id", "reason").collect())
    for i, (line, reason) in enumerate(cases.items()):
        assert said[i] == reason, (line or "")[:60]
    reads = {r.line_id: r for r in M.typed_reads(df).collect()}
    assert (reads[3].qual, reads[3].seq, reads[3].mate) == ('F,"F', "AC.n", 1)


def test_repeated_rows_extra_columns_and_empty_tables(spark, rows):
    schema = "line_id bigint, raw_line string, file_id bigint, cells string, reason string, _body int, edits int"
    df = spark.createDataFrame([(1, "x", 5, "c", "r", 1, 1), (1, "x", 5, "c", "r", 1, 1), (2, OK, None, None, None, 1, 1)], schema)
    assert rows(M.rejected_lines(df)) == [(1, "columns"), (1, "columns")]
    assert rows(M.reject_report(df)) == [(5, 2, 0, 0, 2, 0), (None, 1, 1, 0, 0, 0)]
    empty = spark.createDataFrame([], schema)
    assert rows(M.rejected_lines(empty)) == [] and rows(M.typed_reads(empty)) == []
