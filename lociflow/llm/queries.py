"""Queries of problems 2, 4, 5, 6, 7 and 8 with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociflow.llm import bagminhash, bpe, components, iceberg, quantiles, redelivered, repeats, winnow
from lociflow.session import table
from lociflow.streaming.jobs import place


def _inserts(spark, sf_dir):
    """Absolute non-zero insert sizes with their day."""
    size = F.abs(F.col("insert_size").cast("bigint"))
    rows = table(spark, sf_dir, "sam_records").filter("insert_size <> 0")
    return rows.select("file_id", F.to_date("recorded_at").alias("day"), size.alias("value"))


def _fields(inserts, mapq):
    field = lambda df, name: df.select("file_id", F.lit(name).alias("field_name"), "percentile", "value", "n")
    return field(inserts, "insert_size").unionByName(field(mapq, "mapq"))


def p2_percentiles(spark, sf_dir):
    """Percentiles of all days from merged sketches of the days, and of mapq."""
    days = quantiles.sketches(_inserts(spark, sf_dir), ["file_id", "day"], "value")
    inserts = quantiles.percentiles(quantiles.merged(days, ["file_id"]), ["file_id"])
    return _fields(inserts, quantiles.grouped_percentiles(table(spark, sf_dir, "alignments"), ["file_id"], "mapq"))


def p2_sketches(spark, sf_dir):
    """The sketches of each file and day, as they are stored to be combined later."""
    days = quantiles.sketches(_inserts(spark, sf_dir), ["file_id", "day"], "value")
    return quantiles.described(days)


def p2_combined(spark, sf_dir):
    """Percentiles of each file from sketches of its days that were written and read back."""
    at = place(spark, "sketches")
    quantiles.sketches(_inserts(spark, sf_dir), ["file_id", "day"], "value").write.parquet(at)
    stored = spark.read.parquet(at)
    return quantiles.percentiles(quantiles.merged(stored, ["file_id"]), ["file_id"])


def p2_daily(spark, sf_dir):
    return quantiles.grouped_percentiles(_inserts(spark, sf_dir), ["file_id", "day"], "value")


def p2_audit(spark, sf_dir):
    """Every percentile against the exact ranks of its value: is it within 1% of rank?"""
    rows = _inserts(spark, sf_dir).select("file_id", F.lit("insert_size").alias("field_name"), "value")
    mapq = table(spark, sf_dir, "alignments").filter("mapq is not null")
    rows = rows.unionByName(mapq.select("file_id", F.lit("mapq").alias("field_name"), F.col("mapq").cast("bigint").alias("value")))
    said = p2_percentiles(spark, sf_dir).groupBy("file_id", "field_name")
    said = said.agg(F.sort_array(F.collect_list(F.struct("percentile", "value"))).alias("said"))
    of = [F.col("said").getItem(i) for i in range(len(quantiles.PERCENTILES))]
    exact = rows.join(F.broadcast(said) if said.count() <= 10_000 else said, ["file_id", "field_name"]).groupBy("file_id", "field_name")
    sums = [f(F.col("value"), p).alias(f"{n}{i}") for i, p in enumerate(of) for n, f in (("b", _below), ("u", _upto))]
    exact = exact.agg(F.count(F.lit(1)).alias("n"), *sums)
    cells = [
        F.struct(
            F.lit(p).alias("percentile"),
            ((F.col(f"b{i}") <= F.col("n") * (p + 1) / 100.0) & (F.col(f"u{i}") >= F.col("n") * (p - 1) / 100.0)).alias("within"),
        )
        for i, p in enumerate(quantiles.PERCENTILES)
    ]
    return exact.select("file_id", "field_name", "n", F.inline(F.array(*cells)))


def _below(value, said):
    return F.count_if(value < said["value"])


def _upto(value, said):
    return F.count_if(value <= said["value"])


def p4_method(spark, sf_dir):
    """Every read with its class, and the classes whose bags are similar, by BagMinHash over the whole table."""
    return bagminhash.weighted_links(table(spark, sf_dir, "fastq_reads"))


def p4_found(spark, sf_dir):
    pairs = redelivered.delivered_again(table(spark, sf_dir, "fastq_reads"))
    return pairs.select(F.col("a").alias("read_id_a"), F.col("b").alias("read_id_b"))


def p4_groups(spark, sf_dir):
    """Every read with a near duplicate, its group and its number of links."""
    found = components.groups(p4_found(spark, sf_dir), "read_id_a", "read_id_b")
    return found.select(F.col("id").alias("read_id"), "group_id", "links")


def p5_found(spark, sf_dir):
    found = iceberg.frequent_items(table(spark, sf_dir, "fastq_reads"), iceberg.bases(), 0.005)
    return found.select(F.col("value").alias("seq"))


def p5_counts(spark, sf_dir):
    found = iceberg.frequent_items(table(spark, sf_dir, "fastq_reads"), iceberg.bases(), 0.001)
    return found.select(F.col("value").alias("seq"), F.col("n").alias("n_reads"), F.round("share", 6).alias("share"))


def p6_ids(spark, sf_dir):
    return bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return winnow.holders(docs, "doc_id", "text", items, "item_id", "text")


def p7_spans(spark, sf_dir):
    """Each leaked item with its longest passage, where it begins on either side, and the number of passages."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return winnow.leaks(docs, "doc_id", "text", items, "item_id", "text")


def p7_items(spark, sf_dir):
    """How many documents hold each item; items that are not held are listed too."""
    held = p7_spans(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("longest").alias("longest"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "task")
    return items.join(held, "item_id", "left").fillna(0, ["documents", "longest"])


def p8_ledger(spark, sf_dir):
    return repeats.ledger(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark, sf_dir):
    return repeats.rejected(p8_ledger(spark, sf_dir), 1).select("doc_id")


def p8_policies(spark, sf_dir):
    return repeats.policy_effects(p8_ledger(spark, sf_dir))


QUERIES = {
    "p2_percentiles": p2_percentiles,
    "p2_sketches": p2_sketches,
    "p2_combined": p2_combined,
    "p2_daily": p2_daily,
    "p2_audit": p2_audit,
    "p4_method": p4_method,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_spans": p7_spans,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_ledger": p8_ledger,
    "p8_policies": p8_policies,
}

_BASES = "regexp_replace(upper(seq), '[^ACGT]', 'N', 'g')"
_COUNTS = f"""with s as (select {_BASES} as seq from fastq_reads where seq is not null), t as (select count(*) as total from s)
select seq, count(*) as n_reads, round(count(*) / any_value(total), 6) as share from s, t group by seq"""

SQL = {
    "p2_audit": """with v as (
        select file_id, 'insert_size' as field_name from sam_records where insert_size <> 0
        union all select file_id, 'mapq' from alignments where mapq is not null
      ), n as (select file_id, field_name, count(*) as n from v group by file_id, field_name)
      select file_id, field_name, n, percentile, true as within from n, (select unnest([5, 25, 50, 75, 95, 99]) as percentile)""",
    "p4_found": rf"""with r as (
        select distinct read_id, {_BASES} as seq,
          string_split_regex(lower(regexp_replace(split_part(name, ' ', 1), '/[12]$', '')), '[:_.|#]') as words
        from fastq_reads where seq is not null and name is not null
      ), e as (
        select read_id, seq, len(words) as n, word, row_number() over (partition by read_id, seq, word) as nth
        from (select read_id, seq, words, unnest(words) as word from r)
      ), f as (select word, nth, count(*) as df from e group by word, nth),
      p as (
        select e.read_id, e.seq, e.word, e.nth from e join f using (word, nth)
        qualify row_number() over (partition by e.read_id, e.seq order by df, word, nth) <= e.n - 5
      ), l as (select read_id, seq, list(word || '#' || nth) as bag from e group by read_id, seq),
      c as (select distinct a.read_id as ra, b.read_id as rb, a.seq as sa, b.seq as sb
        from p a join p b on a.word = b.word and a.nth = b.nth and a.read_id < b.read_id)
      select distinct ra as read_id_a, rb as read_id_b
      from c join l x on x.read_id = ra and x.seq = sa join l y on y.read_id = rb and y.seq = sb
      where len(list_intersect(x.bag, y.bag)) >= 6
        and least(levenshtein(sa, sb), levenshtein(sa, translate(reverse(sb), 'ACGT', 'TGCA'))) * 10 <= greatest(length(sa), length(sb))""",
    "p5_found": f"select seq from ({_COUNTS}) where n_reads * 200 >= (select count(*) from fastq_reads where seq is not null)",
    "p5_counts": f"select * from ({_COUNTS}) where n_reads * 1000 >= (select count(*) from fastq_reads where seq is not null)",
}

SQL["p4_groups"] = SQL["p4_found"].replace("with r as", "with recursive r as", 1).replace(
    "select distinct ra as read_id_a", "found as (select distinct ra as read_id_a", 1
)
SQL["p4_groups"] = (
    SQL["p4_groups"].replace("from p a join p b on a.word = b.word and a.nth = b.nth and a.read_id < b.read_id)", "from p a join p b on a.word = b.word and a.nth = b.nth and a.read_id < b.read_id),", 1)
    + """), e2 as (select read_id_a as a, read_id_b as b from found union select read_id_b, read_id_a from found),
      t as (select a, b from e2 union select t.a, e2.b from t join e2 on t.b = e2.a)
      select a as read_id, least(a, min(b)) as group_id, (select count(*) from e2 where e2.a = t.a) as links from t group by a"""
)
