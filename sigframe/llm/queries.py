"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm.mixing import Mix
from sigframe.llm.packing import oversized, pack_items, packing_report
from sigframe.llm.pii import find_entities, redact_texts
from sigframe.llm.splits import assign_splits, record_keys, related_records
from sigframe.llm.tokens import count_tokens
from sigframe.session import table


def _records(spark: SparkSession, root: str) -> DataFrame:
    return record_keys(*[table(spark, root, n) for n in ("locator", "sources", "studies")])


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return related_records(_records(spark, root))


def p1_splits(spark: SparkSession, root: str) -> DataFrame:
    """Every recording and every source with its split."""
    return assign_splits(_records(spark, root), table(spark, root, "split_targets"))


def p1_shares(spark: SparkSession, root: str) -> DataFrame:
    """Records and components per split, beside the target proportion."""
    done = p1_splits(spark, root).groupBy("split_name", "component").agg(F.count(F.lit(1)).alias("n"))
    reached = done.groupBy("split_name").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("components"))
    return table(spark, root, "split_targets").join(reached, "split_name", "left")


def _capacity(spark: SparkSession, root: str) -> int:
    return int(table(spark, root, "bin_capacity").where("bin_kind = 'sequence'").first()["capacity_tokens"])


def p6_bins(spark: SparkSession, root: str) -> DataFrame:
    """Every piece of every text in its sequence."""
    sized = count_tokens(table(spark, root, "documents").select("doc_id", "text"))
    return pack_items(sized, "doc_id", "n_tokens", _capacity(spark, root))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return oversized(p6_bins(spark, root), "doc_id")


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    """Number of sequences, and how much of their room is used."""
    return packing_report(p6_bins(spark, root), _capacity(spark, root))


def _mix(spark: SparkSession, root: str) -> Mix:
    sized = count_tokens(table(spark, root, "documents").select("doc_id", "source", "text"))
    return Mix(sized, table(spark, root, "mix_targets"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _mix(spark, root).found()


def p7_draws(spark: SparkSession, root: str) -> DataFrame:
    """Every text of the mix with the number of its uses."""
    return _mix(spark, root).draws()


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and reached shares of every source."""
    return _mix(spark, root).report()


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return find_entities(table(spark, root, "documents")).select("doc_id", "start_pos", "kind")


def p8_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every text with its personal information replaced by typed placeholders."""
    return redact_texts(table(spark, root, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_shares, p6_found, p6_bins, p6_fill, p7_found, p7_draws, p7_shares, p8_found, p8_redacted)}
#: Participants of recordings and sources by the naming habits of their paths.
_PERSONS = r"""
with s as (select regexp_replace(lower(domain_tag), '[^a-z0-9]', '', 'g') as k from studies),
r as (
  select 'locator' as rec_table, loc_id as rec_id, url_decode(lower(replace(file_path, '\', '/'))) as p from locator
  union all
  select 'sources', source_id::bigint, url_decode(lower(replace(file_path, '\', '/'))) from sources),
k as (
  select rec_table, rec_id, (
    select min(s.k) from s where list_contains(list_transform(string_split(p, '/'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), s.k)
  ) as study, coalesce(
    nullif(regexp_extract(p, '(?:^|/)sub-0*([0-9]+)(?:[/_.]|$)', 1), ''),
    nullif(regexp_extract(p, '/s0*([0-9]+)/s0*[0-9]+r[0-9]+[.]', 1), ''),
    nullif(regexp_extract(p, '(?:^|/)subject[_ -]?0*([0-9]+)(?:[/_.]|$)', 1), ''),
    nullif(regexp_extract(p, '/flat/0*([0-9]+)_[0-9]+_', 1), ''),
    nullif(regexp_extract(p, '__vp0*([0-9]+)[.]', 1), ''),
    nullif(regexp_extract(p, '/p0*([0-9]+)[a-z]_', 1), ''),
    nullif(regexp_extract(p, '(?:^|/)participant[ _-]?0*([0-9]+)(?:[/_.]|$)', 1), '')) as num
  from r where p is not null)
"""
ORACLE = {
    "p1_found": _PERSONS + r""",
f as (select study, num, min(rec_id) as first_loc_id from k where rec_table = 'locator' group by study, num)
select f.first_loc_id, k.rec_table, k.rec_id
from k join f on k.study = f.study and k.num = f.num
where k.rec_table = 'sources' or k.rec_id > f.first_loc_id
""",
    # content hashes tie records without a participant to those with one; no hash ties two participants
    "p1_splits": _PERSONS + r""",
h as (select 'locator' as rec_table, loc_id as rec_id, case when lower(trim(source_hash)) not in ('', 'nan', 'none', 'null', 'n/a', 'na', '<na>', 'nat', 'unknown', 'not_specified', '-') then 'h:' || lower(trim(source_hash)) end as h
  from locator union all select 'sources', source_id::bigint, null from sources),
n as (select h.rec_table, h.rec_id, h.h, 'a:' || k.study || '#' || k.num as person from h left join k on k.rec_table = h.rec_table and k.rec_id = h.rec_id),
g as (select h, min(person) as person from n where h is not null group by h),
c as (select n.rec_table, n.rec_id, coalesce(n.person, g.person, n.h, 'r:' || n.rec_table || ':' || n.rec_id) as component from n left join g on g.h = n.h),
d as (select c.*, t.split_name, -t.proportion / ln((('0x' || substr(md5(c.component || '|' || t.split_name), 1, 12))::bigint + 0.5) / 281474976710656.0::double) as draw from c cross join split_targets t)
select rec_table, rec_id, component, arg_max(split_name, draw) as split_name from d group by rec_table, rec_id, component
""",
}
