"""Queries of the data-cleaning operators: packed fields, units, reference lists, implausible readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.operators.packed_fields import split_packed
from sigframe.operators.reference_match import match_channels
from sigframe.operators.spikes import flag_epochs, flag_rates, implausible
from sigframe.operators.units import decode_units, to_common, uncommon_units
from sigframe.session import table


def channel_values(spark: SparkSession, root: str) -> DataFrame:
    """One row (loc_id, ch_pos, ch_text) per channel value of each recording."""
    locator = table(spark, root, "locator")
    hint = F.col("number_of_channels").try_cast("int")
    return split_packed(locator, "channel_names", ["loc_id"], pos="ch_pos", value="ch_text", count_hint=hint)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return channel_values(spark, root)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    t = {n: table(spark, root, n) for n in ("locator", "studies", "electrodes", "unit_codes")}
    return uncommon_units(t["locator"], t["studies"], t["electrodes"], t["unit_codes"])


def p3_common(spark: SparkSession, root: str) -> DataFrame:
    """Every entry with numbers, in the unit it is in and in the common one."""
    decoded = decode_units(table(spark, root, "locator"), table(spark, root, "studies"), table(spark, root, "electrodes"))
    return to_common(decoded)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    electrodes = table(spark, root, "electrodes")
    names = electrodes.select(F.col("name").alias("ch_text"))
    typed = channel_values(spark, root).join(names, "ch_text", "left_anti")
    return match_channels(typed, "ch_text", electrodes).select("loc_id", "ch_pos", "electrode_id")


def p4_unmatched(spark: SparkSession, root: str) -> DataFrame:
    """Report of the texts that name no electrode, with the number of their uses."""
    found = match_channels(channel_values(spark, root), "ch_text", table(spark, root, "electrodes"))
    return found.where("electrode_id = -1").groupBy("ch_text").agg(F.count(F.lit(1)).alias("uses"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return implausible(*[table(spark, root, n) for n in ("epochs", "sources", "channel_masks", "locator", "studies")])


def p5_flags(spark: SparkSession, root: str) -> DataFrame:
    """Channels of epochs with the number of spikes, stuck samples, impossible ones and level shifts."""
    return flag_epochs(*[table(spark, root, n) for n in ("epochs", "sources", "channel_masks")])


def p5_rates(spark: SparkSession, root: str) -> DataFrame:
    """Recordings whose stated rate is impossible or far from what their study normally records at, with the rate."""
    return flag_rates(table(spark, root, "locator"), table(spark, root, "studies"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_common, p4_found, p4_unmatched, p5_found, p5_flags, p5_rates)}
_D = "[,;|\\t\\n\\r，、；｜]"
_NULLS = "('', 'nan', 'none', 'null', 'n/a', 'na', '<na>', 'nat', '-', '?')"
_STRIPPED = r"regexp_replace(f, '^\[\s*([\s\S]*?)\s*\]$|^\(\s*([\s\S]*?)\s*\)$|^\{\s*([\s\S]*?)\s*\}$', '\1\2\3')"
_WORD = "(?:[A-Za-z][A-Za-z-]*(?:[0-9][A-Za-z0-9''-]*|z)|[A-HJ-Z][A-Z0-9-]+)"
_LIST = rf"^{_WORD}(?:\s+{_WORD})+$"
_HIDE = r"'([\p{L}\p{N}])''([\p{L}\p{N}])', '\1' || chr(57344) || '\2', 'g'"
#: Channel values by string functions: text quotes are hidden first, then quoted pieces are told apart by their parity.
CHANNEL_VALUES = rf"""with a as (
  select loc_id, try_cast(number_of_channels as int) as hint, regexp_replace(channel_names, '^\s+|\s+$', '', 'g') as f from locator
  where channel_names is not null and lower(trim(channel_names)) not in {_NULLS}),
b as (select loc_id, hint, {_STRIPPED} as f from a), c as (select loc_id, hint, {_STRIPPED} as f from b),
d as (select loc_id, hint, regexp_replace(regexp_replace(f, {_HIDE}), {_HIDE}) as f from c),
e as (select *, string_split_regex(f, '["'']') as p from d),
g as (select *, len(p) as n, list_transform(p, lambda x, i: case when i % 2 = 0 and not (len(p) % 2 = 0 and i = len(p)) then null else x end) as bare from e),
h as (select *, array_to_string(list_filter(bare, lambda x: x is not null), '') as outside from g),
k as (select *, not regexp_matches(outside, '{_D}') and (n > 4 or (n >= 3 and regexp_matches(outside, '\S')) or (n = 1 and (len(string_split_regex(trim(f), '\s+')) >= 6 and coalesce(hint, 0) <> 1
    or coalesce(hint, 0) > 1 and len(string_split_regex(trim(f), '\s+')) = hint and regexp_matches(trim(f), '{_LIST}')))) as by_blank from h),
m as (select loc_id, array_to_string(list_transform(p, lambda x, i: case when bare[i] is null then x when by_blank then regexp_replace(x, '\s+', chr(57345), 'g') else regexp_replace(x, '{_D}', chr(57345), 'g') end), '') as r from k),
v as (select loc_id, unnest(string_split(r, chr(57345))) as t, generate_subscripts(string_split(r, chr(57345)), 1) - 1 as pos from m),
w as (select loc_id, pos, replace(t, chr(57344), '''') as t from v),
z as (select loc_id, pos, regexp_replace(case when contains(t, '\u') then json_extract_string('["' || replace(t, '"', '\"') || '"]', '$[0]') else t end, '^\s+|\s+$', '', 'g') as t from w)
"""
ORACLE: dict[str, str] = {
    "p5_rates": r"""with s as (select regexp_replace(lower(domain_tag), '[^a-z0-9]', '', 'g') as k from studies),
l as (select loc_id, url_decode(lower(replace(file_path, '\', '/'))) as p, regexp_replace(regexp_replace(trim(lower(domain_tag)), '(?:@v[0-9]+(?:[.][0-9]+)*|[_ -]v[0-9]+(?:[.][0-9]+)*)$', ''), '[^a-z0-9]', '', 'g') as tag,
  replace(lower(trim(sampling_rate)), ',', '.') as t from locator),
r as (select loc_id, coalesce((select min(k) from s where list_contains(list_transform(string_split(p, '/'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), s.k)), (select min(k) from s where s.k = l.tag), '?') as study,
  round(try_cast(regexp_replace(t, '\s*k?hz$', '') as double) * case when ends_with(t, 'khz') then 1000 else 1 end, 6) as rate from l),
v as (select * from r where rate is not null and not isnan(rate)),
c as (select study, rate, count(*) as n from v where rate > 0 and study <> '?' group by all), t as (select study, sum(n) as total, max(n) as most from c group by study),
n as (select study, list(distinct rate) as normal from c join t using (study) where n = most or n >= greatest(2.0, 0.04 * total) group by study),
a as (select * from n union all select '?', list(distinct x) from (select unnest(normal) as x from n))
select loc_id, rate from v left join a using (study) where rate <= 0 or rate > 1e6 or (coalesce(len(normal), 0) > 0 and len(list_filter(normal, lambda x: rate <= x * 3 and rate * 3 >= x)) = 0)""",
    "p2_found": CHANNEL_VALUES + "select loc_id, pos::int as ch_pos, t as ch_text from z where length(t) > 0",
}
