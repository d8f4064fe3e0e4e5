"""Queries of the catalogue and channel operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.operators import batch, catalog, channels, describe, hashing, store
from sigframe.plans.registry import Registry
from sigframe.session import scratch_path, table

register = Registry()

#: The typed catalogue of the table locator, as in ``catalog.from_locator``; channels split at commas.
REC = r"""with rec as (
  select loc_id as rec_id, file_path as path,
    coalesce(case when length(trim(domain_tag)) > 0 then trim(domain_tag) end, 'not_specified') as domain, file_type,
    try_cast(nullif(regexp_extract(data_shape, '^\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*$', 1), '') as bigint) as shape_channels,
    try_cast(nullif(regexp_extract(data_shape, '^\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*$', 2), '') as bigint) as n_samples,
    try_cast(number_of_channels as int) as n_channels,
    try_cast(regexp_replace(sampling_rate, '[^0-9.eE+\-]', '', 'g') as double) as sfreq,
    case when not isnan(try_cast(duration as double)) then try_cast(duration as double) end as duration_s,
    upper(left(trim(completeness_check), 1)) || lower(substr(trim(completeness_check), 2)) as status,
    list_transform(string_split(channel_names, ','), lambda x: trim(x)) as channels,
    description, source_hash, file_size
  from locator)
"""


def recordings(spark: SparkSession, root: str) -> DataFrame:
    rec = catalog.from_locator(table(spark, root, "locator"))
    return rec.withColumn("channels", F.transform(F.split("channel_text", ","), lambda x: F.trim(x))).drop("channel_text")


@register(REC + "select rec_id, path, domain, file_type, n_samples, sfreq, duration_s from rec where path is not null")
def scan_catalog(spark: SparkSession, root: str) -> DataFrame:
    return recordings(spark, root).where("path is not null").select("rec_id", "path", "domain", "file_type", "n_samples", "sfreq", "duration_s").orderBy("path", "rec_id")


@register("select loc_id, file_path, domain_tag, sampling_rate, file_size from locator")
def locator_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Save the catalogue as CSV and load it again."""
    path = scratch_path(spark, "locator-csv")
    rows = table(spark, root, "locator").select("loc_id", "file_path", "domain_tag", "sampling_rate", "file_size")
    keep = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "multiLine": True, "nullValue": "\\N"}
    rows.write.options(**keep).csv(path)
    return spark.read.options(**keep).schema(rows.schema).csv(path)


@register(REC + "select rec_id, domain, n_channels, sfreq, duration_s, status from rec where n_channels between 8 and 20 and sfreq between 100 and 512 and duration_s between 600 and 4000 and lower(status) = 'completed' and file_type = 'standard_data'")
def sample_filter(spark: SparkSession, root: str) -> DataFrame:
    rows = catalog.sample_filter(recordings(spark, root), channels=(8, 20), rate=(100, 512), duration=(600, 4000), status=" completed", file_type="standard_data")
    return rows.select("rec_id", "domain", "n_channels", "sfreq", "duration_s", "status")


@register(REC + "select rec_id, case when status = 'Completed' and sfreq > 0 then cast(floor(sfreq) as bigint) * 2 end as doubled from rec")
def batch_patch_value(spark: SparkSession, root: str) -> DataFrame:
    rows = recordings(spark, root).select("rec_id", "status", "sfreq")
    go = (F.col("status") == "Completed") & (F.col("sfreq") > 0)
    return batch.batch_process(rows, go, lambda r: int(r["sfreq"] // 1) * 2, returns="bigint", out="doubled").select("rec_id", "doubled")


@register(REC + "select rec_id, case when file_type = 'csvData' then 'csv' else file_type end as file_type, case when file_type = 'csvData' then 'Checked' else status end as status from rec")
def batch_patch_series(spark: SparkSession, root: str) -> DataFrame:
    rows = recordings(spark, root).select("rec_id", "file_type", "status")
    return batch.batch_process(rows, F.col("file_type") == "csvData", lambda r: r | {"file_type": "csv", "status": "Checked"}, result="series")


@register(REC + "select rec_id, case when length(status) > 3 then 1 end as ok, case when not coalesce(length(status) > 3, false) and coalesce(n_channels, 0) >= 0 and status is null then 'TypeError' end as failed from rec")
def error_skip(spark: SparkSession, root: str) -> DataFrame:
    """A function that fails on null values, with failures skipped and named."""
    rows = recordings(spark, root).select("rec_id", "status")
    done = batch.batch_process(rows, F.lit(True), lambda r: 1 if len(r["status"]) > 3 else None, returns="int", out="ok", on_error="skip")
    return done.select("rec_id", "ok", F.regexp_extract("_error", "^([A-Za-z]+)", 1).alias("failed"))


@register(REC + "select rec_id, domain, coalesce(file_size, -1) % 7 as grade from rec")
def set_metadata(spark: SparkSession, root: str) -> DataFrame:
    rows = recordings(spark, root)
    values = rows.select("rec_id", (F.coalesce("file_size", F.lit(-1)) % 7).alias("grade"))
    return catalog.set_metadata(rows, "grade", values).select("rec_id", "domain", "grade")


@register(REC + "select rec_id, case when starts_with(path, '/data/signals/') then '/mnt/new/' || substr(path, 15) else path end as path from rec")
def replace_paths(spark: SparkSession, root: str) -> DataFrame:
    return recordings(spark, root).select("rec_id", catalog.replace_prefix(F.col("path"), "/data/signals/", "/mnt/new/").alias("path"))


@register(REC + "select rec_id, case when len(channels) > 0 then 'domain-' || cast(cast(floor(sfreq) as bigint) as varchar) || 'Hz-' || cast(len(channels) as varchar) || '-' || left(sha1(array_to_string(list_sort(channels), ',')), 4) end as tag from rec")
def auto_domain(spark: SparkSession, root: str) -> DataFrame:
    return recordings(spark, root).select("rec_id", catalog.auto_domain(F.col("sfreq"), F.col("channels")).alias("tag"))


_ERRORS = """, c as (select rec_id, list_filter([
  case when shape_channels is null or n_samples is null then 'shape' end,
  case when file_type is null or trim(file_type) in ('', 'unidentified') then 'file_type' end,
  case when path is null or trim(path) = '' then 'path' end,
  case when not (coalesce(shape_channels = n_channels, false) and coalesce(len(channels) = n_channels, false)) then 'channel_count' end,
  case when not coalesce(sfreq > 0 and abs(n_samples / sfreq - duration_s) < 1, false) then 'duration' end,
  case when channels is null or len(channels) = 0 then 'names' end,
  case when coalesce(len(list_distinct(channels)) < len(channels), false) then 'repeated' end], lambda x: x is not null) as errors from rec)
"""


@register(REC + _ERRORS + "select rec_id, array_to_string(errors, ',') as errors, case when len(errors) = 0 then 'Completed' else 'Unavailable' end as status from c")
def check_locator(spark: SparkSession, root: str) -> DataFrame:
    return catalog.check(recordings(spark, root)).select("rec_id", F.array_join("errors", ",").alias("errors"), "status")


@register("select loc_id, try_cast(regexp_replace(sampling_rate, '[^0-9.eE+\\-]', '', 'g') as double) as sfreq from locator")
def clean_sampling_rate(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "locator").select("loc_id", catalog.clean_rate(F.col("sampling_rate")).alias("sfreq"))


@register(REC + "select count(distinct n_channels) as kinds, min(n_channels) as least, max(n_channels) as most, count(distinct n_channels) <= 1 as consistent from rec where lower(status) <> 'unavailable' and n_channels is not null")
def channel_consistency(spark: SparkSession, root: str) -> DataFrame:
    return catalog.channel_consistency(recordings(spark, root))


@register("select event_id, coalesce(json_extract_string(props, '$.k'), 'unknown') as k, coalesce(json_extract_string(props, '$.sex'), json_extract_string(props, '$.gender'), 'unknown') as gender from events")
def source_attrs_json(spark: SparkSession, root: str) -> DataFrame:
    attrs = describe.source_attributes(F.col("props"), ["k", "gender"], {"sex": "gender"})
    return table(spark, root, "events").select("event_id", *attrs)


@register("select electrode_id, name, kind from electrodes where kind in ('eeg', 'eog')")
def pick_types(spark: SparkSession, root: str) -> DataFrame:
    return channels.pick_types(table(spark, root, "electrodes").select("electrode_id", "name", "kind"), ["eeg", "eog"], "kind")


def _share(key: str, value: str) -> str:
    return REC + f""", v as (select domain, cast({value} as varchar) as {key} from rec),
n as (select domain, {key}, count(*) as n from v group by all union all select null, {key}, count(*) from v group by {key}),
t as (select domain, sum(n) as total from n group by domain)
select n.domain, n.{key}, cast(n.n as bigint) as n, round(100.0::double * n.n / t.total, 2) as percent from n join t on n.domain is not distinct from t.domain"""


@register(_share("file_type", "file_type"))
def report_file_type(spark: SparkSession, root: str) -> DataFrame:
    return catalog.share_report(recordings(spark, root), F.col("file_type"), "file_type")


@register(_share("rate", "case when abs(sfreq) < 1e18 then cast(cast(round_even(sfreq, 0) as bigint) as varchar) when sfreq = 'inf' then 'Infinity' when sfreq = '-inf' then '-Infinity' else cast(sfreq as varchar) end"))
def report_rate(spark: SparkSession, root: str) -> DataFrame:
    """Shares of all recordings; missing and implausible rates are groups of their own."""
    whole = F.when(F.abs("sfreq") < 1e18, F.rint("sfreq").cast("bigint").cast("string")).otherwise(F.col("sfreq").cast("string"))
    return catalog.share_report(recordings(spark, root), whole, "rate")


@register(_share("configuration", "'configuration ' || n_channels"))
def report_config(spark: SparkSession, root: str) -> DataFrame:
    return catalog.share_report(recordings(spark, root), F.concat(F.lit("configuration "), F.col("n_channels").cast("string")), "configuration")


@register(_share("status", "status"))
def report_status(spark: SparkSession, root: str) -> DataFrame:
    return catalog.share_report(recordings(spark, root), F.col("status"), "status")


@register(REC + """select domain, count(*) as files,
  sum(case when coalesce(len(channels) > 0 and len(list_filter(channels, lambda c: instr(c, ':') > 0)) = len(channels), false) then 1 else 0 end)::bigint as typed,
  sum(coalesce(len(list_filter(channels, lambda c: instr(c, ':') = 0 or starts_with(lower(c), 'bio:') or starts_with(lower(c), 'unknown:'))), 0))::bigint as unknown_channels,
  sum(case when coalesce(status <> 'Completed', true) then 1 else 0 end)::bigint as incomplete from rec group by domain""")
def report_diagnostics(spark: SparkSession, root: str) -> DataFrame:
    return catalog.diagnostics(recordings(spark, root))


@register(REC + "select rec_id, path, domain, md5(coalesce(path, '')) as h from rec qualify row_number() over (order by path, rec_id) <= 20")
def limit_rows(spark: SparkSession, root: str) -> DataFrame:
    """The first twenty recordings by path: the feature is the limit."""
    rows = recordings(spark, root).select("rec_id", "path", "domain", F.md5(F.coalesce("path", F.lit(""))).alias("h"))
    return rows.orderBy(F.col("path").asc_nulls_last(), "rec_id").limit(20)


@register(REC + "select rec_id, path, domain from rec where path is not null qualify row_number() over (partition by domain order by md5(cast(rec_id as varchar)), rec_id) <= 3")
def domain_sample(spark: SparkSession, root: str) -> DataFrame:
    return catalog.domain_sample(recordings(spark, root).where("path is not null").select("rec_id", "path", "domain"), 3, "rec_id")


@register(REC + "select rec_id, path, file_type, null::bigint as n_epochs from rec union all by name select source_id as rec_id, file_path as path, n_epochs from sources")
def union_datasets(spark: SparkSession, root: str) -> DataFrame:
    a = recordings(spark, root).select("rec_id", "path", "file_type")
    b = table(spark, root, "sources").select(F.col("source_id").cast("bigint").alias("rec_id"), F.col("file_path").alias("path"), "n_epochs")
    return catalog.union(a, b)


@register(REC + "select 'motor-grasp-24' as chosen, rec_id from rec where domain = 'motor-grasp-24' union all select 'not_specified', rec_id from rec where domain = 'not_specified'")
def group_by_domain(spark: SparkSession, root: str) -> DataFrame:
    parts = catalog.group_by_domain(recordings(spark, root), ["motor-grasp-24", "not_specified"])
    return catalog.union(*[df.select(F.lit(d).alias("chosen"), "rec_id") for d, df in parts.items()])


@register(REC + "select rec_id, sfreq, case when 256 < sfreq / 2 then 256.0::double else sfreq / 2 - 1 end as h_freq from rec where sfreq is not null")
def nyquist_clamp(spark: SparkSession, root: str) -> DataFrame:
    return recordings(spark, root).where("sfreq is not null").select("rec_id", "sfreq", catalog.nyquist_clamp(F.lit(256.0), F.col("sfreq")).alias("h_freq"))


@register("select l.loc_id, l.file_path from locator l where exists (select 1 from sources s where s.name = regexp_extract(replace(l.file_path, '\\', '/'), '([^/]*)[.][A-Za-z0-9]+$', 1))")
def sidecar_semi_join(spark: SparkSession, root: str) -> DataFrame:
    """Recordings beside which a source of the same stem exists."""
    stem = F.regexp_extract(F.translate("file_path", "\\", "/"), r"([^/]*)[.][A-Za-z0-9]+$", 1)
    names = table(spark, root, "sources").select(F.col("name").alias("stem"))
    return table(spark, root, "locator").withColumn("stem", stem).join(names, "stem", "left_semi").select("loc_id", "file_path")


@register(REC + "select rec_id, coalesce(list_aggregate(list_transform(channels, lambda x, i: case when len(list_filter(channels[1:i - 1], lambda y: y = x)) > 0 then x || '_' || len(list_filter(channels[1:i - 1], lambda y: y = x)) else x end), 'string_agg', ','), '') as names from rec where channels is not null")
def dedup_channel_names(spark: SparkSession, root: str) -> DataFrame:
    return recordings(spark, root).where("channels is not null").select("rec_id", F.array_join(channels.dedup_names(F.col("channels")), ",").alias("names"))


_EXPLODED = REC + ", e as (select rec_id, unnest(channels) as name, generate_subscripts(channels, 1) - 1 as pos from rec)\n"
#: The types of typed channels, written out on its own so that it tells when the operator's table is wrong.
_TYPES = """when upper(trim(split_part(name, ':', 1))) in ('EEG', 'DUAL', 'EEGDUAL') then 'eeg' when upper(trim(split_part(name, ':', 1))) in ('ECG', 'EKG') then 'ecg'
 when upper(trim(split_part(name, ':', 1))) in ('TEMP', 'TEMPERATURE') then 'temperature' when upper(trim(split_part(name, ':', 1))) in ('EYETRACK', 'EYEGAZE') then 'eyegaze'
 when upper(trim(split_part(name, ':', 1))) in ('FNIRS', 'FNIRS_CW_AMPLITUDE') then 'fnirs_cw_amplitude'
 when lower(trim(split_part(name, ':', 1))) in ('eog', 'emg', 'stim', 'misc', 'meg', 'mag', 'grad', 'ref_meg', 'resp', 'dbs', 'seeg', 'ecog', 'gsr', 'pupil', 'csd', 'hbo', 'hbr', 'fnirs_od',
  'fnirs_fd_ac_amplitude', 'fnirs_fd_phase', 'chpi', 'dipole', 'gof', 'exci', 'ias', 'syst') then lower(trim(split_part(name, ':', 1)))"""
_TYPED = "instr(name, ':') > 0 and length(trim(split_part(name, ':', 1))) > 0 and length(trim(substr(name, instr(name, ':') + 1))) > 0"


def _names(spark: SparkSession, root: str) -> DataFrame:
    return recordings(spark, root).select("rec_id", F.posexplode("channels").alias("pos", "name"))


@register(_EXPLODED + f"select rec_id, cast(pos as int) as pos, case when {_TYPED} then case {_TYPES} else 'bio' end end as ch_type from e")
def channel_types(spark: SparkSession, root: str) -> DataFrame:
    return _names(spark, root).select("rec_id", "pos", channels.channel_type(F.col("name")).alias("ch_type"))


_PREFIXES = "eeg Dual EEGDual eog EMG ecg EKG stim misc unknown bio meg mag grad ref_meg resp dbs sEEG ecog temp temperature gsr pupil eyetrack eyegaze fnirs csd HbO hbr fnirs_od fnirs_cw_amplitude fnirs_fd_ac_amplitude fnirs_fd_phase chpi dipole gof exci ias syst ref other".split()


@register(f"with e as (select electrode_id, unnest([{', '.join(repr(x) for x in _PREFIXES)}]) || ': ' || name as name from electrodes) select electrode_id, name, case when {_TYPED} then case {_TYPES} else 'bio' end end as ch_type from e")
def channel_type_prefixes(spark: SparkSession, root: str) -> DataFrame:
    """Every prefix a channel may have, before every electrode."""
    prefix = F.explode(F.array(*[F.lit(x) for x in _PREFIXES])).alias("prefix")
    e = table(spark, root, "electrodes").select("electrode_id", "name", prefix).select("electrode_id", F.concat("prefix", F.lit(": "), "name").alias("name"))
    return e.select("electrode_id", "name", channels.channel_type(F.col("name")).alias("ch_type"))


@register(_EXPLODED + r"select rec_id, cast(pos as int) as pos, case when regexp_extract(upper(name), '^(?:FP|AF|FT|FC|TP|CP|PO|F|T|C|P|O|A|M|I)(\d+|Z)$', 1) = '' then 'other' when regexp_extract(upper(name), '^(?:FP|AF|FT|FC|TP|CP|PO|F|T|C|P|O|A|M|I)(\d+|Z)$', 1) = 'Z' then 'midline' when try_cast(regexp_extract(upper(name), '^(?:FP|AF|FT|FC|TP|CP|PO|F|T|C|P|O|A|M|I)(\d+|Z)$', 1) as int) % 2 = 1 then 'left' else 'right' end as side from e")
def classify_channels(spark: SparkSession, root: str) -> DataFrame:
    return _names(spark, root).select("rec_id", "pos", channels.hemisphere(F.col("name")).alias("side"))


@register("select event_id, starts_with(lower('misc:' || event_type), 'misc:') and event_type <> 'view' as misc, case when event_type <> 'view' then event_type end as task from events")
def misc_channels(spark: SparkSession, root: str) -> DataFrame:
    name = F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.concat(F.lit("Misc: "), F.col("event_type")))
    return table(spark, root, "events").select("event_id", channels.is_misc(name).alias("misc"), channels.misc_task(name).alias("task"))


_STRIP = r"trim(regexp_replace(regexp_replace(n, '^(?:(?:EEG|REF|LE|[-_:.])\s*)+', ''), '(?:\s*(?:EEG|REF|LE|[-_:.]))+$', ''))"
_SWAP = "case " + " ".join(f"when starts_with(upper(b), '{a}') then '{z}' || substr(upper(b), 4)" for a, z in channels.SWAPPED.items()) + " else upper(b) end"


def _word(kind: str, words: str) -> str:
    left = f"trim(regexp_replace(b, '{words}', '', 'g'))"
    return f"'{kind}:' || case when length({left}) > 0 then {left} else b end"


_FORMAT = _EXPLODED + f""", a as (select rec_id, pos, trim(name) as n, trim(name) as name from e),
b as (select *, {_STRIP} as b, case when {_TYPED} then case {_TYPES} else 'bio' end end as stated from a),
c as (select *, {_SWAP} as swapped, string_split(b, '-') as sides from b),
d as (select c.*, v.name as known from c left join (select upper(name) as u, min(name) as name from electrodes where kind = 'eeg' group by 1) v on v.u = c.swapped),
f as (select rec_id, pos, case
  when starts_with(lower(n), 'misc:') then 'misc:' || substr(n, 6)
  when stated is not null then stated || ':' || trim(substr(n, instr(n, ':') + 1))
  when regexp_matches(lower(b), 'eog|loc|roc') then {_word('eog', 'EOG:|EOG|eog')}
  when contains(lower(b), 'meg') then {_word('meg', 'MEG:|MEG|meg')}
  when contains(lower(b), 'emg') then {_word('emg', 'EMG:|EMG|emg')}
  when regexp_matches(lower(b), 'ecg|ekg') then {_word('ecg', 'ECG:|ECG|ecg')}
  when len(sides) = 2 and length(sides[1]) > 0 and length(sides[2]) > 0
    and upper(trim(sides[1])) not in ('REF', 'LE', 'EEG', 'ECG', 'EOG', 'EMG', 'EKG', 'MEG') and upper(trim(sides[2])) not in ('REF', 'LE', 'EEG', 'ECG', 'EOG', 'EMG', 'EKG', 'MEG') then 'eeg:' || b
  when regexp_matches(lower(b), 'stim|event|marker') then {_word('stim', 'STIM:|STIM|stim')}
  when known is not null then 'eeg:' || known
  else 'bio:' || case when length(b) > 0 then b else n end end as made from d),
g as (select rec_id, list(made order by pos) as made from f group by rec_id)
select l.loc_id as rec_id, case when len(list_distinct(made)) < len(made) then l.channel_names else array_to_string(made, ', ') end as names from g join locator l on l.loc_id = g.rec_id"""


@register(_FORMAT)
def format_channel_names(spark: SparkSession, root: str) -> DataFrame:
    vocabulary = [r[0] for r in table(spark, root, "electrodes").where("kind = 'eeg'").select("name").distinct().limit(10_001).collect()]
    if len(vocabulary) > 10_000:
        raise ValueError("a vocabulary of at most 10,000 positions")
    rows = table(spark, root, "locator").where("channel_names is not null").select(F.col("loc_id").alias("rec_id"), F.col("channel_names").alias("names"))
    return channels.format_catalogue(rows, "rec_id", "names", vocabulary)


@register("""with o as (select ordinal, name as ch_name, lower(name) as k from channels), s as (select rec_id, k, v as value from (
  select source_id::bigint as rec_id, lower(unnest(['C3', 'c4', 'Pz'])) as k, unnest([n_epochs * 1.0, sfreq, 1.0]) as v from sources)),
enough as (select rec_id from s join o using (k) group by rec_id having count(distinct k) >= 2)
select enough.rec_id, o.ordinal, o.ch_name, coalesce(s.value, 0.0)::double as value, s.value is not null as present from enough cross join o left join s on s.rec_id = enough.rec_id and s.k = o.k""")
def align_channels(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "sources")
    pairs = F.array(*[F.struct(F.lit(n).alias("ch_name"), v.cast("double").alias("value")) for n, v in (("C3", F.col("n_epochs")), ("c4", F.col("sfreq")), ("Pz", F.lit(1.0)))])
    rows = s.select(F.col("source_id").cast("bigint").alias("rec_id"), F.explode(pairs).alias("x")).select("rec_id", "x.*")
    order = table(spark, root, "channels").select("ordinal", F.col("name").alias("ch_name"))
    return channels.align(rows, order, missing="zero", least=2)


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(replace(trim(file_path), '\', '/'), '/+', '/', 'g'), '(/\.)+(/|$)', '/', 'g'), '(.)/$', '\1')"
_UID = f"sha256(case when length(trim(file_path)) > 0 then {_NORMAL} else 'unresolved:' || coalesce(name, '') end)"


@register(f"select source_id, {_UID} as uid from sources")
def source_uid(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "sources").select("source_id", store.source_uid(F.col("file_path"), F.col("name")).alias("uid"))


@register("select doc_id, sha256(text) as source_hash, strlen(text) as file_size from documents where text is not null")
def source_hash(spark: SparkSession, root: str) -> DataFrame:
    """Texts as the bytes of files."""
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("source_hash"), F.octet_length("text").cast("bigint").alias("file_size"))


@register("with h as (select doc_id, sha256(text) as h from documents where text is not null) select doc_id, h, c.copies from h join (select h, count(*) as copies from h group by h having count(*) > 1) c using (h)")
def hash_duplicates(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return hashing.duplicates(rows, "h").select("doc_id", "h", "copies")


@register("select doc_id, n_chars as a_key, length(text)::bigint as b_key from documents where n_chars is distinct from length(text)")
def hash_mismatch(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose recorded length is not the one found."""
    d = table(spark, root, "documents")
    return hashing.mismatches(d.select("doc_id", F.col("n_chars").alias("k")), d.select("doc_id", F.length("text").cast("bigint").alias("k")), "doc_id", "k")


@register("select l.loc_id, coalesce(s.n, -1) as file_size from locator l left join (select file_path, max(n_epochs) as n from sources where file_path is not null group by 1) s on s.file_path = l.file_path")
def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    files = table(spark, root, "sources").where("file_path is not null").groupBy("file_path").agg(F.max("n_epochs").alias("file_size")).withColumnRenamed("file_path", "path")
    rows = table(spark, root, "locator").select("loc_id", F.col("file_path").alias("path"))
    return hashing.file_sizes(rows, files).select("loc_id", "file_size")


@register(REC + "select rec_id, case when sfreq <> 0 then n_samples / sfreq end as seconds from rec")
def safe_duration(spark: SparkSession, root: str) -> DataFrame:
    return recordings(spark, root).select("rec_id", describe.safe_divide(F.col("n_samples"), F.col("sfreq")).alias("seconds"))


@register("select event_id, props as found from events where props is not null")
def json_extract(spark: SparkSession, root: str) -> DataFrame:
    """JSON found in free text, fenced or not."""
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Result:\n```json\n"), "props", F.lit("\n```\nend }"))).otherwise(F.concat(F.lit("see "), "props", F.lit(" above")))
    return table(spark, root, "events").where("props is not null").select("event_id", describe.json_text(text).alias("found"))


@register("""with x as (
  select doc_id, 'sampling_rate' as field, unnest(regexp_extract_all(text, '([0-9]+(?:[.][0-9]+)?) ?Hz', 1)) as value from documents union all
  select doc_id, 'channels', unnest(regexp_extract_all(text, '([0-9]+) (?:channels|Kanäle|canales|voies)', 1)) from documents)
select doc_id, field, value, count(*) as uses from x group by all""")
def metadata_candidates(spark: SparkSession, root: str) -> DataFrame:
    return describe.metadata_candidates(table(spark, root, "documents"), "doc_id", "text")


@register("select doc_id, source, length(text)::int as n from documents where strlen(text) < 3145728")
def small_text_files(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").where(F.octet_length("text") < 3 * 1024 * 1024).select("doc_id", "source", F.length("text").alias("n"))


QUERIES, ORACLE = register.queries, register.oracle
