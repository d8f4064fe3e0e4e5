"""Queries of the signal, event, epoch and store operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.functions import dsp
from sigframe.operators import batch, channels, epoching, events, hashing, quality, signals, store
from sigframe.plans.registry import Registry
from sigframe.session import scratch_path, table
from sigframe.sources.timeseries import infer_rate
from sigframe.streaming import windows

register = Registry()

def _sig(x: str) -> str:
    """SQL of ``x`` with six decimals, above a million with ten digits."""
    return f"case when abs({x}) < 1e6 then round({x}, 6) else printf('%.9e', {x})::double end"


#: Recordings stood in for by the events of a user in order of time.
EV = "with ev as (select user_id as rec_id, event_id, ts, event_type as name, value, props, row_number() over (partition by user_id order by ts, event_id) - 1 as sample from events)\n"
#: Samples of epochs with their channel; non-finite and absent samples are left out.
_CH = "unnest(epoch_data) as data, generate_subscripts(epoch_data, 1) - 1 as ch"
SM = f"""with c as (select epoch_id, source_id, {_CH} from epochs),
x as (select epoch_id, source_id, ch::int as ch, unnest(data)::double as value, generate_subscripts(data, 1) - 1 as sample from c),
sm as (select * from x where value is not null and isfinite(value))
"""


def _events(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").select(F.col("user_id").alias("rec_id"), "event_id", "ts", F.col("event_type").alias("name"), "value", "props")
    return events.sample_index(e, "rec_id", ["ts", "event_id"])


def _samples(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "epochs").select("epoch_id", "source_id", F.posexplode("epoch_data").alias("ch", "data"))
    x = e.select("epoch_id", "source_id", "ch", F.posexplode("data").alias("sample", "v")).select("epoch_id", "source_id", "ch", F.col("sample").cast("bigint").alias("sample"), F.col("v").cast("double").alias("value"))
    return x.where("value is not null and not isnan(value) and abs(value) < double('Infinity')")


# ---------------------------------------------------------------------------- segments and epochs
@register(EV + """, n as (select rec_id, max(sample) + 1 as n from ev group by rec_id),
s as (select rec_id, unnest(range(0, n - 16 + 1, 8)) as start from n where n >= 16)
select s.rec_id, s.start, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std
from s join ev on ev.rec_id = s.rec_id and ev.sample >= s.start and ev.sample < s.start + 16 group by s.rec_id, s.start""")
def sliding_segments(spark: SparkSession, root: str) -> DataFrame:
    seg = events.sliding_segments(_events(spark, root), 16, 0.5)
    return seg.select("rec_id", "start", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register(EV + """, n as (select rec_id, max(sample) + 1 as n from ev group by rec_id),
s as (select rec_id, unnest(range(0, n - 21 + 1, 10)) as start from n where n >= 21)
select s.rec_id, s.start, round(avg(value), 6) as mean, round(avg(value) filter (sample < s.start + 5), 6) as baseline
from s join ev on ev.rec_id = s.rec_id and ev.sample >= s.start and ev.sample < s.start + 21 group by s.rec_id, s.start""")
def pretrain_segments(spark: SparkSession, root: str) -> DataFrame:
    """Windows of one sample more than their step, both ends included, with the mean of a baseline."""
    e = _events(spark, root)
    n = e.groupBy("rec_id").agg((F.max("sample") + 1).alias("n"))
    starts = n.where("n >= 21").select("rec_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 21, F.lit(10).cast("bigint"))).alias("start"))
    ends = events.event_epochs(e, "rec_id", ["sample"], "value", 0, 20).select("rec_id", F.col("sample").alias("start"), "epoch")
    held = ends.join(starts, ["rec_id", "start"])
    return held.select("rec_id", "start", F.round(signals.array_mean(F.col("epoch")), 6).alias("mean"), F.round(signals.array_mean(F.slice("epoch", 1, 5)), 6).alias("baseline"))


_EPOCHS = """, p as (select a.rec_id, a.event_id, a.name, list(b.value order by b.sample) as v from ev a join ev b
  on b.rec_id = a.rec_id and b.sample between a.sample - 2 and a.sample + 5 group by all having count(*) = 8)
select rec_id, event_id, name, round(list_avg(v), 6) as mean, round(v[1], 6) as first from p"""


@register(EV + _EPOCHS)
def event_epochs(spark: SparkSession, root: str) -> DataFrame:
    ep = events.event_epochs(_events(spark, root), "rec_id", ["sample"], "value", 2, 5)
    return ep.select("rec_id", "event_id", "name", F.round(signals.array_mean(F.col("epoch")), 6).alias("mean"), F.round(F.col("epoch")[0], 6).alias("first"))


@register(EV + _EPOCHS + " where name in ('click', 'error')")
def event_epoch_whitelist(spark: SparkSession, root: str) -> DataFrame:
    return event_epochs(spark, root).where(F.col("name").isin("click", "error"))


_RUNS = """, m as (select *, case when lag(name) over (partition by rec_id order by sample) is not distinct from name then 0 else 1 end as fresh from ev),
g as (select *, sum(fresh) over (partition by rec_id order by sample) as run from m)
"""


@register(EV + _RUNS + "select rec_id, run::bigint as run, name, min(sample)::bigint as first, max(sample)::bigint as last, count(*) as length from g group by rec_id, run, name")
def marker_runs(spark: SparkSession, root: str) -> DataFrame:
    return events.runs(_events(spark, root), "rec_id", ["sample"], "name")


@register(EV + "select rec_id, event_id, previous, name from (select *, lag(name) over (partition by rec_id order by sample) as previous from ev) where previous <> name")
def marker_changes(spark: SparkSession, root: str) -> DataFrame:
    return events.changes(_events(spark, root), "rec_id", ["sample"], "name").select("rec_id", "event_id", "previous", "name")


@register(EV + _RUNS + """, r as (select rec_id, run, name, min(sample) as first, count(*) as length from g group by rec_id, run, name having count(*) >= 2)
select rec_id, name, first + k * 1 as start, k from r, lateral (select unnest(range(0, (length - 2) // 1 + 1)) as k)""")
def long_event_segments(spark: SparkSession, root: str) -> DataFrame:
    """Windows of two samples, one apart, within runs of equal events."""
    r = events.runs(_events(spark, root), "rec_id", ["sample"], "name").withColumnRenamed("name", "description")
    return events.long_event_segments(r, 2, 0.5).select("rec_id", F.col("description").alias("name"), "start", "k")


@register(EV + """, n as (select rec_id, max(sample) + 1 as n from ev group by rec_id), s as (select rec_id, unnest(range(0, n - 8 + 1, 8)) as start from n where n >= 8)
select s.rec_id, s.start, s.start + 7 as stop from s where not exists (select 1 from ev b where b.name = 'error' and b.rec_id = s.rec_id and b.sample between s.start and s.start + 7)""")
def drop_bad_epochs(spark: SparkSession, root: str) -> DataFrame:
    e = _events(spark, root)
    n = e.groupBy("rec_id").agg((F.max("sample") + 1).alias("n"))
    ep = n.select("rec_id", F.explode(events.segment_starts(F.col("n"), 8, 0.0)).alias("start")).withColumn("stop", F.col("start") + 7)
    bad = e.where("name = 'error'").select("rec_id", F.col("sample").alias("first"), F.col("sample").alias("last"))
    return events.drop_bad(ep, bad)


@register(EV + "select event_id, rec_id, last_value(case when name = 'click' then event_id end ignore nulls) over (partition by rec_id order by sample rows between unbounded preceding and current row) as marker from ev")
def asof_marker(spark: SparkSession, root: str) -> DataFrame:
    return events.last_before(_events(spark, root), "rec_id", ["sample"], F.col("name") == "click", "event_id", "marker").select("event_id", "rec_id", "marker")


@register("with f as (select event_type as name, min(event_id) as first from events where event_type is not null group by 1) select name, (row_number() over (order by first, name) - 1)::int as code from f")
def label_codes(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumnRenamed("event_type", "name")
    return events.codes_by_first_use(e, "name", "event_id")


@register("select event_id, event_type as description from events where not regexp_matches(lower(event_type), '^(vi|edge)') ")
def events_from_annotations(spark: SparkSession, root: str) -> DataFrame:
    """Annotations but those marked bad; here views are spelt as bad ones."""
    a = table(spark, root, "events").select("event_id", F.regexp_replace("event_type", "^vi", "BAD_vi").alias("description"))
    return events.from_annotations(a)


@register(EV + "select rec_id, event_id, 'event_' || code as name from (select rec_id, event_id, sample, length(name) % 3 as code, lag(length(name) % 3) over (partition by rec_id order by sample) as previous from ev) where previous <> code and code <> 0")
def events_from_stim(spark: SparkSession, root: str) -> DataFrame:
    stim = _events(spark, root).withColumn("code", F.length("name") % 3)
    return events.changes(stim, "rec_id", ["sample"], "code").where("code <> 0").select("rec_id", "event_id", F.concat(F.lit("event_"), F.col("code").cast("string")).alias("name"))


@register("select user_id as rec_id, event_type as name, count(*) as n from events group by all")
def event_counts(spark: SparkSession, root: str) -> DataFrame:
    return events.event_counts(_events(spark, root), "rec_id", "name")


@register("select coalesce(l.name, 'none') as name, count(*) as epochs, count(distinct e.source_id) as sources from epochs e left join event_labels l on l.code = e.event_code group by 1")
def epoch_totals(spark: SparkSession, root: str) -> DataFrame:
    e = store.denormalised(table(spark, root, "epochs").select("epoch_id", "source_id", "event_code"), table(spark, root, "sources"), table(spark, root, "event_labels"))
    return e.groupBy(F.coalesce("event_name", F.lit("none")).alias("name")).agg(F.count(F.lit(1)).alias("epochs"), F.countDistinct("source_id").alias("sources"))


@register("""with n as (select source_id, l.name, count(*) as n from epochs e join event_labels l on l.code = e.event_code group by all)
select s.source_id, s.name, s.sfreq, (select string_agg(n.name || '=' || n.n, ',' order by n.name) from n where n.source_id = s.source_id) as events from sources s""")
def meta_projection(spark: SparkSession, root: str) -> DataFrame:
    """Sources with their counts of events by name."""
    named = table(spark, root, "epochs").select("source_id", "event_code").join(table(spark, root, "event_labels").withColumnRenamed("code", "event_code"), "event_code")
    counts = events.event_counts(named, "source_id", "name").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", F.col("n").cast("string")))), ",").alias("events"))
    return table(spark, root, "sources").select("source_id", "name", "sfreq").join(counts, "source_id", "left")


@register(EV + """, t as (select rec_id, sample / (50.0::double + rec_id % 200) as t from ev)
select rec_id, count(*) as n, round((max(t) - min(t)) / (count(*) - 1), 9) as step, case when count(*) > 1 and (max(t) - min(t)) / (count(*) - 1) < 0.1 then round_even(1 / ((max(t) - min(t)) / (count(*) - 1)), 0) end as sfreq from t group by rec_id""")
def csv_rate_inference(spark: SparkSession, root: str) -> DataFrame:
    e = _events(spark, root).withColumn("t", F.col("sample") / (F.lit(50.0) + F.col("rec_id") % 200))
    return infer_rate(e, "rec_id", ["sample"], "t").select("rec_id", "n", F.round("step", 9).alias("step"), "sfreq")


# ---------------------------------------------------------------------------- moments, units
@register(SM + f"select source_id, ch, count(*) as n, {_sig('avg(value)')} + 0.0::double as mean, {_sig('stddev_pop(value)')} as std from sm group by source_id, ch")
def mean_std_channel(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(signals.moments(_samples(spark, root), ["source_id", "ch"], "value"))


def _rounded(df: DataFrame) -> DataFrame:
    """Six decimals, above a million ten digits."""
    return df.withColumns({c: F.when(F.abs(c) < 1e6, F.round(c, 6)).otherwise(F.format_string("%.9e", F.col(c)).cast("double")) for c in ("mean", "std")})


@register(SM + f"select source_id, count(*) as n, {_sig('avg(value)')} + 0.0::double as mean, {_sig('stddev_pop(value)')} as std from sm group by source_id")
def mean_std_recording(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(signals.moments(_samples(spark, root), ["source_id"], "value"))


_DOMAIN = SM + """, m as (select source_id, ch, avg(value) as mean, stddev_pop(value) as std from sm group by source_id, ch),
d as (select coalesce(s.info['site'], 'unknown') as domain, m.ch, avg(m.mean) as mean, avg(m.std) as std, count(*) as recordings from m join sources s using (source_id) group by 1, 2)
"""


def _domain_stats(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    site = table(spark, root, "sources").select("source_id", F.coalesce(F.try_element_at("info", F.lit("site")), F.lit("unknown")).alias("domain"))
    per = signals.moments(_samples(spark, root), ["source_id", "ch"], "value").join(site, "source_id")
    return per, signals.domain_moments(per, "domain", ["ch"])


@register(_DOMAIN + f"select domain, ch, {_sig('mean')} + 0.0::double as mean, {_sig('std')} as std, recordings from d")
def mean_std_domain(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(_domain_stats(spark, root)[1])


@register(_DOMAIN + "select m.source_id, m.ch, round((m.mean - d.mean) / d.std, 6) as shift from m join sources s using (source_id) join d on d.domain = coalesce(s.info['site'], 'unknown') and d.ch = m.ch")
def domain_mean_std_join(spark: SparkSession, root: str) -> DataFrame:
    """How far each recording's mean lies from its domain's, in the domain's deviations."""
    per, domain = _domain_stats(spark, root)
    d = domain.select("domain", "ch", F.col("mean").alias("dm"), F.col("std").alias("ds"))
    return per.join(d, ["domain", "ch"]).select("source_id", "ch", F.round((F.col("mean") - F.col("dm")) / F.col("ds"), 6).alias("shift"))


_Z = "case when s <= 2.220446049250313e-16 * greatest(1.0, a) then 0.0 else (value - m) / s end"
_ZSUM = "count(*) as n, round(max(z), 5) + 0.0::double as highest, round(min(z), 5) + 0.0::double as lowest"


@register(SM + f", t as (select source_id, ch, avg(value) as m, stddev_pop(value) as s, max(abs(value)) as a from sm group by source_id, ch), y as (select source_id, ch, {_Z} as z from sm join t using (source_id, ch)) select source_id, ch, {_ZSUM} from y group by source_id, ch")
def normalize_channel(spark: SparkSession, root: str) -> DataFrame:
    return _zsum(signals.zscore(_samples(spark, root), ["source_id", "ch"], "value", "z"), ["source_id", "ch"])


def _zsum(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("z"), 5).alias("highest"), F.round(F.min("z"), 5).alias("lowest"))


@register(SM + f", t as (select source_id, avg(value) as m, stddev_pop(value) as s, max(abs(value)) as a from sm group by source_id), y as (select source_id, ch, {_Z} as z from sm join t using (source_id)) select source_id, {_ZSUM} from y group by source_id")
def normalize_sample(spark: SparkSession, root: str) -> DataFrame:
    return _zsum(signals.zscore(_samples(spark, root), ["source_id"], "value", "z"), ["source_id"])


@register(SM + f", k as (select epoch_id, ch, case when ch = 1 then 7.0 else value end as value from sm), t as (select epoch_id, ch, avg(value) as m, stddev_pop(value) as s, max(abs(value)) as a from k where ch <> 3 group by epoch_id, ch), y as (select epoch_id, ch, case when ch = 3 then value else {_Z} end as z from k left join t using (epoch_id, ch)) select epoch_id, ch, {_ZSUM} from y group by epoch_id, ch")
def zscore_constant_safe(spark: SparkSession, root: str) -> DataFrame:
    """Per epoch and channel, with a constant channel and a channel that is left as it is."""
    x = _samples(spark, root).withColumn("value", F.when(F.col("ch") == 1, 7.0).otherwise(F.col("value")))
    return _zsum(signals.zscore(x, ["epoch_id", "ch"], "value", "z", F.col("ch") == 3), ["epoch_id", "ch"])


@register(SM + ", m as (select source_id, ch, avg(abs(value)) as m from sm group by all) select source_id, ch, case when m > 1 then 'uV' when m > 0.001 then 'mV' else 'V' end as unit from m")
def infer_units(spark: SparkSession, root: str) -> DataFrame:
    m = _samples(spark, root).groupBy("source_id", "ch").agg(F.avg(F.abs("value")).alias("m"))
    return m.select("source_id", "ch", signals.infer_unit(F.col("m")).alias("unit"))


@register("select vec_id, list_transform(embedding, lambda x: x::double * 1e-6) as volts from embeddings")
def convert_unit(spark: SparkSession, root: str) -> DataFrame:
    factor = signals.unit_factor(F.lit("uV"), "V")
    return table(spark, root, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * factor).alias("volts"))


@register("select vec_id, list_transform(range(0, 40), lambda i: embedding[round_even(i * ((len(embedding) - 1) / 39.0::double), 0)::int + 1]) as samples from embeddings")
def nn_resample(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select("vec_id", signals.nearest_resample(F.col("embedding"), 40).alias("samples"))


@register(EV + "select event_id, rec_id, round(0.25 * lag(value) over w + 0.5 * value + 0.25 * lead(value) over w, 6) as filtered from ev window w as (partition by rec_id order by sample)")
def fir_filter(spark: SparkSession, root: str) -> DataFrame:
    out = signals.fir(_events(spark, root), ["rec_id"], ["sample"], "value", [0.25, 0.5, 0.25], "filtered")
    return out.select("event_id", "rec_id", F.round("filtered", 6).alias("filtered"))


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]))
def channel_corr(spark: SparkSession, root: str) -> DataFrame:
    return signals.channel_correlation(table(spark, root, "lineitem"), _COLUMNS).select("a", "b", F.round("r", 6).alias("r"))


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """Each channel of each epoch with its samples as they are stored."""
    e = table(spark, root, "epochs").select("epoch_id", "source_id", F.posexplode("epoch_data").alias("ch", "data"))
    return e.select("epoch_id", "source_id", "ch", F.col("data").cast("array<double>").alias("samples"))


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    """As ``_stored``, with 0 for absent and non-finite samples, which the kernels cannot take."""
    clean = F.transform("samples", lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(0.0))
    return _stored(spark, root).withColumn("samples", clean)


def _rates(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "sources").select("source_id", "sfreq")


def _rated(spark: SparkSession, root: str) -> DataFrame:
    """As ``_blocks``, with the rate of each epoch's source, null where that is not known."""
    return _blocks(spark, root).join(_rates(spark, root), "source_id", "left")


@register()
def psd_mean(spark: SparkSession, root: str) -> DataFrame:
    """Mean spectrum of each channel over all epochs whose rate is known, at the lowest of their rates; bin k is k/64 of it."""
    low = table(spark, root, "epochs").select("source_id").join(_rates(spark, root).where("sfreq > 0"), "source_id").agg(F.min("sfreq")).first()[0]
    p = signals.welch(_rated(spark, root), "samples", "sfreq", 64, unified=low)
    return p.select("ch", F.posexplode("samples").alias("bin", "density")).groupBy("ch", "bin").agg(F.avg("density").alias("density"), F.count(F.lit(1)).alias("n"))


@register()
def psd_bands(spark: SparkSession, root: str) -> DataFrame:
    """Band powers of every epoch and channel at its own rate; spectra are padded so that each band has bins at any rate."""
    def powers(x, fs):
        freqs, p = dsp.welch(x, fs, 64, nfft=2048)
        return dsp.band_power(freqs, p)

    bands = signals.mapped_rows(_rated(spark, root), "samples", powers, sfreq="sfreq")
    return bands.select("epoch_id", "ch", *[F.col("samples")[i].alias(b) for i, b in enumerate(dsp.BANDS)])


@register()
def butterworth_filter(spark: SparkSession, root: str) -> DataFrame:
    """Deviation of each channel of each epoch after an 8 to 13 Hz band-pass at its own rate."""
    out = signals.filter_blocks(_rated(spark, root).withColumn("block", F.lit(0)), ["epoch_id", "ch"], "butter", "sfreq", l_freq=8, h_freq=13, reach=0)
    return out.select("epoch_id", "ch", F.round(signals.array_std(F.col("samples")), 6).alias("std"))


_KINDS = {"lowpass": {"h_freq": 1.0}, "highpass": {"l_freq": 0.5}, "bandpass": {"l_freq": 0.5, "h_freq": 1.5}, "notch": {"notch": 1.0}}


def _fir_sql(kind: str) -> str:
    """Taps over the whole recording at once, reflected oddly at its ends."""
    taps = dsp.firwin(kind, 4.0, **_KINDS[kind]).tolist()
    half = len(taps) // 2
    at = f"(i + k - {half})"
    value = f"case when {at} < 0 then 2 * v[1] - v[1 - {at}] when {at} >= len(v) then 2 * v[len(v)] - v[2 * len(v) - 1 - {at}] else v[{at} + 1] end"
    return f"select rec_id, '{kind}' as kind, generate_subscripts(v, 1) - 1 as sample, unnest(list_transform(range(0, len(v)), lambda i: list_sum(list_transform(range(0, {len(taps)}), lambda k: {taps}[k + 1] * ({value}))))) as y from l"


@register(EV + ", l as (select rec_id, list(coalesce(value, 0.0) order by sample) as v from ev group by rec_id), f as (" + " union all ".join(_fir_sql(k) for k in _KINDS) + ") select rec_id, kind, sample, round(y, 4) + 0.0::double as filtered from f")
def fir_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Low-pass, high-pass, band-pass and notch over the blocks of every recording of a user, taken at 4 Hz."""
    e = _events(spark, root).withColumn("value", F.coalesce("value", F.lit(0.0)))
    blocks = epoching.blocks_of(e, 16)
    done = [signals.filter_blocks(blocks, ["rec_id", "ch"], k, 4.0, **p).withColumn("kind", F.lit(k)) for k, p in _KINDS.items()]
    out = done[0].unionByName(done[1]).unionByName(done[2]).unionByName(done[3])
    return out.select("rec_id", "kind", "start", F.posexplode("samples").alias("i", "y")).select("rec_id", "kind", (F.col("start") + F.col("i")).alias("sample"), F.round("y", 4).alias("filtered"))


@register("""with c as (select epoch_id, source_id, unnest(epoch_data) as data, generate_subscripts(epoch_data, 1) - 1 as ch from epochs),
x as (select epoch_id, ch::int as ch, sfreq, list_transform(data, lambda v: case when isfinite(v::double) then v::double else 0.0 end) as v from c join sources using (source_id) where sfreq > 0 and len(data) > 0),
y as (select epoch_id, ch, greatest(1, round_even(len(v) * 100.0::double / sfreq, 0))::int as n, list_avg(v) as m, list_max(list_transform(v, lambda a: abs(a))) as top from x)
select epoch_id, ch, n, case when top < 1e5 then round(m + 3.14e-6, 5) + 0.0::double end as mean from y""")
def resample_100(spark: SparkSession, root: str) -> DataFrame:
    """Each channel of each epoch at 100 Hz. The Fourier method keeps the mean, which is shown where rounding errors are
    below its decimals, moved a little off the halves that even samples lead to."""
    rows = _rated(spark, root).where("sfreq > 0 and size(samples) > 0").withColumn("top", F.array_max(F.transform("samples", F.abs)))
    out = signals.resample(rows, "samples", "sfreq", 100.0)
    return out.select("epoch_id", "ch", F.size("samples").alias("n"), F.when(F.col("top") < 1e5, F.round(signals.array_mean(F.col("samples")) + 3.14e-6, 5) + 0.0).alias("mean"))


_CH4 = ["C3", "C4", "P3", "P4"]


@register("with x as (select source_id, " + ", ".join(f"unnest(epoch_data[{i + 1}])::double as {c}" for i, c in enumerate(_CH4)) + " from epochs), c as ("
          + " union all ".join(f"select source_id, '{a}' as a, '{b}' as b, case when stddev_pop({a}) > 0 and stddev_pop({b}) > 0 then corr({a}, {b}) end as r from (select source_id, {a}, {b}, isfinite({a}) and isfinite({b}) as fine from x) where coalesce(fine, false) and abs({a}) < 1e15 and abs({b}) < 1e15 group by source_id" for i, a in enumerate(_CH4) for b in _CH4[i + 1 :])
          + ") select source_id, a, b, round(r, 5) + 0.0::double as r from c")
def recording_corr(spark: SparkSession, root: str) -> DataFrame:
    """Correlation of every two channels over all epochs of a source; readings from 1e15 on are no signal and taken as absent."""
    e = table(spark, root, "epochs").select("source_id", F.explode(F.arrays_zip(*[F.get("epoch_data", F.lit(i)).alias(c) for i, c in enumerate(_CH4)])).alias("x"))
    held = e.select("source_id", *[F.when(F.abs(F.col("x")[c]) < 1e15, F.col("x")[c].cast("double")).alias(c) for c in _CH4])
    found = signals.recording_correlation(held, ["source_id"], _CH4)
    return found.select("source_id", "a", "b", (F.round("r", 5) + 0.0).alias("r"))


@register()
def ica_cleaned(spark: SparkSession, root: str) -> DataFrame:
    """Each epoch without its components of excess kurtosis above 5, with the deviations that are left."""
    out = signals.ica_apply(_blocks(spark, root).drop("source_id"), ["epoch_id"], kurtosis=5.0, deviation=True)
    return out.select("epoch_id", "ch", "removed", "std")


@register()
def ica_components(spark: SparkSession, root: str) -> DataFrame:
    """Independent components of each epoch, all of them with all their samples."""
    return signals.ica(_blocks(spark, root).drop("source_id"), ["epoch_id"]).select("epoch_id", "component", F.size("samples").alias("n"), "samples")


# ---------------------------------------------------------------------------- quality
_E = "list_transform(embedding, lambda x: x::double * 200)"


def _scaled(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 200).alias("s"))


@register(f"with e as (select vec_id, {_E} as s from embeddings) select vec_id, 100.0 * len(list_filter(s, lambda x: x >= -100 and x < 110)) / nullif(len(list_filter(s, lambda x: x >= -1000 and x <= 1000)), 0) as score from e")
def amp_score(spark: SparkSession, root: str) -> DataFrame:
    return _scaled(spark, root).select("vec_id", quality.amplitude_score(F.col("s")).alias("score"))


@register(f"with e as (select vec_id, list_transform({_E}, lambda x: abs(x)) as s from embeddings) select vec_id, round(100.0 * list_sum(list_filter(s, lambda x: x > list_max(s) * 0.01)) / list_sum(s), 6) as score from e")
def energy_score(spark: SparkSession, root: str) -> DataFrame:
    return _scaled(spark, root).select("vec_id", F.round(quality.energy_score(F.col("s")), 6).alias("score"))


@register(f"with e as (select vec_id, {_E} as s from embeddings) select vec_id, 100.0 * len(list_filter(s, lambda x: abs(x) <= 20)) / len(s) as score from e")
def beta_score(spark: SparkSession, root: str) -> DataFrame:
    return _scaled(spark, root).select("vec_id", quality.share_below(F.col("s"), 20, True).alias("score"))


@register(f"with e as (select vec_id, {_E} as s from embeddings) select vec_id, 100.0 * len(list_filter(s, lambda x: x <= 30)) / len(s) as score from e")
def theta_score(spark: SparkSession, root: str) -> DataFrame:
    return _scaled(spark, root).select("vec_id", quality.share_below(F.col("s"), 30, False).alias("score"))


@register("with m as (select vec_id, label, list_max(embedding) as top from embeddings), r as (select vec_id, row_number() over (partition by label order by top desc, vec_id) as r, count(*) over (partition by label) as n from m) select vec_id, case when r <= ceil(n * 0.5) then 1.0::double when r <= ceil(n * 0.75) then 0.5::double else 0.0::double end as score from r")
def amp_rank_score(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "embeddings").select("vec_id", "label", F.array_max("embedding").alias("top"))
    return quality.rank_score(m, ["label"], "top", "vec_id").select("vec_id", "score")


@register()
def quality_shady(spark: SparkSession, root: str) -> DataFrame:
    """Mean of the scores of each epoch over all its channels, averaged per source."""
    names = table(spark, root, "channels").select(F.col("ordinal").alias("ch"), "name", channels.hemisphere(F.col("name")).alias("side"))
    s = quality.signal_score(_rated(spark, root).join(F.broadcast(names), "ch", "left"), ["source_id", "epoch_id"], "name", "side", "samples", "sfreq")
    return s.groupBy("source_id").agg(F.round(F.avg("score"), 4).alias("score"), F.sum("channels").alias("channels"))


# ---------------------------------------------------------------------------- store
@register("select epoch_id, list_transform([4, 1], lambda c: case when isfinite(epoch_data[c][17]::double) then round(epoch_data[c][17]::double, 6) + 0.0::double end) as picked, len(epoch_data[4][17:32]) as width from epochs")
def epoch_window_read(spark: SparkSession, root: str) -> DataFrame:
    """Sixteen samples of two channels in the order asked for, from a store written before."""
    folder = scratch_path(spark, "store")
    store.write_store({n: table(spark, root, n) for n in store.TABLES}, folder, validate=False)  # the dirty epochs are to be read as they are
    reader = store.EpochStore(spark, folder)
    names = {r["ordinal"]: r["name"] for r in reader.tables["channels"].collect()}
    data = reader.tables["epochs"].select("epoch_id", store.window(F.col("epoch_data"), [3, 0], 16, 16).alias("d"))
    assert len(names) == 4
    value = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c.cast("double"), 6))
    return data.select("epoch_id", F.transform("d", lambda c: value(F.get(c, F.lit(0)))).alias("picked"), F.size(F.col("d")[0]).alias("width"))


@register("select epoch_id, source_id, (row_number() over (partition by source_id order by epoch_id) - 1)::int as source_epoch_index, event_code from epochs")
def star_epochs(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "epochs").select("epoch_id", "source_id", "event_code")
    return store.epoch_indices(rows, "source_id", "epoch_id").select("epoch_id", "source_id", "source_epoch_index", "event_code")


@register("select s.source_id, coalesce(e.n, 0) as n_epochs, m.mask::varchar as mask from sources s left join (select source_id, count(distinct source_epoch_index) as n from epochs group by 1) e using (source_id) left join (select mask_id, array_to_string(mask, '') as mask from channel_masks) m on m.mask_id = s.channel_mask_id")
def star_sources(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "epochs").groupBy("source_id").agg(F.countDistinct("source_epoch_index").alias("n_epochs"))
    masks = table(spark, root, "channel_masks").select(F.col("mask_id").alias("channel_mask_id"), F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"))
    s = table(spark, root, "sources").select("source_id", "channel_mask_id").join(n, "source_id", "left").join(masks, "channel_mask_id", "left")
    return s.select("source_id", F.coalesce("n_epochs", F.lit(0).cast("bigint")).alias("n_epochs"), "mask")


@register("with f as (select l.name, min(e.epoch_id) as first from epochs e join event_labels l on l.code = e.event_code group by 1) select name, (row_number() over (order by first, name) - 1)::int as code from f")
def star_labels(spark: SparkSession, root: str) -> DataFrame:
    named = table(spark, root, "epochs").select("epoch_id", F.col("event_code").alias("code")).join(table(spark, root, "event_labels"), "code")
    return store.coded(named.select("epoch_id", "name"), "name", "epoch_id", "code")


@register("with f as (select array_to_string(m.mask, '') as mask, min(s.source_id) as first from sources s join channel_masks m on m.mask_id = s.channel_mask_id group by 1) select mask, (row_number() over (order by first, mask) - 1)::int as code from f")
def star_masks(spark: SparkSession, root: str) -> DataFrame:
    masks = table(spark, root, "channel_masks").select(F.col("mask_id").alias("channel_mask_id"), F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"))
    return store.coded(table(spark, root, "sources").join(masks, "channel_mask_id").select("source_id", "mask"), "mask", "source_id", "code")


@register("select e.epoch_id, coalesce(s.file_path, 'unresolved:' || s.name) as source, e.event_code, l.name as event_name from epochs e left join sources s using (source_id) left join event_labels l on l.code = e.event_code")
def epochs_denormalised(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "epochs").select("epoch_id", "source_id", "event_code")
    return store.denormalised(rows, table(spark, root, "sources"), table(spark, root, "event_labels")).select("epoch_id", "source", "event_code", "event_name")


@register("select s.name, coalesce(s.sfreq, 0) as rs_freq, count(*) as groups, sum(len(e.epoch_data) * len(e.epoch_data[1]))::bigint as samples, 'C3,C4,P3,P4' as ch_order from epochs e join sources s using (source_id) group by 1, 2")
def export_v1(spark: SparkSession, root: str) -> DataFrame:
    """One group per source with its rate, size and order of channels."""
    order = ",".join(r[0] for r in table(spark, root, "channels").orderBy("ordinal").select("name").collect())
    e = table(spark, root, "epochs").select("source_id", (F.size("epoch_data") * F.size(F.col("epoch_data")[0])).cast("bigint").alias("k"))
    s = table(spark, root, "sources").select("source_id", "name", F.coalesce("sfreq", F.lit(0.0)).alias("rs_freq"))
    per = e.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k")).join(s, "source_id")
    return per.groupBy("name", "rs_freq").agg(F.sum("n").alias("groups"), F.sum("k").alias("samples")).withColumn("ch_order", F.lit(order))


@register("""with recursive z as (select source_id as k, coalesce(n_epochs, 1) * 1024 as s, row_number() over (order by source_id) as r from sources),
w as (select r, k, s, s as used, 0 as part from z where r = 1 union all
 select z.r, z.k, z.s, case when w.used + z.s > 65536 then z.s else w.used + z.s end, case when w.used + z.s > 65536 then w.part + 1 else w.part end from w join z on z.r = w.r + 1)
select k::bigint as source_id, s::bigint as bytes, part::int as part from w""")
def greedy_split(spark: SparkSession, root: str) -> DataFrame:
    sizes = table(spark, root, "sources").select(F.col("source_id").cast("bigint").alias("source_id"), (F.coalesce("n_epochs", F.lit(1)) * 1024).alias("bytes"))
    return store.greedy_parts(sizes, "source_id", "bytes", 65536)


@register("with x as (select epoch_id, generate_subscripts(epoch_data[1], 1) - 1 as sample, " + ", ".join(f"unnest(epoch_data[{i + 1}])::double as c{i}" for i in range(4)) + " from epochs) select x.epoch_id, x.sample, "
          + ", ".join(f"case when isfinite(c{i}) then round(c{i}, 6) + 0.0::double end as {n}" for i, n in enumerate(("C3", "C4", "P3", "P4"))) + ", case when x.sample = 0 then l.name end as marker from x join epochs e using (epoch_id) left join event_labels l on l.code = e.event_code")
def wide_export_with_marker(spark: SparkSession, root: str) -> DataFrame:
    """Every sample of every channel, a row per sample, with the event at the first one."""
    labels = table(spark, root, "event_labels").select(F.col("code").alias("event_code"), F.col("name").alias("event"))
    e = table(spark, root, "epochs").select("epoch_id", "event_code", "epoch_data").join(labels, "event_code", "left")
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.round(x.cast("double"), 6))
    return store.wide_export(e, "epoch_id", "epoch_data", ["C3", "C4", "P3", "P4"], "event", finite)


def _kept(spark: SparkSession, root: str, windows: DataFrame, label: str) -> DataFrame:
    """Epochs of windows over the recordings of users, written to a store, validated and read again."""
    e = _events(spark, root)
    epochs = epoching.cut_epochs(epoching.blocks_of(e, 8), windows, 8)
    users = e.groupBy("rec_id").agg(F.lit(1.0).alias("sfreq"))
    path = F.concat(F.lit("/raw//user/"), F.lpad(F.col("rec_id").cast("string"), 9, "0"), F.lit(".csv"))
    recordings = users.select("rec_id", path.alias("file_path"), F.lit("user").alias("name"), "sfreq", F.array(F.lit(1)).cast("array<tinyint>").alias("mask"), F.create_map(F.lit("site"), F.lit("web")).alias("info"))
    channels = spark.createDataFrame([(0, "value", "misc")], "ordinal int, name string, type string")
    folder = scratch_path(spark, label)
    store.write_store(epoching.store_tables(epochs, recordings, channels), folder)
    t = store.EpochStore(spark, folder).tables
    data = F.col("epoch_data")[0]
    rows = t["epochs"].join(t["sources"].select("source_id", "file_path", "n_epochs"), "source_id").join(t["event_labels"].withColumnsRenamed({"code": "event_code", "name": "event"}), "event_code")
    return rows.select("file_path", "source_epoch_index", F.col("source_start_sample").alias("start"), "event", "n_epochs", F.size(data).alias("width"), F.round(signals.array_sum(data), 3).alias("total"))


_PATH = "'/raw//user/' || lpad(rec_id::varchar, 9, '0') || '.csv'"


@register(EV + f""", n as (select rec_id, max(sample) + 1 as n from ev group by rec_id), s as (select rec_id, unnest(range(0, n - 16 + 1, 8)) as start from n where n >= 16),
w as (select s.rec_id, s.start, round(sum(value::float::double), 3) as total from s join ev on ev.rec_id = s.rec_id and ev.sample >= s.start and ev.sample < s.start + 16 group by s.rec_id, s.start)
select {_PATH} as file_path, (row_number() over (partition by rec_id order by start) - 1)::int as source_epoch_index, start, 'Segment' as event, count(*) over (partition by rec_id) as n_epochs, 16 as width, total from w""")
def segment_epochs_store(spark: SparkSession, root: str) -> DataFrame:
    """Half-overlapping segments of every recording in a store."""
    n = _events(spark, root).groupBy("rec_id").agg((F.max("sample") + 1).alias("n_samples"), F.lit(1.0).alias("sfreq"))
    return _kept(spark, root, epoching.windows_for("segment", recordings=n, seconds=16.0, overlap=0.5), "segment-store")


@register(EV + f""", p as (select a.rec_id, a.sample - 2 as start, a.name, sum(b.value::float::double) as total from ev a join ev b
  on b.rec_id = a.rec_id and b.sample between a.sample - 2 and a.sample + 5 where a.name in ('click', 'error') group by all having count(*) = 8)
select {_PATH} as file_path, (row_number() over (partition by rec_id order by start) - 1)::int as source_epoch_index, start, name as event, count(*) over (partition by rec_id) as n_epochs, 8 as width, round(total, 3) as total from p""")
def event_epochs_store(spark: SparkSession, root: str) -> DataFrame:
    """Epochs around two kinds of events in a store."""
    return _kept(spark, root, epoching.windows_for("event", events=_events(spark, root), before=2, after=5, names=["click", "error"]), "event-store")


@register("""with n as (select source_id, sfreq, coalesce(n_epochs, 0) * 64 as n from sources), b as (select source_id, n, least(floor(sfreq * 5)::bigint, greatest(1, n // 4)) as size from n where sfreq is not null)
select source_id, case when n < 3 * size then [0, n] else [0, size, (n - size) // 2, size, n - size, size] end as cuts from b""")
def data_hash_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Head, middle and tail that stand for a signal."""
    s = table(spark, root, "sources").where("sfreq is not null").select("source_id", "sfreq", (F.coalesce("n_epochs", F.lit(0).cast("bigint")) * 64).alias("n"))
    cuts = F.flatten(F.transform(hashing.block_starts(F.col("n"), F.col("sfreq")), lambda b: F.array(b["start"], b["length"])))
    return s.select("source_id", cuts.alias("cuts"))


@register()
def data_hash(spark: SparkSession, root: str) -> DataFrame:
    """Hash of each epoch's data, by which re-appended epochs are found."""
    e = _stored(spark, root).select("epoch_id", F.concat(F.lit("ch"), F.col("ch").cast("string")).alias("ch_name"), F.lit(4.0).alias("fs"), "samples")
    return hashing.data_hash(e, ["epoch_id"], "fs")


@register("select e.epoch_id, s.name, c.name as ch_name, len(e.epoch_data[c.ordinal + 1])::int as n from epochs e join sources s using (source_id) cross join channels c where c.type = 'eeg' and s.sfreq between 200 and 600")
def load_pipeline(spark: SparkSession, root: str) -> DataFrame:
    """Load steps in their order: choose recordings, name and type channels, pick types."""
    chosen = table(spark, root, "sources").where(F.col("sfreq").between(200, 600)).select("source_id", "name")
    names = table(spark, root, "channels").select(F.col("ordinal").alias("ch"), F.col("name").alias("ch_name"), F.col("type").alias("ch_type"))
    steps = batch.Pipeline([
        lambda d: d.join(chosen, "source_id"),
        lambda d: d.select("epoch_id", "name", F.posexplode("epoch_data").alias("ch", "samples")),
        lambda d: d.join(names, "ch").where(F.col("ch_type") == "eeg"),
    ])
    return steps.forward(table(spark, root, "epochs").select("epoch_id", "source_id", "epoch_data")).select("epoch_id", "name", "ch_name", F.size("samples").alias("n"))


# ---------------------------------------------------------------------------- windows of time
@register("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark: SparkSession, root: str) -> DataFrame:
    """Tumbling windows, the table form of the streaming operator."""
    e = table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = windows.tumbling(e, "ts", "1 day", ["event_type"], "value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) >= interval '6 hours' or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def event_sessions(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sessions(e, "ts", "6 hours", ["user_id"]).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


QUERIES, ORACLE = register.queries, register.oracle
