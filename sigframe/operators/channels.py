"""Channel names: types, formatting, hemispheres, selection and alignment, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.operators.packed_fields import let

#: Prefixes of typed channels and the type they stand for.
TYPE_ALIASES = {
    "EEG": "eeg",
    "DUAL": "eeg",
    "EEGDUAL": "eeg",
    "EOG": "eog",
    "EMG": "emg",
    "ECG": "ecg",
    "EKG": "ecg",
    "STIM": "stim",
    "MISC": "misc",
    "UNKNOWN": "bio",
    "BIO": "bio",
    "MEG": "meg",
    "MAG": "mag",
    "GRAD": "grad",
    "REF_MEG": "ref_meg",
    "RESP": "resp",
    "DBS": "dbs",
    "SEEG": "seeg",
    "ECOG": "ecog",
    "TEMP": "temperature",
    "TEMPERATURE": "temperature",
    "GSR": "gsr",
    "PUPIL": "pupil",
    "EYETRACK": "eyegaze",
    "EYEGAZE": "eyegaze",
    "FNIRS": "fnirs_cw_amplitude",
    "CSD": "csd",
    "HBO": "hbo",
    "HBR": "hbr",
    "FNIRS_OD": "fnirs_od",
    "FNIRS_CW_AMPLITUDE": "fnirs_cw_amplitude",
    "FNIRS_FD_AC_AMPLITUDE": "fnirs_fd_ac_amplitude",
    "FNIRS_FD_PHASE": "fnirs_fd_phase",
    "CHPI": "chpi",
    "DIPOLE": "dipole",
    "GOF": "gof",
    "EXCI": "exci",
    "IAS": "ias",
    "SYST": "syst",
}
#: Mistaken orders of the letters of a position and the right ones.
SWAPPED = {"FAF": "AFF", "CFC": "FCC", "CPC": "CCP", "POP": "PPO", "TPT": "TTP", "TFT": "FTT"}
#: Words that are no part of a name at its ends.
_HEAD = r"^(?:(?:EEG|REF|LE|[-_:.])\s*)+"
_TAIL = r"(?:\s*(?:EEG|REF|LE|[-_:.]))+$"


def _mapped(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def channel_type(name: Column) -> Column:
    """The type that a typed channel ``type:name`` states, ``bio`` for an unknown one, null for an untyped channel."""
    prefix, rest = F.trim(F.substring_index(name, ":", 1)), F.trim(F.substring(name, F.instr(name, ":") + 1, 1_000_000))
    typed = (F.instr(name, ":") > 0) & (F.length(prefix) > 0) & (F.length(rest) > 0)
    return F.when(typed, F.coalesce(_mapped(F.upper(prefix), TYPE_ALIASES), F.lit("bio")))


def format_channel(entry: Column, vocabulary: list[str]) -> Column:
    """``type:name`` of one channel: stated type, else by the words in the name, else by position, else ``bio``.

    ``vocabulary`` is the list of known positions with their spelling. A name that loses all its
    letters to its type keeps the token (``ECG`` -> ``ecg:ECG``).
    """
    names = F.create_map(*[F.lit(x) for v in sorted(set(vocabulary)) for x in (v.upper(), v)])

    def formatted(e: Column) -> Column:
        low = F.lower(e)
        stated = channel_type(e)
        rest = F.trim(F.substring(e, F.instr(e, ":") + 1, 1_000_000))
        bare = F.trim(F.regexp_replace(F.regexp_replace(e, _HEAD, ""), _TAIL, ""))

        def by_word(kind: str, words: str) -> Column:
            left = F.trim(F.regexp_replace(bare, words, ""))
            return F.concat(F.lit(kind + ":"), F.when(F.length(left) > 0, left).otherwise(bare))

        swapped = F.upper(bare)
        for a, b in SWAPPED.items():
            swapped = F.when(F.upper(bare).startswith(a), F.concat(F.lit(b), F.substring(F.upper(bare), len(a) + 1, 100))).otherwise(swapped)
        known = F.try_element_at(names, swapped)
        sides = F.split(bare, "-")
        # fixed values: words beside a hyphen that make no pair
        refs = ["REF", "LE", "EEG", "ECG", "EOG", "EMG", "EKG", "MEG"]
        pair = (F.size(sides) == 2) & (F.length(F.get(sides, F.lit(0))) > 0) & (F.length(F.get(sides, F.lit(1))) > 0)
        pair = pair & ~F.upper(F.trim(F.get(sides, F.lit(0)))).isin(refs) & ~F.upper(F.trim(F.get(sides, F.lit(1)))).isin(refs)
        # fixed values: words that tell the type of a channel, in the order in which they are asked for
        return (
            F.when(low.startswith("misc:"), F.concat(F.lit("misc:"), F.substring(e, 6, 1_000_000)))
            .when(stated.isNotNull(), F.concat(stated, F.lit(":"), rest))
            .when(F.lower(bare).rlike("eog|loc|roc"), by_word("eog", "EOG:|EOG|eog"))
            .when(F.lower(bare).contains("meg"), by_word("meg", "MEG:|MEG|meg"))
            .when(F.lower(bare).contains("emg"), by_word("emg", "EMG:|EMG|emg"))
            .when(F.lower(bare).rlike("ecg|ekg"), by_word("ecg", "ECG:|ECG|ecg"))
            .when(pair, F.concat(F.lit("eeg:"), bare))
            .when(F.lower(bare).rlike("stim|event|marker"), by_word("stim", "STIM:|STIM|stim"))
            .when(known.isNotNull(), F.concat(F.lit("eeg:"), known))
            .otherwise(F.concat(F.lit("bio:"), F.when(F.length(bare) > 0, bare).otherwise(e)))
        )

    return let(F.trim(entry), formatted)


def format_channels(names: Column, vocabulary: list[str], style: str = "typed") -> Column:
    """All channels of a comma-separated text formatted; the text as it is where two would become the same.

    ``style='plain'`` leaves out the types.
    """
    made = F.transform(F.split(names, ","), lambda e: format_channel(e, vocabulary))

    def joined(m: Column) -> Column:
        shown = m if style == "typed" else F.transform(m, lambda x: F.substring(x, F.instr(x, ":") + 1, 1_000_000))
        return F.when(F.size(F.array_distinct(m)) < F.size(m), names).otherwise(F.array_join(shown, ", "))

    return let(made, joined)


def format_catalogue(df: DataFrame, key: str, names: str, vocabulary: list[str], style: str = "typed") -> DataFrame:
    """(key, names): the comma-separated ``names`` of each row formatted as by ``format_channels``.

    Each distinct entry is formatted once, and the entries of a row are put together again in their order; so the work depends on how
    many different entries there are. Null names stay null; ``key`` is unique.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(names).alias("_n"))
    entries = rows.select("_k", F.posexplode(F.split("_n", ",")).alias("_p", "_e"))
    made = entries.select("_e").distinct().select("_e", format_channel(F.col("_e"), vocabulary).alias("_m"))
    lists = entries.join(made, "_e").groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_p", "_m"))).alias("_l"))
    m = F.col("_l._m")
    shown = m if style == "typed" else F.transform(m, lambda x: F.substring(x, F.instr(x, ":") + 1, 1_000_000))
    out = F.when(F.col("_l").isNull() | (F.size(F.array_distinct(m)) < F.size(m)), F.col("_n")).otherwise(F.array_join(shown, ", "))
    return rows.join(lists, "_k", "left").select(F.col("_k").alias(key), out.alias(names))


def dedup_names(names: Column) -> Column:
    """Channel names with ``_1``, ``_2``, ... after the second and later of equal ones, in order."""
    return F.transform(
        names,
        lambda x, i: let(
            F.size(F.filter(F.slice(names, F.lit(1), i), lambda y: y == x)),
            lambda n: F.when(n > 0, F.concat(x, F.lit("_"), n.cast("string"))).otherwise(x),
        ),
    )


def hemisphere(name: Column) -> Column:
    """``left``, ``right`` or ``midline`` by the number or z at the end of a position, else ``other``."""
    n = F.regexp_extract(F.upper(F.trim(name)), r"^(?:FP|AF|FT|FC|TP|CP|PO|F|T|C|P|O|A|M|I)(\d+|Z)$", 1)
    return F.when(n == "", "other").when(n == "Z", "midline").when(n.try_cast("int") % 2 == 1, "left").otherwise("right")


def is_misc(name: Column) -> Column:
    """True for a label channel ``misc:{task}``."""
    return F.lower(F.trim(name)).startswith("misc:")


def misc_task(name: Column) -> Column:
    """The task of a label channel, null for other channels."""
    return F.when(is_misc(name), F.trim(F.substring(F.trim(name), 6, 1_000_000)))


def pick_types(channels: DataFrame, types: list[str], column: str = "ch_type") -> DataFrame:
    """Rows of the given channel types."""
    return channels.where(F.col(column).isin(*types))


def align(signals: DataFrame, order: DataFrame, *, missing: str = "drop", least: int = 1) -> DataFrame:
    """Channels of each recording in the target order: (rec_id, ordinal, ch_name, value, present).

    ``order`` (ordinal, ch_name) is a small table. ``missing='zero'`` adds absent channels with value 0,
    ``'drop'`` leaves them out. Recordings with fewer than ``least`` of the channels are left out. Names
    are compared without regard to case; of repeated channels of a recording each is kept.
    """
    if missing not in ("drop", "zero"):
        raise ValueError(missing)
    rows = order.select(F.col("ordinal").cast("int"), "ch_name").where("ordinal is not null and ch_name is not null").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("an order of at most 10,000 channels")
    wanted = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("ch_name"), F.lit(n.lower()).alias("_k")) for i, n in sorted(map(tuple, rows))])
    have = signals.withColumn("_k", F.lower("ch_name")).drop("ch_name")
    found = have.withColumn("_w", F.explode(F.filter(wanted, lambda w: w["_k"] == F.col("_k")))).select(*have.columns, "_w.ordinal", "_w.ch_name")
    enough = found.groupBy("rec_id").agg(F.countDistinct("_k").alias("_n")).where(F.col("_n") >= least).select("rec_id")
    if missing == "drop":
        return found.join(enough, "rec_id").select("rec_id", "ordinal", "ch_name", "value", F.lit(True).alias("present"))
    grid = enough.select("rec_id", F.explode(wanted).alias("_w")).select("rec_id", "_w.*")
    return grid.join(have, ["rec_id", "_k"], "left").select(
        "rec_id", "ordinal", "ch_name", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("present")
    )
