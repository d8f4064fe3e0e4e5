"""Mapping freely typed values to the entries of a reference list.

Method: a BK-tree over the spellings of the reference entries under an edit distance that is a true metric, so that the
triangle inequality prunes without losing an entry. Every text that is not letter for letter a name asks the tree: first for its own
key, which follows one path, then for all entries within its radius. A reference list of checked size is broadcast and
matched on the map side, once per distinct key and batch, without any shuffle. A larger list is cut into shards of entries and
blocks of texts, each block meets the tree of every shard, and the winners of the shards merge by the same rule.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, permutations, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.functions.skew import join_unique

#: Up to so many reference entries the list is broadcast; beyond, it is sharded.
BROADCAST_ENTRIES = 100_000
UNMATCHED = -1


def edit_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insert, delete, replace, transpose.

    >>> edit_distance("rigth", "right"), edit_distance("ca", "abc"), edit_distance("", "ab")
    (1, 2, 2)
    """
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    big = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            cost = 1
            if x == y:
                cost, match = 0, j
            d[i + 1][j + 1] = min(
                d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1)
            )
        last[x] = i
    return d[-1][-1]


#: Costs of the weighted distance: a letter left out, replaced or swapped; a figure; a blank; a leading naught; any other sign.
LETTER, FIGURE, BLANK, NAUGHT, SIGN = 4, 16, 1, 1, 8
#: Signs that are taken for each other, and what that costs.
ALIKE, ALIKE_COST = (("o", "0"), ("l", "1")), 2
_LETTERS, _FIGURES = "abcdefghijklmnopqrstuvwxyz", "0123456789"


@lru_cache(1)
def _costs() -> dict[tuple[str, str], int]:
    """Cost of turning one sign into another (``''`` for none), closed under the triangle inequality.

    Signs outside the letters and figures cost alike and are kept under ``'?'``.
    """
    signs = ["", " ", "?", *_LETTERS, *_FIGURES]
    own = {"": 0, " ": BLANK, "?": SIGN, "0": NAUGHT} | dict.fromkeys(_LETTERS, LETTER)
    c = {}
    for x in signs:
        for y in signs:
            a, b = own.get(x, FIGURE), own.get(y, FIGURE)
            c[x, y] = 0 if x == y else max(a, b) if not (x and y) else LETTER if x in _LETTERS and y in _LETTERS else FIGURE if x in _FIGURES and y in _FIGURES else a + b
    for x, y in ALIKE:
        c[x, y] = c[y, x] = ALIKE_COST
    for k in signs:
        for x in signs:
            for y in signs:
                if c[x, k] + c[k, y] < c[x, y]:
                    c[x, y] = c[x, k] + c[k, y]
    return c


@lru_cache(200_000)
def weighted_distance(a: str, b: str) -> int:
    """Least total cost of insertions, deletions, replacements and swaps of neighbouring letters.

    Costs are symmetric and closed under the triangle inequality, so that this is a metric.

    >>> weighted_distance("fc3", "fc 03"), weighted_distance("rigth", "right"), weighted_distance("01", "o1"), weighted_distance("f1", "f2")
    (2, 4, 2, 16)
    """
    if a == b:
        return 0
    cost = _costs()
    known = lambda x: x if (x, "") in cost else "?"
    ka, kb = [known(x) for x in a], [known(x) for x in b]
    gone, come = [cost[x, ""] for x in ka], [cost["", y] for y in kb]
    n, m = len(a), len(b)
    upto_a, upto_b = [0, *accumulate(gone)], [0, *accumulate(come)]
    big = upto_a[n] + upto_b[m] + 1
    d = [[big] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = upto_a[i]
    for j in range(m + 1):
        d[1][j + 1] = upto_b[j]
    last: dict[str, int] = {}
    for i in range(1, n + 1):
        x, kx, match = a[i - 1], ka[i - 1], 0
        up, row = d[i], d[i + 1]
        for j in range(1, m + 1):
            y = b[j - 1]
            best = min(up[j] + (0 if x == y else cost[kx, kb[j - 1]] or 2 * SIGN), row[j] + come[j - 1], up[j + 1] + gone[i - 1])
            k = last.get(y, 0)
            if k and match and kx in _LETTERS and kb[j - 1] in _LETTERS:
                swapped = d[k][match] + (upto_a[i - 1] - upto_a[k]) + LETTER + (upto_b[j - 1] - upto_b[match])
                best = min(best, swapped)
            if x == y:
                match = j
            row[j + 1] = best
        last[x] = i
    return d[n + 1][m + 1]


class BKTree:
    """Burkhard-Keller tree over distinct strings under a metric.

    ``within(text, radius)`` returns every stored string at most ``radius`` away, with its
    distance, in order of (distance, string).
    """

    def __init__(self, words: Iterable[str], metric: Callable[[str, str], int] = edit_distance):
        self.metric = metric
        self.root: tuple[str, dict] | None = None
        self.longest = 0
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        self.longest = max(self.longest, len(word))
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while True:
            d = self.metric(word, node[0])
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (word, {})
                return
            node = node[1][d]

    def within(self, text: str, radius: int) -> list[tuple[int, str]]:
        if len(text) > self.longest + radius:  # a sign costs 1 at least
            return []
        found, stack = [], [self.root] if self.root else []
        while stack:
            word, children = stack.pop()
            d = self.metric(text, word)
            if d <= radius:
                found.append((d, word))
            stack.extend(child for k, child in children.items() if d - radius <= k <= d + radius)
        return sorted(found)


def radius_for(key: str) -> int:
    """Cost allowed: blanks and look-alikes in short texts, one letter more from five on, two from nine on."""
    n = sum(c.isalpha() for c in key)
    return 3 if n < 5 else 5 if n < 9 else 9


class Matcher:
    """Finds the reference entry of a text: its exact name, else the nearest spelling in the tree.

    ``names`` are (id, name) pairs, ``spellings`` (id, key) pairs with any number of keys per id. ``key`` maps a text to the string that is
    compared. A nearest spelling counts only if all spellings at that distance belong to one id; so
    ties between entries stay unmatched rather than being decided at random.
    """

    def __init__(self, names: list[tuple[int, str]], spellings: list[tuple[int, str]], key: Callable[[str], str] = str.casefold,
                 radius: Callable[[str], int] = radius_for, metric: Callable[[str, str], int] = weighted_distance):
        self.key, self.radius = key, radius
        self.exact: dict[str, int] = {}
        for i, name in sorted(names):
            self.exact.setdefault(name, i)
        self.ids: dict[str, set[int]] = {}
        for i, k in spellings:
            if k:
                self.ids.setdefault(k, set()).add(i)
        self.tree = BKTree(sorted(self.ids, key=lambda w: (len(w), w)), metric)
        self.known: dict[str, tuple[int, int, int]] = {}

    def nearest(self, key: str) -> tuple[int, int, int]:
        """(distance, least id, greatest id) of the nearest spellings within the radius; (-1, -1, -1) if there are none."""
        if key not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            near = self.tree.within(key, 0) or self.tree.within(key, self.radius(key)) if key else []
            ids = {i for d, w in near if d == near[0][0] for i in self.ids[w]}
            self.known[key] = (near[0][0], min(ids), max(ids)) if near else (-1, UNMATCHED, UNMATCHED)
        return self.known[key]

    def match(self, text: str | None) -> tuple[int, int]:
        """(entry id or -1, distance or -1)."""
        if text is None:
            return UNMATCHED, -1
        if text in self.exact:
            return self.exact[text], 0
        d, lo, hi = self.nearest(self.key(text))
        return (lo, d) if lo == hi and d >= 0 else (UNMATCHED, -1)


# --------------------------------------------------------------------------- channel keys
#: Spellings of the words used in channel names, by the word they mean.
WORDS = {
    "left": "left l links gauche",
    "right": "right r rechts droite",
    "upper": "upper up oben",
    "eog": "eog veog heog",
    "emg": "emg",
    "ecg": "ecg ekg",
    "chin": "chin submental kinn mental",
    "leg": "leg bein tib tibialis",
    "chest": "chest thorax tho thor thoracic",
    "abdomen": "abdomen abd abdo abdominal",
    "nasal": "nasal nose nasale",
    "resp": "resp respiration effort flow breathing",
    "temp": "temp temperature temperatur",
    "skin": "skin haut",
    "gsr": "gsr eda galvanic conductance",
    "palm": "palm hand",
    "spo2": "spo2 sao2 saturation",
    "stim": "stim trig trigger status event marker sti",
    "mastoid": "mastoid",
    "earlobe": "earlobe",
    "vertex": "vertex",
    "inion": "inion",
}
#: Words that a name may go without, and whole spellings of entries by their name in small letters.
OPTIONAL = ("emg", "resp", "skin", "palm")
SPELLINGS = {
    "eog left": "loc", "eog right": "roc", "eog upper": "above the eye", "cz": "vertex|vertex electrode", "iz": "inion",
    "ecg": "ecg ii|ecg i|ecg 1|ecg lead|ecg lead ii|ecg heart|heart ecg|heart|ekg ii|ekg i|ekg 1|ekg lead ii",
    "resp nasal": "airflow|nasal pressure|nasal airflow", "emg leg left": "tib ant left|left tib ant", "emg leg right": "tib ant right|right tib ant",
    "temp skin": "hauttemperatur", "gsr palm": "skin conductance|galvanic skin response|galvanic skin", "spo2": "o2 sat|spo2 finger|finger spo2",
    "stim": "sti 014|stim 014|sti 1|stim 1|trig 1|trigger 1|stim channel|trigger channel|status channel|event marker",
}
_LOOKALIKE = str.maketrans("АВСЕНІКМОРТХУасеорхуіΑΒΕΗΙΚΜΝΟΡΤΧ", "ABCEHIKMOPTXYaceopxyiABEHIKMNOPTX")
_UNIT = r"(?:[µμu]V(?:olts?)?|[mn]V|V|[µμu]S|n?S|K|°\s?[CF]|deg[CF]|[CF]|LSB|counts?|adu|ADC(?: counts)?|(?:micro|milli|nano)?volts?|%|a\.?u\.?)"
_TAIL = re.compile(
    rf"\s*[(\[]\s*(?:{_UNIT}|scalp|ear|vertex|10-?10|10-?20|10-?5)\s*[)\]]$|\s+in\s+{_UNIT}$|_{_UNIT}$|[\s.*#]+$|\s+-$|-(?:ref|le)$",
    re.IGNORECASE,
)
_HEAD = re.compile(r"^(?:(?:eegdual|dual|eeg)[\s:_-]\s*|ch\s?\d{1,3}[\s:_-]\s*)", re.IGNORECASE)


def tidy_channel(text: str) -> str:
    """``text`` without look-alike letters, unit, remark, type prefix, numbering and reference."""
    s = unicodedata.normalize("NFKC", text).translate(_LOOKALIKE)
    s = re.sub(r"[‐‑‒–—−]", "-", s).strip()
    while True:
        t = _TAIL.sub("", s)
        h = _HEAD.sub("", t)
        if h == s or not h:
            return t if not h else h
        s = h


def channel_key(text: str) -> str:
    """The string under which channel names are compared: tidy, in small letters, one blank for each run of separators, no word twice in a row."""
    k = re.sub(r"[\s_\-.,:;/|+()\[\]{}]+", " ", tidy_channel(text).casefold()).strip()
    return re.sub(r"\b(\w+)(?: \1\b)+", r"\1", k)


def channel_spellings(name: str, former: str | None, label: str | None, places: dict[str, str]) -> set[str]:
    """Keys of all ways to write one entry.

    These are its name, its former name and its label; a pair with the former names of its places (``places``, by present name); a name
    of words in any order with each word's other spellings, also without the words it may go without; whole spellings.
    """
    out = {channel_key(x) for x in (name, former, label) if x}
    sides = re.split(r"\s*-\s*", name)
    if len(sides) == 2:
        out |= {channel_key(f"{a}-{b}") for a in {sides[0], places.get(sides[0], sides[0])} for b in {sides[1], places.get(sides[1], sides[1])}}
    for way in (name, label or ""):
        words = re.findall(r"[^\W_]+", way.casefold())
        if words and len(words) <= 4 and all(w in WORDS for w in words):
            short = [w for w in words if w not in OPTIONAL]
            for chosen in (words, short):
                for spelt in product(*(WORDS[w].split() for w in chosen)):
                    out |= {" ".join(order) for order in permutations(spelt)}
    out |= {x for x in SPELLINGS.get(name.casefold(), "").split("|") if x}
    return out - {""}


def channel_matcher(electrodes: list[tuple[int, str, str | None, str | None]]) -> Matcher:
    """Matcher for rows (electrode_id, name, former_name, label)."""
    places = {n: f for _, n, f, _ in electrodes if f and n}
    rows = [(i, n, f, lab) for i, n, f, lab in electrodes if n]
    return Matcher([(i, n) for i, n, _, _ in rows], [(i, k) for i, n, f, lab in rows for k in channel_spellings(n, f, lab, places)], channel_key)


# --------------------------------------------------------------------------- Spark side
def _mapped(matcher_of: Callable[[], Matcher]) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = matcher_of()
        seen: dict[str, int] = {}
        for s in batches:
            for x in s.dropna().unique():
                if x not in seen:
                    seen[x] = matcher.match(x)[0]
            yield s.map(seen).fillna(UNMATCHED).astype("int32")
            if len(seen) > 1_000_000:
                seen.clear()

    return run


def match_broadcast(text: Column, matcher_of: Callable[[], Matcher]) -> Column:
    """Entry id of ``text``, -1 where none is meant (also for null and empty text)."""
    run = _mapped(matcher_of)

    @F.pandas_udf("int")
    def matched(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(it)

    return matched(text)


def match_channels(df: DataFrame, text: str, electrodes: DataFrame, out: str = "electrode_id", *, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """Add the electrode that each channel text names, or -1.

    Null, empty and undecidable texts give -1; repeated rows are kept; an empty
    reference list gives -1 throughout; other columns pass through unchanged. Up to ``most`` entries
    are broadcast; a longer list is matched in shards (``match_sharded``), with the same result.
    """
    rows = electrodes.select("electrode_id", "name", "former_name", "label").limit(most + 1).collect()
    if len(rows) > most:
        return _match_many(df, text, electrodes, out, most)
    data = sorted(((r[0], r[1], r[2], r[3]) for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1]))
    return df.withColumn(out, match_broadcast(F.col(text), lambda: channel_matcher(data)))


def _match_many(df: DataFrame, text: str, electrodes: DataFrame, out: str, most: int) -> DataFrame:
    former = electrodes.where("former_name is not null and name is not null").select("name", "former_name").limit(BROADCAST_ENTRIES + 1).collect()
    if len(former) > BROADCAST_ENTRIES:
        raise ValueError("too many former names")
    places = {r[0]: r[1] for r in former}

    def spelt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [(i, n, k) for i, n, f, lab in pdf.itertuples(index=False) for k in sorted(channel_spellings(n, f, lab, places))]
            yield pd.DataFrame(keys, columns=["id", "name", "k"])

    entries = electrodes.where("electrode_id is not null and name is not null").select(F.col("electrode_id").cast("long").alias("id"), "name", "former_name", "label")
    found = match_sharded(df, text, entries.mapInPandas(spelt, "id long, name string, k string"), channel_key, shard_keys=most)
    return join_unique(df, found.select(F.col("text").alias(text), F.col("match_id").cast("int").alias(out)), text, "left").withColumn(out, F.coalesce(out, F.lit(UNMATCHED)))


#: Distinct texts of one block.
BLOCK_TEXTS = 50_000


def match_sharded(texts: DataFrame, text: str, spellings: DataFrame, key: Callable[[str], str] = str.casefold, *, radius: Callable[[str], int] = radius_for,
                  metric: Callable[[str, str], int] = weighted_distance, shard_keys: int = BROADCAST_ENTRIES, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """The reference entry of each distinct text, for a reference of any size: (text, match_id, distance).

    ``spellings`` has (id, name, k): each entry's name and the keys it is spelt with. Keys are dealt to shards of about ``shard_keys``,
    distinct texts to blocks of about ``block_texts``; each pair of a shard and a block is one task, which builds the shard's tree. An exact name
    wins, then the nearest spelling within the radius; the winners of the shards merge by distance, and a
    tie between entries leaves the text unmatched (-1), as in ``Matcher``. Null texts give no row; an empty reference leaves all texts unmatched.
    """
    q = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    shards, blocks = max(1, math.ceil(spellings.count() / shard_keys)), max(1, math.ceil(q.count() / block_texts))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")).select("text", "block", every(shards).alias("shard"))
    right = spellings.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int")).select("id", "name", "k", "shard", every(blocks).alias("block"))

    def winners(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            ids = [int(i) for i in b["id"]]
            m = Matcher(list(zip(ids, b["name"], strict=True)), list(zip(ids, b["k"], strict=True)), key, radius, metric)
            for t in a["text"]:
                d, lo, hi = (-1, m.exact[t], m.exact[t]) if t in m.exact else m.nearest(key(t))
                if lo != UNMATCHED:
                    rows.append((t, d, lo, hi))
        return pd.DataFrame(rows, columns=["text", "d", "lo", "hi"])

    won = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(winners, "text string, d int, lo long, hi long")
    tied = won.groupBy("text", "d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    best = tied.groupBy("text").agg(F.min(F.struct("d", "lo", "hi")).alias("m"))
    one = (F.col("m.d") < 0) | (F.col("m.lo") == F.col("m.hi"))  # of repeated exact names the smallest id counts
    return q.join(best, "text", "left").select(
        "text",
        F.when(one, F.col("m.lo")).otherwise(F.lit(UNMATCHED).cast("long")).alias("match_id"),
        F.when(one, F.greatest("m.d", F.lit(0))).otherwise(-1).alias("distance"),
    )
