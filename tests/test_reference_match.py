import heapq
import itertools
import random

import pytest

from sigframe.operators.reference_match import ALIKE, BKTree, Matcher, _costs, channel_matcher, edit_distance, match_channels, match_sharded, tidy_channel, weighted_distance

ELECTRODES = [(1, "Fp1", None, None), (2, "T7", "T3", None), (3, "Cz", None, "vertex"), (4, "P7", "T5", None), (5, "T7-P7", None, None), (6, "EOG left", None, "left outer canthus"),
              (7, "EOG right", None, None), (8, "EMG chin", None, "submental muscle"), (9, "Temp skin", None, "skin temperature"), (10, "A1", None, "left earlobe"), (11, "ECG", None, "heart"),
              (12, "SpO2", None, None), (13, "Stim", None, None), (14, "O1", None, None), (15, "EMG leg left", None, None)]


def test_metric_against_search():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(60)]
    for a in words[:20]:
        assert edit_distance(a, a) == 0
        for b in words[:20]:
            assert edit_distance(a, b) == edit_distance(b, a)
            for c in words[:20]:
                assert edit_distance(a, c) <= edit_distance(a, b) + edit_distance(b, c)
    tree = BKTree(words)
    for q in ["abca", "", "ccccc"]:
        for r in range(4):
            assert tree.within(q, r) == sorted({(edit_distance(q, w), w) for w in words if edit_distance(q, w) <= r})


@pytest.mark.parametrize(("text", "entry"), [
    ("FP1", 1), ("EEG fp1-REF", 1), ("Fp01", 1), ("Ｆp１", 1), ("ch01_Fp1 [uV]", 1), ("Fpl", 1), ("T3", 2), ("Т7", 2), ("T-7", 2), ("Vertex electrode", 3), ("CZ (vertex)", 3), ("T5", 4),
    ("T3–T5", 5), ("t7/p7", 5), ("T7P7", 5), ("LEOG", 6), ("eog_l", 6), ("EOG, left", 6), ("EOG lefft", 6), ("ROC", 7), ("EOG rigth_µV", 7), ("CHIN", 8), ("Kinn-EMG", 8),
    ("Hauttemperatur (°C)", 9), ("Ear lobe left", 10), ("E.C.G.", 11), ("ECG II", 11), ("Sp02", 12), ("spo2 finger", 12), ("STI 014", 13), ("Event marker", 13), ("01", 14), ("LLEG", 15), ("EMG leg lft", 15),
    ("A'1", -1), ("K7", -1), ("E136", -1), ("spare", -1), ("Accel X", -1), ("", -1), (None, -1), ("F9-F7", -1), ("x" * 50_000, -1),
])
def test_channels(text, entry):
    assert channel_matcher(ELECTRODES).match(text)[0] == entry


def test_tidy():
    assert tidy_channel("EEG FC6 #") == "FC6" and tidy_channel("ch12-C4 in mV") == "C4"


def test_spark_keeps_rows(spark):
    e = spark.createDataFrame(ELECTRODES, "electrode_id int, name string, former_name string, label string")
    df = spark.createDataFrame([("T3", 1), ("T3", 1), (None, 2), ("nothing", 3)], "t string, label int")
    got = sorted((r.electrode_id, r.label) for r in match_channels(df, "t", e).collect())
    assert got == [(-1, 2), (-1, 3), (2, 1), (2, 1)]
    assert match_channels(df.limit(0), "t", e).count() == 0
    assert {r.electrode_id for r in match_channels(df, "t", e.limit(0)).collect()} == {-1}


def _cheapest(a, b, alphabet):
    """Least cost of single edits from a to b, by search over all strings in between."""
    cost, done, heap = _costs(), {}, [(0, a)]
    while heap:
        c, w = heapq.heappop(heap)
        if w == b:
            return c
        if w in done:
            continue
        done[w] = c
        for i in range(len(w) + 1):
            for x in alphabet:
                if len(w) <= max(len(a), len(b)):
                    heapq.heappush(heap, (c + cost["", x], w[:i] + x + w[i:]))
                if i < len(w) and x != w[i]:
                    heapq.heappush(heap, (c + cost[w[i], x], w[:i] + x + w[i + 1 :]))
            if i < len(w):
                heapq.heappush(heap, (c + cost[w[i], ""], w[:i] + w[i + 1 :]))
            if i + 1 < len(w) and w[i].isalpha() and w[i + 1].isalpha():
                heapq.heappush(heap, (c + 4, w[:i] + w[i + 1] + w[i] + w[i + 2 :]))


def test_weighted_distance_is_the_cheapest_way_and_a_metric():
    words = ["".join(w) for n in range(4) for w in itertools.product("ao0", repeat=n)]
    rng = random.Random(5)
    for _ in range(60):
        a, b = rng.choice(words), rng.choice(words)
        assert weighted_distance(a, b) == _cheapest(a, b, "ao0"), (a, b)
    words = ["".join(rng.choice("abol01 7'") for _ in range(rng.randint(0, 6))) for _ in range(45)]
    for a in words:
        for b in words:
            assert weighted_distance(a, b) == weighted_distance(b, a) and (weighted_distance(a, b) == 0) == (a == b)
            for c in words[:15]:
                assert weighted_distance(a, c) <= weighted_distance(a, b) + weighted_distance(b, c)
    assert all(_costs()[x, y] == 2 for x, y in ALIKE)
    tree = BKTree(words, weighted_distance)
    for q in ["abo", "", "07 l"]:
        for r in (0, 3, 9, 20):
            assert tree.within(q, r) == sorted({(weighted_distance(q, w), w) for w in words if weighted_distance(q, w) <= r})


def test_the_tree_decides_every_text_that_is_no_name(spark):
    """Ablation: without the tree nothing but exact names is found; with a radius of 0 only exact keys are."""
    from sigframe.plans.cleaning import channel_values
    from sigframe.session import table

    rows = table(spark, "/root/testdata/sf0.001", "electrodes").select("electrode_id", "name", "former_name", "label").collect()
    names = {r.name for r in rows}
    texts = [r.ch_text for r in channel_values(spark, "/root/testdata/sf0.001").collect() if r.ch_text not in names]
    full, none, near = (channel_matcher([tuple(r) for r in rows]) for _ in range(3))
    none.tree, near.radius = BKTree([]), lambda key: 0
    found = [t for t in texts if full.match(t)[0] >= 0]
    assert len(found) > 0.8 * len(texts)
    assert not any(none.match(t)[0] >= 0 for t in texts)
    assert sum(near.match(t)[0] < 0 for t in found) > 0.03 * len(found)  # found within the radius alone


def test_ties_between_entries_stay_unmatched():
    m = Matcher([(1, "abcdx"), (2, "abcdy")], [(1, "abcdx"), (2, "abcdy")])
    assert m.match("abcdx") == (1, 0) and m.match("abcdz") == (-1, -1) and m.match("ABCDY") == (2, 0)


@pytest.mark.parametrize("most", [1, 6])
def test_long_lists_are_matched_alike_in_shards(spark, most):
    e = spark.createDataFrame([(i, n, f, lab) for i, n, f, lab in ELECTRODES], "electrode_id int, name string, former_name string, label string")
    texts = ["FP1", "T3–T5", "ROC", "EOG lefft", "01", "LLEG", "A'1", "Sp02", "", None, "Cz", "T-7", "nothing", "FP1"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int")
    few, many = match_channels(df, "t", e), match_channels(df, "t", e, most=most)
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.select(*few.columns).collect()), key=str)


def test_sharded_against_brute_force(spark):
    rng = random.Random(2)
    ref = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(3, 7)))) for i in range(300)]
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 7))) for _ in range(80)] + ["zzzzzzzzzz", "long" * 9000]
    spellings = spark.createDataFrame([(i, w, w) for i, w in ref], "id long, name string, k string")
    got = match_sharded(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spellings, radius=lambda k: 2, metric=edit_distance, shard_keys=70, block_texts=30)
    rows = {r.text: (r.match_id, r.distance) for r in got.collect()}
    names = {w: min(i for i, x in ref if x == w) for _, w in ref}
    for t in set(texts):
        near = min(edit_distance(t, w) for w in names) if len(t) < 20 else 99
        ids = {i for i, w in ref if len(t) < 20 and edit_distance(t, w) == near}
        assert rows[t] == ((names[t], 0) if t in names else (ids.pop(), near) if near <= 2 and len(ids) == 1 else (-1, -1))
