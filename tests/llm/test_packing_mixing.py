import random
from fractions import Fraction

import pytest

from sigframe.llm.mixing import Mix, sainte_lague
from sigframe.llm.packing import oversized, pack, pack_items, packing_report
from sigframe.llm.tokens import VOCABULARY, count_tokens, encoding


def test_pack_is_valid_and_tight():
    rng = random.Random(1)
    for cap in (10, 100, 2048):
        sizes = [rng.randint(1, cap) if rng.random() < 0.2 else rng.randint(1, max(1, cap // 4)) for _ in range(3000)]
        bins = pack(sizes, cap)
        room: dict = {}
        large: dict = {}
        for s, b in zip(sizes, bins, strict=True):
            room[b] = room.get(b, 0) + s
            large[b] = large.get(b, 0) + (s > cap / 3)
        assert max(room.values()) <= cap and max(large.values()) <= 2
        assert sorted(room) == list(range(len(room)))
        assert len(room) <= -(-sum(sizes) // cap) * 1.02 + 2
    assert pack([], 5) == [] and sorted(pack([5, 5], 5)) == [0, 1]


def test_pieces(spark):
    items = spark.createDataFrame([(1, 250, 0), (2, 40, 0), (3, 0, 0), (4, None, 0), (None, 5, 0), (2, 40, 0), (5, 100, 0), (6, 200, 0)], "doc_id long, n long, part int")
    p = pack_items(items, "doc_id", "n", 100)
    rows = p.collect()
    assert sum(r.n_tokens for r in rows) == 250 + 40 + 40 + 100 + 200
    assert [(r.part, r.token_start, r.n_tokens) for r in sorted(rows, key=lambda r: r.part) if r.doc_id == 1] == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert sorted(r.doc_id for r in oversized(p, "doc_id").collect()) == [1, 6]
    rep = packing_report(p, 100).first()
    assert rep.tokens == 630 and rep.fullest == 100 and rep.bins == 7
    assert pack_items(items.limit(0), "doc_id", "n", 100).count() == 0
    with pytest.raises(ValueError):
        pack_items(items, "doc_id", "n", 0)
    many = spark.range(5000).selectExpr("id as doc_id", "1 + id % 37 as n")
    p = pack_items(many, "doc_id", "n", 50, shard_items=700)
    assert p.groupBy("bin_id").sum("n_tokens").where("`sum(n_tokens)` > 50").count() == 0 and p.count() == 5000


def test_token_counts(spark):
    texts = [None, "", "hello world", "Grüße 👍 " * 50, "x" * 100_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    enc = encoding(VOCABULARY)
    assert got == {i: None if t is None else len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


def test_sainte_lague_against_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        w = {c: rng.randint(1, 50) for c in "abcd"[: rng.randint(1, 4)]}
        seats = rng.randint(0, 30)
        ranked = sorted(((-v / (2 * k + 1), c) for c, v in w.items() for k in range(seats)))[:seats]
        assert sainte_lague(w, seats)[0] == {c: sum(x[1] == c for x in ranked) for c in w}
    won, lost = sainte_lague({"a": 0.5, "b": 0.5}, 10, {"a": 2})
    assert won == {"a": 2, "b": 5} and lost == {"a": 3, "b": 0}
    assert sainte_lague({"a": 0.0}, 5)[0] == {"a": 0} and sainte_lague({}, 5) == ({}, {})


def _mix(spark, shards=100_000):
    rng = random.Random(3)
    rows = [(i, rng.choices(["big", "small", "spare", None, "untold"], [70, 8, 10, 6, 6])[0], rng.choice([None, 0, *range(1, 60)])) for i in range(4000)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.25, 2), ("spare", 0.1, 3), ("absent", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    return rows, Mix(spark.createDataFrame(rows, "doc_id int, source string, n_tokens int"), targets, shard_texts=shards)


def test_sainte_lague_ties_caps_and_size():
    import time

    rng = random.Random(4)
    for _ in range(300):
        w = {c: rng.randint(1, 12) for c in "abcdefgh"[: rng.randint(1, 8)]}
        seats = rng.randint(0, 60)
        quotients = sorted(((-Fraction(x, 2 * k + 1), c) for c, x in w.items() for k in range(seats)))[:seats]
        assert sainte_lague(w, seats)[0] == {c: sum(q[1] == c for q in quotients) for c in w}
    start = time.time()
    won, lost = sainte_lague({f"s{i}": 1 / (i + 3) for i in range(1000)}, 10**9, {"s0": 5})
    assert sum(won.values()) + sum(lost.values()) == 10**9 and won["s0"] == 5 and lost["s0"] > 10**6
    assert time.time() - start < 1


@pytest.mark.parametrize("held", [599, 600, 601])
def test_short_sources_come_from_the_seats_and_the_exact_sizes(spark, held):
    """A source is short by a single token or not, where the blocks alone cannot tell."""
    sized = spark.createDataFrame([(1, "a", held), (2, "b", 2000 - held)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 3)], "source string, target_share double, max_repeats int")
    mix = Mix(sized, targets, blocks=7)
    assert [r.source for r in mix.found().collect()] == (["a"] if held < 600 else [])


@pytest.mark.parametrize("shards", [100_000, 300])
def test_mix(spark, shards):
    rows, mix = _mix(spark, shards)
    held = {s: sum(n or 0 for _, x, n in rows if x == s) for s in ("big", "small", "spare")}
    total = sum(n or 0 for _, s, n in rows if s is not None)
    assert mix.total == total and mix.short() == ["absent", "small"]
    draws = mix.draws().collect()
    cap = {"big": 1, "small": 2, "spare": 3}
    assert all(r.source in cap and 1 <= r.uses <= cap[r.source] for r in draws)
    reached = {s: sum(r.n_tokens * r.uses for r in draws if r.source == s) for s in cap}
    assert reached["small"] == 2 * held["small"]  # all it may give
    for s, share in (("big", 0.6), ("spare", 0.1)):
        assert reached[s] == pytest.approx(share * total, rel=0.02)
    rep = {r.source: r for r in mix.report().collect()}
    assert set(rep) == {"big", "small", "spare", "absent"} and rep["absent"].reached == 0 and rep["small"].short
    assert sum(r.reached_share for r in rep.values()) == pytest.approx(1)
    assert sorted(map(tuple, draws)) == sorted(map(tuple, mix.draws().collect()))  # seeded


def test_mix_of_nothing(spark):
    mix = Mix(spark.createDataFrame([], "doc_id int, source string, n_tokens int"), spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int"))
    assert mix.draws().count() == 0 and mix.short() == []
