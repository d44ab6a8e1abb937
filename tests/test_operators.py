"""Operators on small literal tables: quirks, flips of later rows, and guards."""

import math
import random

import pytest
from pyspark.sql import functions as F

from priorframe.functions import scalar as S
from priorframe.operators import aggregate, metrics, ordered, quality, rank, rating, resolve, temporal
from priorframe.sources import tables
from priorframe.streaming import stateful


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


FACT = "entity long, season long, period long, qty double"
ROWS = [(1, 2000, 1, 10.0), (1, 2000, 2, None), (1, 2000, 3, 30.0), (1, 2000, 4, 50.0), (2, 2000, 1, 7.0), (1, 2001, 1, 5.0)]


def trailing(df):
    out = temporal.trailing_mean(df, "qty", 2, ("entity", "season"), ("period",), "rows")
    out = temporal.trailing_mean(out, "qty", 2, ("entity", "season"), ("period",), "seen", skip_null=True)
    return {(r.entity, r.season, r.period): (r.rows, r.seen) for r in out.collect()}


def test_trailing_means_count_null_rows_or_not(spark):
    got = trailing(frame(spark, ROWS, FACT))
    assert got[1, 2000, 4] == (30.0, 20.0) and got[1, 2000, 1] == (None, None) and got[1, 2001, 1] == (None, None)


def test_flipping_a_later_row_changes_no_earlier_one(spark):
    flipped = [(*r[:3], 999.0) if r[:3] == (1, 2000, 4) else r for r in ROWS]
    assert trailing(frame(spark, ROWS, FACT)) == trailing(frame(spark, flipped, FACT))
    early = [(*r[:3], 999.0) if r[:3] == (1, 2000, 1) else r for r in ROWS]
    assert trailing(frame(spark, ROWS, FACT)) != trailing(frame(spark, early, FACT))


@pytest.mark.parametrize("strict,forward,want", [
    (True, False, [None, 10, 20, None]), (False, False, [10, 20, 20, None]), (False, True, [10, 20, None, None]), (True, True, [20, None, None, None]),
])
def test_asof_joins(spark, strict, forward, want):
    left = frame(spark, [(1, 10), (1, 20), (1, 25), (1, None)], "k long, t long")
    right = frame(spark, [(1, 10, 10), (1, 20, 20), (1, None, 99), (2, 10, 5)], "k long, at long, v long")
    got = temporal.asof_join(left, right, ["k"], "t", "at", ["v"], strict=strict, forward=forward).collect()
    assert {r.t: r.v for r in got} == dict(zip([10, 20, 25, None], want))


def test_run_length_before_each_row(spark):
    rows = [(1, t, bad) for t, bad in enumerate([True, True, False, True, False])]
    out = temporal.run_length(frame(spark, rows, "k long, t long, bad boolean"), "bad", ("k",), ("t",), "run")
    assert [r.run for r in out.orderBy("t").collect()] == [0, 1, 2, 0, 1]


def test_average_ranks_share_ties(spark):
    df = frame(spark, [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0)], "g string, v double")
    assert sorted(r.r for r in ordered.average_ranks(df, ["g"], "v", "r").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_global_ordinal_equals_one_sort(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    got = rank.global_ordinal(df, "n", F.desc("v")).collect()
    assert {r.v: r.n for r in got} == {499 - k: k + 1 for k in range(500)}


def test_crps_of_samples(spark):
    df = frame(spark, [([0.0, 1.0, 2.0, 3.0, 4.0], 2.0)], "s array<double>, a double")
    assert df.select(metrics.crps_samples(F.col("s"), F.col("a")).alias("c")).first().c == pytest.approx(0.4)


def test_shrink_and_mode(spark):
    df = frame(spark, [("a", "x", 10.0), ("a", "x", 20.0), ("a", "y", 30.0)], "g string, c string, v double")
    got = {r.c: r.shrunk for r in aggregate.shrunk_means(df, ("g", "c"), ("g",), "v", 2.0).collect()}
    assert got == {"x": pytest.approx(17.5), "y": pytest.approx(30 / 3 + 40 / 3)}
    tied = frame(spark, [(1, "b"), (1, "a"), (1, None), (1, None), (1, None)], "k long, v string")
    assert aggregate.mode_per_key(tied, ["k"], "v").first().v == "a"


def test_order_statistic_has_no_interpolation(spark):
    df = frame(spark, [("a", float(k)) for k in range(1, 21)], "g string, r double")
    assert metrics.order_statistic_radius(df, ("g",), "r", 0.8, 20).first().radius == 17.0
    assert metrics.order_statistic_radius(df.where("r < 20"), ("g",), "r", 0.8, 20).count() == 0


def test_normal_distribution_and_inverse(spark):
    zs = [-2.5, -1.0, 0.0, 0.3, 2.0]
    rows = frame(spark, [(z,) for z in zs], "z double").select("z", S.normal_cdf(F.col("z")).alias("p"))
    for r in rows.withColumn("back", S.normal_quantile(F.col("p"))).collect():
        assert r.p == pytest.approx(0.5 * (1 + math.erf(r.z / math.sqrt(2))), abs=2e-7) and r.back == pytest.approx(r.z, abs=1e-4)


def test_parsers(spark):
    df = frame(spark, [("6-0",), ("6'2",), ("71",), ("tall",), (None,)], "h string")
    assert [r.i for r in df.select(S.height_inches(F.col("h")).alias("i")).collect()] == [72, 74, 71, None, None]
    df = frame(spark, [("D.J. O'Neil III",), ("Ann  Lee Jr.",)], "n string")
    assert [r.n for r in df.select(resolve.normalize_name(F.col("n")).alias("n")).collect()] == ["dj oneil", "ann lee"]


def test_hyphens_join_and_commas_stay(spark):
    df = frame(spark, [("Smith-Jones",), ("SmithJones",), (" Lee, Ann Sr.",)], "n string")
    assert [r.n for r in df.select(resolve.normalize_name(F.col("n")).alias("n")).collect()] == ["smithjones", "smithjones", "lee, ann"]


def test_fuzzy_names_lose_no_match(spark):
    rng = random.Random(7)
    known = {k: "".join(rng.choice("abc ") for _ in range(rng.randint(1, 32))) for k in range(60)}
    asked = []
    for name in known.values():
        for _ in range(3):
            x = list(name)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
            asked.append("".join(x))

    def score(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return 100.0 * (1 - row[-1] / max(len(a), len(b))) if a or b else 100.0

    left = frame(spark, [(x,) for x in sorted(set(asked))], "name string")
    right = frame(spark, [(k, n) for k, n in known.items()], "id long, known string")
    for r in resolve.fuzzy_match(left, right, "name", "known", "id").collect():
        best = max(((score(r.name, n), -k) for k, n in known.items()), default=(0, 0))
        assert (r.matched_id, r.match_score) == ((-best[1], pytest.approx(best[0])) if best[0] >= 90 else (None, None)), r


def test_quarantine_splits_and_names_rules(spark):
    df = frame(spark, [(1, 5.0), (2, None), (None, 1.0)], "id long, v double")
    valid, rejected = quality.quarantine(df, {"id": F.col("id").isNotNull(), "v": F.col("v") > 2}, "s")
    assert [r.id for r in valid.collect()] == [1] and sorted(r.errors for r in rejected.collect()) == ["id,v", "v"]


def test_guards_refuse(spark):
    df = frame(spark, [(1,), (1,)], "id long")
    with pytest.raises(ValueError):
        resolve.require_unique(df, ["id"], "table")
    with pytest.raises(ValueError):
        tables.keep_recent(df, "id", F.current_timestamp(), 0)
    with pytest.raises(ValueError):
        tables.resolve_headers(["ADP", " adp"], {"pick": ("adp",)})
    with pytest.raises(Exception, match="no good"):
        df.select(quality.require(F.col("id") > 1, "no good", F.col("id"))).collect()


def test_upserts(spark):
    old = frame(spark, [(1, 1.0, 2.0), (2, 3.0, 4.0)], "k long, a double, b double")
    new = frame(spark, [(2, None, 9.0), (3, 5.0, 6.0)], "k long, a double, b double")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert [r[0] for r in rows(tables.upsert(old, new, ["k"]))] == [1, 2, 3] and rows(tables.upsert(old, new, ["k"]))[1][1] is None
    assert rows(tables.coalesce_update(old, new, ["k"], ["a", "b"]))[1] == (2, 3.0, 9.0)
    assert len(rows(tables.coalesce_update(old, new, ["k"], ["a"], insert=False))) == 2
    assert rows(tables.insert_absent(old, new, ["k"]))[1] == (2, 3.0, 4.0)


GAMES = "season long, period long, home long, away long, home_score long, away_score long"


def plain_ratings(games, rules=rating.RatingRules()):
    """The stated update, game by game: (season, period, team) to (off, def) after each game."""
    off, def_, out, season = {}, {}, {}, None
    for s, p, h, a, hs, as_ in sorted(games):
        if season is not None and s != season:
            for t in off:
                off[t], def_[t] = (rules.start + rules.keep * (x - rules.start) for x in (off[t], def_[t]))
        season = s
        for t in (h, a):
            off.setdefault(t, rules.start)
            def_.setdefault(t, rules.start)
        mean_h, mean_a = (off[h] + def_[h]) / 2, (off[a] + def_[a]) / 2
        expected = 1 / (1 + 10 ** ((mean_a - mean_h - rules.home_bonus) / 400))
        result = 1.0 if hs > as_ else 0.0 if hs < as_ else 0.5
        gap = mean_h - mean_a if hs > as_ else mean_a - mean_h
        factor = 1.0 if hs == as_ else min(math.log(abs(hs - as_) + 1) * 2.2 / (gap * 0.001 + 2.2), rules.cap)
        clip = lambda x: max(rules.low, min(rules.high, x))
        for t, step, own in ((h, rules.k * factor * (result - expected), result), (a, -rules.k * factor * (result - expected), 1 - result)):
            to_off, to_def = (0.5, 0.5) if own == 0.5 else (1, rules.spill) if own == 1 else (rules.spill, 1)
            off[t], def_[t] = clip(off[t] + step * to_off), clip(def_[t] + step * to_def)
            out[s, p, t] = (off[t], def_[t])
    return out


def test_ratings_equal_the_stated_update(spark):
    """Home bonus in every update, ceiling, ties, teams that miss rounds and a whole season."""
    rng = random.Random(7)
    games = []
    for season in (2001, 2002, 2004):
        for period in (1, 2, 3):
            teams = [t for t in range(1, 9) if not (t in (7, 8) and season == 2002)]
            rng.shuffle(teams)
            for h, a in zip(teams[0:4:2], teams[1:4:2]):
                games.append((season, period, h, a, rng.choice([3, 14, 70]) if h > a else 3, rng.choice([3, 10])))
    rules = rating.RatingRules(k=300.0)  # large enough to meet the bounds
    got = {(r.season, r.period, r.team): (r.off, r["def"]) for r in rating.rate(tables.Workspace(spark, "t"), frame(spark, games, GAMES), rules).collect()}
    want = plain_ratings(games, rules)
    assert set(got) == set(want) and any(x in (rules.low, rules.high) for v in want.values() for x in v)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6), k


def test_ratings_regress_at_the_first_game_of_a_season_only(spark):
    rules = rating.RatingRules()
    state = frame(spark, [(1, 1600.0, 1600.0, 2000), (2, 1400.0, 1400.0, 2000), (3, 1700.0, 1700.0, 2000)], "team long, off double, def double, last_season long")
    played = rating.sides(frame(spark, [(2001, 1, 1, 2, 3, 3)], GAMES))
    after = {r.team: r for r in rating.play_round(state, played, rules, [2000, 2001]).collect()}
    assert after[3].off == 1700.0  # has not played yet
    expected = 1 / (1 + 10 ** (-(1575 - 1425 + 65) / 400))
    assert after[1].off == pytest.approx(1575 + 20 * 0.5 * (0.5 - expected)) and after[1].off - 1575 == pytest.approx(1425 - after[2].off)


class Plain(dict):
    """A stored map by names, where None forgets an entry."""

    def put(self, name, value):
        if value is None:
            self.pop(name, None)
        else:
            self[name] = value


def test_admission_limits_and_releases():
    x = stateful.Exposure(Plain(), Plain(), 0.0)
    place = lambda p, g, a: x.decide("place", p, g, a)[2]
    assert [place("a", "g", 0.05), place("a", "g", 0.01), place("b", "h", 0.05)] == ["approved", "player", "approved"]
    # a release takes its own amount, from the player and from the game it names, wherever other bets of the player are
    x.decide("release", "a", "g", 0.02)
    assert (x.get("player", "a"), x.get("game", "g"), x.total) == (pytest.approx(0.03), pytest.approx(0.03), pytest.approx(0.08))
    assert place("a", "h", 0.02) == "approved" and x.get("game", "h") == pytest.approx(0.07)
    # unknown names are no error and take from the total only
    x.decide("release", "nobody", "nowhere", 0.01)
    assert x.get("player", "nobody") is None and x.get("game", "nowhere") is None and x.total == pytest.approx(0.09)
    # a released game is forgotten; its players keep their exposure
    assert x.decide("release_game", "", "h", 0.0) == (pytest.approx(0.07), True, "released") and x.get("game", "h") is None
    assert x.total == pytest.approx(0.02) and x.get("player", "a") == pytest.approx(0.05) and place("a", "h", 0.001) == "player"
    assert x.decide("release_game", "", "h", 0.0) == (0.0, True, "released")
    x.decide("release", "b", "h", 9.0)
    assert (x.get("player", "b"), x.total) == (0.0, 0.0)
    # limits of a game and of the total, met exactly and exceeded, in the order player, game, total
    y = stateful.Exposure(Plain(), Plain(), 0.0)
    assert [y.decide("place", p, "g", 0.05)[2] for p in "abcde"] == ["approved"] * 4 + ["game"]
    assert y.decide("place", "e", "h", 0.05)[2] == "total" and y.get("player", "e") is None and y.total == pytest.approx(0.2)


def plain_filter(values, start, q, default_r, p0):
    seen = [v for v in values if v is not None]
    mid = sum(seen) / len(seen) if seen else 0
    r = max(sum((v - mid) ** 2 for v in seen) / (len(seen) - 1), 1e-6) if len(seen) > 1 else default_r
    m, v = start, p0
    for x in values:
        v += q
        g = v / (v + r)
        m, v = m + g * ((start if x is None else x) - m), (1 - g) * v
    return m, v


def test_filtered_form_matches_a_plain_loop(spark):
    """From the prior, through nulls, equal values and no history."""
    series = {("a", 1): [10.0, 14.0, None, 9.0], ("a", 2): [None, None, 3.0], ("b", 1): [5.0, 5.0, 5.0, 5.0], (None, 1): [1.0]}
    rows = [(e, s, t, v, "x") for (e, s), vs in series.items() for t, v in enumerate(vs)]
    df = frame(spark, rows, "e string, s long, t long, v double, note string")
    out = temporal.filtered_form(df, ["e", "s"], ["t"], "v", F.when(F.col("e") == "a", 20.0).otherwise(0.0), 1.0, 100.0, 1000.0, "form")
    assert out.columns == [*df.columns, "form"]
    got = {(r.e, r.s, r.t): (r.form.mean, r.form["var"]) for r in out.collect()}
    for (e, s), vs in series.items():
        for t in range(len(vs)):
            assert got[e, s, t] == pytest.approx(plain_filter(vs[:t], 20.0 if e == "a" else 0.0, 1.0, 100.0, 1000.0)), (e, s, t)
    assert got["a", 1, 0] == (20.0, 1000.0)
