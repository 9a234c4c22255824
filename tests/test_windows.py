"""Caps and de-duplication against a plain loop over random input."""

import random

import pytest
from pyspark.sql import functions as F

from postlab.operators import windows
from postlab.operators.joins import term_matches


def random_hits(seed, terms=8, per_term=40, users=9, ids=60):
    rnd = random.Random(seed)
    return [(t, p, f"p{rnd.randrange(ids)}", f"u{min(rnd.randrange(users), rnd.randrange(users))}", rnd.random() < 0.5)
            for t in range(terms) for p in range(per_term)]


def frame(spark, hits):
    return spark.createDataFrame(hits, "term_idx int, pos long, post_id string, username string, match boolean")


def collector_v3(hits, k=2):
    known, out, ids = set(), [], set()
    for t in sorted({h[0] for h in hits}):
        counts, batch = {}, []
        for term, pos, post, user, match in sorted(h for h in hits if h[0] == t):
            if user in known:
                counts[user] = counts.get(user, 0) + 1
                if counts[user] > k:
                    continue
            else:
                counts[user] = 1
            if not match:
                continue
            batch.append((term, pos, post, user, counts[user]))
            known.add(user)
        out += [row for row in batch if row[2] not in ids]
        ids |= {row[2] for row in out}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_v3_cap_and_dedupe(spark, seed):
    hits = random_hits(seed)
    kept = windows.dedupe_across_terms(windows.cap_after_first_accept(frame(spark, hits)))
    got = sorted((r.term_idx, r.pos, r.post_id, r.username, r.user_post_count) for r in kept.collect())
    assert got == sorted(collector_v3(hits))


def test_v3_cap_other_budget(spark):
    hits = [(t, p, f"{t}-{p}", u, m) for t, p, _, u, m in random_hits(11)]
    kept = windows.cap_after_first_accept(frame(spark, hits), k=4, salts=3)
    got = sorted((r.term_idx, r.pos, r.post_id, r.username, r.user_post_count) for r in kept.collect())
    assert got == sorted(collector_v3(hits, k=4))


def budgeted(hits, total, per_term, k=2):
    """The collector's loop: each term fetches what is still missing, caps it and drops what it has."""
    known, out = set(), []
    for t in sorted({h[0] for h in hits}):
        if len(out) >= total:
            break
        counts, batch = {}, []
        for term, pos, post, user, match in sorted(h for h in hits if h[0] == t)[:min(per_term, total - len(out))]:
            if user in known:
                counts[user] = counts.get(user, 0) + 1
                if counts[user] > k:
                    continue
            else:
                counts[user] = 1
            if match:
                batch.append((term, pos, post, user, counts[user]))
                known.add(user)
        ids = {row[2] for row in out}
        out += [row for row in batch if row[2] not in ids]
    return out


@pytest.mark.parametrize("seed,total,per_term", [(0, 30, 25), (1, 12, 40), (2, 70, 15), (3, 1, 40), (4, 10_000, 10), (5, 45, 40)])
def test_budget_shrinks_from_term_to_term(spark, seed, total, per_term):
    hits = random_hits(seed, terms=6, per_term=30)
    kept = windows.select_within_budget(frame(spark, hits), total, per_term)
    got = sorted((r.term_idx, r.pos, r.post_id, r.username, r.user_post_count) for r in kept.collect())
    assert got == sorted(budgeted(hits, total, per_term)) and len(got) <= total


def test_budget_of_no_hits(spark):
    assert windows.select_within_budget(frame(spark, []), 10).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_v2_caps(spark, seed):
    hits = [(t, p, f"{t}-{p}", u, m) for t, p, _, u, m in random_hits(seed)]
    df = frame(spark, hits)
    per_search, per_user = {}, {}
    for row in sorted(hits):
        per_search.setdefault((row[0], row[3]), []).append(row)
        per_user.setdefault(row[3], row)
    capped = windows.cap_per_search(df)
    assert sorted((r.term_idx, r.pos) for r in capped.collect()) == sorted(
        (r[0], r[1]) for rows in per_search.values() for r in rows[:2])
    first = windows.one_post_per_user(capped)
    assert sorted((r.term_idx, r.pos) for r in first.collect()) == sorted((r[0], r[1]) for r in per_user.values())


def test_repeats_inside_a_term_stay(spark):
    df = frame(spark, [(0, 1, "a", "u", True), (0, 2, "a", "u", True), (1, 0, "a", "u", True), (1, 1, "b", "u", True)])
    got = sorted((r.term_idx, r.pos) for r in windows.dedupe_across_terms(df).collect())
    assert got == [(0, 1), (0, 2), (1, 1)]


def test_limit_per_term_honours_the_caller(spark):
    df = spark.range(500).select(F.lit(0).alias("term_idx"), F.col("id").alias("pos"))
    assert windows.limit_per_term(df, 1000).count() == windows.limit_per_term(df).count() == df.count()
    assert windows.limit_per_term(df, 7).count() == 7


def test_heavy_user_is_limited_before_the_shuffle(spark):
    """One account with most rows: each task forwards at most k rows of it."""
    df = spark.range(0, 20000, 1, 8).select(
        F.lit(0).alias("term_idx"), F.col("id").alias("pos"), F.col("id").cast("string").alias("post_id"),
        F.when(F.col("id") % 10 < 9, "heavy").otherwise(F.concat(F.lit("u"), F.col("id") % 50)).alias("username"),
        (F.col("id") % 2 == 0).alias("match"))
    for capped in (windows.cap_per_search(df), windows.one_post_per_user(df), windows.cap_after_first_accept(df)):
        plan = capped._jdf.queryExecution().executedPlan().toString()
        before_shuffle = plan.index("Final, ") if "Final, " in plan else plan.index("Final")
        assert "WindowGroupLimit" in plan and "Partial" in plan[before_shuffle:]
        per_user = dict(capped.groupBy("username").count().collect())
        assert per_user["heavy"] <= 2


def test_term_matches_has_no_join(spark):
    posts = spark.createDataFrame([(1, "All about AI and gpt"), (2, "none"), (3, "GPT")], "post_id int, content string")
    found = term_matches(posts, ["gpt", "AI"])
    assert sorted((r.post_id, r.term_idx, r.search_term) for r in found.collect()) == [
        (1, 0, "gpt"), (1, 1, "AI"), (3, 0, "gpt")]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
