"""The cap of accepted users as a stream: known users and their budgets live across polls.

A user becomes known with the first matching post. From then on each post of the user, matching or not, spends the budget of its
term, and matching ones are kept while it lasts. Terms are searched one after the other, so the state of a user is the term searched
last and what of its budget is spent: two numbers, forgotten when the user has been silent for a while. Users meet in buckets by hash,
since a call of Python for each user costs far more than the user's few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegerType, IntegralType, StructField, StructType

from postlab import rules


def spend(posts, k: int, known: bool, last: int, spent: int, term: str, match: str):
    """Budget numbers of a user's posts in order (0: not kept), and the state behind them."""
    return spend_all(posts[term].tolist(), posts[match].fillna(False).astype(bool).tolist(), k, known, last, spent)


def spend_all(terms: list, hits: list, k: int, known: bool, last: int, spent: int):
    numbers = []
    for t, hit in zip(terms, hits):
        known = known or hit
        if not known or t < last:           # a term that is over has no budget left
            numbers.append(0)
            continue
        spent = spent + 1 if t == last else 1
        last = t
        numbers.append(spent if hit and spent <= k else 0)
    return numbers, known, last, spent


def stream_known_users(hits: DataFrame, k: int = rules.ACCEPTED_USER_CAP, user: str = "username", term: str = "term_idx",
                       place: str = "pos", match: str = "match", event_time: str = "created_at", lateness: str = "1 day",
                       silent: float = 90 * 24 * 3600, buckets: int = 1024) -> DataFrame:
    """``cap_after_first_accept`` over polls: the hits kept, with ``user_post_count``.

    Polls come in the order of their terms, and hits of a term in the order of their places; inside a poll the order of rows does not
    matter. Hits of a known user for a term before the last one are late and dropped. ``silent``: seconds of event time after
    which an inactive user is forgotten, once the watermark has passed them, so a replay forgets the same users. The users of a
    bucket meet in one task with their hits of one poll; the poll's size (``files_per_trigger``) bounds them. Each user of a bucket
    has a time of its own there, and the bucket is called when the first of them has come. Choose more ``buckets`` for more
    than some ten million users, and keep their number while a stream lives.
    """
    out = StructType([*hits.schema.fields, StructField("user_post_count", IntegerType())])
    columns, kind = hits.columns, hits.schema[user].dataType
    whole = isinstance(kind, IntegralType)

    def take(key, batches, state):
        import numpy as np
        import pandas as pd

        users = {name: numbers for name, *numbers in zip(*state.get)} if state.exists else {}
        mark, heard, kept = state.getCurrentWatermarkMs(), set(), None
        if not state.hasTimedOut:
            posts = pd.concat(list(batches), ignore_index=True).sort_values([term, place], kind="stable")
            codes = pd.factorize(posts[user], use_na_sentinel=False)[0]
            order = np.argsort(codes, kind="stable")
            ends = np.flatnonzero(np.diff(codes[order], append=-1)) + 1
            sorted_posts = posts.iloc[order]
            names, terms = sorted_posts[user].tolist(), sorted_posts[term].tolist()
            matched = sorted_posts[match].fillna(False).astype(bool).tolist()
            times = [None if pd.isna(t) else t for t in sorted_posts[event_time]]
            spent_numbers, a = [], 0
            for b in ends.tolist():
                name = None if names[a] != names[a] else int(names[a]) if whole and names[a] is not None else names[a]
                heard.add(name)
                known, last, spent = (True, *users[name][:2]) if name in users else (False, -1, 0)
                numbers, known, last, spent = spend_all(terms[a:b], matched[a:b], k, known, last, spent)
                if known:
                    seen = max((t for t in times[a:b] if t is not None), default=None)
                    until = mark if seen is None else int(seen.timestamp() * 1000)
                    users[name] = [last, min(spent, k + 1), max(until + int(silent * 1000), mark + 1)]
                spent_numbers += numbers
                a = b
            kept = sorted_posts[columns].assign(user_post_count=spent_numbers)
            kept = kept[kept["user_post_count"] > 0]
        # as Spark does for a state of its own: who has no hits in this poll is forgotten once the watermark is past the user's time
        users = {name: numbers for name, numbers in users.items() if name in heard or numbers[2] >= mark}
        if users:
            state.update((list(users), *(list(x) for x in zip(*users.values()))))
            state.setTimeoutTimestamp(max(min(numbers[2] for numbers in users.values()), mark + 1))
        elif state.exists:
            state.remove()
        if kept is not None and len(kept):
            yield kept

    bucketed = hits.withWatermark(event_time, lateness).withColumn("_bucket", F.pmod(F.xxhash64(user), F.lit(buckets)))
    return bucketed.groupBy("_bucket").applyInPandasWithState(
        take, out, f"users array<{kind.simpleString()}>, last array<int>, spent array<int>, until array<long>", "append",
        GroupStateTimeout.EventTimeTimeout)
