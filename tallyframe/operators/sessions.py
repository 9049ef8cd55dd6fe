"""Session life cycle over ordered sign-in events (D2, D9, F14, J10, X20), as one batch job.

A user holds at most one session: a login replaces it, a refresh that presents its token before it
expires rotates it, everything else leaves it. Whether a refresh passes depends on the ones
before, but the dependence has a simple shape: a token is created by one event, and only the
*first* refresh that presents it, in the same stretch between two logins, can pass. So
every refresh has at most one event to follow, and passes if that event passed: chains that
begin at logins.

Scale notes
-----------
* The stretch between logins is a running count per user (``ordered_positions``, hot users split).
* A token meets its refreshes in a join on (user, token), near-unique keys; its first use is
  a partial minimum. No user's events are gathered.
* Chains are followed by pointer doubling: ``log2`` of the longest chain rounds, each a join
  on unique event ids, checkpointed. Two numbers per round reach the driver.

``streaming.sessions`` decides the same events one micro-batch after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.windows import ordered_positions
from tallyframe.schemas import SESSION_DAYS
from tallyframe.session import materialize

LOGIN, REFRESH = "login", "refresh"
BAD_LOGIN = "Invalid credentials."
NO_TOKEN = "Refresh token required."
BAD_TOKEN = "Invalid or expired refresh token."


def session_outcomes(events: DataFrame, users: DataFrame) -> DataFrame:
    """``events(event_id, user_id, kind, token, new_token, at)`` decided in order of (at, event_id) per user:
    one row each with ``accepted``, the ``error`` of a refused one, and the session that an accepted login or
    refresh leaves (``session_token`` = its ``new_token``, ``expires_at`` seven days on).

    A login passes for a known user. A refresh passes if the user's session has its ``token`` and expires after
    ``at``. Other kinds (a logout clears cookies only) pass and change nothing. ``event_id`` and
    ``new_token`` are unique. Events without a user or of unknown users hold no session."""
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_known")).distinct()
    e = events.join(known, "user_id", "left").withColumn("_login", (
        (F.col("kind") == LOGIN) & F.col("_known").isNotNull()).cast("int"))
    e = ordered_positions(e, "user_id", ["at", "event_id"], value="_login", position="_n", running="_before")
    e = materialize(e.withColumn("_stretch", F.col("_before") + F.col("_login")).drop("_before"))

    made = e.where((F.col("_login") == 1) | (F.col("kind") == REFRESH)).select(
        "user_id", F.col("new_token").alias("token"), F.col("event_id").alias("parent"), F.col("at").alias("made_at"),
        F.col("_n").alias("made_n"), F.col("_stretch").alias("made_in"))
    uses = e.where((F.col("kind") == REFRESH) & F.col("token").isNotNull()).select(
        "user_id", "token", "event_id", "at", "_n", "_stretch")
    first = (uses.join(made, ["user_id", "token"]).where("made_in = _stretch and made_n < _n").groupBy("parent", "made_at")
             .agg(F.min_by(F.struct("event_id", "at"), "_n").alias("use")))
    links = first.where(F.col("use.at") < F.col("made_at") + F.expr(f"INTERVAL {SESSION_DAYS} DAYS")).select(
        F.col("use.event_id").alias("event_id"), "parent")
    passed = _passed(links, e.where("_login = 1").select(F.col("event_id").alias("root")))

    j = e.join(passed.withColumn("_passed", F.lit(True)), "event_id", "left")
    error = (F.when(F.col("kind") == LOGIN, F.when(F.col("_login") == 0, F.lit(BAD_LOGIN)))
             .when(F.col("kind") == REFRESH, F.when(F.coalesce("token", F.lit("")) == "", F.lit(NO_TOKEN))
                   .when(F.col("_passed").isNull(), F.lit(BAD_TOKEN))))
    holds = error.isNull() & F.col("kind").isin(LOGIN, REFRESH)
    return j.select("event_id", "user_id", "kind", "at", error.isNull().alias("accepted"), error.alias("error"),
                    F.when(holds, F.col("new_token")).alias("session_token"),
                    F.when(holds, F.col("at") + F.expr(f"INTERVAL {SESSION_DAYS} DAYS")).alias("expires_at"))


def _passed(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The events of ``links(event_id, parent)`` whose chain of parents ends in one of ``roots``."""
    roots = materialize(roots)
    links = materialize(links)
    done = links.join(roots, F.col("parent") == F.col("root"), "left_semi").select("event_id")
    open_ = links.join(roots, F.col("parent") == F.col("root"), "left_anti")
    while not open_.isEmpty():
        step = open_.select(F.col("event_id").alias("parent"), F.col("parent").alias("next"))
        fresh = open_.join(done.withColumnRenamed("event_id", "parent"), "parent", "left_semi").select("event_id")
        # Of the others, those go on whose parent has a parent itself; the rest hang on a refused event.
        open_ = materialize(open_.join(done.withColumnRenamed("event_id", "parent"), "parent", "left_anti")
                            .join(step, "parent").select("event_id", F.col("next").alias("parent")))
        done = materialize(done.unionByName(fresh))
    return done


def sessions_after(outcomes: DataFrame) -> DataFrame:
    """One row per user with a session: the token and expiry that the last accepted login or refresh left."""
    held = outcomes.where("session_token is not null")
    last = held.groupBy("user_id").agg(F.max_by(F.struct("session_token", "expires_at", "at"), F.struct("at", "event_id")).alias("s"))
    return last.select("user_id", F.col("s.session_token").alias("token"), "s.expires_at", F.col("s.at").alias("updated_at"))
