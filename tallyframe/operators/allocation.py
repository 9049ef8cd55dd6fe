"""Profit allocation.

Money is exact: a share is ``amount * pct * 0.01`` in DECIMAL(26,6), so the shares of
one run add up to the run amount without any rounding step (the reference used
floating point). The run gate compares the DECIMAL sum with exactly 100 (Q1).

Scale notes
-----------
* Runs (one per ``alloc`` transaction) are the large, owner-skewed side. The rule
  table is first cut to the owners that have runs (semi-join), then the gate and the
  cut rules are joined to the runs on ``user_id`` through size-checked broadcasts
  (``joins.checked_broadcast``), so the runs are never shuffled by owner; beyond the
  size bound the join is a shuffle join whose hot partitions AQE splits.
* Per-owner totals are partial aggregates; rule positions and running offsets use
  ``windows.ordered_positions`` (range-partitioned, boundary-corrected), so even an
  owner with a third of all rules is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.money import share, usd_text
from tallyframe.functions.text import clamp, int_or_zero
from tallyframe.operators.joins import checked_broadcast, measured
from tallyframe.operators.windows import ordered_positions
from tallyframe.schemas import PCT, RULE_PALETTE

PCT_TOTAL = "decimal(7,2)"


def _hundred():
    return F.lit(100).cast(PCT_TOTAL)


def rule_totals(rules: DataFrame) -> DataFrame:
    """Per owner, total percentage over all rules, on-target flag, remaining and
    over-by (0 when not applicable)."""
    t = rules.groupBy("user_id").agg(F.sum("percentage").cast(PCT_TOTAL).alias("total_pct"))
    return t.select(
        "user_id", "total_pct",
        (F.col("total_pct") == _hundred()).alias("is_on_target"),
        F.greatest(_hundred() - F.col("total_pct"), F.lit(0)).cast(PCT_TOTAL).alias("remaining_pct"),
        F.greatest(F.col("total_pct") - _hundred(), F.lit(0)).cast(PCT_TOTAL).alias("over_by_pct"),
        F.when(F.col("total_pct") == _hundred(), F.lit(None).cast("string"))
         .when(F.col("total_pct") < _hundred(),
               F.concat(F.lit("Rules sum to "), F.col("total_pct").cast("string"),
                        F.lit("% — Remaining: "), (_hundred() - F.col("total_pct")).cast(PCT_TOTAL).cast("string"), F.lit("%")))
         .otherwise(F.concat(F.lit("Rules sum to "), F.col("total_pct").cast("string"),
                             F.lit("% — Over by "), (F.col("total_pct") - _hundred()).cast(PCT_TOTAL).cast("string"), F.lit("%")))
         .alias("warning"))


def rule_cap_check(rules: DataFrame, candidates: DataFrame) -> DataFrame:
    """A7 + V1 + X8: decide new-rule requests ``candidates(request_id, user_id, name,
    pct_text, is_locked)``.

    The requested percentage is parsed as an integer (0 when unparsable) and clamped to
    0..100 as the form does; a request is accepted when the owner's existing total plus
    the new percentage is at most 100, or when the new rule is locked (Q3: an owner
    without rules has total 0).
    """
    # Only the requesting owners' totals are needed: when those owners are few
    # (measured), the rule table is cut to them and their totals are broadcast.
    owners, few = measured(candidates.select("user_id").distinct())
    needed = rules.join(owners, "user_id", "left_semi") if few else rules
    existing = needed.groupBy("user_id").agg(F.sum("percentage").cast(PCT_TOTAL).alias("existing_pct"))
    if few:
        existing = F.broadcast(existing)    # at most one row per measured owner
    c = candidates.withColumn("percentage", clamp(int_or_zero("pct_text"), 0, 100).cast(PCT))
    j = c.join(existing, "user_id", "left").withColumn(
        "existing_pct", F.coalesce(F.col("existing_pct"), F.lit(0).cast(PCT_TOTAL)))
    new_total = (F.col("existing_pct") + F.col("percentage")).cast(PCT_TOTAL)
    accepted = (new_total <= _hundred()) | F.coalesce(F.col("is_locked"), F.lit(False))
    return j.select("request_id", "user_id", "name", "percentage", "is_locked", "existing_pct",
                    new_total.alias("new_total_pct"), accepted.alias("accepted"),
                    F.when(~accepted, F.lit("Total percentage cannot exceed 100%.")).alias("error"))


def auto_rules(rules: DataFrame) -> DataFrame:
    """rules that take part in an automatic run."""
    return rules.where(F.col("is_auto"))


def _gate(rules: DataFrame) -> DataFrame:
    return rules.groupBy("user_id").agg(F.sum("percentage").cast(PCT_TOTAL).alias("rule_total_pct"))


def alloc_run(runs: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R4 (F12 + A8 + J9 + X11): split each run ``runs(run_id, user_id, amount)`` over
    its owner's auto rules.

    Returns ``(allocations, rejects)``: one allocation row per (run, auto rule) when the
    owner's auto rules sum to exactly 100; otherwise one reject row per run with the
    total found (an owner without auto rules has total 0).
    """
    # Semi-join reduction: only the rules of owners that have runs matter. The distinct
    # run owners are a partial aggregate; when they are few (measured), they are
    # broadcast and filter the rule table during its scan, before the gate and the
    # fan-out. Otherwise the rules are used whole (no shuffle of the rule table for a
    # filter that would not cut it down).
    owners, few = measured(runs.select("user_id").distinct())
    cut = auto_rules(rules).join(owners, "user_id", "left_semi") if few else auto_rules(rules)
    auto, bounded = measured(cut.select("user_id", "id", "name", "percentage"))
    gate = _gate(auto)                      # at most one row per rule of ``auto``
    gate = F.broadcast(gate) if bounded else checked_broadcast(gate)
    r = runs.join(gate, "user_id", "left").withColumn(
        "rule_total_pct", F.coalesce(F.col("rule_total_pct"), F.lit(0).cast(PCT_TOTAL)))
    ok = r.where(F.col("rule_total_pct") == _hundred())
    rejects = r.where(F.col("rule_total_pct") != _hundred()).select(
        "run_id", "user_id", "amount", "rule_total_pct",
        F.concat(F.lit("Total percentage must be 100%. Current total: "),
                 F.col("rule_total_pct").cast("string"), F.lit("%")).alias("error"))
    allocations = (ok.join(auto.select("user_id", F.col("id").alias("rule_id"),
                                       F.col("name").alias("rule_name"), "percentage"), "user_id")
                   .select("run_id", "user_id", "rule_id", "rule_name", "percentage",
                           "amount", share("amount", "percentage").alias("share")))
    return allocations, rejects


def run_records(runs: DataFrame, rules: DataFrame, amount: str = "amount") -> DataFrame:
    """S9 + R4: the accepted runs, each with ``allocations``: one (ruleId, ruleName, amount, percentage) per
    auto rule of its owner, by rule id.

    The rule list of an owner whose auto rules sum to 100 is gathered once (an audit record holds it
    whole); runs join it on the owner behind a size check and compute their shares in place, so
    they're neither multiplied by the rules nor shuffled."""
    owners, few = measured(runs.select("user_id").distinct())
    cut = auto_rules(rules).join(owners, "user_id", "left_semi") if few else auto_rules(rules)
    lists = cut.groupBy("user_id").agg(
        F.sum("percentage").cast(PCT_TOTAL).alias("_total"),
        F.sort_array(F.collect_list(F.struct("id", "name", "percentage"))).alias("_rules")).where(
        F.col("_total") == _hundred()).drop("_total")
    j = runs.join(F.broadcast(lists) if few else checked_broadcast(lists), "user_id")
    return j.withColumn("allocations", F.transform("_rules", lambda r: F.struct(
        r["id"].alias("ruleId"), r["name"].alias("ruleName"), share(F.col(amount), r["percentage"]).alias("amount"),
        r["percentage"].alias("percentage")))).drop("_rules")


def alloc_preview(amounts: DataFrame, rules: DataFrame) -> DataFrame:
    """Preview of ``amounts(user_id, amount)`` over **all** the owner's rules,
    without the gate; ``warn`` is set when those rules do not sum to 100."""
    amounts = checked_broadcast(amounts)
    own = rules.join(amounts.select("user_id"), "user_id", "left_semi")
    totals = _gate(own).withColumnRenamed("rule_total_pct", "all_rules_pct")
    return (amounts.join(totals, "user_id")
            .join(own.select("user_id", F.col("id").alias("rule_id"), F.col("name").alias("rule_name"),
                               "percentage", "color"), "user_id")
            .select("user_id", "rule_id", "rule_name", "color", "percentage", "amount",
                    share("amount", "percentage").alias("share"),
                    usd_text(share("amount", "percentage")).alias("share_text"),
                    (F.col("all_rules_pct") != _hundred()).alias("warn"), "all_rules_pct"))


def latest_amount(runs: DataFrame) -> DataFrame:
    """Latest run per owner, ``(user_id, amount)``, by (created_at, run_id); a partial
    aggregate (``max_by``), so hot owners are combined map-side."""
    return runs.groupBy("user_id").agg(
        F.max_by("amount", F.struct("created_at", "run_id")).alias("amount"))


def rule_offsets(rules: DataFrame) -> DataFrame:
    """Donut offset of each rule = sum of the percentages of the owner's earlier
    rules (oldest first); also the rule's own end point. Computed with
    ``ordered_positions``, so an owner with a huge number of rules is spread over
    many tasks."""
    r = ordered_positions(rules.select("user_id", "id", "name", "percentage", "created_at"),
                          "user_id", ["created_at", "id"], value="percentage", running="_before")
    start = r["_before"].cast(PCT_TOTAL)
    return r.select("user_id", "id", "name", "percentage", start.alias("offset_pct"),
                    (start + F.col("percentage")).cast(PCT_TOTAL).alias("end_pct"))


def rule_colors(rules: DataFrame) -> DataFrame:
    """Palette colour by the rule's position (oldest first) modulo 7."""
    palette = F.array(*[F.lit(c) for c in RULE_PALETTE])
    r = ordered_positions(rules.select("user_id", "id", "name", "created_at"), "user_id", ["created_at", "id"])
    return r.select("user_id", "id", "name", "position",
                    F.element_at(palette, (F.pmod(F.col("position") - 1, F.lit(len(RULE_PALETTE))) + 1).cast("int"))
                    .alias("palette_color"))
