"""Cumulative-snapshot collapse and rendering of conversations (operator 8).

Chat logs often hold a conversation many times, once after each turn.  Every
conversation gets a rolling hash per turn prefix (the hash of a prefix is made
from the hash of the one before and the next turn).  A conversation whose
whole hash is the hash of a proper prefix of another one is a snapshot and is
removed by an anti-join; of equal ones the least conv_id stays.  What remains
is rendered with a chat template.

DataFrame functions only.  A conversation's own turns meet in one row, as its
rendering must; snapshots and equal conversations are counted by hash before
anything is joined, so a conversation logged a million times is one row there.

Defined results: turns are ordered by (turn, role, text), nulls first; exact
repeats of a turn row count once; a null role renders as ``unknown`` and a
null text as empty (both differ from the words themselves when hashed); rows
without conv_id form one conversation of their own; an empty table gives an
empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _mark(field: str) -> str:
    return f"coalesce(concat('=', t.{field}), '~')"


#: md5 chain over the ordered turns; entry k is the hash of the first k turns.
_CHAIN = f"""
slice(aggregate(turns, array(md5('')),
  (hs, t) -> concat(hs, array(md5(concat(element_at(hs, -1), md5(concat({_mark("role")}, '|', {_mark("text")}))))))), 2, size(turns))
"""


def _rendered() -> Column:
    turn = f"concat('{OPEN}', coalesce(t.role, 'unknown'), '\\n', coalesce(t.text, ''), '{CLOSE}\\n')"
    return F.expr(f"array_join(transform(turns, t -> {turn}), '')")


def chains(conversations: DataFrame) -> DataFrame:
    """conv_id, its ordered turns and the hashes of their prefixes."""
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.withColumn("prefixes", F.expr(_CHAIN))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal (conversations like it) and the rendered text."""
    every = chains(conversations).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.element_at("prefixes", -1).alias("whole"),
        F.expr("slice(prefixes, 1, size(prefixes) - 1)").alias("proper"),
        _rendered().alias("text"),
    )
    # one row per distinct conversation, then those that no longer one begins with
    distinct = every.groupBy("whole").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_equal"),
        F.first("n_turns").alias("n_turns"),
        F.first("text").alias("text"),
    )
    begun = every.select(F.explode("proper").alias("whole")).distinct()
    return distinct.join(begun, "whole", "left_anti").select("conv_id", "n_turns", "n_equal", F.lower("whole").alias("chain"), "text")


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, list(DISTINCT struct_pack(turn := turn, role := role, text := text)) AS raw
  FROM conversations GROUP BY conv_id),
numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY t.turn NULLS FIRST, t.role NULLS FIRST, t.text NULLS FIRST) AS k,
         md5(concat(coalesce('=' || t.role, '~'), '|', coalesce('=' || t.text, '~'))) AS own,
         concat('{OPEN}', coalesce(t.role, 'unknown'), chr(10), coalesce(t.text, ''), '{CLOSE}', chr(10)) AS shown
  FROM (SELECT conv_id, unnest(raw) AS t FROM turns)),
chain AS (
  WITH RECURSIVE r AS (
    SELECT conv_id, k, md5(concat(md5(''), own)) AS h FROM numbered WHERE k = 1
    UNION ALL
    SELECT n.conv_id, n.k, md5(concat(r.h, n.own)) FROM r JOIN numbered n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.k = r.k + 1)
  SELECT * FROM r),
sized AS (
  SELECT conv_id, max(k) AS n_turns, string_agg(shown, '' ORDER BY k) AS text FROM numbered GROUP BY conv_id),
whole AS (
  SELECT s.conv_id, s.n_turns, s.text, c.h FROM sized s JOIN chain c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.k = s.n_turns),
begun AS (
  SELECT DISTINCT c.h FROM chain c JOIN sized s ON c.conv_id IS NOT DISTINCT FROM s.conv_id WHERE c.k < s.n_turns)
SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_equal, h AS chain, any_value(text) AS text
FROM whole WHERE h NOT IN (SELECT h FROM begun) GROUP BY h
"""
