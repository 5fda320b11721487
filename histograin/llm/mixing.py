"""Mixing sources to target weights (op 8) by Pfair scheduling, in DataFrame operations alone.

A source's documents are cut into blocks in the order of a hash. Its weight is a whole number of tickets, a of W in
all; its k-th ticket of a round of W slots is released at slot floor((k - 1) W / a) and due at ceil(k W / a). Giving
every slot to the released ticket that is due first keeps each source within one block of its share at every slot.
The order of one round is found from the tickets alone and holds for all rounds, so that a block's slots follow from
its number. A source that runs out begins again, until every source has been gone through once: no row is dropped.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Rows in a block.
BLOCK_ROWS = 64
#: Tickets in a round, about: weights are multiples of one in so many. More, up to the second, if the least source's weight asks for it.
TICKETS, MOST_TICKETS = 1000, 100_000
#: Target weights follow the sources' rows to this power.
POWER = 0.7
#: Sources that are scheduled by themselves at most; the smallest ones beyond share the tickets of all of them.
MAX_SOURCES = 4096
#: Rows of a source that are ranked in one task, about; eight times as many are split by place.
RANK_ROWS = 20_000
#: Stands for a null source, and for the sources beyond ``MAX_SOURCES``.
NULL_SOURCE, OTHERS = "(null)", "(others)"


def tickets_of(weights: dict[str, float], tickets: int = TICKETS, most: int = MOST_TICKETS) -> dict[str, int]:
    """Target weights as tickets, rounded half up, at least one; a round is large enough for the least weight to have a whole one, up to ``most``."""
    total = sum(w for _, w in sorted(weights.items()))
    tickets = max(tickets, min(most, int(total / min(weights.values())) if weights else 0))
    return {s: max(1, int(tickets * w / total + 0.5)) for s, w in sorted(weights.items())}


def round_order(tickets: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source in one round: earliest deadline first, then more tickets, then the name."""
    w = sum(tickets.values())
    waiting = sorted(((k * w // a, -(-(k + 1) * w // a), -a, s) for s, a in tickets.items() for k in range(a)), reverse=True)
    ready: list[tuple] = []
    slots: dict[str, list[int]] = {s: [] for s in tickets}
    for t in range(w):
        while waiting and waiting[-1][0] <= t:
            heapq.heappush(ready, waiting.pop()[1:])
        due, _, s = heapq.heappop(ready)
        if due <= t:
            raise ValueError("tickets can't be scheduled")
        slots[s].append(t)
    return slots


def _order() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but source and doc_id in one struct, where no name of ours can meet theirs; and the columns of ``docs`` from it."""
    own = docs.select("source", "doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix__row"))
    return own, [F.col("mix__row").getField(c).alias(c) for c in docs.columns]


def interleave(docs: DataFrame, tickets: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, parts: int | None = None, max_sources: int = MAX_SOURCES) -> DataFrame:
    """The rows of ``docs`` with slot, place (in the block), block and epoch; sorted by slot and place they are the mixture.

    With ``parts``, in this order: so many partitions of equal ranges of slots, each sorted.

    ``tickets``: target weights by source (a null source is ``NULL_SOURCE``); a source without one has one ticket. By
    default a source's weight is its rows to the power ``POWER``. Beyond ``max_sources`` the smallest sources are
    scheduled as one, ``OTHERS``, with the sum of their weights, so that any number of sources is mixed.
    Null and repeated doc_ids are ordered like any other, repeated rows come as often as they stand in ``docs``; an
    empty table gives none. Columns of the names that are added are replaced; all others pass through, so a null or
    long text makes no difference.
    """
    docs = docs.drop("slot", "place", "block", "epoch")
    own, back = apart(docs)
    own = own.withColumn("mix__s", F.coalesce(F.col("source").cast("string"), F.lit(NULL_SOURCE))).withColumn("mix__o", _order())
    counts = own.groupBy("mix__s").agg(F.count("*").cast("bigint").alias("n"))
    n_sources = counts.count()
    if n_sources <= max_sources:
        rows = {r["mix__s"]: r.n for r in counts.collect()}
        weights = {s: n**POWER for s, n in rows.items()}
    else:
        top = counts.orderBy(F.desc("n"), "mix__s").limit(max_sources - 1)
        rows = {r["mix__s"]: r.n for r in top.collect()}
        weights = {s: n**POWER for s, n in rows.items()}
        kept = docs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in rows])).alias("mix__top"))
        own = own.join(F.broadcast(kept), F.col("mix__s") == F.col("mix__top"), "left").withColumn("mix__s", F.coalesce("mix__top", F.lit(OTHERS))).drop("mix__top")
        rest = counts.join(F.broadcast(kept), F.col("mix__s") == F.col("mix__top"), "left_anti").agg(F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(POWER))).alias("w")).first()
        rows[OTHERS], weights[OTHERS] = rows.get(OTHERS, 0) + rest.n, weights.get(OTHERS, 0) + rest.w
    tickets = tickets_of(weights) if tickets is None else {s: tickets.get(s, 1) for s in rows}
    slots, w = round_order(tickets), sum(tickets.values())
    blocks = {s: -(-n // block_rows) for s, n in rows.items()}
    end = 1 + max(((b - 1) // tickets[s] * w + slots[s][(b - 1) % tickets[s]] for s, b in blocks.items()), default=-1)
    plan = [{"mix__s": s, "mix__n": blocks[s], "mix__a": a, "mix__j": end // w * a + sum(x < end % w for x in slots[s]), "mix__at": slots[s]} for s, a in tickets.items()] if rows else []
    schedule = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), "array<struct<mix__s: string, mix__n: bigint, mix__a: bigint, mix__j: bigint, mix__at: array<bigint>>>")))

    # rank of each row in its source: rows before its range of hashes, and its number there
    digits = 1
    while max(rows.values(), default=0) / 16**digits > RANK_ROWS:
        digits += 1
    own = own.withColumn("mix__b", F.substring("mix__o", 1, digits))
    crowded = own.groupBy("mix__s", "mix__b").agg(F.count("*").alias("mix__c")).where(F.col("mix__c") > 8 * RANK_ROWS)  # by repeated doc_ids
    if not crowded.isEmpty():  # one row for so many rows
        piece = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("mix__c") / RANK_ROWS))
        own = own.join(F.broadcast(crowded), ["mix__s", "mix__b"], "left").withColumn("mix__b", F.concat("mix__b", F.when(F.col("mix__c").isNull(), "").otherwise(F.lpad(piece.cast("string"), 9, "0")))).drop("mix__c")
    sizes = own.groupBy("mix__s", "mix__b").agg(F.count("*").alias("mix__c"))
    before = sizes.withColumn("mix__before", F.sum("mix__c").over(Window.partitionBy("mix__s").orderBy("mix__b")) - F.col("mix__c")).drop("mix__c")
    ranked = own.join(before, ["mix__s", "mix__b"]).withColumn("mix__r", F.col("mix__before") + F.row_number().over(Window.partitionBy("mix__s", "mix__b").orderBy("mix__o", "doc_id")) - 1)
    placed = ranked.join(F.broadcast(schedule), "mix__s")  # at most MAX_SOURCES rows
    block, a, n = F.floor(F.col("mix__r") / block_rows), F.col("mix__a"), F.col("mix__n")
    placed = placed.withColumn("block", block.cast("bigint")).withColumn("place", F.pmod(F.col("mix__r"), F.lit(block_rows)).cast("int"))
    placed = placed.withColumn("mix__k", F.explode(F.sequence(F.col("block"), F.col("mix__j") - 1, n)))
    slot = F.expr("mix__k div mix__a") * w + F.element_at("mix__at", (F.pmod(F.col("mix__k"), a) + 1).cast("int"))
    placed = placed.withColumn("slot", slot.cast("bigint")).withColumn("epoch", F.expr("mix__k div mix__n").cast("bigint"))
    placed = placed.select(*back, "slot", "place", "block", "epoch")
    if parts:
        placed = placed.repartitionById(parts, F.expr(f"cast(slot * {parts} div {max(1, end)} as int)")).sortWithinPartitions("slot", "place")
    return placed


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents").select("doc_id", "source"))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '{NULL_SOURCE}') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
n AS (SELECT s, count(*) AS n FROM d GROUP BY s),
sums AS (SELECT total, greatest({TICKETS}, least({MOST_TICKETS}, CAST(floor(total / least) AS BIGINT))) AS w
         FROM (SELECT sum(pow(n, {POWER}) ORDER BY s) AS total, min(pow(n, {POWER})) AS least FROM n)),
p AS (SELECT s, n, greatest(1, CAST(floor(w * pow(n, {POWER}) / total + 0.5) AS BIGINT)) AS a, row_number() OVER (ORDER BY s) AS i FROM n, sums),
q AS (SELECT list(a ORDER BY i) AS a, CAST(sum(a) AS BIGINT) AS w FROM p),
edf AS (SELECT CAST(0 AS BIGINT) AS t, a, w, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS k, CAST(0 AS BIGINT) AS won FROM q
  UNION ALL
  SELECT t + 1, a, w, list_transform(k, lambda x, i: x + CASE WHEN i = win THEN 1 ELSE 0 END), win FROM (
    SELECT *, list_min(list_transform(list_filter(range(1, len(a) + 1), lambda i: k[i] < a[i] AND k[i] * w // a[i] <= t),
      lambda i: (((k[i] + 1) * w + a[i] - 1) // a[i] * 100000 + 99999 - a[i]) * 10000 + i)) % 10000 AS win FROM edf WHERE t < w)),
slots AS (SELECT won AS i, t - 1 AS pos, row_number() OVER (PARTITION BY won ORDER BY t) - 1 AS k FROM edf WHERE won > 0),
b AS (SELECT s, i, a, CAST(ceil(n / CAST({BLOCK_ROWS} AS DOUBLE)) AS BIGINT) AS nb FROM p),
fin AS (SELECT max((nb - 1) // a * (SELECT w FROM q) + pos) + 1 AS fin FROM b JOIN slots ON slots.i = b.i AND slots.k = (nb - 1) % a),
r AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY o, doc_id) - 1 AS r FROM d),
placed AS (SELECT doc_id, source, i, a, nb, r // {BLOCK_ROWS} AS block, r % {BLOCK_ROWS} AS place, unnest(range(r // {BLOCK_ROWS}, ((SELECT fin // w + 1 FROM fin, q) * a), nb)) AS j FROM r JOIN b USING (s)),
timed AS (SELECT doc_id, source, j // a * (SELECT w FROM q) + pos AS slot, place, block, j // nb AS epoch FROM placed JOIN slots ON slots.i = placed.i AND slots.k = j % a)
SELECT doc_id, source, CAST(slot AS BIGINT) AS slot, CAST(place AS INTEGER) AS place, CAST(block AS BIGINT) AS block, CAST(epoch AS BIGINT) AS epoch FROM timed WHERE slot < (SELECT fin FROM fin)
"""
