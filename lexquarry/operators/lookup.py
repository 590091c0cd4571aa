"""Lookups: sources by priority, then the cache, in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import SlotStore, upsert

#: The sources whose sections may come from the cache, and the jurisdiction that never reads it.
CACHEABLE = ("neuris", "gesetze-im-internet", "ris", "fedlex", "eur-lex", "boe", "finlex")
LIVE_ONLY = "IT"


def fresh(retrieved_at: Column, now: Column, ttl_days: int | None) -> Column:
    """Whether a kept section may still be used: forever without a limit; never if its time can't be read."""
    if ttl_days is None:
        return F.lit(True)
    return F.coalesce(F.unix_micros(now) - F.unix_micros(retrieved_at.try_cast("timestamp")) <= ttl_days * 86_400_000_000, F.lit(False))


def look_up(refs: DataFrame, live: DataFrame, cache: DataFrame, now: Column, ttl_days: int | None = None, cacheable: tuple[str, ...] = CACHEABLE) -> DataFrame:
    """ref_id, status, provider, text.

    refs: ref_id, jurisdiction, keys (cache keys, the first that is there counts). live: ref_id, priority, provider,
    status, text; of a reference the lowest priority that isn't `not-found` counts, and an error there is its result,
    with no look at the cache. cache: key, provider, retrieved_at, text; only fresh sections of allowed sources.
    """
    answers = live.where("status <> 'not-found'").groupBy("ref_id").agg(F.min_by(F.struct("status", "provider", "text"), "priority").alias("l"))
    open_ = refs.join(answers, "ref_id", "left")
    probes = open_.where(F.col("l").isNull() & ~F.col("jurisdiction").eqNullSafe(LIVE_ONLY)).select("ref_id", F.posexplode("keys").alias("at", "key"))
    kept = probes.join(cache, "key").groupBy("ref_id").agg(F.min_by(F.struct("provider", "retrieved_at", "text"), "at").alias("c"))
    good = F.col("c.provider").isin(*cacheable) & fresh(F.col("c.retrieved_at"), now, ttl_days)
    out = open_.join(kept, "ref_id", "left")
    status = F.when(F.col("l").isNotNull(), F.when(F.col("l.status") == "ok", "live").otherwise(F.col("l.status"))).when(good, "cached").otherwise("not-found")
    text = lambda c: F.coalesce(F.col(f"l.{c}"), F.when(good, F.col(f"c.{c}")))
    return out.select("ref_id", status.alias("status"), text("provider").alias("provider"), text("text").alias("text"))


def keep_sections(store: SlotStore, sections: DataFrame, cacheable: tuple[str, ...] = CACHEABLE) -> None:
    """Merge live sections (key, provider, retrieved_at, text) into the cache that a store holds: of a key the last one
    retrieved counts, keys without new sections stay. Sources that may not be cached, and rows without a key, don't."""
    rows = sections.where(F.col("key").isNotNull() & F.col("provider").isin(*cacheable)).select("key", "provider", "retrieved_at", "text")
    last = rows.groupBy("key").agg(F.max_by(F.struct("provider", "retrieved_at", "text"), "retrieved_at").alias("_x")).select("key", "_x.*")
    now = store.read()
    store.write_candidate(last if now is None else upsert(now, last, ["key"], "retrieved_at"))
    store.activate()


def current_answers(events: DataFrame, idle_seconds: float) -> DataFrame:
    """The answers that are still wanted when they come: no later request of their session came before them.

    events: session, at (timestamp), number (the order of events of one time), request (a boolean), revision (of a
    request its own, of an answer that of the request it answers), and whatever is to be taken over. A session in
    which nothing happens for idle_seconds ends: answers to its requests come too late.
    """
    by = Window.partitionBy("session").orderBy("at", "number")
    quiet = F.unix_micros("at") - F.lag(F.unix_micros("at")).over(by) > int(idle_seconds * 1e6)
    part = F.sum(F.coalesce(quiet, F.lit(False)).cast("int")).over(by)
    own = Window.partitionBy("session", "_part").orderBy("at", "number").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max_by(F.when(F.col("request"), F.col("revision")), F.when(F.col("request"), F.struct("at", "number"))).over(own)
    return events.withColumn("_part", part).withColumn("_last", last).where(~F.col("request") & (F.col("revision") == F.col("_last"))).drop("_part", "_last")
