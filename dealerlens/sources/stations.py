"""Charging-station feed landed as JSON documents, and the "reuse the
last good snapshot for an hour" cache re-expressed over a snapshot table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import station_name
from ..session import as_of_col
from .fixtures import STATION_JSON_SCHEMA


def parse_feed(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """Parse the documents; ``valid`` is false when any element lacks a
    coordinate (the whole batch then fails, as in the dashboard)."""
    parsed = docs.withColumn("doc", F.from_json(F.col(json_col), STATION_JSON_SCHEMA))
    els = F.coalesce(F.col("doc.elements"), F.array())
    return parsed.withColumn("elements", els).withColumn(
        "valid", F.col("doc").isNotNull()
        & F.forall(els, lambda e: e["lat"].isNotNull() & e["lon"].isNotNull()))


def _inside(e):
    """A charging station inside the box."""
    return ((F.try_element_at(e["tags"], F.lit("amenity")) == K.STATION_AMENITY)
            & e["lat"].between(*K.STATION_LAT) & e["lon"].between(*K.STATION_LON))


def station_feed(docs: DataFrame, json_col: str = "json", keep=()) -> DataFrame:
    """Stations (lat, lon, station_name) of valid documents: amenity
    charging_station inside the bounding box.  Narrow: each document is
    exploded where it was read."""
    p = parse_feed(docs, json_col).where("valid")
    ex = p.select(*keep, F.explode("elements").alias("e"))
    return ex.where(_inside(F.col("e"))).select(*keep, F.col("e.lat").alias("lat"), F.col("e.lon").alias("lon"),
             station_name(F.col("e.tags")).alias("station_name"))


def latest_snapshot(pages: DataFrame, as_of=None, ttl_s: int = K.STATION_TTL_S) -> DataFrame:
    """Stations shown at ``as_of``, with their fetch time and whether it is
    older than ``ttl_s``.

    The last good fetch (all pages valid, at least one station of the right
    kind inside the box) is kept while it is younger than ``ttl_s``.  After
    that the newest fetch decides: a valid one is shown as it is, even if
    empty; an invalid one leaves the last good fetch in place, however old.

    Pages of a fetch are summarised map-side; the decision is one row.  Only
    the chosen fetch's pages are read for their stations."""
    now = as_of_col(as_of)
    landed = pages.where(F.col("fetched_at") <= now)
    p = parse_feed(landed)
    usable = F.size(F.filter("elements", _inside))
    fetches = p.groupBy("snapshot_id").agg(
        F.max("fetched_at").alias("fetched_at"), F.bool_and("valid").alias("valid"), F.sum(usable).alias("n"))
    order, row = F.struct("fetched_at", "snapshot_id"), F.struct("snapshot_id", "fetched_at", "valid")
    good = F.when(F.col("valid") & (F.col("n") > 0), order)
    pick = fetches.agg(F.max_by(row, good).alias("good"), F.max_by(row, order).alias("newest"))
    old = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_s))
    keep = (F.col("good.fetched_at") > old) | ~F.col("newest.valid")
    best = (pick.select(F.when(keep, F.col("good")).otherwise(F.col("newest")).alias("b"))
            .where(F.col("b").isNotNull()).select("b.snapshot_id", F.col("b.fetched_at").alias("_at")))
    chosen = landed.join(F.broadcast(best), "snapshot_id")
    return station_feed(chosen, keep=("snapshot_id", "_at")).select(
        "snapshot_id", F.col("_at").alias("fetched_at"), "lat", "lon", "station_name", (F.col("_at") <= old).alias("is_stale"))
