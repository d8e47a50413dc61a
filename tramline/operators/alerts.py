"""Service alerts: what changed, whom it concerns, and what to tell them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def added_identifiers(states: DataFrame) -> DataFrame:
    """Changes that matter: new content, or only other identifiers.  states has kind and k with was and was_k."""
    content = F.col("was").isNull() | (F.col("kind") != F.col("was"))
    rows = states.where(content | (F.col("k") != F.col("was_k")))
    return rows.withColumn("change", F.when(content, "content").otherwise("identifiers"))


def compile_subscription(rule: dict) -> Column:
    """A boolean column from structured values: no text of users is ever evaluated.

    ``alert_types`` limits the type; ``any_of`` gives names of columns and the values
    of which one must hold.  Without any value nothing matches.
    """
    quoted = lambda field: F.col("`" + field.replace("`", "``") + "`")
    parts = [quoted(field).isin(*values) for field, values in rule.get("any_of", {}).items() if values]
    if not parts:
        return F.lit(False)
    out = reduce(lambda a, b: a | b, parts)
    return out & F.col("event_type").isin(*rule["alert_types"]) if rule.get("alert_types") else out


#: Rows of subscriptions that are sent to every task; with more, they are joined by type and a salt.
SMALL, SALTS = 100_000, 32


def match_subscriptions(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events with each subscription of their type whose least value they exceed: (sub_id, event_id).

    Few subscriptions go to the events; many are copied to each salt, so that a
    type with a third of all events is dealt to as many tasks.
    """
    if subscriptions.limit(SMALL + 1).count() <= SMALL:
        pairs = events.join(F.broadcast(subscriptions), "event_type")
    else:
        salted = subscriptions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = events.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int")).join(salted, ["event_type", "salt"])
    return pairs.where(F.col("value") > F.col("threshold")).select("sub_id", "event_id")


def notification_text(kind: Column, subject: Column) -> Column:
    return F.when(kind == "error", F.concat(F.lit("Journey cancelled: "), subject)).when(kind == "signup", F.concat(F.lit("New alert for "), subject)).otherwise(F.concat(F.lit("Update for "), subject))


#: Types of alerts by a line's status; what is not named is information.
LINE_STATUS = {
    "ServiceSuspended": ("Closed", "Suspended", "Planned Closure", "Service Closed"),
    "ServicePartSuspended": ("Part Suspended", "Part Closure", "Part Closed"),
    "SevereDelays": ("Severe Delays",),
    "Delays": ("Reduced Service",),
    "MinorDelays": ("Minor Delays",),
    "Warning": ("Bus Service", "Exit Only", "Change of frequency", "Diverted", "Not Running", "Issues Reported"),
}
GOOD_STATUS = ("Good Service", "No Issues")
#: Form encoding to what a segment of a path has instead.
SEGMENT = (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%3A", ":"), ("%40", "@"), ("%24", "$"), ("%26", "&"), ("%3D", "="), ("%2B", "+"))
#: Types of events a commute subscribes to.
COMMUTE_EVENTS = ("ServiceAlertCreated", "RealtimeJourneyCancelled", "RealtimeJourneyOverlayCreated", "RealtimeJourneyDelayed", "RealtimeJourneyPlatformSet", "RealtimeJourneyPlatformChanged")


def line_alert(status: Column, valid: Column, hour: Column) -> Column:
    """Type of a line's alert; null for good service, what is not valid now, and closures from 1 to 3 at night."""
    skipped = status.isin(*GOOD_STATUS) | ~valid | ((status == "Service Closed") & hour.between(1, 3))
    out = F.lit("Information")
    for kind, names in LINE_STATUS.items():
        out = F.when(status.isin(*names), kind).otherwise(out)
    return F.when(~F.coalesce(skipped, F.lit(False)), out)


def alert_reference(identifiers: Column, references: Column) -> Column:
    """The first reference (kind, identifier), in their order, that an alert names; null if none.

    A journey is named by its day instances as well, and then has a date.
    """
    named = lambda r: F.exists(identifiers, lambda i: (i == r["identifier"]) | ((r["kind"] == "journey") & i.startswith("DAYINSTANCEOF:") & i.endswith(F.concat(F.lit(":"), r["identifier"]))))
    got = F.try_element_at(F.filter(references, named), F.lit(1))
    day = F.try_element_at(F.filter(identifiers, lambda i: i.startswith("DAYINSTANCEOF:") & i.endswith(F.concat(F.lit(":"), got["identifier"]))), F.lit(1))
    plain = F.array_contains(identifiers, got["identifier"])
    date = F.when((got["kind"] == "journey") & ~plain, F.split_part(day, F.lit(":"), F.lit(2)))
    return F.when(got.isNotNull(), F.struct(got["kind"].alias("kind"), got["identifier"].alias("identifier"), date.alias("date")))


def target_path(kind: Column, identifier: Column, date: Column) -> Column:
    """Where a notice leads: the stop, service or journey it is about; empty if about none."""
    segment = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SEGMENT, F.url_encode(identifier))
    place = F.concat(F.lit("/"), kind, F.lit("s/"), segment)
    tail = F.when((kind == "journey") & date.isNotNull(), F.concat(F.lit("?date="), date)).otherwise("")
    return F.coalesce(F.when(kind.isin("stop", "service", "journey"), F.concat(place, tail)), F.lit(""))


def commute_subscriptions(plans: DataFrame) -> DataFrame:
    """(commute, journey, service, origin, destination) of all plans' legs to six subscriptions a commute, each with all references."""
    refs = plans.groupBy("commute").agg(
        F.array_sort(F.collect_set("journey")).alias("journeys"),
        F.array_sort(F.collect_set("service")).alias("services"),
        F.array_sort(F.collect_set("origin")).alias("platform_stops"),
        F.array_sort(F.array_union(F.collect_set("origin"), F.collect_set("destination"))).alias("stops"),
    )
    return refs.where(F.size("journeys") + F.size("services") + F.size("stops") > 0).withColumn("event_type", F.explode(F.array(*map(F.lit, COMMUTE_EVENTS))))
