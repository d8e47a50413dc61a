"""Names, identifiers and codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Basic GTFS route types.
ROUTE_TYPES = {0: "Tram", 1: "Metro", 2: "Rail", 3: "Bus", 4: "Ferry", 5: "Tram", 6: "CableCar", 7: "CableCar", 11: "Tram", 12: "Rail"}
#: Ranges of extended GTFS route types.
ROUTE_RANGES = ((100, 117, "Rail"), (200, 209, "Coach"), (400, 405, "Metro"), (700, 716, "Bus"), (900, 906, "Tram"), (1300, 1307, "CableCar"), (1500, 1507, "Taxi"))
#: GTFS transfer types.
TRANSFER_TYPES = {0: "Recommended", 1: "Timed", 2: "MinimumTime", 3: "Forbidden", 4: "InSeat", 5: "InSeatForbidden"}
#: What may carry paying passengers on the national railway.
PASSENGER_CATEGORIES = ("OO", "OW", "XC", "XD", "XI", "XR", "XX", "XZ", "BR")
HIDDEN_OPERATORS = ("LT", "ZZ", "")


def coded(value: Column, table: dict[int, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, name in reversed(table.items()):
        out = F.when(value == k, name).otherwise(out)
    return out


def transport_type(route_type: Column) -> Column:
    out = F.lit("Unknown")
    for low, high, name in ROUTE_RANGES:
        out = F.when(route_type.between(low, high), name).otherwise(out)
    for k, name in ROUTE_TYPES.items():
        out = F.when(route_type == k, name).otherwise(out)
    return out


def transfer_type(value: Column) -> Column:
    return coded(value, TRANSFER_TYPES, "Unknown")


def transfer_priority(kind: Column) -> Column:
    return F.when(kind == "PlatformAlias", 0).when(kind == "SameStopGroup", 1).otherwise(2)


def passenger_journey(category: Column, operator: Column) -> Column:
    return ~F.coalesce(operator, F.lit("")).isin(*HIDDEN_OPERATORS) & F.coalesce(category, F.lit("")).isin(*PASSENGER_CATEGORIES)


def service_key(name: Column) -> Column:
    """What two spellings of a service's name have in common."""
    return F.regexp_replace(F.upper(F.trim(name)), r"[\s\-/]", "")


def camel_words(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", " ")


def country(dataset: Column) -> Column:
    return F.split_part(dataset, F.lit("-"), F.lit(1))


def trimmed(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def stop_key(stop: Column, index: Column) -> Column:
    return F.concat(stop.cast("string"), F.lit("@"), index.cast("string"))


def block_key(dataset: Column, service: Column, block: Column) -> Column:
    """Blocks are told apart by dataset where it is known, else by service, and the key says which; no block, no key."""
    known = F.coalesce(dataset, F.lit("")) != ""
    owner = F.when(known, F.concat_ws("\u001f", F.lit("dataset"), dataset)).otherwise(F.concat_ws("\u001f", F.lit("service"), F.coalesce(service, F.lit(""))))
    return F.when(F.coalesce(block, F.lit("")) != "", F.concat_ws("\u001f", owner, block))


def day_instance(identifier: Column) -> tuple[Column, Column]:
    """Date and journey of ``DAYINSTANCEOF:<date>:<journey>``; null date and the whole identifier elsewhere."""
    day = F.regexp_extract(identifier, r"^DAYINSTANCEOF:(\d{4}-\d{2}-\d{2}):", 1)
    return F.when(day != "", day.try_cast("date")), F.regexp_replace(identifier, r"^DAYINSTANCEOF:\d{4}-\d{2}-\d{2}:", "")


def platform_tokens(text: Column) -> Column:
    """Platforms named in a text: upper-case letters and digits, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.upper(text), r"PLATFORMS?", ""), F.lit(r"([0-9]+[A-Z]?|\b[A-Z]\b)")))


def hashed(*parts: Column) -> Column:
    """SHA-256 over parts that a separator keeps apart; null counts as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def activity_mask(activities: Column) -> Column:
    """Pickup 1, Setdown 2, Pass 4."""
    bit = lambda x: F.when(x == "Pickup", 1).when(x == "Setdown", 2).when(x == "Pass", 4).otherwise(0)
    return F.aggregate(activities, F.lit(0), lambda acc, x: acc.bitwiseOR(bit(x)))


def distinct_strings(values: Column, ignore: Column | None = None) -> Column:
    """Each value once, first place kept, null and empty ones and ``ignore`` left out."""
    kept = F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))
    return kept if ignore is None else F.array_except(kept, ignore)


def match_stops(wanted: Column, seen: Column) -> Column:
    """Places (from 1) at which the wanted stops are met in order, each as early as it can; null if one is not met."""

    def step(state: Column, stop: Column) -> Column:
        rest = F.slice(seen, state["at"] + 1, F.greatest(F.size(seen) - state["at"], F.lit(0)))
        found = F.array_position(rest, stop).cast("int")
        at = F.when(state["ok"] & (found > 0), state["at"] + found).otherwise(state["at"])
        ok = state["ok"] & (found > 0)
        return F.struct(at.alias("at"), ok.alias("ok"), F.when(ok, F.concat(state["out"], F.array(at))).otherwise(state["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), F.array().cast("array<int>").alias("out"))
    end = F.aggregate(wanted, zero, step)
    return F.when(end["ok"], end["out"])
