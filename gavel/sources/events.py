"""The tagged event union: build, split (demux), accessors and JSON form.

One mixed stream holds Person, Auction and Bid events as `type` plus three
nullable structs. `demux` is three filters over one scan; Spark evaluates them
lazily, each query reading only the branch it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.schema import AUCTION, AUCTION_COLS, BID, BID_COLS, EVENT, EVENT_TYPES, PERSON, PERSON_COLS
from gavel.sources.tables import AuctionTables


def _null_struct(schema: T.StructType):
    return F.lit(None).cast(schema)


def to_events(t: AuctionTables) -> DataFrame:
    """Union the three relations into the tagged event form."""
    person = t.person.select(F.lit("Person").alias("type"),
                             F.struct(*PERSON_COLS).cast(PERSON).alias("person"),
                             _null_struct(AUCTION).alias("auction"), _null_struct(BID).alias("bid"))
    auction = t.auction.select(F.lit("Auction").alias("type"), _null_struct(PERSON).alias("person"),
                               F.struct(*AUCTION_COLS).cast(AUCTION).alias("auction"),
                               _null_struct(BID).alias("bid"))
    bid = t.bid.select(F.lit("Bid").alias("type"), _null_struct(PERSON).alias("person"),
                       _null_struct(AUCTION).alias("auction"), F.struct(*BID_COLS).cast(BID).alias("bid"))
    return person.unionByName(auction).unionByName(bid)


def demux(events: DataFrame) -> AuctionTables:
    """Split the union into typed relations (variant extract per type)."""
    return AuctionTables(
        person=events.where(F.col("type") == "Person").select("person.*"),
        auction=events.where(F.col("type") == "Auction").select("auction.*"),
        bid=events.where(F.col("type") == "Bid").select("bid.*"),
    )


def event_accessors(events: DataFrame) -> DataFrame:
    """Common accessors: event time and id (a bid's id is its auction)."""
    return events.select(
        "type",
        F.coalesce("person.id", "auction.id", "bid.auction").alias("id"),
        F.coalesce("person.date_time_ns", "auction.date_time_ns", "bid.date_time_ns").alias("time_ns"),
    )


def flatten(events: DataFrame) -> DataFrame:
    """Event union as flat prefixed columns (for comparison and export)."""
    cols = [F.col("type")]
    for kind, schema in (("person", PERSON), ("auction", AUCTION), ("bid", BID)):
        cols += [F.col(f"{kind}.{f.name}").alias(f"{kind}_{f.name}") for f in schema.fields]
    return events.select(*cols)


# Wire names: times travel as `date_time` / `expires` (ns), the type as a tag
# beside the variant's own fields.
_WIRE = {"date_time_ns": "date_time", "expires_ns": "expires"}


def events_to_json(events: DataFrame) -> DataFrame:
    """One JSON object per event, internally tagged by `type`."""
    def variant(kind: str, schema: T.StructType):
        fields = [F.lit(kind.capitalize()).alias("type")]
        fields += [F.col(f"{kind}.{f.name}").alias(_WIRE.get(f.name, f.name)) for f in schema.fields]
        return F.to_json(F.struct(*fields))

    unknown = F.raise_error(F.concat(F.lit("unknown event type "), F.coalesce(F.col("type"), F.lit("NULL"))))
    return events.select(
        F.when(F.col("type") == "Person", variant("person", PERSON))
         .when(F.col("type") == "Auction", variant("auction", AUCTION))
         .when(F.col("type") == "Bid", variant("bid", BID))
         .otherwise(unknown.cast("string")).alias("value"))


def _wire_schema() -> T.StructType:
    seen, fields = set(), [T.StructField("type", T.StringType())]
    for schema in (PERSON, AUCTION, BID):
        for f in schema.fields:
            name = _WIRE.get(f.name, f.name)
            if name not in seen:
                seen.add(name)
                fields.append(T.StructField(name, f.dataType))
    return T.StructType(fields)


def events_from_json(lines: DataFrame, col: str = "value", bad: str = "fail") -> DataFrame:
    """Parse the JSON form back into the tagged union (batch or streaming).

    A line is bad when it does not parse, a field has the wrong type, or its
    type is none of the three. `bad="fail"` fails the query on the first one;
    `bad="keep"` adds a column `bad_line`, which holds such a line (its type
    and structs are then NULL, so no query takes it for an event) and is NULL
    for events.
    """
    if bad not in ("fail", "keep"):
        raise ValueError("bad must be 'fail' or 'keep'")
    known = F.col("type").isin(*EVENT_TYPES)
    schema = _wire_schema()
    if bad == "keep":
        schema = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
        j = lines.select(F.col(col).alias("_line"), F.from_json(F.col(col), schema, options).alias("j")).select("_line", "j.*")
        good = F.col("_bad").isNull() & F.coalesce(known, F.lit(False))
        j = j.withColumns({"bad_line": F.when(~good, F.coalesce("_line", F.lit(""))), "type": F.when(good, F.col("type"))})
    else:
        j = lines.select(F.from_json(F.col(col), schema, {"mode": "FAILFAST"}).alias("j")).select("j.*")
        unknown = F.raise_error(F.concat(F.lit("unknown event type "), F.coalesce(F.col("type"), F.lit("NULL"))))
        j = j.withColumn("type", F.when(F.coalesce(known, F.lit(False)), F.col("type")).otherwise(unknown.cast("string")))

    def struct_of(kind: str, schema: T.StructType):
        body = F.struct(*[F.col(_WIRE.get(f.name, f.name)).alias(f.name) for f in schema.fields])
        return F.when(F.col("type") == kind, body.cast(schema)).otherwise(_null_struct(schema))

    return j.select("type", struct_of("Person", PERSON).alias("person"),
                    struct_of("Auction", AUCTION).alias("auction"), struct_of("Bid", BID).alias("bid"),
                    *(["bad_line"] if bad == "keep" else []))


__all__ = ["EVENT", "to_events", "demux", "event_accessors", "flatten", "events_to_json", "events_from_json"]
