"""Deal identity: which records describe the same transaction, and their merge.

Two records are the same deal when type matches, the dates lie within the tolerance, the
targets share a distinctive token and either both buyers are named, share a token and the
values do not contradict, or one buyer is undisclosed and value or stake is equal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsfunnel import dims
from newsfunnel.functions import text
from newsfunnel.operators.components import connected_components
from newsfunnel.session import StageStore, cut_lineage, drop_path, stage_store, write_stage

_DAY = 86_400_000_000
_KEY = ["key", "key2"]

def is_undisclosed(name: Column) -> Column:
    return F.lower(text.web_trim(name)).isin("", dims.UNDISCLOSED.lower())


def values_close(a: Column, b: Column) -> Column:
    """Two figures of one currency within the tolerance of the larger one."""
    return F.abs(a - b) <= F.lit(dims.VALUE_TOLERANCE) * F.greatest(a, b)


def _profiles(deals: DataFrame, generic: list[str]) -> DataFrame:
    named = ~is_undisclosed(F.col("acquirer"))

    def tokens(column: str) -> Column:
        return F.array_distinct(text.distinctive_tokens(F.col(column), generic))

    return deals.select(
        "deal_id", "deal_type", tokens("target").alias("target_tokens"),
        F.when(named, tokens("acquirer")).otherwise(F.array().cast("array<string>")).alias(
            "buyer_tokens"),
        named.alias("named"), "deal_value", F.coalesce("currency", F.lit("")).alias("currency"),
        "stake_pct", F.unix_micros("announced_date").alias("at"),
    ).filter((F.size("target_tokens") > 0) & F.col("at").isNotNull())


def _claims(profiles: DataFrame) -> DataFrame:
    """The reasons for which a record can match, one row each: (deal_id, at, key, key2, value, open,
    figured). The key is two 64-bit hashes of its parts: a record has a dozen claims, and as text
    their keys would be most of what is moved, sorted and compared.

    Two records are the same deal exactly if they share a key, their dates and values are
    close, and at least one of them is open:
      buyer   type, target token, buyer token; open when the value is undisclosed
      figure  the same plus the currency; always open, the values have to be close
      value   type, target token, currency; open when the buyer is undisclosed
      stake   type, target token, stake; open when the buyer is undisclosed
    The claims by figure and value are `figured`; the others all carry the value 1.
    """

    def key(kind: str, *parts: Column) -> list[Column]:
        text_key = F.concat_ws("\u0001", F.lit(kind), "deal_type", *parts)
        return [F.xxhash64(text_key).alias("key"), F.xxhash64(F.lit(1), text_key).alias("key2")]

    def claim(k: list[Column], value: Column | None, is_open: Column) -> Column:
        return F.struct(
            *k, (F.lit(1.0) if value is None else value).alias("value"),
            is_open.alias("open"), F.lit(value is not None).alias("figured"),
        )

    none = F.array().cast("array<struct<key:bigint,key2:bigint,value:double,open:boolean,figured:boolean>>")
    value, currency, stake = F.col("deal_value"), F.col("currency"), F.col("stake_pct")
    unnamed = ~F.col("named")

    def of_token(t: Column) -> Column:
        buyer = F.transform("buyer_tokens", lambda b: claim(
            key("buyer", t, b), None, value.isNull()))
        figure = F.transform("buyer_tokens", lambda b: claim(
            key("figure", t, b, currency), value, F.lit(True)))
        by_value = F.array(claim(key("value", t, currency), value, unnamed))
        by_stake = F.array(claim(key("stake", t, stake.cast("string")), None, unnamed))
        return F.concat(
            buyer,
            F.when(value > 0, F.concat(figure, by_value)).otherwise(none),
            F.when(stake.isNotNull(), by_stake).otherwise(none),
        )

    claims = F.flatten(F.transform("target_tokens", of_token))
    return profiles.select("deal_id", "at", F.inline(claims))


def _hubs(claims: DataFrame) -> DataFrame:
    """Open records that stand for their cell in it and in the eight cells around it.

    A cell is a key with a date slot and a value step, each as wide as the tolerance, so
    inside a cell everything is close. One open record links the cell. Across one border the
    open record nearest to the border decides for all: the latest, the earliest, the largest or
    the smallest. Across a corner both date and value matter, so every distinct value of the
    cell stands for itself there, with its latest or earliest record.
    """
    cell = [*_KEY, "slot", "step"]

    def at(ds: int, dv: int, record: str) -> Column:
        return F.struct(
            (F.col("slot") + ds).alias("slot"), (F.col("step") + dv).alias("step"),
            F.col(f"{record}.deal_id").alias("hub"), F.col(f"{record}.at").alias("hub_at"),
            F.col(f"{record}.value").alias("hub_value"),
        )

    def pick(fn, by: str, name: str) -> Column:
        return fn(F.struct("deal_id", "at", "value"), F.struct(by, "deal_id")).alias(name)

    opened = claims.filter("open")
    sides = opened.groupBy(*cell).agg(
        pick(F.max_by, "at", "late"), pick(F.min_by, "at", "early"),
        pick(F.max_by, "value", "top"), pick(F.min_by, "value", "low"),
    ).select(*_KEY, F.inline(F.array(
        at(0, 0, "early"), at(1, 0, "late"), at(-1, 0, "early"), at(0, 1, "top"),
        at(0, -1, "low"),
    )))
    corners = opened.filter("figured").groupBy(*cell, "value").agg(
        F.max_by(F.struct("deal_id", "at", "value"), F.struct("at", "deal_id")).alias("late"),
        F.min_by(F.struct("deal_id", "at", "value"), F.struct("at", "deal_id")).alias("early"),
    ).select(*_KEY, F.inline(F.array(
        at(1, 1, "late"), at(1, -1, "late"), at(-1, 1, "early"), at(-1, -1, "early"),
    )))
    return sides.unionByName(corners)


def same_deal_links(
    deals: DataFrame, tolerance_days: int = dims.DATE_TOLERANCE_DAYS,
    generic: list[str] = dims.GENERIC_TOKENS,
) -> DataFrame:
    """Edges (a, b), all of them same-deal pairs, whose connected components are the groups of
    same deals.

    Records meet the hubs of their cell and its neighbours, never each other, so the number of
    edges grows with the records even if a third of them share one key.
    """
    span = tolerance_days * _DAY
    width = -math.log(1 - dims.VALUE_TOLERANCE) * (1 - 1e-12)
    claims, path, _ = write_stage(
        _claims(_profiles(deals, generic))
        .withColumn("slot", F.floor(F.col("at") / F.lit(span)).cast("bigint"))
        .withColumn("step", F.floor(F.log("value") / F.lit(width)).cast("bigint")),
        "claims",
    )
    links = cut_lineage(
        claims.join(_hubs(claims), [*_KEY, "slot", "step"])
        .filter(
            (F.col("hub") != F.col("deal_id"))
            & (F.abs(F.col("at") - F.col("hub_at")) <= span)
            & values_close(F.col("value"), F.col("hub_value"))
        )
        .select(F.least("hub", "deal_id").alias("a"), F.greatest("hub", "deal_id").alias("b"))
        .distinct(),
        "links",
    )
    drop_path(deals.sparkSession, path)  # a dozen rows for every record
    return links


def members_of(keyed: DataFrame, membership: DataFrame, own: str) -> DataFrame:
    """`keyed` (with cluster_id) joined to its cluster's members as article_id; a row whose
    cluster is unknown gets its `own` id.

    Written as an inner join plus the rest, not as an outer join: a crowded cluster sits on the
    membership side, and only an inner join lets adaptive execution split that side.
    """
    known = membership.select("cluster_id").distinct()
    return membership.join(keyed, "cluster_id").unionByName(
        keyed.join(known, "cluster_id", "left_anti").withColumn("article_id", F.col(own))
    )


def merge_deals(
    deals: DataFrame, links: DataFrame, membership: DataFrame, clusters: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(merged deals, membership) after folding each group of same deals into one record.

    The survivor is the record with a value, then a named buyer, then the larger cluster, then
    the earlier announcement, then the earlier arrival. What it lacks comes from the first
    record, in arrival order, that has it. Its cluster takes in every member of the group's
    clusters. `merged` counts the records folded away.
    """
    work = StageStore(deals.sparkSession, "components")
    with stage_store(work):
        component = connected_components(links).withColumnRenamed("node", "deal_id")
    sized = cut_lineage(
        deals.join(clusters.select("cluster_id", "size"), "cluster_id", "left")
        .withColumn("size", F.coalesce("size", F.lit(1)).cast("bigint"))
        .join(component, "deal_id", "left")
    )
    work.release()
    arrival = ["feed_pos", "deal_id"]
    unnamed = is_undisclosed(F.col("acquirer"))
    preference = [
        F.col("deal_value").isNull(), unnamed, F.desc("size"), F.asc("announced_date"), *map(F.asc, arrival),
    ]
    grouped = sized.filter("component is not null")

    def first(rows: DataFrame, order: list, **values: str) -> DataFrame:
        """`values` of the first row of each group, found on narrow rows behind a group limit."""
        place = F.row_number().over(Window.partitionBy("component").orderBy(*order))
        return rows.withColumn("_rn", place).filter("_rn = 1").select(
            "component", *[F.col(c).alias(name) for name, c in values.items()])

    winners = (
        first(grouped, preference, deal_id="deal_id")
        .join(first(grouped.filter("deal_value is not null"), arrival, m_value="deal_value", m_currency="currency"),
              "component", "left")
        .join(first(grouped.filter(~unnamed), arrival, m_buyer="acquirer"), "component", "left")
        .join(first(grouped.filter("stake_pct is not null"), arrival, m_stake="stake_pct"), "component", "left")
        .join(grouped.groupBy("component").agg((F.count(F.lit(1)) - 1).alias("merged")), "component")
    )
    groups = cut_lineage(winners.join(grouped.drop("component", "size"), "deal_id"))
    enriched = {
        "deal_value": F.coalesce("deal_value", "m_value"),
        "currency": F.when(F.col("deal_value").isNull(), F.col("m_currency")).otherwise(F.col("currency")),
        "acquirer": F.when(unnamed, F.coalesce("m_buyer", "acquirer")).otherwise(F.col("acquirer")),
        "stake_pct": F.coalesce("stake_pct", "m_stake"),
    }
    folded = groups.select(*[enriched.get(c, F.col(c)).alias(c) for c in deals.columns], "merged")
    alone = sized.filter("component is null").select(
        *deals.columns, F.lit(0).cast("bigint").alias("merged")
    )
    survivors = groups.select("component", F.col("cluster_id").alias("into"))
    moves = sized.select("deal_id", "cluster_id", "component").join(
        survivors, "component", "left"
    ).select("deal_id", "cluster_id", F.coalesce("into", "cluster_id").alias("into"))
    merged_membership = members_of(moves, membership, "deal_id").select(
        "article_id", F.col("into").alias("cluster_id")
    ).distinct()
    return alone.unionByName(folded), merged_membership
