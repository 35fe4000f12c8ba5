"""Replenishment day by day: the batch simulation over a stream of daily demand.

The state of a SKU is its inventory, its open orders by the day they are due, and
the last day seen; it is kept in the state store, so a run goes on after a restart
from its checkpoint.  Batches of any size give the rows of ``simulate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larder.operators.simulate import POLICY, whole_lead_time

_STATE = "inventory double, day date, due array<date>, quantity array<double>"
_TRACE = "sku_id string, date date, initial_inventory double, received double, inventory double, inventory_position double, rop_used double, forecast_target_date date, order_decision_eligible boolean, demand double, sales_quantity double, lost double, order_placed int"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Replenishment(StatefulProcessor):
    """One SKU's days, in order: receive, sell, then order by what is there and on its way."""

    def __init__(self, last_day: date):
        self.last_day = last_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("date", kind="stable")
        known = self.run.get() if self.run.exists() else None
        inventory, before, orders = (None, None, {}) if known is None else (known[0], known[1], dict(zip(known[2], known[3], strict=True)))
        out = []
        for row in days.itertuples(index=False):
            if before is not None and row.date != before + timedelta(1):
                raise ValueError(f"the day after {before} must come next for SKU {key[0]}, not {row.date}")
            start = None if before is not None else float(row.initial_inventory)
            inventory, before = (inventory if start is None else start), row.date
            received = orders.pop(row.date, 0.0)
            inventory += received
            sales = min(row.demand, inventory)
            inventory -= sales
            point, ordered = None, False
            if row.date < self.last_day:
                point = row.target * row.lead_time + row.safety_stock if row.dynamic else row.rop
                if pd.isna(point):
                    raise ValueError(f"no forecast for the day after {row.date} for SKU {key[0]}")
                ordered = inventory + sum(orders.values()) <= point
            if ordered:
                due = row.date + timedelta(int(row.lead_time))
                orders[due] = orders.get(due, 0.0) + row.order_quantity
            ahead = row.date + timedelta(1) if row.date < self.last_day else None
            out.append((key[0], row.date, start, received, inventory, inventory + sum(orders.values()), point, ahead, ahead is not None, row.demand, sales, row.demand - sales, int(ordered)))
        self.run.update((inventory, before, list(orders), list(orders.values())))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _TRACE.split(", ")])

    def close(self) -> None:
        pass


def replenish(days: DataFrame, policy: DataFrame, initial: DataFrame, last_day: date, dynamic: bool = False) -> DataFrame:
    """The trace of a stream ``days`` (sku_id, date, demand, and target if ``dynamic``), one row a day.

    ``policy`` and ``initial`` are tables; each SKU needs a row in both, once.  Days of
    a SKU must come without gaps or doubles, in any number of batches, and in order
    between batches; no order is placed on ``last_day``.
    """
    spark = days.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    own = policy.select("sku_id", *POLICY).withColumn("lead_time", whole_lead_time(["sku_id"])).join(initial, "sku_id")
    numbers = [F.col(c).cast("double").alias(c) for c in (*POLICY[1:], "initial_inventory")]
    target = F.col("target").cast("double") if dynamic else F.lit(None).cast("double")
    rows = days.select("sku_id", "date", F.col("demand").cast("double").alias("demand"), target.alias("target"))
    rows = rows.join(own.select("sku_id", "lead_time", *numbers, F.lit(dynamic).alias("dynamic")), "sku_id")
    return rows.groupBy("sku_id").transformWithStateInPandas(Replenishment(last_day), outputStructType=_TRACE, outputMode="Append", timeMode="None")
