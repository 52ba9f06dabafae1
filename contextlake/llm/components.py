"""Connected components of a table of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from contextlake.llm.store import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b); component is the least id of it.

    Each round takes the least label among the neighbours and then the label's own label, so labels
    travel in doubling steps. Minima are summed before the shuffle, and joins on a busy id are split by
    adaptive execution. Only a count reaches the driver. No links: no rows.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("beyond"))
        moved = stepped.join(jump, "to", "left").select("id", "old", F.least("to", F.coalesce("beyond", "to")).alias("component"))
        seen = Observation()  # counted by the tasks that write the round
        labels = checkpointed(moved.observe(seen, F.count_if(F.col("component") != F.col("old")).alias("changed"))).select("id", "component")
        if not seen.get["changed"]:
            return labels
