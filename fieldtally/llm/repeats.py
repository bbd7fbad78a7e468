"""What occurs more than once in a corpus: names that texts share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.tables import stored


def shared_names(named: DataFrame, share: int) -> tuple[DataFrame, int]:
    """Of (doc_id, names): per document, those names that occur twice or more in all, each
    with the number of groups of ``share`` that its occurrences make; and how many
    occurrences of such names there are.

    Counting comes first in each task, and what is counted is joined back from a stored
    table, so Spark can split the join of a name that a third of the documents have.
    """
    each = named.select("doc_id", F.explode("names").alias("name"))
    often = each.groupBy("name").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    often = stored(often.withColumn("spread", F.ceil(F.col("often") / share)), "often")
    total = often.agg(F.sum("often")).first()[0] or 0
    found = each.join(often, "name").groupBy(F.col("doc_id").alias("s_doc"))
    return stored(found.agg(F.collect_set(F.struct("name", "spread")).alias("shared")), "shared"), total
