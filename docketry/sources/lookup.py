"""Look-ups of case records outside the tables, with a cache that keeps misses too.

A fetcher is any function from (volume, reporter, page) to a record as JSON text, or None.
It runs on the executors over distinct keys that the cache has not; what it answers,
misses included, is appended to the cache, so no key is asked for twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.resolve import KEY, keys_of

ANSWERS = "volume string, reporter string, page string, found boolean, record string"


def prefetch(cites: DataFrame, cache: DataFrame | None, fetch: Callable[[str, str, str], str | None]) -> DataFrame:
    """Answers for the citations' keys that the cache has none for. `found` counts give the
    number of new records."""
    wanted = keys_of(cites)
    if cache is not None:
        wanted = wanted.join(cache.select(*KEY), list(KEY), "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = [fetch(*key) for key in batch[list(KEY)].itertuples(index=False)]
            yield batch.assign(found=[r is not None for r in records], record=records)[[c.split()[0] for c in ANSWERS.split(", ")]]

    return wanted.mapInPandas(run, ANSWERS)


def records_of(cache: DataFrame) -> DataFrame:
    """Cached answers as records for resolve.resolve: name, cluster, citations, first page."""
    schema = "struct<caseName:string,citation:array<string>,cluster_id:bigint,absolute_url:string>"
    from docketry.functions.names import first_page_in

    made = cache.where("found").select(*KEY, F.from_json("record", schema).alias("_r"))
    record = F.struct(F.col("_r.caseName").alias("case_name"), F.col("_r.cluster_id").alias("cluster_id"), F.col("_r.citation").alias("citation"))
    return made.select(*KEY, record.alias("record"), first_page_in(F.col("_r.citation"), F.col("reporter")).try_cast("int").alias("start_page"))


def opinions_of(clusters: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """Bodies of opinions by URL id: cluster_id, seq, opinion_id, body. clusters: cluster_id,
    urls (array)."""
    from docketry.functions.names import opinion_id

    rows = clusters.select("cluster_id", F.posexplode("urls").alias("seq", "url")).select("cluster_id", "seq", opinion_id(F.col("url")).alias("opinion_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(body=[fetch(x) for x in batch["opinion_id"]])

    return rows.mapInPandas(run, "cluster_id bigint, seq int, opinion_id string, body string")
