"""Names, files and ids for layers that move into a document: later names depend on earlier ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def highest_suffix(taken_files: DataFrame) -> DataFrame:
    """(document, highest): the greatest N of the files layerN of each document."""
    number = F.try_to_number(F.regexp_extract("file", "^layer([0-9]+)$", 1), F.lit("9" * 18))
    return taken_files.groupBy("document").agg(F.max(number).cast("long").alias("highest"))


def renumbered(layers: DataFrame, taken_files: DataFrame) -> DataFrame:
    """`layers` (document, pos, ...) with new_file: layerN from above the highest number of the document's files (document, file) on."""
    nth = F.row_number().over(Window.partitionBy("document").orderBy("pos"))
    numbered = layers.withColumn("__nth", nth).join(highest_suffix(taken_files), "document", "left")
    return numbered.withColumn("new_file", F.concat(F.lit("layer"), (F.coalesce("highest", F.lit(0)) + F.col("__nth")).cast("string"))).drop("__nth", "highest")


def renamed(layers: DataFrame, taken_names: DataFrame) -> DataFrame:
    """(document, pos, name, new_name) of layers in order of pos: a name that is taken gets the first free number from 2 on.

    `taken_names` are the target's (document, name); a name once given is taken for the layers after it. A document is one group.
    """
    incoming = layers.select("document", "pos", "name").groupBy("document")
    return incoming.cogroup(taken_names.select("document", "name").groupBy("document")).applyInPandas(_renamed, "document long, pos long, name string, new_name string")


def _renamed(rows: pd.DataFrame, target: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("pos")
    taken = set(target["name"].tolist())
    after: dict[str, int] = {}  # by name: the first number that may be free
    names = []
    for name in rows["name"].tolist():
        new = name
        if new in taken:
            k = after.get(name, 2)
            while (new := f"{name} [{k}]") in taken:
                k += 1
            after[name] = k
        taken.add(new)
        names.append(new)
    text = {"name": rows["name"].tolist(), "new_name": names}
    return pd.DataFrame({"document": rows["document"].tolist(), "pos": rows["pos"].tolist(), **{k: pd.Series(v, dtype=object) for k, v in text.items()}})
