"""Writers: card decks, indexes, run state."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deck_rows(cards: DataFrame) -> DataFrame:
    """The lines of a TSV deck: front, back, tags; no tabs or line ends inside."""
    plain = lambda c: F.regexp_replace(c, r"[\t\r\n]+", " ")
    return cards.select(F.concat_ws("\t", plain("front_html"), plain("back_html"), plain("tags")).alias("value"))


def write_deck(cards: DataFrame, path: str) -> None:
    cards.sparkSession.createDataFrame([("#Front\tBack\tTags",)], "value string").unionByName(deck_rows(cards)).coalesce(1).write.mode("overwrite").text(path)


def upsert_index(index: DataFrame, rows: DataFrame, key: str = "file_name") -> DataFrame:
    """index with the rows whose key it doesn't hold yet."""
    return index.unionByName(rows.join(index.select(key), key, "left_anti").select(*index.columns))


def write_state(state: DataFrame, root: str, run_id: str) -> None:
    """The latest state replaces the last; each run's rows are kept by run."""
    state.write.mode("overwrite").parquet(f"{root}/state")
    state.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{root}/runs")


def replace_file(path: str, text: str) -> None:
    """A local file replaced as a whole: readers see the old or the new text."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise
