"""What becomes of the entries of archives, nested ones included, over a table of entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Saved, scope

#: Levels of archives that are opened, and entries of an archive. Fixed values.
DEPTH, ENTRIES = 2, 50_000


def is_junk(path: Column) -> Column:
    """Entries of the system, and files whose name begins with a point or is empty."""
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return path.contains("__MACOSX/") | name.startswith(".") | (name == "")


def expanded(archives: DataFrame, entries: DataFrame, known: DataFrame, depth: int = DEPTH, most: int = ENTRIES) -> DataFrame:
    """(root, owner, archive, place, path, level, outcome): what becomes of each
    entry reached from ``archives`` (archive, owner) (S18).

    ``entries``: (archive, place, path, hash, nested), ``nested`` the archive
    that the entry is, or null; ``known``: (owner, hash) of documents already
    there. An archive nested ``depth`` levels deep isn't opened ("too deep"; its
    entry stays registered), nor one of more than ``most`` entries ("too many"):
    both have one row with a null place, and nothing of what is in them is
    reached. Of the others' entries junk is "skipped"; what has the hash of an
    earlier entry of its archive, or of a known document of its owner, is a
    "duplicate"; the rest is "registered", and if it is an archive, opened a
    level deeper. A missing or empty hash is no duplicate of anything.

    Level by level; a level shuffles only the entries of the archives it opens.
    """
    with scope() as tables:
        entries = entries.select("archive", "place", "path", F.nullif("hash", F.lit("")).alias("hash"), "nested")
        open_ = archives.where("archive IS NOT NULL").select(F.col("archive").alias("root"), "owner", "archive").distinct()
        there = known.where("hash IS NOT NULL AND hash <> ''").select(F.col("owner").alias("o"), F.col("hash").alias("h")).distinct()
        sizes = entries.groupBy("archive").agg(F.count("*").alias("size"))
        columns, done = ["root", "owner", "archive", "place", "path", "level", "outcome"], []
        for level in range(depth + 1):
            open_ = Saved(open_, "archives-open").df
            if not open_.head(1):
                break
            none = {"place": F.lit(None).cast(entries.schema["place"].dataType), "path": F.lit(None).cast("string"), "level": F.lit(level)}
            if level == depth:
                done.append(open_.withColumns({**none, "outcome": F.lit("too deep")}).select(*columns))
                break
            sized = open_.join(sizes, "archive", "left")
            done.append(sized.where(F.col("size") > most).withColumns({**none, "outcome": F.lit("too many")}).select(*columns))
            found = sized.where(F.col("size") <= most).join(entries, "archive").withColumn("junk", F.coalesce(is_junk(F.col("path")), F.lit(True)))
            nth = F.row_number().over(Window.partitionBy("root", "archive", "hash", "junk").orderBy("place", "path"))
            found = found.withColumn("again", F.col("hash").isNotNull() & (nth > 1)).join(there, F.col("owner").eqNullSafe(F.col("o")) & (F.col("hash") == F.col("h")), "left")
            outcome = F.when(F.col("junk"), "skipped").when(F.col("again") | F.col("h").isNotNull(), "duplicate").otherwise("registered")
            found = Saved(found.select("root", "owner", "archive", "place", "path", F.lit(level).alias("level"), outcome.alias("outcome"), "nested"), "archives-found").df
            done.append(found.select(*columns))
            open_ = found.where("outcome = 'registered' AND nested IS NOT NULL").select("root", "owner", F.col("nested").alias("archive")).distinct()
        whole = reduce(DataFrame.unionByName, done) if done else open_.withColumns({"place": F.lit(None).cast(entries.schema["place"].dataType), "path": F.lit(None).cast("string"), "level": F.lit(0), "outcome": F.lit("")}).select(*columns)
        return tables.keep(Saved(whole, "archives"))
