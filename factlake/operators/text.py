"""Texts as rows of lines, and what stands around a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each line: the kept columns, line_no from 1, and line. Trailing empty lines count; null has none."""
    return df.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select(*keep, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def digest(text: Column | str, hex_digits: int = 16) -> Column:
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, hex_digits)


def all_matches(text: Column | str, pattern: str, group: int = 0) -> Column:
    """Distinct matches in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def frame_text(by: list[str], order: list[str], column: str, before: int, after: int, sep: str = "\n") -> Column:
    """The rows from `before` rows earlier to `after` rows later, joined."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(-before, after)
    return F.array_join(F.collect_list(column).over(window), sep)


def nearest_preceding(value: Column, by: list[str], order: list[str]) -> Column:
    """The last value that isn't null up to and with this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def running_depth(step: Column, by: list[str], order: list[str]) -> Column:
    """Sum of +1 and -1 steps up to and with this row."""
    return F.sum(step).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def block_ends(df: DataFrame, by: list[str], line: str, depth: str, opens: Column) -> DataFrame:
    """(by, line, block_end) of rows where a block opens (depth counts the row itself): the first later row at which the
    depth is back below; the row itself if there is none. A block closes at the next row of the level it was opened from. Rows of
    a level are read from the last to the first, so that the frame grows from its start: one pass, where a frame that reaches to the
    end would be summed anew for each row."""
    level = F.when(opens, F.col(depth) - 1).otherwise(F.col(depth))
    marked = df.select(*by, line, level.alias("__level"), opens.alias("__opens"))
    after = Window.partitionBy(*by, "__level").orderBy(F.col(line).desc()).rowsBetween(Window.unboundedPreceding, -1)
    end = F.min(F.when(~F.col("__opens"), F.col(line))).over(after)
    return marked.withColumn("block_end", F.coalesce(end, F.col(line))).where("__opens").select(*by, line, "block_end")


def excerpt(text: Column | str, most: int, marker: str = "// ... cut") -> Column:
    """The first `most` lines, with a marker line if there were more."""
    parts = F.split(text, "\n", -1)
    head = F.array_join(F.slice(parts, 1, most), "\n")
    return F.when(F.size(parts) > most, F.concat(head, F.lit(f"\n{marker}"))).otherwise(head)


def split_outside(text: Column | str) -> Column:
    """Parts of a list text between commas that stand outside ( [ and <, trimmed, empty ones left out. A > lowers the depth
    wherever it stands."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, c: Column) -> Column:
        cut = (c == ",") & (state["depth"] <= 0)
        depth = state["depth"] + F.when(c.isin("(", "[", "<"), 1).when(c.isin(")", "]", ">"), -1).otherwise(0)
        return F.struct(
            depth.alias("depth"), F.when(cut, F.lit("")).otherwise(F.concat(state["part"], c)).alias("part"),
            F.when(cut, F.concat(state["parts"], F.array(state["part"]))).otherwise(state["parts"]).alias("parts"),
        )

    folded = F.aggregate(F.split(text, ""), start, step, lambda s: F.concat(s["parts"], F.array(s["part"])))
    return F.filter(F.transform(folded, lambda p: F.trim(p)), lambda p: p != "")
