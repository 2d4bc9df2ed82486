"""Searching texts that come in parts as if they were whole.

A text longer than one row comes as numbered parts, joined by blanks. Each part borrows the beginning of what follows
it, as long as the longest keyword or sentence, so that what crosses a border is found where it begins.

Hits of an alternation don't overlap, so where a part's first hit may begin depends on how far the last hit before it
reaches in. A part is therefore searched for every such reach at once; its result is a small table from the reach that
comes in to the reach that goes out. Behind a part where every reach ends, the next part begins anew; the few parts in
between are folded in order. No task sees more than one part's text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoglens.session import materialize

LEADING = 2
SCANNED = "found array<struct<reach:int,counts:map<string,bigint>,leading:array<string>>>"


def keyword_pattern(keywords: list[str]) -> str:
    return "|".join(re.escape(k).replace(r"\ ", " ") for k in keywords)


def occurrences(text: Column, keywords: list[str]) -> Column:
    return F.regexp_extract_all(text, F.lit(keyword_pattern(keywords)), F.lit(0))


def with_borrowed(parts: DataFrame, keys: list[str], text: str, chars: int) -> DataFrame:
    """Add `own`, the part's text with the blank behind it, and `head`, the `chars` characters that follow."""
    own = F.when(F.col("part") < F.col("parts"), F.concat(F.col(text), F.lit(" "))).otherwise(F.col(text))
    rows = parts.withColumn("own", own).withColumn("_begin", F.substring("own", 1, chars))
    # parts as long as what is borrowed, which is the rule, need their next neighbour alone
    shortest = rows.filter("part < parts").agg(F.min(F.length("own"))).first()[0] or chars
    ahead = Window.partitionBy(*keys).orderBy("part").rowsBetween(1, -(-chars // max(1, shortest)))
    borrowed = rows.select(*keys, "part", F.substring(F.array_join(F.collect_list("_begin").over(ahead), ""), 1, chars).alias("head"))
    return rows.drop("_begin").join(borrowed, [*keys, "part"])


def scan(own: str, head: str, pattern: re.Pattern, longest: int) -> list[tuple[int, dict[str, int], list[str]]]:
    """For each reach into the part: reach out of it, hits by keyword, and the first hits. Hits begin in `own`."""
    starts = [(m.start(), m.group(1)) for m in pattern.finditer(own + head, 0) if m.start() < len(own)]
    out = []
    for reach in range(longest):
        at, counts, leading = reach, Counter(), []
        for start, keyword in starts:
            if start >= at:
                at = start + len(keyword)
                counts[keyword] += 1
                if len(leading) < LEADING:
                    leading.append(keyword)
        out.append((max(0, at - len(own)), dict(counts), leading))
        if reach == 0 and not any(start < longest for start, _ in starts) and len(own) >= longest:
            # no hit begins where a reach could matter
            return out * longest
    return out


def scanned_parts(parts: DataFrame, keys: list[str], keywords: list[str]) -> DataFrame:
    """Parts with `own` and `head` to the results of `scan`, one entry for each reach."""
    pattern, longest = f"(?=({keyword_pattern(keywords)}))", max(map(len, keywords))
    names = [*keys, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(pattern)
        kind = pa.list_(pa.struct([("reach", pa.int32()), ("counts", pa.map_(pa.string(), pa.int64())), ("leading", pa.list_(pa.string()))]))
        for batch in batches:
            found = [
                [{"reach": r, "counts": list(c.items()), "leading": f} for r, c, f in scan(own, head, compiled, longest)]
                for own, head in zip(batch.column("own").to_pylist(), batch.column("head").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, kind)], names=[*names, "found"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*names).schema)
    return parts.select(*names, "own", "head").mapInArrow(run, f"{kinds}, {SCANNED}")


def with_reach(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Pick each part's result for the reach that the parts before it leave: `counts`, `leading`."""
    reaches = F.transform("found", lambda x: x["reach"])
    rows = scanned.select(*keys, "part", reaches.alias("reaches"))
    in_order = Window.partitionBy(*keys).orderBy("part")
    ended = F.forall(F.lag("reaches").over(in_order), lambda r: r == 0)
    begins = F.when(F.coalesce(ended, F.lit(True)), 1).otherwise(0)
    runs = rows.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(in_order))
    grouped = runs.groupBy(*keys, "_run").agg(F.sort_array(F.collect_list(F.struct("part", "reaches"))).alias("members"))
    folded = F.aggregate(
        "members",
        F.array(F.lit(0)),
        lambda states, m: F.concat(states, F.array(F.get(m["reaches"], F.element_at(states, F.lit(-1))))),
    )
    states = grouped.select(*keys, F.explode(F.arrays_zip(F.col("members.part").alias("part"), folded.alias("state"))).alias("s"))
    states = states.filter("s.part IS NOT NULL").select(*keys, "s.part", "s.state")
    chosen = F.get("found", "state")
    return scanned.join(states, [*keys, "part"]).select(*keys, "part", chosen["counts"].alias("counts"), chosen["leading"].alias("leading"))


def parted_hits(parts: DataFrame, keys: list[str], keywords: list[str], text: str) -> DataFrame:
    """`counts` (hits by keyword) and `leading` (first hits) of each part of texts with several parts."""
    several = parts.filter("parts > 1").dropDuplicates([*keys, "part"])
    borrowed = with_borrowed(several, keys, text, max(map(len, keywords)))
    return with_reach(materialize(scanned_parts(borrowed, keys, keywords), "scanned"), keys)


def keyword_counts(parts: DataFrame, keys: list[str], keywords: list[str], text: str) -> DataFrame:
    """`keyword, n` for every row of `parts`: as many hits as the whole texts have."""
    whole = parts.filter("parts = 1").select(F.explode(occurrences(F.col(text), keywords)).alias("keyword"), F.lit(1).cast("bigint").alias("n"))
    if parts.filter("parts > 1").isEmpty():
        return whole
    hits = parted_hits(parts, keys, keywords, text)
    rows = parts.filter("parts > 1").select(*keys, "part").join(hits, [*keys, "part"])
    return whole.unionByName(rows.select(F.explode("counts").alias("keyword", "n")))


def sentences(parts: DataFrame, keys: list[str], keywords: list[str], text: str, chars: int) -> DataFrame:
    """`hits` (the first hits of the whole text), `pos` and `sentence` for each sentence shorter than `chars`."""
    hits = F.slice(occurrences(F.col(text), keywords), 1, LEADING)
    whole = parts.filter("parts = 1").select(*keys, hits.alias("hits"), F.posexplode(F.split(text, "[.]")).alias("pos", "sentence"))
    whole = whole.withColumn("pos", F.col("pos").cast("bigint")).filter(F.length("sentence") < chars)
    if parts.filter("parts > 1").isEmpty():
        return whole
    found = parted_hits(parts, keys, keywords, text).filter(F.size("leading") > 0)
    first = Window.partitionBy(*keys).orderBy("part")
    few = found.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= LEADING)
    leading = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "leading"))).alias("l"))
    leading = leading.select(*keys, F.slice(F.flatten("l.leading"), 1, LEADING).alias("hits"))
    several = materialize(with_borrowed(parts.filter("parts > 1").dropDuplicates([*keys, "part"]), keys, text, chars), "borrowed")
    dots = F.length("own") - F.length(F.replace("own", F.lit("."), F.lit("")))
    counted = several.withColumn("_dots", dots.cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = counted.select(*keys, "part", F.coalesce(F.sum("_dots").over(before), F.lit(0)).alias("_before"))
    # what stands before a later part's first full stop belongs to a sentence begun earlier
    later = F.when(F.col("part") > 1, 1).otherwise(0)
    begun = F.slice(F.split(F.concat("own", "head"), "[.]"), later + 1, F.col("_dots").cast("int") + 1 - later)
    cut = counted.join(places, [*keys, "part"]).filter(F.col("_dots") + 1 > later)
    each = cut.select(*keys, (F.col("_before") + later).alias("_first"), F.posexplode(begun).alias("_k", "sentence"))
    each = each.filter(F.length("sentence") < chars).join(leading, keys)
    # a call that several rows name comes as often as they do
    times = parts.filter("parts > 1 AND part = 1").select(*keys)
    return whole.unionByName(times.join(each, keys).select(*keys, "hits", (F.col("_first") + F.col("_k")).alias("pos"), "sentence"))
