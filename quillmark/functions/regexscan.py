"""Regular-expression matches with their places, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def located(text: Column, pattern: str) -> Column:
    """array<struct<k, start_pos, end_pos, hit>>: all matches, numbered from 1,
    places in characters from 1, inclusive.

    A match's place follows from the lengths of the gaps and matches before it;
    the pattern must not match the empty string.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))
    empty = F.from_json(F.lit("[]"), "array<struct<k:int,start_pos:int,end_pos:int,hit:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(a: Column, p: Column) -> Column:
        size = F.length(p["h"])
        item = F.struct((F.size(a["found"]) + 1).alias("k"), (a["at"] + p["g"] + 1).alias("start_pos"), (a["at"] + p["g"] + size).alias("end_pos"), p["h"].alias("hit"))
        return F.struct((a["at"] + p["g"] + F.coalesce(size, F.lit(0))).alias("at"), F.when(p["h"].isNull(), a["found"]).otherwise(F.array_append(a["found"], item)).alias("found"))

    return F.aggregate(parts, start, step)["found"]
