"""Review packs as Markdown, one row of text for each pack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.operators.sequence import packs


def rendered(units: DataFrame, titles: DataFrame, notes: DataFrame, status: DataFrame) -> DataFrame:
    """(pack_id, text): a heading and a section for each unit, with what the optional notes (id, note) add (JN12, SNK5, SO8).

    Blank fields and missing notes leave no line; a pack without a status is pending.
    """
    numbered = packs(units).select("id", "pack", "pack_id")
    line = lambda name, c: F.when(F.trim(c) != "", F.concat(F.lit(f"**{name}:** "), c))
    some = notes.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.left("note", F.lit(220)))), "\n\n").alias("note"))
    rows = units.join(numbered, "id").join(some, "id", "left")
    speaker = F.when(F.col("speaker").isNotNull(), F.concat(F.lit(" ("), "speaker", F.lit(")"))).otherwise("")
    body = F.concat_ws("\n\n", F.concat(F.lit("## "), "id", speaker), line("Sanskrit", F.col("devanagari")), line("IAST", F.col("iast")), line("Meaning", F.col("meaning")), line("Takeaway", F.col("takeaway")), "note")
    grouped = rows.groupBy("pack_id", "ch", "pack").agg(F.array_sort(F.collect_list(F.struct("n", body.alias("body"), "id"))).alias("all"))
    grouped = grouped.join(titles.select("ch", "title"), "ch", "left").join(status.select("pack_id", "status"), "pack_id", "left")
    first, last = F.try_element_at("all", F.lit(1))["id"], F.try_element_at("all", F.lit(-1))["id"]
    head = F.concat(F.lit("# Pack "), "pack_id", F.lit(": "), F.coalesce("title", F.lit("")), F.lit("\n\nVerses "), first, F.lit("–"), last, F.lit(" · Status: **"), F.coalesce("status", F.lit("pending")), F.lit("**"))
    return grouped.select("pack_id", F.concat_ws("\n\n", head, F.array_join(F.transform("all", lambda x: x["body"]), "\n\n")).alias("text"))
