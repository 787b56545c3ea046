"""Which of the published releases is newer and can be had."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from versemill.functions.cleaning import compare_versions

RELEASE = "tag_name string, body string, assets array<struct<name:string,browser_download_url:string,size:bigint>>"


def available(release: Column, current: Column, host: str = "https://github.com/") -> Column:
    """struct<tag, version, notes, size, url> of a release's JSON that is newer than `current` and has an .apk of the host, or null (FN-V2, FLT16, SRC12).

    The first fitting asset counts; unknown keys are ignored, text that is no JSON gives null.
    """
    r = F.from_json(release, RELEASE)
    asset = F.try_element_at(F.filter(r["assets"], lambda a: F.lower(a["name"]).endswith(".apk") & a["browser_download_url"].startswith(host)), F.lit(1))
    newer = (F.trim(r["tag_name"]) != "") & (compare_versions(r["tag_name"], current) > 0)
    found = F.struct(F.trim(r["tag_name"]).alias("tag"), F.regexp_replace(F.trim(r["tag_name"]), "^[vV]", "").alias("version"), F.coalesce(r["body"], F.lit("")).alias("notes"), asset["size"].alias("size"), asset["browser_download_url"].alias("url"))
    return F.when(newer & asset.isNotNull(), found)
