"""The operators of this subpackage as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, ann, lines, media, mixing, near, packing, quality, secrets, suffix, urls, warc, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": media.op1_media_columns,
    "op2_quality": quality.op2_quality,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_packing": packing.op4_packing,
    "op5_ann_search": ann.op5_ann_search,
    "op6_suffix_dedup": suffix.op6_suffix_dedup,
    "op7_warc": warc.op7_warc,
    "op8_line_dedup": lines.op8_line_dedup,
    "op8_line_dedup_all": lines.op8_line_dedup_all,
    "op8_line_dedup_floor": lines.op8_line_dedup_floor,
    "op9_near_dedup": near.op9_near_dedup,
    "op10_poisson_mixing": mixing.op10_poisson_mixing,
    "op11_url_filter": urls.op11_url_filter,
    "op12_whitening": whiten.op12_whitening,
    "op13_token_alignment": align.op13_token_alignment,
}
SQL: dict[str, str] = {"op7_warc": warc.OP7_SQL, "op8_line_dedup": lines.OP8_SQL, "op8_line_dedup_all": lines.OP8_ALL_SQL, "op8_line_dedup_floor": lines.OP8_FLOOR_SQL, "op10_poisson_mixing": mixing.OP10_SQL, "op11_url_filter": urls.OP11_SQL}
