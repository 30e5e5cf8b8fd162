"""The registered queries of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import gazetteer, history, languages, linkage, lookalikes, mixing, mojibake, packing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": history.p2_found,
        "p3_found": mojibake.p3_found,
        "p4_found": lookalikes.p4_found,
        "p5_found": gazetteer.p5_found,
        "p7_found": linkage.p7_found,
        "p7_matches": linkage.p7_matches,
        "p7_calibration": linkage.p7_calibration,
        "p8_containers": packing.p8_containers,
        "p8_fill": packing.p8_fill,
        "p9_mix": mixing.p9_mix,
        "p9_shares": mixing.p9_shares,
        "p9_shares_all": mixing.p9_shares_all,
        "p9_shares_even": mixing.p9_shares_even,
        "p10_found": languages.p10_found,
        "p10_languages": languages.p10_languages,
    }


def oracle_sql() -> dict[str, str]:
    return {}
