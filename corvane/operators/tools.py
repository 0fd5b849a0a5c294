"""The structured tool: requests for a desk's exposure, their results, and these as documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import filters as P

TOOL = "monitor_desk_exposure"


def mock_exposure(desk, as_of, limit) -> dict[str, Column]:
    """A deterministic stand-in exposure: sign and size from the first eight hex digits of a hash."""
    digest = F.sha1(F.concat_ws("|", desk, as_of, limit).cast("binary"))
    seed = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    total = F.when(seed % 2 == 0, 1).otherwise(-1) * (seed % 900000 + 50000)
    return {"total_delta": total.cast("double"), "breach": F.abs(total) > limit.cast("double")}


def _mocked(requests: DataFrame) -> DataFrame:
    made = mock_exposure(F.col("desk"), F.col("as_of"), F.col("abs_limit").cast("string"))
    return requests.withColumns(made)


def exposure_tool(questions: DataFrame, question: str, today: Column | None = None, tool: Callable[[DataFrame], DataFrame] = _mocked) -> DataFrame:
    """``questions`` that name a desk and a limit, with the tool's result.

    ``tool`` adds ``total_delta`` and ``breach`` to rows of (desk, abs_limit, as_of); rows it gives no result for fail
    with the category ``tool_error``.  The result is also told as a document with an identifier of its own.
    """
    asked = questions.withColumns(P.exposure_request(F.col(question), today)).where("desk is not null")
    rows = tool(asked).withColumn("failure", F.when(F.col("total_delta").isNull(), "tool_error"))
    told = F.format_string(
        "Tool result for desk %s as of %s. Total delta is %.2f. Absolute delta limit is %.2f. Limit breach is %s.",
        F.col("desk"), F.col("as_of"), F.col("total_delta"), F.col("abs_limit"), F.when(F.col("breach"), "yes").otherwise("no"),
    )
    return rows.withColumn("chunk_id", F.concat_ws(":", F.lit("tool"), F.lit(TOOL), "desk", "as_of")).withColumn("document", F.when(F.col("failure").isNull(), told))
