"""What kind of page came back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CHALLENGES = ("just a moment", "captcha", "access denied", "are you a robot", "unusual traffic", "verify you are human", "attention required", "checking your browser", "enable javascript", "request blocked", "403 forbidden", "pardon our interruption")


def is_challenge(title: Column, body: Column) -> Column:
    """Whether a page is a bot check rather than the page asked for."""
    said = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.left(F.coalesce(body, F.lit("")), F.lit(2000))))
    return said.rlike("|".join(CHALLENGES))
