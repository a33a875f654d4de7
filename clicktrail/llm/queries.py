"""Imports every module that registers queries."""

from clicktrail.llm import (  # noqa: F401
    codes,
    decontamination,
    mixing,
    neighbours,
    periods,
    quality,
    rules,
    scoring,
    secrets,
    sharding,
    substrings,
    tokens,
    urls,
)
from clicktrail.llm.common import ORACLES, QUERIES  # noqa: F401
