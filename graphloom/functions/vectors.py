"""Vector functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def seeded_unit(dims: int):
    """A UDF: a Gaussian unit vector whose generator is seeded by the SHA-256 of the upper-case name, so that it is the same everywhere."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def unit(names: pd.Series) -> pd.Series:
        import hashlib
        import math
        import random

        def one(name: str) -> list[float]:
            r = random.Random(int(hashlib.sha256(name.upper().encode()).hexdigest(), 16) % 2**32)
            v = [r.gauss(0, 1) for _ in range(dims)]
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            return [x / n for x in v]

        return names.map(lambda n: None if n is None else one(n))

    return unit
