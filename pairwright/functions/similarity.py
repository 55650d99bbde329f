"""Near-duplicate verdict for a pair of texts.

The ratio is Ratcliff-Obershelp as computed by the standard library; it has no SQL form.
Most pairs never reach Python: equal texts are decided as duplicates and pairs whose
lengths alone rule out the threshold are decided as different, both JVM-side.  Only
undecided pairs are handed to the Arrow UDF, the others travel as nulls.
"""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F

from pairwright.functions import text as T


def _verdict_udf(threshold: float):
    # self-contained, so that the workers need nothing but pandas
    @F.pandas_udf("boolean")
    def verdict(left: pd.Series, right: pd.Series) -> pd.Series:
        def reaches(a, b):
            if a is None or b is None:
                return None
            matcher = SequenceMatcher(None, a, b)
            # the first two are upper bounds of the third
            return (
                matcher.real_quick_ratio() >= threshold
                and matcher.quick_ratio() >= threshold
                and matcher.ratio() >= threshold
            )

        return pd.Series([reaches(a, b) for a, b in zip(left, right)], dtype="object")

    return verdict


def near_duplicate(left: Column, right: Column, threshold: float, where: Column | None = None) -> Column:
    """True where the similarity ratio of the stripped, lower-cased texts is at least ``threshold``.

    ``where`` limits the Python work to the rows that need a verdict; others get false.
    """
    a, b = F.lower(T.strip(left)), F.lower(T.strip(right))
    total = F.length(a) + F.length(b)
    equal = a == b
    bound = F.lit(2.0) * F.least(F.length(a), F.length(b)) / F.greatest(total, F.lit(1))
    undecided = ~equal & (bound >= F.lit(float(threshold)))
    needed = F.lit(True) if where is None else where
    udf = _verdict_udf(float(threshold))
    ask = needed & undecided
    answer = udf(F.when(ask, a), F.when(ask, b))
    return needed & ((equal & F.lit(threshold <= 1.0)) | F.coalesce(answer, F.lit(False)))
