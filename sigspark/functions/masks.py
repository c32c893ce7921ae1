"""Masking of personal values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (leading characters kept, trailing characters kept) per kind.
KEPT = {
    "mobile": (3, 4), "name": (1, 0), "id_card": (6, 2), "bank_card": (6, 2),
    "plate": (3, 1), "phone": (4, 2), "password": (0, 0),
}
# E-mail pattern and its replacement.
EMAIL, EMAIL_OUT = r"(^.)[^@]*(@.*$)", "$1****$2"


def slider(c: Column, prefix: int = 0, suffix: int = 0, replacer: str = "*") -> Column:
    """Keep both ends and mask the middle; text not longer than the ends is masked whole."""
    n = F.length(c)
    middle = n - prefix - suffix
    kept = F.concat(
        F.substring(c, 1, prefix), F.repeat(F.lit(replacer), middle), F.substr(c, prefix + middle + 1, F.lit(suffix)),
    )
    return F.when(middle <= 0, F.repeat(F.lit(replacer), n)).otherwise(kept)


def preset(c: Column, kind: str) -> Column:
    return slider(c, *KEPT[kind])


def regex(c: Column, pattern: str, out: str) -> Column:
    return F.regexp_replace(c, pattern, out)


def email(c: Column) -> Column:
    return regex(c, EMAIL, EMAIL_OUT)
