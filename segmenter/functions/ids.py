"""Client id normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.isspace() sees it (Unicode white space plus the
# four ASCII separators), hyphens and round brackets are removed.
_STRIP = r"(?U)[\s\x1c-\x1f\-()]"


def normalize_id(c: Column | str, phone_only: bool = False) -> Column:
    """Remove white space, ``-``, ``(`` and ``)``; a leading ``8`` becomes ``+7``.

    Default mode rewrites every id that starts with ``8`` (the reference's actual
    behaviour). ``phone_only=True`` rewrites only ids that then read as ``+7``
    followed by ten digits. Null stays null.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(c.cast("string"), _STRIP, "")
    rewritten = F.concat(F.lit("+7"), F.substring(s, 2, 1 << 30))
    cond = s.startswith("8")
    if phone_only:
        cond = s.rlike(r"^8[0-9]{10}$")
    return F.when(cond, rewritten).otherwise(s)
