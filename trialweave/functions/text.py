"""Plain words for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_text(seconds: float) -> str:
    """A duration by its two largest units: ``1d 4h``, ``12min``, ``3s``."""
    left, out = int(abs(seconds)), []
    for name, size in (("w", 604800), ("d", 86400), ("h", 3600), ("min", 60), ("s", 1)):
        if left >= size:
            out.append(f"{left // size}{name}")
            left %= size
    return ("-" if seconds < 0 and out else "") + (" ".join(out[:2]) or "0s")


def gate_text(arms: int) -> Column:
    """A sample-ratio gate in words; with three arms or more it names the oddest."""
    odd = F.concat(F.lit("; most off: "), F.col("culprit")) if arms > 2 else F.lit("")
    line = F.concat(F.format_string("%s (p = %.4f)", F.when(F.col("srm_flag"), "ratio mismatch").otherwise("ratio as planned"), F.col("srm_pvalue")), F.when(F.col("srm_flag"), odd).otherwise(""))
    return F.coalesce(line, F.lit("no units"))
