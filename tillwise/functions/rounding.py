"""The two rounding rules reports use, defined on doubles, as SQL text.

Both scale, round and unscale, so they look at the stored double. Spark's own
``round``/``bround`` look at its shortest decimal text instead and would lift
4.725 (stored just below the tie) to 4.73.
"""

from __future__ import annotations


def half_even(value: str, digits: int) -> str:
    """Round to ``digits`` places, ties to the even neighbour (data-frame reports)."""
    scale = f"{10**digits}D"
    return f"(rint(({value}) * {scale}) / {scale})"


def half_up(value: str, digits: int) -> str:
    """Round to ``digits`` places, ties away from zero (SQL reports)."""
    scale = f"{10**digits}D"
    size = f"abs({value}) * {scale}"
    nearest = f"rint({size})"
    return (
        f"(signum({value}) * if({size} - {nearest} = 0.5D, {nearest} + 1D, {nearest}) / {scale})"
    )
