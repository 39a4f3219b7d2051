"""Number-to-text labels, as SQL text. A NULL number gives a NULL label unless told otherwise."""

from __future__ import annotations

from rosterfold.functions.columns import literal


def number_text(x: str, digits: int = 1) -> str:
    """Shortest text with at most ``digits`` decimals: ``12``, ``12.3``, never ``-0``."""
    rounded = f"round({x}, {digits})"
    pattern = "0" if digits == 0 else "0." + "#" * digits
    return f"format_number(IF({rounded} = 0, 0.0D, {rounded}), '{pattern}')"


def signed_label(x: str, suffix: str, digits: int = 1, na_text: str | None = None) -> str:
    """``+12.3<suffix>`` / ``-4<suffix>``; zero counts as positive."""
    sign = f"IF(round({x}, {digits}) >= 0, '+', '')"
    label = f"concat({sign}, {number_text(x, digits)}, {literal(suffix)})"
    return label if na_text is None else f"coalesce({label}, {literal(na_text + suffix)})"


def amount_text(x: str) -> str:
    """``1,235``, rounded half-even to whole units, never ``-0``."""
    text = f"format_number({x}, 0)"
    return f"IF({text} = '-0', '0', {text})"


def money_label(x: str, width: str | None = None) -> str:
    """``$1,235``; ``width`` right-aligns the amount."""
    amount = amount_text(x)
    if width is not None:
        amount = f"lpad({amount}, greatest({width}, length({amount})), ' ')"
    return f"concat('$', {amount})"


def count_pct_label(n: str, total: str) -> str:
    """``7 (25.0%)``, the percentage rounded half-even to one decimal."""
    share = f"format_number(try_divide(100.0D * {n}, {total}), '0.0')"
    return f"concat(CAST({n} AS STRING), ' (', coalesce({share}, '-'), '%)')"
