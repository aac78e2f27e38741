"""Colours: the package's palette, ramps, parsing of names and hex codes."""

from __future__ import annotations

import re

# The palette's names and colours.
PALETTE = {
    "Red_CMYK": "#F52220",
    "Tangerine": "#E8801A",
    "Flax": "#E1DA8A",
    "Kelly_green": "#5EA530",
    "Brunswick_green": "#114232",
    "Keppel": "#2BB4A2",
    "Dark_slate_gray": "#115A5D",
    "Magenta_dye": "#B20F66",
    "Chocolate_cosmos": "#560F11",
    "Cornell_red": "#C0181A",
}
# Named colours in common use.
NAMED = {
    "black": "#000000", "white": "#FFFFFF", "red": "#FF0000", "green": "#00FF00", "blue": "#0000FF", "yellow": "#FFFF00", "cyan": "#00FFFF",
    "magenta": "#FF00FF", "orange": "#FFA500", "brown": "#A52A2A", "purple": "#A020F0", "darkgreen": "#006400", "darkblue": "#00008B", "grey": "#BEBEBE", "gray": "#BEBEBE",
}


def rgb(colour: str) -> tuple[int, int, int]:
    text = NAMED.get(colour.lower(), PALETTE.get(colour, colour))
    if not re.fullmatch(r"#[0-9A-Fa-f]{6}", text):
        raise ValueError(f"{colour!r} is neither a known name nor #RRGGBB")
    return int(text[1:3], 16), int(text[3:5], 16), int(text[5:7], 16)


def ramp(colours: list[str], n: int = 256) -> list[tuple[int, int, int]]:
    """``n`` colours evenly spaced from the first to the last, linear between neighbours in RGB."""
    if not colours:
        raise ValueError("a palette needs a colour")
    stops = [rgb(c) for c in colours]
    if len(stops) == 1:
        return stops * n
    out = []
    for i in range(n):
        at = i * (len(stops) - 1) / (n - 1)
        k = min(int(at), len(stops) - 2)
        out.append(tuple(int(a + (b - a) * (at - k) + 0.5) for a, b in zip(stops[k], stops[k + 1])))
    return out
