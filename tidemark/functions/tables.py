"""Small results as text tables."""

from __future__ import annotations

from collections.abc import Iterable


def cut_to(text: str, width: int) -> str:
    """A text in at most `width` signs; a longer one ends in three dots."""
    return text if len(text) <= width else text[: max(width - 3, 0)] + "..."[:width]


def plain(header: list[str], rows: Iterable[Iterable], width: int = 60) -> str:
    """Columns side by side under their names."""
    cells = [[cut_to("" if v is None else str(v), width) for v in r] for r in rows]
    sizes = [max([len(h), *(len(r[i]) for r in cells)]) for i, h in enumerate(header)]
    line = lambda r: " | ".join(v.ljust(s) for v, s in zip(r, sizes)).rstrip()
    return "\n".join([line(header), "-+-".join("-" * s for s in sizes), *map(line, cells)])


def rst(header: list[str], rows: Iterable[Iterable], width: int = 60) -> str:
    """The same as a simple table of reStructuredText."""
    cells = [[cut_to("" if v is None else str(v), width) for v in r] for r in rows]
    sizes = [max([len(h), *(len(r[i]) for r in cells)]) for i, h in enumerate(header)]
    rule = "  ".join("=" * s for s in sizes)
    line = lambda r: "  ".join(v.ljust(s) for v, s in zip(r, sizes)).rstrip()
    return "\n".join([rule, line(header), rule, *map(line, cells), rule])
