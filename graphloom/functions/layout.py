"""Layout metrics of source text, as SQL expressions."""

from __future__ import annotations


def layout_expressions(text: str) -> list[tuple[tuple[str, ...], str]]:
    """(names, expression) of each metric; 0 where there is no text."""
    lines = f"filter(split(coalesce({text}, ''), '\\n'), x -> trim(x) <> '')"
    return [
        (("line_of_code", "loc"), f"size({lines})"),
        (("char_of_code", "choc"), f"length(coalesce({text}, ''))"),
        (("max_length_of_line",), f"coalesce(array_max(transform({lines}, x -> length(x))), 0)"),
        (("average_length_of_line", "avg_length_of_line"), f"coalesce(cast(floor(aggregate({lines}, 0, (a, x) -> a + length(x)) / nullif(size({lines}), 0)) as int), 0)"),
        (("no_space_after_comma",), f"regexp_count(coalesce({text}, ''), ',[^ \\\\n]')"),
    ]
