"""Listed names inside texts, as whole symbols.

Lists of any size give the same matches: a list of more than ``PART`` names is searched part by part, and the matches of
the parts are put together by the rule that one part follows too (leftmost first, then longest, none overlapping).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

#: Names in one automaton.
PART = 100_000


def lexicon(*columns: DataFrame) -> list[str]:
    """The different names of one-column frames, sorted. They are those of the reference list, which every worker gets."""
    names = columns[0]
    for more in columns[1:]:
        names = names.union(more)
    return sorted(r[0] for r in names.where(F.col(names.columns[0]).isNotNull()).distinct().toLocalIterator())


class Finder:
    """Matches of names in a text, leftmost and longest, without overlap."""

    def __init__(self, names: Iterable[str], part: int = PART):
        import ahocorasick

        listed = sorted(set(names) - {""})
        self.machines = []
        for low in range(0, len(listed), part):
            machine = ahocorasick.Automaton()
            for name in listed[low : low + part]:
                machine.add_word(name, len(name))
            machine.make_automaton()
            self.machines.append(machine)

    def __bool__(self) -> bool:
        return bool(self.machines)

    def __call__(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, stop) of each match."""
        if len(self.machines) == 1:
            for end, size in self.machines[0].iter_long(text):
                yield end - size + 1, end + 1
            return
        longest: dict[int, int] = {}
        for machine in self.machines:
            for end, size in machine.iter(text):
                start = end - size + 1
                longest[start] = max(longest.get(start, 0), end + 1)
        free = 0
        for start in sorted(longest):
            if start >= free:
                free = longest[start]
                yield start, free
