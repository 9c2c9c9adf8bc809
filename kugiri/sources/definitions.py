"""Readers of the small definition files of a dictionary: char.def, unk.def, matrix.def."""

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np

from kugiri.model import AnalysisError, ErrorKind

#: Cost of a pair of context ids that matrix.def doesn't name.
UNSET = 32767


class Categories:
    """Character categories: by name (invoke, group, length), and the categories of every character in file order."""

    def __init__(self, text: str):
        self.names: list[str] = []
        self.invoke: list[bool] = []
        self.group: list[bool] = []
        self.length: list[int] = []
        ranges: list[tuple[int, int, list[int]]] = []
        for n, line in enumerate(text.splitlines(), 1):
            parts = line.split("#", 1)[0].split()
            if not parts:
                continue
            if parts[0].startswith("0x"):
                low, high = self._range(parts[0], n)
                if len(parts) < 2:
                    raise AnalysisError(ErrorKind.CONTENT, f"char.def line {n}: no category")
                ranges.append((low, high, [self._known(p, n) for p in parts[1:]]))
            else:
                if len(parts) != 4 or not parts[3].isdecimal():
                    raise AnalysisError(ErrorKind.CONTENT, f"char.def line {n}: a category has a name and three numbers")
                if parts[0] in self.names:
                    raise AnalysisError(ErrorKind.CONTENT, f"char.def line {n}: {parts[0]} is defined twice")
                self.names.append(parts[0])
                self.invoke.append(parts[1] == "1")
                self.group.append(parts[2] == "1")
                self.length.append(int(parts[3]))
        if "DEFAULT" not in self.names:
            raise AnalysisError(ErrorKind.CONTENT, "char.def: no DEFAULT")
        # elementary intervals, each with its categories
        edges = sorted({0, *(r[0] for r in ranges), *(r[1] + 1 for r in ranges)})
        self.edges, self.by_edge = edges, []
        default = (self.names.index("DEFAULT"),)
        for e in edges:
            own = dict.fromkeys(c for low, high, cs in ranges if low <= e <= high for c in cs)
            self.by_edge.append(tuple(own) or default)
        self.space = self.names.index("SPACE") if "SPACE" in self.names else None

    def _known(self, name: str, n: int) -> int:
        if name not in self.names:
            raise AnalysisError(ErrorKind.CONTENT, f"char.def line {n}: {name} is used before it is defined")
        return self.names.index(name)

    @staticmethod
    def _range(text: str, n: int) -> tuple[int, int]:
        m = re.fullmatch(r"0x([0-9A-Fa-f]{1,4})(?:\.\.0x([0-9A-Fa-f]{1,4}))?", text)
        if not m:
            raise AnalysisError(ErrorKind.PARSE, f"char.def line {n}: bad code points {text}")
        low = int(m[1], 16)
        high = int(m[2], 16) if m[2] else low
        if high < low:
            raise AnalysisError(ErrorKind.CONTENT, f"char.def line {n}: empty range {text}")
        return low, high

    def of(self, c: str) -> tuple[int, ...]:
        return self.by_edge[bisect_right(self.edges, ord(c)) - 1]

    def rows(self) -> list[tuple[int, int, list[str]]]:
        """Interval table (low, high, categories) for joins."""
        highs = [e - 1 for e in self.edges[1:]] + [0x10FFFF]
        return [(low, high, [self.names[c] for c in own]) for low, high, own in zip(self.edges, highs, self.by_edge)]


def parse_unknown(text: str) -> list[tuple[str, int, int, int, list[str]]]:
    """Rows of unk.def: category, left id, right id, cost, details. Fields are split at commas, without quoting."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        parts = line.split(",")
        if len(parts) < 4:
            raise AnalysisError(ErrorKind.CONTENT, f"unk.def line {n}: under four fields")
        try:
            left, right, cost = int(parts[1]), int(parts[2]), int(parts[3])
        except ValueError as e:
            raise AnalysisError(ErrorKind.PARSE, f"unk.def line {n}: {e}") from e
        out.append((parts[0], left, right, cost, parts[4:]))
    return out


def parse_matrix(text: str) -> np.ndarray:
    """Connection costs, indexed [left id of the right word, right id of the left word]; the last of equal lines counts."""
    lines = text.splitlines()
    head = next((i for i, x in enumerate(lines) if x.strip()), None)
    if head is None:
        raise AnalysisError(ErrorKind.CONTENT, "matrix.def is empty")
    try:
        forward, backward = map(int, lines[head].split())
        cells = np.array([x.split() for x in lines[head + 1 :] if x.strip()], dtype=np.int64).reshape(-1, 3)
    except ValueError as e:
        raise AnalysisError(ErrorKind.PARSE, f"matrix.def: {e}") from e
    out = np.full((backward, forward), UNSET, np.int16)
    f, b, cost = cells.T
    if len(cells) and (f.min() < 0 or b.min() < 0 or f.max() >= forward or b.max() >= backward):
        raise AnalysisError(ErrorKind.CONTENT, "matrix.def: an id is out of range")
    # numpy leaves open which of equal targets wins: keep the last line of each
    cell = b * forward + f
    _, last = np.unique(cell[::-1], return_index=True)
    keep = len(cell) - 1 - last
    out[b[keep], f[keep]] = (cost[keep] & 0xFFFF).astype(np.uint16).view(np.int16)
    return out


def matrix_text(matrix: np.ndarray) -> str:
    backward, forward = matrix.shape
    out = [f"{forward} {backward}"]
    for b in range(backward):
        row = matrix[b].tolist()
        out += [f"{f} {b} {row[f]}" for f in range(forward)]
    return "\n".join(out) + "\n"


@lru_cache(8)
def categories(text: str) -> Categories:
    return Categories(text)
