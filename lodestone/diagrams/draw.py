"""Drawing of layered graphs as text.

All is worked out in two axes, ``across`` a layer and ``along`` the layers, and turned at the end for horizontal diagrams.
Outgoing lines of a gap stand on even places across, incoming ones on odd places, so two lines never share a place and every cell holds
one line, or two that cross.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from .graph import Graph, Layered, layered

UP, DOWN, LEFT, RIGHT = 1, 2, 4, 8


@dataclass(frozen=True)
class Preferences:
    """How to draw: character set, direction, and whether to straighten and to share rows."""

    unicode: bool = True
    rounded: bool = False
    double: bool = False
    vertical: bool = True
    straighten: bool = True
    compact: bool = True
    padding: int = 1
    gap: int = 3


_UNICODE = {UP | DOWN: "│", LEFT | RIGHT: "─", DOWN | RIGHT: "┌", DOWN | LEFT: "┐", UP | RIGHT: "└", UP | LEFT: "┘", 15: "┼"}
_ROUND = {**_UNICODE, DOWN | RIGHT: "╭", DOWN | LEFT: "╮", UP | RIGHT: "╰", UP | LEFT: "╯"}
_DOUBLE = {UP | DOWN: "║", LEFT | RIGHT: "═", DOWN | RIGHT: "╔", DOWN | LEFT: "╗", UP | RIGHT: "╚", UP | LEFT: "╝"}
_ASCII = {UP | DOWN: "|", LEFT | RIGHT: "-", DOWN | RIGHT: "+", DOWN | LEFT: "+", UP | RIGHT: "+", UP | LEFT: "+", 15: "+"}
_ARROW = {True: {UP: "▲", DOWN: "▼", LEFT: "◄", RIGHT: "►"}, False: {UP: "^", DOWN: "v", LEFT: "<", RIGHT: ">"}}
_TURNED = {UP: LEFT, LEFT: UP, DOWN: RIGHT, RIGHT: DOWN}


def _turn(bits: int) -> int:
    return sum(_TURNED[b] for b in (UP, DOWN, LEFT, RIGHT) if bits & b)


def render(g: Graph, prefs: Preferences = Preferences()) -> str:  # noqa: B008
    """The graph as text; parsing it gives the graph back."""
    if not g.vertices:
        return ""
    return _Drawing(layered(g), prefs).text()


class _Drawing:
    def __init__(self, x: Layered, prefs: Preferences):
        self.x, self.prefs = x, prefs
        self.lines: dict[tuple[int, int], int] = {}  # (across, along) → directions
        self.arrows: dict[tuple[int, int], int] = {}
        self.boxes: list[tuple[int, int, int, int, str]] = []
        self._ports()
        self._sizes()
        self._places()
        self._route()

    # Links of each gap: (upper node, lower node, chain, index of the link in its chain)
    def _ports(self) -> None:
        at = {v: k for layer in self.x.layers for k, v in enumerate(layer)}
        self.out, self.into = defaultdict(list), defaultdict(list)
        for c, (chain, _) in enumerate(self.x.chains):
            for i in range(len(chain) - 1):
                self.out[chain[i]].append((at[chain[i + 1]], c, i))
                self.into[chain[i + 1]].append((at[chain[i]], c, i))
        for side in (self.out, self.into):
            for links in side.values():
                links.sort()

    def _extent(self, v: int) -> tuple[int, int]:
        """Size (across, along) of a node."""
        if self.x.label[v] is None:
            return 2, 1
        text = self.x.label[v].split("\n")
        wide, high = max(map(len, text)) + 2 + 2 * self.prefs.padding, len(text) + 2
        across, along = (wide, high) if self.prefs.vertical else (high, wide)
        loops = self.x.loops[v]
        need = 2 * max(len(self.out[v]), len(self.into[v])) + 3
        return max(across, need), max(along, 3 * loops + 2 if loops else 0)

    def _sizes(self) -> None:
        self.size = {v: self._extent(v) for v in self.x.label}

    def _places(self) -> None:
        """Across: side by side with gaps (and room for loops), layers centred. Begins are even."""
        self.begin: dict[int, int] = {}
        widths = []
        for layer in self.x.layers:
            at = 0
            for v in layer:
                self.begin[v] = at
                at += self.size[v][0] + self.prefs.gap + 2 * self.x.loops[v]
                at += at % 2
            widths.append(at)
        most = max(widths)
        for layer, w in zip(self.x.layers, widths, strict=True):
            shift = (most - w) // 2
            shift -= shift % 2
            for v in layer:
                self.begin[v] += shift

    def _port(self, v: int, k: int, n: int, odd: int) -> int:
        """Place of the k-th of n lines on a side: spread over the box, of the side's parity."""
        a, w = self.begin[v], self.size[v][0]
        if self.x.label[v] is None:
            return a + odd
        room = (w - 1) // 2 if odd else (w - 2) // 2
        return a + 2 - odd + 2 * ((2 * k + 1) * room // (2 * n))

    def _line(self, path: list[tuple[int, int]]) -> None:
        """Draw straight pieces between corners; inner cells get both directions, ends one."""
        cells = [path[0]]
        for (a, b), (c, d) in zip(path, path[1:], strict=False):
            da, db = (c > a) - (c < a), (d > b) - (d < b)
            while (a, b) != (c, d):
                a, b = a + da, b + db
                cells.append((a, b))
        way = {(0, 1): DOWN, (0, -1): UP, (1, 0): RIGHT, (-1, 0): LEFT}
        for i, cell in enumerate(cells):
            bits = 0
            if i:
                p = cells[i - 1]
                bits |= way[(p[0] - cell[0], p[1] - cell[1])]
            if i + 1 < len(cells):
                q = cells[i + 1]
                bits |= way[(q[0] - cell[0], q[1] - cell[1])]
            if len(cells) == 1:
                bits = UP | DOWN
            elif i in (0, len(cells) - 1):
                bits |= UP | DOWN if bits & (UP | DOWN) else LEFT | RIGHT
            self.lines[cell] = self.lines.get(cell, 0) | bits

    def _route(self) -> None:
        along = 0
        for i, layer in enumerate(self.x.layers):
            deep = max(self.size[v][1] for v in layer)
            for v in layer:
                if self.x.label[v] is None:
                    a = self.begin[v]
                    self._line([(a + 1, along), (a + 1, along + deep - 1), (a, along + deep - 1)] if deep > 1 else [(a + 1, along), (a, along)])
                    self.lines[(a, along + deep - 1)] = RIGHT | DOWN
                    self.lines[(a + 1, along + deep - 1)] = LEFT | UP
                    continue
                w, _ = self.size[v]
                self.boxes.append((self.begin[v], along, w, deep, self.x.label[v]))
                for k in range(self.x.loops[v]):
                    right, top = self.begin[v] + w - 1, along + 1 + 3 * k
                    out = right + 2
                    self._line([(right + 1, top), (out, top), (out, top + 1), (right + 1, top + 1)])
                    self.arrows[(right + 1, top + 1)] = LEFT
            along += deep
            if i + 1 < len(self.x.layers):
                along = self._gap(layer, along)
        self.depth = along

    def _gap(self, layer: list[int], along: int) -> int:
        """Lines between a layer that ends before ``along`` and the next one; returns where that begins."""
        links = []
        for v in layer:
            for k, (_, c, j) in enumerate(self.out[v]):
                w = self.x.chains[c][0][j + 1]
                m = [(x[1], x[2]) for x in self.into[w]].index((c, j))
                links.append([self._port(v, k, len(self.out[v]), 0), self._port(w, m, len(self.into[w]), 1), v, w, self.x.chains[c][1]])
        if self.prefs.straighten:  # an incoming line may stand right below its outgoing one if no other line comes near
            taken = {x for a, b, *_ in links for x in (a, b)}
            for link in links:
                a, b, _, w, _ = link
                inside = self.x.label[w] is not None and self.begin[w] < a < self.begin[w] + self.size[w][0] - 1
                if abs(a - b) == 1 and inside and b + (b - a) not in taken and 2 * a - b not in taken - {b}:
                    link[1] = a
        rows: list[list[tuple[int, int]]] = []
        track = {}
        for n, (a, b, *_) in sorted(enumerate(links), key=lambda x: (abs(x[1][0] - x[1][1]), x[0])):
            if a == b:
                continue
            lo, hi = min(a, b), max(a, b)
            for r, own in enumerate(rows if self.prefs.compact else []):
                if all(hi + 1 < x or y + 1 < lo for x, y in own):
                    break
            else:
                rows.append([])
                r = len(rows) - 1
            rows[r].append((lo, hi))
            track[n] = r
        end = along + max(1, len(rows)) + 2  # a row above and one below the tracks for arrows and stubs
        for n, (a, b, v, w, up) in enumerate(links):
            at = along + 1 + track.get(n, 0)
            self._line([(a, along), (a, at), (b, at), (b, end - 1)] if a != b else [(a, along), (a, end - 1)])
            if up and self.x.label[v] is not None:
                self.arrows[(a, along)] = UP
            if not up and self.x.label[w] is not None:
                self.arrows[(b, end - 1)] = DOWN
        return end

    def text(self) -> str:
        flat = self.prefs.vertical
        chars = (_ROUND if self.prefs.rounded else _UNICODE) if self.prefs.unicode else _ASCII
        edge = _DOUBLE if self.prefs.double and self.prefs.unicode else chars
        grid: dict[tuple[int, int], str] = {}
        put = lambda a, b, c: grid.__setitem__((a, b) if flat else (b, a), c)
        for (a, b), bits in self.lines.items():
            put(a, b, chars[bits if flat else _turn(bits)])
        for (a, b), way in self.arrows.items():
            put(a, b, _ARROW[self.prefs.unicode][way if flat else _TURNED[way]])
        for a, b, w, h, label in self.boxes:
            x, y, wide, high = (a, b, w, h) if flat else (b, a, h, w)
            for i in range(wide):
                grid[(x + i, y)] = grid[(x + i, y + high - 1)] = edge[LEFT | RIGHT]
            for j in range(high):
                grid[(x, y + j)] = grid[(x + wide - 1, y + j)] = edge[UP | DOWN]
            for cx, cy, bits in ((x, y, DOWN | RIGHT), (x + wide - 1, y, DOWN | LEFT), (x, y + high - 1, UP | RIGHT), (x + wide - 1, y + high - 1, UP | LEFT)):
                grid[(cx, cy)] = edge[bits]
            rows = label.split("\n")
            for j, row in enumerate(rows):
                for i, c in enumerate(row):
                    grid[(x + 1 + (wide - 2 - len(row)) // 2 + i, y + 1 + (high - 2 - len(rows)) // 2 + j)] = c
        across = max(x for x, _ in grid) + 1
        down = max(y for _, y in grid) + 1
        return "\n".join("".join(grid.get((x, y), " ") for x in range(across)).rstrip() for y in range(down))
