"""Edit distance of two long texts, one rectangle of the distance table at a time.

Bit-parallel form of the table (Myers 1999, Hyyrö 2003): only differences between
neighbouring cells are kept, one bit pair per row of the rectangle. A rectangle takes the
differences along its left and top edge and gives those along its right and bottom edge.

A tile is made of rectangles and leaves out those that lie farther from the table's diagonal than a band.
Where a neighbour is left out the cells beyond the edge count one more at each step, which is the way along
the edge; so a tile's values are never too small, and right wherever they do not exceed the band.
"""

from __future__ import annotations

LEFT_EDGE = None  # the table's own left border: every cell is one more than the cell above


def rectangle(
    rows: str,
    columns: str,
    left: tuple[int, int] | None = LEFT_EDGE,
    top: bytes | None = None,
) -> tuple[tuple[int, int], bytes]:
    """Right edge as (plus bits, minus bits) and bottom edge as one byte 0/1/2 (−1/0/+1) per column."""
    height = len(rows)
    full = (1 << height) - 1
    last = 1 << (height - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(rows):
        where[c] = where.get(c, 0) | (1 << i)
    plus, minus = (full, 0) if left is None else left
    bottom = bytearray(len(columns))
    for j, c in enumerate(columns):
        step = 1 if top is None else top[j] - 1
        same = where.get(c, 0)
        vertical = same | minus
        if step < 0:
            same |= 1
        horizontal = (((same & plus) + plus) ^ plus) | same
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal & full
        bottom[j] = 2 if up & last else (0 if down & last else 1)
        up = ((up << 1) | (step > 0)) & full
        down = ((down << 1) | (step < 0)) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return (plus, minus), bytes(bottom)


def edge_sum(edge: tuple[int, int]) -> int:
    """Difference between the last and the first cell of a right edge."""
    return edge[0].bit_count() - edge[1].bit_count()


def pack(edge: tuple[int, int], height: int) -> bytes:
    width = (height + 7) // 8
    return edge[0].to_bytes(width, "little") + edge[1].to_bytes(width, "little")


def unpack(data: bytes) -> tuple[int, int]:
    half = len(data) // 2
    return int.from_bytes(data[:half], "little"), int.from_bytes(data[half:], "little")


#: an edge of a rectangle with the table's value at its first corner
Edge = tuple[int, tuple[int, int]]
Bottom = tuple[int, bytes]


def tile(
    rows: str,
    columns: str,
    left: list[Edge | None] | None,
    top: list[Bottom | None] | None,
    row_start: int,
    column_start: int,
    band: int,
    side: int,
) -> tuple[list[Edge | None], list[Bottom | None], int | None]:
    """Right edges, bottom edges and the last corner's value of a tile that begins at these places of both texts;
    None for a rectangle outside the band. An absent edge list is the table's border."""
    row_parts = [rows[k : k + side] for k in range(0, len(rows), side)]
    column_parts = [columns[k : k + side] for k in range(0, len(columns), side)]
    rights = list(left) if left else [None] * len(row_parts)
    bottoms = list(top) if top else [None] * len(column_parts)
    corner = None
    for a, row_part in enumerate(row_parts):
        r0, edge = row_start + a * side, rights[a]
        r1 = r0 + len(row_part)
        for b, column_part in enumerate(column_parts):
            c0 = column_start + b * side
            c1 = c0 + len(column_part)
            if c0 - r1 > band or r0 - c1 > band:
                edge = bottoms[b] = corner = None
                continue
            above = bottoms[b]
            # one neighbour lies nearer to the diagonal, so it is there
            at = c0 if r0 == 0 else r0 if c0 == 0 else edge[0] if edge else above[0]
            along = sum(above[1]) - len(column_part) if above else len(column_part)
            down = edge_sum(edge[1]) if edge else len(row_part)
            right, bottom = rectangle(row_part, column_part, edge[1] if edge else LEFT_EDGE, above[1] if above else None)
            edge, bottoms[b] = (at + along, right), (at + down, bottom)
            corner = at + along + edge_sum(right)
        rights[a] = edge
    return rights, bottoms, corner
