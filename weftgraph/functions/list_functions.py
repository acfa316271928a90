"""The vertex programs of :mod:`weftgraph.functions.table_functions` over whole record batches.

A message of theirs tells a node of one other; a row here tells it of up to ``LIST`` others at once,
as the steps from each id down to the next, all steps of a batch in as many bytes as the longest
takes.  So what nodes send is a row an edge instead of a row a pair of neighbours, and counts are
made for all nodes of a batch together.  As there, a partition is read once, in order, and what is
kept between batches is of one node, or of two blocks of its neighbours.

Table functions over record batches can't look at their arguments when a query is analysed; what
they need of them is checked as they run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Others in a row at most, and in all rows of a batch that is handed on.
LIST, BATCH = 128, 500_000

MESSAGE = "id bigint, value bigint, width tinyint, others binary"


def _table(rows) -> pa.RecordBatch:
    """The rows that have an id."""
    if not isinstance(rows, pa.RecordBatch):
        raise ValueError("the first argument must be a table: TABLE(...) PARTITION BY ... ORDER BY ...")
    if rows.column("id").null_count:
        rows = rows.filter(rows.column("id").is_valid())
    return rows


def _numbers(rows: pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    column = rows.column(name)
    return (column.fill_null(null) if column.null_count else column).to_numpy(zero_copy_only=False)


def _there(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).is_valid().to_numpy(zero_copy_only=False)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows with the same values begin, of rows in which these stand together."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _places(sizes: np.ndarray) -> np.ndarray:
    """Where parts of these sizes begin, and the end of the last."""
    return np.concatenate([[0], np.cumsum(sizes)])


def encode(ids: np.ndarray, values: np.ndarray, others: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Messages to ``ids``: of the ``sizes`` numbers in ``others`` that end with the one at ``last``.
    Each rises up to there and is below the id; the steps are from the id down."""
    at = _places(sizes)
    steps = np.empty(len(others) + 1, dtype=np.int64)
    steps[1:-1] = others[1:] - others[:-1]
    flat = steps[np.repeat(last + at[:-1] + 1, sizes) - np.arange(at[-1])]
    flat[at[:-1]] = ids - others[last]
    # steps of over 63 bits come out right as well: they wrap, here and when they are added up
    width = max(1, -(-int(flat.view(np.uint64).max()).bit_length() // 8))
    data = np.ascontiguousarray(flat.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width])
    lists = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(values), pa.array(np.full(len(ids), width, dtype=np.int8)), lists], names=["id", "value", "width", "others"])


def decode(ids: np.ndarray, widths: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many others each row tells of (none where the width is 0), and all of them."""
    lists = lists.cast(pa.binary())
    offsets = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, 4 * lists.offset)
    held = lists.buffers()[2]
    data = np.frombuffer(held, np.uint8, offsets[-1] - offsets[0], offsets[0]) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    n_bytes = np.diff(offsets)
    sizes = np.where(widths > 0, n_bytes // np.maximum(widths, 1), 0).astype(np.int64)
    steps = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
    kinds = np.unique(widths[sizes > 0]).tolist()
    for w in kinds:
        if len(kinds) == 1:
            steps[:, :w] = data.reshape(-1, w)
        else:
            of = widths == w
            steps[np.repeat(of, sizes), :w] = data[np.repeat(of, n_bytes)].reshape(-1, w)
    down = np.cumsum(steps.view("<i8").ravel(), dtype=np.int64)
    at = _places(sizes)[:-1]
    before = np.where(at > 0, down[np.maximum(at, 1) - 1], 0) if len(down) else np.zeros(len(at), np.int64)
    return sizes, np.repeat(ids + before, sizes) - down


class SendLists:
    """``pregel_send_lists(TABLE(blocks) PARTITION BY ... ORDER BY (id, x, y, side, edge))``: what each node
    tells its neighbours of each other, as (id, value, width, others): neighbour ``id`` hears from
    ``value`` of the smaller neighbours ``others``, so of each pair the larger hears of the smaller.

    ``blocks`` is the table of :func:`weftgraph.functions.table_functions.neighbour_blocks`; rows with
    one (id, x, y) are in one partition.  Repeated rows count once.
    """

    def __init__(self) -> None:
        self.open: list[np.ndarray] | None = None

    def eval(self, rows) -> Iterator[pa.RecordBatch]:
        rows = _table(rows)
        columns = [_numbers(rows, c) for c in ("id", "x", "y", "side", "edge")]
        if self.open is not None:
            columns = [np.concatenate(c) for c in zip(self.open, columns, strict=True)]
        if not len(columns[0]):
            return
        starts = _starts(*columns[:3])
        self.open = [c[starts[-1] :].copy() for c in columns]
        yield from self._send([c[: starts[-1]] for c in columns], starts[:-1])

    def terminate(self) -> Iterator[pa.RecordBatch]:
        if self.open is not None:
            yield from self._send(self.open, np.array([0]))

    def _send(self, columns: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole (id, x, y)."""
        if not len(starts):
            return
        node, x, y, side, edge = columns
        rising = (edge[1:] >= edge[:-1]) | (side[1:] > side[:-1])
        rising[starts[1:] - 1] = True
        blocks = list(zip(node[starts].tolist(), x[starts].tolist(), y[starts].tolist(), strict=True))
        if not rising.all() or blocks != sorted(blocks):
            raise ValueError("rows must come ordered by id, x, y, side, edge")
        keep = np.ones(len(edge), dtype=bool)
        keep[1:] = (edge[1:] != edge[:-1]) | (side[1:] != side[:-1])
        keep[starts] = True
        starts = np.cumsum(keep)[starts] - 1
        node, x, y, side, edge = (c[keep] for c in (node, x, y, side, edge))
        # one block: those before it in the block
        same = np.flatnonzero(x == y)
        first = np.repeat(starts, np.diff(np.append(starts, len(edge))))[same]
        yield from self._lists(edge[same], node[same], edge, same - 1, same - first)
        # two: those of the other block that are smaller
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(edge)], strict=True):
            if x[a] == y[a]:
                continue
            cut = a + int(np.searchsorted(side[a:b], 1))
            for mine, others in ((slice(a, cut), edge[cut:b]), (slice(cut, b), edge[a:cut])):
                less = np.searchsorted(others, edge[mine])
                yield from self._lists(edge[mine], node[mine], others, less - 1, less)

    def _lists(self, ids: np.ndarray, values: np.ndarray, others: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Lists of ``sizes`` numbers of ``others`` up to ``last``, in rows of ``LIST`` and batches of ``BATCH``."""
        some = sizes > 0
        ids, values, last, sizes = ids[some], values[some], last[some], sizes[some]
        parts = -(-sizes // LIST)
        if len(parts) and parts.max() > 1:
            gone = LIST * (np.arange(parts.sum()) - np.repeat(_places(parts)[:-1], parts))
            ids, values, last, sizes = np.repeat(ids, parts), np.repeat(values, parts), np.repeat(last, parts) - gone, np.minimum(np.repeat(sizes, parts) - gone, LIST)
        total = np.cumsum(sizes)
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BATCH, side="right")))
            yield encode(ids[a:b], values[a:b], others, last[a:b], sizes[a:b])
            a = b


class _Rows:
    """Reads batches of rows by id."""

    def __init__(self) -> None:
        self.id: int | None = None

    def _ids(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Each row's id and its number among the ids of the batch; raises unless ids rise."""
        ids = _numbers(rows, "id")
        if (ids[1:] < ids[:-1]).any() or (self.id is not None and ids[0] < self.id):
            raise ValueError("rows must come ordered by id")
        rank = np.zeros(len(ids), dtype=np.int64)
        np.cumsum(ids[1:] != ids[:-1], out=rank[1:])
        return ids, rank


class _Closing(_Rows):
    """Reads edges (``edge``, no width) and messages by (id, edge nulls last) and tells which of a
    message's others are about an edge that exists."""

    def __init__(self) -> None:
        super().__init__()
        self.edges, self.heard = np.zeros(0, np.int64), False

    def closed(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each triangle its largest node that the sender tells, the smaller one, and the sender."""
        ids, rank = self._ids(rows)
        edge, is_edge = _numbers(rows, "edge"), _there(rows, "edge")
        late = is_edge[1:] & ~is_edge[:-1] & (ids[1:] == ids[:-1])
        if late.any() or (self.heard and ids[0] == self.id and is_edge[0]):
            raise ValueError("rows must come ordered by id, edge, nulls last: an edge came after a message")
        of, ends = rank[is_edge], edge[is_edge]
        if self.id is not None and ids[0] == self.id:
            of, ends = np.concatenate([np.zeros(len(self.edges), np.int64), of]), np.concatenate([self.edges, ends])
        self.id, self.edges, self.heard = int(ids[-1]), ends[of == rank[-1]], not is_edge[-1]
        sizes, others = decode(ids, _numbers(rows, "width"), rows.column("others"))
        none = np.zeros(0, np.int64)
        if not len(ends) or not len(others):
            return none, none, none
        known = np.unique(ends)
        place = np.minimum(np.searchsorted(known, others), len(known) - 1)
        could = np.flatnonzero(known[place] == others)
        row = np.repeat(np.arange(len(ids)), sizes)[could]
        keys = np.sort(of * len(known) + np.searchsorted(known, ends))
        asked = rank[row] * len(known) + place[could]
        found = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
        row = row[found]
        return ids[row], others[could[found]], _numbers(rows, "value")[row]


class TrianglesOfLists(_Closing):
    """``pregel_triangle_lists(TABLE(t) PARTITION BY id % n ORDER BY (id, edge NULLS LAST))``: (triangles),
    one row of each partition that has any, to be added up.  A task without rows ends as well, and
    Spark can't take a row from it."""

    def __init__(self) -> None:
        super().__init__()
        self.total = 0

    def eval(self, rows) -> None:
        rows = _table(rows)
        if rows.num_rows:
            self.total += len(self.closed(rows)[0])

    def terminate(self) -> Iterator[pa.RecordBatch]:
        if self.total:
            yield pa.RecordBatch.from_arrays([pa.array([self.total], pa.int64())], names=["triangles"])


class PernodeTrianglesOfLists(_Closing):
    """``pregel_pernode_triangle_lists(TABLE(t) PARTITION BY id % n ORDER BY (id, edge NULLS LAST))``: (id,
    triangles), in parts to be added up."""

    def eval(self, rows) -> Iterator[pa.RecordBatch]:
        rows = _table(rows)
        if rows.num_rows:
            corners, n = np.unique(np.concatenate(self.closed(rows)), return_counts=True)
            if len(corners):
                yield pa.RecordBatch.from_arrays([pa.array(corners), pa.array(n.astype(np.int64))], names=["id", "triangles"])


class WeakTiesOfBatches(_Rows):
    """``pregel_weak_ties_batches(TABLE(t) PARTITION BY id % n ORDER BY id, threshold => 1000)``: (id, ties), as
    ``pregel_weak_ties`` gives them of the same rows."""

    def __init__(self) -> None:
        super().__init__()
        self.degree, self.triangles, self.threshold = 0, 0, 0

    def eval(self, rows, threshold) -> Iterator[pa.RecordBatch]:
        rows = _table(rows)
        if not rows.num_rows:
            return
        self.threshold = threshold[0].as_py()
        ids, _ = self._ids(rows)
        edge, value = _there(rows, "edge"), _there(rows, "value")
        starts = _starts(ids)
        degree = np.add.reduceat((edge & ~value).astype(np.int64), starts)
        triangles = np.add.reduceat(np.where(edge | ~value, 0, _numbers(rows, "value")).astype(np.int64), starts)
        nodes = ids[starts]
        if nodes[0] == self.id:
            degree[0] += self.degree
            triangles[0] += self.triangles
        elif self.id is not None:
            yield from self.terminate()
        self.id, self.degree, self.triangles = int(nodes[-1]), int(degree[-1]), int(triangles[-1])
        yield from self._over(nodes[:-1], degree[:-1], triangles[:-1])

    def _over(self, nodes: np.ndarray, degree: np.ndarray, triangles: np.ndarray) -> Iterator[pa.RecordBatch]:
        ties = degree * (degree - 1) // 2 - triangles
        over = ties >= self.threshold
        if over.any():
            yield pa.RecordBatch.from_arrays([pa.array(nodes[over]), pa.array(ties[over].astype(np.float64))], names=["id", "ties"])

    def terminate(self) -> Iterator[pa.RecordBatch]:
        if self.id is not None:
            yield from self._over(*(np.array([n]) for n in (self.id, self.degree, self.triangles)))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and how often each came, of such parts."""
    if len(parts) == 1:
        return parts[0]
    numbers, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(numbers), dtype=np.int64)
    np.add.at(n, place, np.concatenate([p[1] for p in parts]))
    return numbers, n


class OverlapOfLists(_Rows):
    """``pregel_overlap_lists(TABLE(t) PARTITION BY id % n ORDER BY id, threshold => 100)``: (n1, n2, overlap) of
    the pairs that ``threshold`` messages or more tell of.

    Kept between batches: how often the last node has heard of each other."""

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.loose, self.threshold = 0, 1

    def eval(self, rows, threshold) -> Iterator[pa.RecordBatch]:
        rows = _table(rows)
        if not rows.num_rows:
            return
        self.threshold = threshold[0].as_py()
        ids, rank = self._ids(rows)
        sizes, others = decode(ids, _numbers(rows, "width"), rows.column("others"))
        if not len(others):
            return
        nodes = ids[_starts(ids)]
        # a number for each (node, other), in 64 bits
        low, known = int(others.min()), None
        span = int(others.max()) - low + 1
        if span * len(nodes) >= 1 << 63:
            known, others = np.unique(others, return_inverse=True)
            low, span = 0, len(known)
        key = np.repeat(rank * span - low, sizes) + others
        key.sort()
        starts = _starts(key)
        n = np.diff(np.append(starts, len(key)))
        key = key[starts]

        def other(k: np.ndarray) -> np.ndarray:
            k = k % span + low
            return k if known is None else known[k]

        a, b = 0, int(np.searchsorted(key, (len(nodes) - 1) * span))
        if nodes[0] == self.id:
            a = int(np.searchsorted(key, span)) if len(nodes) > 1 else len(key)
            self._keep(other(key[:a]), n[:a])
        if len(nodes) > 1 or nodes[0] != self.id:
            yield from self.terminate()
            many = a + np.flatnonzero(n[a:b] >= self.threshold)
            yield from self._found(nodes[key[many] // span], other(key[many]), n[many])
            self.id, self.parts, self.loose = int(nodes[-1]), [], 0
            self._keep(other(key[b:]), n[b:])

    def _keep(self, others: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((others, n))
        self.loose += len(others)
        if self.loose > BATCH + 2 * len(self.parts[0][0]):
            self.parts, self.loose = [_added(self.parts)], 0

    def _found(self, ids: np.ndarray, others: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(others), pa.array(ids), pa.array(n)], names=["n1", "n2", "overlap"])

    def terminate(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            others, n = _added(self.parts)
            many = n >= self.threshold
            yield from self._found(np.full(int(many.sum()), self.id, dtype=np.int64), others[many], n[many])


class StrongOverlapOfLists(OverlapOfLists):
    """``pregel_strong_overlap_lists(TABLE(t) PARTITION BY id % n ORDER BY id, threshold => 100)``: (id,
    partners): with how many smaller nodes a node shares ``threshold`` neighbours or more."""

    def _found(self, ids: np.ndarray, others: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes, partners = np.unique(ids, return_counts=True)
        if len(nodes):
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(partners.astype(np.int64))], names=["id", "partners"])


FUNCTIONS = {
    "pregel_send_lists": (SendLists, MESSAGE), "pregel_triangle_lists": (TrianglesOfLists, "triangles bigint"),
    "pregel_pernode_triangle_lists": (PernodeTrianglesOfLists, "id bigint, triangles bigint"), "pregel_weak_ties_batches": (WeakTiesOfBatches, "id bigint, ties double"),
    "pregel_overlap_lists": (OverlapOfLists, "n1 bigint, n2 bigint, overlap bigint"), "pregel_strong_overlap_lists": (StrongOverlapOfLists, "id bigint, partners bigint"),
}
