"""Near duplicates of embeddings: all pairs of vectors, tile by tile, with bounds on whole tiles.

Vectors of length one whose cosine is ``c`` lie ``sqrt(2 - 2c)`` apart. A tree of median cuts deals them to chunks of
close vectors, and each chunk is kept as parts of up to ``PART`` vectors with a centre and a radius. A task takes two
chunks. By the triangle inequality two chunks, or two parts, none of whose vectors can be in range are passed over, and
of two parts whose vectors must all be in range only the sizes are used, so that large groups of copies cost little.
What lies between is compared by products of matrices: first of a few leading directions, whose distance is never more
than the whole one, then of whole vectors for what is left.

Tasks hold vectors as 16-bit codes with a bound of their error. A pair nearer to the limit than that is compared anew,
in double precision, from the vectors as they are given. A sample lays out tree and directions; it bears on the time
only, as every bound holds for any tree and any directions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.graph import components
from tablescope.sources.shared import cut_lineage

SIMILAR = 0.95
#: Vectors that lay out the tree and the directions, and the dimensions up to which so many are taken.
SAMPLE, LONG = 8192, 1024
#: Vectors of the sample in a leaf of the tree, and cuts above it at most, as copies beside loose vectors give uneven cuts.
LEAF, DEPTH = 16, 30
#: Vectors of a part, parts compared with one at once, and rows of a product: small ones need no packing.
PART, ABREAST, ROWS = 256, 4, 128
#: Bytes of codes of a chunk at most; fewer chunks mean fewer copies of a vector, more of them more tasks.
CHUNK_BYTES = 32_000_000
CHUNKS, LEAST_CHUNK = 8, 8192
#: Numbers of leading directions tried, by nanoseconds for a pair: of any product, for each direction, for looking through a
#: product in which a pair is left, and for each pair left.
DIRECTIONS, PAIR_NS, DIRECTION_NS, LOOK_NS, LEFT_NS = (12, 16, 20, 24, 28, 32, 40, 48, 64, 96, 128), 0.2, 0.0095, 0.4, 60
#: Ids of vectors to look at again that go to the table; of more of them the table is shuffled to meet them.
SENT_IDS = 1_000_000
#: Guards distances of numbers in double precision, and squared ones in single precision for each dimension.
SLACK, SINGLE = 1e-6, 2.4e-7
STEPS = 32767


def unit_rows(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``dims, ids, matrix`` of the vectors that can link, of length one in double precision.

    ``batch`` holds an id and a list of floats or doubles; nulls among the numbers read as not finite.
    """
    for at in range(0, batch.num_rows, rows):
        some = batch.slice(at, rows)
        some = some.filter(pc.and_(some.column(0).is_valid(), some.column(1).is_valid()))
        ids = some.column(0).to_numpy()
        lengths = some.column(1).value_lengths().to_numpy()
        numbers = some.column(1).flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        for dims in np.unique(lengths[lengths > 0]):
            where = np.flatnonzero(lengths == dims)
            x = numbers[starts[where][:, None] + np.arange(dims)].astype(float)
            largest = np.abs(x).max(axis=1)
            fit = np.isfinite(largest) & (largest > 0)
            y = x[fit] / largest[fit][:, None]
            y /= np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]
            yield int(dims), ids[where[fit]], y


def _given(vectors: DataFrame) -> DataFrame:
    numbers = F.col("embedding")
    if vectors.schema["embedding"].dataType.simpleString() != "array<float>":  # half the bytes of doubles
        numbers = numbers.cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding"))


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix."""
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def tree_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, cuts and children of a tree of median cuts; a negative child is a leaf, in order from -1 down."""
    nodes: list[list] = []
    leaves = 0

    def grow(some: np.ndarray, depth: int) -> int:
        nonlocal leaves
        cut = None
        if len(some) > 2 * LEAF and depth < DEPTH:
            away = some - some.mean(axis=0)
            v = away[np.argmax(np.einsum("ij,ij->i", away, away))]
            for _ in range(6):  # towards the direction of the largest spread
                v = away.T @ (away @ (v / max(np.linalg.norm(v), 1e-30)))
            v = v / max(np.linalg.norm(v), 1e-30)
            along = some @ v
            cut = np.median(along)
            high = along > cut if (along > cut).any() else along >= cut
        if cut is None or high.all() or not high.any():
            leaves += 1
            return -leaves
        if not (along > cut).any():
            cut = np.nextafter(cut, np.float32(-np.inf))
        at = len(nodes)
        nodes.append([v, cut, 0, 0])
        nodes[at][2] = grow(some[~high], depth + 1)
        nodes[at][3] = grow(some[high], depth + 1)
        return at

    grow(x, 0)
    kids = np.array([n[2:] for n in nodes], np.int64).reshape(-1, 2)
    return np.array([n[0] for n in nodes], np.float32).reshape(-1, x.shape[1]), np.array([n[1] for n in nodes], np.float32), kids


def directions_of(x: np.ndarray, range2: float) -> np.ndarray | None:
    """As many leading directions (orthonormal columns) as make comparisons cheapest; none if whole vectors do."""
    some = x[:: max(1, len(x) // 1024)].astype(float)
    dims = x.shape[1]
    if len(some) < 256:
        return None
    found = np.linalg.svd(some - some.mean(axis=0), full_matrices=False)[2]
    first, second = x[::2][:2048], x[1::2][:2048]

    def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * a @ b.T <= range2

    def cost(count: int, left: float) -> float:
        return PAIR_NS + DIRECTION_NS * count + LOOK_NS * -math.expm1(-left * PART * ROWS) + LEFT_NS * left

    linked = within(first, second)  # these stand together, so that few products hold them
    best, least = None, cost(dims, 0)
    for count in DIRECTIONS:
        if count < min(dims, len(found) + 1):
            lead = found[:count].T.astype(np.float32)
            now = cost(count, float((within(first @ lead, second @ lead) & ~linked).mean()))
            if now < least:
                best, least = lead, now
    return best


def layouts(vectors: DataFrame, range2: float) -> dict[int, tuple]:
    """By number of dimensions the tree and the leading directions, from a sample spread by the hash of ids.

    Of vectors of more than ``LONG`` dimensions fewer are taken, so that the driver holds no more of them.
    """
    step = max(1, vectors.count() // SAMPLE)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, ids, y in unit_rows(batch):
                if dims > LONG:
                    some = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) < 2**32 * LONG // dims
                    ids, y = ids[some], y[some]
                columns = [pa.array(ids), pa.array(np.full(len(ids), dims, np.int32)), _binary(y.astype(np.float32))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dims", "v"])

    some = _given(vectors).filter("vec_id IS NOT NULL").filter(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).limit(2 * SAMPLE)
    by: dict[int, list] = {}
    for row in sorted(some.mapInArrow(rows, "vec_id long, dims int, v binary").collect(), key=lambda r: (r.vec_id, bytes(r.v))):
        by.setdefault(row.dims, []).append(row.v)
    out = {}
    for dims, packed in by.items():
        x = np.frombuffer(b"".join(packed), np.float32).reshape(-1, dims)
        out[dims] = (tree_of(x), directions_of(x, range2))
    return out


def coded(vectors: DataFrame, trees: dict[int, tuple]) -> DataFrame:
    """``vec_id, dims, leaf, code`` of the vectors that can link: a code is the largest number, then 16 bits for each."""
    sent = vectors.sparkSession.sparkContext.broadcast(trees)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, ids, y in unit_rows(batch):
                leaf = np.full(len(y), -1)
                if dims in sent.value and len(sent.value[dims][0]):
                    lines, cuts, kids = sent.value[dims]
                    leaf[:] = 0
                    single = y.astype(np.float32)
                    while len(on := np.flatnonzero(leaf >= 0)):
                        node = leaf[on]
                        along = np.einsum("ij,ij->i", single[on], lines[node])
                        leaf[on] = kids[node, (along > cuts[node]).astype(int)]
                most = np.abs(y).max(axis=1).astype(np.float32)
                code = np.empty((len(y), dims + 2), np.int16)
                code[:, :2] = most[:, None].view(np.int16)
                code[:, 2:] = np.clip(np.rint(y / most[:, None] * STEPS), -STEPS, STEPS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(np.full(len(ids), dims, np.int32)), pa.array((-1 - leaf).astype(np.int32)), _binary(code)],
                    names=["vec_id", "dims", "leaf", "code"],
                )

    return _given(vectors).mapInArrow(rows, "vec_id long, dims int, leaf int, code binary")


def decoded(code: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """The vectors of codes, each no further from its own than ``code_error`` says."""
    most = np.ascontiguousarray(code[:, :2]).view(np.float32).astype(kind)
    return code[:, 2:] * (most / kind(STEPS))


def code_error(code: np.ndarray) -> float:
    return float(np.ascontiguousarray(code[:, :2]).view(np.float32).max()) * math.sqrt(code.shape[1] - 2) / (2 * STEPS) + 5e-7


def in_chunks(units: DataFrame) -> tuple[DataFrame, int]:
    """``units`` with ``chunk`` and ``slot``, the task that packs it, and the number of slots.

    Leaves are laid side by side, each as wide as it has vectors, and cut at even steps, so that a leaf of any size is
    dealt over as many chunks as it needs; inside a leaf the hash of the id is the place.
    """
    spark = units.sparkSession
    by: dict[int, list] = {}
    for row in units.groupBy("dims", "leaf").count().collect():
        by.setdefault(row.dims, []).append((row.leaf, row["count"]))
    rows, chunk, slot, room = [], 0, -1, 0
    for dims, leaves in sorted(by.items()):
        total = sum(n for _, n in leaves)
        width = 2 * dims + 12
        chunks = max(math.ceil(total * width / CHUNK_BYTES), min(CHUNKS, math.ceil(total / LEAST_CHUNK)))
        if chunks > 1 or total * width > room:
            slot, room = slot + 1, CHUNK_BYTES if chunks == 1 else 0
        room -= total * width
        start = 0
        for leaf, n in sorted(leaves):
            rows.append((dims, leaf, chunk, slot, chunks, float(start), float(n), total / chunks))
            start += n
        chunk, slot = chunk + chunks, slot + chunks - 1
    places = spark.createDataFrame(rows, "dims int, leaf int, first int, slot0 int, chunks int, start double, n double, step double")
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    at = F.least(F.floor((F.col("start") + part * F.col("n")) / F.col("step")), F.col("chunks") - 1).cast("int")
    placed = units.join(F.broadcast(places), ["dims", "leaf"]).select(
        (F.col("first") + at).alias("chunk"), (F.col("slot0") + at).alias("slot"), "dims", "leaf", "vec_id", "code"
    )
    return placed, slot + 1


def packed(placed: DataFrame, slots: int) -> DataFrame:
    """``chunk, part, dims, ids, codes, centre, radius`` and, in part 0, ``whole, reach, error`` of the chunk."""

    def part_row(chunk, part, dims, ids, code, whole, reach, error):
        x = decoded(code)
        centre = x.mean(axis=0)
        return chunk, part, dims, ids.tobytes(), code.tobytes(), centre.tobytes(), spread(x, centre), whole, reach, error

    def spread(x, centre):
        return float(np.sqrt(np.einsum("ij,ij->i", x - centre, x - centre).max())) * (1 + SINGLE * x.shape[1]) + SLACK

    def chunk_rows(chunk, dims, leaf, ids, code):
        x = decoded(code)
        away = np.empty(len(x), np.float32)
        order = np.argsort(leaf, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            apart = x[run] - x[run].mean(axis=0)
            away[run] = np.einsum("ij,ij->i", apart, apart)
        order = np.lexsort((ids, away, leaf))  # close copies in a leaf stand together
        ids, code = ids[order], code[order]
        whole = x.mean(axis=0)
        reach, error = spread(x, whole), code_error(code)
        for at in range(0, len(ids), PART):
            yield part_row(
                chunk, at // PART, dims, ids[at : at + PART], code[at : at + PART], None if at else whole.tobytes(), None if at else reach,
                None if at else error,
            )

    names = ["chunk", "part", "dims", "ids", "codes", "centre", "radius", "whole", "reach", "error"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.float64(), pa.float64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            chunks, all_dims = batch.column("chunk").to_numpy(), batch.column("dims").to_numpy()
            for chunk in np.unique(chunks):
                some = batch.filter(pa.array(chunks == chunk))
                dims = int(all_dims[np.argmax(chunks == chunk)])
                codes = np.frombuffer(b"".join(some.column("code").to_pylist()), np.int16).reshape(-1, dims + 2)
                held.setdefault((int(chunk), dims), []).append((some.column("leaf").to_numpy(), some.column("vec_id").to_numpy(), codes))
        for (chunk, dims), pieces in held.items():
            out = list(chunk_rows(chunk, dims, *(np.concatenate(p) for p in zip(*pieces))))
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 64]), kinds)], names=names)

    schema = (
        "chunk int, part int, dims int, ids binary, codes binary, centre binary, radius double, whole binary, reach double, error double"
    )
    return placed.repartitionById(max(1, slots), "slot").select("chunk", "dims", "leaf", "vec_id", "code").mapInArrow(rows, schema)


def forest(u: np.ndarray, v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of ``count`` nodes as one link to the least node of its component for every other node."""
    label = np.arange(count)
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            break
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label[label] != label).any():
            label = label[label]
    node = np.flatnonzero(label != np.arange(count))
    return node, label[node]


def spanning(linked: np.ndarray, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Few links (rows, columns) that join what the true cells of a matrix join; beyond ``most`` groups all cells left."""
    us, vs = [], []
    left = linked.any(axis=1)
    for _ in range(most):
        if not left.any():
            break
        new = np.array([np.argmax(left)])
        seen = np.zeros(linked.shape[1], bool)
        left[new] = False
        while len(new):
            cells = linked[new]
            cols = np.flatnonzero(cells.any(axis=0) & ~seen)
            us.append(new[cells[:, cols].argmax(axis=0)])
            vs.append(cols)
            seen[cols] = True
            rest = np.flatnonzero(left)
            cells = linked[np.ix_(rest, cols)]
            found = cells.any(axis=1)
            new = rest[found]
            if len(new):
                us.append(new)
                vs.append(cols[cells[found].argmax(axis=1)])
            left[new] = False
    rows, cols = np.nonzero(linked & left[:, None])
    return np.concatenate([*us, rows]), np.concatenate([*vs, cols])


class Chunk:
    """The parts of a chunk as arrays."""

    def __init__(self, parts: list[dict], lead: np.ndarray | None):
        parts.sort(key=lambda p: p["part"])
        self.dims = parts[0]["dims"]
        self.ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in parts])
        self.codes = np.concatenate([np.frombuffer(p["codes"], np.int16) for p in parts]).reshape(-1, self.dims + 2)
        self.edges = np.cumsum([0] + [len(p["ids"]) // 8 for p in parts])
        self.centres = np.array([np.frombuffer(p["centre"], np.float32) for p in parts], float)
        self.radii = np.array([p["radius"] for p in parts])
        self.error = code_error(self.codes)
        width = self.dims if lead is None else lead.shape[1]
        #: By part: leading coordinates, then one and half the negative square, so that a product with such a row, its last two
        #: turned round, is half the negative squared distance. Rows that fill up the last part are far from all.
        self.short = np.zeros((len(parts), PART, width + 2), np.float32)
        self.short[..., width:] = 1, -1e9
        flat = self.short.reshape(-1, width + 2)
        for at in range(0, len(self.ids), 4096):
            x = decoded(self.codes[at : at + 4096])
            x = x if lead is None else x @ lead
            flat[at : at + len(x), :width] = x
            flat[at : at + len(x), width + 1] = -0.5 * np.einsum("ij,ij->i", x, x)
        self.counts = np.zeros(len(self.ids), np.int64)
        self.joined = np.zeros(len(parts), bool)


def compare(a: Chunk, b: Chunk, range2: float) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Links of two chunks, or of one with itself if ``b`` is ``a``: ``ids, None, counts``, then links that join what is
    linked, as ``ids, ids, zeros``, and pairs nearer to the limit than codes tell, as ``ids, ids, None``."""
    reach, doubt, same = math.sqrt(range2), a.error + b.error, a is b
    inner, outer = max(reach - doubt, 0.0) ** 2 if reach > doubt else -1.0, (reach + doubt) ** 2
    single = 1e-5 + SINGLE * a.dims
    limit = np.float32(-(outer + single) / 2)
    offset = 0 if same else len(a.ids)
    nodes = a.ids if same else np.concatenate([a.ids, b.ids])
    across = b.short.transpose(0, 2, 1).copy()
    across[:, -2:] = across[:, -2:][:, ::-1].copy()
    buffer = np.empty(PART * PART * ABREAST, np.float32)
    later = np.arange(PART)[:, None] < np.arange(PART)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def link(u, v):
        nonlocal held, links
        links.append((u, v + offset))
        held += len(u)
        if held > 500_000 + len(nodes):
            links = [forest(*(np.concatenate(x) for x in zip(*links)), len(nodes))]
            held = len(links[0][0])

    def all_linked(i, j):
        """Every vector of part i of a is linked with every one of part j of b."""
        (s, e), (t, f) = a.edges[i : i + 2], b.edges[j : j + 2]
        if same and i == j:
            a.counts[s:e] += e - s - 1
        else:
            a.counts[s:e] += f - t
            b.counts[t:f] += e - s
        if not a.joined[i]:
            a.joined[i] = True
            link(np.arange(s, e), np.full(e - s, t))
        if not b.joined[j]:
            b.joined[j] = True
            link(np.full(f - t, s), np.arange(t, f))
        link(np.array([s]), np.array([t]))

    def few(rows, cols):
        """Pairs one by one, in double precision."""
        for at in range(0, len(rows), 16384):
            r, c = rows[at : at + 16384], cols[at : at + 16384]
            apart = decoded(a.codes[r], np.float64) - decoded(b.codes[c], np.float64)
            d2 = np.einsum("ij,ij->i", apart, apart)
            sure = d2 <= inner
            if sure.any():
                np.add.at(a.counts, r[sure], 1)
                np.add.at(b.counts, c[sure], 1)
                link(r[sure], c[sure])
            open_ = ~sure & (d2 <= outer)
            if open_.any():
                yield a.ids[r[open_]], b.ids[c[open_]], None

    def many(hits, s, t):
        """The true cells of a block, by whole vectors."""
        rows, cols = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
        x, y = decoded(a.codes[s + rows]), decoded(b.codes[t + cols])
        d2 = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y) - 2 * (x @ y.T)
        hits = hits[np.ix_(rows, cols)]
        sure = hits & (d2 <= inner - single)
        a.counts[s + rows] += sure.sum(axis=1)
        b.counts[t + cols] += sure.sum(axis=0)
        u, v = spanning(sure)
        if len(u):
            link(s + rows[u], t + cols[v])
        r, c = np.nonzero(hits & ~sure & (d2 <= outer + single))
        yield from few(s + rows[r], t + cols[c])

    for i in range(len(a.radii)):
        s, e = a.edges[i : i + 2]
        apart = np.sqrt(((b.centres - a.centres[i]) ** 2).sum(axis=1))
        radii = a.radii[i] + b.radii
        near, sure = apart - radii <= reach + doubt + SLACK, apart + radii < reach - doubt - SLACK
        if same:
            near[:i] = sure[:i] = False
        for j in np.flatnonzero(sure):
            all_linked(i, j)
        todo = np.flatnonzero(near & ~sure)
        left = a.short[i].reshape(PART // ROWS, 1, ROWS, -1)
        found = [(np.empty(0, int), np.empty(0, int))]
        for at in range(0, len(todo), ABREAST):
            js = todo[at : at + ABREAST]
            out = buffer[: PART * PART * len(js)].reshape(PART // ROWS, len(js), ROWS, PART)
            np.matmul(left, across[js[0] : js[-1] + 1] if js[-1] - js[0] < len(js) else across[js], out=out)
            if out.max() < limit:
                continue
            for band, place in zip(*np.nonzero(out.max(axis=(2, 3)) >= limit)):
                hits = out[band, place] >= limit
                first, j = band * ROWS, js[place]
                if same and i == j:
                    hits &= later[first : first + ROWS]
                if np.count_nonzero(hits) > hits.size // 256:
                    yield from many(hits, s + first, b.edges[j])
                else:
                    r, c = np.divmod(np.flatnonzero(hits), PART)
                    found.append((s + first + r, b.edges[j] + c))
        yield from few(*(np.concatenate(x) for x in zip(*found)))
    for side in [a] if same else [a, b]:
        linked = np.flatnonzero(side.counts)
        yield side.ids[linked], None, side.counts[linked]
    if links:
        u, v = forest(*(np.concatenate(x) for x in zip(*links)), len(nodes))
        yield nodes[u], nodes[v], np.zeros(len(u), np.int64)


def compared(parts: DataFrame, leads: dict[int, np.ndarray], range2: float) -> DataFrame:
    """What ``compare`` finds in all pairs of chunks that may hold links, as ``a, b, n``."""
    spark = parts.sparkSession
    chunks = parts.filter("part = 0").select("chunk", "dims", "whole", "reach", "error").collect()
    sizes = {r.chunk: r.bytes for r in parts.groupBy("chunk").agg(F.sum(F.length("codes")).alias("bytes")).collect()}
    by: dict[int, list] = {}
    for row in sorted(chunks, key=lambda r: r.chunk):
        by.setdefault(row.dims, []).append(row)
    rows, slot, room, pair = [], -1, 0, 0
    for some in by.values():
        centres = np.array([np.frombuffer(r.whole, np.float32) for r in some], float)
        reaches, errors = np.array([r.reach for r in some]), np.array([r.error for r in some])
        for i, one in enumerate(some):
            apart = np.sqrt(((centres[i:] - centres[i]) ** 2).sum(axis=1)) - reaches[i:] - reaches[i] - errors[i:] - errors[i]
            for j in i + np.flatnonzero(apart <= math.sqrt(range2) + SLACK):
                need = sizes[one.chunk] + sizes[some[j].chunk]
                if need > room:  # chunks of few vectors share a task
                    slot, room = slot + 1, CHUNK_BYTES // 4
                room -= need
                rows.append((one.chunk, pair, 0, slot))
                if i != j:
                    rows.append((some[j].chunk, pair, 1, slot))
                pair += 1
    sent = spark.sparkContext.broadcast(leads)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["pair"], ([], []))[row["side"]].append(row)
        while held:
            first, second = held.popitem()[1]
            lead = sent.value.get(first[0]["dims"])
            a = Chunk(first, lead)
            b = Chunk(second, lead) if second else a
            del first, second
            for u, v, n in compare(a, b, range2):
                none = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u), none if v is None else pa.array(v), none if n is None else pa.array(n)], names=["a", "b", "n"]
                )

    places = spark.createDataFrame(rows, "chunk int, pair int, side int, slot int")
    dealt = parts.join(F.broadcast(places), "chunk").repartitionById(max(1, slot + 1), "slot")
    return dealt.select("pair", "side", "part", "dims", "ids", "codes", "centre", "radius").mapInArrow(work, "a long, b long, n long")


def exact(pairs: DataFrame, vectors: DataFrame, similar: float) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose cosine is at least ``similar`` in double precision."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, ids, y in unit_rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids), _binary(y)], names=["vec_id", "v"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [
                len(x) == len(y) and float(np.frombuffer(x) @ np.frombuffer(y)) >= similar
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    ids = pairs.select(F.col("a").alias("vec_id")).unionByName(pairs.select(F.col("b").alias("vec_id"))).distinct()
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    units = _given(vectors).join(ids, "vec_id", "left_semi").mapInArrow(rows, "vec_id long, v binary").dropDuplicates(["vec_id"])
    joined = pairs.join(units.select(F.col("vec_id").alias("a"), F.col("v").alias("x")), "a").join(
        units.select(F.col("vec_id").alias("b"), F.col("v").alias("y")), "b"
    )
    return joined.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def near_duplicates(vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding`` and others, not read).

    Vectors link if their cosine in double precision is at least ``similar``; ``n_links`` counts the other vectors linked
    directly, ``component_id`` is the least id reachable by links, the vector's own included, and ``kept`` says whether
    that is its own. Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id,
    link with nothing. Vectors of different dimensions don't link. Ids are taken to be unique; rows that repeat an id
    with the same vector count as one. An empty table gives an empty result.
    """
    range2 = 2 - 2 * similar
    laid = layouts(vectors, range2)
    units = coded(vectors, {dims: tree for dims, (tree, _) in laid.items()})
    repeated = _given(vectors).filter("vec_id IS NOT NULL").groupBy("vec_id").count().filter("count > 1")
    if not repeated.isEmpty():
        units = units.dropDuplicates(["vec_id"])
    units = cut_lineage(units, "embed-units")
    parts = cut_lineage(packed(*in_chunks(units)), "embed-parts")
    found = cut_lineage(compared(parts, {dims: lead for dims, (_, lead) in laid.items()}, range2), "embed-found")
    sure = found.filter("b IS NOT NULL AND n IS NOT NULL").select("a", "b")
    close = cut_lineage(exact(found.filter("b IS NOT NULL AND n IS NULL").select("a", "b"), vectors, similar), "embed-exact")
    ends = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = (
        found.filter("b IS NULL")
        .select("a", "n")
        .unionByName(ends.select("a", F.lit(1).cast("long").alias("n")))
        .groupBy(F.col("a").alias("vec_id"))
        .agg(F.sum("n").alias("n"))
    )
    roots = components(sure.unionByName(close)).withColumnRenamed("node", "vec_id")
    return (
        vectors.select("vec_id")
        .join(counts, "vec_id", "left")
        .join(roots, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("root", "vec_id").alias("component_id"),
            (F.coalesce("root", "vec_id") == F.col("vec_id")).alias("kept"),
        )
    )
