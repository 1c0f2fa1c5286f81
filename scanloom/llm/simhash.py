"""Near-duplicate documents by SimHash, found through the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import map_arrow, text_of
from scanloom.llm.components import components
from scanloom.plans.stage import stage

BITS, MAX_BITS, WORDS, SEED = 64, 4, 4, 42
#: Numbers of parts to choose from.
PARTS, WIDE_PARTS = (2, 3, 4, 5), (4, 6, 8)
#: Cost of a probe row (shuffled and sorted) in units of one comparison.
ROW_COST = 200
#: Fingerprints of one bucket that one task compares; larger buckets are split into pairs of blocks.
BLOCK = 20_000
_ALL_PAIRS = 6


def shingle_hashes(tokens: list[bytes], words: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of ``words`` words (of the whole sequence if it is shorter), in bounded parts."""
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, 1 << 15):
        at = slice(lo, lo + (1 << 15))
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at], ends[at])], "<u8")


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits, each set if over half the shingles' hashes have it; shingles count as often as they occur."""
    tokens = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(tokens, words):
        n += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _print(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_as_long(fingerprint(t, words)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["doc_id", "tie", "fp"]
            )

    return run


def _count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often two bits are set together, over the fingerprints of a task."""
    both = np.zeros((BITS, BITS))
    for batch in batches:
        bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
        both += bits.T @ bits
    cells = np.arange(BITS * BITS, dtype=np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(both.ravel().astype(np.int64))], ["cell", "n"])


def _bits(prints: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(prints.astype("<i8")).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def group_bits(both: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """``parts`` groups of near-equal width; bits that vary together share a group."""
    share = np.diag(both) / max(1, total)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    tied = np.abs(both / max(1, total) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0)
    left, groups = set(range(BITS)), []
    for g in range(parts):
        width = BITS // parts + (g < BITS % parts)
        group = [max(left, key=lambda b: (tied[b, list(left)].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            nearest = max(left, key=lambda b: (tied[b, group].sum(), -b))
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def within(share: np.ndarray, most: int) -> np.ndarray:
    """Chance that two random fingerprints differ in at most 0, 1, .. ``most`` of bits set with these chances."""
    odds = np.zeros(most + 2)
    odds[0] = 1.0
    for p in share:
        differ = 2 * p * (1 - p)
        odds[1:] = odds[1:] * (1 - differ) + odds[:-1] * differ
        odds[0] *= 1 - differ
        odds[-1] = 0
    return np.cumsum(odds[: most + 1])


def allocate(costs: list[list[float]], most: int) -> tuple[float, list[int]]:
    """Thresholds (-1: skip the part) that add up to ``most`` - parts + 1 at the least cost, by dynamic programming.

    ``costs[i][t]`` is the cost of threshold t - 1 for part i.
    """
    best = {0: (0.0, [])}
    for row in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(row):
                if used + t <= most + 1 and (used + t not in following or cost + c < following[used + t][0]):
                    following[used + t] = (cost + c, [*chosen, t - 1])
        best = following
    return best[most + 1]


class Plan:
    """Bit groups with a threshold each, such that two fingerprints within ``most`` bits meet in one of them."""

    def __init__(self, masks: list[int], thresholds: list[int], largest: int):
        self.masks, self.thresholds, self.largest = masks, thresholds, largest

    def flips(self, part: int) -> np.ndarray:
        """What to flip in a part to reach every value within its threshold; the first entry flips nothing."""
        bits = [b for b in range(BITS) if self.masks[part] >> b & 1]
        out = [0]
        for r in range(1, self.thresholds[part] + 1):
            out += [sum(1 << b for b in c) for c in combinations(bits, r)]
        return np.array(out, np.uint64)


def make_plan(prints: DataFrame, most: int = MAX_BITS, parts: tuple[int, ...] = PARTS) -> Plan:
    """Choose parts and thresholds from what all distinct fingerprints show.

    For each number of parts bits are grouped by correlation, and the pairs that
    agree on a whole part are counted exactly. Pairs within a larger distance
    are estimated from that count and the bits' shares. The parts and thresholds
    of least cost in probe rows and comparisons win; every choice finds all links.
    """
    cells = map_arrow(prints.select("fp"), _count_bits, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    both = np.zeros(BITS * BITS)
    for r in cells.collect():  # 64 x 64
        both[r["cell"]] = r["n"]
    both, total = both.reshape(BITS, BITS), prints.count()
    share = np.diag(both) / max(1, total)
    grouped = {m: group_bits(both, total, m) for m in parts if m <= most + 1}
    masks = {(m, i): sum(1 << b for b in g) for m, groups in grouped.items() for i, g in enumerate(groups)}
    values = F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_as_long(k))).alias("v"))
        for (m, i), k in masks.items()
    ])).alias("x")
    alike = prints.select(values).groupBy("x.m", "x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))
    alike = alike.groupBy("m", "i").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias("pairs"), F.max("n").alias("most"))
    seen = {(r["m"], r["i"]): r for r in alike.collect()}  # one row a part
    found = []
    for m, groups in grouped.items():
        costs = []
        for i, g in enumerate(groups):
            pairs = float(seen[m, i]["pairs"]) if (m, i) in seen else 0.0
            odds = within(share[g], most)
            scale = max(pairs, 1.0) / max(odds[0], 1e-30)
            rows = np.cumsum([comb(len(g), r) for r in range(most + 1)]) * total
            costs.append([0.0, *(ROW_COST * rows + scale * odds).tolist()])
        cost, thresholds = allocate(costs, most)
        found.append((cost, m, thresholds))
    _, m, thresholds = min(found)
    used = [seen[m, i]["most"] for i in range(m) if (m, i) in seen and thresholds[i] >= 0]
    return Plan([masks[m, i] for i in range(m)], thresholds, max(used, default=0))


def _probe(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for part, t in enumerate(plan.thresholds):
                if t < 0:
                    continue
                flips = plan.flips(part)
                at = max(1, 200_000 // max(1, len(prints)))
                for lo in range(0, len(flips), at):
                    some = flips[lo : lo + at]
                    keys = ((prints & np.uint64(plan.masks[part]))[:, None] ^ some[None, :]).ravel()
                    who = np.repeat(prints, len(some)).view(np.int64)
                    columns = [pa.array(np.full(len(keys), part, np.int32)), pa.array(keys.view(np.int64)), pa.array(who)]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "key", "fp"])

    return run


def _forest(prints: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is reachable within one bucket; each fingerprint is reached once."""
    left = np.unique(prints)
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= most
            if near.any():
                met = left[near]
                yield np.full(len(met), x), met
                frontier.extend(met)
                left = left[~near]


def bucket_links(keys: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets: ``keys`` numbers the buckets, in runs."""
    us, vs = [prints[:0]], [prints[:0]]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], int)
    sizes = np.diff(np.append(starts, len(keys)))
    few = np.repeat(sizes <= _ALL_PAIRS, sizes)
    for shift in range(1, _ALL_PAIRS):
        ok = (keys[:-shift] == keys[shift:]) & few[shift:] if len(keys) > shift else np.array([], bool)
        if not ok.any():
            break
        a, b = prints[:-shift][ok], prints[shift:][ok]
        near = (np.bitwise_count(a ^ b) <= most) & (a != b)
        us.append(a[near])
        vs.append(b[near])
    for s, n in zip(starts[sizes > _ALL_PAIRS], sizes[sizes > _ALL_PAIRS]):
        for a, b in _forest(prints[s : s + n], most):
            us.append(a)
            vs.append(b)
    return np.concatenate(us), np.concatenate(vs)


def _verify(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys, prints):
            u, v = bucket_links(keys, prints, most)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        held, last = np.zeros((0, 4), np.int64), None
        for batch in batches:
            rows = np.column_stack([np.asarray(c.to_numpy(), np.int64) for c in batch.columns])
            rows = np.vstack([held, rows])
            if not len(rows):
                continue
            new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
            last = int(np.flatnonzero(new)[-1])  # the last bucket may go on in the next batch
            if last:
                yield links(np.cumsum(new)[:last], np.ascontiguousarray(rows[:last, 3]).view(np.uint64))
            held = rows[last:]
        yield links(np.zeros(len(held), np.int64), np.ascontiguousarray(held[:, 3]).view(np.uint64))

    return run


def split_large(rows: DataFrame, keys: list[str], member: str, block: int, weight: Column | None = None) -> DataFrame:
    """``rows`` with ``sub``: buckets of more than ``block`` rows become pairs of blocks that cover all their pairs.

    With ``weight`` a row counts as so many.
    """
    sizes = rows.groupBy(*keys).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n")).filter(F.col("n") > block)
    blocks = stage(sizes.select(*keys, F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-buckets")
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> least(x, mine) * blocks + greatest(x, mine))")
    joined = rows.join(blocks, keys, "left").withColumn("mine", F.expr(f"cast(pmod(xxhash64({member}), blocks) as int)"))
    sub = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs))
    return joined.withColumn("sub", sub).drop("blocks", "mine")


def near_links(prints: DataFrame, most: int = MAX_BITS, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` within ``most`` bits of each other.

    Not every pair is listed: within a bucket each fingerprint is reached once,
    which keeps components whole without all pairs of a group.
    """
    plan = make_plan(prints, most, parts)
    rows = map_arrow(prints.select("fp"), _probe(plan), "part int, key long, fp long").withColumn("sub", F.lit(0))
    if plan.largest > BLOCK:
        rows = split_large(rows.drop("sub"), ["part", "key"], "fp", BLOCK)
    rows = rows.select("part", "key", "sub", "fp").repartition("part", "key", "sub").sortWithinPartitions("part", "key", "sub")
    return map_arrow(rows, _verify(most), "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, words: int = WORDS, most: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprint every whole text and number the groups of fingerprints that links connect.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and into
    shingles of ``words`` words. Documents with one fingerprint are one node, so
    a large group of copies costs what one document costs. Nodes link at
    ``most`` or fewer differing bits; see ``make_plan`` and ``near_links``.

    Returns doc_id, fp (the fingerprint as a signed long), tie (hash of the
    text), fingerprint (16 hex digits) and component_id (the smallest doc_id
    reachable; null if none has one), a row per row. Texts without words, null
    ones too, have fingerprint zero; null ids and repeated rows are kept; an
    empty table gives no rows.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tie"), text_of(text_col).alias("text")
    )
    rows = stage(map_arrow(texts, _print(words), "doc_id long, tie long, fp long"), "fingerprints")
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(near_links(prints, most))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(rooted.join(firsts, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select(
        "doc_id", "fp", "tie", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


SIMILARITY, SHINGLE, SLOTS = 0.8, 5, 256
#: Fingerprints over word pairs: a changed word alters two of them but five shingles, so similar texts stay close.
CANDIDATE_WORDS, CANDIDATE_BITS = 2, 10
#: Slots of a band; texts that agree in one of the 42 bands are candidates too. At similarity 0.8 three in a million pairs agree in none.
BAND = 6
#: Estimate from which the shingles themselves are compared: six standard deviations below ``SIMILARITY``.
LOOSE = 0.65
#: Texts, and bytes of them, in one block of a group.
_SIMILAR_BLOCK, _SIMILAR_BYTES = 5_000, 32 << 20


def _factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240613)
    a = draw.integers(1 << 31, size=(SLOTS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, draw.integers(1 << 32, size=(SLOTS, 1), dtype=np.uint64).astype(np.uint32)


def sketch(tokens: list[bytes], words: int = SHINGLE) -> np.ndarray:
    """MinHash of the shingle set, 16 bits a slot; the share of equal slots estimates the Jaccard similarity."""
    (a, b), least = _factors(), np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for hashes in shingle_hashes(tokens, words):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for lo in range(0, len(x), 2048):
            least = np.minimum(least, (a * x[None, lo : lo + 2048] + b).min(axis=1))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def _print_and_sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(4).to_pylist()
            prints = [_as_long(fingerprint(t, words)) for t in texts]
            sketches = [sketch(t.encode().lower().split()).tobytes() for t in texts]
            cols = [*batch.columns[:4], pa.array(prints, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "tie", "size", "fp", "sketch"])

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between similar texts of a bucket, each text reached once.

    The sketches only rule out; every link is decided on the two texts' whole
    shingle sets, which are made when they are first needed.
    """
    unpack = zstd.ZstdDecompressor().decompress

    def links(held):
        ties, sketches = np.array([h[0] for h in held], np.int64), np.stack([np.frombuffer(h[1], "<u2") for h in held])
        sets: dict[int, np.ndarray] = {}

        def shingles(i):
            if i not in sets:
                parts = list(shingle_hashes(unpack(held[i][2]).lower().split(), SHINGLE))
                sets[i] = np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")
            return sets[i]

        us, vs, left = [], [], np.arange(len(held))
        while len(left) > 1:
            frontier, left = [left[0]], left[1:]
            while frontier and len(left):
                x = frontier.pop()
                near = (sketches[left] == sketches[x]).mean(axis=1) >= LOOSE
                near[near] = [alike(shingles(x), shingles(y)) for y in left[near].tolist()]
                met = left[near]
                us.extend([ties[x]] * len(met))
                vs.extend(ties[met].tolist())
                frontier.extend(met.tolist())
                left = left[~near]
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    held, last = [], None
    for batch in batches:
        for root, sub, tie, packed, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (root, sub) != last and held:
                yield links(held)
                held = []
            last = (root, sub)
            held.append((tie, packed, text))
    if held:
        yield links(held)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of ``SIMILARITY`` or more; empty sets are equal."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) >= SIMILARITY or not len(a) + len(b)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstd.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [pack(t.encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["row", "text"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tie) for every band of a sketch; a key is a hash of the band's place and slots."""
    for batch in batches:
        ties, packed = batch.column(0), batch.column(1).to_pylist()
        keys = [
            _as_long(xxhash.xxh64_intdigest(p[lo : lo + 2 * BAND], lo)) for p in packed for lo in range(0, 2 * SLOTS - 2 * BAND + 1, 2 * BAND)
        ]
        each = len(keys) // max(1, len(packed))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.repeat(ties.to_numpy(), each))], ["key", "tie"])


def _to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every text to the first of its key; keys come in runs, and a run may go on in the next batch."""
    last = None  # key and first text of the run at hand
    for batch in batches:
        keys, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        new = np.concatenate([[last is None or keys[0] != last[0]], keys[1:] != keys[:-1]])
        firsts = np.concatenate([[last[1] if last else 0], ties[new]])[np.cumsum(new)]
        last = (keys[-1], firsts[-1])
        linked = firsts != ties
        yield pa.RecordBatch.from_arrays([pa.array(ties[linked]), pa.array(firsts[linked])], ["u", "v"])


def similar_groups(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts alike in five-word shingles, found by SimHash and MinHash: (row, first), a row per row of ``docs``.

    Texts meet as candidates by SimHash over word pairs (``near_links``: at most
    ``CANDIDATE_BITS`` bits), or by a band of ``BAND`` of the ``SLOTS`` minima
    of their five-word shingles; either may miss what the other finds. Within
    the groups that both make together texts are linked if the Jaccard similarity
    of their whole shingle sets is 0.8 or more, and links are closed; the minima
    only rule out what they estimate below ``LOOSE``.
    ``first`` says that the row is the one of its group that stays: smallest id,
    then text hash, then row number. Equal texts are one text throughout; large
    groups are split into pairs of blocks. Null ids count as the largest, null
    texts as empty; an empty table gives no rows.
    """
    texts = docs.select(
        F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tie"),
        F.octet_length(text_of(text_col)).cast("long").alias("size"), text_of(text_col).alias("text"),
    )
    schema = "row long, doc_id long, tie long, size long, fp long, sketch binary"
    rows = stage(map_arrow(texts, _print_and_sketch(CANDIDATE_WORDS), schema), "sketches")
    # One row of each text; its fingerprint and sketch are functions of the text.
    one = stage(rows.groupBy("tie").agg(F.min(F.struct("row", "size", "fp", "sketch")).alias("x")).select("tie", "x.*"), "texts")
    prints = stage(one.select("fp").distinct(), "distinct-fingerprints")
    roots = components(near_links(prints, CANDIDATE_BITS, WIDE_PARTS)).withColumnRenamed("node", "fp")
    rooted = one.select("tie", "fp").join(roots, "fp", "left").select(F.xxhash64(F.coalesce("root", "fp")).alias("key"), "tie")
    keys = map_arrow(one.select("tie", "sketch"), _bands, "key long, tie long").union(rooted)
    met = map_arrow(keys.repartition("key").sortWithinPartitions("key", "tie"), _to_first, "u long, v long").distinct()
    roots = components(met).withColumnRenamed("node", "tie")
    members = stage(roots.join(one, "tie").select("root", "tie", "row", "size", "sketch"), "candidates")
    weight = F.lit(1.0) + F.col("size") * (_SIMILAR_BLOCK / _SIMILAR_BYTES)
    dealt = split_large(members, ["root"], "tie", _SIMILAR_BLOCK, weight).select("root", "sub", "tie", "row", "sketch")
    packed = map_arrow(texts.select("row", "text"), _pack_texts, "row long, text binary")
    dealt = dealt.join(packed, "row").select("root", "sub", "tie", "sketch", "text")
    dealt = dealt.repartition("root", "sub").sortWithinPartitions("root", "sub")
    groups = components(map_arrow(dealt, _similar, "u long, v long")).withColumnRenamed("node", "tie").withColumnRenamed("root", "group")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("tie").alias("c"), F.col("row").alias("d"))
    named = rows.select("row", "doc_id", "tie").join(groups, "tie", "left").withColumn("group", F.coalesce("group", "tie"))
    least = named.groupBy("group").agg(F.min(order).alias("least"))
    return named.join(least, "group").select("row", (F.col("row") == F.col("least.d")).alias("first"))
