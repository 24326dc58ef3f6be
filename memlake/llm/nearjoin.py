"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct K-word shingles.  Documents link when
100 * intersection >= PERCENT * union.

1. Equal sets collapse to one representative, the smallest doc_id.
2. Candidates.  Two linked sets of which the larger has n elements differ in at
   most D(n) of them.  Elements are dealt by hash into M > D parts, so at least
   M - D parts are the same in both: sets meet under keys that are the sum of a
   part's hashes.  Sizes are classed so that linked sets are in one class or in
   neighbouring ones.  A set that shares fewer than M - D keys (less its own
   empty parts) with all others together has no link.  Sets so small that all
   equal parts may be empty also meet under their first elements, of which
   linked sets share one (prefix filter).  Thus no link is lost.  Of a key only
   the edges to its smallest member are kept, as many as rows.
3. The candidate edges' components are the groups that are partitioned further:
   by size class, and by hash into blocks of at most about BLOCK sets and TOKENS
   elements.  Only texts of grouped sets are read on: their ids' bits in a filter
   of FILTER bits, whose false hits the join removes.  A block is packed once,
   as the union of its elements and places in it, so near copies take a small
   part of their elements' bytes, and only packed blocks are dealt to pairs.
4. A task takes a block, then one pair of blocks.  Its sets are dealt into small
   groups of similar ones; for each group the union of its tokens is stored,
   every set's tokens in that union bound its overlap with any member, and only
   groups whose bound reaches the least overlap are opened and counted exactly.
5. The links' components give component_id.

Each step's shuffles go when it ends, and its inputs as soon as they are read.

Element and set hashes have 64 and 128 bits; texts are never compared in pairs
outside their blocks, nor gathered on the driver.

Defined cases: null texts, and texts without words, have an empty set and are
their own component; fewer than K words are one shingle; rows of one doc_id are
one document; a null doc_id links with nothing beyond its equal sets and has
their smallest doc_id; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .arrays import pack, unpack
from .components import components
from .store import cut, drop, width

K = 5
PERCENT = 80
BLOCK = 1024
TOKENS = 1 << 19
GROUP = 16
CELLS = 1 << 22
FILTER = 1 << 23
BYTES = 1 << 20
SPARE = 0.2
_SEED_A, _SEED_B = np.uint64(0x632BE59BD9B4E019), np.uint64(0xE220A8397B1DCDAF)


class Classes:
    """Size classes and numbers of parts for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ratio = math.log(1 / (percent / 100 - 0.001))
        self.spread = (100 - percent) / (100 + percent)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(n, 1)) / self.ratio).astype(np.int64)

    def parts(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sets of classes label - 1 and label: the most elements in which linked ones differ, and the number of parts."""
        differ = np.floor(2 * np.exp((label + 1) * self.ratio) * self.spread + 1e-6).astype(np.int64)
        return differ, np.ceil((differ + 1) / (1 - SPARE)).astype(np.int64)

    def first(self, n: np.ndarray) -> np.ndarray:
        """Number of first elements of which linked sets share one."""
        return n - -(-self.percent * n // 100) + 1


def _sets(block: tk.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    data = tk.lower_ascii(block.data)
    s, e, o = tk.words(data, block.offsets)
    h, at = tk.shingles(tk.span_hashes(data, s, e), o, len(block), k)
    return tk.distinct_per_text(h, at, len(block))


def _sum_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint64)
    np.add.at(out, owner, values)
    return out


def _digests(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    with np.errstate(over="ignore"):
        return tk.mix(_sum_by(owner, tk.mix(h + _SEED_A), n)).view(np.int64), tk.mix(_sum_by(owner, tk.mix(h ^ _SEED_B), n)).view(np.int64)


def part_keys(h: np.ndarray, offsets: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys under which sets meet, with the sets' numbers and which label they are of (0 or 1), and for each set and label how many keys a linked set shares with it at least."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    rank = np.arange(len(h)) - offsets[:-1][owner]
    own = classes.of(sizes)
    keys, owners, labels, least = [], [], [], np.ones((2, n), dtype=np.int64)
    with np.errstate(over="ignore"):
        spread, value = tk.mix(h + np.uint64(77)) >> np.uint64(32), tk.mix(h ^ np.uint64(0x51ED270B))
        for which, label in enumerate((own, own + 1)):
            differ, m = classes.parts(label)
            m = np.where(sizes > 0, m, 0)
            base = np.concatenate([[0], np.cumsum(m)])
            part = (spread * m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            slot = base[:-1][owner] + part
            total = int(base[-1])
            sums = _sum_by(slot, value, total)
            full = np.bincount(slot, minlength=total) > 0
            of = np.repeat(np.arange(n), m)
            number = np.arange(total) - base[:-1][of]
            salt = tk.mix(label[of].astype(np.uint64) << np.uint64(40) | number.astype(np.uint64))
            keys.append(tk.mix(sums[full] + salt[full]))
            owners.append(of[full])
            empty = np.bincount(of[~full], minlength=n)
            spare = m - differ - empty
            least[which] = np.maximum(spare, 1)
            # all equal parts may be empty ones: such sets also meet under their first elements
            weak = np.flatnonzero((spare < 1) & (sizes > 0))
            if len(weak):
                first = (rank < classes.first(sizes)[owner]) & np.isin(owner, weak)
                keys.append(tk.mix((h[first] ^ np.uint64(0xA5A5A5A5)) + tk.mix(label[owner[first]].astype(np.uint64)) * np.uint64(3)))
                owners.append(owner[first])
            labels.append(np.full(len(keys[-1]) if not len(weak) else len(keys[-1]) + len(keys[-2]), which, dtype=np.int64))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(labels), least


def _facts(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tk.blocks(batch.column("text"), BYTES):
                h, off = _sets(block, k)
                a, b = _digests(h, off)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[block.first : block.first + len(block)], "n": np.diff(off), "d1": a, "d2": b})

    return docs.select("doc_id", "text").mapInArrow(tk.lean(run), "doc_id long, n long, d1 long, d2 long")


def _shared_keys(docs: DataFrame, k: int, classes: Classes) -> DataFrame:
    """(key, id, lab, need): the keys that two sets or more have, with the sets' digests."""
    wide = width(docs.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        count = sets = 0

        def flush() -> pa.RecordBatch:
            keys, mark, ids, least = (np.concatenate([x[i] for x in held], axis=-1) for i in range(4))
            to = (keys >> np.uint64(33)).astype(np.int64) % wide
            order = np.argsort(to, kind="stable")
            keys, mark, ends = keys[order], mark[order], np.cumsum(np.bincount(to, minlength=wide))
            rows, blobs = [], []
            for r in range(wide):
                begin = ends[r - 1] if r else 0
                if ends[r] == begin:
                    continue
                there, m = np.unique(mark[begin : ends[r]] >> 1, return_inverse=True)
                m = m << 1 | mark[begin : ends[r]] & 1
                low = keys[begin : ends[r]]
                # 48 bits of each key are sent
                blobs.append(pack((low & np.uint64(0xFFFFFFFF)).astype(np.int64), (low >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64), m, ids[there].view(np.uint64), least[0][there], least[1][there]))
                rows.append(r)
            return pa.RecordBatch.from_pydict({"r": pa.array(rows, pa.int32()), "blob": pa.array(blobs, pa.binary())})

        for batch in batches:
            for block in tk.blocks(batch.column("text"), BYTES):
                h, off = _sets(block, k)
                d, _ = _digests(h, off)
                fresh = np.array([x not in known and not known.add(x) for x in d.tolist()], dtype=bool) & (np.diff(off) > 0)
                if len(known) > 1_000_000:
                    known.clear()
                keys, own, lab, least = part_keys(h, off, classes)
                keep = fresh[own]
                held.append((keys[keep], (own[keep] + sets) << 1 | lab[keep], d, least))
                sets += len(block)
                count += int(keep.sum())
                if count > 500_000:
                    yield flush()
                    held, count, sets = [], 0, 0
        if count:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x) for batch in batches for x in batch.column("blob").to_pylist()]
        if not parts:
            return
        key = np.concatenate([p[1].astype(np.int64) << 32 | p[0].astype(np.int64) for p in parts])
        mark = np.concatenate([p[2].astype(np.int64) + 2 * b for p, b in zip(parts, np.cumsum([0, *[len(p[3]) for p in parts[:-1]]]), strict=True)])
        ids, least = np.concatenate([p[3] for p in parts]).view(np.int64), [np.concatenate([p[i] for p in parts]) for i in (4, 5)]
        del parts
        order = np.argsort(key, kind="stable")
        key, mark = key[order], mark[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        runs = np.diff(np.append(np.flatnonzero(head), len(key)))
        several = np.repeat(runs > 1, runs)
        key, mark = key[several], mark[several]
        own, lab = ids[mark >> 1], mark & 1
        # copies of a set that other tasks dealt go
        order = np.lexsort((lab, own, key))
        key, mark, own, lab = key[order], mark[order], own[order], lab[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | (lab[1:] != lab[:-1])]) if len(key) else np.zeros(0, bool)
        key, mark, own, lab = key[new], mark[new], own[new], lab[new]
        head = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        runs = np.diff(np.append(np.flatnonzero(head), len(key)))
        several = np.repeat(runs > 1, runs)
        key, mark, own, lab = key[several], mark[several], own[several], lab[several]
        need = np.where(lab == 0, least[0][mark >> 1], least[1][mark >> 1]).astype(np.int64)
        for i in range(0, len(key), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_pydict({"key": key[s] << 14 | key[s] % 16381, "id": own[s], "lab": lab[s].astype(np.int32), "need": need[s].astype(np.int32)})

    dealt = docs.select("doc_id", "text").mapInArrow(tk.lean(deal), "r int, blob binary")
    return dealt.repartitionById(wide, F.col("r")).mapInArrow(tk.lean(meet), "key long, id long, lab int, need int")


def _groups(docs: DataFrame, k: int, classes: Classes) -> DataFrame:
    """(d1, grp): the components of sets by digest that share keys, from edges to the smallest digest of each key.

    A set that shares fewer keys with all others than a linked one would is
    left out first, so that sets which have only a common line in common do not
    hold groups together.
    """
    spark = docs.sparkSession
    shared, p1 = cut(_shared_keys(docs, k, classes))
    enough = shared.groupBy("id", "lab").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select(F.col("id").alias("_i"), F.col("lab").alias("_l"))
    enough, p2 = cut(enough)
    left, p3 = cut(shared.join(enough, (F.col("id") == F.col("_i")) & (F.col("lab") == F.col("_l"))).select("key", "id"))
    drop(spark, p1, p2)
    least, p4 = cut(left.groupBy(F.col("key").alias("_k")).agg(F.min("id").alias("a")))
    edges = left.join(least, F.col("key") == F.col("_k")).filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    groups = components(edges).withColumnsRenamed({"v": "d1", "root": "grp"})
    drop(spark, p3, p4)
    return groups


def links_within(sizes: np.ndarray, tokens: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Linked pairs of sets; where side holds both 0 and 1, only those between the sides."""
    m = len(sizes)
    across = len(set(side.tolist())) > 1
    if m == 2:
        i = len(np.intersect1d(tokens[0], tokens[1], assume_unique=True))
        return [(0, 1)] if 100 * i >= percent * (int(sizes.sum()) - i) else []
    flat = np.concatenate(tokens)
    owner = np.repeat(np.arange(m), sizes)
    _, token, spread = np.unique(flat, return_inverse=True, return_counts=True)
    # tokens of one set only meet nothing; a set with too many of them links with nothing
    shared = spread[token] > 1
    token, owner = token[shared], owner[shared]
    live = 100 * np.bincount(owner, minlength=m) >= percent * sizes
    keep = live[owner]
    token, owner = token[keep], owner[keep]
    ends = np.cumsum(np.bincount(owner, minlength=m))
    begins = ends - np.bincount(owner, minlength=m)
    # groups of similar sets: neighbours by their smallest shared token, then size
    members = np.flatnonzero(live & (ends > begins))
    if len(members) < 2:
        return []
    members = members[np.lexsort((sizes[members], token[begins[members]]))]
    column = np.full(int(token.max()) + 1, -1, dtype=np.int64)
    out: list[tuple[int, int]] = []
    place = np.full(m, -1, dtype=np.int64)
    place[members] = np.arange(len(members))
    for g in range(0, len(members), GROUP):
        group = members[g : g + GROUP]
        union = np.unique(np.concatenate([token[begins[i] : ends[i]] for i in group]))
        column[union] = np.arange(len(union))
        matrix = np.zeros((len(group), len(union)), dtype=np.float32)
        for j, i in enumerate(group):
            matrix[j, column[token[begins[i] : ends[i]]]] = 1
        at = column[token]
        inside = at >= 0
        bound = np.bincount(owner[inside], minlength=m)
        small, large = sizes[group].min(), sizes[group].max()
        opened = (100 * bound >= percent * sizes) & (100 * large >= percent * sizes) & (100 * sizes >= percent * small) & (place >= g)
        if across:
            opened &= np.isin(side, np.unique(1 - side[group]))
        queries = np.flatnonzero(opened)
        if len(queries):
            mine = np.flatnonzero(inside & opened[owner])
            step = max(1, CELLS // len(union))
            for first in range(0, len(queries), step):
                some = queries[first : first + step]
                row = np.full(m, -1, dtype=np.int64)
                row[some] = np.arange(len(some))
                here = mine[row[owner[mine]] >= 0]
                dense = np.zeros((len(some), len(union)), dtype=np.float32)
                dense[row[owner[here]], at[here]] = 1
                common = np.rint(dense @ matrix.T).astype(np.int64)
                good = 100 * common >= percent * (sizes[some][:, None] + sizes[group][None, :] - common)
                good &= place[some][:, None] > place[group][None, :]
                if across:
                    good &= side[some][:, None] != side[group][None, :]
                out += [(int(some[a]), int(group[b])) for a, b in np.argwhere(good)]
        column[union] = -1
    return out


def _forest(m: int, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Enough of the links to connect what they connect."""
    up = list(range(m))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            up[x] = y
            kept.append((a, b))
    return kept


def pack_block(ids: np.ndarray, tokens: list[np.ndarray]) -> bytes:
    """A block's sets: the union of their elements, and each set as steps through it."""
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    union, place = np.unique(np.concatenate(tokens), return_inverse=True)
    steps = place.astype(np.int64)
    steps[1:] -= place[:-1]
    begins = np.cumsum(sizes) - sizes
    steps[begins] = place[begins]
    return pack(ids, sizes, union, steps)


def unpack_block(raw: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    ids, sizes, union, steps = unpack(raw)
    sizes = sizes.astype(np.int64)
    place = np.cumsum(steps.astype(np.int64))
    begins = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], place])[begins]
    return ids, np.split(union[place - np.repeat(before, sizes)], begins[1:])


def _linked(ids: np.ndarray, tokens: list[np.ndarray], side: np.ndarray, percent: int) -> dict[str, pa.Array]:
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    found = _forest(len(ids), links_within(sizes, tokens, side, percent)) if len(ids) > 1 else []
    return {"a": pa.array([int(ids[a]) for a, _ in found], pa.int64()), "b": pa.array([int(ids[b]) for _, b in found], pa.int64())}


_AT = ("grp", "cls", "me", "nb", "nb_up", "nb_down")


def _pack(percent: int) -> tk.Run:
    """Rows of sets, those of a block together: the links within each block, and the packed blocks that have others to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            ids, tokens = np.array([v for v, _ in rows], dtype=np.int64), [np.frombuffer(t, np.uint64) for t in rows.values()]
            found = _linked(ids, tokens, np.zeros(len(ids), np.int64), percent)
            yield pa.RecordBatch.from_arrays([found["a"], found["b"], *[pa.nulls(len(found["a"]), t) for t in kinds]], names=names)
            if now[3] + now[4] + now[5] > 1:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *[pa.array([x], t) for x, t in zip((*now, pack_block(ids, tokens)), kinds, strict=True)]], names=names)

        names, kinds = ["a", "b", *_AT, "blob"], [pa.int64(), *[pa.int32()] * 5, pa.binary()]
        for batch in batches:
            at = zip(*(batch.column(c).to_pylist() for c in _AT), strict=True)
            for key, v, d, tokens in zip(at, *(batch.column(c).to_pylist() for c in ("v", "d1", "tokens")), strict=True):
                if key != now:
                    yield from close()
                    now, rows = key, {}
                rows[v, d] = tokens
        yield from close()

    return run


def _verify(percent: int) -> tk.Run:
    """The links between the two packed blocks of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, other = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                pair, blob = batch.column("pair")[i].as_py(), unpack_block(batch.column("blob")[i].as_py())
                if pair != now:
                    now, other = pair, blob
                    continue
                side = np.repeat([0, 1], [len(other[0]), len(blob[0])])
                yield pa.RecordBatch.from_pydict(_linked(np.concatenate([other[0], blob[0]]), other[1] + blob[1], side, percent))

    return run


def _bits(ids: np.ndarray) -> np.ndarray:
    return (tk.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER)).astype(np.int64)


def _filter(ids: DataFrame) -> np.ndarray:
    """Which of FILTER bits the ids have; the driver gets a packed row from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER, dtype=bool)
        for batch in batches:
            bits[_bits(batch.column(0).to_numpy(zero_copy_only=False))] = True
        yield pa.RecordBatch.from_pydict({"bits": pa.array([pack(np.packbits(bits))], pa.binary())})

    out = np.zeros(FILTER // 8, dtype=np.uint8)
    for r in ids.mapInArrow(run, "bits binary").toLocalIterator():
        out |= unpack(bytes(r["bits"]))[0]
    return out


def _tokens(docs: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """(v, d, tokens): the sets, with their digests, of rows whose doc_id has a wanted bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            at = _bits(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
            hit = (wanted[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            batch = batch.filter(pa.array(hit & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)))
            for block in tk.blocks(batch.column("text"), BYTES):
                h, off = _sets(block, k)
                d, _ = _digests(h, off)
                ids = batch.column("doc_id")[block.first : block.first + len(block)]
                raw = [h[off[i] : off[i + 1]].tobytes() for i in range(len(block))]
                once = [x not in done and not done.add(x) for x in zip(ids.to_pylist(), d.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"v": ids, "d": d, "tokens": pa.array(raw, pa.binary())}).filter(pa.array(once, pa.bool_()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tk.lean(run), "v long, d long, tokens binary")


def near_join(docs: DataFrame, k: int = K, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    spark = docs.sparkSession
    classes, wide = Classes(percent), width(spark)
    facts, _ = cut(_facts(docs, k))
    reps, p1 = cut(facts.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")))
    groups = _groups(docs, k, classes)
    label = F.floor(F.log(F.col("n")) / classes.ratio).cast("int")
    placed, p2 = cut(reps.filter("rep is not null").join(groups, "d1").withColumn("cls", label))
    held = placed.groupBy("grp", "cls").agg(F.count("*").alias("cnt"), F.sum("n").alias("sum"), F.max("n").alias("most"))
    # blocks of this class and of the next one up
    size = F.least(F.lit(block), F.greatest(F.lit(8), F.floor(TOKENS / F.col("most"))))
    held, p3 = cut(held.withColumn("nb", F.ceil(F.col("cnt") / size).cast("int")))
    up = held.select("grp", (F.col("cls") - 1).alias("cls"), F.col("nb").alias("nb_up"))
    down = held.select("grp", (F.col("cls") + 1).alias("cls"), F.col("nb").alias("nb_down"))
    total = held.groupBy("grp").agg(F.sum("cnt").alias("all"), F.sum("sum").alias("elements"))
    plan = held.join(up, ["grp", "cls"], "left").join(down, ["grp", "cls"], "left").fillna(0, ["nb_up", "nb_down"]).join(total, "grp")
    plan, p4 = cut(plan.select("grp", "cls", "nb", "nb_up", "nb_down", ((F.col("all") <= block) & (F.col("elements") <= TOKENS)).alias("whole")))
    me = F.pmod(F.xxhash64("d2", "d1"), F.col("nb")).cast("int")
    zero = F.lit(0)
    of = lambda c, alone=zero: F.when(F.col("whole"), alone).otherwise(c)
    p = placed.join(plan, ["grp", "cls"]).select("rep", "d1", "grp", of(F.col("cls")).alias("cls"), of(me).alias("me"), of(F.col("nb"), F.lit(1)).alias("nb"), of(F.col("nb_up")).alias("nb_up"), of(F.col("nb_down")).alias("nb_down"))
    rows = _tokens(docs, k, _filter(placed.select("rep"))).join(p, (F.col("v") == F.col("rep")) & (F.col("d") == F.col("d1"))).select(*_AT, "v", "d1", "tokens")
    rows = rows.repartition(wide, "grp", "cls", "me").sortWithinPartitions("grp", "cls", "me", "v", "d1")
    ints = ", ".join(f"{c} int" for c in _AT[1:])
    packed, p5 = cut(rows.mapInArrow(tk.lean(_pack(percent)), f"a long, b long, grp long, {ints}, blob binary"))
    pair = lambda c, i, d, j: F.struct(c.cast("int").alias("c"), i.cast("int").alias("i"), d.cast("int").alias("d"), j.cast("int").alias("j"))
    numbers = lambda n: F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(F.filter(numbers(F.col("nb")), lambda j: j != F.col("me")), lambda j: F.struct(pair(F.col("cls"), F.least("me", j), F.col("cls"), F.greatest("me", j)).alias("p"), F.when(j < F.col("me"), 1).otherwise(0).alias("side")))
    above = F.transform(numbers(F.col("nb_up")), lambda j: F.struct(pair(F.col("cls"), F.col("me"), F.col("cls") + 1, j).alias("p"), F.lit(0).alias("side")))
    below = F.transform(numbers(F.col("nb_down")), lambda j: F.struct(pair(F.col("cls") - 1, j, F.col("cls"), F.col("me")).alias("p"), F.lit(1).alias("side")))
    met = packed.filter("blob is not null").select("grp", F.explode(F.concat(same, above, below)).alias("x"), "blob")
    met = met.select(F.struct("grp", "x.p").alias("pair"), F.col("x.side").alias("side"), "blob")
    across = met.repartition(wide, "pair").sortWithinPartitions("pair", "side").mapInArrow(tk.lean(_verify(percent)), "a long, b long")
    found = components(packed.filter("a is not null").select("a", "b").unionByName(across))
    labels, _ = cut(reps.join(found.select(F.col("v").alias("rep"), "root"), "rep", "left").select("d1", "d2", "n", F.coalesce("root", "rep").alias("component")))
    drop(spark, p1, p2, p3, p4, p5)
    out = facts.join(labels, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
