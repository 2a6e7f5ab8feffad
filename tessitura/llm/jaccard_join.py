"""N-gram Jaccard join by grouped prefixes (operator 1).

Documents whose sets of distinct word 3-grams have Jaccard similarity of at least
``num / den`` are linked; each gets the smallest id that it reaches by links.

1. *Order.*  One scan counts the n-grams into a sketch of fixed size.  N-grams are
   ordered by (size class of their counter, hash), the rare ones first.  Any total
   order gives right results; this one keeps common lines out of the prefixes.
2. *Prefixes.*  A set of n has an overlap of at least ceil(t n) with any set it links
   to.  Two such sets, in one order, share at least l n-grams among their first
   n - ceil(t n) + l ones.  A second scan gives each document its fingerprint and
   this prefix.  Documents with equal sets become one class.
3. *Groups.*  Classes with one size and one prefix become one group; only groups are
   indexed.  For each prefix n-gram the groups that hold it are counted.  A group in
   which fewer than l of them are shared cannot link to another group.  Two of the rest
   that link share one of their first (shared - l + 1) n-grams, the ones in fewest
   groups first; all groups that do so come into one family, which is the unit of routing.
4. *Group pairs.*  A family is cut into blocks of bounded size.  For each pair of blocks
   the groups meet with their prefixes alone, and pairs of groups are filtered: their sizes
   must fit and their prefixes share l n-grams.  What comes out is not the pairs but, for each
   group, the blocks with a group that it may link to.
5. *Verify.*  Those groups are expanded to their classes, whose whole sets are sent once to
   each pair of blocks where they are wanted.  There the group pairs are filtered again and the
   members of those left are counted exactly by a matrix product over the n-grams, in
   slices.  A unit returns a spanning forest of its links and how many links each class has, never
   all pairs.
6. Connected components of the links give the result.

Sizes: the sketch is 4 MB whatever the corpus; a common n-gram sends
to one task at most COMMON records for each batch of groups.  Within a group of near copies the number of comparisons is the
square of its distinct texts, spread over block pairs.  Classes of very many copies, of which
there are few, meet their copies by a broadcast of at most HEAVY rows.

Defined results: a null or wordless text has an empty set and links to nothing; a document
whose doc_id is null takes part in no link and has a null component; rows that repeat a doc_id
are separate documents of one id, each with the links of its own text; ties don't arise, as
similarity is compared in whole numbers.  A text of any length is one set; it is counted
by itself if it is longer than a chunk.  Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.blocks import PACKED, buckets_for, chunks, exchange, forget, gather, join_by_count, kept, lean, mix, runs, scatter, small_batches, sorted_sets, tokenise
from tessitura.llm.components import connected_components, forest

U = np.uint64
SKETCH_BITS = 20
SKETCH_SLICE = 1 << 14
COMMON = 64  # groups from which on an n-gram is just a common one
BLOCK = 1024  # classes in a block of a family
SPREAD, SMALL_BLOCK = 16, 128  # a smaller family has blocks of SMALL_BLOCK, SPREAD of them at most
BLOCK_GRAMS = 1_000_000  # n-grams in a block of a family
SLICE = 2048  # n-grams in a slice of the matrix product
BUCKET_BYTES = 4 << 20  # of the planner's size in a bucket of prefix n-grams; a task has one


def ceil_share(n, num: int, den: int):
    """The least overlap of a set of n with a set that it links to: ceil(n * num / den)."""
    return -((-n * num) // den)


def least_shared(n, num: int, den: int):
    """l for a set of n: a longer prefix lets more sets be ruled out."""
    return np.maximum(1, n * (den - num) // den)


def grams(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds by row, hashes) of the k-grams of each text; all words are one gram where there are fewer."""
    words = tokenise(batch.column(batch.schema.get_field_index("text")))
    h = words.hashes(fold=True)
    at, found = words.window_hashes(h, k)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = np.zeros(len(short), U)
        for j in range(k - 1):
            has = words.counts[short] > j
            whole[has] = mix(whole[has] + h[words.first[:-1][short[has]] + j] + U(j + 101))
        doc, found = np.concatenate([doc, short]), np.concatenate([found, whole])
        order = np.argsort(doc, kind="stable")
        doc, found = doc[order], found[order]
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int64), found


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How often k-grams of each of 2 ** SKETCH_BITS counters occur."""
    slices = (1 << SKETCH_BITS) // SKETCH_SLICE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, codec = np.zeros(1 << SKETCH_BITS, np.uint32), pa.Codec("zstd")
        for batch in chunks(batches):
            counts += np.bincount((grams(batch, k)[1] >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
        parts = [codec.compress(x.tobytes(), asbytes=True) for x in counts.reshape(slices, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary())], ["bucket", "payload"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sums = pa.Codec("zstd"), {}
        for batch in batches:
            for b, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(codec.decompress(p.as_buffer(), SKETCH_SLICE * 4), np.uint32).astype(U)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["bucket", "payload"])

    out = np.zeros((slices, SKETCH_SLICE), U)
    # 8 MB, whatever the corpus
    for r in docs.select("text").mapInArrow(lean(count), PACKED).repartition(16, "bucket").mapInArrow(lean(add), PACKED).collect():
        out[r.bucket] = np.frombuffer(r.payload, U)
    return out.ravel()


def size_classes(counts: np.ndarray) -> np.ndarray:
    """0 for counters below twice the mean, then one more for each doubling, up to 15."""
    mean = max(1.0, float(counts.mean()))
    return np.clip(np.log2(np.maximum(counts.astype(float) / (2 * mean), 1)).astype(np.int64), 0, 15).astype(U)


def ordered_sets(batch: pa.RecordBatch, k: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text as numbers that sort as the order says: the class, then 60 bits of hash."""
    bounds, found = grams(batch, k)
    keys = (classes[(found >> U(64 - SKETCH_BITS)).astype(np.int64)] << U(60)) | (mix(found + U(7)) >> U(4))
    return sorted_sets(bounds, keys)


def fingerprints(bounds: np.ndarray, keys: np.ndarray) -> list[bytes | None]:
    """128 bits for each set; None for an empty one."""
    sums = np.zeros((len(keys) + 1, 2), U)
    np.cumsum(np.stack([mix(keys + U(11)), mix(keys + U(13))], axis=1), axis=0, out=sums[1:])
    prints = sums[bounds[1:]] - sums[bounds[:-1]]
    return [p.tobytes() if n else None for p, n in zip(prints, np.diff(bounds).tolist(), strict=True)]


def signatures(docs: DataFrame, k: int, num: int, den: int, classes) -> DataFrame:
    """doc_id, n, set_id, prefix_id and prefix of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            bounds, keys = ordered_sets(batch, k, classes.value)
            n = np.diff(bounds)
            length = np.minimum(n, n - ceil_share(n, num, den) + least_shared(n, num, den))
            length[den * n < num * (n + 1)] = 0  # so small that it links to equal sets only
            prefixes = [keys[a : a + m].tobytes() for a, m in zip(bounds[:-1].tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fingerprints(bounds, keys), pa.binary()), pa.array([xxhash.xxh3_128_digest(p) if p else None for p in prefixes], pa.binary()), pa.array(prefixes, pa.binary())],
                ["doc_id", "n", "set_id", "prefix_id", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(sign), "doc_id long, n long, set_id binary, prefix_id binary, prefix binary")


def shared_grams(groups: DataFrame, n: int) -> DataFrame:
    """groups(gid, n, prefix) to packed (gid, size, token, groups): each prefix n-gram of a group that another one has too.

    ``groups`` is in how many it is, COMMON + 1 at most.  Where a batch has more than
    COMMON groups for an n-gram, the number is known at once, and one record is sent to
    tell the other batches.
    """
    columns = {"gid": "<i8", "size": "<i4", "token": "<u8", "groups": "u1"}

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column(2)
            lengths = np.array([len(p.as_buffer()) // 8 for p in prefixes], np.int64)
            x = {"gid": np.repeat(batch.column(0).to_numpy(), lengths), "size": np.repeat(batch.column(1).to_numpy(), lengths).astype(np.int32)}
            x["token"] = np.concatenate([np.zeros(0, U), *(np.frombuffer(p.as_buffer(), U) for p in prefixes)])
            if not len(x["token"]):
                continue
            order = np.lexsort((x["gid"], x["token"]))
            x = {c: v[order] for c, v in x.items()}
            begins, counts = runs(x["token"])
            common = np.repeat(counts, counts) > COMMON
            x["groups"] = np.where(common, COMMON + 1, 1).astype(np.uint8)
            sent = ~common
            sent[begins] = True
            for kind, use in ((0, sent), (1, common)):
                key = x["token"] if kind == 0 else x["gid"].view(U)
                rows = scatter(key[use], {c: v[use] for c, v in x.items()}, n)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * rows.num_rows, pa.int32()), *rows.columns], ["kind", "bucket", "payload"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts = []
        for batch in batches:
            kind = batch.column(0).to_numpy()
            own = batch.filter(pa.array(kind == 1)).select(["bucket", "payload"])
            if own.num_rows:
                yield own
            posts.append(batch.filter(pa.array(kind == 0)))
        x = gather(posts, columns)
        order = np.argsort(x["token"], kind="stable")
        x = {c: v[order] for c, v in x.items()}
        begins, counts = runs(x["token"])
        if not len(begins):
            return
        told = np.repeat(np.maximum(np.maximum.reduceat(x["groups"], begins), np.minimum(counts, COMMON + 1)), counts).astype(np.uint8)
        use = (told > 1) & (x["groups"] == 1)  # the others know already
        x["groups"] = told
        if use.any():
            yield scatter(x["gid"][use].view(U), {c: v[use] for c, v in x.items()}, n)

    return exchange(groups.select("gid", "n", "prefix").mapInArrow(lean(post), f"kind int, {PACKED}"), n, lean(meet), PACKED, direct=True)


def family_links(shared: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): each group that shares enough of its prefix to link to another one at all, and a negative number for each n-gram by which it could."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = gather(batches, {"gid": "<i8", "size": "<i4", "token": "<u8", "groups": "u1"})
        order = np.lexsort((x["token"], x["groups"], x["gid"]))
        gid, size, token = (x[c][order] for c in ("gid", "size", "token"))
        if not len(gid):
            return
        begins, counts = runs(gid)
        place = np.arange(len(gid)) - np.repeat(begins, counts) + 1
        have = np.repeat(counts, counts)
        need = least_shared(ceil_share(size.astype(np.int64), num, den), num, den)
        keep = (have >= need) & (place <= have - need + 1)
        yield pa.RecordBatch.from_arrays([pa.array(gid[keep]), pa.array(-(token[keep] >> U(1)).astype(np.int64) - 1)], ["a", "b"])

    return exchange(shared, n, lean(link), "a long, b long", direct=True)


def places_of(sets: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, place in common) of each n-gram that is there, by place; one side at a time, since its arrays are as large as the sets."""
    if not len(common):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    grams = np.concatenate(sets)
    place = np.searchsorted(common, grams)
    known = common[np.minimum(place, len(common) - 1)] == grams
    del grams
    place = place[known].astype(np.int32)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])[known]
    order = np.argsort(place, kind="stable")
    return row[order], place[order]


def count_overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, by a matrix product over slices of the n-grams that both sides have."""
    if left is right:
        common, times = np.unique(np.concatenate(left), return_counts=True)
        common = common[times > 1]
    else:
        common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    ra, ca = places_of(left, common)
    rb, cb = (ra, ca) if left is right else places_of(right, common)
    for at in range(0, len(common), SLICE):
        p, q = np.zeros((len(left), SLICE), np.float32), np.zeros((len(right), SLICE), np.float32)
        i, j = np.searchsorted(ca, [at, at + SLICE])
        p[ra[i:j], ca[i:j] - at] = 1
        i, j = np.searchsorted(cb, [at, at + SLICE])
        q[rb[i:j], cb[i:j] - at] = 1
        out += p @ q.T
    return out.astype(np.int64)


def fitting(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of sets of these sizes may link."""
    small, large = np.minimum.outer(n, m), np.maximum.outer(n, m)
    return den * small >= num * large


def prefix_of(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    n = len(grams)
    return grams[: n - ceil_share(n, num, den) + least_shared(n, num, den)]


def group_pairs(n: np.ndarray, prefixes: list[np.ndarray], m: np.ndarray, others: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which groups (sizes n, prefixes) and others (m, others) may link: their sizes fit and their prefixes share enough.

    Of two sets that link, the l-th n-gram that both have is among the first
    n - ceil(t n) + l ones of either, so that their prefixes share the smaller l of the two.
    """
    fits = fitting(n, m, num, den)
    use = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
    if len(use[0]):
        left = [prefixes[i] for i in use[0]]
        both = count_overlaps(left, left if prefixes is others and np.array_equal(*use) else [others[i] for i in use[1]])
        least = np.minimum.outer(least_shared(n[use[0]], num, den), least_shared(m[use[1]], num, den))
        fits[np.ix_(*use)] &= both >= least
    return fits


def verify_unit(rows: dict[str, list], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A pair of blocks: (a, b) of a spanning forest of its links; (class, number of documents linked).

    Rows have side (0 or 1, or all 0 for a block with itself), node, copies, gid and grams.
    Pairs of groups are filtered before the members of any are compared.
    """
    _, own = np.unique(np.array(rows["node"], np.int64), return_index=True)  # a class once, whatever rows repeat it
    side, node, copies, gid = (np.array(rows[c], np.int64)[own] for c in ("side", "node", "copies", "gid"))
    sets = [rows["grams"][i] for i in own]
    one = not (side == 1).any()
    left = np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    none = np.zeros(0, np.int64)
    if not len(left) or not len(right):
        return none, none, none, none
    n = np.array([len(s) for s in sets], np.int64)

    def groups(members: np.ndarray):
        _, first, which = np.unique(gid[members], return_index=True, return_inverse=True)
        return n[members[first]], [prefix_of(sets[i], num, den) for i in members[first]], which

    ours = groups(left)
    theirs = ours if one else groups(right)
    pairs = group_pairs(*ours[:2], *theirs[:2], num, den)
    if one:
        pairs[np.diag_indices(len(pairs))] = True  # members of one group
    fits = pairs[np.ix_(ours[2], theirs[2])]
    if one:
        fits &= ~np.eye(len(left), dtype=bool)
    use = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
    if not len(use[0]):
        return none, none, none, none
    left, right, fits = left[use[0]], right[use[1]], fits[np.ix_(*use)]
    whole = [sets[i] for i in left]
    both = count_overlaps(whole, whole if np.array_equal(left, right) else [sets[i] for i in right])
    linked = fits & (den * both >= num * (n[left][:, None] + n[right][None, :] - both))
    i, j = np.nonzero(linked)
    a, b = forest(node[left][i], node[right][j])
    who = np.concatenate([node[left], none if one else node[right]])
    many = np.concatenate([linked @ copies[right], none if one else linked.T @ copies[left]])
    return a, b, who[many > 0], many[many > 0]


UNIT = "family long, i int, j int, side int"
SENT = pa.schema([("family", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("gid", pa.int64()), ("grams", pa.binary())])
SENT_BYTES = 4 << 20  # of sets in a batch for the units


def block_of(gid: np.ndarray, part: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (mix(mix(gid.view(U)) + part.view(U)) % blocks.astype(U)).astype(np.int64)


def units_of(own: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(which, family places): each item of block own[k] in every pair of blocks that its block is in."""
    which = np.repeat(np.arange(len(own)), blocks)
    other = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    mine = own[which]
    return which, {"i": np.minimum(mine, other), "j": np.maximum(mine, other), "side": (mine > other).astype(np.int64)}


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Where to cut items of these sizes so that a piece has ``most``, or one item."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def place_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups with their prefixes in each unit where they meet others, in batches of SENT_BYTES: a prefix goes to as many units as its family has blocks."""
    for batch in batches:
        gid, part, n, members, family, blocks = (batch.column(c).to_numpy().astype(np.int64) for c in range(6))
        row = pc.binary_length(batch.column(6)).to_numpy(zero_copy_only=False).astype(np.int64) + 52  # and the columns beside it
        own = block_of(gid, part, blocks)
        for begin, end in pieces(row * blocks, SENT_BYTES):
            all_, places = units_of(own[begin:end], blocks[begin:end])
            all_ += begin
            for a, b in pieces(row[all_], SENT_BYTES):  # more than one if a group alone is beyond it
                which = all_[a:b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(family[which]), *(pa.array(places[c][a:b], pa.int32()) for c in ("i", "j", "side")), *(pa.array(x[which]) for x in (gid, part, n, members)), batch.column(6).take(pa.array(which))],
                    ["family", "i", "j", "side", "gid", "part", "n", "members", "prefix"],
                )


def by_unit(f):
    """Rows in order of (family, i, j), the first columns, to f(columns of a unit), unit by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        for batch in batches:
            family, i, j = (batch.column(c).to_numpy() for c in (0, 1, 2))
            change = np.flatnonzero((family[1:] != family[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
                if a == b:
                    continue
                if (now := (int(family[a]), int(i[a]), int(j[a]))) != key:
                    if rows:
                        yield f(key, rows)
                    key, rows = now, {c: [] for c in batch.schema.names[3:]}
                part = batch.slice(a, b - a)
                for c in rows:
                    x = part.column(part.schema.get_field_index(c))
                    rows[c] += [np.frombuffer(v.as_buffer(), U) for v in x] if pa.types.is_binary(x.type) else x.to_pylist()
        if rows:
            yield f(key, rows)

    return run


def candidate_units(groups: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """groups(gid, part, n, members, family, blocks, prefix) to gid, part, family, i, j and side: where a group has one that it may link to, or members of its own to compare."""

    def filter_pairs(key: tuple[int, int, int], rows: dict[str, list]) -> pa.RecordBatch:
        x = np.array([rows[c] for c in ("gid", "part", "side", "n", "members")], np.int64)
        x, first = np.unique(x, axis=1, return_index=True)  # rows that repeat a document have its prefix again
        gid, part, side, n, members = x
        prefixes = [rows["prefix"][i] for i in first]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if key[1] == key[2]:
            pairs = group_pairs(n, prefixes, n, prefixes, num, den)
            pairs[np.diag_indices(len(n))] = members > 1
            wanted = np.flatnonzero(pairs.any(axis=1))
        else:
            pairs = group_pairs(n[left], [prefixes[i] for i in left], n[right], [prefixes[i] for i in right], num, den)
            wanted = np.concatenate([left[pairs.any(axis=1)], right[pairs.any(axis=0)]])
        k = len(wanted)
        return pa.RecordBatch.from_arrays(
            [pa.array(gid[wanted]), pa.array(part[wanted]), pa.array(np.full(k, key[0])), *(pa.array(np.full(k, v), pa.int32()) for v in key[1:]), pa.array(side[wanted], pa.int32())],
            ["gid", "part", "family", "i", "j", "side"],
        )

    placed = groups.select("gid", "part", "n", "members", "family", "blocks", "prefix").mapInArrow(lean(place_groups), f"{UNIT}, gid long, part long, n long, members long, prefix binary")
    return placed.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(lean(by_unit(filter_pairs)), f"gid long, part long, {UNIT}")


def verified(classes: DataFrame, docs: DataFrame, k: int, num: int, den: int, order, parts: int) -> DataFrame:
    """classes(node, rep, set_id, copies, gid, units) to (a, b, links): a spanning forest, b null where links counts those of a."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            bounds, keys = ordered_sets(batch, k, order.value)
            prints = fingerprints(bounds, keys)
            out: dict[str, list] = {c: [] for c in SENT.names}
            _, *rest = (batch.column(c).to_pylist() for c in ("text", "node", "set_id", "copies", "gid", "units"))
            held = 0
            for at, (node, set_id, copies, gid, units) in enumerate(zip(*rest, strict=True)):
                if prints[at] != set_id:  # another text of the same id
                    continue
                grams = keys[bounds[at] : bounds[at + 1]].tobytes()
                for u in units:
                    for c, v in zip(out, (u["family"], u["i"], u["j"], u["side"], node, copies, gid, grams), strict=True):
                        out[c].append(v)
                    held += len(grams)
                    if held > SENT_BYTES:  # a set goes to as many units as its family has blocks
                        yield pa.RecordBatch.from_pydict(out, SENT)
                        out, held = {c: [] for c in SENT.names}, 0
            if out["node"]:
                yield pa.RecordBatch.from_pydict(out, SENT)

    def done(key: tuple[int, int, int], rows: dict[str, list]) -> pa.RecordBatch:
        a, b, who, many = verify_unit(rows, num, den)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([a, who])), pa.array([*b.tolist(), *[None] * len(who)], pa.int64()), pa.array(np.concatenate([np.zeros(len(a), np.int64), many]))],
            ["a", "b", "links"],
        )

    placed = (
        docs.select("doc_id", "text").join(classes.hint("shuffle_hash"), F.col("doc_id") == F.col("rep"))
        .select("text", "node", "set_id", "copies", "gid", "units")
        .mapInArrow(lean(place), f"{UNIT}, node long, copies long, gid long, grams binary")
    )
    return placed.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(lean(by_unit(done)), "a long, b long, links long")


def with_classes(signed: DataFrame, by_class: DataFrame, n: int) -> DataFrame:
    """signed with the columns of its class; those without a set, and those in classes of very many, don't meet in one task."""
    alone = signed.where("set_id is null").withColumn("__found", F.lit(None).cast("struct<copies:long,component:long,links:long>"))
    joined = join_by_count(signed.where("set_id is not null"), by_class, "set_id", "copies", n)
    return alone.unionByName(joined).select(*signed.columns, "__found.component", "__found.links")


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id, n_links: one row for each row of docs."""
    with small_batches(docs.sparkSession):
        return _jaccard_components(docs, k, num, den)


def _jaccard_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = buckets_for(docs, BUCKET_BYTES)
    order = spark.sparkContext.broadcast(size_classes(sketch(docs, k)))
    signed = kept(signatures(docs, k, num, den, order), "signatures")
    slim = kept(signed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id")), "sets")
    classes = signed.where("doc_id is not null and set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("prefix_id").alias("prefix_id")
    )
    # a number for each class: an id may stand for two texts.  It is written, so that it stays
    classes = kept(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.where("prefix_id is not null")
    first = F.min(F.struct("node", "rep", "set_id")).alias("first")
    groups = kept(keyed.groupBy("n", "prefix_id").agg(first, F.count(F.lit(1)).alias("members")).select("n", "prefix_id", "members", F.col("first.node").alias("gid"), "first.rep", "first.set_id"), "groups")
    prefixes = signed.select(F.col("doc_id").alias("rep"), "set_id", "prefix").join(groups, ["rep", "set_id"]).select("gid", "n", "members", "prefix")
    links = family_links(shared_grams(prefixes, parts), parts, num, den)
    links = kept(links.unionByName(groups.where("members > 1").select(F.col("gid").alias("a"), F.col("gid").alias("b"))), "families")
    families = connected_components(links)
    alive = links.select(F.col("a").alias("gid")).distinct().join(families.withColumnRenamed("node", "gid"), "gid", "left").select("gid", F.coalesce("component", "gid").alias("family"))
    alive = kept(alive.join(groups.select("gid", "n", "members"), "gid"), "alive")
    # a block is bounded by the classes that its groups have, and by their n-grams
    total = F.sum("members")
    blocks = F.greatest(F.ceil(total / BLOCK), F.least(F.lit(SPREAD), F.ceil(total / SMALL_BLOCK)), F.ceil(F.sum(F.col("members") * F.col("n")) / BLOCK_GRAMS)).cast("int")
    sizes = alive.groupBy("family").agg(total.alias("_n"), blocks.alias("blocks")).where("_n > 1").drop("_n")
    # a group of many classes goes to the blocks in parts
    in_parts = F.ceil(F.col("members") / SMALL_BLOCK).cast("long")
    part = lambda key: F.pmod(F.xxhash64(key), in_parts)
    split = alive.join(sizes, "family").join(prefixes.select("gid", "prefix"), "gid").withColumn("part", F.explode(F.sequence(F.lit(0), in_parts - 1)))
    placed = split.select("gid", F.col("part").cast("long").alias("part"), "n", F.when(in_parts > 1, SMALL_BLOCK).otherwise(F.col("members")).cast("long").alias("members"), "family", "blocks", "prefix")
    units = candidate_units(placed, num, den, parts).groupBy("gid", "part").agg(F.collect_list(F.struct("family", "i", "j", "side")).alias("units"))
    expanded = keyed.select("node", "rep", "set_id", "copies", "n", "prefix_id").join(groups.select("n", "prefix_id", "gid", "members"), ["n", "prefix_id"]).withColumn("part", part("node"))
    candidates = expanded.join(units, ["gid", "part"]).select("node", "rep", "set_id", "copies", "gid", "units")
    candidates = kept(candidates, "candidates")
    forget(signed)  # prefixes are most of what is kept
    found = kept(verified(candidates, docs, k, num, den, order, parts), "links")
    forget(candidates)
    components = connected_components(found.where("b is not null").select("a", "b"))
    # the smallest id of a component
    linked = kept(components.join(classes.select("node", "rep"), "node"), "components")
    lowest = linked.groupBy("component").agg(F.min("rep").alias("lowest"))
    own = linked.join(lowest, "component").select("node", "lowest")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    by_class = (
        classes.select("set_id", "rep", "copies", "node").join(own, "node", "left").join(counts, "node", "left")
        .select("set_id", "copies", F.coalesce("lowest", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return with_classes(slim, by_class, slim.count()).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with one document of each component, the one of the smallest id; of rows that repeat another, one.

    Rows without a doc_id stay.
    """
    found = kept(jaccard_components(docs, **options).select("doc_id", "component_id"), "components")
    first = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__first")).count()
    stay = docs.join(first.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("__first"), "left_semi")
    repeated = first.where("count > 1").drop("count")
    if not repeated.isEmpty():
        stay = docs.join(first.where("count = 1").hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("__first"), "left_semi")
        again = docs.join(repeated, F.col("doc_id").cast("long") == F.col("__first"), "left_semi")
        stay = stay.unionByName(again.dropDuplicates(["doc_id", "text"]))
    return stay.unionByName(docs.where("doc_id is null"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS grams FROM d),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM p GROUP BY a)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM s JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""
