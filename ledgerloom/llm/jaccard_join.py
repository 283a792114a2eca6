"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles, each a 64-bit token; tokens are ordered by their value. Two sets of
Jaccard similarity t or more that keep the first ``n - ceil(t * n) + l`` tokens each have l of these in common.
Documents of equal sets are one. What a token costs is the number of pairs its documents would give; a costly
one is never expanded. A document whose prefix holds costly tokens gets a longer one, with as many more tokens
required in common, until one of the tokens in common must be cheap: pairs come from cheap tokens only, and
nothing is lost. Before verification a pair must also have enough tokens of both plain prefixes in common.

The first costly tokens of a document pair it with the first of its size in their list and with one neighbour in
random order, so that large groups of near copies become one component early and cost nothing more. Documents
that stay without enough cheap tokens, even in their whole sets, are compared within their lists, with documents
of other components; but for those that too many tokens of their own, or tokens lost against a document that both
have been compared with, already rule out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.packed import BUCKET_SCHEMA, bucketed, buffers, deal, held_until_full, mixed, multikey_order, range_hash, unpack
from ledgerloom.llm.shared import bounded_batches, lean, only, saved

#: A token is costly if its documents would give more pairs than COST and than COST_PER_DOC for each of them.
COST, COST_PER_DOC = 10, 2
#: Tokens kept beyond the plain prefix: this share of the set, and this many.
MORE_SHARE, MORE = 0.08, 8
BUCKET_ROWS, LATER_ROWS = 1_000_000, 100_000
#: Costly tokens of a document that pair it in the first and in the second round.
FIRST = (4, 6)
#: token, node, size of the set, place (1: in the plain prefix, 3: also among the first) and whether the row stands
#: for others that its task has seen to; later rounds add component - node, the last one also pivot - node, tokens in
#: common with the pivot, tokens that others may have but the pivot hasn't, and tokens that no other stuck document has.
ROW = ["<u8", "<i8", "<u4", "<u1", "<u1", "<i8", "<i8", "<u4", "<u4", "<u4"]
COLUMNS = (5, 6, 10)
PAIR = ["<i8", "<i8", "<i8", "<i8", "<i8"]
#: A task sees to the list of a costly token itself if it is as long as this, so no bucket gets all of it.
LONG = 256
#: Pairs of rows looked at in one go.
AT_ONCE = 1 << 17

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(b: pa.RecordBatch, words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the batch, ends, tokens): each row's distinct tokens, sorted, up to its end."""
    h = range_hash(5)
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for buf, starts, rows in buffers(b):
        low = LOWER[buf]
        word = ~SPACE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[starts] = True
        first = np.nonzero(word & np.concatenate([[True], ~word[:-1]])[: len(word)] | word & edge[:-1])[0]
        last = np.nonzero(word & (np.concatenate([~word[1:], [True]])[: len(word)] | edge[1:]))[0] + 1
        token = h.ranges(h.sums(low), first, last)
        doc = np.searchsorted(starts, first, side="right") - 1
        # Empty texts share their start with the next one: searchsorted gives the last of them, the right one.
        count = np.bincount(doc, minlength=len(rows))
        n = len(token) - words + 1
        tokens, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n > 0:
            whole = doc[:n] == doc[words - 1 :]
            mix = np.zeros(n, np.uint64)
            for k in range(words):
                mix = (mix ^ (mix >> np.uint64(29))) * odd[k] + token[k : k + n]
            tokens, owner = mixed(mix[whole]), doc[:n][whole]
        short = np.nonzero((count > 0) & (count < words))[0]
        at = np.cumsum(count) - count
        if len(short):
            seq = [np.bitwise_xor.reduce(mixed(token[at[d] : at[d] + count[d]] + odd[: count[d]] * np.uint64(count[d]))) for d in short.tolist()]
            tokens, owner = np.concatenate([tokens, np.array(seq, np.uint64)]), np.concatenate([owner, short])
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]) if len(tokens) else np.zeros(0, bool)
        yield rows, np.cumsum(np.bincount(owner[new], minlength=len(rows))), tokens[new]


def plain_prefix(n, t: int):
    """Tokens to keep so that a set of n tokens shares one with every set of similarity t percent."""
    return n + (-n * t // 100) + 1


def more_tokens(n: int) -> int:
    return ceil(MORE_SHARE * n) + MORE


def sketches(df: DataFrame, words: int, t: int) -> DataFrame:
    """doc_id, n, k1, k2 (128 bits of the set), head (first tokens): saved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for rows, ends, tokens in shingle_sets(b, words):
                n = np.diff(ends, prepend=0)
                at = ends - n
                keys = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
                some = np.nonzero(n)[0]
                if len(some):
                    keys[0][some] = np.add.reduceat(mixed(tokens ^ np.uint64(0x9E3779B97F4A7C15)), at[some])
                    keys[1][some] = np.bitwise_xor.reduceat(mixed(tokens + np.uint64(0xD1B54A32D192ED03)), at[some])
                heads = [tokens[a : a + min(k, plain_prefix(k, t) + more_tokens(k))].tobytes() for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(n), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(heads, pa.binary())], names=["doc_id", "n", "k1", "k2", "head"])

    return saved(df.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, k1 long, k2 long, head binary"), "sketches")


def list_pairs(rows: list[np.ndarray], t: int, final: bool, long: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """Pairs of rows sorted by token and size that tokens give, as columns a, b, na, nb, shared; a = b tells of a
    node: na tokens that others have too, nb costly ones, ``shared`` of these in its plain prefix. With ``long``:
    only for costly lists of that many rows, and which rows needn't be dealt any more."""
    token, node, n, place, seen = rows[:5]
    component = rows[5] if len(rows) > 5 else node
    n, klass, plain = n.astype(np.int64), size_class(n, t), place & 1
    pivot, both, beside, own = (x.astype(np.int64) for x in (rows[6:] if final else [node, n, n, 0 * n]))
    starts = np.nonzero(np.concatenate([[True], token[1:] != token[:-1]]))[0] if len(token) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(token))
    some = np.nonzero(ends - starts > max(1, long - 1))[0]
    pairs: list[np.ndarray] = []
    stars: list[np.ndarray] = []
    costly: list[np.ndarray] = []
    gone = np.zeros(len(token), bool)
    for lo, hi in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
        m = hi - lo
        c = np.unique(component[lo:hi], return_counts=True)[1]
        cost = (m * m - int((c * c).sum())) // 2
        if final or cost <= max(COST, COST_PER_DOC * m) and not seen[lo:hi].any():
            if not cost or long:
                continue
            step = max(1, AT_ONCE // m)
            for at in range(lo, hi, step):
                i, j = np.nonzero(component[at : min(at + step, hi), None] != component[None, at:hi])
                i, j = i + at, j + at
                ok = (i < j) & (100 * np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                # What two sets can have in common: no token of their own, and by way of a pivot of both what either
                # has in common with it, and of the rest what the pivot hasn't.
                most = np.minimum(n[i] - own[i], n[j] - own[j])
                by_pivot = np.minimum(both[i], both[j]) + np.minimum(beside[i], beside[j])
                most = np.where(pivot[i] == pivot[j], np.minimum(most, by_pivot), most)
                ok = most >= -(-t * (n[i] + n[j]) // (100 + t))
                pairs.append(np.stack([i[ok], j[ok]]))
        else:
            mine = np.arange(lo, hi)
            costly.append(mine[seen[lo:hi] == 0])
            first = lo + np.nonzero(np.concatenate([[True], klass[lo + 1 : hi] != klass[lo : hi - 1]]))[0]
            mine = mine[place[mine] > 1]
            centre = first[np.searchsorted(first, mine, side="right") - 1]
            mixed_up = mine[np.argsort(mixed(node[mine].view(np.uint64) ^ token[lo] ^ np.uint64(m)))]
            a, b = np.concatenate([centre, mixed_up[:-1]]), np.concatenate([mine, mixed_up[1:]])
            ok = component[a] != component[b]
            stars.append(np.stack([a[ok], b[ok]]))
            gone[lo:hi] = True
            gone[first] = False
    i, j = np.concatenate(pairs + stars, axis=1) if pairs or stars else np.zeros((2, 0), np.int64)
    both = plain[i].astype(np.int64) * plain[j]
    both[len(both) - sum(x.shape[1] for x in stars) :] = 0
    swap = node[i] > node[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    order = np.lexsort((node[j], node[i]))
    i, j, both = i[order], j[order], both[order]
    new = np.nonzero(np.concatenate([[True], (node[i][1:] != node[i][:-1]) | (node[j][1:] != node[j][:-1])]))[0] if len(i) else i
    i, j, shared = i[new], j[new], np.add.reduceat(both, new) if len(new) else new
    hot = np.concatenate(costly) if costly else np.zeros(0, np.int64)
    nodes, at = np.unique(node[hot], return_inverse=True)
    count, in_plain = (np.bincount(at, weights=w, minlength=len(nodes)).astype(np.int64) for w in (np.ones(len(hot)), plain[hot]))
    columns = ((node[i], nodes), (node[j], nodes), (n[i], count if long else count * 0), (n[j], count), (shared, in_plain))
    return [np.concatenate(x).astype(np.int64) for x in columns], gone


def size_class(n: np.ndarray, t: int) -> np.ndarray:
    """Sizes whose ratio is t percent or more are in the same class or in the next."""
    return np.floor(np.log(n) / -np.log(t / 100)).astype(np.int64)


def token_round(heads: DataFrame, tokens: int, t: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round over (node, component, n, head), with about ``tokens`` tokens in all heads: candidate pairs
    (a, b) and, per node, how many of the tokens of its head are costly. The second round (turn 1) has whole sets
    as heads and counts the tokens that others have too. In the third (turn 2) no token is costly, only plain
    prefixes are dealt, and heads come with pivot, both, beside and own."""
    final = turn == 2
    # Buckets are sized by rows alone: a pair is told once for each bucket, less often in few of them.
    buckets = tokens // (LATER_ROWS if turn else BUCKET_ROWS) + 1

    kinds = ROW[: COLUMNS[turn]]

    def prefixes(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        nodes, sizes = (b.column(c).to_numpy() for c in ("node", "n"))
        more = [b.column(c).to_numpy() for c in ("component", "pivot", "both", "beside", "own")[: len(kinds) - 5]]
        heads = b.column("head").to_pylist()
        for lo in range(0, len(heads), 1024):
            parts = [np.frombuffer(h, "<u8") for h in heads[lo : lo + 1024]]
            plain = plain_prefix(sizes[lo : lo + 1024], t)
            if final:
                parts = [x[:k] for x, k in zip(parts, plain.tolist(), strict=True)]
            m = np.array([len(x) for x in parts])
            place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            row = np.repeat(np.arange(lo, lo + len(parts)), m)
            at = (place < np.repeat(plain, m)).astype(np.uint8) * (1 + 2 * (place < FIRST[min(turn, 1)])).astype(np.uint8)
            rest = [x[row].astype(kind) for x, kind in zip(more, kinds[5:], strict=True)]
            yield [np.concatenate(parts), nodes[row], sizes[row].astype(np.uint32), at, np.zeros(len(row), np.uint8), *rest]

    def in_order(rows: list[np.ndarray]) -> list[np.ndarray]:
        order = multikey_order([rows[0], size_class(rows[2], t), rows[1]])
        return [x[order] for x in rows]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in held_until_full(x for b in batches for x in prefixes(b)):
            rows = in_order(rows)
            done, gone = list_pairs(rows, t, final, LONG)
            if len(done[0]):
                yield from deal((mixed(done[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), done, buckets, kind=1)
                # What is left of a long list stands for it.
                cut = np.unique(rows[0][gone])
                rows[4][np.isin(rows[0], cut)] = 1
                rows = [x[~gone] for x in rows]
            rows[5:7] = [x - rows[1] for x in rows[5:7]]
            where = (mixed(rows[0]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            yield from deal(where.astype(np.int64), rows, buckets)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: tuple[list, list] = ([], [])
        for b in batches:
            for x in b.column("rows").to_pylist():
                blobs[x[0]].append(x)
        rows = unpack(blobs[0], kinds)
        _, inverse, count = np.unique(rows[0], return_inverse=True, return_counts=True)
        rows = [x[count[inverse] > 1] for x in rows]
        rows[5:7] = [x + rows[1] for x in rows[5:7]]
        found, _ = list_pairs(in_order(rows), t, final)
        if turn == 1 and len(rows[0]):
            nodes, count = np.unique(rows[1][rows[4] == 0], return_counts=True)
            found = [np.concatenate(x) for x in zip(found, (nodes, nodes, count, count * 0, count * 0), strict=True)]
        for columns in (found, unpack(blobs[1], PAIR)):
            where = mixed(columns[0].view(np.uint64) ^ mixed(columns[1].view(np.uint64))) % np.uint64(buckets)
            yield from deal(where.astype(np.int64), columns, buckets)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each pair and node, of all that buckets tell of it."""
        c = unpack([x for b in batches for x in b.column("rows").to_pylist()], PAIR)
        if len(c[0]):
            order = np.lexsort((c[1], c[0]))
            a, b, na, nb, shared = (x[order] for x in c)
            at = np.nonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))[0]
            na, nb = (np.where(a[at] == b[at], np.add.reduceat(x, at), x[at]) for x in (na, nb))
            c = [a[at], b[at], na, nb, np.add.reduceat(shared, at)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=["a", "b", "na", "nb", "shared"])

    # Rows with a = b tell of a node.
    told = bucketed(bucketed(heads.mapInArrow(lean(send), BUCKET_SCHEMA), buckets).mapInArrow(lean(lists), BUCKET_SCHEMA), buckets)
    found = saved(told.mapInArrow(lean(combine), "a long, b long, na long, nb long, shared long"), "token-lists")
    costly = found.filter("a = b").select(F.col("a").alias("node"), F.col("nb").alias("costly"), F.col("shared").alias("costly_plain"), F.col("na").alias("common"))
    pairs = found.filter("a != b")
    for side in "ab":
        pairs = pairs.join(costly.select(F.col("node").alias(side), F.col("costly_plain").alias(f"h{side}")), side, "left")
    # Of the plain prefix that ends first, all tokens not in common are missing from the other set.
    most = F.col("shared") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    least = F.ceil((F.col("na") + F.col("nb")) * t / F.lit(100 + t))
    prefix = lambda n: n - F.ceil(n * t / F.lit(100)) + 1
    possible = (prefix(F.col("na")) - most <= F.col("na") - least) | (prefix(F.col("nb")) - most <= F.col("nb") - least)
    return pairs.filter(possible).select("a", "b"), costly


def verified(pairs: DataFrame, texts: DataFrame, words: int, t: int) -> DataFrame:
    """The pairs (a, b) by their whole texts (node, text): sizes na and nb of the sets and of what they share, and
    whether they link; saved. The smaller node's text meets those of all its partners; Spark can split a node with
    many."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for side in ("text_a", "text_b"):
                found: list[np.ndarray] = []
                for _, ends, tokens in shingle_sets(pa.RecordBatch.from_arrays([b.column(side)], names=["text"]), words):
                    found += np.split(tokens, ends[:-1])
                sets.append(found)
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)], np.int64)
            na, nb = (np.array([len(x) for x in side], np.int64) for side in sets)
            linked = (both > 0) & (100 * both >= t * (na + nb - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(na), pa.array(nb), pa.array(both), pa.array(linked)], names=["a", "b", "na", "nb", "both", "linked"])

    found = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return saved(found.mapInArrow(lean(run), "a long, b long, na long, nb long, both long, linked boolean"), "verified")


def pivots(seen: DataFrame, stuck: DataFrame) -> DataFrame:
    """For each node, of the ``stuck`` nodes that it was compared with and shares half of whose set or more, the one
    that most nodes were compared with, and how many tokens both have."""
    both = seen.select(F.col("b").alias("node"), F.col("a").alias("pivot"), F.col("na").alias("size"), "both").unionByName(seen.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.col("nb").alias("size"), "both"))
    known = both.join(stuck.select(F.col("node").alias("pivot")), "pivot", "left_semi").groupBy("pivot").agg(F.count("*").alias("uses"))
    best = both.filter("2 * both >= size").join(known, "pivot").groupBy("node").agg(F.max(F.struct("uses", "pivot", "both")).alias("p"))
    return best.select("node", F.col("p.pivot").alias("pivot"), F.col("p.both").alias("both"))


def set_heads(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``nodes`` (node, component and more, all long) with n and head, the whole sets as heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, ends, tokens in shingle_sets(b, words):
                parts = [x.tobytes() for x in np.split(tokens, ends[:-1])]
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in others), pa.array(np.diff(ends, prepend=0)), pa.array(parts, pa.binary())], names=[*others, "n", "head"])

    others = nodes.columns
    kinds = ", ".join(f"{c} long" for c in others)
    return texts.join(nodes, "node").select(*others, "text").mapInArrow(lean(run), f"{kinds}, n long, head binary")


def _components(df: DataFrame, words: int, t: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The saved sketches, each set's smallest doc_id, and the saved components of those."""
    bounded_batches(df.sparkSession)
    docs = df.select("doc_id", "text")
    sketch = sketches(docs, words, t)
    ceil_t = lambda n: F.ceil(n * t / F.lit(100))
    named = sketch.filter("n > 0 and doc_id is not null")
    heads = named.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "head")).alias("s"))
    heads = heads.select(F.col("s.doc_id").alias("node"), F.col("s.doc_id").alias("component"), F.col("s.n").alias("n"), F.col("s.head").alias("head"))
    pairs, costly = token_round(heads, int((named.agg(F.sum(F.length("head"))).first()[0] or 0) // 8), t, 0)
    pairs = saved(pairs, "pairs")
    # A document is stuck if its head can hold no cheap token more than its smallest partner's head must.
    smallest = ceil_t(F.col("n"))
    in_head = F.least(F.ceil(smallest * MORE_SHARE) + MORE, ceil_t(smallest) - 1)
    sizes = named.groupBy(F.col("doc_id").alias("node")).agg(F.min("n").alias("n"))
    stuck = saved(costly.join(sizes, "node").filter(F.col("costly") > in_head).select("node").distinct(), "stuck")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(stuck).distinct()
    texts = saved(docs.withColumnRenamed("doc_id", "node").join(wanted.hint("shuffle_hash"), "node", "left_semi"), "texts")
    seen = verified(pairs, texts, words, t)
    links = seen.filter("linked").select("a", "b")
    # Rows of one doc_id and several sets: all of these link.
    reps = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    twice = named.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y")).filter("x != y").select("doc_id")
    links = links.unionByName(named.join(twice, "doc_id").join(reps, ["k1", "k2"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b")).filter("a != b"))
    components = saved(connected_components(links), "components")
    own, first = None, stuck
    for turn in (1, 2):
        if stuck.isEmpty():
            break
        known = stuck.join(components, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        if turn == 2:
            # A pivot is stuck itself, so no token that is a node's own is its pivot's.
            known = known.join(own, "node").join(pivots(seen, first), "node", "left")
            known = known.select("node", "component", F.coalesce("pivot", "node").alias("pivot"), F.coalesce("both", "size").alias("both"), F.when(F.col("pivot").isNull(), 0).otherwise(F.col("size") - F.col("both") - F.col("own")).cast("long").alias("beside"), "own")
        tokens = int(stuck.join(sizes, "node").agg(F.sum("n")).first()[0])
        pairs, costly = token_round(set_heads(texts, known, words), tokens, t, turn)
        now = verified(saved(pairs, "pairs"), texts, words, t)
        seen, links = seen.unionByName(now), links.unionByName(now.filter("linked").select("a", "b"))
        components = saved(connected_components(links), "components")
        if turn == 1:
            # What no other has is missing from any partner: more of it than a link allows, and there is none.
            own = saved(costly.join(sizes, "node").filter(F.col("costly") > ceil_t(smallest) - 1).select("node", (F.col("n") - F.col("common")).alias("own"), (F.col("n") - smallest).alias("most"), F.col("n").alias("size")).filter("own <= most").drop("most"), "own")
            stuck = own.select("node")
    return sketch, reps, components


def similar_components(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of df (doc_id, text): documents link when the Jaccard
    similarity of their sets of ``words``-word shingles is ``percent`` percent or more.

    Words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer words is one shingle, one
    without words (or null) is empty and links with nothing. The component is the smallest doc_id reachable by
    links. Rows of one doc_id are one node: what links to one of them links to all. Rows without doc_id take no
    part and have no component; rows that repeat stay."""
    t = percent
    with only(df.sparkSession, "sketches", "components"):
        sketch, reps, components = _components(df, words, t)
    sets = reps.join(components, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    rows = sketch.join(sets, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
