"""Dependency contexts: climbing trees, context options, projectivisation.

Climbing runs on flattened node arrays, one vector step per depth for all
tokens of an Arrow batch; options are column expressions behind it.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.config import DepembedsConfig
from wordloom.operators.pairs import Lookup
from wordloom.operators.sampling import hashed_uniform
from wordloom.sources.corpus import NODE

ROOT_FORM = "<root>"
INVERSE, REGULAR = 0, 1
TYPED, UNTYPED = 0, 1
CONTEXT = ["kind", "direction", "depth", "dep_label", "form"]


def synthetic_trees(sentences: DataFrame) -> DataFrame:
    """Trees over plain sentences: token i (from 1) hangs on ``i div 2``."""
    node = lambda t, i: F.struct(
        (i + 1).cast("int").alias("id"),
        t.alias("form"),
        F.floor((i + 1) / 2).cast("int").alias("head"),
        F.concat(F.lit("r"), (F.length(t) % 4).cast("string")).alias("rel"),
    )
    return sentences.select("sent_id", F.transform("tokens", node).alias("nodes"))


class _Flat:
    """The nodes of a batch of trees in one row, heads as absolute positions.

    A head is found by its node's id within the tree; a head that is 0 or not
    in the tree is the root, -1.
    """

    def __init__(self, sent_ids: pa.Array, trees: pa.Array):
        offsets = trees.offsets.to_numpy()
        nodes = trees.flatten()
        sizes = np.diff(offsets)
        if trees.null_count:
            sizes = np.where(np.asarray(trees.is_null()), 0, sizes)
        self.tree = np.repeat(np.arange(len(sizes)), sizes)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.position = np.arange(len(self.tree)) - self.begin[self.tree]
        get = lambda i: nodes.field(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, heads = get(0), get(2)
        self.form, self.rel = nodes.field(1), nodes.field(3)
        key = self.tree << 32 | ids
        order = np.argsort(key, kind="stable")
        want = self.tree << 32 | heads
        at = np.searchsorted(key[order], want)
        hit = (at < len(key)) & (heads > 0)
        hit[hit] = key[order][at[hit]] == want[hit]
        self.head = np.full(len(ids), -1)
        self.head[hit] = order[at[hit]]
        self.sent_id = sent_ids.take(pa.array(self.tree))
        self.sizes = sizes
        self.longest = int(sizes.max(initial=0))


def _climb(flat: _Flat, max_depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(depth, node, current, head)`` of all tokens still below the root.

    Depth 0 means unlimited; a cycle ends after as many steps as its tree has nodes.
    """
    steps = flat.sizes[flat.tree]
    node = current = np.arange(len(flat.head))
    for depth in range(1, min(max_depth or flat.longest, flat.longest) + 1):
        head = flat.head[current]
        yield depth, node, current, head
        up = (head >= 0) & (depth < steps[node])
        node, current = node[up], head[up]
        if not len(node):
            return


def _emitted(flat: _Flat, max_depth: int) -> tuple[np.ndarray, ...] | None:
    """All contexts of a batch in order of emission: ``(node, seq, focus,
    direction, depth, rel_at, form_at)``.

    ``node`` is the climbing token and ``focus`` the token the context stands
    at, as absolute positions; ``form_at`` is -1 for the root.
    """
    found = []
    for d, node, current, head in _climb(flat, max_depth):
        found.append((node, np.zeros(len(node), np.int64), node, np.full(len(node), d), current, head))
        below = head >= 0
        node, head = node[below], head[below]
        found.append((node, np.ones(len(node), np.int64), head, np.full(len(node), d), node, node))
    if not found:
        return None
    node, direction, focus, depth, rel_at, form_at = map(np.concatenate, zip(*found))
    order = np.lexsort((direction, depth, node))
    node, direction, focus, depth, rel_at, form_at = (x[order] for x in (node, direction, focus, depth, rel_at, form_at))
    tree = flat.tree[node]
    first = np.concatenate([[0], np.flatnonzero(tree[1:] != tree[:-1]) + 1])
    seq = np.arange(len(tree)) - np.repeat(first, np.diff(np.append(first, len(tree))))
    return node, seq, focus, direction, depth, rel_at, form_at


def _context_batches(max_depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = _Flat(batch.column(0), batch.column(1))
        emitted = _emitted(flat, max_depth)
        if emitted is None:
            continue
        node, seq, focus, direction, depth, rel_at, form_at = emitted
        form = flat.form.take(pa.array(form_at, mask=form_at < 0))
        form = pa.compute.if_else(pa.array(form_at < 0), ROOT_FORM, form)
        yield pa.RecordBatch.from_arrays(
            [
                flat.sent_id.take(pa.array(node)),
                pa.array(seq, pa.int64()),
                pa.array(flat.position[focus], pa.int32()),
                pa.array(np.full(len(focus), TYPED), pa.int32()),
                pa.array(direction, pa.int32()),
                pa.array(depth, pa.int32()),
                pa.compute.fill_null(flat.rel, "").take(pa.array(rel_at)),
                form,
            ],
            names=["sent_id", "seq", "focus", *CONTEXT],
        )


def _path_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = _Flat(batch.column(0), batch.column(1))
        for d, node, _, head in _climb(flat, 0):
            form = pa.compute.if_else(pa.array(head < 0), ROOT_FORM, flat.form.take(pa.array(head, mask=head < 0)))
            yield pa.RecordBatch.from_arrays(
                [flat.sent_id.take(pa.array(node)), pa.array(flat.position[node], pa.int32()), pa.array(np.full(len(node), d), pa.int32()), form],
                names=["sent_id", "focus", "step", "form"],
            )


def root_paths(trees: DataFrame) -> DataFrame:
    """``(sent_id, focus, step, form)``: the forms on each token's way to the
    root, the root itself as ``<root>``."""
    return trees.select("sent_id", "nodes").mapInArrow(_path_batches, "sent_id long, focus int, step int, form string")


def dependency_contexts(trees: DataFrame, config: DepembedsConfig = DepembedsConfig()) -> DataFrame:
    """``(sent_id, seq, focus, kind, direction, depth, dep_label, form)``.

    ``seq`` is the order of emission within the sentence before filtering.
    An inverse context stands at the token that climbs and carries the
    relation of the edge just climbed and the head's form; a regular one
    stands at the head reached and carries the relation and form of the token
    that climbs.  Options apply in the order normalise, untyped, root filter.
    """
    source = projectivize(trees) if config.projectivize else trees.select("sent_id", "nodes")
    depth = config.depth
    out = source.mapInArrow(
        lambda it: _context_batches(depth, it),
        "sent_id long, seq long, focus int, kind int, direction int, depth int, dep_label string, form string",
    )
    if config.normalize:
        out = out.withColumn("form", F.lower("form"))
    if config.untyped:
        out = untyped(out)
    return out if config.use_root else out.where(F.col("form") != ROOT_FORM)


def untyped(contexts: DataFrame) -> DataFrame:
    """Contexts reduced to their form."""
    null = lambda t: F.lit(None).cast(t)
    return contexts.withColumns({"kind": F.lit(UNTYPED), "direction": null("int"), "depth": null("int"), "dep_label": null("string")})


def context_struct() -> Column:
    """The context as one value; its order is that of kind, direction, depth, label, form."""
    return F.struct(*CONTEXT)


#: Streams of the hashed draws of focus tokens and contexts.
KEEP_FOCUS, KEEP_CONTEXT = 2, 6
#: Contexts, and bytes of their texts, up to which the ranked contexts are sent to every executor.
LOOKUP_CONTEXTS, LOOKUP_BYTES = 1_000_000, 128 << 20


class _Ranked:
    """Words and ranked contexts for lookups without a join.

    Labels and forms become numbers, and a context one number made of them,
    its depth and its direction.
    """

    def __init__(self, words: pa.Table, contexts: pa.Table):
        self.word = Lookup(words["label"].combine_chunks())
        self.word_idx, self.word_keep = (words[c].to_numpy() for c in ("idx", "keep"))
        self.forms, self.rels = (Lookup(pa.compute.unique(contexts[c])) for c in ("form", "dep_label"))
        self.depths = int((pa.compute.max(contexts["depth"]).as_py() or 0) + 1)
        column = lambda c: contexts[c].fill_null(0).to_numpy().astype(np.int64)
        key = self.key(column("direction"), column("depth"), contexts["dep_label"].combine_chunks(), contexts["form"].combine_chunks())
        order = np.argsort(key)
        self.keys, self.idx, self.keep = key[order], column("idx")[order], contexts["keep"].to_numpy()[order]

    def key(self, direction: np.ndarray, depth: np.ndarray, rel, form) -> np.ndarray:
        """One number for each context, negative where no context can be known."""
        r, f = self.rels(rel), self.forms(form)
        key = ((f * max(len(self.rels.at), 1) + r) * self.depths + depth) * 2 + direction
        return np.where((f < 0) | (r < 0) | (depth >= self.depths), -1, key)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(output row, keep probability)``; -1 and 0 where unknown."""
        if not len(self.keys):
            return np.full(len(key), -1), np.zeros(len(key))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.idx[at], -1), np.where(hit, self.keep[at], 0.0)


def _pair_batches(config: DepembedsConfig, tables: tuple[pa.Table, pa.Table], epoch: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept focus tokens of a batch of trees with their surviving contexts."""
    ranked = _Ranked(*tables)
    for batch in batches:
        flat = _Flat(batch.column(0), batch.column(1))
        if not len(flat.tree):
            continue
        sent = flat.sent_id.to_numpy(zero_copy_only=False)
        word = ranked.word(flat.form)
        kept = word >= 0
        kept[kept] = hashed_uniform(KEEP_FOCUS, epoch, sent[kept], flat.position[kept]) < ranked.word_keep[word[kept]]
        node, seq, focus, direction, depth, rel_at, form_at = _emitted(flat, config.depth)
        shown = batch.column(2).flatten() if config.normalize else flat.form
        form = pa.compute.if_else(pa.array(form_at < 0), ROOT_FORM, shown.take(pa.array(form_at, mask=form_at < 0)))
        if config.untyped:
            none = np.zeros(len(node), np.int64)
            key = ranked.key(none, none, pa.nulls(len(node), pa.string()), form)
        else:
            key = ranked.key(direction, depth, pa.compute.fill_null(flat.rel, "").take(pa.array(rel_at)), form)
        output, keep = ranked.find(key)
        lucky = (output >= 0) & kept[focus]
        if not config.use_root:
            lucky &= ~pa.compute.equal(form, ROOT_FORM).fill_null(False).to_numpy(zero_copy_only=False)
        lucky[lucky] = hashed_uniform(KEEP_CONTEXT, epoch, sent[focus[lucky]], seq[lucky]) < keep[lucky]
        focus, output, seq = focus[lucky], output[lucky], seq[lucky]
        order = np.lexsort((seq, focus))
        at = np.flatnonzero(kept)
        sizes = np.bincount(focus, minlength=len(kept))[at]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        columns = [pa.array(sent[at]), pa.array(flat.position[at].astype(np.int32)), pa.array(ranked.word_idx[word[at]])]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(output[order]))], names=["sent_id", "pos", "focus_idx", "contexts"])


def _drawn(df: DataFrame, stream: int, epoch: int, key: str) -> DataFrame:
    """Add ``u``, drawn by ``sent_id`` and ``key``."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("sent_id", key))
            u = hashed_uniform(stream, epoch, *parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(u)], names=[*batch.schema.names, "u"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(draw, f"{fields}, u double")


def training_pairs(trees: DataFrame, config: DepembedsConfig, words: DataFrame, context_vocab: DataFrame, epoch: int = 0, lookup: int = LOOKUP_CONTEXTS) -> DataFrame:
    """``(sent_id, pos, focus_idx, contexts)`` of kept focus tokens.

    ``contexts`` are the surviving contexts as output rows in order of
    emission; a kept token without contexts stays with an empty array.
    Vocabularies of at most ``lookup`` entries and ``LOOKUP_BYTES`` are sent
    to the executors and everything happens inside the tree; larger ones are
    joined, contexts on one hash and then on all their columns.  Both ways
    give the same rows.
    """
    spark = trees.sparkSession
    source = (projectivize(trees) if config.projectivize else trees).select("sent_id", "nodes")
    slim = words.select("label", "idx", F.col("keep_prob").cast("double").alias("keep"))
    known = context_vocab.select(*CONTEXT, "idx", F.col("keep_prob").cast("double").alias("keep"))
    length = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    sizes = [*slim.agg(F.count(F.lit(1)), length("label")).first(), *known.agg(F.count(F.lit(1)), length("form") + length("dep_label")).first()]
    if max(sizes[0], sizes[2]) <= lookup and sizes[1] + sizes[3] <= LOOKUP_BYTES:
        shared = spark.sparkContext.broadcast((slim.toArrow(), known.toArrow()))  # sizes checked above
        lowered = source.withColumn("lower", F.transform("nodes", lambda n: F.lower(n["form"]))) if config.normalize else source
        shape = "sent_id long, pos int, focus_idx long, contexts array<long>"
        return lowered.mapInArrow(lambda it: _pair_batches(config, shared.value, epoch, it), shape)
    tokens = source.select("sent_id", F.posexplode(F.col("nodes.form")).alias("pos", "label")).join(slim, "label")
    focus = _drawn(tokens, KEEP_FOCUS, epoch, "pos").where(F.col("u") < F.col("keep")).select("sent_id", "pos", F.col("idx").alias("focus_idx"))
    contexts = dependency_contexts(source, replace(config, projectivize=False)).withColumn("h", F.xxhash64(*CONTEXT))
    ranked = known.select(F.xxhash64(*CONTEXT).alias("h"), *[F.col(c).alias(f"v_{c}") for c in CONTEXT], "idx", "keep")
    hits = contexts.join(ranked, "h")
    for c in CONTEXT:
        hits = hits.where(F.col(c).eqNullSafe(F.col(f"v_{c}")))
    hits = _drawn(hits.select("sent_id", "seq", F.col("focus").alias("pos"), "idx", "keep"), KEEP_CONTEXT, epoch, "seq").where(F.col("u") < F.col("keep"))
    lists = hits.groupBy("sent_id", "pos").agg(F.sort_array(F.collect_list(F.struct("seq", "idx"))).alias("found"))
    joined = focus.join(lists, ["sent_id", "pos"], "left")
    return joined.select("sent_id", "pos", "focus_idx", F.coalesce(F.col("found.idx"), F.array().cast("array<long>")).alias("contexts"))


def _tour(parent: list[int]) -> tuple[list[int], list[int], list[list[int]]] | None:
    """``(first, last, children)`` of a walk over the tree: the descendants of
    a node, and itself, are those with first numbers in its range.  None if a
    cycle keeps nodes from the root."""
    children: list[list[int]] = [[] for _ in parent]
    stack = []
    for i, p in enumerate(parent):
        (stack if p < 0 else children[p]).append(i)
    first, order = [0] * len(parent), []
    while stack:
        i = stack.pop()
        first[i] = len(order)
        order.append(i)
        stack += children[i]
    if len(order) < len(parent):
        return None
    size = [1] * len(parent)
    for i in reversed(order):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    return first, [f + n for f, n in zip(first, size)], children


def _crossed(parent: list[int], first: list[int], last: list[int]) -> list[int]:
    """Tokens whose arc spans a token that is no descendant of its head."""
    p, f, l = (np.array(x) for x in (parent, first, last))
    i = np.flatnonzero((p >= 0) & (np.abs(p - np.arange(len(p))) > 1))
    if not len(i):
        return []
    lo, hi = np.minimum(i, p[i]) + 1, np.maximum(i, p[i])
    level = np.floor(np.log2(hi - lo)).astype(int)
    least, most = np.empty(len(i), int), np.empty(len(i), int)
    low = high = f  # extremes over runs of 2^k tokens
    for k in range(int(level.max()) + 1):
        at = level == k
        least[at] = np.minimum(low[lo[at]], low[hi[at] - (1 << k)])
        most[at] = np.maximum(high[lo[at]], high[hi[at] - (1 << k)])
        step = 1 << k
        low, high = np.minimum(low[:-step], low[step:]), np.maximum(high[:-step], high[step:])
    head = p[i]
    return i[(least < f[head]) | (most >= l[head])].tolist()


def lift(parent: list[int]) -> list[int]:
    """Heads (positions, -1 for the root) after lifting: the shortest arc that
    is not projective, the leftmost of equals, moves to its head's head until
    none is left.

    A lift takes a subtree from one node only, so of all other arcs just those
    of that node can become non-projective, and only where they span the
    subtree.  Something with a cycle is no tree and comes out as it is.
    """
    tour = _tour(parent)
    if tour is None:
        return parent
    first, last, children = tour
    bad = _crossed(parent, first, last)
    if not bad:
        return parent
    parent, crossed = list(parent), set(bad)
    heap = [(abs(parent[i] - i), i) for i in bad]
    heapq.heapify(heap)

    def spans_stranger(i: int, head: int) -> bool:
        known = {head}
        for j in range(min(i, head) + 1, max(i, head)):
            path = []
            while j >= 0 and j not in known:
                path.append(j)
                j = parent[j]
            if j < 0:
                return True
            known.update(path)
        return False

    while heap:
        length, i = heapq.heappop(heap)
        old = parent[i]
        if i not in crossed or length != abs(old - i):
            continue
        crossed.discard(i)
        up = parent[old]
        children[old].remove(i)
        parent[i] = up
        rest = [c for c in children[old] if c not in crossed and abs(c - old) > 1]
        if rest:
            moved, stack = [], [i]
            while stack:
                moved.append(stack.pop())
                stack += children[moved[-1]]
            moved.sort()
            for c in rest:
                lo, hi = min(c, old), max(c, old)
                if bisect.bisect_right(moved, lo) < bisect.bisect_left(moved, hi):
                    crossed.add(c)
                    heapq.heappush(heap, (hi - lo, c))
        if up >= 0:
            children[up].append(i)
            if spans_stranger(i, up):
                crossed.add(i)
                heapq.heappush(heap, (abs(up - i), i))
    return parent


def _projective_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = _Flat(batch.column(0), batch.column(1))
        trees = batch.column(1)
        nodes = trees.flatten()
        parent = np.where(flat.head >= 0, flat.position[np.maximum(flat.head, 0)], -1) if len(flat.head) else flat.head
        ids, heads = (nodes.field(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (0, 2))
        heads = heads.copy()
        for begin, size in zip(flat.begin.tolist(), flat.sizes.tolist()):
            before = parent[begin : begin + size].tolist()
            after = lift(before)
            for i in (i for i in range(size) if after[i] != before[i]) if after is not before else ():
                heads[begin + i] = ids[begin + after[i]] if after[i] >= 0 else 0
        fields = [nodes.field(i) for i in range(4)]
        fields[2] = pa.array(heads.astype(np.int32))
        made = pa.StructArray.from_arrays(fields, names=["id", "form", "head", "rel"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(flat.sizes)]).astype(np.int32)), made)
        if trees.null_count:
            lists = pa.compute.if_else(trees.is_valid(), lists, pa.scalar(None, lists.type))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["sent_id", "nodes"])


def projectivize(trees: DataFrame) -> DataFrame:
    """Trees made projective by lifting arcs; relations keep their label.

    Projective trees come out as they are, also nodes with a cycle (no lift
    makes them a tree); null heads become 0.
    """
    return trees.select("sent_id", "nodes").mapInArrow(_projective_batches, f"sent_id long, nodes array<{NODE}>")
