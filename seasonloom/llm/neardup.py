r"""Near-duplicate documents by chosen-path set similarity join.

A document's set holds its distinct shingles of four words ([^\x20\x09-\x0D]+, A-Z lower-cased); with fewer words the
whole sequence is its one shingle, and without words the set is empty and linked with nothing. Documents are linked if
100 * |intersection| >= 80 * |union|; a component's smallest doc_id names it.

Equal sets form one class from the start, so copies of any number cost one row. Each class has a sketch of 64 minwise
tokens, and one token more for the root of each of eight independent trees. At a root all classes choose that token's
node; two sets of similarity s share it with probability s. Nodes with one class need no more work, and their sketches
stay where they are. Nodes of at most LEAF classes are compared exhaustively (by sketches, then what passes by whole
sets); larger nodes branch, again and again, by one or two positions of the sketch that the node's name selects, 1 / 0.8
on average. A pair of similarity s that meets in small nodes is missed with probability (1 - s) ^ 8 (0.2 ^ 8 at 0.8); in a
large node each branching passes it on with a probability of about 1 - (1 - s) ^ 1.25, so a pair that meets in large nodes
only is missed more often. Components need one path of links, so that what is measured (README) is higher than either.

Groups of near copies of any size stay cheap, as only links between different components matter. Before the trees
branch, the large root nodes of the first three are dealt into blocks that share a few pivots, which ties most of a
group together. The trees then know these components: a node within one component is done, a large one with few classes
outside its main component compares just these with all others, in blocks, and what else is large branches. Nodes that
are still large at the greatest depth are compared by pairs of blocks: that is the exact way for sets which are alike
without being linked, and its work is the square of their number. Nothing is capped or dropped. Candidates of all trees
are checked once, each equal group of them in one task. Edges of a node are a spanning forest, and components meet by
least-label propagation with pointer jumping on the executors.

What is shuffled: rows of numbers (node, id) for all trees; sketches (128 bytes) of classes in nodes that they share;
whole sets of classes with candidates, twice. Joins whose two sides grow with the data merge sorted rows at every size.

Null text is empty. Repeated rows are copies; classes whose smallest doc_id is the same count as one. Rows with a null
doc_id have the component of their class but never name it; alone they have a null component, and they aren't kept. An
empty table gives an empty result; other columns pass by. Texts are read whole, of any length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonloom.llm import textops
from seasonloom.llm.common import forget, maybe_among, stored

#: Words of a shingle; least similarity in hundredths; tokens of a sketch; trees, and those whose large roots are tied
#: first; classes of a node that is compared exhaustively; few classes outside a main component; greatest depth; pivots
#: of a block.
WIDTH, LEAST, TOKENS, TREES, TIED, LEAF, FEW, DEPTH, PIVOTS = 4, 80, 64, 8, 3, 256, 256, 14, 8
#: Least number of equal tokens to look at whole sets: 0.8 less four standard deviations.
SKETCH_LEAST = 38
#: Rows of a class from which its rows are joined apart: this or the rows' number by HOT_CLASSES, so that there are at
#: most HOT_CLASSES of them.
HOT_ROWS, HOT_CLASSES = 10_000, 100_000
MULTIPLIERS = np.random.default_rng(1).integers(0, 2**62, TOKENS + TREES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Of a class in a node.
COLUMNS = ["node", "id", "n", "f1", "label", "sketch"]


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts, sorted within each, and where each text's begin (one more at the end)."""
    words = textops.byte_words(texts, lower=True)
    hashes = words.hashes()
    sets, doc = textops.shingles(hashes, words.doc, WIDTH)
    counts = words.per_doc()
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        begins = np.searchsorted(words.doc, short)
        mult = textops.powers(np.uint64(0xA0761D6478BD642F), WIDTH + 1)
        whole = [textops.mixed((hashes[b : b + counts[d]] * mult[1 : 1 + counts[d]]).sum(keepdims=True) ^ np.uint64(counts[d])) for b, d in zip(begins, short)]
        sets, doc = np.concatenate([sets, *whole]), np.concatenate([doc, short])
    order = np.lexsort((sets, doc))
    sets, doc = sets[order], doc[order]
    fresh = np.ones(len(sets), dtype=bool)
    fresh[1:] = (sets[1:] != sets[:-1]) | (doc[1:] != doc[:-1])
    sets, doc = sets[fresh], doc[fresh]
    return sets, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, f1, f2, roots, sketch of each row: size, fingerprints, the trees' root nodes and minwise tokens (16 bits each) of its set."""

    def work(frames):
        for frame in frames:
            texts = [t or "" for t in frame["text"].where(frame["text"].notna(), "")]
            for a, b in textops.batches(texts):
                sets, begins = shingle_sets(texts[a:b])
                n = np.diff(begins)
                has = n > 0
                starts = begins[:-1][has]
                f1, f2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                tokens, roots = np.zeros((b - a, TOKENS), np.uint16), np.zeros((b - a, TREES), np.uint64)
                if len(starts):
                    f1[has] = np.add.reduceat(textops.mixed(sets ^ np.uint64(0x51)), starts)
                    f2[has] = np.add.reduceat(textops.mixed(sets ^ np.uint64(0xF2A3)), starts)
                    for j, m in enumerate(MULTIPLIERS):
                        least = textops.mixed(np.minimum.reduceat(sets * m, starts) ^ np.uint64(j))
                        if j < TOKENS:
                            tokens[has, j] = least & np.uint64(0xFFFF)
                        else:
                            roots[has, j - TOKENS] = least
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b].to_numpy(), "n": n, "f1": f1.view(np.int64), "f2": f2.view(np.int64), "roots": list(roots.view(np.int64)), "sketch": [t.tobytes() for t in tokens]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(work, "doc_id long, n long, f1 long, f2 long, roots array<long>, sketch binary")


def whole_groups(frames, key: str):
    """Frames whose rows, ordered by key, hold every group whole."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        last = frame[key].to_numpy() == frame[key].iloc[-1] if len(frame) else np.zeros(0, bool)
        rest = frame[last]
        if not last.all():
            yield frame[~last]
    if rest is not None and len(rest):
        yield rest


class Forest:
    """Disjoint sets of numbers 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def similar_pairs(tokens: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places a < b of a node's classes of different components whose sketches and sizes allow a link, with equal tokens, most first."""
    found = []
    for a in range(len(tokens) - 1):
        small, large = np.minimum(sizes[a], sizes[a + 1 :]), np.maximum(sizes[a], sizes[a + 1 :])
        rest = np.flatnonzero((100 * small >= LEAST * large) & (labels[a + 1 :] != labels[a])) + a + 1
        equal = (tokens[rest] == tokens[a]).sum(1)
        hit = equal >= SKETCH_LEAST
        if hit.any():
            found.append((np.full(hit.sum(), a), rest[hit], equal[hit]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    a, b, equal = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-equal, kind="stable")
    return a[order], b[order], equal[order]


def sketches(column) -> np.ndarray:
    """A column of sketches as rows of tokens."""
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, TOKENS)


def candidates(leaves: DataFrame) -> DataFrame:
    """gid and the columns of leaves but node: in each leaf, the groups of classes tied by similar sketches; equal groups of different leaves once."""

    def work(frames):
        done = set()
        for frame in whole_groups(frames, "node"):
            tokens = sketches(frame["sketch"])
            ids, sizes, labels = (frame[c].to_numpy() for c in ("id", "n", "label"))
            node = frame["node"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
            keep, gids = [], []
            for start, end in zip(cuts[:-1], cuts[1:]):
                a, b, _ = similar_pairs(tokens[start:end], sizes[start:end], labels[start:end])
                if not len(a):
                    continue
                forest = Forest(end - start)
                for x, y in zip(a.tolist(), b.tolist()):
                    forest.join(x, y)
                groups: dict[int, list[int]] = {}
                for x in sorted({*a.tolist(), *b.tolist()}):
                    groups.setdefault(forest.root(x), []).append(start + x)
                for members in groups.values():
                    members = sorted(set(members), key=lambda k: ids[k])
                    gid = int(textops.mixed((textops.mixed(ids[members].view(np.uint64)) * textops.powers(textops.STEP, len(members))).sum(keepdims=True)).view(np.int64)[0])
                    if gid not in done:
                        if len(done) > 200_000:
                            done.clear()
                        done.add(gid)
                        keep += members
                        gids += [gid] * len(members)
            if keep:
                yield frame.iloc[keep][["id", "n", "f1", "label", "sketch"]].assign(gid=gids)[["gid", "id", "n", "f1", "label", "sketch"]]

    ordered = leaves.select(COLUMNS).repartition("node").sortWithinPartitions("node", "id")
    found = ordered.mapInPandas(work, "gid long, id long, n long, f1 long, label long, sketch binary")
    return found.dropDuplicates(["gid", "id"])  # a pair meets in most trees, but its sets need only come once


def whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, f1, shingles (bytes of sorted hashes) of the documents with the wanted ids, and of few others."""

    def work(frames):
        for frame in frames:
            texts = list(frame["text"])
            for a, b in textops.batches(texts):
                sets, begins = shingle_sets(texts[a:b])
                f1 = [int(textops.mixed(sets[s:e] ^ np.uint64(0x51)).sum(keepdims=True).view(np.int64)[0]) for s, e in zip(begins[:-1], begins[1:])]
                yield pd.DataFrame({"id": frame["id"].iloc[a:b].to_numpy(), "f1": f1, "shingles": [sets[s:e].tobytes() for s, e in zip(begins[:-1], begins[1:])]})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    likely = maybe_among(texts, wanted, "id").where("maybe").drop("maybe")
    return likely.mapInPandas(work, "id long, f1 long, shingles binary").dropDuplicates(["id", "f1"])


def verified(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between the groups' classes on whole sets, those that are needed to tie a group together."""

    def work(frames):
        for frame in whole_groups(frames, "gid"):
            out = []
            for _, own in frame.groupby("gid", sort=False):
                tokens = sketches(own["sketch"])
                ids, labels = own["id"].to_numpy(), own["label"].to_numpy()
                raw, sets = own["shingles"].to_numpy(), {}
                forest, of = Forest(len(ids)), {}
                for k, label in enumerate(labels.tolist()):
                    forest.join(of.setdefault(label, k), k)
                for a, b, _ in zip(*similar_pairs(tokens, own["n"].to_numpy(), labels)):
                    if forest.root(a) != forest.root(b):
                        for k in (a, b):
                            if k not in sets:
                                sets[k] = np.frombuffer(raw[k], np.uint64)
                        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if 100 * both >= LEAST * (len(sets[a]) + len(sets[b]) - both):
                            forest.join(a, b)
                            out.append((ids[a], ids[b]))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    full = groups.join(sets.hint("merge"), ["id", "f1"]).repartition("gid").sortWithinPartitions("gid", "id")
    return full.select("gid", "id", "n", "label", "sketch", "shingles").mapInPandas(work, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, label of the vertices of edges (a, b): the least id that can be reached. Least labels pass along edges and
    then jump to their label's label, so the rounds grow with the logarithm of a component's width."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    labels = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        passed = labels.join(near, labels["id"] == near["u"]).select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        passed = stored(passed, "passed")
        jump = passed.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = stored(passed.join(jump, "label").select("id", F.col("next").alias("label"), "was"), "labels")
        forget(labels, passed)
        if not after.where("label != was").head(1):
            return after
        labels = after


def token_at(position: str) -> str:
    """SQL of the node that a class goes to by its token at a position of its sketch."""
    return f"xxhash64(node, {position}, substring(sketch, 2 * ({position}) + 1, 2))"


def in_blocks(rows: DataFrame, shared: str) -> DataFrame:
    """rows of nodes dealt into blocks of about LEAF by id; those that the condition shared names go to every block."""
    rows = rows.withColumn("blocks", F.ceil(F.col("total") / LEAF).cast("int")).withColumn("every", F.expr(shared))
    own = F.pmod(F.xxhash64("node", "id", F.lit("block")), F.col("blocks")).cast("int")
    return rows.withColumn("block", F.explode(F.when(F.col("every"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))).withColumn("node", F.xxhash64("node", "block", F.lit("block")))


def branched(roots: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """All leaves below the large nodes roots (COLUMNS), and the tables that hold them."""
    leaves, held, frontier, depth = [], [], roots, 0
    while True:
        by_label = frontier.groupBy("node", "label").agg(F.count(F.lit(1)).alias("rows"))
        stats = by_label.groupBy("node").agg(F.sum("rows").alias("total"), F.max(F.struct("rows", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        stats = stored(stats.select("node", "total", F.col("top.rows").alias("top_rows"), F.col("top.label").alias("top_label")), "node-stats")
        placed = stored(frontier.join(stats, "node"), "nodes")
        held.append(placed)
        leaves.append(placed.where(F.col("total") <= LEAF).select(COLUMNS))
        large = placed.where(F.col("total") > LEAF)
        more = stats.where(F.col("total") > LEAF).head(1)
        forget(stats)
        if not more:
            break
        few = f"total - top_rows <= {FEW}"
        leaves.append(in_blocks(large.where(few), "label != top_label").select(COLUMNS))
        large, depth = large.where(f"not ({few})"), depth + 1
        if depth == DEPTH:
            # pairs of blocks: every two classes meet in one of them
            half = large.withColumn("blocks", F.ceil(2 * F.col("total") / LEAF).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", "id", F.lit("half")), F.col("blocks")).cast("int"))
            half = half.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            leaves.append(half.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"), F.lit("pair"))).select(COLUMNS))
            break
        one, two = f"pmod(xxhash64(node, 'one'), {TOKENS})", f"pmod(xxhash64(node, 'two'), {TOKENS})"
        child = F.expr(f"explode(if(pmod(xxhash64(node, 'more'), {100 // (100 - LEAST) - 1}) > 0, array({token_at(one)}), array({token_at(one)}, {token_at(two)})))")
        frontier = large.select(child.alias("child"), *COLUMNS[1:]).withColumnRenamed("child", "node")
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out, held


def links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """id, label of the classes that have links: their components; None if there is no link."""

    def checked(leaves: DataFrame) -> DataFrame:
        groups = stored(candidates(leaves), "candidates")
        found = stored(verified(groups, whole_sets(docs, groups.select("id").distinct(), id_col, text_col)), "links")
        forget(groups)
        return found

    sets = classes.select("id", "n", "f1", "sketch")
    rooted = classes.select("id", "f1", F.posexplode("roots").alias("tree", "node"))
    counts = stored(rooted.groupBy("node").agg(F.count(F.lit(1)).alias("total")).where("total > 1"), "node-counts")
    placed = stored(rooted.join(counts.hint("merge"), "node"), "placed")
    edges, held = None, [counts, placed]
    if counts.where(F.col("total") > LEAF).head(1):
        large = placed.where((F.col("total") > LEAF) & (F.col("tree") < TIED)).join(sets, ["id", "f1"]).withColumn("label", F.col("id"))
        edges = checked(in_blocks(large, f"pmod(xxhash64(node, id, 'pivot'), total) < {PIVOTS}"))
        labels = components(edges)
        placed = placed.join(labels.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        several = placed.groupBy("node").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("node")
        several = stored(several, "nodes-of-several")
        placed = stored(placed.join(several.hint("merge"), "node"), "placed")
        forget(labels)
        held += [several, placed]
    else:
        placed = placed.withColumn("label", F.col("id"))
    rows = placed.join(sets.hint("merge"), ["id", "f1"])
    small, nodes = rows.where(F.col("total") <= LEAF).select(COLUMNS), []
    if edges is not None:
        leaves, nodes = branched(rows.where(F.col("total") > LEAF).select(COLUMNS))
        small = small.unionByName(leaves)
    found = checked(small)
    forget(*held, *nodes)
    edges = found if edges is None else stored(edges.unionByName(found), "links")
    return components(edges) if edges.head(1) else None


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id and kept of each row: the document with a component's smallest id is kept."""
    sigs = stored(signatures(docs, id_col, text_col), "signatures")
    classes = sigs.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch"))
    classes = stored(classes.where("id is not null"), "classes")
    labels = links(docs, classes, id_col, text_col)
    named = classes.select("n", "f1", "f2", "id", "copies")
    named = named.join(labels.select("id", "label"), "id", "left") if labels is not None else named.withColumn("label", F.lit(None).cast("long"))
    named = stored(named.select("n", "f1", "f2", "copies", F.coalesce("label", "id").alias("component")).where("copies > 1 or component != id"), "class-components")
    forget(classes, *([labels] if labels is not None else []))
    # rows of the few largest classes are joined by a broadcast of bounded size, all others have no hot key
    hot_rows = max(HOT_ROWS, -(-sigs.count() // HOT_CLASSES))
    key = ["n", "f1", "f2"]
    rows = sigs.select("doc_id", *key)
    hot = named.where(F.col("copies") > hot_rows).select(*key, F.col("component").alias("hot"))
    rows = rows.join(F.broadcast(hot), key, "left")
    cold = rows.where("hot is null and n > 0").join(named.where(F.col("copies") <= hot_rows).select(*key, "component"), key, "left")
    found = cold.select("doc_id", "n", "component").unionByName(rows.where("hot is not null or n = 0").select("doc_id", "n", F.col("hot").alias("component")))
    out = found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
