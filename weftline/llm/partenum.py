"""N-gram Jaccard join by PartEnum signatures.

Two sets of similarity t or more, of sizes a and b, differ in at most k = (1 - t) / (1 + t) * (a + b)
features. Sets are put into bands of like size. A band partitions the domain of features into n1
parts, each of n2 cells; a part in which two sets differ in k2 features at most has a subset of
n2 - k2 cells in which they are equal, so for each part all such subsets are enumerated and the
features in each are hashed to one signature. As at most k / (k2 + 1) parts differ in more, a set
signs its parts in order until it has signed one more than that of those that cannot be empty in
any subset ("strong" ones, of more than k2 filled cells), and a few to spare: a similar pair has
more signatures in common than the spare ones. A set whose similar sets may be in the next band
signs in that as well. ``Scheme`` has each band's n1, n2, k2 and spare parts: subsets of two of
three cells for small sets, and for large ones, whose signatures are what costs, whole parts (k2 = 0).

Sets that share signatures enough are candidates. Small groups are compared in full. In a large one every
member is compared with one leader, so a group of near copies makes as many pairs as it has
members. Where that leaves a large group in several parts (texts that share common passages), the
features that the same members have are one passage, and each member enumerates the subsets of its
passages that hold enough of it for a link: two similar ones have the subset of all that both hold. Within
one subset's group all links follow from those to its member of fewest other features, so that texts put
together from common paragraphs make no pairs of their number squared. Members with too many subsets, or
of too many short passages, are compared by their rarest features, of which the first quarter and one must
meet. So no link is lost. Candidates are verified by histograms, which never hide a likeness, and then by
their whole sets.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import stash, texts
from weftline.llm.graph import components, grown
from weftline.llm.shingles import mix, shingle_set

#: Similarity as a fraction of whole numbers, so that limits are exact.
SIMILARITY = (75, 100)
#: Sizes below which a band's parts have three cells, of which all pairs are enumerated.
SMALL_SETS = 128
#: Bits of a signature that hold its band (sets of up to 2^32 features).
BAND_BITS = np.uint64(31)
#: Documents whose ids are broadcast when their texts are read again (16 MB); more are joined.
BROADCAST_IDS = 2_000_000
#: Members up to which a group is compared in full.
SMALL_GROUP = 12
#: Subsets of passages that a text enumerates at most; texts of more are compared by rare features.
MOST_SUBSETS = 256


def histogram(features: np.ndarray) -> bytes:
    """Features by their leading bits, about two to a bin; 255 stands for that many or more."""
    bits = max(3, (len(features) // 2).bit_length())
    return np.minimum(np.bincount((features >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_share(a: bytes, b: bytes) -> int:
    """No less than the features that two sets have in common."""
    x, y = (np.frombuffer(h, np.uint8).astype(np.int64) for h in (a, b))
    if max(x.max(), y.max()) == 255:
        return 1 << 62
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(n, -1).sum(axis=1), y.reshape(n, -1).sum(axis=1)).sum())


@dataclass(frozen=True)
class Scheme:
    """How the band of sizes ``low`` .. 2 * ``low`` - 1 is signed."""

    low: int

    @property
    def top(self) -> int:
        return 2 * self.low - 1

    @property
    def cells(self) -> int:
        return 3 if 16 <= self.low < SMALL_SETS else 1

    @property
    def spoiled(self) -> int:
        """k2: features by which two sets may differ in a part and still share a signature of it."""
        return 1 if self.cells > 1 else 0

    @property
    def parts(self) -> int:
        """n1: so many that nearly every set of the band, or just below it, has strong parts enough."""
        return self.top * (20 if self.cells > 1 else 36) // 100 + (2 if self.cells > 1 else 4)

    @property
    def spare(self) -> int:
        """Strong parts that are signed beyond those of which one must be shared."""
        return self.top // (100 if self.cells > 1 else 50)

    @property
    def subsets(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.cells), self.cells - self.spoiled))


def most_apart(a: int, b: int, similarity: tuple[int, int]) -> int:
    """Features that are in one only of two similar sets of these sizes, at most."""
    num, den = similarity
    return (den - num) * (a + b) // (den + num)


def signatures(s: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """The signatures of a set of hashed features, ascending, in its band and, where it must, in the next."""
    n, (num, den) = len(s), similarity
    if not n:
        return s
    own = Scheme(1 << (n.bit_length() - 1))
    largest = n * den // num
    out, spread = [], mix(s)
    for scheme in (own, Scheme(2 * own.low)):
        if scheme is own or largest > own.top:
            out.append(signed_in(s, spread, scheme, most_apart(n, min(largest, scheme.top), similarity)))
    return np.concatenate(out)


def signed_in(s: np.ndarray, spread: np.ndarray, scheme: Scheme, apart: int) -> np.ndarray:
    """Signatures in one band, for partners that differ in at most ``apart`` features."""
    n_cells = scheme.cells
    place = ((s >> np.uint64(32)) * np.uint64(scheme.parts)) >> np.uint64(32)
    if n_cells > 1:
        place = place * np.uint64(n_cells) + (((s & np.uint64(0xFFFFFFFF)) * np.uint64(n_cells)) >> np.uint64(32))
        order = np.argsort(place, kind="stable")
        place, spread = place[order], spread[order]
    place = place.astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    cells, sums = place[first], np.add.reduceat(spread, first)  # those that are filled, in order

    strong = np.flatnonzero(np.bincount(cells // n_cells, minlength=scheme.parts) > scheme.spoiled)
    quota = apart // (scheme.spoiled + 1) + 1 + scheme.spare
    enough = len(strong) >= quota
    parts = int(strong[quota - 1]) + 1 if enough else scheme.parts
    held, filled = np.zeros(parts * n_cells, dtype=np.uint64), np.zeros(parts * n_cells, dtype=bool)
    here = int(np.searchsorted(cells, parts * n_cells))
    held[cells[:here]], filled[cells[:here]] = mix(sums[:here]), True
    held, filled = held.reshape(parts, n_cells), filled.reshape(parts, n_cells)
    out = []
    for k, subset in enumerate(scheme.subsets):
        total, some = np.full(parts, (scheme.low << 34) + (k << 32), dtype=np.uint64) + np.arange(parts, dtype=np.uint64), np.zeros(parts, dtype=bool)
        for c in subset:
            total, some = mix(total) + held[:, c], some | filled[:, c]
        out.append(mix(total[some]))
    if not enough:  # sets with too few strong parts meet each other by single features, the finest parts of the domain
        out.append(mix(s[: apart + 1 + scheme.spare] + np.uint64(scheme.low)))
    # The last bits tell the band.
    return np.concatenate(out) & ~BAND_BITS | np.uint64(scheme.low.bit_length() - 1)


def spare_of(sig: str = "sig") -> Column:
    """``Scheme.spare`` of a signature's band."""
    bands = F.array(*[F.lit(Scheme(1 << k).spare) for k in range(int(BAND_BITS) + 1)])
    return F.element_at(bands, F.col(sig).bitwiseAND(int(BAND_BITS)).cast("int") + 1)


SIGNED = "node long, sig long, x long, bins binary"


def signed(docs: DataFrame, similarity: tuple[int, int], words: int) -> DataFrame:
    """node, sig, x, bins: a row for each signature (x 0), and of each text two more: x > 0 hashes its set, x < 0 is -1 - its size (with bins)."""

    def run(batches):
        for batch in batches:
            nodes, sigs, marks, bins = [], [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_buffer().to_pybytes(), words)
                n = len(s)
                # Two rows of the text's own, told apart by a bit within unsigned numbers, so that any long is a node.
                own = mix(mix(np.array([node, node], dtype=np.int64).view(np.uint64)) ^ np.array([0, 1], dtype=np.uint64))
                sig = np.concatenate([own, signatures(s, similarity)]).view(np.int64)
                mark = np.zeros(len(sig), dtype=np.int64)
                mark[:2] = int(mix(s).sum()) >> 1 | 1 if n else 1, -1 - n
                nodes.append(np.full(len(sig), node))
                sigs.append(sig)
                marks.append(mark)
                bins += [None, histogram(s), *[None] * (len(sig) - 2)]
                if len(nodes) == 256:
                    yield rows(nodes, sigs, marks, bins)
                    nodes, sigs, marks, bins = [], [], [], []
            if nodes:
                yield rows(nodes, sigs, marks, bins)

    def rows(nodes, sigs, marks, bins):
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c), pa.int64()) for c in (nodes, sigs, marks)), pa.array(bins, pa.binary())], names=["node", "sig", "x", "bins"])

    return texts(docs).where(F.col("doc_id").isNotNull()).mapInArrow(run, SIGNED)


def shared(rows: DataFrame) -> DataFrame:
    """Rows of signatures that more than one node has, with their number ``c`` and a ``leader``.

    Leaders are drawn by hash, in four ways, so that one odd text does not lead all groups of its kind.
    """
    drawn = F.min(F.struct(F.xxhash64("node", F.pmod("sig", F.lit(4))).alias("draw"), "node"))
    found = rows.groupBy("sig").agg(F.count("*").alias("c"), drawn["node"].alias("leader")).where("c > 1")
    return rows.join(found, "sig")


def promising(groups: DataFrame) -> DataFrame:
    """The rows of sets that have, in the row's band, more signatures in common with others than the spare ones."""
    groups = groups.withColumn("band", F.col("sig").bitwiseAND(int(BAND_BITS)).cast("int"))
    own = Window.partitionBy("node", "band")
    large = F.sum((F.col("c") > SMALL_GROUP).cast("long")).over(own)
    return groups.withColumns({"shared": F.count("*").over(own), "large": large}).where(F.col("shared") > spare_of()).drop("shared")


def candidates(groups: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of small groups with as many common signatures as a similar pair has; leader and member of other groups.

    Signatures that a pair may have in common in large groups are not counted against it.
    """
    num, den = similarity
    small = groups.where(f"c <= {SMALL_GROUP}").select("sig", "node", "n", "large")
    met = small.toDF("sig", "a", "na", "la").join(small.toDF("sig", "b", "nb", "lb"), "sig").where(f"a < b AND {num} * greatest(na, nb) <= {den} * least(na, nb)")
    met = met.groupBy("a", "b", F.col("sig").bitwiseAND(int(BAND_BITS)).cast("int").alias("band"), spare_of().alias("spare")).agg(F.count("*").alias("common"), F.min(F.least("la", "lb")).alias("large"))
    star = groups.where(f"c > {SMALL_GROUP} AND node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    return met.where("common + large > spare").select("a", "b").union(star).distinct()


def verified(docs: DataFrame, sizes: DataFrame, pairs: DataFrame, similarity: tuple[int, int], words: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: by histograms, which never hide a likeness, then by the whole sets."""
    num, den = similarity

    def comparing(parse, shared):
        def compare(batches):
            for batch in batches:
                near = []
                for a, b, na, nb in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                    fits = num * max(na, nb) <= den * min(na, nb)
                    near.append(fits and (num + den) * shared(parse(a), parse(b)) >= num * (na + nb))
                mask = pa.array(near, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

        return compare

    def sets(batches):
        for batch in batches:
            whole = [shingle_set(t.as_buffer().to_pybytes(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in whole], pa.binary()), pa.array([len(s) for s in whole], pa.int64())], names=["node", "s", "n"])

    def common(x: np.ndarray, y: np.ndarray) -> int:
        if not len(x) or not len(y):
            return 0
        at = np.searchsorted(y, x)
        return int((y[np.minimum(at, len(y) - 1)] == x).sum())

    def kept(pairs: DataFrame, rows: DataFrame, compare) -> DataFrame:
        met = pairs.join(rows.toDF("a", "sa", "na"), "a").join(rows.toDF("b", "sb", "nb"), "b").select("a", "b", "sa", "sb", "na", "nb")
        return stash(met.mapInArrow(compare, "a long, b long").distinct(), "near")

    pairs = kept(pairs, sizes.select("node", "bins", "n"), comparing(bytes, may_share))
    wanted = stash(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    rows = stash(of_nodes(docs, wanted).mapInArrow(sets, "node long, s binary, n long"), "sets")
    return kept(pairs, rows, comparing(lambda s: np.frombuffer(s, np.uint64), common))


def of_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, text of the documents in ``nodes`` (node); the ids are broadcast while they are few enough."""
    if nodes.count() <= BROADCAST_IDS:
        nodes = F.broadcast(nodes)
    return texts(docs).join(nodes, F.col("doc_id") == F.col("node"), "left_semi")


def groups_of(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for every doc_id.

    Documents link at Jaccard similarity ``similarity`` or more of their sets of distinct word
    shingles; component_id is the smallest doc_id reachable by links, itself included. Null and
    empty texts and such without words have an empty set and no link. Rows without doc_id are left
    out. Rows of one doc_id are one document, as if linked; n_shingles is then its largest. An empty
    table gives no row. Only doc_id and text are read.
    """
    times = F.count("*").over(Window.partitionBy("sig"))
    known = stash(signed(docs, similarity, words).withColumn("c", times).where("c > 1 OR x <> 0").drop("c"), "signatures")
    sizes = stash(known.where("x < 0").select("node", (-1 - F.col("x")).alias("n"), "bins"), "sizes")
    hashes = known.where("x > 0").select("node", F.col("x").alias("h")).distinct().join(sizes.select("node", "n"), "node")
    # Equal sets, by size and hash: one of them stands for all.
    reps = hashes.where("n > 0").groupBy("n", "h").agg(F.min("node").alias("rep"))
    alike = stash(hashes.join(reps, ["n", "h"]).select("node", "rep", "n"), "alike")
    own = alike.where("node = rep").select("node", "n").distinct()
    groups = stash(promising(shared(stash(known.where("x = 0").select("node", "sig").distinct().join(own, "node"), "own"))), "groups")
    pairs = stash(candidates(groups, similarity), "pairs")
    links = verified(docs, sizes, pairs, similarity, words)

    found = components(links)
    held = stash(crowded(docs, groups, found, similarity, words), "passages")
    links = stash(passage_links(held, similarity), "links")
    few = few_features(held)
    star = stash(led(few).join(pairs, ["a", "b"], "left_anti"), "pairs")
    found = grown(found, links.union(verified(docs, sizes, star, similarity, words)))
    rest = passage_pairs(held, found, similarity).union(apart_pairs(few, found, similarity)).distinct()
    rest = stash(rest.join(pairs.union(star), ["a", "b"], "left_anti"), "pairs")
    same = alike.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    part = grown(found, same.union(verified(docs, sizes, rest, similarity, words)))
    whole = sizes.groupBy("node").agg(F.max("n").alias("n"))
    return whole.join(part, "node", "left").select(
        F.col("node").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")
    )


def droppable(weights: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]] | None:
    """Subsets of places whose weights are ``most`` at most in sum, with the sum; None if they are too many."""
    found = [((), 0)] if most >= 0 else []
    for k in np.argsort(weights, kind="stable").tolist():
        w = int(weights[k])
        found += [((*dropped, k), t + w) for dropped, t in found if t + w <= most]
        if len(found) > MOST_SUBSETS:
            return None
    return found


HELD = "node long, n long, most long, closed boolean, feature long, after long, sig long, w long, light long"


def crowded(docs: DataFrame, groups: DataFrame, found: DataFrame, similarity: tuple[int, int], words: int) -> DataFrame:
    """Rare features and subsets of passages of all members of large groups that are in several parts, as ``HELD``.

    ``most`` counts the features that a member of ``n`` has in common with any other. A row has either one
    of the member's rarest such features, with the number from this one on (``after``), or the hash of a
    subset of its passages (``sig``) of ``w`` features. A passage is what the same members have in common, of
    twice ``words`` features or more; ``light`` counts the features of shorter ones. Members that are not
    ``closed`` have no rows of subsets.
    """
    num, den = similarity
    large = groups.where(f"c > {SMALL_GROUP}").join(found, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("part"))
    split = large.groupBy("sig").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("sig")
    members = large.join(split, "sig", "left_semi").select("node").distinct()

    def features(batches):
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_buffer().to_pybytes(), words).view(np.int64)
                own = int(mix(s.view(np.uint64)).sum() >> np.uint64(1))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(s), x)) for x in (node, len(s), own)), pa.array(s)], names=["node", "n", "h", "feature"])

    def passages(batches):
        for batch in batches:
            for node, n, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                c, feature, kind = (np.asarray(x) for x in own.values.flatten())
                feature, at = np.unique(feature, return_index=True)  # a row may be there twice
                c, kind = c[at], kind[at]
                most = len(feature)
                # Features of one text alone are its rarest: they take the first places, though they have no rows.
                spare = n - (n * num + den - 1) // den - (n - most)
                first = np.lexsort((feature, c))[: max(spare + 1, 0)]
                kinds, weights = np.unique(kind, return_counts=True)
                heavy = weights >= 2 * words
                kinds, weights = mix(kinds[heavy].view(np.uint64)), weights[heavy]
                light = most - int(weights.sum())
                subsets = droppable(weights, spare) if 4 * light <= n else None
                sums = np.array([kinds[list(dropped)].sum(dtype=np.uint64) for dropped, _ in subsets or ()], dtype=np.uint64)
                sigs = mix(kinds.sum(dtype=np.uint64) - sums).view(np.int64)
                a, b = len(first), len(sigs)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([x] * (a + b)) for x in (node, n, most, subsets is not None)),
                        pa.array([*feature[first].tolist(), *[None] * b], pa.int64()),
                        pa.array([*range(most, most - a, -1), *[None] * b], pa.int64()),
                        pa.array([*[None] * a, *sigs.tolist()], pa.int64()),
                        pa.array([*[None] * a, *(most - light - t for _, t in subsets or ())], pa.int64()),
                        pa.array([*[None] * a, *[light] * b], pa.int64()),
                    ],
                    names=[f.split()[0] for f in HELD.split(", ")],
                ).cast(held_schema)

    held_schema = pa.schema([(f.split()[0], pa.bool_() if f.endswith("boolean") else pa.int64()) for f in HELD.split(", ")])
    rows = stash(of_nodes(docs, stash(members, "members")).mapInArrow(features, "node long, n long, h long, feature long"), "features")
    # Features of the same members are told by the members' number and by sums of both halves of their hashes.
    who = F.xxhash64("node", "h")
    counts = rows.groupBy("feature").agg(F.count("*").alias("c"), F.sum(F.shiftrightunsigned(who, 33)).alias("x"), F.sum(who.bitwiseAND((1 << 31) - 1)).alias("y"))
    counts = counts.where("c > 1").select("feature", "c", F.xxhash64("c", "x", "y").alias("kind"))
    met = rows.join(counts, "feature").select("node", "n", "h", F.struct("c", "feature", "kind").alias("row"))
    return met.groupBy("node", "n", "h").agg(F.collect_list("row").alias("rows")).select("node", "n", "rows").mapInArrow(passages, HELD)


def passage_groups(held: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """node, n, sig, w, light of subsets that several members enumerate, with ``lead`` (n, node), the member with fewest features, and ``room``.

    ``room`` is how far the row is from being without a link in its group, were its light features all in common.
    """
    num, den = similarity
    rows = held.where("sig IS NOT NULL").select("node", "n", "sig", "w", "light")
    apart = f"{2 * num} * (n - w) - {num + den} * light"
    found = rows.groupBy("sig", "w").agg(F.count("*").alias("c"), F.min(F.struct("n", "node")).alias("lead"), F.min(F.expr(apart)).alias("least")).where("c > 1").drop("c")
    return rows.join(found, ["sig", "w"]).withColumn("room", F.expr(f"{2 * (den - num)} * w - least - ({apart})")).drop("least")


def passage_links(held: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) of a subset's members with its lead that the subset alone is enough for.

    Where it is enough for any two members, it is for each of them and the lead, whose other features are fewest.
    """
    num, den = similarity
    sure = passage_groups(held, similarity).where(f"node <> lead.node AND {den - num} * w >= {num} * (n + lead.n - 2 * w)")
    return sure.select(F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b")).distinct()


def passage_pairs(held: DataFrame, found: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of different parts whose common passages are enough for a link only with short ones."""
    num, den = similarity
    rows = passage_groups(held, similarity).where("room >= 0").join(found, "node", "left").select("sig", "w", "node", "n", "light", F.coalesce("component", "node").alias("part"))
    rows = stash(rows, "unsure")
    split = rows.groupBy("sig", "w").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("sig", "w")
    rows = rows.join(split, ["sig", "w"], "left_semi")
    a, b = rows.toDF("sig", "w", "a", "na", "la", "pa"), rows.toDF("sig", "w", "b", "nb", "lb", "pb")
    enough = f"a < b AND pa <> pb AND {num + den} * (w + least(la, lb)) >= {num} * (na + nb)"
    return a.join(b, ["sig", "w"]).where(enough).select("a", "b").distinct()


def few_features(held: DataFrame) -> DataFrame:
    """Rows of rare features that members have who are not closed."""
    rows = held.where("feature IS NOT NULL").select("feature", "node", "n", "most", "after", "closed")
    return stash(rows.join(rows.where("NOT closed").select("feature").distinct(), "feature", "left_semi"), "rare")


def led(held: DataFrame) -> DataFrame:
    """Pairs of each member with the one of its feature that shares the largest part of its features with others."""
    lead = held.groupBy("feature").agg(F.max(F.struct((F.col("most") / F.col("n")).alias("share"), "node")).alias("lead")).select("feature", F.col("lead.node").alias("leader"))
    pairs = held.join(lead, "feature").where("leader <> node AND NOT closed")
    return pairs.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()


def apart_pairs(held: DataFrame, found: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of different parts, one at least not closed, that share a rare feature and have features enough in common with others."""
    num, den = similarity
    placed = held.join(found, "node", "left").select("feature", "node", "n", "after", "closed", F.coalesce("component", "node").alias("part"))
    a, b = placed.where("NOT closed").drop("closed").toDF("feature", "a", "na", "after_a", "pa"), placed.toDF("feature", "b", "nb", "after_b", "closed", "pb")
    # At its first common feature a pair has no more in common than either shares with any text from there on.
    enough = f"(closed OR a < b) AND pa <> pb AND {num + den} * least(after_a, after_b) >= {num} * (na + nb) AND {num} * greatest(na, nb) <= {den} * least(na, nb)"
    return a.join(b, "feature").where(enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


JOIN_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * n_both >= 75 * (sa.n + sb.n - n_both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
