"""Mixing sources to target weights by iterative proportional fitting.

Topics are clusters of whole texts, fitted to all distinct ones: of each text's TF-IDF n-gram vector
the part that its language's mean does not explain is clustered, so topics tell texts of one language
apart instead of languages. Rounds go over all texts, first along the main directions of these parts
and then with whole vectors. Tokens are counted by cells of source, language and topic. Raking scales the cells' weights to each
marginal in turn until all hold; a cell never gets more than it has. Every value has its own marginal, however many there
are. Documents are then drawn with their cell's calibrated probability by a hash of their id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stash
from weftline.llm.language import DIMENSIONS, gram_counts, unit

AXES = ("source", "lang", "topic")
#: Clusters of texts, and the distinct texts up to which the driver clusters; more are clustered in Spark, and as many give the rows to start from.
TOPICS, TOPIC_SAMPLE = 8, 2000
#: Fixed point in which vectors are summed, so that sums are the same however rows are dealt out.
POINT = float(1 << 32)
#: Starts of the clustering, of which the best counts, and the least part of the texts, and rows, that make a cluster or a language.
STARTS, LEAST_SHARE, LEAST_ROWS = 5, 0.01, 5
#: Directions in which the rounds over all texts go on until they settle, and the rounds that whole vectors then take at most.
DIRECTIONS, WHOLE_ROUNDS = 64, 4
#: Length below which what a mean leaves of a unit vector has no direction.
NOTHING = 1e-3
#: Bytes of a bitmap of n-grams, and logarithms of one and the counts of a byte.
BITMAP, _BITS, _LOGS = DIMENSIONS // 8, DIMENSIONS.bit_length() - 1, np.log1p(np.arange(256)).astype(np.float32)
#: Texts whose n-grams are unpacked at once (2 MB as rows, which a core's cache holds), and rows along directions summed at once.
UNPACKED, SUMMED = 128, 512
KEYS = [f"mix_{a}" for a in AXES]
#: Cells up to which the driver rakes (some 300 bytes a cell); more are raked in Spark, by the same steps.
DRIVER_CELLS = 100_000
#: Values of an axis up to which their factors are broadcast.
BROADCAST_VALUES = 100_000


@dataclass(frozen=True)
class Targets:
    """Shares of each marginal. An axis that is not given keeps its shares to the power ``temperature``, made to sum to one.

    Of an axis that is given, values that are not listed keep their own share of the tokens, and the
    listed ones divide the rest as their shares say. A listed share of 0 keeps a value out.
    """

    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    temperature: float = 0.5
    keep: float = 0.5  # of all tokens
    rounds: int = 200


def tokens(text: Column) -> Column:
    """Words by single blanks; 0 for null or empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


class Grams:
    """Hashed n-grams of some texts: at (row, gram) the logarithm of one and the count, ``tf``."""

    def __init__(self, sent: list[bytes]):
        bits = np.frombuffer(b"".join([x[:BITMAP] for x in sent]), np.uint8).reshape(-1, BITMAP)
        self.n = len(sent)
        self.at = np.flatnonzero(np.unpackbits(bits).view(bool))
        self.row, self.gram = self.at >> _BITS, self.at & (DIMENSIONS - 1)
        #: How many n-grams each row has; one at least, as any text has a blank.
        self.many = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.first = np.cumsum(self.many) - self.many
        ends = (BITMAP + self.many).tolist()
        few = np.frombuffer(b"".join([x[BITMAP:e] for x, e in zip(sent, ends, strict=True)]), np.uint8)
        self.tf = _LOGS[few]
        if few.size and few.max() == 255:
            self.tf[few == 255] = np.log1p(np.frombuffer(b"".join([x[e:] for x, e in zip(sent, ends, strict=True)]), np.uint32))

    @staticmethod
    def of(counts: np.ndarray) -> bytes:
        """A bitmap of the n-grams that occur, a byte for the count of each, and those of 255 and more in full: some 1 KB for most texts."""
        there = counts > 0
        some = counts[there]
        few = np.packbits(there).tobytes() + np.minimum(some, 255).astype(np.uint8).tobytes()
        return few + some[some >= 255].astype(np.uint32).tobytes() if some.size and some.max() >= 255 else few

    def add(self, value: np.ndarray) -> np.ndarray:
        """By row the sums of one number for each n-gram."""
        return np.add.reduceat(value, self.first) if self.n else np.zeros(0)

    def dense(self, value: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, DIMENSIONS), np.float32)
        out.ravel()[self.at] = value
        return out


class Rest:
    """What the nearest of the means leaves of some texts' unit vectors, times the columns of ``onto``.

    A row is (w / length - share * mean) / size: ``cosines`` are its products with ``onto``. Rows of a
    size below ``NOTHING`` are (nearly) their mean and have no direction: ``left`` is false for them.
    """

    def __init__(self, grams: Grams, idf: np.ndarray, means: np.ndarray, onto: np.ndarray):
        self.w = grams.tf * idf[grams.gram]
        w = self.w.astype(float)
        self.length = np.maximum(np.sqrt(grams.add(w * w)), 1e-12)
        products = grams.dense(self.w) @ np.concatenate([means, onto]).T
        self.mean = products[:, : len(means)].argmax(axis=1)
        self.share = grams.add(w * means.ravel()[np.repeat(self.mean * DIMENSIONS, grams.many) + grams.gram]) / self.length
        square = (means.astype(float) ** 2).sum(axis=1)[self.mean]
        size = np.sqrt(np.maximum(1 - self.share**2 * (2 - square), 0))
        self.left = size >= NOTHING
        self.size = np.where(self.left, size, np.inf)
        self.cosines = (products[:, len(means) :] / self.length[:, None] - self.share[:, None] * (means @ onto.T)[self.mean]) / self.size[:, None]


@dataclass
class Topics:
    """Means of languages and clusters of what they leave of TF-IDF vectors of hashed n-grams; a few hundred kilobytes."""

    idf: np.ndarray
    means: np.ndarray
    centroids: np.ndarray

    def nearest(self, sent: list[bytes]) -> list[str]:
        """The nearest cluster of each text of packed ``Grams``."""
        if not len(self.centroids):
            return ["none"] * len(sent)
        out = []
        for at in range(0, len(sent), UNPACKED):
            out += [f"t{k}" for k in Rest(Grams(sent[at : at + UNPACKED]), self.idf, self.means, self.centroids).cosines.argmax(axis=1)]
        return out

    def of(self, text: pa.Array, letters: np.ndarray) -> list[str]:
        """The nearest cluster of each whole text, "none" without a letter."""
        out = np.full(len(text), "none", dtype=object)
        some = np.flatnonzero(letters)
        if len(some):
            out[some] = self.nearest([Grams.of(gram_counts(t.as_buffer().to_pybytes())) for t in text.take(pa.array(some))])
        return out.tolist()


_LETTERS = r"\p{L}"


def has_letter(text: Column) -> Column:
    """Whether any letter is there; most texts show one at once, and the others are read to their end. False for null."""
    return F.coalesce(F.substring(text, 1, 64).rlike(_LETTERS) | text.rlike(_LETTERS), F.lit(False))


def left_over(rows: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Unit rows without their part along the nearest mean."""
    own = means[(rows @ means.T).argmax(axis=1)]
    return unit(rows - (rows * own).sum(axis=1, keepdims=True) * own)


def spread(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Rows to start from: each drawn by its squared distance from those before."""
    picked, far = [int(rng.integers(len(rows)))], np.full(len(rows), 2.0)
    while len(picked) < min(k, len(rows)):
        far = np.minimum(far, np.maximum(0, 2 - 2 * rows @ rows[picked[-1]]))
        if far.sum() <= 1e-9:
            break
        picked.append(int(rng.choice(len(rows), p=far / far.sum())))
    return rows[picked]


def topic_centres(rows: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means of the best of several starts; clusters of few rows are given up to the others."""
    rng, least = np.random.default_rng(3), max(LEAST_ROWS, LEAST_SHARE * len(rows))
    best, top = rows[:1], -np.inf
    for _ in range(STARTS):
        c = spread(rows, k, rng)
        for turn in range(rounds):
            own = (rows @ c.T).argmax(axis=1)
            size = np.bincount(own, minlength=len(c))
            keep = np.flatnonzero(size >= (least if turn >= rounds // 2 else 1))
            if not len(keep):
                keep = size.argmax(keepdims=True)
            c = unit(np.array([rows[own == j].mean(axis=0) for j in keep]))
        fit = float((rows @ c.T).max(axis=1).mean())
        if fit > top:
            best, top = c, fit
    return best


def grams(docs: DataFrame) -> DataFrame:
    """h, counts, lang of each distinct text with a letter, written. Without lang all texts are of one language."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    rows = docs.select("text", lang.alias("lang")).where(has_letter(F.col("text"))).select(F.xxhash64("text").alias("h"), "text", "lang")

    def counts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Grams.of(gram_counts(t.as_buffer().to_pybytes())) for t in batch.column(1)], pa.binary()), batch.column(2)], names=["h", "counts", "lang"])

    counted = rows.mapInArrow(counts, "h long, counts binary, lang string")
    return stash(counted.groupBy("h").agg(F.min("counts").alias("counts"), F.min("lang").alias("lang")), "grams")


def summed(rows: DataFrame, each, at_once: int = UNPACKED) -> dict[int, np.ndarray]:
    """By key the sums of the rows of whole numbers that ``each`` gives for ``at_once`` rows: added up in each task, and each key's in Spark."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), at_once):
                for key, row in each(batch.slice(at, at_once)):
                    total[key] = total[key] + row.astype(np.int64) if key in total else row.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([row.tobytes() for row in total.values()], pa.binary())], names=["key", "row"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(r, np.int64) for r in rows["row"].to_pylist())
        return pa.table({"key": rows["key"][:1], "row": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "key int, row binary")
    return {r["key"]: np.frombuffer(r["row"], np.int64) for r in parts.groupBy("key").applyInArrow(add, "key int, row binary").collect()}  # a row for each cluster of each start


def whole(values: np.ndarray) -> np.ndarray:
    """Numbers in fixed point; sums of a batch of them are exact."""
    return np.rint(values * POINT)


def fit_topics(docs: DataFrame, topics: int = TOPICS, sample: int = TOPIC_SAMPLE) -> Topics:
    """``topics_of`` the distinct texts of ``docs``."""
    return topics_of(grams(docs), topics, sample)


def topics_of(held: DataFrame, topics: int = TOPICS, sample: int = TOPIC_SAMPLE) -> Topics:
    """Weights of n-grams, means of languages and clusters over all distinct texts: on the driver up to ``sample`` of them, else in passes of Spark over all."""
    n = held.count()
    none = np.zeros((0, DIMENSIONS), np.float32)
    if not n:
        return Topics(np.ones(DIMENSIONS, np.float32), none, none)
    least = max(LEAST_ROWS, LEAST_SHARE * n)
    known = [r["lang"] for r in held.groupBy("lang").count().where(F.col("lang").isNotNull() & (F.col("lang") != "") & (F.col("count") >= least)).orderBy("lang").collect()]  # 100 at most
    first = first_rows(held, n, sample, "counts", "lang")
    some = Grams([r["counts"] for r in first])
    df = np.bincount(some.gram, minlength=DIMENSIONS) if n <= sample else summed(held.select("counts"), lambda batch: [(0, np.bincount(Grams(batch.column(0).to_pylist()).gram, minlength=DIMENSIONS))])[0]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    x = some.dense(some.tf * idf[some.gram])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    if n <= sample:
        langs = np.array([r["lang"] or "" for r in first], dtype=object)
        means = unit(np.array([x[langs == v].mean(axis=0) for v in known] or [x.mean(axis=0)])).astype(np.float32)
        return Topics(idf, means, topic_centres(left_over(x, means), topics).astype(np.float32))
    places = {v: k for k, v in enumerate(known)}

    def by_language(batch):
        g = Grams(batch.column(0).to_pylist())
        own = np.array([places.get(v, len(known)) for v in batch.column(1).to_pylist()] if known else [0] * g.n)
        w = (g.tf * idf[g.gram]).astype(float)
        fixed = whole(w / np.repeat(np.maximum(np.sqrt(g.add(w * w)), 1e-12), g.many))
        table = np.bincount(np.repeat(own * DIMENSIONS, g.many) + g.gram, fixed, (own.max() + 1) * DIMENSIONS).reshape(-1, DIMENSIONS)
        return [(int(k), table[k]) for k in np.unique(own) if k < max(len(known), 1)]

    sums = summed(held.select("counts", "lang"), by_language)
    means = unit(np.array([sums[k] / POINT for k in range(len(sums))])).astype(np.float32)
    for at in range(0, len(x), 256):
        x[at : at + 256] = left_over(x[at : at + 256], means)
    return Topics(idf, means, spark_centres(held, idf, means, directions(x), topics, sample).astype(np.float32))


def first_rows(rows: DataFrame, n: int, wanted: int, *columns: str) -> list:
    """The ``wanted`` texts of least hash among ``n``."""
    draw = F.pmod("h", F.lit(1 << 30))
    # Twice what is taken and 50: fewer come with no chance that matters, and few meet in the task that puts them in order.
    few = rows.select("h", *columns).where(draw <= min(1.0, (2 * wanted + 50) / max(n, 1)) * (1 << 30))
    return few.orderBy(draw, "h").limit(wanted).orderBy("h").collect()


def directions(rows: np.ndarray, n: int = DIRECTIONS) -> np.ndarray:
    """About the first ``n`` principal directions of rows, by power passes; orthonormal."""
    basis = np.random.default_rng(4).normal(size=(rows.shape[1], n)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    return np.ascontiguousarray(basis.T, dtype=np.float32)


def centred(sums: dict[int, np.ndarray], base: int, k: int, least: float, lift=lambda row: row) -> np.ndarray:
    """Unit means of the clusters ``base`` to ``base`` + ``k`` of sums (row, count): those of ``least`` rows, or else the largest."""
    met = [sums[base + j] for j in range(k) if base + j in sums]
    keep = [row for row in met if row[-1] >= least] or [max(met, key=lambda row: row[-1])]
    return unit(np.array([lift(row[:-1] / POINT / row[-1]) for row in keep]))


def spark_centres(held: DataFrame, idf: np.ndarray, means: np.ndarray, basis: np.ndarray, k: int, sample: int, rounds: int = 15) -> np.ndarray:
    """``topic_centres`` of all texts of ``held``.

    What the means leave of every text is written along the rows of ``basis``. Starts are among the
    ``sample`` texts of least hash; each round is a pass over all texts for those starts that still
    move. The best one's clusters, of all texts again, then take rounds of whole vectors.
    """

    def along(batches):
        for batch in batches:
            for at in range(0, len(batch), UNPACKED):
                part = batch.slice(at, UNPACKED)
                rest = Rest(Grams(part.column(1).to_pylist()), idf, means, basis)
                y = rest.cosines.astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in y], pa.binary())], names=["h", "y"]).filter(pa.array(rest.left))

    reduced = stash(held.select("h", "counts").mapInArrow(along, "h long, y binary"), "reduced")
    read = lambda sent: np.frombuffer(b"".join(sent), np.float32).reshape(-1, len(basis))
    n = reduced.count()
    first = read([r["y"] for r in first_rows(reduced, n, sample, "y")])
    if not len(first):  # all texts are alike
        return means[:1]
    rng, least = np.random.default_rng(3), max(LEAST_ROWS, LEAST_SHARE * n)
    now, moving = [spread(unit(first), k, rng) for _ in range(STARTS)], list(range(STARTS))
    for turn in range(rounds):
        centres = {s: now[s].astype(np.float32) for s in moving}

        def parts(batch, centres=centres):
            y, out = read(batch.column(0).to_pylist()), []
            fixed = whole(y.astype(float))
            for s, c in centres.items():
                own = (y @ c.T).argmax(axis=1)
                out += [(int(s * k + j), np.append(fixed[own == j].sum(axis=0), (own == j).sum())) for j in np.unique(own)]
            return out

        sums = summed(reduced.select("y"), parts, SUMMED)
        for s in list(moving):
            after = centred(sums, s * k, len(now[s]), least if turn >= rounds // 2 else 1)
            if turn >= rounds // 2 and np.array_equal(after.astype(np.float32), now[s].astype(np.float32)):
                moving.remove(s)
            now[s] = after
        if not moving:
            break
    last = [c.astype(np.float32) for c in now]
    fits = summed(reduced.select("y"), lambda batch: [(0, np.array([whole((read(batch.column(0).to_pylist()) @ c.T).max(axis=1).astype(float)).sum() for c in last]))], SUMMED)[0]
    found = unit(now[int(fits.argmax())] @ basis)
    for _ in range(WHOLE_ROUNDS):
        centres = found.astype(np.float32)

        def wholes(batch, centres=centres):
            g = Grams(batch.column(0).to_pylist())
            rest = Rest(g, idf, means, centres)
            own = rest.cosines.argmax(axis=1)
            vectors = np.bincount(np.repeat(own * DIMENSIONS, g.many) + g.gram, whole(rest.w / np.repeat(rest.length * rest.size, g.many)), len(centres) * DIMENSIONS)
            shares = np.bincount(own * len(means) + rest.mean, whole(-rest.share / rest.size), len(centres) * len(means))
            table = np.column_stack([vectors.reshape(len(centres), -1), shares.reshape(len(centres), -1), np.bincount(own, rest.left, len(centres))])
            return [(j, row) for j, row in enumerate(table) if row[-1]]

        found = centred(summed(held.select("counts"), wholes), 0, len(centres), least, lambda row: row[:DIMENSIONS] + row[DIMENSIONS:] @ means)
        if found.shape == centres.shape and np.abs(found - centres).max() < 1e-6:
            break
    return found


def weighed(docs: DataFrame, held: DataFrame, topics: Topics) -> DataFrame:
    """Adds mix_source, mix_lang, mix_topic (null: "null") and mix_tokens. Topics are those of the texts of ``held``, joined by hash."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(topics.nearest(batch.column(1).to_pylist()), pa.string())], names=["mix_h", "mix_topic"])

    found = stash(held.select("h", "counts").mapInArrow(run, "mix_h long, mix_topic string"), "topics")
    docs = docs.drop(*KEYS, "mix_tokens", "mix_h", "mix_letters")
    letters = has_letter(F.col("text"))
    # Rows without a letter have no topic; they are dealt out by other numbers, which are no text's.
    key = F.when(letters, F.xxhash64("text")).otherwise(F.xxhash64(F.monotonically_increasing_id()))
    rows = docs.withColumns({"mix_source": known("source"), "mix_lang": known("lang"), "mix_tokens": tokens(F.col("text")), "mix_h": key, "mix_letters": letters})
    topic = F.when(F.col("mix_letters"), F.coalesce("mix_topic", F.lit("none"))).otherwise("none")
    return rows.join(found, "mix_h", "left").withColumn("mix_topic", topic).drop("mix_h", "mix_letters")


def phases(targets: Targets) -> list[list[int]]:
    """Places of the axes in the order of raking: all, until they hold, and then those with given shares alone.

    So given shares hold where marginals contradict each other (topics that one language alone has)
    or cells are used up, as far as there is text at all; ``achieved`` tells what came of the rest.
    """
    given = [k for k in range(len(AXES)) if AXES[k] in targets.shares]
    return [[*(k for k in range(len(AXES)) if k not in given), *given], given]


def marginal(have: dict[str, float], targets: Targets, axis: str) -> dict[str, float]:
    """Wanted shares. Values that the targets do not list keep their share of the tokens, the listed ones divide the rest."""
    listed = targets.shares.get(axis)
    if listed is None:
        wanted = {k: v**targets.temperature if v > 0 else 0.0 for k, v in have.items()}
    else:
        asked = sum(listed[k] for k in have if k in listed)
        rest = sum(v for k, v in have.items() if k in listed)
        wanted = {k: (listed[k] / asked * rest if asked else 0.0) if k in listed else v for k, v in have.items()}
    total = sum(wanted.values())
    return {k: v / total if total else 1 / len(have) for k, v in wanted.items()}


def rake(cells: list[tuple[tuple[str, ...], float]], targets: Targets) -> np.ndarray:
    """Tokens to take from each cell: raked to every marginal, at most what the cell has."""
    have = np.array([t for _, t in cells], dtype=float)
    goal, axes = targets.keep * have.sum(), []
    for k, axis in enumerate(AXES):
        names = sorted({c[k] for c, _ in cells})
        places = {name: n for n, name in enumerate(names)}
        code = np.array([places[c[k]] for c, _ in cells])
        sums = dict(zip(names, np.bincount(code, have, len(names)), strict=True))
        wanted = marginal(sums, targets, axis)
        axes.append((code, len(names), goal * np.array([wanted[n] for n in names])))
    take = targets.keep * have
    for phase in phases(targets):
        for _ in range(targets.rounds):
            before = take
            for code, n, wanted in (axes[k] for k in phase):
                now = np.bincount(code, take, n)
                take = np.minimum(have, take * np.where(now > 0, wanted / np.maximum(now, 1e-12), 0.0)[code])
            if np.abs(take - before).sum() <= 1e-9 * max(goal, 1):
                break
    return take


def marginal_rows(cells: DataFrame, targets: Targets, axis: str) -> DataFrame:
    """``marginal`` times the goal as a table: the axis' column and ``wanted``."""
    key = f"mix_{axis}"
    sums = stash(cells.groupBy(key).agg(F.sum("have").alias("n")), "marginal")
    listed = targets.shares.get(axis)
    if listed is None:
        weights = sums.withColumn("w", F.when(F.col("n") > 0, F.pow("n", F.lit(float(targets.temperature)))).otherwise(0.0))
    else:
        shares = sums.sparkSession.createDataFrame([(k, float(v)) for k, v in listed.items()], f"{key} string, share double")
        met = stash(sums.join(shares, key, "left"), "marginal")
        rest, asked = met.agg(F.sum(F.when(F.col("share").isNotNull(), F.col("n"))), F.sum("share")).first()
        weights = met.withColumn("w", F.when(F.col("share").isNull(), F.col("n")).otherwise(F.col("share") / asked * rest if asked else 0.0))
    weights = stash(weights.select(key, "n", "w"), "marginal")
    have, total, values = weights.agg(F.sum("n"), F.sum("w"), F.count("*")).first()
    return weights.select(key, (targets.keep * have * (F.col("w") / total if total else F.lit(1 / values))).alias("wanted"))


def rake_rows(cells: DataFrame, targets: Targets) -> DataFrame:
    """``rake`` in Spark: ``cells`` (KEYS, have) with ``take``. Each round is written."""
    wanted = {key: stash(marginal_rows(cells, targets, axis), "marginal") for key, axis in zip(KEYS, AXES, strict=True)}
    few = {key: rows.count() <= BROADCAST_VALUES for key, rows in wanted.items()}
    goal = targets.keep * cells.agg(F.sum("have")).first()[0]
    state, done = stash(cells.withColumn("take", targets.keep * F.col("have")), "raked"), []
    for phase in [p for p in phases(targets) for _ in range(targets.rounds)]:
        if phase == done:
            continue
        now = state.withColumn("before", F.col("take"))
        for key in (KEYS[k] for k in phase):
            factor = F.when(F.col("now") > 0, F.col("wanted") / F.greatest("now", F.lit(1e-12))).otherwise(0.0)
            factors = now.groupBy(key).agg(F.sum("take").alias("now")).join(wanted[key], key).select(key, factor.alias("factor"))
            factors = stash(factors, "factors")
            met = now.join(F.broadcast(factors) if few[key] else factors, key)
            now = met.withColumn("take", F.least("have", F.col("take") * F.col("factor"))).drop("factor")
        state = stash(now, "raked")
        moved = state.agg(F.sum(F.abs(F.col("take") - F.col("before")))).first()[0]
        state = state.drop("before")
        if moved <= 1e-9 * max(goal, 1):
            done = phase
    return state


def calibrated(docs: DataFrame, targets: Targets = Targets(), text: bool = True) -> DataFrame:
    """``docs`` with mix_* columns and ``probability``, that of being drawn. Without ``text`` the texts are left behind, and read once less."""
    spark = docs.sparkSession
    held = grams(docs)
    rows = weighed(docs.drop("probability"), held, topics_of(held))
    if not text:
        rows = stash(rows.drop("text"), "weighed")
    cells = stash(rows.groupBy(*KEYS).agg(F.sum("mix_tokens").cast("double").alias("have")), "cells")
    n_cells = cells.count()
    if not n_cells:
        return rows.withColumn("probability", F.lit(0.0))
    if n_cells <= DRIVER_CELLS:
        few = [((r[0], r[1], r[2]), r[3]) for r in cells.orderBy(*KEYS).collect()]
        take = rake(few, targets)
        table = spark.createDataFrame(
            [(*c, float(t / n) if n else 1.0) for (c, n), t in zip(few, take, strict=True)], ", ".join(f"{k} string" for k in KEYS) + ", probability double"
        )
    else:
        table = rake_rows(cells, targets).select(*KEYS, F.when(F.col("have") > 0, F.col("take") / F.col("have")).otherwise(1.0).alias("probability"))
    if n_cells <= 20_000:  # some 60 bytes a row
        table = F.broadcast(table)
    return rows.join(table, KEYS)


def achieved(rows: DataFrame) -> DataFrame:
    """axis, value, share: the marginals of the tokens that ``calibrated`` rows are expected to give, to be held against the targets."""
    weight = F.col("mix_tokens") * F.col("probability")
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(k).alias("value")) for a, k in zip(AXES, KEYS, strict=True)])).alias("of"), weight.alias("w"))
    sums = each.groupBy("of.axis", "of.value").agg(F.sum("w").alias("w"))
    total = sums.groupBy("axis").agg(F.sum("w").alias("total"))
    return sums.join(F.broadcast(total), "axis").select("axis", "value", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(0.0).alias("share"))


def draw(docs: DataFrame, targets: Targets = Targets(), seed: int = 42, text: bool = True) -> DataFrame:
    """Documents drawn by calibrated probabilities, with mix_* columns and ``probability``; without the column text if not ``text``.

    Null source or language is a value like others, named "null": where the targets do not list it, as
    with any value that they do not list, it keeps its own share. Null or empty text has no tokens and is kept only
    by its cell's probability (1 where the cell has no tokens at all). Repeated rows are drawn
    alike, and rows without doc_id by their text. An empty table gives no row. Other columns pass through; names that start with mix_, or
    ``probability``, are the operator's and replace columns of that name.
    """
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text"), F.lit(seed))).otherwise(F.xxhash64(F.col("doc_id"), F.lit(seed)))
    u = F.pmod(key, F.lit(1 << 53)) / float(1 << 53)
    return calibrated(docs.withColumn("mix_u", u), targets, text).where(F.col("mix_u") < F.col("probability")).drop("mix_u")
