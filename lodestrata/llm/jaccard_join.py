"""N-gram Jaccard join: which texts share most of their word shingles, and the groups they form.

Rare-first prefix filtering.  Shingles are ordered from rare to frequent by how often their words would meet by chance: the sum of the
levels (a logarithm) of their words' exact counts over all texts, then their hash: one total order.  The most frequent MOST_WORDS
words have a level, all others the least, so that the table keeps its size and its sharpness however many texts there are.  Two sets
that are alike enough must share a shingle among the first few of either, and several among a few more.  So each set's prefix is a
quarter longer than one shared shingle needs; prefix shingles are counted exactly (combined before the shuffle), those that a single
text has go, and so does a set that is left with fewer than it must share with any other.  What is left is ordered anew, by exact
counts: as several must be shared, a set can do without its most frequent ones but for one, and texts meet over the others.  A pair must
pass the length filter, the positional filter (what can still be shared before and behind the common shingle) and the suffix filter
(shingles counted in BINS ranges of their hash cannot agree more than bin by bin, and where the parities of 64 * PARITIES ranges differ, the sets do); then its
whole sets are compared, once.

Equal sets are one class from the start.  Pairs are not spelt out within a group that hangs together: in a few rounds every member
of a prefix shingle's group is compared with one pivot (first the member that shares most, then others), and the links found are joined
to components; only pairs from different components remain, and all of these are compared, sizes that cannot be alike apart.  So every
link between components is found, and groups of thousands of near copies take about as many comparisons as they have members.

Every statistic covers all texts; nothing is capped.  What reaches the driver is the table of word levels (2**LEVEL_BITS bytes) and, to
keep texts without a candidate out of the verification's shuffle, a filter of eight bits a candidate, 2**MOST_FILTER_BITS at most; where more
candidates fill it, more texts are shuffled, once.

Defined cases: a null or empty text, or one of white space, has no shingles and is linked with nothing; a text with fewer words than a
shingle has its whole sequence as its one shingle; equal texts are linked; rows that share a doc_id are separate texts; a null doc_id is
never the smallest of its group unless all are null; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _mix as mixed
from .common import chunks, materialize, packed, release, unpacked, utf8, word_hashes
from .graph import components

#: Words that have a level; ranges (as bits) of the table of levels; steps of a level for a doubling; bins of a set; bits of the candidates' filter.
MOST_WORDS, LEVEL_BITS, STEPS, BINS, MOST_FILTER_BITS = 1 << 20, 24, 4, 64, 26
#: Longs that hold the parities of a set's counts in as many times 64 ranges of the hash.
PARITIES = 8
#: Different words that a task adds up before it hands them on.
HELD_WORDS = 400_000
#: Rounds in which members are compared with one pivot a group, before the pairs that are left.
PIVOT_ROUNDS = 3
P = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """The k-word shingles of some texts, as they come: hashes (h), where each text starts (starts, one more at the end), and the words' hashes."""

    def __init__(self, texts: list[bytes], k: int):
        lower = [t.lower() for t in texts]
        self.word, begins = word_hashes(lower)
        w, n = self.word, np.diff(begins)
        h = w.copy()
        for i in range(1, min(k, len(w))):  # h[x] covers the words from x to x + i, where there are so many
            h[: len(w) - i] = h[: len(w) - i] * P + w[i:]
        counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        self.starts = ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.at = np.repeat(begins[:-1] - ends[:-1], counts) + np.arange(ends[-1])  # the first word of each
        self.size = np.repeat(np.minimum(n, k), counts)  # its words
        self.h, self.k = mixed(h[self.at]), k
        for i in np.flatnonzero((n > 0) & (n < k)).tolist():  # the whole sequence as one
            self.h[ends[i]] = xxhash.xxh3_64_intdigest(b" ".join(lower[i].split()), seed=int(n[i]))

    def total(self, of_word: np.ndarray) -> np.ndarray:
        """The sum of a number that every word has, over the words of each shingle."""
        each = of_word.astype(np.int32)
        total = each[self.at]
        for i in range(1, self.k):
            total += np.where(self.size > i, each[np.minimum(self.at + i, max(0, len(each) - 1))], 0)
        return total

    def distinct(self, order_by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of one shingle of each kind in each text, in the order of a number (the hash, if not given) within each text; where each text starts."""
        n = len(self.starts) - 1
        doc = np.repeat(np.arange(n, dtype=np.uint16 if n < 65536 else np.int64), np.diff(self.starts))
        key = self.h if order_by is None else order_by
        order = np.argsort(key)
        order = order[np.argsort(doc[order], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
        places = order[new]
        return places, np.concatenate([[0], np.cumsum(np.bincount(doc[places], minlength=n))]).astype(np.int64)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of each text's shingle hashes, ascending, and where each text starts."""
    s = Shingles(texts, k)
    places, starts = s.distinct()
    return s.h[places], starts


def word_levels(docs: DataFrame) -> np.ndarray:
    """A level for each of 2**LEVEL_BITS ranges of word hashes: STEPS a doubling of the count over all texts of the range's most
    frequent word, 0 without one of the MOST_WORDS most frequent (as many as share the last count are left out together)."""

    def count(batches):
        held = None

        def flush(words, counts):
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts, pa.int64())], names=[
                "word", "n"])

        for batch in batches:
            for part in chunks(batch, "text"):
                words, counts = np.unique(word_hashes([t.lower() for t in utf8(part.column("text"))])[0],
                    return_counts=True)
                if held is not None:
                    both, which = np.unique(np.concatenate([held[0], words]), return_inverse=True)
                    words, counts = both, np.bincount(which, weights=np.concatenate([held[1], counts]),
                        minlength=len(both)).astype(np.int64)
                held = words, counts
                if len(words) > HELD_WORDS:
                    yield flush(*held)
                    held = None
        if held is not None:
            yield flush(*held)
        release()

    level = (F.lit(1) + F.floor(F.lit(STEPS) * F.log2(F.sum("n").cast("double")))).cast("int")
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word long, n long")
    counted = materialize(counted.groupBy("word").agg(level.alias("level")), "word-levels")
    room, least = MOST_WORDS, 256
    for r in sorted(counted.groupBy("level").count().collect(), key=lambda r: -r[
        "level"]):  # some hundred levels at most
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    at = F.shiftrightunsigned("word", 64 - LEVEL_BITS).cast("int")
    found = counted.where(F.col("level") >= least).groupBy(at.alias("at")).agg(F.max("level").alias("level")).toArrow()
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    out[found.column("at").to_numpy()] = np.minimum(found.column("level").to_numpy(), 255)
    return out


def must_share(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of its prefix a set of n has in common with the prefix of any other that is alike enough and no smaller.  The prefix has as many more
    shingles than another may lack; the number never falls as n grows, so for any partner that of the smallest possible one holds."""
    shared = -(-percent * n // 100)
    return np.maximum(np.minimum(shared, (n - shared + 3) // 4 + 1), 1)


def least_overlap(na, nb, percent: int):
    """Shared shingles that sets of na and nb need: the smallest x with 100 x >= percent * (na + nb - x)."""
    return -((-percent * (na + nb)) // (100 + percent))


def _text_hash(docs: DataFrame):
    return F.xxhash64(docs["text"].cast("string"))


def profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per text: row (a number), doc_id, th (a hash of the text), n (set size), key (of equal sets), prefix (its rarest shingles, in order of rarity; empty
    where an earlier text of the same task has the same set), bins, parity.  Kept in a table."""
    levels = docs.sparkSession.sparkContext.broadcast(word_levels(docs))  # a byte for each range

    def run(batches):
        seen: set[bytes] = set()  # of the texts of one task
        for batch in batches:
            for part in chunks(batch, "text"):
                yield profile(part, seen)
        release()

    def profile(part: pa.RecordBatch, seen: set[bytes]) -> pa.RecordBatch:
        s = Shingles(utf8(part.column("text")), k)
        total = s.total(levels.value[(s.word >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)])
        token = total.astype(np.uint64) << np.uint64(53) | s.h >> np.uint64(11)
        places, starts = s.distinct()
        h, n = s.h[places], np.diff(starts)
        doc = np.repeat(np.arange(len(n)), n)
        bins = np.bincount(doc * BINS + (h & np.uint64(BINS - 1)).astype(np.int64),
            minlength=len(n) * BINS).astype(np.int32)
        parity = np.zeros((len(n), PARITIES), np.uint64)
        at = (h >> np.uint64(8)) % np.uint64(64 * PARITIES)
        np.bitwise_xor.at(parity, (doc, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
        data = memoryview(h.tobytes())
        keys = [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(),
            strict=True)]
        first = np.zeros(len(n), bool)
        for i, key in enumerate(keys):
            if key not in seen:
                seen.add(key)
                first[i] = True
        token = token[places]
        order = np.argsort(token)
        order = order[np.argsort(doc[order].astype(np.uint16 if len(n) < 65536 else np.int64), kind="stable")]
        size = np.where(first & (n > 0), np.minimum(n, n - -(-percent * n // 100) + must_share(n, percent)), 0)
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        place = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
        prefix = token[order][np.repeat(starts[:-1], size) + place].view(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("th"),
                pa.array(n, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prefix)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BINS, pa.int32()), pa.array(bins)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * PARITIES, pa.int32()), pa.array(parity.ravel()
                    .view(np.int64))),
            ],
            names=["doc_id", "th", "n", "key", "prefix", "bins", "parity"],
        )

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), _text_hash(docs).alias("th"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(run,
        f"doc_id {id_type}, th long, n long, key binary, prefix array<long>, bins array<int>, parity array<long>")
    return materialize(out.select(F.monotonically_increasing_id().alias("row"), "*"), "profiles")


def _oriented(pairs: DataFrame, percent: int) -> DataFrame:
    """Of rows (x, nx, ix) and (y, ny, iy) at a common shingle, those pairs that the length and positional filters leave."""
    larger = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y")))
    need = F.ceil(F.expr(f"{percent} * (nx + ny) / {100 + percent}"))
    can = F.expr("least(ix, iy) + 1 + least(nx - 1 - ix, ny - 1 - iy)")
    alike = F.expr(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)") & (can >= need)
    return pairs.where(alike).select(F.when(larger, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(larger, F.col(
        "y")).otherwise(F.col("x")).alias("b"), "nx", "ny")


def _with_parity(rows: DataFrame, classes: DataFrame, of: str) -> DataFrame:
    """rows with the parities of the class in column `of`, a column each, named after it."""
    longs = [F.col("parity")[i].alias(f"{of}{i}") for i in range(PARITIES)]
    return rows.join(classes.select(F.col("id").alias(of), *longs), of)


def _few_apart(a: str, b: str, percent: int):
    """Whether the parities of both leave room for what two sets of na and nb may lack of each other: each that differs is a shingle that one of them lacks."""
    apart = sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(PARITIES)), F.lit(0))
    both = F.expr(f"(n{a} + n{b})")
    return apart <= both - 2 * F.ceil(percent * both / (100 + percent))


def _near(df: DataFrame, column: str, keys: DataFrame, count: int) -> DataFrame:
    """The rows of df whose column may be among keys' column (count of them at most).  A filter of eight bits a key or more, 2**MOST_FILTER_BITS
    at most, broadcast as a table of 64 bits a row, keeps most others out of a shuffle."""
    bits = min(max((8 * count).bit_length(), 12), MOST_FILTER_BITS)
    at = lambda: F.pmod(F.xxhash64(column), F.lit(1 << bits))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), (x % 64).cast("int"))
    words = keys.select(at().alias("_h")).select(F.shiftright("_h", 6).alias("_word"), bit(F.col("_h")).alias("_b"))
    words = words.groupBy("_word").agg(F.bit_or("_b").alias("_bits"))
    marked = df.withColumn("_h", at()).withColumn("_word", F.shiftright("_h", 6)).join(F.broadcast(words), "_word")
    return marked.where(F.col("_bits").bitwiseAND(bit(F.col("_h"))) != 0).select(*df.columns)


def _members(docs: DataFrame, wanted: DataFrame, count: int, k: int) -> DataFrame:
    """The sets (id, shingles) of the classes in wanted (id, doc_id, key).  A partition gives a class's set once, however often its text is there."""
    near = _near(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id", wanted, count)
    joined = near.join(wanted, near["doc_id"].eqNullSafe(wanted["doc_id"])).select("id", "key", "text")

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "text"):
                part = part.filter(pa.array([i not in seen for i in part.column("id").to_pylist()], pa.bool_()))
                h, starts = shingle_sets(utf8(part.column("text")), k)
                data = memoryview(h.tobytes())
                right, ids = [], part.column("id").to_pylist()
                for i, a, b, key in zip(ids, starts[:-1].tolist(), starts[1:].tolist(), part.column("key").to_pylist(),
                    strict=True):
                    right.append(i not in seen and xxhash.xxh3_128_digest(data[8 * a : 8 * b]) == key)
                    if right[-1]:
                        seen.add(i)
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id",
                    "shingles"]).filter(pa.array(right, pa.bool_()))

    return joined.mapInArrow(run, "id long, shingles array<long>")


class _Verifier:
    """Compares pairs of classes by their whole sets, which it gets from the texts when a pair first needs them."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, percent: int):
        self.docs, self.classes, self.k, self.percent, self.sets = docs, classes, k, percent, None

    def __call__(self, pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = self.classes.select("id", "doc_id", "key").join(ids, "id", "left_semi")
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("id"), "id", "left_anti")
        wanted = materialize(wanted, "wanted-sets")
        count = wanted.count()
        if self.sets is None or count:
            new = materialize(_members(self.docs, wanted, count, self.k), "sets")
            self.sets = new if self.sets is None else self.sets.unionByName(new)
        return _verified(pairs, _near(self.sets, "id", ids, 2 * pairs.count()), self.percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias(
        "b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.select("a", "b", shared.alias("i"), F.size("sa").cast("long").alias("na"), F.size("sb").cast("long")
        .alias("nb")).where(F.col("i") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a",
        "b").distinct()


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The suffix filter: what the bins of both can share at most must be enough, and their parities must not be too far apart."""
    of = lambda c: classes.select(F.col("id").alias(c), F.col("bins").alias(f"bins_{c}"), F.col("n").alias(f"n{c}"),
        *[F.col("parity")[i].alias(f"{c}{i}") for i in range(PARITIES)])
    most = F.expr("aggregate(zip_with(bins_a, bins_b, (x, y) -> least(x, y)), 0L, (s, x) -> s + x)")
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").where(_few_apart("a", "b", percent))
    return both.where(most * 100 >= percent * (F.col("na") + F.col("nb") - most)).select("a", "b")


def _met(texts: DataFrame, of_key: DataFrame, percent: int) -> DataFrame:
    """The shingles (id, n, i, token) over which classes meet; i is the shingle's place in its set."""

    def shared(rows: DataFrame) -> DataFrame:
        return rows.groupBy("token").agg(F.count("*").alias("c")).where("c >= 2")

    smallest, own = (f"(({percent} * {x} + 99) div 100)" for x in ("n",
        "m"))  # of a set that is alike enough to one of n; then of m shingles
    prefixes = texts.select(F.col("row").alias("id"), F.posexplode("prefix").alias("i", "token"))
    rows = materialize(prefixes.join(shared(prefixes).select("token"), "token"), "met-prefixes")
    rows = rows.join(of_key.select("id", "n"), "id").withColumn("m", F.expr(smallest))
    rows = rows.withColumn("must", F.expr(f"greatest(least({own}, (m - {own} + 3) div 4 + 1), 1)")).drop(
        "m")  # must_share(m)
    rows = materialize(rows, "class-prefixes")
    rows = rows.join(shared(rows).select("token"), "token")
    enough = rows.groupBy("id").agg(F.count("*").alias("own"), F.first("must").alias("must")).where(
        "own >= must").select("id")
    rows = materialize(rows.join(enough, "id"), "rich-prefixes")
    common = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("c"),
        "token"))  # of a set's shingles: a part of its own number at most
    rows = rows.join(shared(rows), "token").withColumn("common", common).where("common >= must")
    return rows.select("id", F.col("n").cast("long").alias("n"), "i", "token")


def grouped(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included)."""
    return _grouped(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """grouped, and the row, th (a hash of the text) and component (null without shingles) of each text."""
    texts = profiles(docs, k, percent)
    of_key = texts.where("n > 0").groupBy("key").agg(F.min("row").alias("id"), F.min("doc_id").alias("least"), F.first(
        "n").alias("n"))
    of_key = materialize(of_key, "classes")
    rows = materialize(_met(texts, of_key, percent), "prefixes")
    classes = texts.select(F.col("row").alias("id"), "doc_id", "key", "n", "bins", "parity").join(rows.select("id")
        .distinct(), "id", "left_semi")
    classes = materialize(classes, "candidates")
    verify = _Verifier(docs, classes, k, percent)

    # each member with the pivot of its group, as long as that joins components
    x = rows.select("token", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("i").alias("ix"))
    degree = rows.groupBy("id").agg(F.count("*").alias("degree"))
    placed = materialize(x.withColumn("cx", F.col("x")).join(degree.withColumnRenamed("id", "x"), "x"), "open-prefixes")
    links = tried = None
    for turn in range(PIVOT_ROUNDS):
        prefer = F.col("degree") if turn == 0 else F.xxhash64(F.lit(turn), "cx")
        heads = placed.groupBy("token").agg(F.max(F.struct(prefer.alias("prefer"), (-F.col("x")).alias("minus"), F.col(
            "nx").alias("ny"), F.col("ix").alias("iy"), F.col("cx").alias("cy"))).alias("p"))
        pivots = heads.select("token", (-F.col("p.minus")).alias("y"), "p.ny", "p.iy", "p.cy")
        star = _oriented(placed.join(pivots, "token").where("cx <> cy"), percent).select("a", "b").distinct()
        star = materialize(_alike(star if tried is None else star.join(tried, ["a", "b"], "left_anti"), classes,
            percent), "pivot-pairs")
        if star.isEmpty():
            break
        tried = star if tried is None else tried.unionByName(star)
        new = materialize(verify(star), "pivot-links")
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        parts = components(links)
        placed = placed.drop("cx").join(parts.select(F.col("id").alias("x"), "component"), "x", "left").withColumn("cx",
            F.coalesce("component", "x")).drop("component")
        several = placed.groupBy("token").agg(F.min("cx").alias("lo"), F.max("cx").alias("hi")).where(
            "lo <> hi").select("token")
        placed = materialize(placed.join(several, "token"), "open-prefixes")

    # then every pair from two components: a smaller set meets larger ones of its own band of sizes and of the next, as others are too large
    y = placed.select("token", F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("ix").alias("iy"), F.col("cx")
        .alias("cy"))
    band = lambda n: F.floor(F.log(F.col(n).cast("double")) / np.log(100 / min(percent, 99)) * (1 - 1e-9)).cast(
        "int")
    y = y.withColumn("band", F.explode(F.array(band("ny"), band("ny") + 1)))
    both = _with_parity(placed, classes, "x").withColumn("band", band("nx")).join(_with_parity(y, classes, "y"), [
        "token", "band"])
    both = both.where("cx <> cy and (nx > ny or (nx = ny and x > y))").where(_few_apart("x", "y", percent))
    cross = _oriented(both, percent).select("a", "b").distinct()
    cross = materialize(_alike(cross if tried is None else cross.join(tried, ["a", "b"], "left_anti"), classes,
        percent), "other-pairs")
    new = verify(cross)
    parts = components(new if links is None else links.unionByName(new))

    least = of_key.join(parts, "id", "left").select("key", "least", F.coalesce("component", "id").alias("component"))
    names = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(names, "component").select("key", "component", "component_id")
    named = texts.join(named, "key", "left")
    return named.select("row", "th", "component", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0,
        F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group: that of the smallest doc_id (null last), of the first text where several share it.  Texts without shingles stay.

    Rows are told apart by doc_id and text; of rows that agree in both the one whose other columns come first, as text, stays."""
    columns, docs = docs.columns, packed(docs, ("doc_id", "text"))
    texts = _grouped(docs, k, percent).where("n_shingles > 0").select("component", "doc_id", "th", "row")
    first = texts.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias(
        "none"), "doc_id", "row")).alias("first")).where("n > 1")
    same = texts.join(first, "component").groupBy(F.col("doc_id").alias("_id"), F.col("th").alias(
        "_th")).agg(F.bool_or(F.col("row") == F.col("first.row")).alias("_stays"), F.count("*").alias("_n"))
    looked_at = materialize(same.where("not _stays or _n > 1"), "near-copies")
    at = docs["doc_id"].eqNullSafe(looked_at["_id"]) & (_text_hash(docs) == looked_at["_th"])
    rest = docs.join(looked_at, at, "left_anti")
    repeated = docs.join(looked_at.where("_stays"), at, "left_semi")
    whole = F.struct(*docs.columns)
    one = repeated.groupBy(F.col("doc_id").alias("_id"), _text_hash(repeated).alias("_th")).agg(F.min_by(whole,
        whole.cast("string")).alias("_row"))
    return unpacked(rest.unionByName(one.select("_row.*")), columns, ("doc_id", "text"))
