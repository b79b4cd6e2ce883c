"""Exact n-gram Jaccard join that skips by position and derives answers from similar sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.llm.components import components
from weftline.llm.store import Scratch, bounded_batches, discard, sized, written
from weftline.llm.words import chunks, mix64, shingles, words

_U = np.uint64
_SIG, _PART, _PLACE = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0x9E3779B97F4A7C15)
#: Bits of a token that name its size class.
CLASS_BITS = 6
#: One part in ``SPARE`` of the largest size of a class is added to the parts that differences can touch, so that a link shows in many.
SPARE = 50


@dataclass(frozen=True)
class Classes:
    """Size classes of sets, and into how many parts the sets of a class are cut.

    Two sets x, y with 100 * overlap >= percent * union differ in at most ``most(|x| + |y|)`` shingles. The hash space is cut into so many parts
    that more of them than these are left over: of the ``parts`` of a class two linked sets have at least parts - most(|x| + |y|) wholly
    in common. A pair is sought in the class of its smaller set, so a set is listed in its own class and, if a smaller partner
    can be there, in the one below."""

    percent: int

    @property
    def lows(self) -> list[int]:
        """The smallest size of each class; no link spans more than two neighbouring ones."""
        ratio, out = max(1.5, 105 / self.percent), [1]
        while out[-1] < 1 << 40 and len(out) < 1 << CLASS_BITS:
            out.append(max(out[-1] + 1, -int(-out[-1] * ratio // 1)))
        return out

    def most(self, sizes):
        """The most shingles in which linked sets of ``sizes`` (both together) can differ; for numbers, arrays and columns."""
        if isinstance(sizes, Column):
            return F.floor(sizes * (100 - self.percent) / (100 + self.percent) + 1e-9).cast("long")
        return sizes * (100 - self.percent) // (100 + self.percent)

    @property
    def parts(self) -> list[int]:
        tops = [x - 1 for x in self.lows[1:]]
        return [int(self.most(u + u * 100 // self.percent)) + 1 + u // SPARE for u in tops]

    @property
    def shared(self) -> list[int]:
        """How many parts linked sets are asked to share within their first ones; never more than are left over."""
        return [1 + (x - 1) // (3 * SPARE) for x in self.lows[1:]]


def signature(s: np.ndarray) -> int:
    """A hash of a set. Sets of one hash are taken as equal: among n different sets about n * n / 2**65 pairs are so by chance."""
    return int((mix64(np.add.reduce(mix64(s ^ _SIG), keepdims=True) + _U(len(s)))).view(np.int64)[0])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))


def part_tokens(flat: np.ndarray, sizes: np.ndarray, cls: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One token for each part of each set (the sorted hashes of all sets end to end): a hash of the shingles that lie in the part, of
    its place and, in the lowest bits, of the class. Returns the tokens end to end, and how many each set has."""
    m = parts[cls]
    if not len(m):
        return np.zeros(0, dtype=np.uint64), m
    first = np.concatenate(([0], np.cumsum(m)))
    part = ((flat >> _U(32)) * np.repeat(m, sizes).astype(np.uint64) >> _U(32)).astype(np.int64) + np.repeat(first[:-1], sizes)
    run = np.concatenate((np.zeros(1, dtype=np.uint64), np.add.accumulate(mix64(flat ^ _PART))))
    cut = np.searchsorted(part, np.arange(first[-1] + 1))
    place = np.arange(first[-1]) - np.repeat(first[:-1], m)
    h = mix64((run[cut[1:]] - run[cut[:-1]]) + mix64(place.astype(np.uint64) * _PLACE + (cut[1:] - cut[:-1]).astype(np.uint64)))
    return (h >> _U(CLASS_BITS) << _U(CLASS_BITS)) | np.repeat(cls, m).astype(np.uint64), m


def shingle_sets(docs: DataFrame, n_words: int, percent: int, *, key: Column | None = None) -> DataFrame:
    """doc_id, ``key`` (a long of the row, if given), n (distinct shingles), sig (a hash of the set; null if empty) and the tokens of the
    set's parts in its own class (own) and in the one below (below)."""
    own = [0] if key is None else [0, 2]
    kinds = Classes(percent)
    lows, parts = np.array(kinds.lows), np.array(kinds.parts)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                sets = list(shingles(words(c), n_words))
                n = np.array([len(s) for s in sets], dtype=np.int64)
                cls = np.searchsorted(lows, n, side="right") - 1
                under = (cls > 0) & (n * percent <= 100 * (lows[np.maximum(cls, 0)] - 1))
                got = []
                for some, of in ((n > 0, cls), (under, cls - 1)):
                    mine = [s for s, x in zip(sets, some.tolist(), strict=True) if x]
                    tokens, m = part_tokens(np.concatenate(mine) if mine else np.zeros(0, dtype=np.uint64), n[some], of[some], parts)
                    count = np.zeros(len(n), dtype=np.int64)
                    count[some] = m
                    got.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(tokens.view(np.int64))))
                sig = pa.array([signature(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(c.lo, c.hi - c.lo).cast(pa.int64()) for i in own), pa.array(n), sig, *got], [*(batch.schema.names[i] for i in own), "n", "sig", "own", "below"])

    passed = [] if key is None else [key.alias("text_key")]
    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *passed).mapInArrow(make, f"doc_id long, {'text_key long, ' if passed else ''}n long, sig long, own array<bigint>, below array<bigint>")


def _fits(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


_TEST = "a long, b long, an long, bn long, o long, linked boolean, diff array<bigint>"


def tested(docs: DataFrame, pairs: DataFrame, sets: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with the sizes and the exact overlap ``o`` of their whole sets, whether they link, and (for those that share 70 %
    of the larger one) the shingles that only one of them has.

    A set's pairs are tested together, in parts of about 64, each part with the text of ``a`` and of its ``b``s;
    only texts in pairs move. ``sets`` has (sig, rep_id), a document of each set.
    """
    ways = pairs.groupBy("a").agg(F.ceil(F.count("*") / 64).cast("int").alias("ways"))
    lead = ways.select("a", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("salt"), F.col("a").alias("sig"), F.lit(0).alias("role"))
    tail = pairs.join(ways, "a").select("a", F.pmod(F.xxhash64("b"), F.col("ways")).cast("int").alias("salt"), F.col("b").alias("sig"), F.lit(1).alias("role"))
    need = written(lead.union(tail).join(sets.select("sig", "rep_id"), "sig"), "near-needs")
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = body.join(sized(need, 400_000), F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("a", "salt", "role", "sig", "text")
    got = got.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead_of, lead_set = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keys = [batch.column(i).to_pylist() for i in range(4)]
            for c in chunks(batch.column(4)):
                out: list[tuple] = []
                diff = []
                for i, s in enumerate(shingles(words(c), n_words), c.lo):
                    a, salt, role, sig = (k[i] for k in keys)
                    if signature(s) != sig:  # another text under the same id
                        continue
                    if role == 0:
                        lead_of, lead_set = (a, salt), s
                    elif lead_of == (a, salt):
                        at = np.searchsorted(lead_set, s)
                        at[at == len(lead_set)] = 0
                        same = lead_set[at] == s
                        both = int(np.count_nonzero(same))
                        out.append((a, sig, len(lead_set), len(s), both, 100 * both >= percent * (len(s) + len(lead_set) - both)))
                        if 10 * both >= 7 * max(len(s), len(lead_set)):
                            left = np.ones(len(lead_set), dtype=bool)
                            left[at[same]] = False
                            diff.append(np.concatenate((s[~same], lead_set[left])))
                        else:
                            diff.append(s[:0])
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols[:5]], pa.array(cols[5]), _lists(diff)], ["a", "b", "an", "bn", "o", "linked", "diff"])

    out = written(got.mapInArrow(test, _TEST), "near-tests")
    discard(need)
    return out


def _class(token: Column) -> Column:
    return token.bitwiseAND((1 << CLASS_BITS) - 1).cast("int")


def _per_class(values: list[int], cls: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), cls + 1)


def listed(sets: DataFrame, percent: int) -> DataFrame:
    """Lists (t, sig, c, cl, n, m, pos) of parts that at least two of ``sets`` (a row for each) have alike, as a written table; c is the list's length.

    Sets with too few such parts for any link are left out. The others' parts are in a global order, rare ones first (those that
    no other set has come before all); ``pos`` is a part's position in it, from 1 to the ``m`` parts of the class."""
    kinds = Classes(percent)
    raw = sets.select(F.explode(F.concat("own", "below")).alias("t"), "sig")
    # lengths are combined before the shuffle, and a join can split a long list
    many = raw.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    shared = written(raw.join(many, "t").select("t", "sig", "c", _class(F.col("t")).alias("cl")), "near-shared")
    n, cl = F.col("n"), F.col("cl")
    top = _per_class(kinds.lows[1:], cl) - 1
    reach = F.when(n > top, n + top).otherwise(n + F.floor(n * 100 / percent).cast("long"))
    some = shared.groupBy("sig", "cl").agg(F.count("*").alias("k")).join(sets.select("sig", "n"), "sig")
    some = some.withColumn("m", _per_class(kinds.parts, cl)).where(F.col("k") >= F.col("m") - kinds.most(reach))
    some = written(some.select(F.col("sig").alias("s2"), F.col("cl").alias("cl2"), "n", "m", "k"), "near-some")
    rows = shared.join(sized(some, 200_000), (F.col("sig") == F.col("s2")) & (F.col("cl") == F.col("cl2")))
    # a set's own parts: as many as one text has at most
    pos = F.col("m") - F.col("k") + F.row_number().over(W.partitionBy("sig", "cl").orderBy("c", "t"))
    out = written(rows.select("t", "sig", "c", "cl", "n", "m", pos.alias("pos")), "near-lists")
    discard(shared, some)
    return out


def _stars(lists: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Pairs (a, b, k): in each list that holds several components the set of the highest score leads, and the others of
    another component and a fitting size follow; k is the number of lists in which they do."""
    top = F.max(F.struct("score", "sig", "c", "n")).alias("l")
    lead = lists.groupBy(*keys).agg(top, F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(*keys, F.col("l.sig").alias("a"), F.col("l.c").alias("ac"), F.col("l.n").alias("an"))
    pair = lists.join(lead, keys).where((F.col("sig") != F.col("a")) & (F.col("c") != F.col("ac")) & _fits(F.col("n"), F.col("an"), percent))
    return pair.groupBy("a", F.col("sig").alias("b")).agg(F.count("*").alias("k"), F.first("n").alias("bn"), F.first("an").alias("an"))


def _with_component(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return rows.withColumn("c", F.col("sig"))
    return rows.join(sized(comp, 200_000), F.col("sig") == F.col("v"), "left").withColumn("c", F.coalesce("c", "sig")).drop("v")


def _open(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of lists that hold several components."""
    return rows.join(rows.groupBy(*keys).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(*keys), keys)


def followers(tests: list[DataFrame]) -> DataFrame:
    """(lead, sig, n, ln, o, linked, diff): sets that share most of their shingles with one they were tested against; of several such leaders the one
    with most followers counts, so that a group's sets have the same one."""
    all_ = reduce(DataFrame.union, tests)
    close = all_.where(10 * F.col("o") >= 7 * F.greatest("an", "bn")).select(F.col("a").alias("lead"), F.col("b").alias("sig"), F.col("bn").alias("n"), F.col("an").alias("ln"), "o", "linked", "diff")
    size = close.groupBy("lead").agg(F.count("*").alias("k"))
    best = close.join(sized(size, 200_000), "lead").groupBy("sig").agg(F.max(F.struct("k", "lead", "n", "ln", "o", "linked", "diff")).alias("l"))
    return best.select("l.lead", "sig", "l.n", "l.ln", "l.o", "l.linked", "l.diff")


def differences(follow: DataFrame, keep: Scratch, percent: int) -> tuple[DataFrame, DataFrame]:
    """Index entries (lead, h, sig, n, r, m, few, g, score) of followers by how they differ from their leader, and the probes
    (lead, h, sig, n, r, m, few, over) of those that don't link to it.

    With d shingles of the leader missing and a added, followers x, y overlap in ln - d_x - d_y + (differences that both
    have). With g = (1 - f) d + f a and f = percent / (100 + percent), they link only if at least g_x + g_y - (1 - 2 f) ln of their
    differences are the same; a set links to the leader just if g <= (1 - 2 f) ln. So only an x that doesn't needs to be paired, and has
    over_x + g_y differences in common with any y (see ``alike``). ``r`` is a difference's place among the ``m`` of its set: those that
    many followers have come last, and those of a single one before all."""
    d, a, f = F.col("ln") - F.col("o"), F.col("n") - F.col("o"), percent / (100.0 + percent)
    m = F.size("diff")
    t = follow.withColumn("g", (1 - f) * d + f * a).withColumn("over", F.col("g") - (1 - 2 * f) * F.col("ln"))
    # leaders of which a follower doesn't link: one row each
    leads = t.groupBy("lead").agg(F.min("linked").alias("all")).where("not all").select("lead")
    t = t.join(sized(leads, 200_000), "lead").select("lead", "sig", "n", "linked", "g", "over", m.alias("m"), F.explode("diff").alias("h"))
    t = keep.written(t, "near-diff")
    many = t.groupBy("lead", "h").agg(F.count("*").alias("many"))
    t = t.join(many, ["lead", "h"])
    own = W.partitionBy("lead", "sig")
    t = t.withColumn("r", F.row_number().over(own.orderBy("many", "h"))).withColumn("score", F.round(F.avg(F.log("many")).over(own), 9)).where("many > 1")
    t = t.withColumn("few", 1 + F.floor(F.col("m") / 8))
    first = lambda least: F.col("r") <= F.col("m") - _at_least(least) + F.col("few")
    index = t.where(first(F.col("g"))).select("lead", "h", "sig", "n", "r", "m", "few", "g", "score")
    return index, t.where(~F.col("linked") & first(F.col("over"))).select("lead", "h", "sig", "n", "r", "m", "few", "over")


def _at_least(x: Column) -> Column:
    """A bound as a whole number, at least 1; a millionth less, so that it may be weaker than it is, never stronger."""
    return F.greatest(F.lit(1), F.ceil(x - 1e-6))


def alike(index: DataFrame, probe: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one leader's followers, of different components, that differ from it alike enough. Sets that have ``share`` differences in
    common have ``few`` of them among the first m - share + few of both, so later places of either are skipped."""
    x, y = probe.alias("x"), index.alias("y")
    share, few = _at_least(F.col("x.over") + F.col("y.g")), F.least("x.few", "y.few")
    same = (F.col("x.lead") == F.col("y.lead")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & _fits(F.col("x.n"), F.col("y.n"), percent)
    first = (F.col("x.r") <= F.col("x.m") - share + few) & (F.col("y.r") <= F.col("y.m") - share + few)
    met = x.join(y, same & first).groupBy(F.col("x.sig").alias("p"), F.col("y.sig").alias("q")).agg(F.count("*").alias("k"), F.first(F.least(few, share)).alias("few"))
    return met.where("k >= few").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def across(lists: DataFrame, keep: Scratch, percent: int, *, band: float = 0.04, block: int = 256) -> DataFrame:
    """Pairs (a, b) of sets under different leads that share enough parts within the first ones of both.

    ``lists`` has (t, sig, n, c, cl, m, pos, lead). A list lies in blocks of at most ``block`` sets of one lead and of sizes within a ``band``, which
    know their sizes, components and first position. With D the most differences for the sizes of two blocks, all their pairs are skipped
    where a block begins beyond position D + s: linked sets share s parts before it (see ``listed`` for the order)."""
    kinds = Classes(percent)
    band_of = F.floor(F.log(F.col("n").cast("double")) / float(np.log1p(band))).cast("int")
    # at most as many positions as can count for any partner
    extra = _per_class(kinds.shared, F.col("cl"))
    top = _per_class(kinds.lows[1:], F.col("cl")) - 1
    reach = F.when(F.col("n") > top, F.col("n") + top).otherwise(F.col("n") + F.floor(F.col("n") * 100 / percent).cast("long"))
    cur = lists.where(F.col("pos") <= kinds.most(reach) + extra)
    several = cur.groupBy("t").agg(F.min("lead").alias("l0"), F.max("lead").alias("l1"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("l0 < l1 and c0 < c1").select("t")
    cur = keep.written(cur.join(several, "t").withColumn("band", band_of), "near-open")
    sizes = cur.groupBy("t", "lead", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("ways"))
    one = F.struct("sig", "n", "c", "pos")
    made = cur.join(sizes, ["t", "lead", "band"]).withColumn("part", F.pmod(F.xxhash64("sig"), F.col("ways")))
    made = made.groupBy("t", "lead", "band", "part").agg(
        F.collect_list(one).alias("e"), F.first("cl").alias("cl"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least"), F.max("n").alias("largest"), F.min("pos").alias("first")
    )
    made = keep.written(made, "near-blocks")
    x, y = made.alias("x"), made.alias("y")
    apart = (F.col("x.lo") != F.col("y.hi")) | (F.col("x.hi") != F.col("y.lo"))  # else all are in one component
    near = (100 * F.col("x.largest") >= percent * F.col("y.least")) & (100 * F.col("y.largest") >= percent * F.col("x.least"))
    extra = _per_class(kinds.shared, F.col("x.cl"))
    before = F.greatest("x.first", "y.first") <= kinds.most(F.col("x.largest") + F.col("y.largest")) + extra
    met = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.lead") < F.col("y.lead")) & apart & near & before)
    low = _per_class(kinds.lows, F.col("x.cl"))
    # of two blocks only the pairs that count are made, within one expression
    good = lambda p, q: (p["c"] != q["c"]) & _fits(p["n"], q["n"], percent) & (F.least(p["n"], q["n"]) >= low) & (F.greatest(p["pos"], q["pos"]) <= kinds.most(p["n"] + q["n"]) + extra)
    pairs = F.flatten(F.transform("x.e", lambda p: F.transform(F.filter("y.e", lambda q: good(p, q)), lambda q: F.struct(F.least(p["sig"], q["sig"]).alias("a"), F.greatest(p["sig"], q["sig"]).alias("b")))))
    found = met.select(extra.alias("least"), F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("k"), F.first("least").alias("least"))
    return found.where("k >= least").select("a", "b")


def near_groups(docs: DataFrame, *, n_words: int = 4, percent: int = 85, levels: int = 2, key: Column | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of the exact Jaccard join of all documents.

    Sets: distinct shingles of ``n_words`` words of the whole text; with fewer words the sequence is the one shingle; a null or blank text
    has an empty set and is linked with nothing. Two sets link when 100 * intersection >= percent * union.
    component_id is the smallest doc_id that links reach.

    1. Equal sets become one (their answers are the same).
    2. Each set is cut into parts by its hashes, more than the differences of linked sets can touch (see ``Classes``), and listed under
       those that another set has alike. Sets with too few of them link with nothing.
    3. In each list the set whose parts are shared most leads (of near copies, the one that was copied); those that
       follow it in some share of its lists are tested against it, which gives their exact overlap with it.
    4. Answers of a leader's followers derive from its own: two of them that aren't known to be linked can only link if they differ
       from the leader alike, so they are indexed and paired by these differences (see ``differences``), again by leaders first.
    5. Sets of different leaders, or of none, are paired in the lists of step 2, of which blocks are skipped by position and size (see ``across``).
    Lists whose members are known to be in one component are skipped throughout; all pairs that pass are tested on whole sets, so
    no link between components is lost.

    Repeated rows and repeated ids are taken as they come (each text under its id). Null ids join groups but name none.
    An empty table gives an empty result.

    With ``key`` (a long that tells rows of one id apart, such as a hash of the text) the result is doc_id, text_key and component, a
    number of the component whatever ids it has (null for an empty set).
    """
    keep = Scratch()
    sets_all = written(shingle_sets(docs, n_words, percent, key=key), "near-sets")
    some = sets_all.where("sig is not null")
    sets = keep.written(some.groupBy("sig").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("k")), "near-reps")
    # one row of each set: of those that several rows have, the first of the smallest id's
    multi = sized(sets.where("k > 1").select(F.col("sig").alias("xs"), F.col("rep_id").alias("xd")), 200_000)
    copies = some.join(multi, (F.col("sig") == F.col("xs")) & F.col("doc_id").eqNullSafe(F.col("xd"))).dropDuplicates(["sig"])
    one = some.join(multi, F.col("sig") == F.col("xs"), "left_anti").select("sig", "n", "own", "below").unionByName(copies.select("sig", "n", "own", "below"))
    lists = keep.add(listed(one, percent))
    plain = written(sets_all.select("doc_id", *([] if key is None else ["text_key"]), F.col("n").alias("n_shingles"), "sig"), "near-plain")
    discard(sets_all)

    def run(pairs: DataFrame) -> DataFrame:
        todo = written(pairs.select("a", "b"), "near-pairs")
        out = keep.add(tested(docs, todo, sets, n_words, percent))
        discard(todo)
        return out

    def joined(tests: list[DataFrame]) -> DataFrame | None:
        links = reduce(DataFrame.union, [t.where("linked").select("a", "b") for t in tests])
        return None if links.isEmpty() else components(links)

    # how much of a set others have, by the lengths of its lists
    fame = keep.written(lists.groupBy("sig").agg(F.round(F.sum(F.log("c")) / F.first("n"), 9).alias("score")).withColumnRenamed("sig", "fs"), "near-fame")
    ranked = lists.select("t", "sig", "n", "m").join(sized(fame, 200_000), F.col("sig") == F.col("fs"))
    stars = _stars(_with_component(ranked, None), ["t"], percent)
    parts = F.col("an") * (100 - percent) / (100 + percent)
    first = run(stars.where(F.col("k") >= F.least(F.lit(16), 1 + F.floor(parts / 8))))
    tests, comp = [first], joined([first])
    for _ in range(1, levels):
        entries, _ = differences(followers(tests), keep, percent)
        more = run(_stars(_open(keep.written(_with_component(entries, comp), "near-open"), ["lead", "h"]), ["lead", "h"], percent))
        tests.append(more)
        comp = joined(tests)
    follow = keep.written(followers(tests), "near-follow")
    index, probe = differences(follow, keep, percent)
    within = alike(_with_component(index, comp), _with_component(probe, comp), percent)

    # sets of different leaders, in the lists
    cur = _open(_with_component(lists.drop("c"), comp), ["t"]).join(sized(follow.select("lead", F.col("sig").alias("fs")), 200_000), F.col("sig") == F.col("fs"), "left")
    others = across(cur.withColumn("lead", F.coalesce("lead", "sig")), keep, percent)

    tests.append(run(within.union(others).distinct()))
    comp = joined(tests)

    if key is not None:
        comp = None if comp is None else written(comp, "near-other")
        keep.clear()
        if comp is None:
            return plain.select("doc_id", "text_key", F.col("sig").alias("component"))
        return plain.join(sized(comp, 200_000), F.col("sig") == F.col("v"), "left").select("doc_id", "text_key", F.coalesce("c", "sig").alias("component"))
    if comp is None:
        named = sets.select("sig", F.col("rep_id").alias("name"), "rep_id", "k")
    else:
        c = sets.join(comp, F.col("sig") == F.col("v"))
        low = c.groupBy("c").agg(F.min("rep_id").alias("name"))
        named = keep.written(c.join(low, "c").select(F.col("sig").alias("ns"), "name"), "near-names")
        named = sets.join(named, F.col("sig") == F.col("ns"), "left").select("sig", F.coalesce("name", "rep_id").alias("name"), "rep_id", "k")
    # only sets of several documents, or linked ones, have another name than their document's own id
    other = written(named.where("k > 1 or not (name <=> rep_id)").select("sig", "name"), "near-other")
    keep.clear()
    return plain.join(sized(other, 200_000), "sig", "left").select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"))
