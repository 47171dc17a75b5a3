"""Exact Jaccard self-join on word shingles with PartEnum signatures, and the groups that its links make.

Sets whose Jaccard similarity is at least num/100 differ in at most (|A| + |B|) * (100 - num) / (100 + num) elements. Sizes
are cut into bands; for the largest difference k of a band the element domain is hash-partitioned into n1 groups of n2 cells.
Some group then holds at most k2 differences, so the sets agree on n2 - k2 of its cells, and one signature for each such
choice of cells is enumerated. `spare` more groups make sure of spare + 1 such groups, so that a set may leave out the
signatures of cells without elements, on which unrelated sets would meet, unless it has more than `spare` groups with one.

Copies are taken together first: rows with equal sets make a class, and its least id stands for it. Two tests, both exact,
then rule out what cannot link. A set's link partner shares a known number of signatures with it, so sets that share fewer
with all others together go. Of what is left the elements that two sets hold are counted: an intersection is no larger than
the count of such elements of either side, which most sets that only share passages with others fail.

Buckets of equal signatures are never expanded into all their pairs. Each member is first verified against the least id of
one of its buckets, its pivot; links make components; then only pairs of different components that still share a bucket are
verified as well, if the bound on their intersection lets them. Two sets with one pivot have a sharper one: inside the pivot
they share no more than either shares with it, and outside no more than either has of elements that others hold. No link
between different components stays unseen.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch, anti_join, batch_rows, bounded_batches, semi_join, unused
from corpusmill.llm.components import components

#: Signatures or elements that one job shuffles, and the bits that tell jobs apart: there are at most 2 ** SLICE_BITS, and more rows go into larger slices.
SLICE, SLICE_BITS = 8_000_000, 4
#: Bits of the sketch that goes with a row into the buckets, at most; longer sets are sketched again by their size.
ROW_SKETCH = 2048
_U = np.uint64


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix finaliser)."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 40_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text, A-Z lower-cased, words cut at ASCII white space.

    Fewer than k words make one shingle; no word (or a null) makes none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(_WORDS.__getitem__, words), _U, len(words))
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, _U)
    for j in range(width):
        out = _mix(out ^ h[j : len(h) - width + 1 + j], j)
    return np.unique(out)


class PartEnum:
    """The signature scheme for one threshold, in hundredths."""

    def __init__(self, num: int):
        if not 50 < num <= 100:
            raise ValueError("the threshold must be over 50 and at most 100 hundredths")
        self.num, self._bands, self._plans = num, [(1, 1)], {}
        self._ratio = max(1.4, 100 / num + 0.05)

    def band(self, size: int) -> int:
        while self._bands[-1][0] <= size:  # the band after a size's own exists as well
            low = self._bands[-1][1] + 1
            self._bands.append((low, max(low * 100 // self.num, int(low * self._ratio))))
        return next(i for i in range(len(self._bands) - 1, -1, -1) if self._bands[i][0] <= size)

    def plan(self, tag: int) -> tuple | None:
        """(groups, cells of a group, choices of cells, spare) for the sets that meet under a band's tag; None if they must be equal."""
        if tag not in self._plans:
            low, high = self._bands[tag]
            k = 2 * high * (100 - self.num) // (100 + self.num)
            self._plans[tag] = self._choose(k, low) if k else None
        return self._plans[tag]

    @staticmethod
    def _choose(k: int, size: int) -> tuple:
        options = []
        for cells, differ in ((1, 0), (3, 1), (4, 1), (4, 2), (5, 2)):
            least = k // (differ + 1) + 1
            choices = list(itertools.combinations(range(cells), cells - differ))
            spare = 0
            while True:
                groups = least + spare
                cover = size / groups * (cells - differ) / cells
                mean = groups * len(choices) * math.exp(-cover)  # groups with an empty choice, about Poisson
                sure = spare >= mean + 3.3 * math.sqrt(mean) if mean > 1e-3 else True
                if sure or cover < 1.5:
                    break
                spare += 1
            options.append((cover < (5 if k <= 8 else 2.2), not sure, groups * len(choices), groups, cells, choices, spare))
        *_, groups, cells, choices, spare = min(options, key=lambda o: o[:3])
        return groups, cells, np.array(choices), spare

    def tagged(self, h: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """For a set's own band and the next: its signatures there, and how many of them a partner that it meets there shares at least."""
        size = len(h)
        own = self.band(size)
        where, what = _mix(h, 11), _mix(h, 12)
        out = []
        for tag in (own, own + 1):
            low, high = self._bands[tag]
            partner = min(high, size * 100 // self.num)
            plan = self.plan(tag)
            if partner < low or plan is None:
                out.append((np.zeros(0, _U), 1))
                continue
            groups, cells, choices, spare = plan
            cell = ((where >> _U(32)) * _U(groups) >> _U(32)) * _U(cells) + ((where & _U(2**32 - 1)) * _U(cells) >> _U(32))
            content = np.zeros(groups * cells, _U)
            np.add.at(content, cell.astype(np.int64), what)
            filled = np.bincount(cell.astype(np.int64), minlength=groups * cells).reshape(groups, cells) > 0
            content = content.reshape(groups, cells)
            empty = ~filled[:, choices].any(axis=2)
            named = np.arange(groups * len(choices), dtype=_U).reshape(groups, len(choices)) + _U(tag << 40)
            # the sum of the chosen cells' contents, and which choice of which group of which band it is
            made = _mix(_mix(content[:, choices].sum(axis=2, dtype=_U), 13) ^ _mix(named, 14), 15)
            weak = int(empty.any(axis=1).sum())
            # a group with at most cells - chosen differences agrees on a choice; so many groups have more at most
            differ = cells - choices.shape[1]
            broken = (size + partner) * (100 - self.num) // (100 + self.num) // (differ + 1)
            # whoever has more weak groups than `spare` keeps all signatures, but its partner may have left out those of `spare` groups
            out.append((made.ravel(), max(1, groups - broken - spare)) if weak > spare else (made[~empty], max(1, groups - broken - weak)))
        return out

    def signatures(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([s for s, _ in self.tagged(h)])


def _ends(values: np.ndarray) -> list[int]:
    """Where each range of the highest bits ends in sorted values."""
    return np.searchsorted(values, np.arange(1, 1 << SLICE_BITS, dtype=_U) << _U(64 - SLICE_BITS)).tolist() + [len(values)]


def _part(values: str, ends: str, slices: int, k: int) -> Column:
    """The k-th of so many slices (a power of two) of a sorted array, cut by its ends."""
    width = (1 << SLICE_BITS) // slices
    start = F.element_at(ends, k * width) if k else F.lit(0)
    return F.slice(values, start + 1, F.element_at(ends, (k + 1) * width) - start)


def _sets(docs: DataFrame, k: int, num: int) -> DataFrame:
    """id, n, a 128-bit digest (d1, d2) of the set, and for its own band and the next its sorted signatures (s0, s1), the ends of their slices (e0, e1) and how many of them a partner shares (r0, r1), for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, longs, ints = PartEnum(num), pa.list_(pa.int64()), pa.list_(pa.int32())
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                h = shingles(text, k)
                if not len(h):
                    rows.append((0, *[None] * 8))
                    continue
                (s0, r0), (s1, r1) = scheme.tagged(h)
                s0, s1 = np.sort(s0), np.sort(s1)
                rows.append((len(h), *(int(_mix(h, salt).sum(dtype=_U).view(np.int64)) for salt in (21, 22)), s0.view(np.int64), s1.view(np.int64), _ends(s0), _ends(s1), r0, r1))
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            types = (pa.int64(), pa.int64(), pa.int64(), longs, longs, ints, ints, pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "n", "d1", "d2", "s0", "s1", "e0", "e1", "r0", "r1"])

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, s0 array<long>, s1 array<long>, e0 array<int>, e1 array<int>, r0 int, r1 int")


def _parities(h: np.ndarray, bits: int) -> np.ndarray:
    """The parity sketch of a set: for each of 2^x places whether an odd number of elements falls there. Two sets differ in at least as many elements as sketches in bits."""
    odd = np.bincount((_mix(h, 23) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _set_arrays(docs: DataFrame, k: int) -> DataFrame:
    """id, n, the set's sorted hashes h, the ends e of their slices, a parity sketch f of at least four bits an element and one of a bounded size, g, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
            bits = [max(64, 1 << (4 * len(h)).bit_length()) for h in sets]
            fine, rough = ([_parities(h, min(b, most)) for h, b in zip(sets, bits, strict=True)] for most in (1 << 62, ROW_SKETCH))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([h.view(np.int64) for h in sets], longs), pa.array(map(_ends, sets), pa.list_(pa.int32())), pa.array(fine, longs), pa.array(rough, longs)], names=["id", "n", "h", "e", "f", "g"])

    return docs.mapInArrow(run, "id long, n long, h array<long>, e array<int>, f array<long>, g array<long>")


def _apart(a: str, b: str) -> Column:
    """Differing bits of two parity sketches; a longer one is folded in half, for its places are those of the shorter one and one bit more."""
    count = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    half = lambda x: (F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q))
    x, y = F.col(a), F.col(b)
    return F.when(F.size(x) == F.size(y), count(x, y)).when(F.size(x) == 2 * F.size(y), count(folded(x), y)).when(2 * F.size(x) == F.size(y), count(x, folded(y))).otherwise(F.lit(0))


def _slices(rows: int) -> int:
    """A power of two, so that slices are whole ranges of the highest bits."""
    return 1 << min(SLICE_BITS, max(0, (rows - 1) // SLICE).bit_length())


class JaccardJoin:
    """One run over a table (id, text): id is a long that names a text. unique: no id comes twice; else rows that repeat an id repeat its text."""

    def __init__(self, docs: DataFrame, k: int = 5, num: int = 80, unique: bool = True):
        bounded_batches(docs.sparkSession)
        self.docs, self.k, self.num, self.unique = docs, k, num, unique
        self.scratch = Scratch(docs.sparkSession, "jaccard")

    def _met(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) with the size of their sets' intersection and both sizes na and nb."""
        side = lambda x: sets.select(F.col("id").alias(x), F.col("h").alias("h" + x), F.col("n").alias("n" + x))
        both = pairs.join(side("b"), "b").join(side("a"), "a")
        return both.select("a", "b", F.size(F.array_intersect("ha", "hb")).cast("long").alias("common"), "na", "nb")

    def _linked(self) -> Column:
        return 100 * F.col("common") >= self.num * (F.col("na") + F.col("nb") - F.col("common"))

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that do link. A sketch of a sixteenth of the set's size rules out most that don't; the others meet in whole."""
        side = lambda x: sets.select(F.col("id").alias(x), F.col("f").alias("f" + x), F.col("n").alias("n" + x))
        s = self.scratch
        pairs = s.write("rest-pairs", pairs)
        close = pairs.join(side("b"), "b").join(side("a"), "a").filter(_apart("fa", "fb") * (100 + self.num) <= (F.col("na") + F.col("nb")) * (100 - self.num)).select("a", "b")
        links = s.write("rest-links", self._met(s.write("rest-close", close), sets).filter(self._linked()).select("a", "b"))
        s.drop("rest-pairs", "rest-close")
        return links

    def _possible(self, x: str, y: str) -> Column:
        """Whether two sets may link by their sizes n and their numbers u of elements that some other set holds too."""
        total = F.col(f"{x}.n") + F.col(f"{y}.n")
        bound = F.least(f"{x}.u", f"{y}.u") * (100 + self.num) >= total * self.num
        return bound & (F.col(f"{x}.n") * 100 >= F.col(f"{y}.n") * self.num) & (F.col(f"{y}.n") * 100 >= F.col(f"{x}.n") * self.num)

    def _shared(self, live: DataFrame, total: int) -> DataFrame:
        """sig, id and tag of the signatures that two rows hold."""
        s, slices = self.scratch, _slices(total)
        # to find them, 48 bits and a count are enough: a chance meeting of two signatures only lets rows through that the exact steps below part again
        short = F.shiftright("sig", 16)

        def make(k: int) -> DataFrame:
            of = lambda t: live.select(F.explode(_part(f"s{t}", f"e{t}", slices, k)).alias("sig"), "id", F.lit(t).alias("tag"))
            own = of(0).unionByName(of(1))
            often = s.write(f"often-{k}", own.groupBy(short.alias("short")).agg(F.count("*").alias("c")).filter("c > 1").select("short"))
            return own.join(often, short == F.col("short"), "left_semi")

        return s.write_slices("rows", slices, make)

    def _held(self, sets: DataFrame, total: int) -> DataFrame:
        """id and u: how many of the set's elements another of these sets holds as well."""
        s, slices = self.scratch, _slices(total)

        def make(k: int) -> DataFrame:
            own = sets.select(F.explode(_part("h", "e", slices, k)).alias("x"), "id")
            often = s.write(f"common-{k}", own.groupBy("x").agg(F.count("*").alias("c")).filter("c > 1").select("x"))
            return own.join(often, "x", "left_semi").groupBy("id").agg(F.count("*").alias("u"))

        return s.write_slices("held", slices, make).groupBy("id").agg(F.sum("u").alias("u"))

    def groups(self) -> DataFrame:
        """id, n and component of every row: the least id reachable by links, its own where it has none."""
        s, write = self.scratch, self.scratch.write
        with batch_rows(self.docs.sparkSession, 100):  # little memory beside the shuffles
            sets = write("sets", _sets(self.docs, self.k, self.num))
        facts = write("facts", sets.select("id", "n", "d1", "d2", "r0", "r1", (F.size("s0") + F.size("s1")).alias("m")))
        # classes of equal sets; only those with several members are kept
        repeated = write("classes", facts.filter("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).filter("c > 1").drop("c"))
        member = write("members", facts.select("id", "n", "d1", "d2").join(repeated, ["d1", "d2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")))
        copies = member.filter(F.col("rep") != F.col("id")).select("id")
        once = lambda df, *keys: df if self.unique else df.dropDuplicates(list(keys))
        live = write("live", once(anti_join(sets.filter("n > 0").select("id", "s0", "s1", "e0", "e1"), copies, "id", "id"), "id"))
        s.drop("sets")
        s.release()
        rows = self._shared(live, int(facts.agg(F.sum("m")).first()[0] or 0))
        s.drop("live")
        # a partner shares a known number of signatures, so whoever shares fewer with all others has none
        of = lambda t: facts.select(F.col("id").alias("i"), F.lit(t).alias("t"), F.col(f"r{t}").alias("need"))
        need = once(of(0).unionByName(of(1)), "i", "t")
        have = rows.groupBy("id", "tag").agg(F.count("*").alias("c"))
        able = write("able", have.join(need, (F.col("id") == F.col("i")) & (F.col("tag") == F.col("t")) & (F.col("c") >= F.col("need"))).select("id", "tag"))
        with batch_rows(self.docs.sparkSession, 100):
            chosen = write("chosen", _set_arrays(once(semi_join(self.docs, able.select("id"), "id", "id"), "id"), self.k))
        s.release()
        # and an intersection is no larger than the number of elements that others hold
        held = self._held(chosen, int(chosen.agg(F.sum("n")).first()[0] or 0))
        alive = write("alive", chosen.select("id", "n", "g").join(held, "id").filter(F.col("u") * 100 >= F.col("n") * self.num))
        rows = write("open", rows.join(able, ["id", "tag"], "left_semi").join(alive.select("id", "n", "u"), "id").select("sig", "tag", F.col("id").alias("cls"), "n", "u"))
        s.drop("rows", "held")
        s.release()
        # first, each class against the least class of its buckets
        pivots = write("pivots", rows.groupBy("sig").agg(F.min(F.struct("cls", "n", "u")).alias("p"), F.max("cls").alias("q")).filter("p.cls < q").select("sig", "p.*"))
        stars = rows.alias("x").join(pivots.alias("p"), F.col("x.sig") == F.col("p.sig")).filter((F.col("p.cls") < F.col("x.cls")) & self._possible("x", "p"))
        stars = write("stars", stars.groupBy(F.col("x.cls").alias("b")).agg(F.min("p.cls").alias("a")).select("a", "b"))
        met = write("met", self._met(stars, chosen))
        links = write("links", met.filter(self._linked()).select("a", "b"))
        found = components(links, s, "cc1")
        # then what still shares a bucket across components; a set without a pivot is its own
        placed = rows.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
        placed = write("placed", placed)
        mixed = write("mixed", placed.groupBy("sig").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).filter("p < q").select("sig"))
        pivot = met.select(F.col("b").alias("cls"), F.col("a").alias("pivot"), F.col("common").alias("inside"))
        last = placed.join(mixed, "sig", "left_semi").join(alive.select(F.col("id").alias("cls"), "g"), "cls").join(pivot, "cls", "left")
        last = write("last", last.withColumns({"pivot": F.coalesce("pivot", "cls"), "inside": F.coalesce("inside", "n")}))
        s.drop("open", "pivots", "placed")
        x, y = last.alias("x"), last.alias("y")
        most = F.least("x.inside", "y.inside") + F.least(F.col("x.u") - F.col("x.inside"), F.col("y.u") - F.col("y.inside"))
        sharp = (F.col("x.pivot") != F.col("y.pivot")) | (most * (100 + self.num) >= (F.col("x.n") + F.col("y.n")) * self.num)
        once = F.col("x.tag") + F.col("y.tag") < 2  # sets of one band meet under their own tag, neighbours under one's own and the other's next
        near = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.comp") != F.col("y.comp")) & once & self._possible("x", "y") & sharp
        near &= _apart("x.g", "y.g") * (100 + self.num) <= (F.col("x.n") + F.col("y.n")) * (100 - self.num)
        pairs = x.join(y, near).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
        more = self._verified(pairs, chosen)
        s.drop("last", "mixed", "chosen", "facts")
        found = components(links.unionByName(more), s, "cc2")
        out = member.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        return out.select("id", "n", F.coalesce("component", "rep", "id").alias("component"))


def _named(docs: DataFrame) -> tuple[DataFrame, Column, bool]:
    """The rows (doc_id, id, text), the expression of id on docs, and whether ids are unique.

    A doc_id is its row's name. Where some are null or come twice, a hash of doc_id and text is, so that each row is judged by its own text.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    unique = not docs.groupBy(doc_id.alias("i")).agg(F.count("*").alias("c")).filter("i IS NULL OR c > 1").limit(1).count()
    key = doc_id if unique else F.xxhash64(doc_id, text)
    return docs.select(doc_id.alias("doc_id"), key.alias("id"), text.alias("text")), key, unique


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80) -> DataFrame:
    """Groups of near-duplicates: doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Two rows link when 100 * |A and B| >= num * |A or B| over their sets of k-word shingles. Empty, null and white-space-only
    texts have an empty set and link with nothing. component_id is the least doc_id in the group; null doc_ids come last, and
    a group of nulls has a null. Rows with one doc_id and different texts are judged each by its text. An empty table gives no rows.
    """
    rows, _, unique = _named(docs)
    found = JaccardJoin(rows.select("id", "text"), k, num, unique).groups()
    if unique:
        return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    names = rows.select("id", "doc_id").distinct()
    named = found.join(names, "id")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def near_duplicate_stage(docs: DataFrame, k: int = 5, num: int = 80) -> DataFrame:
    """One row of each group stays, that with the least doc_id (a null comes last); all columns as they were, whatever their names.

    Texts without words link with nothing and stay. Of rows with one doc_id and one text any one stays; rows with one doc_id and different texts are different documents.
    """
    rows, key, unique = _named(docs)
    later = Scratch(docs.sparkSession, "dedup")
    found = later.write("found", JaccardJoin(rows.select("id", "text"), k, num, unique).groups())
    if unique:
        return anti_join(docs, later.write("dropped", found.filter("component <> id").select("id")), key, "id")
    # the survivor of a group by its doc_id, and one row of it
    named = found.filter("n > 0").select("id", "component").distinct().join(rows.select("id", "doc_id").distinct(), "id")
    best = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id"))["id"].alias("id"))
    kept = later.write("kept", best.select("id"))
    name, wordless = unused(docs, "_row"), found.filter("n = 0").select("id").distinct()
    marked = docs.withColumn(name[0], key)
    one = semi_join(marked, kept, name[0], "id").dropDuplicates(name)
    return one.unionByName(semi_join(marked, later.write("wordless", wordless), name[0], "id")).drop(*name)
