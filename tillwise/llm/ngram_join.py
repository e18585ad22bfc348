"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word n-grams. Documents with equal sets form a class, and classes
of Jaccard similarity of at least a threshold link. Links are found exactly (up to 64-bit hashes of
n-grams), not estimated:

* Sets whose sizes allow a link share a *layout*: one for each power of two of the size, and one
  around each border between two. A layout knows the most n-grams two linked sets can differ in, d,
  deals n-grams by hash to P > d parts, and XORs the hashes of each part. Two linked sets have at
  least P - d equal parts (pigeonhole), hence equal XORs; those are joined.
* A part with fewer than two n-grams says little and is no key, as long as the set has more usual
  parts than it can lose to differences. Sets with too few usual parts also give their small parts,
  under keys of their own; two such sets meet there. A pair with one good set meets at a usual part.
* Joined pairs are cut by a parity sketch: each n-gram flips one bit, so the Hamming distance of
  two sketches can't be above the symmetric difference. What is left is verified on the sets.

Classes that share a key are not paired with each other: each is first joined with one of the key,
the one that shares most keys, and the verified links are merged to components. Only keys whose
classes still lie in different components are looked at again: their classes outside the largest
component are compared with all others by sketches, block by block, and what passes is verified. Where
much passes, as among near copies, first only as many pairs are as merge the components; the last
round verifies all that still pass. So no link between components is lost, and near copies don't
give all their pairs.

Defined results: a document with fewer than n words is one sequence; one without words (or null)
has the empty set and links with nothing. Rows are told apart by doc_id and text, so rows that
repeat both give equal rows. A component's id is its smallest doc_id that isn't null. Of the rows of
a component ``one_of_each`` keeps a single one, where a null doc_id counts as smallest. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm import tokens
from tillwise.llm.common import free_name, keep, keep_few, store, text_key
from tillwise.llm.components import connected
from tillwise.llm.filters import Filter, filter_of

SMALL_PART = 2
SKETCH_BITS = 16  # as a power of two, at most
#: Classes of a key that lie outside its largest component are compared with all in such blocks.
FAR_BLOCK, ALL_BLOCK = 8_000, 32_000
#: Pairs compared at a time.
COMPARED = 1 << 18
#: A block gives up to so many passing pairs for each of its classes, else only those that merge
#: components, in so many rounds; the round after gives all that still pass, so no link is lost.
PASSING, THIN_ROUNDS = 2, 3


@dataclass(frozen=True)
class Join:
    """Links need ``scale`` * intersection >= ``similar`` * union of sets of ``words``-grams."""

    words: int = 3
    similar: int = 90
    scale: int = 100

    def apart(self, both: np.ndarray | int) -> np.ndarray | int:
        """The most n-grams that linked sets of ``both`` n-grams together can differ in."""
        return both * (self.scale - self.similar) // (self.scale + self.similar)

    def partner(self, size: np.ndarray | int) -> np.ndarray | int:
        """The largest size that links with ``size``."""
        return size * self.scale // self.similar

    def parts(self, largest: int) -> int:
        """How many parts a layout deals sets of up to ``largest`` n-grams to: enough for one more
        usual part than can differ, if n-grams fall evenly, with room for chance."""
        apart = int(self.apart(largest + self.partner(largest)))
        for parts in range(apart + 1, 4 * apart + 8):
            mean = largest / parts
            small = parts * np.exp(-mean) * (1 + mean)
            if parts - small >= apart + 1 + 3 * np.sqrt(small):
                return parts
        return apart + 1


def _sets(texts: pa.Array, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of texts, text by text in order, and where each text's begin."""
    found = tokens.words(texts, lower=True)
    hashes = found.hashes()
    runs = tokens.grams(hashes, join.words)
    at, doc = tokens.gram_starts(found.first, join.words)
    value = runs[at]
    few = np.flatnonzero((found.counts > 0) & (found.counts < join.words))
    if len(few):
        whole = [tokens.grams(hashes[found.first[i] : found.first[i + 1]], int(found.counts[i]))[0] for i in few]
        value, doc = np.concatenate([value, np.array(whole, np.uint64)]), np.concatenate([doc, few])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def _fingerprints(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 where it is empty."""
    summed = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(tokens.mix(value + np.uint64(77)), out=summed[1:])
    size = np.diff(first).astype(np.uint64)
    return np.where(size > 0, tokens.mix(summed[first[1:]] - summed[first[:-1]] + size), np.uint64(0))


def _layouts(size: np.ndarray, join: Join) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the home and the border layouts: layout number of each set (-1: not in one), the most it
    can differ from a partner there, and the largest size of the layout."""
    power = np.frexp(np.maximum(size, 1).astype(float))[1].astype(np.int64) - 1
    low, top = 1 << power, (2 << power) - 1
    found = [(np.where(size > 0, 2 * power, -1), join.apart(size + np.minimum(join.partner(size), top)), top)]
    border = 2 << power  # the one above
    under = join.partner(size) >= border
    largest = join.partner(border - 1)
    found.append((np.where(under, 2 * power + 1, -1), join.apart(size + join.partner(size)), largest))
    over = (size >= low) & (size <= join.partner(low - 1)) & (power > 0)  # the one below
    found.append((np.where(over, 2 * power - 1, -1), join.apart(size + low - 1), join.partner(low - 1)))
    return found


def _keys(value: np.ndarray, first: np.ndarray, join: Join, parts_of: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(key, set): a key for each part by which a set may meet another one."""
    size = np.diff(first).astype(np.int64)
    keys, owners = [], []
    for layout, apart, largest in _layouts(size, join):
        chosen = np.flatnonzero((layout >= 0) & (apart > 0))  # sets that can't differ are equal
        if not len(chosen):
            continue
        for top in np.unique(largest[chosen]).tolist():
            if top not in parts_of:
                parts_of[top] = join.parts(top)
        parts = np.array([parts_of[t] for t in largest[chosen].tolist()], np.int64)
        count = size[chosen]
        at = np.repeat(first[chosen] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        owner = np.repeat(np.arange(len(chosen)), count)
        gram = tokens.mix(value[at] ^ (layout[chosen][owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        base = np.cumsum(parts) - parts
        part = base[owner] + ((gram >> np.uint64(32)) * parts[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        held = np.bincount(part, minlength=int(parts.sum()))
        xor = np.zeros(len(held), np.uint64)
        np.bitwise_xor.at(xor, part, tokens.mix(gram))
        whose = np.repeat(np.arange(len(chosen)), parts)
        number = np.arange(len(held)) - base[whose]
        key = tokens.mix(xor + tokens.mix(number.astype(np.uint64) * np.uint64(64) + layout[chosen][whose].astype(np.uint64)))
        usual = held >= SMALL_PART
        rank = np.cumsum(usual)
        rank -= np.concatenate([[0], rank])[base][whose]  # the how manieth usual part of its set
        need = apart[chosen][whose] + 1
        enough = np.bincount(whose, usual, len(chosen)) > apart[chosen]
        given = usual & (~enough[whose] | (rank <= need))
        apart_keys = ~enough[whose]  # too few usual parts: all parts, under keys of their own
        keys += [key[given], tokens.mix(key[apart_keys] ^ np.uint64(0x5DEECE66D))]
        owners += [chosen[whose[given]], chosen[whose[apart_keys]]]
    return np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*owners, np.zeros(0, np.int64)])


def _sketches(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parity sketches: each n-gram flips a bit. The length, a power of two about the set's size,
    can be halved by XORing the halves."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        bits = max(8, min(SKETCH_BITS, int(b - a).bit_length() + 1))
        flips = np.bincount((value[a:b] & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        out.append(np.packbits(flips & 1).tobytes())
    return out


def hamming(one: bytes, other: bytes) -> int:
    """Distance of two parity sketches at the length of the shorter one."""
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    while len(a) != len(b):
        long, b = (a, b) if len(a) > len(b) else (b, a)
        half = len(long) // 2
        a = long[:half] ^ long[half:]
    return int(np.bitwise_count(a ^ b).sum())


def _slim(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), "text", text_key().alias("text_key"))


def document_sets(documents: DataFrame, join: Join) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_hash) of every row; set_hash is null for an empty set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in tokens.slices(batch["text"]):
                value, first = _sets(batch["text"].slice(i, j - i), join)
                size = np.diff(first).astype(np.int64)
                prints = pa.array(tokens.as_signed(_fingerprints(value, first)), mask=size == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), batch["text_key"].slice(i, j - i), pa.array(size), prints],
                    ["doc_id", "text_key", "n_shingles", "set_hash"],
                )

    return _slim(documents).mapInArrow(of, "doc_id long, text_key long, n_shingles long, set_hash long")


def part_keys(documents: DataFrame, join: Join, wanted: Filter | None = None) -> DataFrame:
    """(key, set_hash) of every row's parts, or of those that ``wanted`` may hold."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of: dict[int, int] = {}
        for batch in batches:
            for i, j in tokens.slices(batch["text"]):
                value, first = _sets(batch["text"].slice(i, j - i), join)
                key, owner = _keys(value, first, join, parts_of)
                if wanted is not None:
                    met = wanted.may_hold(key)
                    key, owner = key[met], owner[met]
                prints = tokens.as_signed(_fingerprints(value, first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens.as_signed(key)), pa.array(prints[owner]), batch["doc_id"].slice(i, j - i).take(pa.array(owner))],
                    ["key", "set_hash", "doc_id"],
                )

    return _slim(documents).mapInArrow(of, "key long, set_hash long, doc_id long")


def candidate_sets(documents: DataFrame, join: Join, wanted: Filter) -> DataFrame:
    """(set_hash, grams, sketch, size), once for each set that ``wanted`` may hold."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task; copies that other tasks meet go below
        for batch in batches:
            for i, j in tokens.slices(batch["text"]):
                value, first = _sets(batch["text"].slice(i, j - i), join)
                prints = tokens.as_signed(_fingerprints(value, first))
                held = np.flatnonzero(wanted.may_hold(prints) & (np.diff(first) > 0))
                held = [d for d in held.tolist() if not (int(prints[d]) in seen or seen.add(int(prints[d])))]
                sets = [value[first[d] : first[d + 1]] for d in held]
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
                grams = np.concatenate([*sets, np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prints[held]),
                        pa.array([np.sort(s).tobytes() for s in sets], pa.binary()),
                        pa.array(_sketches(grams, bounds), pa.binary()),
                        pa.array(np.diff(bounds)),
                    ],
                    ["set_hash", "grams", "sketch", "size"],
                )

    found = _slim(documents).mapInArrow(of, "set_hash long, grams binary, sketch binary, size long")
    return found.groupBy("set_hash").agg(*[F.first(c).alias(c) for c in ("grams", "sketch", "size")])


def _passing(join: Join, columns: list[str]):
    """Keeps the pairs whose sketches allow a link."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [batch[n].to_pylist() for n in ("size_a", "size_b", "sketch_a", "sketch_b")]
            kept = [i for i, (m, n, near, far) in enumerate(zip(*known)) if hamming(near, far) <= join.apart(m + n)]
            yield batch.take(pa.array(kept, pa.int64())).select(columns)

    return of


def _linked(join: Join, columns: list[str]):
    """Keeps the pairs whose sets link."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, sets in enumerate(zip(batch["grams_a"], batch["grams_b"])):  # a pair's sets at a time
                joined = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in sets])
                both = len(joined)
                joined.sort()
                shared = int((joined[1:] == joined[:-1]).sum())
                if join.scale * shared >= join.similar * (both - shared):
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64())).select(columns)

    return of


def links(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) of set hashes whose sets link, with their further columns. Sketches, which
    are short, meet first; only the pairs they leave carry their sets."""

    def both(found: DataFrame, *columns: str) -> DataFrame:
        for side in ("a", "b"):
            named = [F.col(c).alias(f"{c}_{side}") for c in columns]
            found = found.join(sets.select(F.col("set_hash").alias(side), *named), side)
        return found.select(*pairs.columns, *[f"{c}_{side}" for c in columns for side in ("a", "b")])

    near = both(pairs, "size", "sketch").mapInArrow(_passing(join, pairs.columns), pairs.schema)
    return both(near, "grams").mapInArrow(_linked(join, pairs.columns), pairs.schema)


def _component_of(keyed: DataFrame, found: DataFrame) -> DataFrame:
    named = found.withColumnRenamed("node", "set_hash")
    return keyed.drop("component").join(named, "set_hash", "left").withColumn(
        "component", F.coalesce("component", "set_hash")
    )


def _merged(found: DataFrame, among: DataFrame) -> DataFrame:
    """(node, component) of ``found``, after the components of ``among`` (node, component), whose
    nodes are components of ``found``, became one."""
    moved = among.select(F.col("node").alias("component"), F.col("component").alias("to"))
    after = found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return after.union(among)


def linked_sets(documents: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """Verified links between set hashes, as many as join the components and not all there are (pairs
    within a component are left out), and (node, component) of the sets they join."""
    met = part_keys(documents, join).groupBy("key").agg(F.count("*").alias("n"))
    shared = filter_of(keep(met.where("n > 1").select("key")), "key")
    rows = part_keys(documents, join, shared).select("key", "set_hash").distinct()
    keyed = store(rows)
    # Keys that the same classes share lead to the same pairs: one of them is kept.
    members = [F.count("*"), *(F.bit_xor(F.xxhash64("set_hash", F.lit(salt))) for salt in (1, 2))]
    several = keep_few(
        keyed.groupBy("key").agg(*(m.alias(f"m{i}") for i, m in enumerate(members))).where("m0 > 1")
    )
    once = several.groupBy("m0", "m1", "m2").agg(F.min("key").alias("key")).select("key")
    # The class that shares most keys comes first: of a group of near copies, the one in the middle.
    often = keyed.join(several.select("key"), "key").groupBy("set_hash").agg((-F.count("*")).alias("order"))
    often = keep_few(often)
    keyed = store(keyed.join(once, "key").join(often, "set_hash"))
    sets = store(candidate_sets(documents, join, filter_of(often, "set_hash")))
    place = F.struct("order", "set_hash")
    pivots = keyed.groupBy("key").agg(F.min(place).alias("pivot"))
    pairs = keyed.join(pivots, "key").select(F.col("set_hash").alias("a"), F.col("pivot.set_hash").alias("b"))
    # Dealt by one end, so that what tells equal pairs apart also joins the sets of that end.
    all_links = keep_few(links(pairs.where("a <> b").repartition("a").distinct(), sets, join))
    found = connected(all_links)
    sketches, thin = sets.select("set_hash", "sketch", "size"), THIN_ROUNDS
    while True:
        apart = keep_few(_apart(keyed, found))
        if apart.isEmpty():
            return all_links, found
        pairs = keep_few(_across(apart, sketches, join, thin > 0))
        fresh = keep_few(links(pairs.drop("thinned").repartition("a").distinct(), sets, join))
        linked = not fresh.isEmpty()
        if linked:
            all_links = all_links.union(fresh.select("a", "b"))
            # Only the components that fresh links join are looked at again, not all links.
            found = keep_few(_merged(found, connected(fresh.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))))
        if pairs.where("thinned").isEmpty():
            return all_links, found
        thin = thin - 1 if linked else 0  # what passes is no link: all that passes is verified


def _apart(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The classes of those keys whose classes lie in several components so far: (key, set_hash,
    component), the key's largest component ``top``, and how many classes the key has, ``all``."""
    left = _component_of(keyed.select("key", "set_hash"), found)
    sizes = left.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("components")
    ).where("components > 1")
    return left.join(largest, "key")


def _across(apart: DataFrame, sketches: DataFrame, join: Join, thin: bool) -> DataFrame:
    """Pairs (a, b) that share a key, lie in different components so far (part_a, part_b) and pass the
    sketches. With ``thin``, a block where more pass than a few for each class gives only as many as
    it takes to merge the components that pass, and says so in ``thinned``.

    Of a key's classes, those outside its largest component are compared with all, in blocks: a row
    holds at most a block of the ones and one of the others, and the pairs of a row are compared by
    their sketches in numpy, so pairs that fail never become rows.
    """
    left = apart.join(sketches, "set_hash")
    left = left.withColumn("far", F.col("component") != F.col("top.component"))
    spread = F.xxhash64("set_hash", "key")
    far_blocks = F.ceil((F.col("all") - F.col("top.n")) / FAR_BLOCK)
    all_blocks = F.ceil(F.col("all") / ALL_BLOCK)

    def every(blocks: Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), blocks - 1)

    def places(far: bool, far_block: Column, all_block: Column) -> Column:
        return F.struct(F.lit(far).alias("one"), far_block.alias("far_block"), all_block.alias("all_block"))

    member = F.struct("set_hash", "component", "sketch", "size")
    ones = F.transform(every(all_blocks), lambda block: places(True, F.pmod(spread, far_blocks), block))
    others = F.transform(every(far_blocks), lambda block: places(False, block, F.pmod(spread, all_blocks)))
    placed = F.when(F.col("far"), F.concat(ones, others)).otherwise(others)
    blocks = left.select("key", member.alias("member"), F.inline(placed)).groupBy("key", "far_block", "all_block").agg(
        F.collect_list(F.when(F.col("one"), F.col("member"))).alias("ones"),
        F.collect_list(F.when(~F.col("one"), F.col("member"))).alias("others"),
    )
    found = "a long, b long, part_a long, part_b long, thinned boolean"
    return blocks.select("ones", "others").mapInArrow(_near(join, thin), found).distinct()


def _folded(sketches: list[bytes], length: int) -> np.ndarray:
    """Sketches at one length, a line each."""
    out = np.zeros((len(sketches), length), np.uint8)
    for line, raw in zip(out, sketches):
        one = np.frombuffer(raw, np.uint8)
        while len(one) > length:
            one = one[: len(one) // 2] ^ one[len(one) // 2 :]
        line[:] = one
    return out.view(np.uint64)


def _merging(parts: np.ndarray, root: dict[int, int]) -> list[int]:
    """Which of the pairs of components merge two that pairs before them haven't; ``root`` has
    what is merged so far."""

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    _, firsts = np.unique(parts, axis=0, return_index=True)
    for i in np.sort(firsts).tolist():
        a, b = (top(x) for x in parts[i].tolist())
        if a != b:
            root[a] = b
            kept.append(i)
    return kept


def _near(join: Join, thin: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ones, others in zip(batch["ones"], batch["others"]):
                sides = []
                for side in (ones.values, others.values):
                    sides.append([side.field(n) for n in ("set_hash", "component", "size")] + [side.field("sketch").to_pylist()])
                length = min((len(x) for s in sides for x in s[3]), default=8)
                (id_a, part_a, size_a, low_a), (id_b, part_b, size_b, low_b) = (
                    [*(c.to_numpy(zero_copy_only=False) for c in s[:3]), _folded(s[3], length)] for s in sides
                )
                most = PASSING * (len(id_a) + len(id_b)) if thin else None
                found = [np.zeros((0, 4), np.int64)]
                merging, root, passed = [np.zeros((0, 4), np.int64)], {}, 0
                step = max(1, COMPARED // max(1, len(id_b)))
                for i in range(0, len(id_a), step):
                    j = slice(i, i + step)
                    apart = np.zeros((len(id_a[j]), len(id_b)), np.int32)
                    for w in range(low_a.shape[1]):
                        apart += np.bitwise_count(low_a[j, w][:, None] ^ low_b[:, w][None, :])
                    both = size_a[j][:, None] + size_b[None, :]
                    x, y = np.nonzero((apart <= join.apart(both)) & (part_a[j][:, None] != part_b[None, :]))
                    if not len(x):
                        continue
                    pair = np.stack([id_a[j][x], id_b[y], part_a[j][x], part_b[y]], 1)
                    turned = pair[:, 0] < pair[:, 1]  # a pair met from both sides is one
                    pair[turned] = pair[turned][:, [1, 0, 3, 2]]
                    passed += len(pair)
                    if most is None or passed <= most:
                        found.append(pair)
                    if most is not None:
                        merging.append(pair[_merging(pair[:, 2:], root)])
                if not passed:
                    continue
                thinned = most is not None and passed > most
                pairs = np.unique(np.concatenate(merging if thinned else found), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(pairs[:, c]) for c in range(4)), pa.array(np.full(len(pairs), thinned))],
                    ["a", "b", "part_a", "part_b", "thinned"],
                )

    return of


def _component_rows(documents: DataFrame, join: Join) -> DataFrame:
    """(doc_id, text_key, n_shingles, component) of every row; component is null for an empty set."""
    rows = keep(document_sets(documents, join))
    found = linked_sets(documents, join)[1].withColumnRenamed("node", "set_hash")
    rows = rows.join(found, "set_hash", "left").withColumn("component", F.coalesce("component", "set_hash"))
    return keep(rows.select("doc_id", "text_key", "n_shingles", "component"))


def ngram_join(documents: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id that
    links reach."""
    rows = _component_rows(documents, join)
    smallest = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(smallest, "component", "left").select(
        "doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(documents: DataFrame, join: Join) -> DataFrame:
    """One row of each component and all rows without words. The one has the smallest (doc_id,
    text_key), a null doc_id before all others; of rows that repeat both, the smallest columns."""
    rows = _component_rows(documents, join)
    same_rows = rows.where("component IS NOT NULL").groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = same_rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_key", "n")).alias("first"))
    wordless = rows.where("component IS NULL").select("doc_id", "text_key").distinct()
    kept = keep(
        first.select("first.doc_id", "first.text_key", (F.col("first.n") > 1).alias("repeated"))
        .union(wordless.select("doc_id", "text_key", F.lit(False)))
    )
    key = free_name(documents, "join_key")
    df = documents.select(*documents.columns, text_key().alias(key))

    def those(chosen: DataFrame) -> DataFrame:
        same = df["doc_id"].eqNullSafe(chosen["doc_id"]) & (df[key] == chosen["text_key"])
        return df.join(chosen, same, "left_semi")

    once = those(kept.where("NOT repeated")).select(*documents.columns)
    several = those(kept.where("repeated")).groupBy("doc_id", key)
    return once.union(several.agg(F.min(F.struct(*documents.columns)).alias("row")).select("row.*"))
