"""Near-dedup by b-bit MinHash: banded candidates, packed signatures, exact confirmation."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions.ship import map_arrow, ship
from trialweave.llm.common import having, saved, small_batches

#: Words in a shingle; the least similarity of a link, in hundredths.
WORDS, SIMILAR = 5, 75
#: Minima per signature, rows in a band, low bits kept of each minimum.
MINIMA, ROWS, BITS = 256, 5, 4
BANDS = MINIMA // ROWS
#: Distinct sets in a bucket whose pairs are all compared; beyond that, the bucket is refined.
ALL_PAIRS = 16
#: Each larger bucket's members are compared with this many central ones and one drawn by hash, at
#: each level of refinement.  Central are those whose buckets hold the most others; near copies of
#: one text all resemble its least changed copies, so these connect a group that others do not.
CENTRAL = 3
#: Members on the two sides of a block, in expectation, when components of a bucket or family are compared,
#: and the shingles of their texts.
LEFT, RIGHT = 256, 4096
LEFT_SHINGLES, RIGHT_SHINGLES = 1 << 16, 1 << 18
#: Consecutive bands that agree in the buckets of each level of refinement.
REFINED = (2, 4)
#: Bytes of a text whose words are read at a time; word hashes that a worker remembers.
BLOCK = 1 << 20
REMEMBERED = 1 << 16
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Standard deviations by which an estimate may fall short of ``SIMILAR`` before its pair is dropped.
SLACK = 5.3


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


@functools.cache
def _constants():
    return {
        "place": numbers(WORDS, 2) | np.uint64(1),
        "a": (numbers(MINIMA, 4) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), "b": (numbers(MINIMA, 5) >> np.uint64(32)).astype(np.uint32),
        "row": numbers(ROWS, 6) | np.uint64(1), "band": numbers(BANDS, 7)}


class _Hashes(dict):
    """64-bit XXH3 hashes of words; short words are remembered."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            self[word] = out
        return out


_HASHES = _Hashes()


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in lists, A-Z in lower case, a block of whole words at a time."""
    raw = (text or "").encode("utf-8")
    at = 0
    while len(raw) - at > BLOCK and (m := _BLANK.search(raw, at + BLOCK)):
        yield raw[at:m.start()].lower().split()
        at = m.start()
    yield raw[at:].lower().split()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    if len(_HASHES) > REMEMBERED:
        _HASHES.clear()
    return np.concatenate([np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w)) for w in words(text)])


def digest(text: str | None) -> bytes:
    """A 128-bit digest of a text's words in order; equal for texts that differ in white space and A-Z only."""
    out = hashlib.blake2b(digest_size=16)
    for w in words(text):
        out.update(b" ".join(w) + b" ")
    return out.digest()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; with fewer than ``WORDS`` words, of all its words as one."""
    found = word_hashes(text)
    place = _constants()["place"]
    with np.errstate(over="ignore"):
        if len(found) < WORDS:
            if not len(found):
                return found
            return mix((found * place[: len(found)]).sum(keepdims=True) + np.uint64(len(found)))
        n = len(found) - WORDS + 1
        total = found[:n] * place[0]
        for k in range(1, WORDS):
            total += found[k:n + k] * place[k]
        return np.unique(mix(total))


class _Numbers(dict):
    """Words numbered from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self) + 1
        return out


def exact_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text by their very words: (text's place, shingle's number), sorted.

    Words are numbered, and a shingle gets its number by its words' numbers, one word at a
    time, so equal numbers mean equal words.  The numbers hold among these texts.
    """
    number = _Numbers()
    rows, owner = [], []
    for i, text in enumerate(texts):
        w = np.concatenate([np.fromiter(map(number.__getitem__, x), np.int64, len(x)) for x in words(text)])
        if not len(w):
            continue
        if len(w) < WORDS:
            w = np.concatenate([w, np.zeros(WORDS - len(w), np.int64)])
        rows.append(np.lib.stride_tricks.sliding_window_view(w, WORDS))
        owner.append(np.full(len(w) - WORDS + 1, i))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    columns = [np.concatenate([x[:, k] for x in rows]) for k in range(WORDS)]
    code, base = columns[0], len(number) + 1
    for c in columns[1:]:
        code = np.unique(code * base + c, return_inverse=True)[1]
    every = np.unique(np.concatenate(owner) * (code.max() + 1) + code)
    return every // (code.max() + 1), every % (code.max() + 1)


def signature(found: np.ndarray) -> np.ndarray:
    """``MINIMA`` 32-bit minima of a non-empty set."""
    c = _constants()
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i:i + 1024] * c["a"][:, None] + c["b"][:, None]).min(axis=1), out=out)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    c = _constants()
    with np.errstate(over="ignore"):
        rows = minima[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        return mix((rows * c["row"]).sum(axis=1) + c["band"]).view(np.int64)


def packed(minima: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of the mixed minima, 16 to a 64-bit integer."""
    low = mix(minima.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    return (low.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n``, a digest of the words, ``same``, ``sig`` and ``bands`` of every row."""
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, 1):
            n, same, sig, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                n.append(len(found))
                if not len(found):
                    same.append(None), sig.append(None), bands.append(None)
                    continue
                same.append(digest(text))
                minima = signature(found)
                sig.append(packed(minima))
                bands.append(band_keys(minima))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "n", "same", "sig", "bands"])

    return map_arrow(chosen, run, f"id {kind}, n long, same binary, sig array<long>, bands array<long>")


def _split(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs (a < b) of the small buckets of (``key``, ``id``, ...), and the members of the large ones with ``size``."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumnRenamed("key", "k")
    shared = saved(members.join(sizes, F.col("key") == F.col("k")).drop("k"))
    few, many = shared.filter(F.col("size") <= ALL_PAIRS), shared.filter(F.col("size") > ALL_PAIRS)
    left, right = few.select("key", F.col("id").alias("a")), few.select(F.col("key").alias("k"), F.col("id").alias("b"))
    return left.join(right, (F.col("key") == F.col("k")) & (F.col("a") < F.col("b"))).select("a", "b"), many


def _central(many: DataFrame) -> DataFrame:
    """Each member (``id``) of a large bucket with its central ones and one drawn by hash, ``p``; wants ``weight``."""
    lot = F.xxhash64("id")
    central = [F.max(F.when(F.pmod(lot, F.lit(CENTRAL)) == j, F.struct("weight", "id")))["id"] for j in range(CENTRAL)]
    chosen = many.groupBy(F.col("key").alias("k")).agg(F.array_compact(F.array(*central, F.min(F.struct(lot.alias("h"), "id"))["id"])).alias("p"))
    return many.join(chosen, F.col("key") == F.col("k")).select("id", "p")


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of ids that share a band, as far as :data:`ALL_PAIRS` and :data:`CENTRAL` go, and the members of large buckets.

    Members of large buckets meet again in the buckets of two consecutive bands, and those
    of such that are still large in buckets of four, and are treated alike at each level.
    """
    out, many = _split(reps.select("id", F.posexplode("bands").alias("at", "key")))
    if many.isEmpty():
        return out.distinct(), many
    weight = many.groupBy(F.col("id").alias("i")).agg(F.sum("size").alias("weight"))
    known = reps.join(weight, F.col("id") == F.col("i")).select("i", "weight", "bands")
    wider = [F.xxhash64(*[F.element_at("bands", (F.col("at") + k) % F.lit(BANDS) + 1) for k in range(n)]).alias(f"key{n}") for n in REFINED]
    many = large = saved(many.join(known, F.col("id") == F.col("i")).select("id", "key", "weight", *wider))
    stars = _central(many)
    for n in REFINED:
        pairs, many = _split(many.withColumn("key", F.col(f"key{n}")).drop("size"))
        out, stars = out.union(pairs), stars.union(_central(many))
    # A member's buckets share central members, so these are made distinct before any pair is.
    own = stars.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("p"))).alias("p")).select("id", F.explode("p").alias("p"))
    out = out.union(own.filter("id != p").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")))
    return out.distinct(), large


def rate(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """The pairs whose signatures (``i``, ``sig``) agree in enough bits, with their number, ``same``."""
    rated = pairs.join(sig, F.col("a") == F.col("i")).select("a", "b", F.col("sig").alias("sa")).join(
        sig, F.col("b") == F.col("i")).select("a", "b", agreeing(F.col("sa"), F.col("sig")).alias("same"))
    return rated.filter(F.col("same") >= least_agreeing())


def agreeing(left, right):
    """How many of the packed low bits of two signatures agree, by bit counts."""
    spread = sum(1 << (BITS * i) for i in range(64 // BITS))

    def apart(x, y):
        d = x.bitwiseXOR(y)
        for k in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(d.bitwiseAND(F.lit(spread)))

    return F.lit(MINIMA) - F.aggregate(F.zip_with(left, right, apart), F.lit(0), lambda s, x: s + x)


def least_agreeing() -> int:
    """Agreements below which a pair of similarity ``SIMILAR`` is out of reach, corrected for chance collisions."""
    chance = 1 / (1 << BITS)
    p = chance + (1 - chance) * SIMILAR / 100
    return int(MINIMA * p - SLACK * (MINIMA * p * (1 - p)) ** 0.5)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar, by their very words; ``texts`` has ``id`` and ``text``."""
    a, b = texts.select(F.col("id").alias("ia"), F.col("text").alias("ta")), texts.select(F.col("id").alias("ib"), F.col("text").alias("tb"))
    full = pairs.join(a, F.col("a") == F.col("ia")).join(b, F.col("b") == F.col("ib"))
    full = full.select("a", "b", "ta", "tb")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, (2, 3), 2 << 20):
            at: dict[str, int] = {}
            left, right = ([at.setdefault(t, len(at)) for t in batch.column(c).to_pylist()] for c in (2, 3))
            owner, code = exact_sets(list(at))
            cuts = np.searchsorted(owner, np.arange(len(at) + 1))
            sets = [code[x:y] for x, y in zip(cuts, cuts[1:])]
            good = []
            for x, y in zip(left, right):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                good.append(100 * both >= SIMILAR * (len(sets[x]) + len(sets[y]) - both) > 0)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return map_arrow(full, run, f"a {kind}, b {kind}").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id`` and the smallest id that it reaches, ``root``, for every id of ``links`` (a, b) but the roots.

    Alternating large and small stars: each round joins every id to the least of its
    neighbourhood, until nothing changes.  A hub's edges are reduced by partial aggregation
    and its join can be split.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(lower, F.col("u") == F.col("x")).select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = saved(small.select("e.u", "e.v").filter("u != v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def dealt(members: DataFrame, group: str, weigh: bool = False) -> DataFrame:
    """Members (``group``, ``id``, ``c``, ``n``, ...) dealt in blocks: ``x``, ``y``, ``left`` and ``top`` come to them.

    Members outside their group's largest component (``top`` is false) meet all members of
    other components: they stand on the left, and everybody on the right.  A block has about
    ``LEFT`` by ``RIGHT`` members and, if ``weigh``, not many more shingles than stated above.
    Groups of one component are left out.
    """
    parts = members.groupBy(group, "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    sizes = parts.groupBy(F.col(group).alias("k")).agg(F.max(F.struct("m", "c", "w")).alias("top"), F.sum("m").alias("size"), F.sum("w").alias("all")).filter("size > top.m")
    ls, rs = (F.col("size") - F.col("top.m")) / LEFT, F.col("size") / RIGHT
    if weigh:
        ls, rs = F.greatest(ls, (F.col("all") - F.col("top.w")) / LEFT_SHINGLES), F.greatest(rs, F.col("all") / RIGHT_SHINGLES)
    sizes = sizes.select("k", F.col("top.c").alias("most"), F.ceil(ls).cast("int").alias("ls"), F.ceil(rs).cast("int").alias("rs"))
    met = members.join(sizes, F.col(group) == F.col("k")).withColumn("top", F.col("c") == F.col("most")).withColumn("lot", F.xxhash64("id"))

    def places(n, place):
        return F.transform(F.sequence(F.lit(0), n - 1), place)

    left = places(F.col("rs"), lambda k: F.struct(F.lit(True).alias("left"), F.pmod("lot", "ls").cast("int").alias("x"), k.alias("y")))
    right = places(F.col("ls"), lambda k: F.struct(F.lit(False).alias("left"), k.alias("x"), F.pmod("lot", "rs").cast("int").alias("y")))
    out = met.withColumn("at", F.explode(F.when(F.col("top"), right).otherwise(F.concat(left, right))))
    return out.select(*members.columns, "top", "lot", "at.x", "at.y", "at.left")


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that it reaches over the edges (``a``, ``b``)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]


def families(large: DataFrame, roots: DataFrame, known: DataFrame) -> DataFrame:
    """``id`` and ``family`` of the members that could still connect components in large buckets.

    ``known`` has ``i``, ``n`` and ``sig``.  All members of different components in a bucket
    are compared by their sizes' ratio and their signatures, in blocks.  A pair that passes
    puts both into one family; a block gives each such member once, with one of its family.
    """
    named = large.select("key", "id").join(roots.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").select("key", "id", F.coalesce("root", "id").alias("c"))
    rows = saved(named.withColumn("n", F.lit(1)))
    mixed = dealt(rows, "key").drop("n").join(known, F.col("id") == F.col("i"))
    kind = large.schema["id"].dataType.simpleString()
    least = least_agreeing()

    def run(table):
        import pyarrow as pa

        on_left, top, n, lot = (table[x].to_numpy() for x in ("left", "top", "n", "lot"))
        c = table["c"].combine_chunks().dictionary_encode().indices.to_numpy()
        sig = table["sig"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
        r = np.flatnonzero(~on_left)
        a, b = [], []
        for i in np.flatnonzero(on_left):
            fit = (c[r] != c[i]) & (top[r] | (lot[i] <= lot[r])) & (SIMILAR * np.maximum(n[r], n[i]) <= 100 * np.minimum(n[r], n[i]))
            rows = r[fit]
            good = rows[alike(sig[i], sig[rows]) >= least]
            a.append(np.full(len(good), i)), b.append(good)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        label = least_labels(len(n), a, b)
        some = np.unique(np.concatenate([a, b]))
        ids = table["id"].combine_chunks()
        return pa.table({"a": ids.take(pa.array(some)), "b": ids.take(pa.array(label[some]))})

    ship(large.sparkSession)
    found = mixed.select("key", "x", "y", "left", "id", "c", "top", "n", "sig", "lot").groupBy("key", "x", "y").applyInArrow(run, f"a {kind}, b {kind}")
    edges = saved(found.distinct())
    root = components(edges)
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    return ids.join(root.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").select("id", F.coalesce("root", "id").alias("family"))


def crossing(members: DataFrame, roots: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect all linked components within each family, by the very words of full sets.

    A family's members of different components are all compared, in blocks of bounded
    shingles; a block gives no more links than connect its components.
    """
    kind = members.schema["id"].dataType.simpleString()
    rows = members.join(roots.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").select("id", "family", F.coalesce("root", "id").alias("c"))
    rows = saved(rows.join(sizes, F.col("id") == F.col("i")).select("id", "family", "c", "n"))
    full = dealt(rows, "family", weigh=True).join(texts.withColumnRenamed("id", "i"), F.col("id") == F.col("i"))

    def run(table):
        import pyarrow as pa

        on_left, ids = table["left"].to_numpy(), table["id"].combine_chunks()
        c = table["c"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        a, b = linked(on_left, c, *exact_sets(table["text"].to_pylist()))
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))})

    ship(members.sparkSession)
    return full.select("family", "x", "y", "left", "id", "c", "text").groupBy("family", "x", "y").applyInArrow(run, f"a {kind}, b {kind}")


def linked(on_left: np.ndarray, c: np.ndarray, owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left and a right row of different components ``c`` and similar sets that connect all such components."""
    n = np.bincount(owner, minlength=len(c))
    left, right = np.flatnonzero(on_left), np.flatnonzero(~on_left)
    place = np.zeros(len(c), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    seen = [np.zeros(int(code.max(initial=0)) + 1, bool) for _ in range(2)]
    seen[0][code[on_left[owner]]] = True
    seen[1][code[~on_left[owner]]] = True
    column = np.cumsum(seen[0] & seen[1]) - 1
    shared = (seen[0] & seen[1])[code]
    owner, code = owner[shared], column[code[shared]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((len(left), len(right)), np.int64)
    width = 1024
    for k in range(0, int(code.max(initial=-1)) + 1, width):
        x, y = np.searchsorted(code, (k, k + width))
        o, w = owner[x:y], code[x:y] - k
        side = on_left[o]
        l, r = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        l[place[o[side]], w[side]] = 1
        r[place[o[~side]], w[~side]] = 1
        both += (l @ r.T).astype(np.int64)
    good = 100 * both >= SIMILAR * (n[left][:, None] + n[right][None, :] - both)
    good &= (c[left][:, None] != c[right][None, :]) & (both > 0)
    a, b = np.nonzero(good)
    a, b = left[a], right[b]
    out, root = [], {}

    def find(v):
        while root.get(v, v) != v:
            v = root[v]
        return v

    for k in np.unique(np.minimum(c[a], c[b]) * len(c) + np.maximum(c[a], c[b]), return_index=True)[1]:
        u, v = find(c[a[k]]), find(c[b[k]])
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append(k)
    return a[out], b[out]


def alike(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """What :func:`agreeing` gives for one packed signature and each row of others."""
    d = many ^ one
    for k in (1, 2):
        d |= d >> np.uint64(k)
    spread = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))
    return MINIMA - np.bitwise_count(d & spread).sum(axis=1, dtype=np.int64)


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    label = roots.withColumnRenamed("root", "r")
    out = pairs.join(label.withColumnRenamed("id", "i"), F.col("a") == F.col("i"), "left").select("a", "b", F.coalesce("r", "a").alias("ra"))
    out = out.join(label.withColumnRenamed("id", "i"), F.col("b") == F.col("i"), "left").select("a", "b", "ra", F.coalesce("r", "b").alias("rb"))
    return out.filter("ra != rb").select("a", "b")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group near-duplicates: ``id_col``, ``n_shingles``, ``component_id``, ``kept`` for every row.

    Texts are linked when their shingle sets have a similarity of 0.75 or more.  Rows of
    equal words are one class, represented by its smallest id.  Representatives meet in
    buckets of equal bands; a pair goes on if its packed signatures agree in enough bits,
    and counts only if its full sets, compared word by word, confirm it.  First each row's
    most promising pair is confirmed, then all pairs that still connect different
    components.  A bucket of more than ``ALL_PAIRS`` members compares them with ``CENTRAL +
    1`` of them, at each of two levels of refinement, and is finished after that: all its
    members of different components are compared by signatures, in blocks; those that pass
    form families, within which all full sets of different components are compared, again in
    blocks.  So every pair that shares a band is compared or already in one component,
    whatever the bucket's size.  That costs the square of a group of unlinked texts that
    share bands.

    ``component_id`` is the smallest id reachable over links, ``kept`` says that it is the
    row's own.  An empty text, a blank one or null has no shingles and is linked with
    nothing, unless its id has another text.  A row without an id is linked with nothing,
    has a null component and is kept.  Rows that repeat an id are one document, which has the
    links of all its texts; each row tells its own text's shingles.  Other columns are not
    read.  An empty table gives an empty result.
    """
    rows = saved(sketches(docs, id_col, text_col))
    real = rows.filter("n > 0 and id is not null")
    repeats = not rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").isEmpty()
    classes = saved(real.groupBy("same").agg(F.min("id").alias("rep")))
    reps = having(real, classes.select("rep")).select("id", "same", "n", "sig", "bands")
    reps = saved(reps.dropDuplicates(["id", "same"]) if repeats else reps)
    member = saved(real.join(classes.withColumnRenamed("same", "s"), F.col("same") == F.col("s")).select("id", "n", "rep"))
    pairs, large = candidates(reps.select("id", "bands"))
    sig = reps.select(F.col("id").alias("i"), "sig")
    rated = saved(rate(pairs, sig))
    every = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    texts = saved(having(every, rated.select("a").union(rated.select("b"))))
    best = rated.groupBy("b").agg(F.max(F.struct("same", (-F.col("a")).alias("na"), "a"))["a"].alias("a")).select("a", "b")
    links = confirmed(best, texts)
    if repeats:
        several = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select(F.col("id").alias("i"), "a")
        links = links.union(member.join(several, F.col("id") == F.col("i")).select("a", F.col("rep").alias("b")).filter("a != b").distinct())
    links = saved(links)
    roots = components(links)
    rest = rated.join(best.withColumnRenamed("a", "ba").withColumnRenamed("b", "bb"), (F.col("a") == F.col("ba")) & (F.col("b") == F.col("bb")), "left_anti")
    rest = saved(apart(rest.select("a", "b"), roots))
    if not rest.isEmpty():
        more = saved(confirmed(rest, texts))
        if not more.isEmpty():
            roots = components(more.union(roots.select("id", "root")))
    if not large.isEmpty():
        sizes = reps.select(F.col("id").alias("i"), "n")
        own = saved(families(large, roots, reps.select(F.col("id").alias("i"), "n", "sig")))
        if not own.isEmpty():
            more = saved(crossing(own, roots, sizes, having(every, own.select("id"))))
            if not more.isEmpty():
                roots = components(more.union(roots.select("id", "root")))
    named = roots.withColumnRenamed("id", "i")
    found = member.join(named, F.col("rep") == F.col("i"), "left").select("id", "n", F.coalesce("root", "rep").alias("component"))
    none = rows.filter("n = 0 or id is null").select("id", "n")
    if repeats:
        found = saved(found)
        none = none.join(found.groupBy(F.col("id").alias("i")).agg(F.min("component").alias("c")), F.col("id") == F.col("i"), "left")
    out = found.union(none.select("id", "n", F.coalesce("c", "id").alias("component") if repeats else F.col("id").alias("component")))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group; all columns stay, and all rows of a kept id."""
    gone = near_dedup(docs, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
