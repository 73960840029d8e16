"""Near-duplicates by exact Jaccard similarity of n-gram sets: a rare-first prefix-filter join.

1. Documents with the same set form a class, found by a fingerprint of the set with map-side
   minima, so that copies cost no more than their digests. The join works on classes.
2. Document frequencies. A task packs its n-grams by parts; a part counts the classes of each
   n-gram and returns those found in two classes or more. An n-gram that many classes of one
   block hold is hot: it sends its part a single note, and its entries go on by other parts,
   so no part takes in the rows of a hot n-gram. Hot n-grams order after all others. There
   are ``spark.sql.shuffle.partitions`` parts; a task holds one, seven bytes for each n-gram.
3. Prefixes. The n-grams of a class in order of frequency, rare first: with similarity t, two
   classes of a and b n-grams can only link if they share one among the first a - ceil(ta) + 1
   and b - ceil(tb) + 1. N-grams of one class lead the order and can match nothing: a class
   with a prefix of these alone is out. Only shared n-grams take part in intersections, so the
   kept ones are enough to verify with.
4. Stars. In each bucket (classes that share a prefix n-gram) every class meets the bucket's
   leader for its length. A class is verified against the few leaders it meets most, each pair
   once and never again later, and links make components. This is linear in the rows, also where a third of them are near copies.
5. The rest, exactly. Buckets that still hold several components are joined: pairs of classes
   in different components that pass the length and the positional filter are formed once,
   pass the suffix filter (partitioned counts of the n-grams), and are verified once. Pairs
   within a component can add nothing to it.

Null texts and texts without words have no set and link with nothing. Each row counts, also
where ids repeat; null ids are no candidates for the component's smallest id. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.blocks import ragged_positions, release, slices
from threadlens.llm.components import connected
from threadlens.llm.shingles import SHINGLE, fingerprint, shingle_sets
from threadlens.session import materialise

NUM, DEN = 80, 100  # similarity of links: at least NUM / DEN
BLOCK_GRAMS = 2_000_000  # n-grams of a block, in which hot ones are told
HOT_CLASSES = 64  # an n-gram in so many classes of a block is hot
HOT = np.int32(2**31 - 1)
LEADERS = 3
SUFFIX_BINS = 64
_LOW = np.uint64(0xFFFFFF)

DIGEST_SCHEMA = "doc_id long, text_hash long, n_shingles long, class long"
PACK_SCHEMA = "part int, classes binary, sizes binary, grams binary, owners binary, hot binary, passed binary, passed_owners binary"
REPLY_SCHEMA = "dest int, classes binary, sizes binary, grams binary, freqs binary"
SET_SCHEMA = "class long, n int, first int, prefix binary, grams binary, bins array<int>"


def digests(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, class`` of each row; ``class`` is null for an empty set."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            n, names = [], []
            for grams in shingle_sets(batch.column("text"), size):
                n.append(len(grams))
                names.append(fingerprint(grams) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(names, pa.int64())],
                ["doc_id", "text_hash", "n_shingles", "class"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(digest, DIGEST_SCHEMA)


def _packed(docs: DataFrame, size: int, parts: int) -> DataFrame:
    def pack_block(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        names = np.fromiter(sets, np.int64, len(sets))
        sizes = np.array([len(s) for s in sets.values()], np.int32)
        grams = np.concatenate(list(sets.values()))
        owners = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        # The low bits of a hash name its part; the others tell n-grams of a part apart.
        part = (grams & _LOW).astype(np.int64) % parts
        grams = (grams & ~_LOW) | part.astype(np.uint64)
        order = np.argsort(grams, kind="stable")
        grams, owners, part = grams[order], owners[order], part[order]
        starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        counts = np.diff(np.append(starts, len(grams)))
        hot = np.repeat(counts >= HOT_CLASSES, counts)
        hot_grams = grams[starts[counts >= HOT_CLASSES]]
        other = (part + 1 + int(names[0]) % max(1, parts - 1)) % parts
        to = np.where(hot, other, part)
        by_part = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[by_part], np.arange(parts + 1))
        hot_part = (hot_grams & _LOW).astype(np.int64)
        by_hot = np.argsort(hot_part, kind="stable")
        hot_bounds = np.searchsorted(hot_part[by_hot], np.arange(parts + 1))
        for p in range(parts):
            mine, notes = by_part[bounds[p] : bounds[p + 1]], hot_grams[by_hot[hot_bounds[p] : hot_bounds[p + 1]]]
            if not len(mine) and not len(notes):
                continue
            used, local = np.unique(owners[mine], return_inverse=True)
            passed = hot[mine]
            own = grams[mine[~passed]]
            local = local.astype("<u2" if len(used) < 65536 else "<u4")
            tops = own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:]
            row = [p, names[used].tobytes(), sizes[used].tobytes(), np.ascontiguousarray(tops).tobytes(),
                   local[~passed].tobytes(), notes.tobytes(), grams[mine[passed]].tobytes(), local[passed].tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[0]], pa.int32())] + [pa.array([x], pa.binary()) for x in row[1:]],
                ["part", "classes", "sizes", "grams", "owners", "hot", "passed", "passed_owners"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in slices(batches, "text"):
            for grams in shingle_sets(batch.column("text"), size):
                if len(grams) and (name := fingerprint(grams)) not in sets:
                    sets[name] = grams
                    held += len(grams)
            if held >= BLOCK_GRAMS:
                yield from pack_block(sets)
                sets, held = {}, 0
        if sets:
            yield from pack_block(sets)

    return docs.select("text").mapInArrow(pack, PACK_SCHEMA)


def _owners(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width < 65536 else "<u4").astype(np.int64)


def _replies(packed: DataFrame, parts: int) -> DataFrame:
    """Each class's n-grams found in two classes or more, with their frequencies."""

    def count(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        classes, sizes, grams, owners, hot, freqs = [], [], [], [], [], []
        passed, passed_owners, base = [], [], 0
        for row in table.to_pylist():
            names = np.frombuffer(row["classes"], np.int64)
            tops = np.frombuffer(row["grams"], np.uint8).reshape(-1, 5)
            wide = np.zeros((len(tops), 8), np.uint8)
            wide[:, 3:] = tops
            grams.append(wide.reshape(-1).view("<u8") | np.uint64(part))
            owners.append(_owners(row["owners"], len(names)) + base)
            passed.append(np.frombuffer(row["passed"], "<u8"))
            passed_owners.append(_owners(row["passed_owners"], len(names)) + base)
            hot.append(np.frombuffer(row["hot"], "<u8"))
            classes.append(names)
            sizes.append(np.frombuffer(row["sizes"], np.int32))
            base += len(names)
        classes, sizes = np.concatenate(classes), np.concatenate(sizes)
        grams, owners, hot = np.concatenate(grams), np.concatenate(owners), np.unique(np.concatenate(hot))
        order = np.lexsort((classes[owners], grams))
        grams, owners = grams[order], owners[order]
        named = classes[owners]
        fresh = np.ones(len(grams), bool)  # copies in other blocks are one class
        fresh[1:] = (grams[1:] != grams[:-1]) | (named[1:] != named[:-1])
        grams, owners = grams[fresh], owners[fresh]
        starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(grams)))
        freq = np.repeat(counts, counts).astype(np.int32)
        if len(hot) and len(grams):
            freq[np.isin(grams, hot)] = HOT
        shared = freq >= 2
        grams = np.concatenate([grams[shared], *passed])
        owners = np.concatenate([owners[shared], *passed_owners])
        freq = np.concatenate([freq[shared], np.full(len(grams) - int(shared.sum()), HOT, np.int32)])
        named = classes[owners]
        dest = named.astype(np.uint64) % np.uint64(parts)
        order = np.lexsort((named, dest))
        bounds = np.searchsorted(dest[order], np.arange(parts + 1))
        out: dict[str, list] = {k: [] for k in ("dest", "classes", "sizes", "grams", "freqs")}
        for d in range(parts):
            mine = order[bounds[d] : bounds[d + 1]]
            if len(mine):
                out["dest"].append(d)
                out["classes"].append(named[mine].tobytes())
                out["sizes"].append(sizes[owners[mine]].tobytes())
                out["grams"].append(grams[mine].tobytes())
                out["freqs"].append(freq[mine].tobytes())
        kinds = {"dest": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    return packed.groupBy("part").applyInArrow(count, REPLY_SCHEMA)


def _sets(replies: DataFrame, num: int, den: int) -> DataFrame:
    """Classes that can link: size, place of the first shared n-gram, prefix, shared n-grams, and their counts by bin."""

    def order(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
        classes, sizes = read("classes", np.int64), read("sizes", np.int32)
        grams, freqs = read("grams", "<u8"), read("freqs", np.int32)
        by = np.lexsort((grams, freqs, classes))
        classes, sizes, grams = classes[by], sizes[by], grams[by]
        fresh = np.ones(len(classes), bool)
        fresh[1:] = (classes[1:] != classes[:-1]) | (grams[1:] != grams[:-1])
        classes, sizes, grams = classes[fresh], sizes[fresh], grams[fresh]
        starts = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
        ends = np.append(starts[1:], len(classes))
        n = sizes[starts].astype(np.int64)
        own = n - (ends - starts)
        prefix = n - (-(-n * num // den)) + 1
        able = np.flatnonzero(own < prefix)
        shared = [grams[starts[i] : ends[i]] for i in able]
        return pa.table({
            "class": pa.array(classes[starts[able]]), "n": pa.array(n[able], pa.int32()),
            "first": pa.array(own[able], pa.int32()),
            "prefix": pa.array([s[: prefix[i] - own[i]].tobytes() for i, s in zip(able, shared)], pa.binary()),
            "grams": pa.array([np.sort(s).tobytes() for s in shared], pa.binary()),
            "bins": pa.array([np.bincount((s >> np.uint64(24)) % np.uint64(SUFFIX_BINS), minlength=SUFFIX_BINS)
                              for s in shared], pa.list_(pa.int32())),
        })

    return replies.groupBy("dest").applyInArrow(order, SET_SCHEMA)


def _prefixes(sets: DataFrame) -> DataFrame:
    """``gram, class, n, pos`` for each shared n-gram in a prefix."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x, "<i8") for x in batch.column("prefix").to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            at = pa.array(np.repeat(np.arange(len(lists)), sizes))
            first = batch.column("first").to_numpy().astype(np.int64)
            pos = ragged_positions(first, sizes)
            grams = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams), batch.column("class").take(at), batch.column("n").take(at), pa.array(pos, pa.int32())],
                ["gram", "class", "n", "pos"])

    return sets.select("class", "n", "first", "prefix").mapInArrow(explode, "gram long, class long, n int, pos int")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (``a, b``) that link, each verified once on its n-grams."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, ga, gb in zip(*[batch.column(c).to_pylist() for c in ("na", "nb", "ga", "gb")], strict=True):
                x, y = np.frombuffer(ga, "<u8"), np.frombuffer(gb, "<u8")
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(den * both >= num * (na + nb - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    b = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    joined = pairs.select("a", "b").join(a, "a").join(b, "b")
    return joined.select("a", "b", "na", "nb", "ga", "gb").mapInArrow(verify, "a long, b long")


def _star_pairs(prefixes: DataFrame, leaders: int, turn: int, num: int, den: int) -> DataFrame:
    """Each class with the leaders that it shares most buckets with. Classes of a length band can link by length."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    rows = prefixes.select("gram", "class", band.alias("band"))
    chosen = rows.groupBy("gram", "band").agg(
        F.min(F.struct(F.xxhash64("class", F.lit(turn)).alias("h"), F.col("class").alias("c"))).alias("l"),
        F.count("*").alias("m"),
    ).filter("m > 1").select("gram", "band", F.col("l.c").alias("b"))
    met = rows.join(chosen, ["gram", "band"]).filter("class <> b").groupBy(F.col("class").alias("a"), "b").agg(
        F.count("*").alias("m"))
    best = Window.partitionBy("a").orderBy(F.desc("m"), "b")
    chosen = met.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= leaders)
    return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _named(prefixes: DataFrame, components: DataFrame) -> DataFrame:
    """Prefix rows of buckets that hold more than one component, with the component of their class."""
    known = components.select(F.col("node").alias("class"), "component")
    rows = prefixes.join(known, "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = rows.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    return rows.join(mixed.select("gram"), "gram")


def _rest_pairs(mixed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes in different components of a bucket that pass the length, positional and suffix filters.

    The bucket's largest component meets the others only, never itself.
    """
    major = mixed.groupBy("gram", "component").agg(F.count("*").alias("m")).groupBy("gram").agg(
        F.max(F.struct("m", "component")).alias("x")).select("gram", F.col("x.component").alias("major"))
    rows = mixed.join(sets.select("class", "bins"), "class").join(major, "gram")
    x = rows.filter("component <> major").select(*[F.col(c).alias(f"x_{c}") for c in rows.columns])
    y = rows.select(*[F.col(c).alias(f"y_{c}") for c in rows.columns])
    need = F.ceil((F.col("x_n") + F.col("y_n")) * F.lit(num) / F.lit(num + den))
    passes = (
        (F.col("x_gram") == F.col("y_gram"))
        & (F.col("x_component") != F.col("y_component"))
        & ((F.col("y_component") == F.col("y_major")) | (F.col("x_class") < F.col("y_class")))
        & (F.least("x_n", "y_n") * den >= F.greatest("x_n", "y_n") * num)
        & (F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) >= need)
        & (F.aggregate(F.zip_with("x_bins", "y_bins", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v) >= need)
    )
    return x.join(y, passes).select(
        F.least("x_class", "y_class").alias("a"), F.greatest("x_class", "y_class").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN,
    leaders: int = LEADERS, rounds: int = 2, keys: bool = False,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row; a component is named by its smallest id.

    With ``keys``, also ``text_hash`` (``xxhash64`` of the text) and ``group``, which tell rows and
    components apart where ids repeat or are null; ``group`` is null for an empty set.

    Two documents link when ``den`` times their sets' intersection is at least ``num`` times
    the union. ``leaders`` and ``rounds`` of stars decide what is verified early, not the result.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digest = materialise(digests(rows, size), "digests")
    sets = materialise(_sets(_replies(_packed(rows, size, parts), parts), num, den), "sets")
    prefixes = materialise(_prefixes(sets), "prefixes")
    links = components = tried = None
    open_rows = prefixes
    untried = lambda pairs: pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
    for turn in range(rounds):
        pairs = materialise(untried(_star_pairs(open_rows, leaders, turn, num, den)), "pairs")
        found = materialise(_verified(pairs, sets, num, den), "stars")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        components = connected(links)
        links = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
        open_rows = materialise(_named(prefixes, components), "mixed")
    rest = _verified(untried(_rest_pairs(open_rows, sets, num, den)), sets, num, den)
    components = connected(links.unionByName(rest))
    found = _labelled(digest, components)
    return found if keys else found.drop("text_hash", "group")


def _labelled(digest: DataFrame, components: DataFrame) -> DataFrame:
    """The smallest id of each row's component."""
    smallest = digest.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("low"))
    joined = smallest.join(components.select(F.col("node").alias("class"), "component"), "class")
    lowest = joined.groupBy("component").agg(F.min("low").alias("lowest"))
    linked = joined.join(lowest, "component").select("class", "component", "lowest")
    ids = smallest.join(linked, "class", "left").select(
        "class", F.coalesce("lowest", "low").alias("component_id"), F.coalesce("component", "class").alias("group"))
    return digest.join(ids, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "group")
