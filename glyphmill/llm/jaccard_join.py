"""N-gram Jaccard join with set-relation skipping, exact at a similarity of 80 hundredths.

A document's set holds its distinct word 5-grams. Documents with equal sets are one class, named by
a 64-bit fingerprint of the set. Two sets can only be similar if they share one of the first
n - ceil(0.8 n) + 1 elements in some common order; the order puts the n-grams that the documents share
most last, which is a matter of speed and not of the result.

* Position skipping: the entries of an index list come sorted by size and place. What two sets share
  is bounded by what follows their places, so blocks of entries whose sizes and places leave no room
  for a partner are passed over, and most lists end there.
* What is left of a list is grouped under its smallest fingerprint, so sets that meet in many lists
  meet in few groups. A group is compared block against block, never pair by pair in rows.
* Sketch skipping: the sum of the smaller counts, bucket by bucket, bounds what two sets share, so most sets
  without a similar one leave their group before their elements are read.
* Answer skipping: within a block one pivot is compared with all. Its answers are one component and need
  no comparison among themselves; for the others, what both share with the pivot and what both have besides bounds
  what they share with one another, and only sets for which that bound leaves room are compared.

Null texts count as empty; an empty set links with nothing. Repeated rows belong to one class. A row
without doc_id can be in a class but isn't read as its representative, and its component_id is the
smallest id of the class, or null. A very long text is one set like any other; blocks are bounded by their
elements. Ties in size and place don't matter, as every partner within the bounds is kept. Other columns
than doc_id and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, fresh_name, gram_hashes, mix, signed, slices, trimmed, utf8, word_hashes
from glyphmill.llm.components import connected_components

GRAM = 5
PERCENT = 80
#: n-grams in this many documents of a task's run, and in this many of all such runs, are put last in the order.
OFTEN_HERE, OFTEN = 3, 12
#: At most so many are put last, the most frequent ones. It bounds what tasks are sent; the result doesn't depend on it.
MOST_OFTEN = 1 << 17
RUN = 1 << 21
#: A list of more entries is dealt out as pairs of parts of about so many.
LIST = 50_000
#: Entries of a block of a list.
BLOCK = 256
#: Sets and elements of a block of a group.
MEMBERS, ELEMENTS = 1024, 2_000_000


def shingles(text: bytes, gram: int = GRAM) -> np.ndarray:
    """The text's set, as sorted 64-bit hashes."""
    words = word_hashes(text, lower=True)
    if len(words) == 0:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words, min(gram, len(words))))


def fingerprint(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n) // 100 + 1


@dataclass(frozen=True)
class Order:
    """Frequent n-grams, sorted by hash, with their counts; the most frequent come last."""

    often: np.ndarray
    counts: np.ndarray
    longest: int  # entries of a list that stays whole

    def prefix(self, own: np.ndarray, length: int) -> tuple[np.ndarray, int]:
        """The first `length` elements in the common order, and how many of them are rare."""
        if len(self.often) == 0:
            return own[:length], min(length, len(own))
        at = np.minimum(np.searchsorted(self.often, own), len(self.often) - 1)
        frequent = self.often[at] == own
        rare = own[~frequent][:length]
        if len(rare) == length:
            return rare, length
        rest = own[frequent][np.argsort(self.counts[at[frequent]], kind="stable")]
        return np.concatenate([rare, rest[: length - len(rare)]]), len(rare)

    def parts(self, tokens: np.ndarray) -> np.ndarray:
        """Into how many parts the lists of these frequent n-grams are dealt."""
        return -(-self.counts[np.searchsorted(self.often, tokens)] // self.longest)


SURVEY = "kind int, a long, n long, fp long, sketch binary"


def sketch(own: np.ndarray) -> bytes:
    """How many elements there are by their leading bits, about eight a bucket; empty if a count doesn't fit."""
    bits = min(16, max(3, (len(own) // 8).bit_length()))
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def survey(docs: DataFrame, gram: int) -> DataFrame:
    """Kind 0: doc_id, set size and fingerprint of each document. Kind 1: n-grams that recur in a run, with their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, total, seen = ["kind", "a", "n", "fp", "sketch"], [], 0, set()

        def frequent():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= OFTEN_HERE
            values, counts = values[keep], counts[keep]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(values), np.int32)), pa.array(signed(values)), pa.array(counts.astype(np.int64)), pa.nulls(len(values), pa.int64()), pa.nulls(len(values), pa.binary())], names)

        for batch in batches:
            sizes, prints, sketches = [], [], []
            for t in utf8(batch.column(1)):
                own = shingles(t, gram)
                fp = fingerprint(own)
                sizes.append(len(own))
                prints.append(fp)
                sketches.append(sketch(own))
                if len(own) and fp not in seen:  # copies within a run count once
                    seen.add(fp)
                    held.append(own)
                    total += len(own)
                if total >= RUN:
                    yield frequent()
                    held, total, seen = [], 0, set()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(batch), np.int32)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(sketches, pa.binary())], names)
        if held:
            yield frequent()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), SURVEY)


def dealt(token: int, fp: int, parts: int) -> list[int]:
    """The names of the lists that a set joins for an n-gram whose list is dealt into pairs of parts."""
    own = fp % parts
    pairs = np.array([(min(own, k) << 32) + max(own, k) for k in range(parts)], np.uint64)
    return signed(mix(pairs + np.uint64(token))).tolist()


def index_lists(docs: DataFrame, order: Order, gram: int, percent: int) -> DataFrame:
    """(token, fp, place): the prefix of every set. place packs the set's size and the position."""
    order = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in slices(batch, texts, 8 << 20):
                tokens, prints, places = [], [], []
                for t in texts[a:b]:
                    own = shingles(t, gram)
                    n = len(own)
                    fp = fingerprint(own)
                    if n == 0 or fp in seen:
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(fp)
                    own, rare = order.value.prefix(own, prefix_length(n, percent))
                    place = n << 28 | np.arange(len(own), dtype=np.int64)
                    many = order.value.parts(own[rare:]) if rare < len(own) else np.empty(0)
                    for k in (np.flatnonzero(many > 1) + rare).tolist():
                        names = dealt(int(own[k]), fp, int(many[k - rare]))
                        tokens.append(np.array(names, np.int64).view(np.uint64))
                        places.append(np.full(len(names), place[k]))
                        prints.append(np.full(len(names), fp, np.int64))
                    if (many > 1).any():
                        single = np.concatenate([np.ones(rare, bool), many <= 1])
                        own, place = own[single], place[single]
                    tokens.append(own)
                    prints.append(np.full(len(own), fp, np.int64))
                    places.append(place)
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(prints)), pa.array(np.concatenate(places))], ["token", "fp", "place"])

    return docs.select("text").mapInArrow(trimmed(run), "token long, fp long, place long")


def partners(n: np.ndarray, p: np.ndarray, percent: int) -> np.ndarray:
    """For lists of one length, a row each: which entries have a partner that sizes and places leave room for."""
    least = lambda x: np.minimum(x[:, :, None], x[:, None, :])
    both = n[:, :, None] + n[:, None, :]
    room = ((100 + percent) * least(n - p) >= percent * both) & ((100 + percent) * least(n) >= percent * both)
    room[:, np.arange(n.shape[1]), np.arange(n.shape[1])] = False
    return room.any(axis=2)


def partners_by_block(n: np.ndarray, p: np.ndarray, percent: int) -> np.ndarray:
    """The same for one long list in order of size. Pairs of blocks are passed over whole where the bounds of both leave no room."""
    left, keep = n - p, np.zeros(len(n), bool)
    start = np.arange(0, len(n), BLOCK)
    end = np.append(start[1:], len(n))
    most, low, high = np.maximum.reduceat(left, start), n[start], n[end - 1]
    for i, a in enumerate(start.tolist()):
        for j in range(i, len(start)):
            if 100 * high[i] < percent * low[j]:
                break
            own, other = slice(a, end[i]), slice(start[j], end[j])
            if (100 + percent) * min(most[i], most[j]) < percent * (low[i] + low[j]) or (keep[own].all() and keep[other].all()):
                continue
            both = n[own, None] + n[other]
            room = ((100 + percent) * np.minimum(left[own, None], left[other]) >= percent * both) & ((100 + percent) * np.minimum(n[own, None], n[other]) >= percent * both)
            if i == j:
                np.fill_diagonal(room, False)
            keep[own] |= room.any(axis=1)
            keep[other] |= room.any(axis=0)
    return keep


def groups_of_lists(lists: DataFrame, percent: int) -> DataFrame:
    """(pivot, fp): the entries with possible partners, under the smallest fingerprint of their list. lists: by token, in order of place."""

    def sieved(token: np.ndarray, fp: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(start, len(token)))
        n, p = place >> 28, place & ((1 << 28) - 1)
        pivots, prints = [], []
        for m in np.unique(length[length > 1]).tolist():
            lists_ = start[length == m]
            # Lists longer than a block are taken one by one.
            for a in range(0, len(lists_), step := max(1, (1 << 20) // (m * m)) if m <= BLOCK else 1):
                at = lists_[a : a + step, None] + np.arange(m)
                keep = partners(n[at], p[at], percent) if m <= BLOCK else partners_by_block(n[at[0]], p[at[0]], percent)[None]
                own = np.where(keep, fp[at], np.iinfo(np.int64).max)
                pivots.append(np.broadcast_to(own.min(axis=1)[:, None], own.shape)[keep])
                prints.append(own[keep])
        if pivots and len(pivots := np.concatenate(pivots)):
            rows = np.unique(np.rec.fromarrays([pivots, np.concatenate(prints)], names="a,b"))
            yield pa.RecordBatch.from_arrays([pa.array(rows.a), pa.array(rows.b)], ["pivot", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            held = own if held is None else np.concatenate([held, own], axis=1)
            ended = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
            if ended:
                yield from sieved(*held[:, :ended])
                held = held[:, ended:]
        if held is not None and held.shape[1]:
            yield from sieved(*held)

    return lists.mapInArrow(trimmed(run), "pivot long, fp long")


def sets_of(docs: DataFrame, wanted: DataFrame, gram: int) -> DataFrame:
    """(fp, own) for the wanted classes (doc_id, fp): the sets, read again from the texts of their representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices(batch, texts, 8 << 20):
                kept = [(fp, signed(own)) for fp, t in zip(batch.column(0)[a:b].to_pylist(), texts[a:b]) if fingerprint(own := shingles(t, gram)) == fp]
                if kept:
                    ends = np.cumsum([0, *(len(o) for _, o in kept)])
                    yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in kept], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([o for _, o in kept])))], ["fp", "own"])

    # Merged at every size, as what is wanted has no bound.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("shuffle_merge"), "doc_id")
    return rows.select("fp", "text").mapInArrow(trimmed(run), "fp long, own array<long>")


def overlaps(owner: np.ndarray, column: np.ndarray, rows: np.ndarray, members: int) -> np.ndarray:
    """What each of `rows` shares with every member; (owner, column) are the elements' places, by column."""
    out = np.zeros((len(rows), members), np.float32)
    step = max(64, (1 << 22) // members)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [first, first + step])
        x = np.zeros((members, step), np.float32)
        x[owner[a:b], column[a:b] - first] = 1
        out += x[rows] @ x.T
    return out


def united(sets: list[np.ndarray], pivot: int, percent: int) -> np.ndarray:
    """For each set the number of the first one in its component, links being those of similar sets."""
    m, n = len(sets), np.array([len(s) for s in sets])
    label = np.arange(m)
    similar = lambda shared, x, y: (100 + percent) * shared >= percent * (x + y)
    if m == 2:
        if similar(len(np.intersect1d(*sets, assume_unique=True)), n[0], n[1]):
            label[1] = 0
        return label
    owner = np.repeat(label, n)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = (count > 1)[column]
    column, owner = (np.cumsum(count > 1) - 1)[column[shared]], owner[shared]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    with_pivot = np.bincount(owner[np.isin(column, column[owner == pivot])], minlength=m)
    core = similar(with_pivot, n, n[pivot])
    core[pivot] = True
    label[core] = np.flatnonzero(core)[0]
    rest = np.flatnonzero(~core)
    if len(rest):
        own, free = with_pivot[rest], (n - with_pivot)[rest]
        most = np.minimum(own[:, None], with_pivot) + np.minimum(free[:, None], n - with_pivot)
        room = similar(most, n[rest][:, None], n)
        room[np.arange(len(rest)), rest] = False
        rest = rest[room.any(axis=1)]
    if len(rest):
        linked = similar(overlaps(owner, column, rest, m), n[rest][:, None], n)
        while True:
            before = label.copy()
            label[rest] = np.minimum(label[rest], np.where(linked, label, m).min(axis=1))
            label = np.minimum(label, np.where(linked, label[rest][:, None], m).min(axis=0))
            label[core] = label[core].min()
            if (label == before).all():
                break
    return label


def hopeful(sketches: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which sets have a partner that the sketches leave room for. Similar sets' sketches differ in length by a factor of two at most."""
    length = np.array([len(s) for s in sketches])
    keep = length == 0  # without a sketch nothing is ruled out, for none of the group
    if keep.any():
        return np.ones(len(sketches), bool)
    for buckets in np.unique(length).tolist():
        at = np.flatnonzero((length == buckets) | (length == 2 * buckets))
        rows = np.empty((len(at), buckets), np.uint16)
        for i, k in enumerate(at.tolist()):
            own = np.frombuffer(sketches[k], np.uint8)
            rows[i] = own if len(own) == buckets else own.reshape(-1, 2).sum(axis=1, dtype=np.uint16)
        for i in range(len(at)):
            if not keep[at[i]]:
                room = (100 + percent) * np.minimum(rows, rows[i]).sum(axis=1, dtype=np.int64) >= percent * (sizes[at] + sizes[at[i]])
                room[i] = False
                keep[at[room]] = True
                keep[at[i]] = room.any()
    return keep


def by_group(members: DataFrame, content: DataFrame, most: int) -> DataFrame:
    """(pivot, lo, hi, fp, n, content) in groups. members: (pivot, fp, n); content: (fp, content), of which a block holds about `most` elements.

    Groups larger than a block are dealt out as pairs of blocks.
    """
    sizes = members.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / most)).cast("int").alias("g"))
    rows = members.join(sizes, "pivot").withColumn("k", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("pivot", F.least("k", "j").alias("lo"), F.greatest("k", "j").alias("hi"), "fp", "n").join(content, "fp")
    return rows.select("pivot", "lo", "hi", "fp", "n", "content").repartition("pivot", "lo", "hi").sortWithinPartitions("pivot", "lo", "hi", "fp")


def blocks(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
    """(pivot, fingerprints, sizes, contents) of each block with more than one set; read gives the contents of a batch's last column."""
    now, prints, sizes, held = None, [], [], []
    for batch in batches:
        contents = read(batch.column(5))
        for (*key, fp, n), x in zip(zip(*(batch.column(k).to_pylist() for k in range(5))), contents):
            if key != now:
                if len(prints) > 1:
                    yield now[0], np.array(prints), np.array(sizes), held
                now, prints, sizes, held = key, [], [], []
            if not prints or prints[-1] != fp:  # rows that repeat an id and its text
                prints.append(fp)
                sizes.append(n)
                held.append(x)
    if len(prints) > 1:
        yield now[0], np.array(prints), np.array(sizes), held


def hopeful_members(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(pivot, fp): the members for which sketches leave room for a partner in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for pivot, prints, sizes, own in blocks(batches, lambda column: column.to_pylist()):
            at = prints[hopeful(own, sizes, percent)]
            if len(at):
                out.append((np.full(len(at), pivot), at))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["pivot", "fp"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["pivot", "fp"])

    return by_group(members, sketches, 8 * ELEMENTS).mapInArrow(trimmed(run), "pivot long, fp long").distinct()


def links_of_groups(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that unite the similar sets of each group. members: (pivot, fp, n)."""

    def arrays(column: pa.Array) -> list[np.ndarray]:
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return [np.array(x) for x in np.split(flat, ends[1:-1] - ends[0])] if len(column) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pivot, prints, _, own in blocks(batches, arrays):
            at = np.flatnonzero(prints == pivot)
            label = united(own, int(at[0]) if len(at) else 0, percent)
            at = np.flatnonzero(label != np.arange(len(label)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(prints[at]), pa.array(prints[label[at]])], ["a", "b"])

    return by_group(members, sets, ELEMENTS).mapInArrow(trimmed(run), "a long, b long")


def similar_components(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    seen = scratch.put(survey(docs, gram), "survey")
    sets = seen.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "fp")
    often = seen.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "a").limit(MOST_OFTEN).collect()
    tokens = np.array([r.a for r in often], np.int64).view(np.uint64)
    by_hash = np.argsort(tokens)
    order = Order(tokens[by_hash], np.array([r.n for r in often], np.int64)[by_hash], LIST)

    classes = scratch.put(sets.where("n > 0 and doc_id is not null").groupBy("fp", "n").agg(F.min("doc_id").alias("doc_id")), "reps")
    lists = index_lists(docs, order, gram, percent).repartition("token").sortWithinPartitions("token", "place")
    members = scratch.put(groups_of_lists(lists, percent).distinct(), "members")
    # Rows that repeat an id and its text may double a sketch or a set, which does no harm.
    sketches = seen.where("kind = 0 and n > 0").select(F.col("a").alias("doc_id"), "fp", F.col("sketch").alias("content")).join(classes, ["doc_id", "fp"]).select("fp", "content")
    members = scratch.put(hopeful_members(members.join(classes.select("fp", "n"), "fp"), sketches, percent), "hopeful")
    wanted = scratch.put(classes.join(members.select("fp").distinct(), "fp"), "wanted")
    own = scratch.put(sets_of(docs, wanted.select("doc_id", "fp"), gram), "sets")
    links = scratch.put(links_of_groups(members.join(wanted.select("fp", "n"), "fp"), own.withColumnRenamed("own", "content"), percent).distinct(), "links")
    scratch.drop("members", "hopeful", "wanted", "sets")
    whole = scratch.put(connected_components(links, scratch, "whole"), "whole")
    scratch.drop("links")

    lowest = classes.join(whole.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component_id", "fp"))
    lowest = scratch.put(lowest.select("fp", "doc_id", "component"), "classes")
    named = lowest.join(lowest.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("fp", "component_id")
    named = scratch.put(named, "named")
    scratch.drop("classes", "whole")
    out = sets.join(named, "fp", "left")
    own_id = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own_id.alias("component_id"))


def keep_one(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; rows with an empty set or no id all stay.

    Of rows that repeat an id with a non-empty set, one stays.
    """
    ids = similar_components(docs, gram, percent).where("doc_id is not null").groupBy("doc_id")
    ids = ids.agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n"), F.min("component_id").alias("component_id"))
    scratch, name = Scratch(docs.sparkSession, "keep-one"), fresh_name(docs)
    ids = ids.where("n > 0 and (component_id <> doc_id or rows > 1)").select(F.col("doc_id").alias(name), (F.col("component_id") == F.col("doc_id")).alias(f"{name}_first"))
    ids = scratch.put(ids, "ids")
    same = F.col("doc_id") == F.col(name)
    rest = docs.join(ids.select(name), same, "left_anti")
    first = ids.where(f"{name}_first").select(name)
    if first.isEmpty():  # no row repeats an id
        return rest
    return rest.unionByName(docs.join(first, same, "left_semi").dropDuplicates(["doc_id"]))
