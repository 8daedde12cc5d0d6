"""Exact n-gram Jaccard join of whole texts, answered as classes and components.

Sets are distinct word shingles, hashed to 64 bits. Two sets link when ``100 * |x & y| >= percent * |x | y|``.

* Equal sets collapse to one class; only its representative is joined, so copies cost nothing however many they are.
* Index: each set enters the inverted lists of its prefix, the (1 - t) n + 1 rarest shingles under one global order:
  first by the frequency that their words suggest, and last those that are frequent themselves in a share of all documents. Any
  order gives the same links; this one keeps lists short. A list is sorted by set size and cut into blocks of sizes that
  a factor t spans: a set meets its own and the neighbouring block, and skips all others (index-level skipping). Entries
  carry their position in their set, which bounds the overlap that a pair can still reach.
* Answers: the first pass links each entry only to its predecessor and to its blocks' leaders, the entries of smallest
  position, so a list of any length gives a linear number of candidates. Verified links form components. In the second
  pass a set takes over the answer of a highly similar set: pairs inside one component are known to be connected and are
  skipped; only lists that still hold several components are joined, pair by pair, where positions
  leave room for the overlap that a link needs (answer-level skipping).
* Before texts are fetched to verify a pair, the sets' signatures are compared: counts of their hashes by low bits, about
  four a bucket. The counts' differences are a lower bound of the symmetric difference, so no link is lost.

No pair that could connect two components is left out, and no list or component is gathered in one place: lists are
range-partitioned by (shingle, size, id), so long ones spread over several tasks.

Defined results: null or empty texts have no shingles and link with nothing; texts shorter than one shingle count as
one shingle, the whole sequence; rows without an id get a null component unless their text equals that of a row with
one; each row of a repeated id is judged by its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import bitmap_of, components, fresh, in_bitmap, persisted, release, small_batches

#: One document in so many has its shingles counted; from this count on a shingle is frequent.
COUNTED, FREQUENT = 8, 4
#: Documents, at most about, whose words are counted.
SAMPLE_DOCS = 6000
#: Frequent shingles and words remembered, at most.
DICTIONARY, VOCABULARY = 1 << 18, 1 << 16
#: Word hashes kept by a worker before it starts anew.
_WORDS = 1 << 17


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _shingles(lowered: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, and of its shingles in order, repeats included. A-Z are lower-cased already."""
    found = lowered.split()  # on blank, \t, \n, \v, \f and \r, and nothing else
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    lookup = _hashes
    h = np.fromiter([lookup[w] for w in found], dtype=np.uint64, count=len(found))
    span = min(words, len(found))
    out = np.full(len(h) - span + 1, np.uint64(span))
    for k in range(span):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - span + 1 + k])
    return h, out


def shingle_set(lowered: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text whose A-Z are lower-cased already."""
    return np.unique(_shingles(lowered, words)[1])


def signature(s: np.ndarray) -> bytes | None:
    """Counts of a set's hashes by their low bits, about four to eight a bucket; none if one doesn't fit a byte."""
    buckets = 1 << max(4, (len(s) // 4).bit_length() - 1)
    counts = np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their signatures."""
    x, y = (np.frombuffer(v, dtype=np.uint8).astype(np.int64) for v in (x, y))
    n = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, n).sum(axis=0) - y.reshape(-1, n).sum(axis=0)).sum())


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _prefix_length(n: np.ndarray | int, percent: int):
    """Sets of size n that link share a shingle among this many first ones of each."""
    return n - (percent * n + 99) // 100 + 1


def _least_overlap(nx, ny, percent: int):
    """The smallest intersection with which sets of these sizes link: i >= p/(100+p) * (nx+ny)."""
    return -((-percent * (nx + ny)) // (100 + percent))


def _span(percent: int) -> float:
    """The logarithm of the sizes that a block spans: a little over a factor 100 / percent, so that sets that link are at most one block apart."""
    return max(-float(np.log(percent / 100)), 1e-6) * 1.000001


def _vocabulary(docs: DataFrame, sample_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a sample of documents: frequent words (sorted hashes, log2 of shares)."""
    total = docs.count()
    edge = int(min(1.0, sample_docs / max(total, 1)) * (1 << 32))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 32)) < edge)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingles(t.encode().lower(), 1)[0] for t in batch["text"].to_pylist() if t]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": _signed(h), "n": n.astype(np.int64)})

    table = drawn.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(VOCABULARY).toArrow()
    h, n = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(h, kind="stable")
    return h[order], np.log2(n[order] / max(n.sum(), 1))


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles (sorted hashes, counts) of a fixed share of all documents, so that a shingle's number of
    documents from which it is known to be frequent does not grow with the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.encode().lower(), words) for t in batch["text"].to_pylist() if t]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": _signed(h), "n": n.astype(np.int32)})

    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(COUNTED)) == 0)
    table = drawn.select("text").mapInArrow(count, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(DICTIONARY).toArrow()
    h, n = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(h, kind="stable")
    return h[order], n[order]


def _ordered(text: str, words: int, frequent: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """A text's set, sorted, and the rank of each shingle in the global order."""
    h, every = _shingles(text.encode().lower(), words)
    s, first = np.unique(every, return_index=True)
    return s, _ranks(h, every, first, s, words, frequent) if len(s) else np.zeros(0, dtype=np.int64)


def _ranks(h: np.ndarray, shingles: np.ndarray, first: np.ndarray, distinct: np.ndarray, words: int, frequent: tuple[np.ndarray, ...]) -> np.ndarray:
    """The place of a set's shingles in the global order, up to their hash: small for rare ones."""
    known, counts, vocabulary, shares = frequent
    log = np.full(len(h), -24.0)
    if len(vocabulary):
        k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        log = np.where(vocabulary[k] == h, shares[k], log)
    span = len(h) - len(shingles) + 1
    run = np.concatenate([[0.0], np.cumsum(log)])
    expected = run[span:] - run[:-span]
    rank = np.round(2 * (expected[first] + 24.0 * words)).astype(np.int64)
    if len(known):
        k = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        rank = np.where(known[k] == distinct, (1 << 20) + counts[k], rank)
    return rank


def _sets(docs: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, ...]) -> DataFrame:
    """A row a document: id, set size, fingerprint and signature of the set, and the prefix in global order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most DICTIONARY and VOCABULARY entries

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, prints, signatures, prefixes = [], [], [], []
                for text in batch["text"].to_pylist():
                    s, rank = _ordered(text or "", words, shared.value)
                    sizes.append(len(s))
                    prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signatures.append(signature(s))
                    prefix = s[:0]
                    if len(s):
                        prefix = s[np.argsort(rank, kind="stable")[: _prefix_length(len(s), percent)]]
                    prefixes.append(_signed(prefix))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                    ["doc_id", "n", "print", "signature", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id long, n long, print binary, signature binary, prefix array<long>")


def _sweep(index: DataFrame, percent: int) -> DataFrame:
    """One pass over the sorted index: linear candidates (a, b), and the entries (b null) of lists with several sets."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one partition of the index, a few numbers an entry
        if not held:
            return
        table = pa.Table.from_batches(held)
        t, n, node, pos = (table[c].to_numpy() for c in ("t", "n", "node", "pos"))
        new = np.concatenate([[True], t[1:] != t[:-1]])
        lists = np.cumsum(new) - 1
        size = np.bincount(lists)[lists]
        # a list may go on in the next partition, so the outermost ones are always kept
        live = (size > 1) | (lists == 0) | (lists == lists[-1])
        block = np.floor(np.log(n) / _span(percent)).astype(np.int64)
        head = new | np.concatenate([[True], block[1:] != block[:-1]])
        here = np.arange(len(t))
        blocks = np.cumsum(head) - 1
        order = np.lexsort((here, pos, blocks))
        leaders = order[np.searchsorted(blocks[order], np.arange(blocks[-1] + 1))]
        leader = leaders[blocks]
        before = leaders[np.maximum(blocks - 1, 0)]  # leader of the block before, if in the same list
        a = np.concatenate([here, here, here])
        b = np.concatenate([leader, before, np.maximum(here - 1, 0)])
        ok = (t[a] == t[b]) & (node[a] != node[b])
        a, b = a[ok], b[ok]
        reach = 1 + np.minimum(n[a] - pos[a] - 1, n[b] - pos[b] - 1)
        ok = reach >= _least_overlap(n[a], n[b], percent)
        a, b = node[a[ok]], node[b[ok]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (pairs[:, 0], pairs[:, 1])] + [pa.nulls(len(pairs), pa.int64())] * 3, ["a", "b", "t", "n", "pos"]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[live]), pa.nulls(int(live.sum()), pa.int64())] + [pa.array(x[live]) for x in (t, n, pos)], ["a", "b", "t", "n", "pos"]
        )

    return index.mapInArrow(sweep, "a long, b long, t long, n long, pos long")


def _plausible(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures allow a link."""
    one, two = (signatures.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("signature").alias(f"s_{k}")) for k in "ab")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b["n_a"].to_numpy(), b["n_b"].to_numpy()
            most = na + nb - 2 * _least_overlap(na, nb, percent)
            kept = [k for k, (x, y, d) in enumerate(zip(b["s_a"].to_pylist(), b["s_b"].to_pylist(), most)) if x is None or y is None or apart(x, y) <= d]
            yield b.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(weigh, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of representatives whose sets link, checked exactly from their whole texts."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(ends, "node"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(in_bitmap(ids.astype(np.int64), shared.value))
            for at in range(0, len(keep), 512):
                part = keep[at : at + 512]
                texts = batch["text"].take(pa.array(part)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part].astype(np.int64)), pa.array([deflate.compress(t.encode().lower()) for t in texts], pa.binary())], ["node", "body"]
                )

    bodies = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(pack, "node long, body binary")
    one, two = (bodies.select(F.col("node").alias(k), F.col("body").alias(f"body_{k}")) for k in "ab")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor()
        last_body, last_set = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            kept = []
            for k, (x, y) in enumerate(zip(batch["body_a"], batch["body_b"])):
                y = y.as_py()
                if y != last_body:
                    last_body, last_set = y, shingle_set(inflate.decompress(y), words)
                other = shingle_set(inflate.decompress(x.as_py()), words)
                common = len(np.intersect1d(other, last_set, assume_unique=True))
                union = len(other) + len(last_set) - common
                if union and 100 * common >= percent * union:
                    kept.append(k)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "body_a", "body_b").mapInArrow(check, "a long, b long")


def join_sets(docs: DataFrame, words: int = 3, percent: int = 90, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, and representative, the smallest id of its class."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    vocabulary = _vocabulary(docs, sample_docs)
    frequent = (*_frequent(docs, words), *vocabulary)
    sets = persisted(_sets(docs, words, percent, frequent), "sets")
    del frequent, vocabulary
    release()
    classes = sets.where("n > 0").groupBy("print", "n").agg(F.min("doc_id").alias("node"))
    # rows of a representative; copies add nothing to the index
    distinct = sets.where("n > 0").join(classes.select("node", F.col("print").alias("print_")), F.expr("doc_id = node and print = print_")).dropDuplicates(["node", "print"])
    signatures = distinct.select("node", "n", "signature")
    index = distinct.select("node", "n", F.posexplode("prefix").alias("pos", "t")).select("t", "n", "node", F.col("pos").cast("long").alias("pos"))
    index = index.repartitionByRange("t", "n", "node").sortWithinPartitions("t", "n", "node")
    swept = persisted(_sweep(index, percent), "swept")
    first = swept.where("b is not null").select("a", "b").distinct()
    first = persisted(_plausible(first, signatures, percent), "first")
    links = persisted(_verified(first, docs, words, percent), "links")
    known = components(links, "links-cc")

    live = swept.where("b is null").select(F.col("a").alias("node"), "t", "n", "pos")
    live = live.join(known, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    # lists with equal members (a passage's shingles, mostly) are one list; an entry keeps its first position
    lists = live.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("of"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("lo < hi")
    lists = persisted(lists.select("t", F.xxhash64("of", "members", "lo", "hi").alias("list")), "lists")
    live = live.join(lists, "t").groupBy("list", "node", "n", "c").agg(F.min("pos").alias("pos"))
    live = persisted(live.withColumn("block", F.floor(F.log(F.col("n").cast("double")) / F.lit(_span(percent)))), "live")
    left = live.select("list", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "pos", "c")], "block")
    right = live.select("list", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "c")], F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    # the larger set of a pair is at its own block, the smaller one at its own and the next; a pair that links passes at
    # the list of its first common shingle, whose positions leave room for the overlap that it needs
    need = F.expr(f"-floor((-{percent}L * (n_a + n_b)) / {100 + percent}D)")
    met = (
        left.join(right, ["list", "block"])
        .where(F.expr(f"c_a <> c_b and (n_a > n_b or (n_a = n_b and node_a > node_b)) and n_b * 100L >= n_a * {percent}L"))
        .where(F.lit(1) + F.least(F.expr("n_a - pos_a - 1"), F.expr("n_b - pos_b - 1")) >= need)
    )
    second = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    second = persisted(_plausible(second, signatures, percent), "second")
    # of those, the ones that the first pass has verified already are done
    more = persisted(_verified(second.join(first, ["a", "b"], "left_anti"), docs, words, percent), "more")
    both = components(links.unionByName(more), "all-cc")
    labelled = classes.join(both, "node", "left").select("print", "n", "node", F.coalesce("component", "node").alias("component"))
    return sets.select("doc_id", F.col("n").alias("n_shingles"), "print").join(
        labelled.withColumnRenamed("n", "n_shingles"), ["print", "n_shingles"], "left"
    ).select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("node")).alias("representative"),
    )


def one_of_each(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one row of each group that is linked, over however many links: the one of the smallest id.

    Rows are told apart by id and text, so of two texts that share an id each stays or goes by its own links. Rows
    without an id come after all others. Of linked rows of one id the smaller hash stays; of rows equal in id and text, the
    first by its other columns. Texts without words are linked with nothing, so all rows of such texts stay.
    """
    own = fresh(docs, "own")
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*names, F.xxhash64("doc_id", "text").alias(own))
    found = join_sets(keyed.select(F.col(own).alias("doc_id"), "text"), words, percent).where("n_shingles > 0")
    found = persisted(found.groupBy(F.col("doc_id").alias(own)).agg(F.first("component_id").alias("component"), F.count("*").alias("rows")), "found")
    ids = keyed.select(own, "doc_id").join(found, own).select(own, "component", "doc_id")
    best = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(own))).alias("least"))
    gone = found.select(own).join(best.select(F.col(f"least.{own}").alias(own)), own, "left_anti")  # by row, as a component may be large
    kept = keyed.join(persisted(gone, "gone"), own, "left_anti")
    again = persisted(found.where("rows > 1").select(own), "again")
    if again.isEmpty():
        return kept.select(*names)
    whole = F.struct(*names)
    one = kept.join(again, own, "left_semi").groupBy(own).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return kept.join(again, own, "left_anti").select(*names).unionByName(one.select("row.*"))
