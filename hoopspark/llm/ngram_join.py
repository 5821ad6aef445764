"""N-gram Jaccard join by token-combination prefixes.

A text is the set of its word shingles. Shingles have one global order, rare ones first. A set that shares at least the
fraction t of the union with another differs from it in at most e of its own shingles; its prefix is extended until more
than e losses are needed to break all its signatures. Rare shingles are signatures by themselves; frequent ones fall by a
hash into classes of a few shingles per text, and combinations of k of a class are signatures (k grows with frequency), so
a class of m shingles in the prefix stands m - k + 1 losses. The order is counted on a fixed share of all possible
shingles, which comes first in it; texts with too few shingles there take part with all of theirs. Signatures carry the
size class of the sets, own and next smaller, so that texts of far sizes never meet.

Equal sets are one class, known by its smallest id. Classes that share a signature are candidates; their signatures are
taken once more from an order counted on all their shingles, in which far fewer meet. Then every candidate is
verified against one hub of each signature, which joins most groups of near copies; last only pairs that are not yet in
one component, and whose parity sketches leave room for the similarity, are verified, with all their shingles. No link between different components is left out, and a group of
copies is never paired with itself.

Null texts and texts without words are empty sets and linked with nothing; a null id takes part in no link and has no
component; rows that repeat an id are one node; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopspark.llm.components import components
from hoopspark.llm.shared import LIMIT_BROADCAST, distinct_pairs, lean, mix, shingles, span_hashes, text_slices, word_spans
from hoopspark.session import condensed, remove, written

WORDS, PERCENT = 3, 90
PAIRS_FROM, TRIPLES_FROM = 64, 4096      # documents from which a shingle is combined in twos and in threes
PER_CLASS = {2: 10, 3: 6}                # losses that a class of pairs and one of triples should stand, about
HUB_ROUNDS = 2
SKETCH_WORDS = 16                        # 64-bit words of a parity sketch
CARRIED_WORDS = 2                        # sketches up to this long are compared with every hub, too


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, distinct shingle hashes, row of each) of slices of a batch, by row and hash."""
    for first, past, data, offsets in text_slices(batch):
        start, end, owner = word_spans(data, offsets)
        found, whose = shingles(span_hashes(data, start, end, folded=True), owner, past - first, words)
        yield first, past - first, *distinct_pairs(found, whose)


def _fingerprints(found: np.ndarray, whose: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, the same for the same set."""
    sums = []
    for odd in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(found ^ odd), dtype=np.uint64)])
        ends = np.searchsorted(whose, np.arange(rows), "right")
        starts = np.searchsorted(whose, np.arange(rows), "left")
        sums.append(total[ends] - total[starts])
    return sums[0], sums[1]


def _profile(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, found, whose in _sets(batch, words):
                f1, f2 = _fingerprints(found, whose, rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(np.bincount(whose, minlength=rows)),
                                                  pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))], names=["id", "n", "f1", "f2"])
    return run


def losses(n, percent: int):
    """Shingles of a set of n that a linked set may lack, at most."""
    return n - -(-n * percent // 100)


def classes_of(n, percent: int, kind: int):
    return np.maximum(1, losses(n, percent) // PER_CLASS[kind])


def share(percent: int) -> np.uint64:
    """Hashes below this belong to the share of shingles that the order is counted on: a prefix of texts of usual length
    fits in it."""
    return np.uint64(min((1 << 64) - 1, int(1.9 * (100 - percent) / 100 * (1 << 64))))


def size_edges(percent: int, up_to: int = 1 << 40) -> np.ndarray:
    """Sizes at which a size class begins: a linked set is in the same class or the next."""
    edges = [1]
    while edges[-1] < up_to:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges)


def _tokens(words: int, percent: int):
    """(token, set, n, n_first, whole): the shingles that the order is counted on, once per set and task."""
    smallest = 1
    while losses(smallest, percent) == 0 and not (smallest * 100 >= percent * (smallest + 1)):
        smallest += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, rows, found, whose in _sets(batch, words):
                f1 = _fingerprints(found, whose, rows)[0]
                n = np.bincount(whose, minlength=rows)
                first = found <= share(percent)
                n_first = np.bincount(whose, first, minlength=rows).astype(np.int64)
                few = n_first < losses(n, percent) + 1 + classes_of(n, percent, 2) + 2 * classes_of(n, percent, 3)
                new = np.array([n[i] >= smallest and f not in seen for i, f in enumerate(f1.tolist())], bool)
                _, at = np.unique(f1, return_index=True)
                once = np.zeros(rows, bool)
                once[at] = True
                new &= once
                seen.update(f1[new].tolist())
                keep = new[whose] & (first | few[whose])
                w = whose[keep]
                yield pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(f1[w].view(np.int64)), pa.array(n[w].astype(np.int32)),
                                                  pa.array(n_first[w].astype(np.int32)), pa.array(few[w])], names=["token", "f1", "n", "n_first", "whole"])
    return run


def signatures_of(tokens: np.ndarray, df: np.ndarray, n: int, n_first: int, whole: bool, percent: int, edge: int,
                  limit: np.uint64) -> list[int]:
    """Signatures of a set for the size class that begins at edge. tokens: those that more than one set
    has; the order begins with those up to limit, of which the set has n_first."""
    first = tokens <= limit
    order = np.lexsort((tokens, df, ~first))
    tokens, df, first = tokens[order], df[order], first[order]
    need = losses(n, percent) + 1
    alone = n_first - int(first.sum()), (n - n_first - int((~first).sum())) if whole else 0
    kinds = np.where(df < PAIRS_FROM, 1, np.where(df < TRIPLES_FROM, 2, 3))
    n_classes = np.where(kinds == 3, classes_of(edge, percent, 3), classes_of(edge, percent, 2)).astype(np.uint64)
    group = (mix(tokens) % n_classes).astype(np.int64)
    have, members, singles, outside = alone[0], {}, [], False
    for token, kind, g, inside in zip(tokens.tolist(), kinds.tolist(), group.tolist(), first.tolist()):
        if not inside and not outside:
            outside, have = True, have + alone[1]
        if have >= need:
            break
        if kind == 1:
            singles.append(token)
            have += 1
        else:
            members.setdefault((kind, g), []).append(token)
            have += len(members[kind, g]) >= kind
    if not outside:
        have += alone[1]
    if have < need:
        raise ValueError("a prefix of all shingles is too short")
    out = [hash((edge, t)) for t in singles]
    for (kind, g), own in members.items():
        out += [hash((edge, kind, g) + c) for c in combinations(own, kind)]
    return out


def _signatures(percent: int, limit: np.uint64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = size_edges(percent)
        for batch in batches:
            owner, sigs, sizes = [], [], []
            for i, (name, n, n_first, whole, tokens, df) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)))):
                t, at = np.unique(np.array(tokens, np.int64).view(np.uint64), return_index=True)
                d = np.array(df, np.int64)[at]
                if n_first - int((t <= limit).sum()) > losses(n, percent):
                    continue
                b = int(np.searchsorted(edges, n, "right")) - 1
                for edge in {int(edges[b]), int(edges[max(0, b - 1)])}:
                    own = set(signatures_of(t, d, n, n_first, whole, percent, edge, limit))
                    sigs += own
                    owner += [name] * len(own)
                    sizes += [n] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(owner, pa.int64()), pa.array(sizes, pa.int32())], names=["sig", "name", "n"])
    return run


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, found, whose in _sets(batch, words):
                n = np.bincount(whose, minlength=rows)
                cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.view(np.int64))),
                                                  pa.array(_fingerprints(found, whose, rows)[0].view(np.int64)), pa.array(n.astype(np.int32))],
                                                 names=["id", "tokens", "k", "n"])
    return run


def narrowed(sets: DataFrame, percent: int) -> DataFrame:
    """(sig, id, n): signatures of the candidates again, in an order counted on all shingles that candidates have. A set
    with more shingles of its own than it may lose has none, so copies that differ too much are no candidates any more."""
    rows = sets.select("id", "k", "n", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(counts, "token").groupBy("id", "k", "n").agg(F.collect_list("token").alias("tokens"), F.collect_list("df").alias("df"))
    return (shared.select("id", "n", F.col("n").alias("n_first"), F.lit(False).alias("whole"), "tokens", "df")
            .mapInArrow(lean(_signatures(percent, np.uint64((1 << 64) - 1))), "sig long, id long, n int").distinct())


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A counted table, to be broadcast if it is small."""
    return F.broadcast(df) if rows <= LIMIT_BROADCAST else df


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough."""
    left, right = (sets.select(F.col("id").alias(x), F.col("tokens").alias(f"{x}_tokens")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(100 * common >= percent * (F.size("a_tokens") + F.size("b_tokens") - common)).select("a", "b").distinct()


def _sketch(n_words: int):
    """For each set, whether the number of its shingles that fall on each of 64 n_words places is odd."""
    places = 64 * n_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column(1)
                bits = (mix(lists.flatten().to_numpy().view(np.uint64)) % np.uint64(places)).astype(np.int64)
                owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
                odd = np.bincount(owner * places + bits, minlength=part.num_rows * places).reshape(part.num_rows, -1) & 1
                words = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, np.ascontiguousarray(words.T))], names=["id", *(f"s{i}" for i in range(n_words))])
    return run


def sketches(sets: DataFrame, n_words: int = SKETCH_WORDS) -> DataFrame:
    """id and the parity sketch of its set. Where two sketches differ the sets do: their distance in bits is never more than the number
    of shingles that only one of two sets has."""
    return sets.select("id", "tokens").mapInArrow(lean(_sketch(n_words)), "id long, " + ", ".join(f"s{i} long" for i in range(n_words))).dropDuplicates(["id"])


def _may_reach(percent: int, n_words: int):
    """Whether two sketches leave room for the similarity: of sets of a and b shingles, linked ones have at most
    (a + b) (100 - percent) / (100 + percent) shingles apart."""
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, n_words)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    return apart * (100 + percent) <= (F.col("an") + F.col("bn")) * (100 - percent)


def _close(percent: int, x: str, y: str):
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _side(side: str, n_words: int) -> list:
    """The columns of one of two sides of a comparison."""
    return [F.col("id").alias(side), F.col("n").alias(f"{side}n"), F.col("label").alias(f"{side}l"), *(F.col(f"s{i}").alias(f"{side}{i}") for i in range(n_words))]


def links_of(sigs: DataFrame, sets: DataFrame, percent: int, n_words: int = SKETCH_WORDS) -> DataFrame:
    """Links between classes, enough of them to connect all that are connected. sigs: stored (sig, id, n). Sketches of n_words
    words stand beside the signatures from the start if they are short, else only in the last join."""
    spark = sigs.sparkSession
    early = n_words if n_words <= CARRIED_WORDS else 0
    known = written(sigs.join(sketches(sets, n_words), "id"), "sketched") if early else sigs
    fits = _close(percent, "an", "bn") & (F.col("al") != F.col("bl"))
    fits_early = fits & _may_reach(percent, early) if early else fits
    found, label = spark.createDataFrame([], "a long, b long"), None
    for turn in range(HUB_ROUNDS):
        rows = known.withColumn("label", F.col("id")) if label is None else known.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
        rank = F.struct((F.xxhash64("id", F.lit(turn)) if turn else F.col("id")).alias("rank"), "id", "n", "label", *(f"s{i}" for i in range(early)))
        hubs = rows.groupBy("sig").agg(F.min(rank).alias("hub"), F.count("*").alias("k")).where("k > 1").select("sig", "hub.*")
        pairs = written(rows.select("sig", *_side("b", early)).join(hubs.select("sig", *_side("a", early)), "sig").where(fits_early).select("a", "b").distinct(), "pairs")
        before, found = found, written(found.unionByName(verified(pairs, sets, percent)), "verified")
        remove(pairs, before)
        before, label = label, written(components(found, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("label")), "labels")
        if before is not None:
            remove(before)
    rows = known.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = rows.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("sig")
    unmet = written(rows.join(mixed, "sig"), "open")
    if not early:
        bare, unmet = unmet, written(unmet.join(sketches(sets.join(unmet.select("id").distinct(), "id", "left_semi"), n_words), "id"), "open")
        remove(bare)
    a, b = (unmet.select("sig", *_side(side, n_words)) for side in "ab")
    rest = written(a.join(b, "sig").where((F.col("a") < F.col("b")) & fits & _may_reach(percent, n_words)).select("a", "b").distinct(), "pairs")
    remove(unmet, label)
    return found.unionByName(verified(rest, sets, percent))


def _labels(texts: DataFrame, known: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the classes that have links. texts: (id, text); known: (n, f1, f2, rep)."""
    tokens = texts.where("id is not null").mapInArrow(lean(_tokens(words, percent)), "token long, f1 long, n int, n_first int, whole boolean")
    tokens = tokens.select("token", F.struct("f1", "n", "n_first", "whole").alias("s"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(counts, "token").groupBy("s").agg(F.collect_list("token").alias("tokens"), F.collect_list("df").alias("df"))
    raw = shared.select("s.f1", "s.n", "s.n_first", "s.whole", "tokens", "df").mapInArrow(lean(_signatures(percent, share(percent))), "sig long, f1 long, n int")
    rows = written(raw.join(known.select("f1", F.col("n").cast("int").alias("n"), F.col("rep").alias("id")), ["f1", "n"]).select("sig", "id", "n").distinct(), "signatures")
    several = rows.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig")
    sigs = written(rows.join(several, "sig"), "signatures")
    remove(rows)
    ids = written(sigs.select("id").distinct(), "candidates")
    remove(sigs)
    whole = texts.join(bounded(ids, ids.count()), "id", "left_semi").mapInArrow(lean(_whole_sets(words)), "id long, tokens array<long>, k long, n int")
    sets = written(whole, "sets")
    return components(links_of(written(narrowed(sets, percent), "signatures"), sets, percent), "a", "b")


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile = written(texts.mapInArrow(lean(_profile(words)), "id long, n long, f1 long, f2 long"), "profile")
    named = profile.where("id is not null and n > 0")
    known = written(named.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep")), "classes")
    label = condensed(docs.sparkSession, lambda: _labels(texts, known, words, percent), "components")
    placed = known.join(label, known["rep"] == label["node"], "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = profile.join(placed, ["n", "f1", "f2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the smallest id of every component, with their own columns; rows without an id or words stay, and rows
    that repeat an id stay or go together."""
    gone = condensed(docs.sparkSession, lambda: join_components(docs, words, percent, id_col, text_col).where(F.col("component_id") < F.col(id_col)).select(id_col).distinct(), "removed")
    return docs.join(bounded(gone, gone.count()), id_col, "left_anti").select(*docs.columns)
